"""BPE encoding and decoding over a table of distinct words.

Documents become sequences of word numbers by block (see `words`).  The
distinct words of all blocks meet by bucket, each is encoded once, and the ids
go back to each block that has the word, where they are joined to the positions
by number.  Decoding joins every id to its piece: the id-to-piece table is as
long as the vocabulary, so each task holds it whole, and the join is a gather.
All three joins are over arrays of a block rather than over rows of one word,
which would move some forty bytes for each word of the corpus.

A word here is a chunk after which the tokenizer always cuts (see `tokens`): a
word with the white space before it, or the rest of a longer run of white space.

Defined cases: null text is empty: no ids.  Repeated rows and rows of null
doc_id keep a row each.  No rows: no result rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tokens import byte_symbols, encoder, ragged


class Pieces:
    """The id-to-piece table of a byte-level vocabulary."""

    def __init__(self, tokenizer: str):
        with open(tokenizer, encoding="utf-8") as f:
            model = json.load(f)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        table = {i: bytes(byte[c] for c in s) for s, i in model["model"]["vocab"].items() if all(c in byte for c in s)}
        table |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        pieces = [table.get(i, b"") for i in range(max(table) + 1)]
        self.n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces of ``ids``, one after the other."""
        return self.flat[ragged(self.first[ids], self.n[ids])]


_PIECES: dict[str, Pieces] = {}


def pieces(tokenizer: str) -> Pieces:
    if tokenizer not in _PIECES:
        _PIECES[tokenizer] = Pieces(tokenizer)
    return _PIECES[tokenizer]


def _cut(tokenizer: str) -> Callable[[], Callable[[str], list]]:
    def make() -> Callable[[str], list]:
        enc = encoder(tokenizer)

        def cut(text: str) -> list[str]:
            return enc.chunks(text) if text else []

        return cut

    return make


def word_ids(of_words: DataFrame, tokenizer: str) -> DataFrame:
    """(block, bucket, data) for `words.words_of` rows: a bucket's words, of all blocks, are encoded once each.

    data: how many ids each word has, and the ids of all.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(tokenizer)
        parts = [words.read_words(x)[0] for x in rows["data"]]
        number: dict[bytes, int] = {}
        for own in parts:
            for w in own:
                number.setdefault(w, len(number))
        keys = [w.decode() for w in number]
        enc.memo = {}
        enc.learn(keys)
        found = [enc.memo[k] for k in keys]
        enc.memo = {}
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, flat = np.cumsum(n) - n, np.frombuffer(b"".join(found), "<u4")
        packed = []
        for own in parts:
            at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            packed.append(words.join(words.squeeze(n[at]), words.squeeze(flat[ragged(first[at], n[at])])))
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "data": packed})

    return of_words.groupBy("bucket").applyInPandas(run, "block long, bucket int, data binary")


def encoded(docs: DataFrame, tokenizer: str, finish: Callable[[bytes, bytes], tuple], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, n_tokens, and what ``finish(ids, decoded)`` gives) for each document.

    ``ids`` are little-endian uint32, ``decoded`` the text in UTF-8.
    """
    table = words.coded(docs, _cut(tokenizer), F.lit(False), "bpe-words", words.bucket_count(docs, text), key, text)
    known = word_ids(words.words_of(table), tokenizer)
    schema = f"doc_id long, n_tokens long, {schema}"

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        place, data = words.by_number(rows, answers)
        of_bucket = [[words.unsqueeze(x) for x in words.split(d)] for d in data]
        n = np.concatenate([np.empty(0, np.int64), *(x[0].astype(np.int64) for x in of_bucket)])
        flat = np.concatenate([np.empty(0, np.uint32), *(x[1].astype(np.uint32) for x in of_bucket)])
        first = (np.cumsum(n) - n)[place]
        n = n[place]
        table, out = pieces(tokenizer), []
        for doc_ids, _, sizes, numbers in words.documents_of(rows):
            ends = np.cumsum(sizes)
            for doc, a, z in zip(doc_ids, (ends - sizes).tolist(), ends.tolist(), strict=True):
                own = numbers[a:z]
                ids = flat[ragged(first[own], n[own])]
                decoded = table.join(ids).tobytes()
                out.append((doc, len(ids), *finish(ids.astype("<u4").tobytes(), decoded.decode(errors="replace").encode())))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    left = table.filter(F.col("kind").isin(words.DOCUMENTS, words.ORDER)).groupBy("block")
    return left.cogroup(known.groupBy("block")).applyInPandas(run, schema)


def sha256_pair(ids: bytes, decoded: bytes) -> tuple[str, str]:
    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
