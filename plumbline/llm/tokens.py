"""Whole-text encoding as the ``tokenizers`` library does it, each distinct chunk once.

A text is cut around its runs of white space, where a cut cannot change the
result: at the start of a run, and before the last place of a run that a word
follows.  The byte-level tokenizer takes all but the last place of a run as one
piece, and the last one with the word if it is a space, else alone; the
word-level one drops white space.  So every pre-token ends at a cut, and a text's
ids are its chunks' ids one after the other.  A chunk is a word with the
character of white space before it, or what else there is of a run.  Next to
white space on which definitions differ, and before a special token, no cut is
made.  Equal chunks of a block of texts are encoded once, and remembered up to a
bound (`Known`).  Chunks of plain Latin letters with trailing stops are merged all
at once (`BatchMerges`); every other chunk goes to the library itself.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np

TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS_DIR", "/opt/tokenizers")

#: White space outside ``[\\x20\\t-\\r]``, or counted as such by some library, and what else is kept away from cuts.
_ODD = "\x00-\x02\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
_ODD_CHAR = re.compile(f"[{_ODD}]")
#: A run but for its last place; a word and the place before it; a run at the end.
_CHUNK = re.compile(r"[\t-\r ]+(?![^\t-\r ])|[\t-\r ]?[^\t-\r ]+")
_SIMPLE = re.compile(r"[\t\x0b-\r]|[ \n][ \n]|^[ \n]")
_SPACES = "\t\n\x0b\x0c\r "
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(0x09, 0x0E), 0x20]] = True
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!|]*)")
_BLOCK_CHARS = 1_000_000
DEPTH = 4


#: Random odd multipliers by place in a chunk; what a longer chunk needs is left to the library.
_WEIGHTS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.full(256, 9, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[ord(c) for c in ".,!|"]] = 2
_KIND[0xC3] = 3
_KIND[0x80:0xC0] = 4


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder is a parameter, nothing is copied."""
    if TOKENIZER_DIR not in sys.path:
        sys.path.append(TOKENIZER_DIR)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _latin(word: str) -> bool:
    """Whether every character is below U+0100."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class BatchMerges:
    """Byte-pair merging of many short pieces at once.

    Each round finds, for every unfinished piece, its leftmost pair of lowest
    rank and merges it; a piece is done when no pair has a rank.  That is the
    order in which the library merges, so the ids are equal.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + self.suffix, -1) for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 17
        while True:  # a table in which each slot holds at most DEPTH pairs
            slot = self._slot(keys)
            order = np.argsort(slot, kind="stable")
            nth = np.arange(len(keys)) - np.searchsorted(slot[order], slot[order])
            if nth.max(initial=0) < DEPTH:
                break
            self.bits += 1
        self.key = np.full((DEPTH, 1 << self.bits), -1, np.int64)
        self.rank = np.full((DEPTH, 1 << self.bits), len(keys), np.int32)
        self.key[nth, slot[order]], self.rank[nth, slot[order]] = keys[order], order
        self.fill = np.bincount(slot, minlength=1 << self.bits).astype(np.uint8)
        self.made, self.none = made, len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        slot = self._slot(keys)
        out = np.full(len(keys), self.none, np.int32)
        hit = self.key[0][slot] == keys
        out[hit] = self.rank[0][slot[hit]]
        left = np.flatnonzero(~hit & (self.fill[slot] > 1))
        for level in range(1, DEPTH):
            at = slot[left]
            hit = self.key[level][at] == keys[left]
            out[left[hit]] = self.rank[level][at[hit]]
            left = left[~hit & (self.fill[at] > level + 1)]
        return out

    def encode_flat(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces that stand one after the other in ``raw`` (n: their lengths, none zero), and how many each has."""
        counts = np.zeros(len(n), np.int64)
        if not len(n):
            return np.empty(0, np.uint32), counts
        ids = self.first[raw]
        ends = np.cumsum(n) - 1
        ids[ends] = self.last[raw[ends]]
        word = np.arange(len(n))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            start = np.cumsum(n) - n
            rank = np.full(len(ids), self.none, np.int32)
            rank[:-1] = self.ranks(ids[:-1], ids[1:])
            rank[start + n - 1] = self.none
            low = np.minimum.reduceat(rank, start)
            at = np.flatnonzero(rank == np.repeat(low, n))
            owner = np.repeat(np.arange(len(n)), n)[at]
            at = at[np.r_[True, owner[1:] != owner[:-1]]]  # the leftmost of each piece
            live = low < self.none
            if not live.all():
                done.append((word[~live], n[~live], ids[np.repeat(~live, n)].astype(np.uint32)))
            go = at[live]
            ids[go] = self.made[low[live]]
            keep = np.repeat(live, n)
            keep[go + 1] = False
            ids, n, word = ids[keep], n[live] - 1, word[live]
        for w, k, _ in done:
            counts[w] = k
        offset = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for w, k, x in done:
            flat[ragged(offset[w], k)] = x
        return flat, counts

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """ids of each non-empty piece as little-endian uint32 bytes."""
        flat, counts = self.encode_flat(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [data[a:z] for a, z in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[k], starts[k] + 1, ... (lengths[k] of them) for each k, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Known:
    """Chunks seen before and their ids, found by a 64-bit hash and confirmed by their bytes; emptied when ``limit`` is passed."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.key, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by key
        self.n, self.at, self.count, self.first = (np.empty(0, np.int64) for _ in range(4))  # by row
        self.raw, self.ids = np.empty(0, np.uint8), np.empty(0, np.uint32)

    def find(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The row of each chunk, or -1."""
        out = np.full(len(key), -1, np.int64)
        if not len(self.key):
            return out
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        row = self.row[at]
        hit = np.flatnonzero((self.key[at] == key) & (self.n[row] == n))
        row, size = row[hit], n[hit]
        differs = raw[ragged(start[hit], size)] != self.raw[ragged(self.at[row], size)]
        if differs.any():
            same = np.bincount(np.repeat(np.arange(len(hit)), size), differs, len(hit)) == 0
            hit, row = hit[same], row[same]
        out[hit] = row
        return out

    def add(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New chunks; ``key`` is sorted. One whose hash another chunk has is found under neither's place but by the other's bytes."""
        if len(self.key) + len(key) > self.limit:
            self.clear()
        rows = len(self.n) + np.arange(len(key))
        place = np.searchsorted(self.key, key)
        self.key, self.row = np.insert(self.key, place, key), np.insert(self.row, place, rows)
        self.at = np.r_[self.at, len(self.raw) + np.cumsum(n) - n]
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(counts) - counts]
        self.n, self.count = np.r_[self.n, n], np.r_[self.count, counts]
        self.raw, self.ids = np.r_[self.raw, raw[ragged(start, n)]], np.r_[self.ids, ids]


class Encoder:
    """``encode_many(texts)`` yields for each text the bytes of the ids that
    ``library.encode(text, add_special_tokens=False)`` returns (null: none)."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merges = BatchMerges(path)
        self.spaced = not self.merges.suffix  # byte-level: the white space before a word is part of it
        self.memo: dict[str | bytes, bytes] = {}
        self.limit = limit
        self.known = Known(2 * limit)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunks(self, text: str) -> list[str]:
        """Keys of the chunks whose ids, joined, are the text's.

        A key is the chunk without its leading space; ``\\x00`` stands for a
        leading line feed, ``\\x01`` for none (the start of the text), ``\\x02``
        for a chunk that the library has to see as it is.
        """
        if self.cuttable(text) and not _SIMPLE.search(text):  # single spaces and line feeds between words
            return ("\x01" + text).replace("\n", " \x00").split(" ")
        return [self._key(c) for c in self.cut(text)]

    def _key(self, chunk: str) -> str:
        lead, body = chunk[0], chunk[1:]
        if not body or body[0] in "\x00\x01\x02" or lead not in " \n" and lead in _SPACES:
            return "\x02" + chunk
        return body if lead == " " else "\x00" + body if lead == "\n" else "\x02" + chunk

    def cut(self, text: str) -> list[str]:
        """The chunks of a text, one after the other."""
        found = _CHUNK.findall(text)
        if self.cuttable(text):
            return found
        out: list[str] = []
        at = 0
        for c in found:
            # a run starts here, or its last place: what stands before it, or after it, decides
            before, after = text[at - 1] if at else "x", text[at + 1 : at + 2]
            run = c[0] in _SPACES and before not in _SPACES
            held = _ODD_CHAR.match(before) if run else _ODD_CHAR.match(after) or text.startswith(self.added, at + 1)
            if out and held:
                out[-1] += c
            else:
                out.append(c)
            at += len(c)
        return out

    def cuttable(self, text: str) -> bool:
        """Whether every run of white space can be cut around: no odd white space, no special token."""
        return not _ODD_CHAR.search(text) and not any(t in text for t in self.added)

    def learn(self, new: list[str]) -> None:
        """Puts the ids of chunks that are not known yet into the memo."""
        plain: list[str] = []  # a space and letters: one piece each
        parts: list[tuple[str, list[bytes]]] = []  # letters with stops or another lead: several pieces
        for key in new:
            if key.isalpha() and len(key) <= 60 and (key.isascii() or _latin(key)):
                plain.append(key)
                continue
            lead = key[0] if key and key[0] in "\x00\x01\x02" else " "
            body = key if lead == " " else key[1:]
            m = _PLAIN.fullmatch(body) if lead != "\x02" and len(body) <= 60 else None
            if not m:
                text = (" " if lead == " " else "\n" if lead == "\x00" else "") + body
                self.memo[key] = self.library(text) if text else b""
                continue
            stem, stops = m.groups()
            if self.spaced:
                split = [b"\n"] if lead == "\x00" else []
                split.append((" " + stem if lead == " " else stem).encode())
            else:
                split = [stem.lower().encode()]
            if stops:
                split.append(stops.encode())
            parts.append((key, split))
        whole = [(" " + k).encode() for k in plain] if self.spaced else [k.lower().encode() for k in plain]
        few = list({p for _, ps in parts for p in ps})
        ids = self.merges.encode(whole + few)
        self.memo.update(zip(plain, ids, strict=False))
        stems = dict(zip(few, ids[len(whole) :], strict=True))
        self.memo.update([(k, b"".join([stems[p] for p in ps])) for k, ps in parts])

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Works in blocks of about _BLOCK_CHARS, so that memory is bounded."""
        block: list[str] = []
        chars = 0
        for t in texts:
            block.append(t or "")
            chars += len(block[-1])
            if chars >= _BLOCK_CHARS:
                yield from self._block(block)
                block, chars = [], 0
        yield from self._block(block)

    def _block(self, block: list[str]) -> Iterator[bytes]:
        safe = [bool(t) and self.cuttable(t) for t in block]
        found = iter(self._flat([t.encode() for t, s in zip(block, safe, strict=True) if s]))
        for t, s in zip(block, safe, strict=True):
            yield next(found) if s else b"".join(map(self._remember, self.cut(t))) if t else b""

    def _remember(self, chunk: str) -> bytes:
        key = chunk.encode()
        if key not in self.memo:
            if len(self.memo) > self.limit:
                self.memo = {}
            self.memo[key] = self.library(chunk)
        return self.memo[key]

    def _flat(self, texts: list[bytes]) -> list[bytes]:
        """ids of texts that can be cut around every run of white space, without an object for each chunk.

        Chunks are told apart by a 64-bit hash and then compared with the chunk
        that stands for them; equal ones are encoded once a block.
        """
        if not texts:
            return []
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        space = _IS_SPACE[raw]
        before, after = np.r_[False, space[:-1]], np.r_[space[1:], True]
        before[begins] = False
        after[begins[1:] - 1] = True  # a run at the end of a text is one piece
        mark = space & (~before | ~after)
        mark[begins] = True
        start = np.flatnonzero(mark)
        n = np.diff(np.r_[start, len(raw)])
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(start.astype(np.int32), n)
        key = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[np.minimum(place, len(_WEIGHTS) - 1)], start)
        # the first chunk of a text has no lead: its key is its own even where it equals another chunk's tail
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        same = n == n[first][of]
        twin = np.minimum(np.repeat(start[first][of], n) + place, len(raw) - 1)
        if not same.all() or (raw[twin] != raw).any() or int(n.max()) >= len(_WEIGHTS):  # a collision or a very long chunk
            return [self.library(t.decode()) for t in texts]
        ids, counts = self._remembered(key[first], raw, start[first], n[first])
        offset = np.cumsum(counts) - counts
        flat = ids[ragged(offset[of], counts[of])].astype("<u4").tobytes()
        per_text = np.add.reduceat(counts[of], np.searchsorted(start, begins)) * 4
        ends = np.cumsum(per_text)
        return [flat[a:z] for a, z in zip((ends - per_text).tolist(), ends.tolist(), strict=True)]

    def _remembered(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_distinct`; chunks of earlier blocks are not encoded again."""
        known = self.known
        row = known.find(key, raw, start, n)
        old = row >= 0
        new = np.flatnonzero(~old)
        ids, counts = self._distinct(raw, start[new], n[new]) if len(new) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        total = np.empty(len(key), np.int64)
        total[new], total[old] = counts, known.count[row[old]]
        offset = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[ragged(offset[new], counts)] = ids
        out[ragged(offset[old], total[old])] = known.ids[ragged(known.first[row[old]], total[old])]
        known.add(key[new], raw, start[new], n[new], ids, counts)
        return out, total

    def _distinct(self, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct chunks, one after the other, and how many each has."""
        at = ragged(start, n)
        chars, owner = raw[at], np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        lead = np.zeros(len(chars), bool)
        lead[begin] = _IS_SPACE[chars[begin]]
        kind = _KIND[chars]  # 1 letter, 2 stop, 3 first byte of a Latin letter, 4 second byte, 9 other
        before = np.r_[np.uint8(9), kind[:-1]]
        after = np.r_[kind[1:], np.uint8(9)]
        odd = (kind == 9) | (kind == 4) & (before != 3) | (kind == 3) & (after != 4) | (before == 3) & ((chars == 0x97) | (chars == 0xB7))
        kind = np.where((kind == 3) | (kind == 4), np.uint8(1), kind)
        before = np.r_[np.uint8(0), kind[:-1]]
        inner = ~lead & ~np.r_[True, lead[:-1]]
        inner[begin] = False
        odd |= inner & (kind < before)  # a letter after a stop
        odd &= ~lead
        head = np.minimum(begin + lead[begin], len(chars) - 1)
        plain = (np.bincount(owner, odd, len(n)) == 0) & (kind[head] == 1) & ~lead[head] & (n > lead[begin])
        rare = np.flatnonzero(~plain)
        own = plain[owner]
        cut = np.zeros(len(chars), bool)
        cut[begin] = True
        after_lead = np.r_[False, lead[:-1]]
        if self.spaced:
            cut |= after_lead & np.r_[False, chars[:-1] != 0x20]
        else:
            cut |= after_lead
            upper = (chars >= 0x41) & (chars <= 0x5A) | np.r_[False, chars[:-1] == 0xC3] & (chars >= 0x80) & (chars <= 0x9E)
            chars = np.where(upper, chars + np.uint8(0x20), chars)
        cut |= (kind == 2) & ~lead & (np.r_[np.uint8(0), kind[:-1]] != 2)
        use = own if self.spaced else own & ~lead
        flags, stream, whose = cut[use], chars[use], owner[use]
        piece = np.flatnonzero(flags)
        ids, counts = self.merges.encode_flat(stream, np.diff(np.r_[piece, len(stream)]))
        total = np.bincount(whose[piece], counts, len(n)).astype(np.int64)
        texts = [raw[start[k] : start[k] + n[k]].tobytes() for k in rare.tolist()]
        if len(self.memo) > self.limit:
            self.memo = {}
        for t in texts:
            if t not in self.memo:
                self.memo[t] = self.library(t.decode())
        rest = [np.frombuffer(self.memo[t], "<u4") for t in texts]
        total[rare] = [len(r) for r in rest]
        offset = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[ragged(offset[plain], total[plain])] = ids
        if rest:
            out[ragged(offset[rare], total[rare])] = np.concatenate(rest)
        return out, total

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
