"""Texts cut into tokens and segments, many at once, as Arrow functions.

A text's bytes are marked once; tokens, their places in code points and the ends
of segments are sums over those marks, so no token is sorted or compared with
its neighbours in a window.  A column of texts gives a column of arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from . import text as T

#: Bytes of text that are cut at once, about.
BLOCK = 4 << 20

_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ONE = np.zeros(256, bool)
_ONE[[c for c in _SPACES if c < 128]] = True
_MORE = [np.frombuffer(chr(c).encode(), np.uint8) for c in _SPACES if c >= 128]
_CLOSERS = "\"'»”’)]}"
_TERMINAL = tuple(".!?…。！？")
_LAST = np.zeros(256, bool)
_LAST[[c.encode()[-1] for c in (*_CLOSERS, *_TERMINAL)]] = True
_ENUMERATION = re.compile(T.ENUMERATION)
_ABBREVIATIONS = frozenset(T.ABBREVIATIONS)


def ends_sentence(token: str) -> bool:
    """As `text.ends_sentence`."""
    if not token.rstrip(_CLOSERS).endswith(_TERMINAL):
        return False
    low = token.lower()
    return low not in _ABBREVIATIONS and not _ENUMERATION.match(low)


class Cut:
    """Tokens of some texts: where each begins and ends in ``data`` (bytes) and in its text (code points)."""

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.bytes = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
        self.offsets = offsets - offsets[0]
        data = self.data = np.frombuffer(self.bytes, np.uint8)
        space = _ONE[data]
        if len(data) and data.max() >= 128:
            for lead in sorted({int(s[0]) for s in _MORE}):
                at = np.flatnonzero(data == lead)
                for s in _MORE:
                    if s[0] != lead:
                        continue
                    own = at[at + len(s) <= len(data)]
                    for k in range(1, len(s)):
                        own = own[data[own + k] == s[k]]
                    for k in range(len(s)):
                        space[own + k] = True
        edge = np.zeros(len(data) + 1, bool)  # where a text begins
        edge[self.offsets] = True
        word = ~space
        self.lo = np.flatnonzero(word & (edge[:-1] | np.r_[True, space[:-1]])) if len(data) else np.empty(0, np.int64)
        self.hi = np.flatnonzero(word & (edge[1:] | np.r_[space[1:], True])) + 1 if len(data) else np.empty(0, np.int64)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)]
        self.first = np.searchsorted(self.lo, self.offsets)  # a text's first token, by text
        self.count = np.diff(self.first)
        base = np.repeat(points[self.offsets[:-1]], self.count)
        self.start, self.end = points[self.lo] - base, points[self.hi] - base

    def strings(self, lo: np.ndarray, hi: np.ndarray) -> pa.StringArray:
        """The stretches lo..hi - 1 of the bytes; in order, without overlaps."""
        ends = np.empty(2 * len(lo) + 1, np.int32)
        ends[0], ends[1::2], ends[2::2] = 0, lo, hi
        cut = pa.StringArray.from_buffers(2 * len(lo), pa.py_buffer(ends), pa.py_buffer(self.bytes))
        return cut.take(pa.array(np.arange(1, 2 * len(lo), 2)))

    def breaks(self) -> np.ndarray:
        """Whether a segment ends after each token."""
        out = np.zeros(len(self.lo), bool)
        if not len(out):
            return out
        lines = np.r_[0, np.cumsum(self.data == 10, dtype=np.int32)]
        out[:-1] = lines[self.lo[1:]] > lines[self.hi[:-1]]
        known: dict[bytes, bool] = {}
        for k in np.flatnonzero(~out & _LAST[self.data[self.hi - 1]]).tolist():
            token = self.bytes[self.lo[k] : self.hi[k]]
            if token not in known:
                known[token] = ends_sentence(token.decode("utf-8", "replace"))
            out[k] = known[token]
        out[self.first[1:][self.count > 0] - 1] = False  # a text's last token ends none
        return out

    def segment(self) -> np.ndarray:
        """The segment of each token."""
        before = np.r_[0, np.cumsum(self.breaks(), dtype=np.int32)][:-1]
        return before - np.repeat(before[self.first[:-1][self.count > 0]], self.count[self.count > 0]) if len(before) else before


def _tokens(cut: Cut) -> tuple[np.ndarray, list[pa.Array]]:
    before = np.r_[0, cut.hi[:-1]] if len(cut.hi) else cut.lo
    before[cut.first[:-1][cut.count > 0]] = cut.offsets[:-1][cut.count > 0]
    return cut.count, [cut.strings(before, cut.hi), cut.strings(cut.lo, cut.hi), *(pa.array(x, pa.int32()) for x in (cut.start, cut.end, cut.segment()))]


def _segments(cut: Cut) -> tuple[np.ndarray, list[pa.Array]]:
    seg = cut.segment()
    begins = np.zeros(len(seg), bool)
    begins[1:] = seg[1:] != seg[:-1]
    begins[cut.first[:-1][cut.count > 0]] = True
    at = np.flatnonzero(begins)
    to = np.r_[at[1:], len(seg)] if len(at) else at
    sizes = np.diff(np.searchsorted(at, cut.first))
    text = np.repeat(cut.first[:-1], sizes)
    return sizes, [pa.array(x, pa.int32()) for x in (seg[at], at - text, to - text, cut.start[at])] + [cut.strings(cut.lo[at], cut.hi[to - 1])]


def _cuts(texts: pa.Array) -> Iterator[Cut]:
    """``texts``, which has no nulls, cut a block at a time."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, int(ends[begin]) + BLOCK, "right")) - 1)
        yield Cut(texts.slice(begin, end - begin))
        begin = end


def _blocks(texts: pa.Array, parts, struct: pa.StructType) -> pa.Array:
    texts = texts.cast(pa.string())
    null = texts.is_null()
    sizes, made = [], []
    for cut in _cuts(texts.fill_null("") if texts.null_count else texts):
        n, columns = parts(cut)
        sizes.append(n)
        made.append(pa.StructArray.from_arrays(columns, fields=list(struct)))
    values = pa.concat_arrays(made) if made else pa.array([], struct)
    offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes) if sizes else np.empty(0, np.int64))], pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=null) if texts.null_count else pa.ListArray.from_arrays(offsets, values)


def _udf(parts, **fields: str):
    kinds = {"string": pa.string(), "int": pa.int32()}
    struct = pa.struct([(k, kinds[v]) for k, v in fields.items()])

    def cut(texts: pa.Array) -> pa.Array:
        return _blocks(texts, parts, struct)

    cut.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(cut, "array<struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">>")


def tokens(text: Column) -> Column:
    """Array of (piece, tok, start, end, seg): a text's tokens in order; ``piece`` has the white space before it, places count code points."""
    return _udf(_tokens, piece="string", tok="string", start="int", end="int", seg="int")(text)


def segments(text: Column) -> Column:
    """Array of (seg, tok_lo, tok_hi, char_lo, text): a text's segments, each the exact substring."""
    return _udf(_segments, seg="int", tok_lo="int", tok_hi="int", char_lo="int", text="string")(text)


def segment_count(text: Column) -> Column:
    """How many `segments` a text has; none if null."""

    def count(texts: pa.Array) -> pa.Array:
        out = [np.empty(0, np.int64)]
        for cut in _cuts(texts.cast(pa.string()).fill_null("")):
            ends = np.r_[0, np.cumsum(cut.breaks())]
            out.append(ends[cut.first[1:]] - ends[cut.first[:-1]] + (cut.count > 0))
        return pa.array(np.concatenate(out), pa.int32())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(count, "int")(text)
