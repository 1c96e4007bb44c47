"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and their white space is made single
spaces.  An item of m bytes counts as leaked where a document holds it with at
most e = floor(m * ``error``) edits.  Then the two share at least
m - q + 1 - q * e q-grams whose diagonals (place in the document less place in
the item) lie within e of each other.  So

* each q-gram of a document that some item has is found through a table of
  hashes, and counted in the two bands of diagonals, 2(e + 1) wide and half
  overlapping, that its diagonal lies in;
* bands that reach the bound are kept: none with a leak is lost;
* each is verified by banded alignment over the region it spans.

Items come in blocks of bounded size, which are sent to every task; documents
are read as they are and nothing is shuffled.  Items shorter than a q-gram are
looked for as they are, between spaces.

Edge cases: a NULL or empty text holds nothing; NULL and empty items match
nothing; equal items are each reported; repeated rows are each reported; empty
tables give an empty result; other columns are ignored (or passed through by
``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

Q = 12
#: Bytes of benchmark items in a block, and of documents that are searched at once.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 18
_TABLE_BITS = 22


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def _grams(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for the ``q`` (8 to 16) bytes from each place on."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = np.ascontiguousarray(b)
    at = lambda i: np.ndarray((n,), "<u8", b, i, (1,))
    h = at(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += at(q - 8)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Items:
    """A block of items and the index of its q-grams."""

    ids: np.ndarray
    texts: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: list[int]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], error: float, q: int) -> Items:
        ids, texts = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
        size = np.array([len(t) for t in texts], np.int64)
        edits = np.minimum((size * error).astype(np.int64), np.maximum((size - q) // q, 0))  # the lemma's bound stays positive
        grams = [_grams(np.frombuffer(t, np.uint8), q) for t in texts]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        by = np.argsort(keys, kind="stable")
        return cls(ids, texts, edits, np.maximum(size - q + 1 - q * edits, 1), keys[by], item[by], place[by], [i for i, t in enumerate(texts) if 0 < len(t) < q])


def aligned(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole ``item`` within ``text`` on diagonals ``low`` to ``high``; edits beyond ``most`` are reported as more.

    Row i of the table has, for each diagonal d, the edits that turn the first i
    bytes of the item into a stretch of the text that ends before i + d.
    """
    p, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    d = np.arange(low, high + 1)
    far = 1 << 20
    now = np.where((d >= 0) & (d <= len(t)), 0, far)
    padded = np.full(len(p) + (high - low + 1) + 1, -1, np.int16)
    a, b = max(low, 0), min(len(t), low + len(padded))
    if a < b:
        padded[a - low : b - low] = t[a:b]
    steps = np.arange(len(d))
    for i in range(1, len(p) + 1):
        diagonal = now + (padded[i - 1 : i - 1 + len(d)] != p[i - 1])
        up = np.append(now[1:] + 1, far)
        best = np.minimum(diagonal, up)
        best = np.where((i + d >= 0) & (i + d <= len(t)), best, far)
        now = np.minimum.accumulate(best - steps) + steps
        if now.min() > most:
            return most + 1, 0
    k = int(now.argmin())
    return int(now[k]), len(p) + int(d[k])


def find(texts: list[bytes], items: Items, table: np.ndarray, q: int) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, end) of the best occurrence of each item in each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    joined = b"".join(texts)
    grams = _grams(np.frombuffer(joined, np.uint8), q)
    at = np.flatnonzero(table[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    left = np.searchsorted(items.keys, grams[at], "left")
    n = np.searchsorted(items.keys, grams[at], "right") - left
    at, left, n = at[n > 0], left[n > 0], n[n > 0]
    hit = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = np.repeat(at, n)
    doc = np.searchsorted(ends, place, "right")
    inside = place + q <= ends[doc]
    hit, place, doc = hit[inside], place[inside], doc[inside]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if len(hit):
        item = items.item[hit]
        diagonal = place - (ends[doc] - sizes[doc]) - items.place[hit] + (1 << 20)  # an item is shorter than that
        half = items.edits[item] + 1
        first = diagonal // half
        doc, item, band = np.r_[doc, doc], np.r_[item, item], np.r_[first, first - 1]
        by = np.lexsort((band, item, doc))
        doc, item, band = doc[by], item[by], band[by]
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        count = np.diff(np.r_[cuts, len(doc)])
        for c in cuts[count >= items.least[item[cuts]]].tolist():
            d, i, e = int(doc[c]), int(item[c]), int(items.edits[item[c]])
            if best.get((d, i), (1, 0))[0] == 0:
                continue
            low = int(band[c]) * (e + 1) - (1 << 20)
            high, text, body = low + 2 * (e + 1) - 1, texts[d], items.texts[i]
            exact = text.find(body, max(low - e, 0), high + e + len(body))
            edits, end = (0, exact + len(body)) if exact >= 0 else aligned(body, text, low - e, high + e, e)
            if edits <= e and (edits, end) < best.get((d, i), (e + 1, 0)):
                best[d, i] = edits, end
    for i in items.short:
        for d, t in enumerate(texts):
            k = (b" " + t + b" ").find(b" " + items.texts[i] + b" ")
            if k >= 0:
                best[d, i] = 0, k + len(items.texts[i])
    return [(d, i, *x) for (d, i), x in best.items()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        body = normal(r[1])
        if body:
            rows.append((r[0], body))
            size += len(body)
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: float = 0.05, q: int = Q) -> DataFrame:
    """(doc_id, item_id, edits, end_byte): each benchmark item that a document holds, its best occurrence; ``end_byte`` in the normal text."""
    names = ["doc_id", "item_id", "edits", "end_byte"]
    schema = ", ".join(f"{c} long" for c in names)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            items = Items.of(block, error, q)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(items.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            for b in batches:
                ids, at = b.column(0).to_pylist(), 0
                while at < len(ids):
                    texts, size, first = [], 0, at
                    while at < len(ids) and size < SLICE_BYTES:
                        texts.append(normal(b.column(1)[at].as_py()))
                        size += len(texts[-1])
                        at += 1
                    got = [(ids[first + d], int(items.ids[i]), e, end) for d, i, e, end in find(texts, items, table, q)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names)

        found = rows.transform(in_arrow, run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else rows.where("false").selectExpr(*(f"CAST(NULL AS LONG) AS {c}" for c in names))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error: float = 0.05, q: int = Q) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns as they are."""
    at, schema, kept = docs.columns.index(text_col), docs.schema, docs
    for block in _blocks(benchmark, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            items = Items.of(block, error, q)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(items.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            for b in batches:
                clean, i = np.ones(b.num_rows, bool), 0
                while i < b.num_rows:
                    texts, size, first = [], 0, i
                    while i < b.num_rows and size < SLICE_BYTES:
                        texts.append(normal(b.column(at)[i].as_py()))
                        size += len(texts[-1])
                        i += 1
                    clean[[first + x[0] for x in find(texts, items, table, q)]] = False
                if clean.all():
                    yield b
                elif clean.any():
                    yield b.filter(pa.array(clean))

        kept = kept.transform(in_arrow, run, schema)
    return kept
