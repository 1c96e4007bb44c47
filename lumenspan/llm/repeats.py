"""Finding windows of a fixed length that occur again anywhere in a corpus.

Shared by the word-based and the byte-based substring operators.  A document is
a sequence of symbols (word hashes or bytes); a window is ``length`` of them.

1. Anchors.  Of every window the ``k``-gram with the smallest hash is selected,
   the last one of equals.  The choice depends on the window's content alone, so
   two equal windows select the same k-gram at the same place in both, and
   windows can only be equal if they hold an anchor with the same hash.  About
   two in (length - k + 2) places are anchors.
2. The context of an anchor is the stretch of the windows that select it.  Each
   window is in one context only.  Equal contexts are merged into classes with a
   count before anything else moves, so thousands of copies cost one row.
3. Anchors whose hash occurs once in the corpus are dropped: no window that
   selects them occurs again.  Where all contexts of a hash are one class, all
   of its windows recur.  The rest goes, as one text per class, to the
   operator's own matcher, in shards of bounded size.
4. The matcher's intervals go back to every occurrence of the class, and per
   document they are united.

No step holds a hot hash in one task: classes are counted with map-side
combining, occurrences are joined by (hash, class) under the skew join, and a
group with too many classes is dealt over several shards, which a merge step
compares (``split_groups``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, in_arrow, staged

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
#: Symbols that are worked on at once; places need 24 bits.
_CHUNK = 1 << 21
_MASK = (1 << 24) - 1
#: Classes of one anchor hash beyond which its group is dealt over several shards.
SPLIT_AT = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _B)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _B_INV)])
        return self.up, self.down


class Prefix:
    """Polynomial hashes of any stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.get(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """Of every stretch of ``length``, by its start."""
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by two running minima over blocks of ``w``."""
    n = len(a)
    padded = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def select_anchors(grams: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the k-grams that windows select, in order, with the first and last window that selects each.

    A window has ``w`` k-grams, and counts if its first place is ``valid``.
    """
    found = []
    for at in range(0, len(grams) - w + 1, _CHUNK):
        part = grams[at : at + _CHUNK + w - 1]
        keyed = (part & ~np.uint64(_MASK)) | (np.uint64(_MASK) - np.arange(len(part), dtype=np.uint64))
        least = sliding_min(keyed, w)
        window = np.flatnonzero(valid[at : at + len(least)])
        if len(window):
            place = at + (_MASK - (least[window] & np.uint64(_MASK)).astype(np.int64))
            new = np.flatnonzero(place[1:] != place[:-1])
            found.append((place[np.r_[0, new + 1]], at + window[np.r_[0, new + 1]], at + window[np.r_[new, len(window) - 1]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(place[1:] != place[:-1])  # a k-gram may be selected on both sides of a chunk's end
    return place[np.r_[0, new + 1]], first[np.r_[0, new + 1]], last[np.r_[new, len(place) - 1]]


@dataclass(frozen=True)
class Shape:
    """Windows of ``length`` symbols, anchored by ``k``-grams."""

    length: int
    k: int

    @property
    def reach(self) -> int:
        return self.length - self.k


def corpus_anchors(symbols: np.ndarray, sizes: np.ndarray, shape: Shape, powers: Powers) -> tuple[np.ndarray, ...]:
    """(document, hash, class hash, place, left, right) of the anchors of documents whose symbols stand one after the other."""
    n = len(symbols)
    if n < shape.length:
        return (np.zeros(0, np.int64),) * 6
    ends = np.cumsum(sizes)
    prefix = Prefix(symbols, powers)
    grams = prefix.windows(shape.k)
    valid = np.repeat(ends, sizes) - np.arange(n) >= shape.length
    at, first, last = select_anchors(grams, shape.reach + 1, valid)
    doc = np.searchsorted(ends, at, "right")
    left, right = at - first, last + shape.reach - at
    of = prefix.hash(first, last + shape.length) ^ _mix((left * (shape.length + 1) + right).astype(np.uint64))
    return doc, grams[at].view(np.int64), of.view(np.int64), at - (ends[doc] - sizes[doc]), left, right


Symbols = Callable[[], Callable[[bytes], np.ndarray]]


def stage_documents(df: DataFrame, id_col: str, text_col: str, shape: Shape, symbols: Symbols) -> Rows:
    """(uid, doc_id, z, hashes, classes, places): every row with a number of its own, its text compressed and its anchors, in the shared folder."""
    names = ["doc_id", "z", "hashes", "classes", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, of, powers = zstandard.ZstdCompressor(3), symbols(), Powers()

        def made(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            got = [of(t) for t in texts]
            sizes = np.array([len(g) for g in got], np.int64)
            doc, h, c, *where = corpus_anchors(np.concatenate(got), sizes, shape, powers)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            cols = [h, c, np.stack(where, axis=1).astype(np.int32)]
            blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(z.compress, texts), pa.binary()), *blobs], names)

        for b in batches:
            rows, size = ([], []), 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or b""
                for col, x in zip(rows, (i, t)):
                    col.append(x)
                size += len(t)
                if size >= _CHUNK:
                    yield made(*rows)
                    rows, size = ([], []), 0
            if rows[0]:
                yield made(*rows)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return Rows(rows.transform(in_arrow, run, "doc_id long, z binary, hashes binary, classes binary, places binary"), "uid", "documents")


def repeated_hashes(docs: DataFrame) -> DataFrame:
    """(hash): anchors that occur twice or more in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0)[i : i + 500].to_pylist()), np.int64))], ["hash"])

    return docs.select("hashes").transform(in_arrow, run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")


def occurrences_of(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(hash, class, uid, place, left, right) of every anchor whose hash is in ``repeated``; a hot hash is split by the skew join."""
    names = ["hash", "class", "uid", "place", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                h, c, at = (np.frombuffer(b"".join(part.column(k).to_pylist()), t) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32)))
                uid, at = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in part.column(1).to_pylist()]), at.reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (h, c, uid, at[:, 0].astype(np.int64), at[:, 1], at[:, 2])], names)

    rows = docs.select("uid", "hashes", "classes", "places").transform(in_arrow, run, "hash long, class long, uid long, place long, left int, right int")
    return rows.join(repeated, "hash", "left_semi")


def repeated_classes(occurrences: DataFrame) -> DataFrame:
    """(hash, class, n, uid, place, left, right, classes): the classes of anchors, with one occurrence each and the number of classes of the hash."""
    classes = staged(occurrences.groupBy("hash", "class").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place", "left", "right")).alias("one")), "classes")
    groups = staged(classes.groupBy("hash").agg(F.count("*").alias("classes")), "groups")  # written, so that the join can split a hot hash
    return classes.join(groups, "hash").select("hash", "class", "n", "one.*", "classes")


def class_texts(classes: DataFrame, docs: Rows, shape: Shape, cut: Callable) -> DataFrame:
    """``classes`` with the text of each one's context (``cut`` of a document's text), and a shard key."""
    wanted = docs.dealt(classes).groupBy(docs.bucket, "uid").agg(F.collect_list(F.struct("hash", "class", "n", "place", "left", "right", "classes")).alias("of"))
    k = shape.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, cutter = zstandard.ZstdDecompressor(), cut()
        for b in batches:
            rows = []
            for uid, t, of in zip(*(b.column(i).to_pylist() for i in range(3))):
                get = cutter(z.decompress(t))
                for x in of:
                    start = x["place"] - x["left"]
                    end = x["place"] + k + x["right"]
                    salt = x["class"] % -(-x["classes"] // SPLIT_AT) if x["classes"] > SPLIT_AT else -1
                    rows.append((x["hash"], salt, x["class"], x["n"], uid, start, get(start, end)))
                    if len(rows) >= 4000:
                        yield _class_rows(rows)
                        rows = []
            if rows:
                yield _class_rows(rows)

    joined = docs.join(wanted, "inner", "z").select("uid", "z", "of")
    return joined.transform(in_arrow, run, "hash long, salt long, class long, n long, uid long, start long, text binary")


def _class_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["hash", "salt", "class", "n", "uid", "start", "text"])


@dataclass
class Shard:
    """Whole groups of classes, or for a split group one part of it."""

    hash: np.ndarray
    salt: np.ndarray
    of: np.ndarray
    n: np.ndarray
    uid: np.ndarray
    start: np.ndarray
    texts: list[bytes]


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """Shards of about ``most`` bytes from rows sorted by (hash, salt)."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    texts: list[bytes] = []
    size, last = 0, None

    def made() -> Shard:
        return Shard(*(np.concatenate(c) for c in cols), texts)

    for b in batches:
        if not b.num_rows:
            continue
        arrays = [b.column(i).to_numpy() for i in range(6)]
        body = b.column(6).to_pylist()
        sizes = np.cumsum([len(x) for x in body])
        new = np.r_[last != (arrays[0][0], arrays[1][0]), (np.diff(arrays[0]) != 0) | (np.diff(arrays[1]) != 0)]
        last, at, done = (arrays[0][-1], arrays[1][-1]), 0, 0
        for i in np.flatnonzero(new).tolist():
            if size + (sizes[i - 1] if i else 0) - done >= most:
                for c, a in zip(cols, arrays):
                    c.append(a[at:i])
                texts += body[at:i]
                if texts:
                    yield made()
                cols, texts, size = [[] for _ in range(6)], [], 0
                at, done = i, sizes[i - 1] if i else 0
        for c, a in zip(cols, arrays):
            c.append(a[at:])
        texts += body[at:]
        size += int(sizes[-1] - done)
    if texts:
        yield made()


def repeated_starts(group: np.ndarray, place: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which windows occur again: ``group`` numbers equal windows, ``place`` tells apart where they start, ``many``: the class occurs twice or more."""
    if not len(group):
        return np.zeros(0, bool)
    _, p = np.unique(place, return_inverse=True)
    _, g = np.unique(group, return_inverse=True)
    pairs = np.unique(g.astype(np.int64) * (int(p.max()) + 1) + p)
    places = np.bincount(pairs // (int(p.max()) + 1), minlength=int(g.max()) + 1)
    return ((places > 1) | (np.bincount(g, many, int(g.max()) + 1) > 0))[g]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of [s, s + length) over sorted ``starts``."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cuts + 1]].tolist(), (starts[np.r_[cuts, len(starts) - 1]] + length).tolist()))


def split_groups(runs_of: DataFrame) -> DataFrame:
    """(hash, class, start, end) from windows of split groups that recur in another shard.

    ``runs_of`` has a row per shard and range of window hashes: (hash, range,
    keys, classes, starts, places, width), with keys sorted.  The runs that meet
    are merged, and each finds its own keys in the merged run by binary search.
    ``places`` tells apart where in the corpus windows start, since contexts of
    near anchors hold the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def merged() -> pa.RecordBatch:
            keys, places = (np.concatenate([x[i] for x in held]) for i in (0, 3))
            by = np.lexsort((places, keys))
            keys, places = keys[by], places[by]
            every = keys[np.r_[True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])]]
            out: list[list[np.ndarray]] = [[], [], []]
            for keys, of, starts, _, width in held:
                again = np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left") > 1
                for col, x in zip(out, (of[again], starts[again], starts[again] + width)):
                    col.append(x)
            cols = [np.concatenate(x) for x in out]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), key[0])), *map(pa.array, cols)], ["hash", "class", "start", "end"])

        for b in batches:
            for h, r, keys, of, starts, places, width in zip(*(b.column(i).to_pylist() for i in range(7))):
                if key is not None and (h, r) != key:
                    yield merged()
                    held = []
                key = (h, r)
                held.append((np.frombuffer(keys, np.uint64), np.frombuffer(of, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(places, np.int64), width))
        if held:
            yield merged()

    return runs_of.repartition("hash", "range").sortWithinPartitions("hash", "range").transform(in_arrow, run, "hash long, class long, start long, end long")


def sorted_runs(s: Shard, owner: np.ndarray, start: np.ndarray, key: np.ndarray, length: int) -> list[tuple]:
    """Rows for ``split_groups``: the windows of a shard's split groups, by hash and one of 64 ranges."""
    out = []
    mine = np.flatnonzero(s.salt[owner] >= 0)
    if not len(mine):
        return out
    mine = mine[np.lexsort((key[mine], s.hash[owner[mine]]))]
    h, of = s.hash[owner[mine]], key[mine] >> np.uint64(58)
    cuts = np.flatnonzero((np.diff(h) != 0) | (np.diff(of.astype(np.int64)) != 0)) + 1
    for part in np.split(mine, cuts):
        place = _mix(s.uid[owner[part]].astype(np.uint64)) ^ (s.start[owner[part]] + start[part]).astype(np.uint64)
        out.append((int(s.hash[owner[part[0]]]), int(key[part[0]] >> np.uint64(58)), key[part].tobytes(), s.of[owner[part]].tobytes(), start[part].tobytes(), place.tobytes(), length))
    return out


def repeated_intervals(docs: Rows, shape: Shape, cut: Callable, match: Callable[[Shard], tuple[list[tuple], list[tuple]]], shard_bytes: int) -> DataFrame:
    """(bucket, uid, spans): for each document with repeated windows, the stretches that they cover.

    ``match`` takes a shard and returns rows (index, start, end) of repeated
    stretches within its texts, and rows for ``split_groups``.
    """
    repeated = staged(repeated_hashes(docs.df), "repeated")
    occurrences = staged(occurrences_of(docs.df, repeated), "anchors")
    classes = repeated_classes(occurrences)
    alone = classes.where("classes = 1").select("hash", "class", F.lit(0).cast("long").alias("start"), (F.col("left") + shape.k + F.col("right")).cast("long").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary()] * 4 + [pa.int64()]
        names = ["hash", "class", "start", "end", "range", "keys", "classes", "starts", "places", "width"]
        for s in shards(batches, shard_bytes):
            found, more = match(s)
            rows = [(int(s.hash[i]), int(s.of[i]), a, b, None, None, None, None, None, None) for i, a, b in found]
            rows += [(h, None, None, None, *x) for h, *x in more]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 20_000]), kinds)], names)

    texts = class_texts(classes.where("classes > 1"), docs, shape, cut).repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    matched = staged(texts.transform(in_arrow, run, "hash long, class long, start long, end long, range long, keys binary, classes binary, starts binary, places binary, width long"), "matches")
    found = matched.where("range IS NULL").select("hash", "class", "start", "end")
    found = found.union(split_groups(matched.where("range IS NOT NULL").select("hash", "range", "keys", "classes", "starts", "places", "width")))
    found = found.union(alone)
    # written first, so that the join has a shuffle on each side and a hot class can be split
    per_class = staged(found.groupBy("hash", "class").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "stretches")
    at = occurrences.join(per_class, ["hash", "class"]).select("uid", (F.col("place") - F.col("left")).alias("at"), F.explode("spans").alias("s"))
    spans = F.struct((F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"))
    return docs.dealt(at.select("uid", spans.alias("s"))).groupBy(docs.bucket, "uid").agg(F.collect_list("s").alias("spans"))


def covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The union of ``spans``, in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def apply_spans(docs: Rows, spans: DataFrame, remove: Callable[[bytes, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """``remove(text, stretches)`` of every document, after its id."""
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
    kinds = [pa.int64(), *({"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = [(i, *remove(z.decompress(t), covered(s))) for i, t, s in zip(*(b.column(c).to_pylist() for c in range(3)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.join(spans, "left", "doc_id", "z").select("doc_id", "z", "spans").transform(in_arrow, run, f"doc_id long, {schema}")
