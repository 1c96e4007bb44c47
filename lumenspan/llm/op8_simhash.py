"""SimHash near-duplicates found by the generalised pigeonhole principle.

1. A 64-bit fingerprint per document: bit i is set if it is set in over half
   of the XXH64 values of the word shingles.  Equal fingerprints are merged
   first, so that thousands of copies cost one row from then on.
2. The plan: bits whose values go together (co-occurrence counted over all
   fingerprints) are put into one partition, and thresholds t_1..t_m with
   sum(t) = tau - m + 1 (-1 skips a partition) are chosen by dynamic
   programming on estimated candidate counts.  Two fingerprints within tau bits
   differ by at most t_i in some partition i.
3. Each fingerprint is dealt to every value within t_i of its own in
   partition i.  Fingerprints that meet are verified by counting bits, and each
   bucket returns a spanning forest: never all pairs.  Buckets are counted
   first, and one beyond ``BLOCK`` members is dealt in pairs of blocks to as
   many tasks, which loses no link.
4. Components of the forest edges.

Edge cases: NULL and empty texts have fingerprint zero, linked like any other;
a text shorter than a shingle is one shingle; repeated rows share their
component; a NULL id takes part in no minimum but is returned; an empty table
gives an empty result; other columns are not read.

``similar_groups`` serves text similarity instead of a number of bits.  The same
steps 1 to 4, over fingerprints of sets of shingles, link texts loosely.  They
alone would miss pairs: at Jaccard similarity 0.8 a pair differs in 29 of 192
bits on average, and no plan that covers the deviations too is affordable.  So
texts that they leave apart meet in a second way: two sets of n and more
shingles with similarity J share at least Jn of them, so by the pigeonhole
principle the least n - Jn + 1 of each have one in common, whatever order is
used.  Those are linked loosely if their wide fingerprints are within
``WIDE_MOST`` bits.  Within each loose group a search by the exact similarity
tests every pair that is not yet connected.  Shingles common in a sample come
last in the order, so that passages many texts share make no large buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, in_arrow, staged
from .components import connected_components
from .repeats import Powers, Prefix, _mix

BITS = 64
#: Members of a bucket that are compared as one block.
BLOCK = 8192
#: What the comparison of a pair costs against a row that is dealt to a bucket.
PAIR_COST = 0.005


_LANES = np.uint64(0x0101010101010101)


def majorities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` values of ``h`` the bits that are set in over half of them; 0 for an empty run.

    A bit of each byte is added up at a time, in byte lanes that 255 values cannot overflow.
    """
    out, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    n = counts[full]
    pieces = -(-n // 255)
    firsts = np.cumsum(pieces) - pieces
    cuts = np.repeat(np.cumsum(n) - n - 255 * firsts, pieces) + 255 * np.arange(int(pieces.sum()))
    for k in range(8) if len(full) else ():
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of every word shingle, ASCII letters lower-cased."""
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    lasts = ends[min(shingle, len(words)) - 1 :].tolist()
    firsts = (ends - size)[: len(lasts)].tolist()
    h64 = xxhash.xxh64_intdigest
    return [h64(joined[a:b], 42) for a, b in zip(firsts, lasts)]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of one text, UTF-8."""
    h = shingle_hashes(text or b"", shingle)
    return int(majorities(np.array(h, np.uint64), np.array([len(h)]))[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): a fingerprint per row, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _text_slices(b, 1):
                h = [np.array(shingle_hashes(t, shingle), np.uint64) for t in texts]
                fp = majorities(np.concatenate(h), np.array([len(x) for x in h]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).transform(in_arrow, run, "doc_id long, fp long")


def bit_counts(fps: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many set both."""
    bits_of = BITS * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits_of, bits_of)), 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = np.stack([b.column(i).slice(at, 4096).to_numpy() for i in range(len(columns))], axis=1).view(np.uint64)
                bits = ((fp[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32).reshape(len(fp), -1)
                total += bits.T @ bits
                n += len(fp)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n, *total.astype(np.int64).ravel().tolist()]), pa.array(range(bits_of**2 + 1), pa.int32())], ["c", "i"])

    got = fps.select(*columns).transform(in_arrow, run, "c long, i int").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(bits_of**2 + 1)
    counts[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return int(counts[0]), counts[1:].reshape(bits_of, bits_of)


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of nearly equal size, the most correlated together."""
    bits_of = len(both)
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, groups = set(range(bits_of)), []
    for g in range(m):
        size = len(left) // (m - g)
        free = sorted(left)
        seed = free[int(corr[np.ix_(free, free)].sum(axis=1).argmax())]
        group = [seed]
        left.remove(seed)
        near = corr[seed].copy()
        while len(group) < size:
            free = sorted(left)
            best = free[int(near[free].argmax())]
            group.append(best)
            left.remove(best)
            near += corr[best]
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Thresholds by dynamic programming, and the rows and candidates they are estimated to cost.

    A pair agrees in bit j with chance p^2 + (1-p)^2; the chance that it differs
    in at most t bits of a group is a sum of elementary symmetric polynomials.
    """
    p = np.diag(both) / max(n, 1)
    cost = []
    for g in groups:
        agree = p[g] ** 2 + (1 - p[g]) ** 2
        poly = np.array([1.0])
        for a in agree:
            poly = np.convolve(poly, [a, 1 - a])
        row = {-1: 0.0}
        for t in range(0, min(tau, 3) + 1):
            probes = sum(math.comb(len(g), k) for k in range(t + 1))
            row[t] = n * (probes + (probes > 1)) + PAIR_COST * n * n * float(poly[: t + 1].sum()) * probes
        cost.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by sum of (t + 1)
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, x in row.items():
                if used + t + 1 <= tau + 1 and (used + t + 1 not in step or c + x < step[used + t + 1][0]):
                    step[used + t + 1] = (c + x, [*ts, t])
        best = step
    return best.get(tau + 1, (math.inf, []))


def plan(fps: DataFrame, tau: int, columns: list[str]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    n, both = bit_counts(fps, columns)
    options = []
    for m in range(2, min(tau + 1, 24) + 1):
        groups = partition_bits(n, both, m)
        cost, ts = allocate(n, both, groups, tau)
        options.append((cost, m, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2] if options else [(list(range(len(both))), tau)]


def _keys(fp: np.ndarray, parts: list[tuple[list[int], int]]) -> np.ndarray:
    """Signed keys, a row for each fingerprint (a row of 64-bit words): the values that it is dealt to."""
    out = []
    for i, (bits, t) in enumerate(parts):
        value = np.zeros(len(fp), np.uint64)
        for k, b in enumerate(bits):
            value |= ((fp[:, b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)) << np.uint64(k)
        salt = np.uint64(i) << np.uint64(56) if len(bits) <= 56 else np.uint64(0)
        for r in range(t + 1):
            for flips in combinations(range(len(bits)), r):
                out.append((value ^ np.uint64(sum(1 << f for f in flips))) | salt)
    return np.stack(out, axis=1).view(np.int64)


def forest(members: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that links members within ``tau`` bits.

    A search from each member in turn; what it has reached is never looked at
    again, so that dense groups cost little more than their size.
    """
    left, a, b = members, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= tau
            if near.any():
                found = left[near]
                left = left[~near]
                a += [int(x)] * len(found)
                b += found.tolist()
                front += found.tolist()
                front = [np.uint64(y) for y in front]
    return a, b


def in_blocks(rows: DataFrame, key: str, node: str, sizes: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``key`` split where its ``size`` (of ``sizes``: key, size) is beyond ``most``.

    The rows of such a key go to blocks by a hash of ``node``, and every pair of
    blocks becomes a key of its own: all rows of the key still meet each other.
    """
    large = staged(sizes.where(F.col("size") > most).select(key, F.ceil(F.col("size") / most).alias("blocks")), "large")
    own, blocks = F.pmod(F.xxhash64(node), F.col("blocks")), F.col("blocks")
    others = F.when(blocks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: i != own))
    pair = F.xxhash64(key, F.least(own, "other"), F.greatest(own, "other"))
    dealt = rows.join(large, key, "left").withColumn("other", F.explode(others))
    return dealt.select(F.when(blocks.isNull(), F.col(key)).otherwise(pair).alias(key), *[c for c in rows.columns if c != key])


def links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect all that are linked by steps of ``tau`` bits or fewer.

    ``fps`` has one row for each distinct fingerprint.
    """
    parts = plan(fps, tau, ["fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                keys = _keys(fp[:, None], parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], ["k", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def edges(fp: np.ndarray) -> pa.RecordBatch:
            a, b = forest(fp, tau)
            return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

        def pairs(fp: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
            x, y = fp[firsts], fp[firsts + 1]
            near = np.bitwise_count(x ^ y) <= tau
            return pa.RecordBatch.from_arrays([pa.array(x[near].view(np.int64)), pa.array(y[near].view(np.int64))], ["a", "b"])

        for batch in batches:
            k, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            cuts = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
            if key is not None and k[0] == key:
                held.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
                if not len(starts):
                    continue
            if sum(map(len, held)) > 1:
                yield edges(np.concatenate(held))
            held, key = [fp[starts[-1] : ends[-1]].copy()], k[-1]
            size = (ends - starts)[:-1]
            if (size == 2).any():
                yield pairs(fp, starts[:-1][size == 2])
            for s, e in zip(starts[:-1][size > 2], ends[:-1][size > 2]):
                yield edges(fp[s:e])
        if sum(map(len, held)) > 1:
            yield edges(np.concatenate(held))

    dealt = fps.select("fp").transform(in_arrow, deal, "k long, fp long")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_blocks(dealt, "k", "fp", dealt.groupBy("k").agg(F.count("*").alias("size")), BLOCK)
    return dealt.repartition(n, "k").sortWithinPartitions("k", "fp").transform(in_arrow, meet, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): for each row its fingerprint and the smallest id it is linked to."""
    return linked(staged(fingerprints(df, id_col, text_col, shingle), "fingerprints"), tau)


def linked(docs: DataFrame, tau: int) -> DataFrame:
    """(doc_id, fp, component_id): rows (doc_id, fp) with the smallest id that each is linked to by steps of ``tau`` bits or fewer."""
    least = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(least, tau))
    joined = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(smallest, "root").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", "fp", "component_id")


#: 64-bit words of a wide fingerprint, and the bits by which members of a loose group may differ by steps.  A pair at
#: Jaccard similarity 0.8 differs in 29 on average with deviation 5, so seven deviations are allowed; strangers differ in 96.
WIDE, WIDE_MOST = 3, 64
#: About as many texts are sampled for common shingles; a shingle in ``COMMON`` of them or more is common.
SAMPLE, COMMON = 10_000, 5
#: Shingles of a loose group that are searched as one block; a larger group is dealt in pairs of blocks, which loses no pair.
SHINGLES = 1 << 20

_BYTES = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_keys(texts: list[bytes], powers: Powers) -> list[np.ndarray]:
    """For each text the hashes of its words, without regard to ASCII case."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    text = raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    last = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    keys = Prefix(_BYTES[text], powers).hash(first, last)
    return np.split(keys, np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])[:-1]))


def _shingles(keys: np.ndarray, k: int) -> np.ndarray:
    """A hash for every ``k`` words in a row; for fewer words one of them all."""
    k = min(k, len(keys))
    out = np.zeros(max(len(keys) - k + 1, 0) if k else 0, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[i : len(keys) - k + 1 + i])
    return out


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``WIDE`` words for each set of shingles: its SimHash."""
    h, counts = np.concatenate(sets), np.array([len(x) for x in sets])
    salted = (_mix(h + np.uint64((w + 1) * 0xD1342543DE82EF95 % (1 << 64))) for w in range(WIDE))
    return np.stack([majorities(x, counts) for x in salted], axis=1)


def prefix_of(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The least shingles of a sorted set, one of which any set as similar has among its own; ``common`` (sorted) ones come last."""
    take = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1 if len(shingles) else 0
    if not len(common) or not take:
        return shingles[:take]
    last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    return np.concatenate([shingles[~last], shingles[last]])[:take]


def whole_hash(keys: np.ndarray) -> int:
    """A hash of a sequence of words."""
    at = np.arange(1, len(keys) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(_mix(_mix(keys + at).sum(keepdims=True, dtype=np.uint64))[0])


def _text_slices(b: pa.RecordBatch, column: int, most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < b.num_rows:
        texts, size, start = [], 0, at
        while at < b.num_rows and size < most:
            texts.append(b.column(column)[at].as_py() or b"")
            size += len(texts[-1])
            at += 1
        yield start, texts


def wide_forest(fp: np.ndarray, size: np.ndarray, most: int, similarity: float) -> tuple[list[int], list[int]]:
    """As ``forest``, for fingerprints of ``WIDE`` words of sets of ``size`` shingles; the edges are places in ``fp``."""
    left, rest, sizes, a, b = np.arange(len(fp)), fp, size, [], []
    while len(left) > 1:
        front, left, rest, sizes = [int(left[0])], left[1:], rest[1:], sizes[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(rest ^ fp[x]).sum(axis=1) <= most
            near &= np.minimum(sizes, size[x]) >= similarity * np.maximum(sizes, size[x])
            if near.any():
                found = left[near].tolist()
                left, rest, sizes = left[~near], rest[~near], sizes[~near]
                a += [x] * len(found)
                b += found
                front += found
    return a, b


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that links ``sets`` of Jaccard similarity ``similarity`` or more.

    The same search; the sets that a set shares elements with are read from an
    inverted index, which is made again when half of it has been reached.
    """
    size, a, b = np.fromiter(map(len, sets), np.int64, len(sets)), [], []
    left, front = np.arange(len(sets)), []
    while len(left):
        every = np.concatenate([sets[i] for i in left])
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(left)), size[left])[order]
        values, starts = np.unique(every[order], return_index=True)
        counts = np.diff(np.r_[starts, len(every)])
        alive, n, at = np.ones(len(left), bool), len(left), 0
        while n and 2 * n >= len(left):
            if not front:
                at += int(alive[at:].argmax())
                alive[at] = False
                n -= 1
                front.append(int(left[at]))
            x = front.pop()
            if not len(values):
                continue
            run = np.minimum(np.searchsorted(values, sets[x]), len(values) - 1)
            run = run[values[run] == sets[x]]
            c = counts[run]
            met = owner[np.repeat(starts[run] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))]
            if 8 * len(met) > len(left):
                both = np.bincount(met, minlength=len(left))
                who = np.flatnonzero(both)
                both = both[who]
            else:
                who, both = np.unique(met, return_counts=True)
            found = who[alive[who] & (both >= similarity * (size[x] + size[left[who]] - both))]
            alive[found] = False
            n -= len(found)
            a += [x] * len(found)
            b += left[found].tolist()
            front += left[found].tolist()
        left = left[alive]
    return a, b


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its rows (as a matrix of the other columns), from batches of longs sorted by their first column."""
    key, held = None, []
    for batch in batches:
        k = batch.column(0).to_numpy()
        if not len(k):
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
        cuts = np.flatnonzero(np.diff(k)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
            if key is not None and k[at] != key:
                yield key, held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            key = int(k[at])
            held.append(rows[at:end].copy() if end == len(k) else rows[at:end])
    if held:
        yield key, held[0] if len(held) == 1 else np.concatenate(held)


def common_shingles(texts: DataFrame, n: int, shingle: int) -> np.ndarray:
    """Sorted: the shingles in ``COMMON`` or more of a sample of the ``n`` ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for _, said in _text_slices(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(_shingles(k, shingle)) for k in _word_keys(said, powers)]).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(n // SAMPLE, 1))) == 0).select("text").distinct() if n > SAMPLE else texts.select("text").distinct()
    got = some.transform(in_arrow, run, "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(1_000_000).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().view(np.uint64))


def loose_pairs(texts: DataFrame, nodes: DataFrame, common: np.ndarray, similarity: float, shingle: int) -> DataFrame:
    """(a, b): edges that connect all nodes that share a shingle of their prefixes and are linked by steps of ``WIDE_MOST`` bits.

    ``texts`` has (whole, text), ``nodes`` a row for each distinct ``whole``.
    Nodes of one ``component`` are connected already: edges between these may be left out.
    """
    columns = [f"f{w}" for w in range(WIDE)]
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, order, seen = Powers(), sent.value, set()
        for b in batches:
            for start, said in _text_slices(b, 0):
                keys = _word_keys(said, powers)
                whole = [whole_hash(k) for k in keys]
                if len(seen) > 100_000:
                    seen.clear()
                h = []
                for w, k in zip(whole, keys):
                    h.append(np.zeros(0, np.uint64) if w in seen else prefix_of(np.unique(_shingles(k, shingle)), similarity, order))
                    seen.add(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.repeat(np.array(whole, np.uint64).view(np.int64), [len(x) for x in h]))], ["h", "whole"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each bucket, numbered by what they are: many shingles have the same."""
        seen, out, n = set(), [], 0
        for _, rows in runs_of(batches):
            if len(rows) == 1:
                continue
            whole = np.unique(rows[:, 0])
            if len(whole) == 1:
                continue
            bucket = int(_mix(_mix(whole.view(np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])
            if bucket in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(bucket)
            out.append((bucket, whole))
            n += len(whole)
            if n > 50_000:
                yield said(out)
                out, n = [], 0
        if out:
            yield said(out)

    def said(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in out], [len(w) for _, w in out])), pa.array(np.concatenate([w for _, w in out]))], ["bucket", "whole"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[int], list[int]] = ([], [])
        for _, rows in runs_of(batches):
            if (rows[:, 1] == rows[0, 1]).all():
                continue
            a, b = wide_forest(np.ascontiguousarray(rows[:, 3:]).view(np.uint64), rows[:, 2], WIDE_MOST, similarity)
            out[0].extend(rows[a, 0].tolist())
            out[1].extend(rows[b, 0].tolist())
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
                out = ([], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("text").transform(in_arrow, prefixes, "h long, whole long")
    met = dealt.repartition(parts, "h").sortWithinPartitions("h").transform(in_arrow, meet, "bucket long, whole long").distinct()
    met = staged(met, "buckets")
    members = met.join(nodes, "whole").select("bucket", "node", "component", "n", *columns)
    members = in_blocks(members, "bucket", "node", met.groupBy("bucket").agg(F.count("*").alias("size")), BLOCK)
    return members.repartition(parts, "bucket").sortWithinPartitions("bucket", "node").transform(in_arrow, link, "a long, b long").distinct()


def similar_groups(of_rows: Rows, text_col: str = "text", similarity: float = 0.8, shingle: int = 5, tau: int = 4) -> DataFrame:
    """(key, group): rows whose sets of word shingles are alike, directly or by steps; ``group`` is the smallest key reached.

    Equal word sequences are one node.  Nodes whose fingerprints are linked by
    steps of ``tau`` bits are candidates, and those that meet by their prefixes;
    the exact similarity decides on both.  Texts are read where they lie: once for
    their fingerprints and prefixes, once for the sets of those in loose groups.
    """
    columns = [f"f{w}" for w in range(WIDE)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for start, texts in _text_slices(b, 1):
                keys = _word_keys(texts, powers)
                whole = np.array([whole_hash(k) for k in keys], np.uint64)
                sets = [np.unique(_shingles(k, shingle)) for k in keys]
                fps = wide_fingerprints(sets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(whole.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(WIDE)]], ["key", "whole", "n", *columns])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for start, texts in _text_slices(b, 1):
                sets = [np.unique(_shingles(k, shingle)) for k in _word_keys(texts, powers)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(map(len, sets), pa.int32()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["node", "n", "said"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, said = None, [], []

        def found() -> pa.RecordBatch:
            a, b = jaccard_forest(said, similarity)
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            for k, i, s in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2)):
                if k != key and node:
                    yield found()
                    node, said = [], []
                key = k
                node.append(i)
                said.append(np.frombuffer(s.as_py(), "<u8"))
        if node:
            yield found()

    rows = of_rows.df.select(F.col(of_rows.key).alias("key"), F.col(text_col).cast("binary").alias("text"))
    docs = staged(rows.transform(in_arrow, read, "key long, whole long, n long, " + ", ".join(f"{c} long" for c in columns)), "wide-fingerprints")
    nodes = staged(docs.groupBy("whole").agg(F.min("key").alias("node"), *[F.min(c).alias(c) for c in ("n", *columns)]), "distinct-texts")
    near = staged(linked(nodes.select(F.col("node").alias("doc_id"), F.col("f0").alias("fp")), tau).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")), "linked")
    common = common_shingles(rows, nodes.count(), shingle)
    met = loose_pairs(rows, nodes.join(near, "node"), common, similarity, shingle)
    loose = staged(connected_components(met.union(near.select("component", "node").where("component <> node"))), "loose-groups")
    said = of_rows.join(loose.select(F.col("node").alias(of_rows.key)), "left_semi", text_col).select(F.col(of_rows.key), F.col(text_col).cast("binary"))
    sets = staged(said.transform(in_arrow, shingled, "node long, n int, said binary").join(loose, "node"), "shingles")
    sizes = sets.groupBy("root").agg(F.sum("n").alias("size"))
    dealt = in_blocks(sets.select("root", "node", "said"), "root", "node", sizes, SHINGLES)
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = dealt.repartition(parts, "root").sortWithinPartitions("root", "node").transform(in_arrow, alike, "a long, b long")
    roots = connected_components(edges)
    of = nodes.join(roots, "node", "left").select("whole", F.coalesce("root", "node").alias("group"))
    return docs.select("key", "whole").join(of, "whole").select("key", "group")
