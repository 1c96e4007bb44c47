"""Exact substring deduplication by suffix arrays.

Windows of ``length`` bytes that occur again are found as ``repeats`` tells; the
matcher is a suffix array per shard:

* Larsson-Sadakane refinement in numpy: suffixes sorted by their first eight
  bytes, then doubled (h = 8, 16, ...) by the rank of the suffix h further on,
  where only groups that are not yet sorted are touched, until none is left;
* Kasai's common prefixes, all texts of the shard in step, cut at ``length``;
* suffixes whose common prefix reaches ``length`` are one group of equal windows;
* groups that had to be split over shards are merged by binary search over
  sorted runs of window hashes.

Edge cases: NULL and empty texts have nothing to remove; a repeated row or an
exact copy of ``length`` bytes or more loses all its bytes, in every copy; texts
shorter than ``length`` stay whole; matches do not cross documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Powers, Prefix, Shape, Shard, apply_spans, repeated_intervals, repeated_starts, runs, sorted_runs, stage_documents

#: Bytes of text of one suffix array.
SHARD_BYTES = 1 << 20


def eight(text: np.ndarray) -> np.ndarray:
    """The next eight bytes at each place as a big-endian number."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order."""
    n = len(text)
    key = eight(text)
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def number(places: np.ndarray, new: np.ndarray) -> None:
        """Each suffix's rank is the place in ``order`` of its group's first."""
        rank[order[places]] = np.maximum.accumulate(np.where(new, places, 0))

    number(np.arange(n), np.r_[True, key[order[1:]] != key[order[:-1]]] if n else np.zeros(0, bool))
    same = rank[order[1:]] == rank[order[:-1]]
    open_ = np.flatnonzero(np.r_[same, False] | np.r_[False, same]) if n else np.zeros(0, np.int64)  # places of groups that are not sorted
    h = 8
    while len(open_):
        suffix = order[open_]
        both = rank[suffix] * (n + 1) + rank[np.minimum(suffix + h, n)] + 1
        by = np.argsort(both)
        order[open_], both = suffix[by], both[by]
        same = both[1:] == both[:-1]
        number(open_, np.r_[True, ~same])
        open_ = open_[np.r_[same, False] | np.r_[False, same]]
        h *= 2
    return order


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of 64-bit numbers are zero, for x > 0."""
    return (64 - np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1]) // 8


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """By place in ``order``: the bytes, ``depth`` at most, that a suffix shares with the one before it.

    ``order`` holds the first ``counts`` suffixes of each of the texts that begin
    at ``starts``.  Kasai's bound, that the next suffix of a text shares at most
    one byte less, is carried along all texts in step; it does not hold where the
    suffix before is the last of its text that ``order`` holds.
    """
    n = len(text)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    held = np.zeros(n + 1, bool)
    held[order] = True
    key = np.concatenate([eight(text), np.zeros(1, np.uint64)])
    shared, h = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    lanes = np.argsort(-counts, kind="stable")
    many = np.searchsorted(-counts[lanes], -np.arange(int(counts.max(initial=0))), "left").tolist()
    for step, alive in enumerate(many):
        of = lanes[:alive]
        i = starts[of] + step
        j = before[i]
        now = h[of]
        now[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (now < depth))
        while len(go):
            a, b = i[go] + now[go], j[go] + now[go]
            x = key[np.minimum(a, n)] ^ key[np.minimum(b, n)]
            equal = np.where(x == 0, 8, _equal_bytes(x))
            now[go] += np.minimum(equal, n - np.maximum(a, b))
            go = go[(equal == 8) & (np.maximum(a, b) + 8 < n)]
            go = go[now[go] < depth]
        shared[i] = now = np.minimum(now, depth)
        h[of] = np.where((j >= 0) & held[j + 1], np.maximum(now - 1, 0), 0)
    return shared[order]


def _windows(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in it) of every window."""
    n = np.maximum(sizes - length + 1, 0)
    return np.repeat(np.arange(len(sizes)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def matcher(length: int) -> Callable[[Shard], tuple[list[tuple], list[tuple]]]:
    powers = Powers()

    def match(s: Shard) -> tuple[list[tuple], list[tuple]]:
        sizes = np.array([len(t) for t in s.texts], np.int64)
        text = np.frombuffer(b"".join(s.texts), np.uint8)
        starts = np.cumsum(sizes) - sizes
        _, row = np.unique(s.uid, return_inverse=True)
        width = int(s.start.max(initial=0)) + int(sizes.max(initial=0)) + 1
        owner, within = _windows(sizes, length)
        place = row[owner] * width + s.start[owner] + within
        # a window whose hash is alone cannot recur: the array is built over the stretches of the others
        key = Prefix(_SYMBOLS[text], powers).windows(length)[starts[owner] + within] if len(owner) else np.zeros(0, np.uint64)
        more = sorted_runs(s, owner, within, key, length) if (s.salt >= 0).any() else []
        likely = np.flatnonzero(repeated_starts(key, place, s.n[owner] > 1))
        if not len(likely):
            return [], more
        of, at = np.unique(owner[likely], return_index=True)
        low, high = within[likely[at]], within[likely[np.r_[at[1:], len(likely)] - 1]]
        sizes = high - low + length
        text = np.concatenate([text[a : a + n] for a, n in zip((starts[of] + low).tolist(), sizes.tolist())])
        starts = np.cumsum(sizes) - sizes
        owner, within = _windows(sizes, length)
        at = starts[owner] + within
        order = suffix_array(text)
        kept = np.zeros(len(text), bool)
        kept[at] = True
        order = order[kept[order]]
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(common_prefixes(text, order, starts, sizes - length + 1, length) < length)
        within += low[owner]
        again = repeated_starts(group[at], row[of[owner]] * width + s.start[of[owner]] + within, s.n[of[owner]] > 1)
        cuts, found = np.searchsorted(owner, np.arange(len(of) + 1)), []
        for i in np.unique(owner[again]).tolist():
            mine = slice(cuts[i], cuts[i + 1])
            found += [(int(of[i]), a, b) for a, b in runs(within[mine][again[mine]], length)]
        return found, more

    return match


#: A random 64-bit number for each byte.
_SYMBOLS = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _symbols() -> Callable[[bytes], np.ndarray]:
    return lambda text: _SYMBOLS[np.frombuffer(text, np.uint8)]


def _cut() -> Callable:
    return lambda text: lambda start, end: text[start:end]


def removed_bytes(text: bytes, stretches: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in stretches:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, texts: bool = False) -> DataFrame:
    """A row per document: n_bytes, n_removed, n_spans, kept_sha256 (or, with ``texts``, the bytes that stay)."""
    shape = Shape(length, max(1, length * 8 // 25))
    docs = stage_documents(df, id_col, text_col, shape, _symbols)
    spans = repeated_intervals(docs, shape, _cut, matcher(length), SHARD_BYTES)

    def remove(text: bytes, stretches: list[tuple[int, int]]) -> tuple:
        kept = removed_bytes(text, stretches)
        return len(text), len(text) - len(kept), len(stretches), kept if texts else hashlib.sha256(kept).hexdigest()

    last = "kept binary" if texts else "kept_sha256 string"
    return apply_spans(docs, spans, remove, f"n_bytes long, n_removed long, n_spans long, {last}")
