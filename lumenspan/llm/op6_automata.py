"""Repeated passages located by Aho-Corasick automata.

Windows of ``length`` words that occur again are found as ``repeats`` tells; the
matcher of a shard

* confirms: windows that occur in two places, or in a class with two or more
  occurrences, are joined into recurring passages;
* compiles the passages, with a space around each word, into a pyahocorasick
  automaton of bounded size;
* streams the texts of all documents' classes through it, and every occurrence
  it reports is a stretch to remove.

Groups that had to be split over shards are merged by binary search over sorted
runs of window hashes.

Edge cases: NULL and empty texts have no words; a text with fewer than
``length`` words stays whole; a repeated row or a copy loses all its words, in
every copy; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Powers, Prefix, Shape, Shard, apply_spans, repeated_intervals, repeated_starts, runs, sorted_runs, stage_documents

#: Bytes of text of one shard, and so of its automaton.
SHARD_BYTES = 1 << 20
REMEMBERED = 300_000


class WordHashes(dict):
    def __init__(self) -> None:
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = self.hash(word, 6) | 1
        return h


def _symbols() -> Callable[[bytes], np.ndarray]:
    known = WordHashes()

    def of(text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return of


def _cut() -> Callable:
    def cutter(text: bytes) -> Callable[[int, int], bytes]:
        words = text.split()
        return lambda start, end: b" ".join(words[start:end])

    return cutter


def locate(passages: list[bytes], texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, first word, last word + 1) of the stretches that occurrences of passages cover in each text; both are words joined by one space."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in passages:
        said = f" {p.decode('latin-1')} "
        automaton.add_word(said, len(said))
    automaton.make_automaton()
    out = []
    for i, t in enumerate(texts):
        said = f" {t.decode('latin-1')} "
        found = [(end - size + 1, end) for end, size in automaton.iter(said)]
        if found:
            spaces = np.flatnonzero(np.frombuffer(said.encode("latin-1"), np.uint8) == 32)
            first, last = (np.searchsorted(spaces, x) for x in np.array(found).T)
            by = np.argsort(first, kind="stable")
            first, reach = first[by], np.maximum.accumulate(last[by])
            cuts = np.flatnonzero(first[1:] > reach[:-1])
            out += zip([i] * (len(cuts) + 1), first[np.r_[0, cuts + 1]].tolist(), reach[np.r_[cuts, len(reach) - 1]].tolist())
    return out


def matcher(length: int) -> Callable[[Shard], tuple[list[tuple], list[tuple]]]:
    powers, hashes = Powers(), WordHashes()

    def match(s: Shard) -> tuple[list[tuple], list[tuple]]:
        words = [t.split() for t in s.texts]
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
        starts, n = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        key = Prefix(symbols, powers).windows(length)[starts[owner] + within] if len(owner) else np.zeros(0, np.uint64)
        _, row = np.unique(s.uid, return_inverse=True)
        place = row[owner] * (int(s.start.max(initial=0)) + int(sizes.max(initial=0)) + 1) + s.start[owner] + within
        again = repeated_starts(key, place, s.n[owner] > 1)
        cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
        passages = set()
        for i in np.unique(owner[again]).tolist():
            mine = slice(cuts[i], cuts[i + 1])
            passages.update(b" ".join(words[i][a:b]) for a, b in runs(within[mine][again[mine]], length))
        found = locate(sorted(passages), s.texts) if passages else []
        more = sorted_runs(s, owner, within, key, length) if (s.salt >= 0).any() else []
        return found, more

    return match


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, texts: bool = False) -> DataFrame:
    """A row per document: n_words, n_removed, kept_sha256 (or, with ``texts``, the words that stay, joined)."""
    shape = Shape(length, max(1, length * 12 // 35))
    docs = stage_documents(df, id_col, text_col, shape, _symbols)
    spans = repeated_intervals(docs, shape, _cut, matcher(length), SHARD_BYTES)

    def remove(text: bytes, stretches: list[tuple[int, int]]) -> tuple:
        words, at, kept = text.split(), 0, []
        for s, e in stretches:
            kept += words[at:s]
            at = e
        kept += words[at:]
        joined = b" ".join(kept)
        return len(words), len(words) - len(kept), joined if texts else hashlib.sha256(joined).hexdigest()

    return apply_spans(docs, spans, remove, f"n_words long, n_removed long, {'kept binary' if texts else 'kept_sha256 string'}")
