"""Packing by lexical retrieval.

1. Texts become ids.  A tokenizer that never joins across ASCII white space, splits
   a full stop or comma off a letter, and ignores ASCII case, gives a text the
   ids of its words in order, so each distinct word is encoded once and
   remembered; any other (probed at start) encodes whole texts.  Ids and a
   min-hash of the words are written to the shared folder.
2. Documents are range-partitioned by the min-hash (then by id, so that ties
   split), which puts lexically near documents side by side and gives each task
   about as many rows.
3. A task reads its rows in shards of bounded size.  For each shard it builds a
   BM25 inverted index, and the unused neighbours that the index returns for a
   seed document fill the seed's window greedily.  The document that a full
   window cuts is the next seed.  So every sequence is full but the last of a
   task, which is cut into sequences of power-of-two lengths: no padding.

Edge cases: a NULL or empty text is the end id alone; repeated rows are packed
each by itself; a NULL id is returned as NULL; a text of any length is cut over
as many windows as it needs; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, staged
from .repeats import Powers, Prefix

#: Words that a worker remembers the ids of, over all its tasks: about 35 bytes each.
REMEMBERED = 1 << 19
#: New words that are encoded as one text.
LEARNED = 1 << 14
#: Bytes of a worker's first texts, and texts of all habits, on which encoding by words is held against encoding whole texts.
CHECKED = 1 << 16
PROBES = ["The cat, it's here.  A.B,c. 3.14, 1,000.\tEnd\n\nNew", "Ünïcode “quoted”, straße. Don't x, y.. z,, .a ,b I'LL o'Neil's,", "a_b-c <|endoftext|> <|EndOfText|> <b>Bold.</b> e\u0301t\u00a0nbsp 中文，混合. ΣΑΣ. İx"]
#: Bytes of text that are encoded at once; a shard of the index ends at so many documents or ids.
BLOCK_BYTES, SHARD_DOCS, SHARD_IDS = 1 << 20, 4096, 2 << 20
#: BM25's parameters, and the most telling ids of a seed that make its query.
K1, B, QUERY_IDS = 1.2, 0.75, 16

_BYTES = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


class WordIds:
    """Ids of words: ``ids[starts[i] : starts[i] + sizes[i]]`` are those of the word whose hash is ``keys[i]``; keys are sorted.

    Words are told apart by a 64-bit hash; among the half million that are remembered two meet with a chance of 1e-8.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.powers = Powers()
        self.punctuation = [self._encode(x) for x in (".", ",")]
        self.forget()
        self.checked = 0
        self.by_word = [len(x) for x in self.punctuation] == [1, 1] and self._same([x.encode() for x in PROBES])

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _same(self, texts: list[bytes]) -> bool:
        """Whether words give the ids that the whole texts give."""
        got, _ = self._by_word(texts, None)
        return all(x.tolist() == self._encode(t.decode("utf-8", "replace")) for x, t in zip(got, texts))

    def forget(self) -> None:
        self.keys, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encodes new words (``keys`` are sorted) in one text; the place of each id tells its word."""
        said = b" ".join(words).decode("utf-8", "replace")
        got = self.tokenizer.encode(said, add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        at = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in said.split(" ")), np.int64, len(words)))
        sizes = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(words))
        place = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, place, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes, self.keys = np.insert(self.sizes, place, sizes), np.insert(self.keys, place, keys)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[bytes], end: int) -> tuple[list[np.ndarray], list[int]]:
        """Each text's ids, ``end`` last, and the smallest hash of its words.

        A tokenizer that reads a text otherwise than word by word (``PROBES`` and
        the worker's first texts tell) encodes whole texts.
        """
        if self.by_word and self.checked < CHECKED:
            some = [t for t in texts if len(t) < CHECKED][:64]
            self.checked += sum(map(len, some))
            self.by_word = self._same(some)
        got, mins = self._by_word(texts, end)
        if not self.by_word:
            got = [np.array([*x.ids, end], np.uint32) for x in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return got, mins

    def _by_word(self, texts: list[bytes], end: int | None) -> tuple[list[np.ndarray], list[int]]:
        if len(self.keys) > REMEMBERED:
            self.forget()
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        text = raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
        space = _SPACE[raw]
        first = np.flatnonzero(~space & np.r_[True, space[:-1]])
        last = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        for w in np.unique(np.searchsorted(first, np.flatnonzero(raw == 60), "right") - 1).tolist():
            text[first[w] : last[w]] = raw[first[w] : last[w]]  # control strings are known by their case
        mark = text[last - 1]
        marked = ((mark == 46) | (mark == 44)) & (last - first > 1) & _LETTER[text[np.maximum(last - 2, 0)]]
        core = last - marked
        keys = Prefix(_BYTES[text], self.powers).hash(first, core) + (core - first).astype(np.uint64)
        distinct, at, word = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(place == len(self.keys)) if not len(self.keys) else np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != distinct)
        if len(new):
            body = text.tobytes()
            for i in range(0, len(new), LEARNED):
                some = new[i : i + LEARNED]
                self._learn(distinct[some], [body[a:b] for a, b in zip(first[at[some]].tolist(), core[at[some]].tolist())])
            place = np.searchsorted(self.keys, distinct)
        which = place[word]
        size = self.sizes[which].astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, first, "right")
        total, last_ids = size + marked, int(end is not None)
        begin = np.cumsum(total) - total + doc * last_ids  # each text before has an end id
        out = np.empty(int(total.sum()) + len(texts) * last_ids, np.uint32)
        before = np.cumsum(size) - size
        n = np.arange(int(size.sum()))
        out[np.repeat(begin - before, size) + n] = self.ids[np.repeat(self.starts[which] - before, size) + n]
        for code, tokens in ((46, self.punctuation[0]), (44, self.punctuation[1])):
            out[(begin + size)[marked & (mark == code)]] = tokens[0]
        per_doc = np.bincount(doc, total, len(texts)).astype(np.int64) + last_ids
        stops = np.cumsum(per_doc)
        if last_ids:
            out[stops - 1] = end
        mins = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(mins, doc, keys)
        return np.split(out, stops[:-1]), mins.view(np.int64).tolist()


def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task."""
    kept = sys.modules.setdefault("_word_ids_of_this_worker", types.ModuleType("_word_ids_of_this_worker")).__dict__
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


class Index:
    """A BM25 inverted index over the documents of a shard, by id of the vocabulary."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = self.n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        ids = np.concatenate(docs)
        kind = np.uint32 if (int(ids.max()) + 1) * n < 1 << 32 else np.int64  # of (id, document) pairs
        pair, tf = np.unique(ids.astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), size), return_counts=True)
        self.terms, self.docs = pair // n, (pair % n).astype(np.uint16 if n <= 1 << 16 else np.int64)
        self.first = np.searchsorted(self.terms, np.arange(int(self.terms[-1]) + 2))
        self.df = np.diff(self.first)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * size / size.mean())
        self.weight = (idf[self.terms] * tf * (K1 + 1) / (tf + norm[self.docs])).astype(np.float32)
        self.by_doc = np.argsort(self.docs, kind="stable")
        self.of = np.searchsorted(self.docs[self.by_doc], np.arange(n + 1))

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share telling ids with ``doc``, the nearest first."""
        own = self.by_doc[self.of[doc] : self.of[doc + 1]]
        own = own[self.df[self.terms[own]] > 1]
        if len(own) > QUERY_IDS:
            own = own[np.argpartition(-self.weight[own], QUERY_IDS)[:QUERY_IDS]]
        if not len(own):
            return np.zeros(0, np.int64)
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.terms[own].tolist()]
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def retrieval_order(index: Index, sizes: list[int], room: int, window: int) -> Iterator[int]:
    """The documents of a shard in the order in which windows take them.

    ``room`` is what is left of the open window.  Neighbours of the seed follow
    it until the window is full; the one that crosses its end is the next seed.
    """
    used, rest = np.zeros(index.n, bool), 0
    while True:
        while rest < index.n and used[rest]:
            rest += 1
        if rest == index.n:
            return
        seed = rest
        used[seed] = True
        yield seed
        room -= sizes[seed]
        while True:
            if room <= 0:
                room = window - (-room) % window
            crossed = False
            for d in index.neighbours(seed, used).tolist():
                used[d] = True
                yield d
                room -= sizes[d]
                if room <= 0:
                    seed, crossed = d, True
                    break
            if not crossed:
                break


class Packer:
    """Cuts a stream of id arrays into sequences of ``window`` ids."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.sequence, self.open, self.fill = window, first, [], 0

    @property
    def room(self) -> int:
        return self.window - self.fill

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.room, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            self.fill += take
            at += take
            if not self.room:
                yield from self.close(self.window)

    def close(self, length: int) -> Iterator[tuple]:
        """The first ``length`` ids of what is open become a sequence."""
        offset, left = 0, []
        for doc, start, ids, total in self.open:
            take = min(length - offset, len(ids))
            if take:
                yield doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, self.sequence, offset
                offset += take
            if take < len(ids):
                left.append((doc, start + take, ids[take:], total))
        self.sequence, self.open, self.fill = self.sequence + 1, left, self.fill - length

    def finish(self) -> Iterator[tuple]:
        """What is left, in sequences of power-of-two lengths: these need no padding."""
        while self.fill:
            yield from self.close(1 << (self.fill.bit_length() - 1))


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, near, ids): every row's ids as little-endian bytes, two to an id where the vocabulary allows, and the min-hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        kind = _kind(words.vocabulary)
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size, start = [], 0, at
                while at < b.num_rows and size < BLOCK_BYTES:
                    texts.append(b.column(1)[at].as_py() or b"")
                    size += len(texts[-1])
                    at += 1
                ids, near = words.encode(texts, end_id)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(near, pa.int64()), pa.array([i.astype(kind).tobytes() for i in ids], pa.binary())], ["doc_id", "near", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.transform(in_arrow, run, "doc_id long, near long, ids binary"), "ids")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = _kind(word_ids(tokenizer_path).vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for ids, docs in shards(batches, kind):
            index, out = Index(docs), []
            for d in retrieval_order(index, [len(x) for x in docs], packer.room, window):
                out += packer.add(ids[d], docs[d])
            if out:
                yield rows(out)
        if out := list(packer.finish()):
            yield rows(out)

    docs = encode_documents(df, tokenizer_path, id_col, text_col, end_id)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("near", F.xxhash64("near"))  # else long texts, whose minima are small, would meet in the first ranges
    docs = docs.repartitionByRange(n, "near", "doc_id").sortWithinPartitions("near", "doc_id")
    return docs.select("doc_id", "ids").transform(in_arrow, run, ", ".join(f"{c} long" for c in names))


def shards(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, docs, size = [], [], 0
    for b in batches:
        for i, d in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            docs.append(np.frombuffer(d.as_py(), kind))
            size += len(docs[-1])
            if len(ids) >= SHARD_DOCS or size >= SHARD_IDS:
                yield ids, docs
                ids, docs, size = [], [], 0
    if ids:
        yield ids, docs
