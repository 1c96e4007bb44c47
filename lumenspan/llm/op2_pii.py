"""Personal data: fixed patterns, and terms that give protected values away.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers.  Each
value found is a protected entity, and the terms of a document that holds it are
a context.  Over the whole corpus the share of the entity's information that a
term discloses is

    disclosure(t, c) = PMI(t; c) / IC(c) = log(p(t, c) / (p(t) p(c))) / -log p(c)

where each p is a share of the corpus's documents (Sanchez and Batet's
C-sanitisation).  A term in ``SUPPORT`` independent contexts of c (copies and
near copies of one context count as documents, but only one of them supports:
else every word of a passage that is copied with its value would disclose it)
whose disclosure reaches ``remove_at`` is removed; one that reaches ``generalise_at`` is replaced by the
class of words it belongs to (``general``): wherever it stands in the corpus,
beside the value or in a document without it.  The spans of both are added to
the base ones.

Only terms with that support can disclose, so these are counted first; if there
are few (a checked bound) their counts over the corpus come from one pass that
knows them, else from a distributed count of all words, and rows then look up
the judgements of their own terms where they lie.

Edge cases: a NULL text is empty and has no spans; repeated rows are each
judged, and equal or nearly equal contexts support once; an empty table gives an empty result;
other columns pass through ``sanitise`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Container, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Rows, in_arrow, staged, unused

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, written so that no text takes quadratic time.  An e-mail
#: address lies in one run of its own characters; an IP address that fails at
#: the first digit of a group fails at the others.
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TWO_DIGITS = re.compile(r"[0-9][0-9. -]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Independent contexts of an entity that must hold a term before it can disclose.
SUPPORT = 3
#: Contexts that agree in one of BANDS groups of BAND_ROWS min-hashes of their pairs of neighbouring terms depend on each other (0.8 alike: 1.0; 0.6: 0.96; 0.2: 0.04).
BANDS, BAND_ROWS = 24, 4
_MIXERS = np.random.default_rng(42).integers(1, 2**63, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
#: Candidate terms (or entities) that one pass may know by heart; beyond, words are counted by a shuffle.
KNOWN_TERMS = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    for run in _EMAIL_RUN.finditer(text):
        r, at, first = run[0], run.start(), 0
        p = r.find("@")
        while p >= 0:
            m = _DOMAIN.match(r, p + 1) if p > first else None
            if m:
                yield "email", at + first, at + m.end()
            first = m.end() if m else p + 1
            p = r.find("@", first)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += _emails(text)
    cards = []
    if _TWO_DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", m.start(), m.end()))
    out += cards
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def term_of(word: str) -> str:
    return word.strip(".,;:!?()[]{}\"'<>|*#$%&").lower()


def term_key(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big", signed=True)


def entity_key(kind: str, value: str) -> int:
    plain = value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    return term_key(f"{kind}:{plain}")


def outside(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with spaces for the words that ``spans`` touch."""
    if not spans:
        return text
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if e <= at:
            continue
        s = max(s, at)
        while s > at and text[s - 1] not in SPACES:
            s -= 1
        while e < len(text) and text[e] not in SPACES:
            e += 1
        out += [text[at:s], " " * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text: of three characters or more."""
    return {t for w in set(_WORD.findall(text)) if len(t := term_of(w)) > 2}


class Known:
    """Finds those of the term keys ``keys`` whose terms a text holds; each word is judged once, while it is remembered."""

    def __init__(self, keys: Container[int]) -> None:
        self.keys = keys
        self.seen: set[bytes] = set()
        self.hits: dict[bytes, int] = {}

    def found(self, text: bytes) -> set[int]:
        words = set(text.split())  # bytes split at ASCII white space only, as _WORD does
        if fresh := words - self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
                self.hits.clear()
                fresh = words
            self.seen |= fresh
            self.hits.update((w, k) for w in fresh if len(t := term_of(w.decode())) > 2 and (k := term_key(t)) in self.keys)
        return {self.hits[w] for w in words & self.hits.keys()}


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def _context(text: str, spans: list[tuple[str, int, int]]) -> tuple[int, list[str]]:
    terms = sorted(terms_of(outside(text, spans)))
    return term_key("\0".join(terms)), terms


def bands_of(text: str) -> list[int]:
    """A key per band of min-hashes of the pairs of neighbouring terms; zeros if there is none."""
    terms = [t for w in _WORD.findall(text) if (t := term_of(w))]
    pairs = {f"{a} {b}" for a, b in pairwise(terms)}
    if not pairs:
        return [0] * BANDS
    own = np.array([term_key(x) for x in pairs], np.int64).view(np.uint64)
    least = np.array([(own * m).min() for m in _MIXERS])
    return [term_key(least[i : i + BAND_ROWS].tobytes().hex()) for i in range(0, len(least), BAND_ROWS)]


def entity_contexts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, context, bands, n): each distinct context of each entity, its bands and how many documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                if spans := base_spans(t):
                    context, _ = _context(t, spans)
                    bands = bands_of(outside(t, spans))
                    rows += [(e, context, bands) for e in {entity_key(k, t[s:e]) for k, s, e in spans}]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["entity", "context", "bands"])

    return _texts(df, text_col).transform(in_arrow, run, "entity long, context long, bands array<long>").groupBy("entity", "context").agg(F.min("bands").alias("bands"), F.count("*").alias("n"))


def independent(contexts: DataFrame) -> DataFrame:
    """(entity, context): contexts that are the first of their entity in all their bands.

    A near copy shares a band with the context it was made from, so one of a
    group stays, however many there are; minima combine on the map side.
    """
    firsts = contexts.select("entity", "context", F.posexplode("bands").alias("i", "band")).groupBy("entity", "i", "band").agg(F.min("context").alias("context"))
    return firsts.groupBy("entity", "context").agg(F.count("*").alias("first_in")).where(F.col("first_in") == BANDS).drop("first_in")


def cooccurrence(df: DataFrame, text_col: str = "text", entities: frozenset[int] | None = None) -> DataFrame:
    """(entity, context, term, n): each distinct context of each entity (of ``entities``, if given), a row per term in it, and how many documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                spans = base_spans(t)
                own = {entity_key(k, t[s:e]) for k, s, e in spans}
                if entities is not None:
                    own &= entities
                if own:
                    context, terms = _context(t, spans)
                    keys = [term_key(x) for x in terms]
                    for entity in own if keys else ():
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([entity] * n, [context] * n, keys)], ["entity", "context", "term"])

    return _texts(df, text_col).transform(in_arrow, run, "entity long, context long, term long").groupBy("entity", "context", "term").agg(F.count("*").alias("n"))


def disclosures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, share): terms with support and the share of the entity's information that each discloses."""
    contexts = staged(entity_contexts(df, text_col), "contexts")
    leading = staged(independent(contexts), "independent-contexts")
    enough = leading.groupBy("entity").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT).drop("support")  # fewer support no term
    n_entity = staged(contexts.groupBy("entity").agg(F.sum("n").alias("n_entity")).join(enough, "entity"), "entities")
    n_entities = n_entity.count()
    entities = frozenset(r["entity"] for r in n_entity.collect()) if n_entities <= KNOWN_TERMS else None
    if n_entities:
        held = cooccurrence(df, text_col, entities).join(leading.withColumn("leads", F.lit(1)), ["entity", "context"], "left")
        pairs = held.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("leads").alias("support")).where(F.col("support") >= SUPPORT).drop("support")
    else:
        pairs = df.sparkSession.createDataFrame([], "entity long, term long, n_both long")
    pairs = staged(pairs, "supported-terms")
    candidates = pairs.select("term").distinct()
    n_candidates = candidates.count()
    schema = "entity long, term long, share double"
    if not n_candidates:
        return df.sparkSession.createDataFrame([], schema)
    known = {r["term"] for r in candidates.collect()} if n_candidates <= KNOWN_TERMS else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        keys: dict[str, int] = {}
        words = None if known is None else Known(known)
        for b in batches:
            for t in b.column(0):
                if words is not None:
                    found = words.found(t.as_buffer().to_pybytes())
                    if found and (spans := base_spans(t := t.as_py())):
                        found = words.found(outside(t, spans).encode())
                    counts.update(found)
                    continue
                t = t.as_py()
                for x in terms_of(outside(t, base_spans(t))):
                    if (k := keys.get(x)) is None:
                        if len(keys) > 200_000:
                            keys.clear()
                        keys[x] = k = term_key(x)
                    counts[k] += 1
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    n_term = _texts(df, text_col).transform(in_arrow, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    n_docs = df.count()
    log = lambda x: F.log(x.cast("double") / n_docs)
    both, term, entity = F.col("n_both"), F.greatest("n_term", "n_both"), F.col("n_entity")
    share = (log(both) - log(term) - log(entity)) / F.greatest(-log(entity), F.lit(1e-9))
    return pairs.join(n_entity, "entity").join(n_term, "term").select("entity", "term", share.alias("share"))


def _judged(df: DataFrame, text_col: str, generalise_at: float, remove_at: float) -> dict[int, bool] | DataFrame:
    """Each disclosing term to whether it is removed (else generalised); a DataFrame where there are too many to send."""
    found = disclosures(df, text_col).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise_at)
    found = staged(found.select("term", (F.col("share") >= remove_at).alias("gone")), "disclosing")
    if found.count() > KNOWN_TERMS:
        return found
    return {r["term"]: r["gone"] for r in found.collect()}


def term_spans(text: str, spans: list[tuple[str, int, int]], judged: dict[int, bool], words: dict[str, bool | None]) -> list[tuple[str, int, int]]:
    """Spans of the disclosing terms of ``text`` outside ``spans``: ``term`` to remove, ``hint`` to generalise.

    ``words`` remembers words that ``judged`` was asked for.
    """
    if not judged:
        return []
    if len(words) > 200_000:
        words.clear()
    any_found, text = False, outside(text, spans)
    for w in set(_WORD.findall(text)):
        if w not in words:
            words[w] = judged.get(term_key(t)) if len(t := term_of(w)) > 2 else None
        any_found |= words[w] is not None
    if not any_found:
        return []
    return sorted(("term" if gone else "hint", *m.span()) for m in _WORD.finditer(text) if (gone := words[m[0]]) is not None)


def _with_judged(df: DataFrame, columns: list, judged: dict | DataFrame, text_col: str) -> tuple[DataFrame, dict | None]:
    """The rows; beyond the bound each has the judgements of its own terms as a column."""
    rows = df.select(*columns)
    row_id, name = unused(rows, "row_id", "judged")
    if isinstance(judged, dict):
        return rows.withColumn(name, F.lit(None).cast("array<struct<term:long,gone:boolean>>")), judged

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = [term_key(x) for x in terms_of(t)]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array([r] * len(keys), pa.int64()), pa.array(keys, pa.int64())], ["row_id", "term"])

    at_rest = Rows(rows, row_id, "rows")
    own = at_rest.df.select(row_id, F.coalesce(F.col(text_col), F.lit(""))).transform(in_arrow, terms, "row_id long, term long")
    found = at_rest.dealt(own.join(judged, "term").select(F.col("row_id").alias(row_id), "term", "gone"))
    per_row = found.groupBy(at_rest.bucket, row_id).agg(F.collect_list(F.struct("term", "gone")).alias(name))
    return at_rest.join(per_row, "left").select(*rows.columns, name), None


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """A row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    rows, known = _with_judged(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], _judged(df, text_col, generalise_at, remove_at), "text")
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, bool | None] = {}
        for b in batches:
            out = []
            for i, t, own in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
                base = base_spans(t or "")
                more = term_spans(t or "", base, known, words) if known is not None else term_spans(t or "", base, {x["term"]: x["gone"] for x in own or []}, {})
                said = [f"{k}:{s}:{e}" for k, s, e in base]
                n = Counter(x[0] for x in base)
                out.append((i, *(n[k] for k in KINDS), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(said + [f"{k}:{s}:{e}" for k, s, e in more])))
            if out:
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.transform(in_arrow, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def general(word: str) -> str:
    """The class of words that a generalised term belongs to."""
    core = term_of(word)
    if core.isdigit():
        return f"{len(core)}-DIGIT NUMBER"
    if any(c.isdigit() for c in core):
        return "CODE"
    first = word.lstrip(".,;:!?()[]{}\"'<>|*#$%&")[:1]
    return "NAME" if first.isupper() else "WORD"


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind, removed terms by nothing, and hints by a more general word; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], "" if kind == "term" else f"[{general(text[s:e]) if kind == 'hint' else kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, text_col: str = "text", generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """``df`` with its texts sanitised; a NULL text stays NULL."""
    judged = _judged(df, text_col, generalise_at, remove_at)
    rows, known = _with_judged(df, ["*"], judged, text_col)
    at, schema = df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, bool | None] = {}
        for b in batches:
            texts = []
            for t, own in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if t is not None:
                    base = base_spans(t)
                    more = term_spans(t, base, known, words) if known is not None else term_spans(t, base, {x["term"]: x["gone"] for x in own or []}, {})
                    if base or more:
                        t = redact(t, base + more)
                texts.append(t)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=list(b.schema.names[:-1]))

    return rows.transform(in_arrow, run, schema)
