"""Quality rules applied as a short-circuit cascade of built-in expressions.

Every rule is one Column over the whole text.  On a small sample each rule's
cost (seconds) and selectivity (share rejected) are measured, rules are put in
the order of rejections per second, and one CASE expression tries them in that
order: the first that rejects ends the work on a document.  The cost is the
least of several runs on warm code over copies of the sample, less that of a
rule that looks at nothing, in steps of two, so that noise doesn't reorder
rules; equal ones keep their given order.  The order changes time only, never
a verdict.

Edge cases: a NULL or empty text has no words and is rejected as too short;
ties and repeated rows are judged row by row; an empty table gives an empty
result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spaced, unused, word_array

SYMBOLS = "#*$%&|<>"
#: Rows that costs and selectivities are estimated on; copies of them that are timed, and how often.
SAMPLE_ROWS, COPIES, RUNS = 512, 2, 2


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(text: Column) -> Column:
    return F.char_length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(f"[{SYMBOLS}]")).cast("long")


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are compared by XXH64.  Few repeated windows are looked up in a
    short list, many by sorting (hash, place), so that no text costs more than
    n log n.
    """

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))).cast("long")

    def by_sorting(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def both(p: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            return F.transform(F.filter(p, lambda x, j: same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1))), lambda x: x["i"])

        return covered(let(pairs, both))

    def of_hashes(g: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            dups = F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False))))
            few = lambda d: covered(F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(d, g[i])))
            return let(dups, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).when(F.size(d) <= 24, few(d)).otherwise(by_sorting(g)))

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(F.sort_array(g), of_sorted))

    def of_words(w: Column) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(g, of_hashes))

    return let(words, of_words)


@dataclass(frozen=True)
class Measures:
    """What rules look at.  Each is an expression over the text and its words, put into a rule only where the rule asks for it; known values stand in."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Column:
        if name in self.known:
            return self.known[name]
        t = _text(self.text)
        return {
            "n_words": lambda: F.size(self.words).cast("long"), "word_chars": lambda: word_chars(t), "n_symbols": lambda: n_symbols(t), "n_dup_lines": lambda: n_dup_lines(t), "n_repeat_words": lambda: n_repeat_words(self.words),
            "n_lines": lambda: F.size(F.split(t, "\n")).cast("long"), "n_exclamations": lambda: F.regexp_count(t, F.lit("!")).cast("long"), "n_capitals": lambda: F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long"),
        }[name]()


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``test`` of its measures is true."""

    name: str
    test: Callable[[Measures], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


#: The first two are the fixed base; the others are the method's own.
RULES = [
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: _share(m.n_repeat_words, m.n_words, 50)),
    Rule("symbols", lambda m: _share(m.n_symbols, m.word_chars, 6)),
    Rule("exclamation", lambda m: _share(m.n_exclamations, m.word_chars, 8)),
    Rule("capitals", lambda m: _share(m.n_capitals, m.word_chars, 40)),
    Rule("repeated_lines", lambda m: (m.n_lines >= 4) & _share(m.n_dup_lines, m.n_lines, 50)),
    Rule("word_length", lambda m: let(m.word_chars, lambda c: (c < m.n_words * 2) | (c > m.n_words * 20))),
]


def cascade_order(df: DataFrame, text_col: str, rules: list[Rule]) -> list[Rule]:
    """``rules`` by measured rejections per second, the best first."""
    sample = df.select(F.col(text_col).alias("t")).where(F.rand(7) < 0.25).limit(SAMPLE_ROWS).persist()
    try:
        hits = lambda rule: F.sum(first_rejection(F.col("t"), [rule]).isNotNull().cast("int"))
        n = sample.count()
        if not n:
            return list(rules)
        copies = sample.select("t", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).select("t")
        jobs = [copies.agg(F.count("t"))] + [copies.agg(hits(r)) for r in rules]
        least, found = [math.inf] * len(jobs), [0] * len(jobs)
        for turn in range(RUNS + 1):  # the first warms up
            for i, job in enumerate(jobs):
                began = time.perf_counter()
                found[i] = job.first()[0] or 0
                if turn:
                    least[i] = min(least[i], time.perf_counter() - began)

        def worth(i: int) -> int:
            return round(math.log2((found[i] / COPIES + 0.5) / n / max(least[i] - least[0], 0.002)))

        return [rules[i - 1] for i in sorted(range(1, len(jobs)), key=lambda i: -worth(i))]
    finally:
        sample.unpersist()


def first_rejection(text: Column, ordered: list[Rule], **known: Column) -> Column:
    """Name of the first rule that rejects ``text``; NULL if none does.  Later rules are not evaluated."""

    def chain(words: Column) -> Column:
        m, out = Measures(text, words, known), None
        for rule in ordered:
            out = (F if out is None else out).when(F.coalesce(rule.test(m), F.lit(False)), rule.name)
        return out

    return chain(word_array(text)) if {"n_words", "n_repeat_words"} <= known.keys() else let(word_array(text), chain)


def quality_filter(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects."""
    ordered = cascade_order(df, text_col, rules or RULES)
    return df.where(first_rejection(F.col(text_col), ordered).isNull())


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: measures, ``base_failed`` and ``kept``."""
    ordered = cascade_order(df, text_col, RULES[2:])
    text, words, measures = unused(df, "text", "words", "measures")
    t = F.col(text)
    both = let(word_array(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words")))
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text)).withColumn(measures, both)
    m = lambda c: F.col(measures)[c]
    out = out.select(
        "doc_id", m("n_words").alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), m("n_repeat_words").alias("n_repeat_words"),
        ((m("n_words") < 50) | _share(m("n_repeat_words"), m("n_words"), 50)).alias("base_failed"), F.col(text).alias(text),
    )
    known = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_rejection(F.col(text), ordered, **known).isNull())
    return out.withColumn("kept", kept).drop(text)
