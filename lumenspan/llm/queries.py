"""The registered queries of the corpus operators: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .op1_html import extract_pages
from .op2_pii import pii_report
from .op3_license import BLANK, CONFIRM, CUES, LEAST, NOTICES, UNKNOWN, WRAPPED, grams_of, license_scan, model, words_of
from .op4_chat import chat_digests
from .op5_quality import quality_report
from .op6_automata import passage_dedup
from .op7_decontam import leaks
from .op8_simhash import near_duplicates
from .op9_packing import pack
from .op10_suffix import suffix_dedup


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_digests(rows.unionByName(extra))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op6_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_pii, op3_license, op4_chat, op5_quality_rules, op6_automata, op7_decontam, op8_simhash, op9_packing, op10_suffix)}


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1)
  GROUP BY r),
m AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(replace(t, '!', '')) AS bangs,
         length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS uppers,
         len(string_split(t, chr(10))) AS n_lines
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 6 * word_chars OR 100 * bangs > 8 * word_chars
            OR 100 * uppers > 40 * word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT r, i, md5_number(hex(b[i:i + 399])) AS g FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
cut AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS s FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM again)),
span AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM cut GROUP BY r, s),
piece AS (SELECT r, coalesce(lag(z) OVER w, 1) AS a, a - 1 AS z FROM span WINDOW w AS (PARTITION BY r ORDER BY a) UNION ALL SELECT r, max(z), any_value(n) FROM span JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN piece.z >= piece.a THEN hex(b[piece.a:piece.z]) ELSE '' END, '' ORDER BY piece.a) AS k FROM piece JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(z - a) AS gone, count(*) AS c FROM span GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(CASE WHEN k IS NULL THEN b ELSE unhex(k) END) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


def op3_sql() -> str:
    """The scan as SQL, with the trained weights and the notices as constants."""
    classes, weights, temperature = model()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda rows: "VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows)
    w = values([text(g), str(c), f"{x}::DOUBLE"] for g, xs in weights.items() if g for c, x in enumerate(xs) if x)
    k = values([str(c), text(name), f"{b}::DOUBLE"] for c, (name, b) in enumerate(zip(classes, weights.get("", [0.0] * len(classes)))))
    n = values([text(g), text(family), str(i), str(len(gs))] for family, ts in NOTICES.items() for i, t in enumerate(ts) for gs in [grams_of(words_of(t))] for g in sorted(gs))
    return f"""
WITH w(g, c, x) AS ({w}), k(c, family, bias) AS ({k}), notice(g, family, i, size) AS ({n}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), {text(BLANK)}, chr(30), 'g'), {text(WRAPPED)}, '\\1 ', 'g'), '[\\n\\x1e]') AS ls FROM documents),
line AS (SELECT r, p, said FROM (SELECT r, unnest(ls) AS said, unnest(range(len(ls))) AS p FROM d) WHERE regexp_matches(said, {text(CUES)})),
word AS (SELECT r, p, list_filter(string_split(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM line),
gram AS (SELECT DISTINCT r, p, array_to_string(ws[i:i + j], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM word) CROSS JOIN (VALUES (0), (1), (2)) v(j) WHERE i + j <= len(ws)),
seen AS (SELECT DISTINCT r, p FROM gram JOIN w USING (g)),
score AS (SELECT r, p, k.c, k.family, (coalesce(sum(x), 0) + any_value(bias)) / {temperature!r} AS s FROM seen CROSS JOIN k LEFT JOIN (SELECT r, p, c, x FROM gram JOIN w USING (g)) USING (r, p, c) GROUP BY r, p, k.c, k.family),
best AS (SELECT r, p, arg_max(family, (s, -c)) AS family, 1 / sum(exp(s - top)) AS probability FROM (SELECT *, max(s) OVER (PARTITION BY r, p) AS top FROM score) GROUP BY r, p),
alike AS (SELECT r, p, family, max(share) AS share FROM (SELECT r, p, family, i, count(*) / any_value(size) AS share FROM gram JOIN notice USING (g) GROUP BY ALL) GROUP BY ALL),
top AS (SELECT r, p, max(share) AS most FROM alike GROUP BY r, p),
sure AS (SELECT r, count(*) AS n, array_to_string(list_sort(list(DISTINCT family)), ',') AS fs FROM best JOIN alike USING (r, p, family) JOIN top USING (r, p) WHERE family <> {text(UNKNOWN)} AND probability >= {LEAST} AND share >= {CONFIRM} AND share >= most GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_paragraphs, coalesce(fs, '') AS families FROM d LEFT JOIN sure USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license": op3_sql(), "op5_quality_rules": OP5_SQL, "op6_automata": OP6_SQL, "op10_suffix": OP10_SQL}
