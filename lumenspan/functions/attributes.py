"""Attribute values: canonical JSON text, its readings and comparisons, and words."""

from __future__ import annotations

import json
import re
from json.encoder import encode_basestring

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
LONG_MAX = (1 << 63) - 1
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)
_WORDS = {None: "null", True: "true", False: "false"}


def canonical(value: object) -> str:
    """Canonical JSON: sorted keys, no white space."""
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    if kind is int:
        return repr(value)
    # most values are scalars: these need no encoder, which is made anew for each container
    return _WORDS[value] if value is None or kind is bool else _ENCODER.encode(value)


def value(attributes: Column | str, key: str) -> Column:
    """The JSON text of an attribute; NULL if it is missing."""
    return F.try_element_at(F.col(attributes) if isinstance(attributes, str) else attributes, F.lit(key))


def scalar_text(v: Column) -> Column:
    """A scalar's plain text: strings without quotes; NULL for containers and null."""
    parsed = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    # without an escape a string's text stands between its quotes
    plain = v.endswith('"') & ~v.contains("\\") & (F.length(v) > 1)
    text = F.when(plain, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(parsed)
    return F.when(v.startswith('"'), text).when(v.startswith("{") | v.startswith("[") | (v == "null"), F.lit(None)).otherwise(v)


def _double(text: Column) -> Column:
    """A finite or infinite number from its text; NULL otherwise, and never NaN."""
    low = F.regexp_replace(F.lower(text), r"^\+", "")
    return (
        F.when(text.rlike(_NUMBER), text.try_cast("double"))
        .when(low.isin("inf", "infinity"), F.lit(float("inf")))
        .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
    )


def numeric(v: Column) -> Column:
    """A number, or a string that is one as it stands (no trimming)."""
    return F.when(~v.isin("true", "false"), _double(scalar_text(v)))


def loosely_equal(v: Column, wanted: str) -> Column:
    """Type-agnostic for scalars (200 and "200"), structural for containers."""
    try:
        parsed = json.loads(wanted)
    except ValueError:
        parsed = wanted
    if isinstance(parsed, dict | list):
        return F.coalesce((v == canonical(parsed)) | (scalar_text(v) == wanted), F.lit(False))
    return F.coalesce(scalar_text(v) == wanted, F.lit(False))


def strictly_different(v: Column, wanted: object) -> Column:
    """Type-strict; a missing attribute is different from everything."""
    return F.coalesce(v != canonical(wanted), F.lit(True))


def text_of(v: Column, text: Column) -> Column:
    """A value, whose scalar text is ``text``, as a non-empty string or a number's text."""
    return F.when(~v.isin("true", "false", '""'), text)


def long_of(v: Column, text: Column) -> Column:
    """A value as a count: a number cut to an integer of 0 or more, or a trimmed string of digits."""
    text = F.trim(text)
    whole = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))
    cut = F.when(text.rlike(_NUMBER), F.least(F.greatest(F.floor(text.try_cast("double")), F.lit(0)), F.lit(LONG_MAX)))
    return F.when(v.startswith('"'), whole).when(~v.isin("true", "false"), F.coalesce(whole, cut))


def double_of(v: Column, text: Column) -> Column:
    """A value as a finite number; strings are trimmed."""
    n = F.when(~v.isin("true", "false"), _double(F.trim(text)))
    return F.when(F.abs(n) != float("inf"), n)


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, lower-cased after they are cut."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z]+"), F.lit(0)), F.lower)


def _wanted(query: str) -> list[str]:
    return sorted({w.lower() for w in re.findall("[0-9A-Za-z]+", query)})


def near_words(text: Column, query: str) -> Column:
    """The letters of every word of ``query`` are somewhere in ``text``: cheap, and needed for any match."""
    near = F.lit(True)
    for w in _wanted(query):
        near = near & text.rlike(f"(?i){w}")
    return near


def has_words(text: Column, query: str) -> Column:
    """Every word of ``query`` is a word of ``text``; a query without words matches nothing."""
    wanted = _wanted(query)
    if not wanted:
        return F.lit(False)
    # most texts end at the letters
    near = near_words(text, query)
    exact = F.lit(True)
    for w in wanted:
        exact = exact & text.rlike(f"(?i)(?<![0-9A-Za-z]){w}(?![0-9A-Za-z])")
    return F.coalesce(near & exact, F.lit(False))


def strings(v: Column) -> Column:
    """The strings within a JSON text at any depth, still quoted, without object keys and without what ``$payload`` keys hold.

    Escapes become spaces: what they stand for is no part of a word.  Then a
    literal runs from quote to quote, and one before a colon is a key.
    """
    plain = F.regexp_replace(F.regexp_replace(v, r"\\(u[0-9a-fA-F]{4}|.)", " "), r'"\$payload":"[^"]*"', "")
    return F.filter(F.regexp_extract_all(plain, F.lit('"[^"]*":?'), F.lit(0)), lambda x: ~x.endswith('":'))


def searchable_text(attributes: Column, events: Column) -> Column:
    """All strings that search looks at: within attribute values (of payload references the preview), event names, and within event attributes."""
    all_of = lambda m: F.flatten(F.transform(F.map_values(m), strings))
    of_events = F.flatten(F.transform(events, lambda e: F.concat(F.array(F.coalesce(e["name"], F.lit(""))), all_of(e["attributes"]))))
    return F.concat_ws("\n", all_of(attributes), F.coalesce(of_events, F.array().cast("array<string>")))


def stored_text(attributes: Column, events: Column) -> Column:
    """All that ``searchable_text`` is taken from, as it is stored: a word there is a run of letters and digits here too."""
    of_events = F.flatten(F.transform(events, lambda e: F.concat(F.array(F.coalesce(e["name"], F.lit(""))), F.map_values(e["attributes"]))))
    return F.concat_ws("\n", F.map_values(attributes), F.coalesce(of_events, F.array().cast("array<string>")))
