"""The one query predicate: clauses that must all hold, as a Column for Catalyst to push down."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import has_words, loosely_equal, near_words, numeric, searchable_text, stored_text, strictly_different, value
from ..functions.semconv import duration
from ..schema import ORDER

SORTS = {"start": ("start_time_ns", True), "-start": ("start_time_ns", False), "duration": (None, True), "-duration": (None, False)}


@dataclass(frozen=True)
class Cursor:
    """A place in the total order of spans; a page begins strictly after it."""

    start_time_ns: int
    end_time_ns: int
    tenant: str
    trace_id: str
    span_id: str

    def token(self) -> str:
        body = json.dumps([1, *(getattr(self, f.name) for f in fields(self))], separators=(",", ":"))
        return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")

    @classmethod
    def from_token(cls, token: str) -> Cursor:
        try:
            version, *parts = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
            if version != 1 or [type(p) for p in parts] != [int, int, str, str, str]:
                raise ValueError
        except (ValueError, TypeError) as e:
            raise ValueError("not a cursor of this store") from e
        return cls(*parts)

    def after(self) -> Column:
        return F.struct(*ORDER) > F.struct(*[F.lit(getattr(self, f.name)).alias(f.name) for f in fields(self)])


@dataclass(frozen=True)
class SpanFilter:
    """``tenant`` None is all tenants, "" the default one; bounds of time are inclusive on both sides."""

    tenant: str | None = None
    service: str | None = None
    name: str | None = None
    status: str | None = None
    not_status: tuple[str, ...] = ()
    min_duration_ns: int | None = None
    max_duration_ns: int | None = None
    since_ns: int | None = None
    until_ns: int | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    not_attributes: dict[str, object] = field(default_factory=dict)
    min_attributes: dict[str, float] = field(default_factory=dict)
    max_attributes: dict[str, float] = field(default_factory=dict)
    session: str | None = None
    content: str | None = None
    cursor: Cursor | None = None
    sort: str | None = None
    limit: int | None = None

    @classmethod
    def from_params(cls, params: list[tuple[str, str]], bound_tenant: str | None = None) -> SpanFilter:
        """From query parameters; unknown ones are errors, and a bound tenant admits no other."""
        plain = {"tenant", "service", "name", "status", "session", "sort"}
        got: dict[str, object] = {}
        maps: dict[str, dict] = {"attributes": {}, "not_attributes": {}, "min_attributes": {}, "max_attributes": {}}
        heads = {"attr.": "attributes", "not_attr.": "not_attributes", "min_attr.": "min_attributes", "max_attr.": "max_attributes"}
        for key, text in params:
            head = next((h for h in heads if key.startswith(h)), None)
            if key in plain:
                got[key] = text
            elif key == "not_status":
                got["not_status"] = (*got.get("not_status", ()), text)
            elif key in ("content", "q"):
                got["content"] = text
            elif key in ("since", "since_ns", "until", "until_ns"):
                got[key.removesuffix("_ns") + "_ns"] = int(text)
            elif key in ("min_duration_ms", "max_duration_ms", "min_duration_ns", "max_duration_ns"):
                ns = int(text) * (1_000_000 if key.endswith("_ms") else 1)
                got[key[:-3] + "_ns"] = min(ns, (1 << 63) - 1)
            elif key == "limit":
                got["limit"] = int(text)
            elif key == "cursor":
                got["cursor"] = Cursor.from_token(text)
            elif head and head in ("min_attr.", "max_attr."):
                maps[heads[head]][key[len(head) :]] = float(text)
            elif head:
                parsed: object = text
                if head == "not_attr.":
                    try:
                        parsed = json.loads(text)
                    except ValueError:
                        parsed = text
                maps[heads[head]][key[len(head) :]] = parsed
            else:
                raise ValueError(f"unknown parameter: {key}")
        if bound_tenant is not None:
            if got.get("tenant", bound_tenant) != bound_tenant:
                raise PermissionError("the credential is bound to another tenant")
            got["tenant"] = bound_tenant
        got.setdefault("limit", 100)
        return cls(**got, **maps)

    def column(self, attributes: str = "attributes") -> Column:
        tests = []
        for name in ("tenant", "service", "name", "status"):
            if (wanted := getattr(self, name)) is not None:
                tests.append(F.col(name) == wanted)
        if self.not_status:
            tests.append(~F.coalesce(F.col("status"), F.lit("")).isin(*self.not_status))
        if self.since_ns is not None:
            tests.append(F.col("start_time_ns") >= self.since_ns)
        if self.until_ns is not None:
            tests.append(F.col("start_time_ns") <= self.until_ns)
        if self.min_duration_ns is not None:
            tests.append(duration() >= self.min_duration_ns)
        if self.max_duration_ns is not None:
            tests.append(duration() <= self.max_duration_ns)
        if self.session is not None:
            tests.append(F.col("session_id") == self.session)
        tests += [loosely_equal(value(attributes, k), v) for k, v in self.attributes.items()]
        tests += [strictly_different(value(attributes, k), v) for k, v in self.not_attributes.items()]
        tests += [F.coalesce(numeric(value(attributes, k)) >= v, F.lit(False)) for k, v in self.min_attributes.items()]
        tests += [F.coalesce(numeric(value(attributes, k)) <= v, F.lit(False)) for k, v in self.max_attributes.items()]
        if self.content is not None:
            if attributes == "":
                tests.append(has_words(F.col("content"), self.content))
            else:
                # strings are taken apart only where the letters stand
                held = F.col(attributes), F.col("events")
                tests += [near_words(stored_text(*held), self.content), has_words(searchable_text(*held), self.content)]
        if self.cursor is not None:
            tests.append(self.cursor.after())
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def search(spans: DataFrame, f: SpanFilter, masked: DataFrame | None = None, attributes: str = "attributes") -> DataFrame:
    """Current spans that match, in order, cut to the limit after filtering; masked ones don't count.

    ``spans`` must hold the newest version of each span only: a filter below
    that choice would bring replaced versions back.
    """
    if f.sort and f.cursor:
        raise ValueError("a cursor is a place in the stable order, so it can't be used with a sort")
    out = spans.where(f.column(attributes))
    if masked is not None:
        from ..operators.lifecycle import unmasked

        out = unmasked(out, masked)
    order = [F.col(c).asc() for c in ORDER]
    if f.sort:
        by, up = SORTS[f.sort]
        key = F.col(by) if by else duration()
        order = [key.asc() if up else key.desc(), *order]
    elif f.limit is None:
        return out
    out = out.orderBy(*order)
    return out.limit(f.limit) if f.limit is not None else out


def next_cursor(page: list, f: SpanFilter) -> Cursor | None:
    """Where the next page begins; None unless the page is full."""
    if f.sort or f.limit is None or len(page) < f.limit or not page:
        return None
    return Cursor(*(page[-1][c] for c in ORDER))


def export(spans: DataFrame, f: SpanFilter, path: str) -> int:
    """NDJSON of all matches, in the stable order; the count of rows written."""
    out = spans.where(replace(f, sort=None, cursor=None).column()).orderBy(*ORDER)
    out = out.limit(f.limit) if f.limit is not None else out
    from pyspark.sql import Observation

    seen = Observation("export")
    out.observe(seen, F.count("*").alias("n")).write.mode("errorifexists").json(path)
    return seen.get["n"]
