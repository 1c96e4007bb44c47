"""LLM facts of a span, from the attribute conventions in use."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import LONG_MAX, double_of, long_of, scalar_text, text_of, value

# Fixed keys of the conventions, in order of precedence.
MODEL = ("gen_ai.response.model", "gen_ai.request.model", "llm.model")
PROVIDER = ("gen_ai.provider.name", "gen_ai.system")
PROMPT = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.prompt_tokens")
COMPLETION = ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.completion_tokens")
TOTAL = ("llm.usage.total_tokens", "gen_ai.usage.total_tokens", "llm.total_tokens")
COST = ("llm.cost_usd", "gen_ai.usage.cost")
CACHE_READ = ("gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens")
CACHE_CREATION = ("gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_creation_input_tokens")
SESSION = ("session.id", "gen_ai.conversation.id", "traceloop.association.properties.session_id", "traceloop.association.properties.chat_id")
OUTCOME = ("session.outcome", "traceloop.association.properties.outcome")
GOAL = ("session.goal", "traceloop.association.properties.goal")
CALL_KEYS = ("gen_ai.operation.name", "llm.request.type")
KIND = "traceloop.span.kind"
#: Providers that report cached tokens beside the prompt's, and within them.
CACHE_BESIDE = ("anthropic", "aws.bedrock", "gcp.vertex_ai")
CACHE_WITHIN = ("openai", "azure.ai.openai")


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))), F.lit(LONG_MAX))


def saturating_sum(x: Column) -> Column:
    return F.coalesce(F.try_sum(F.coalesce(x, F.lit(0).cast("long"))), F.lit(LONG_MAX))


#: Expressions in one generator: what it compiles to stays small.
_AT_ONCE = 8


def _held(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``rows`` with columns by generators of one row, which the optimizer doesn't inline."""
    names = list(made)
    for at in range(0, len(names), _AT_ONCE):
        rows = rows.select("*", F.inline(F.array(F.struct(*[made[k].alias(k) for k in names[at : at + _AT_ONCE]]))))
    return rows


def with_facts(spans: DataFrame, attributes: str = "attributes") -> DataFrame:
    """``spans`` with the facts as typed columns, so that no query reads attributes again.

    Each key is looked up once, its scalar text is made once from that, and the
    facts from both, each step held by generators.
    """
    keys = sorted({*MODEL, *PROVIDER, *PROMPT, *COMPLETION, *TOTAL, *COST, *CACHE_READ, *CACHE_CREATION, *SESSION, *OUTCOME, *GOAL, *CALL_KEYS, KIND})
    v = {k: f"__value_{i}" for i, k in enumerate(keys)}
    text = {k: f"__text_{i}" for i, k in enumerate(keys) if k not in CALL_KEYS}
    first = lambda of, names: F.coalesce(*[of(F.col(v[k]), F.col(text[k])) for k in names])
    key = None
    for k in SESSION:
        key = (F if key is None else key).when(first(text_of, [k]).isNotNull(), k)
    called = functools.reduce(lambda x, y: x | y, [F.col(v[k]).isNotNull() for k in CALL_KEYS]) | F.coalesce(F.col(text[KIND]) == "llm", F.lit(False))
    facts = {
        "model": first(text_of, MODEL), "provider": first(text_of, PROVIDER), "session_id": first(text_of, SESSION), "session_key": key, "prompt_tokens": first(long_of, PROMPT), "completion_tokens": first(long_of, COMPLETION),
        "explicit_total": first(long_of, TOTAL), "cost_metered": first(double_of, COST), "cache_read": first(long_of, CACHE_READ), "cache_creation": first(long_of, CACHE_CREATION), "is_llm": called,
        "declared_outcome": first(text_of, OUTCOME), "goal": first(text_of, GOAL),
    }
    out = _held(spans, {v[k]: value(attributes, k) for k in keys})
    out = _held(out, {text[k]: scalar_text(F.col(v[k])) for k in text})
    names = list(facts)
    for at in range(0, len(names), 2):
        out = _held(out, {k: facts[k] for k in names[at : at + 2]})
    shows = [F.col(c).isNotNull() for c in ("model", "provider", "prompt_tokens", "completion_tokens", "explicit_total")]
    return out.drop(*v.values(), *text.values()).withColumn("is_llm", functools.reduce(lambda x, y: x | y, shows, F.col("is_llm")))


def total_tokens() -> Column:
    """The stated total, else prompt and completion."""
    return F.coalesce(F.col("explicit_total"), saturating_add(F.col("prompt_tokens"), F.col("completion_tokens")))


def duration() -> Column:
    return F.greatest(F.col("end_time_ns") - F.col("start_time_ns"), F.lit(0))


def is_error() -> Column:
    """Exact, as counters take it."""
    return F.coalesce(F.col("status") == "error", F.lit(False))


def context_tokens() -> Column:
    """Size of the context a call was given; NULL where the provider's counting of cached tokens is unknown."""
    prompt, read, made = F.col("prompt_tokens"), F.col("cache_read"), F.col("cache_creation")
    plain = read.isNull() & made.isNull()
    return F.when(plain | F.col("provider").isin(*CACHE_WITHIN), prompt).when(F.col("provider").isin(*CACHE_BESIDE) & prompt.isNotNull(), saturating_add(saturating_add(prompt, read), made))


def context_is_ambiguous() -> Column:
    known = F.coalesce(F.col("provider").isin(*CACHE_BESIDE, *CACHE_WITHIN), F.lit(False))
    return (F.col("cache_read").isNotNull() | F.col("cache_creation").isNotNull()) & ~known
