"""Costs: metered where the producer gave one, else derived from a price table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pricing:
    """USD per million tokens, (input, output), by model; a name that ends in ``*`` is a prefix."""

    rates: dict[str, tuple[float, float]]

    @classmethod
    def from_json(cls, models: dict[str, dict[str, float]]) -> Pricing:
        return cls({m: (float(r["input_per_mtok"]), float(r["output_per_mtok"])) for m, r in models.items()})

    def __post_init__(self) -> None:
        for model, rates in self.rates.items():
            if not all(math.isfinite(r) and r >= 0 for r in rates):
                raise ValueError(f"rates of {model} must be finite and not negative")

    def rate(self, model: Column, which: int) -> Column:
        """The rate of an exact name, else of the longest prefix; a constant CASE, so no join is needed."""
        exact = sorted(m for m in self.rates if not m.endswith("*"))
        prefixes = sorted((m[:-1] for m in self.rates if m.endswith("*")), key=lambda p: (-len(p), p))
        out = None
        for test, name in [*((model == m, m) for m in exact), *((model.startswith(p), p + "*") for p in prefixes)]:
            out = (F if out is None else out).when(test, F.lit(self.rates[name][which]))
        return out if out is not None else F.lit(None).cast("double")

    def derived(self) -> Column:
        """NULL without a rate or without both counts."""
        m = F.col("model")
        cost = (F.col("prompt_tokens") * self.rate(m, 0) + F.col("completion_tokens") * self.rate(m, 1)) / 1e6
        return F.when(F.abs(cost) < float("inf"), cost)


def with_cost(spans: DataFrame, pricing: Pricing | None = None) -> DataFrame:
    """``spans`` with ``cost_usd`` and ``cost_source``: metered, derived, or NULL; a metered cost is never replaced."""
    metered = F.col("cost_metered")
    derived = pricing.derived() if pricing else F.lit(None).cast("double")
    derived = F.when(metered.isNull(), derived)
    return spans.withColumns({"cost_usd": F.coalesce(metered, derived), "cost_source": F.when(metered.isNotNull(), "metered").when(derived.isNotNull(), "derived")})
