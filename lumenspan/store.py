"""One object for a store's tables, with a method for each question; all return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .functions.pricing import Pricing, with_cost
from .functions.semconv import with_facts
from .operators import aggregates, diagnosis, evals, insights, lifecycle, trees
from .operators.current import current, trace
from .plans.filters import SpanFilter, search
from .sources import payloads


@dataclass(frozen=True)
class TraceStore:
    """``versions`` is every span as it was written, with ``ingest_seq``; the other tables are optional."""

    versions: DataFrame
    pricing: Pricing | None = None
    annotations: DataFrame | None = None
    payload_table: DataFrame | None = None
    subjects: DataFrame | None = None
    tenant: str | None = None

    @property
    def spans(self) -> DataFrame:
        """Current spans with facts and costs, without what an erasure masks or another tenant owns."""
        now = current(self.versions)
        now = now if self.tenant is None else now.where(now["tenant"] == self.tenant)
        now = now if "is_llm" in now.columns else with_facts(now)
        now = now if "cost_usd" in now.columns else with_cost(now, self.pricing)
        return now if self.subjects is None else lifecycle.unmasked(now, self.subjects)

    def for_tenant(self, tenant: str) -> TraceStore:
        return replace(self, tenant=tenant)

    def as_of(self, seq: int) -> TraceStore:
        """The store as it was when ``seq`` had been written."""
        return replace(self, versions=self.versions.where(self.versions["ingest_seq"] <= seq))

    def search_spans(self, f: SpanFilter) -> DataFrame:
        return search(self.spans, f)

    def get_trace(self, trace_id: str) -> DataFrame:
        return trace(self.spans, trace_id)

    def get_trace_with_annotations(self, trace_id: str) -> DataFrame:
        notes = self.annotations.where(self.annotations["trace_id"] == trace_id).drop("session_id")
        return self.get_trace(trace_id).join(notes, ["tenant", "trace_id", "span_id"], "left")

    def list_sessions(self, by: str = "recent", limit: int = 50) -> DataFrame:
        return aggregates.ranked_sessions(aggregates.sessions(self.spans), by, limit)

    def get_session(self, session_id: str) -> DataFrame:
        return aggregates.session_traces(self.spans, session_id).orderBy("first_start_ns")

    def diagnose_session(self, session_id: str, now_ns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(outcome, cause, findings)."""
        spans = self.spans
        spans = spans.where(spans["session_id"] == session_id)
        findings = diagnosis.repetitions(spans)
        return diagnosis.session_outcomes(spans, now_ns), diagnosis.causes(spans, findings), diagnosis.ranked_findings(findings)

    def top_failures(self, limit: int = 100) -> DataFrame:
        return insights.ranked_failures(insights.failures(self.spans), limit)

    def slowest_spans(self, limit: int = 100) -> DataFrame:
        return insights.slowest(self.spans, limit)

    def analyze_cost(self, by: str = "model", since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
        return aggregates.ranked_llm(aggregates.llm_by(aggregates.windowed(self.spans, since_ns, until_ns), by))

    def describe(self) -> DataFrame:
        return aggregates.dims(self.spans, "service", "model", "provider", "session_key")

    def get_payload(self, ref: str) -> DataFrame:
        return payloads.fetch(self.payload_table, ref, payloads.refs(self.spans), self.tenant)

    def promote_failures(self, limit: int = 50) -> DataFrame:
        spans = self.spans
        findings = diagnosis.repetitions(spans)
        return diagnosis.promoted(diagnosis.causes(spans, findings), findings, limit)

    def waterfall(self, trace_id: str) -> DataFrame:
        return trees.trace_trees(self.get_trace(trace_id)).orderBy("position")

    def experiment_summary(self, experiment_id: int) -> DataFrame:
        return evals.score_summary(self.annotations.where(self.annotations["experiment_id"] == experiment_id))
