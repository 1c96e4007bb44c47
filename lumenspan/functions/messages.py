"""Chat messages of LLM spans, from whichever convention a producer used."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_INDEXED = re.compile(r"^gen_ai\.(prompt|completion)\.(\d+)\.(role|content)$")
_MEDIA = {"image", "image_url", "input_image", "audio", "input_audio", "video", "file", "input_file", "media", "blob", "uri"}


def _plain(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def part_of(part: object) -> tuple[str, str]:
    """(kind, text) of a part: text, media, tool_call, tool_result or payload."""
    if not isinstance(part, dict):
        return "text", "" if part is None else _plain(part)
    for held in (part, part.get("content")):
        if isinstance(held, dict) and isinstance(held.get("$payload"), str):
            return "payload", held["$payload"]
    kind = str(part.get("type") or "").lower()
    if kind == "tool_call":
        return "tool_call", f"{part.get('name') or ''}({_plain(part.get('arguments', part.get('args', {})))})"
    if kind in ("tool_call_response", "tool_result"):
        return "tool_result", _plain(next((part[k] for k in ("result", "response", "content") if part.get(k) is not None), ""))
    if kind in _MEDIA:
        return "media", str(part.get("mime_type") or part.get("media_type") or part.get("filename") or kind)
    for k in ("content", "text"):
        if isinstance(part.get(k), str):
            return "text", part[k]
    return "text", _plain(part)


def message_of(m: object) -> tuple[str | None, list[tuple[str, str]]]:
    if not isinstance(m, dict) or "$payload" in m:
        return None, [part_of(m)]
    role = m["role"] if isinstance(m.get("role"), str) else None
    for k in ("parts", "content"):
        if isinstance(m.get(k), list):
            return role, [part_of(p) for p in m[k]]
    return role, [part_of({"content": m["content"]} if m.get("content") is not None else m)]


def messages_of(attributes: dict[str, str], events: list[dict]) -> list[tuple[str, str | None, str, str]]:
    """(direction, role, kind, text) in order: message lists first, else indexed keys and native events."""
    got = {k: json.loads(v) for k, v in attributes.items() if k.startswith("gen_ai.")}
    out: list[tuple[str, str | None, str, str]] = []
    lists = {"prompt": got.get("gen_ai.input.messages"), "completion": got.get("gen_ai.output.messages")}
    if any(v is not None for v in lists.values()):
        for direction, value in lists.items():
            if isinstance(value, str):
                try:
                    value = json.loads(value)
                except ValueError:
                    pass
            for m in [] if value is None else value if isinstance(value, list) else [value]:
                role, parts = message_of(m)
                out += [(direction, role, *p) for p in parts]
        return out
    for direction in ("prompt", "completion"):
        turns: dict[int, dict] = {}
        for k, v in got.items():
            if (m := _INDEXED.match(k)) and m[1] == direction:
                turns.setdefault(int(m[2]), {})[m[3]] = v
        out += [(direction, t.get("role"), *part_of({"content": t.get("content")} if t.get("content") is not None else "")) for _, t in sorted(turns.items())]
    for e in events or []:
        if e["name"] in ("llm.prompt", "llm.completion"):
            said = {k: json.loads(v) for k, v in (e["attributes"] or {}).items()}
            out.append((e["name"][4:], said.get("role"), *part_of({"content": said["content"]} if said.get("content") is not None else "")))
    return out


def messages(spans: DataFrame) -> DataFrame:
    """(tenant, trace_id, span_id, position, direction, role, kind, text): a row per part of each message."""
    names = ["tenant", "trace_id", "span_id", "position", "direction", "role", "kind", "text"]
    kinds = [pa.int64() if n == "position" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                found = messages_of(dict(r["attributes"] or ()), [e | {"attributes": dict(e["attributes"] or ())} for e in r["events"] or ()])
                rows += [(r["tenant"], r["trace_id"], r["span_id"], i, *m) for i, m in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spans.select("tenant", "trace_id", "span_id", "attributes", "events").mapInArrow(run, ", ".join(f"{n} {'long' if n == 'position' else 'string'}" for n in names))
