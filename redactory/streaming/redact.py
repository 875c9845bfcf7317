"""Redaction of chunked text: chunks of a stream arrive in order of ``seq``; matches cut between chunks are still found.

``Flow`` is the pure state of one stream: a buffer, how much of it is final, and the counters of restoration. Text is
emitted up to a point behind which no detection can still change: the buffer's end less the longest match and the
widest context of the active rules, moved back to the start of any group across it. The batch operator and Structured
Streaming (transformWithStateInPandas, keyed by stream) run the same code.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from redactory.functions.render import Restoration, StreamRestorer, grouped
from redactory.functions.scan import aligned, utf16
from redactory.operators.redact import Redactor, render
from redactory.plans.errors import RedactionError
from redactory.plans.policy import Resolved

BUFFER_LIMIT = 65_536
#: Characters that become final at a time in batches, where nobody waits for the first.
STEP = 4_096
EVENTS = "stream_id string, pos long, event_type string, text string, group string, map string"


@dataclass
class Flow:
    """State between chunks: unfinished text, where it begins in the stream, and how far it has been emitted."""

    buffer: str = ""
    base: int = 0
    cursor: int = 0
    restoration: dict = field(default_factory=dict)


def margins(policy: Resolved) -> tuple[int, int]:
    """How much text must follow a point to make it final, and how much before it stays as context."""
    if any(d.max_match is None for d in policy.specs):
        raise RedactionError("STREAM_UNSUPPORTED")
    return max(d.max_match + max(d.left, d.right) + 1 for d in policy.specs), max(max(d.left, 1) for d in policy.specs)


def advance(policy: Resolved, flow: Flow, chunk: str, last: bool, report: bool = False, step: int = 1) -> list[dict]:
    """Takes a chunk in and gives the events it allows: text, detection (with its group), and at the end complete.

    Nothing is looked at before ``step`` more characters are final: small chunks need not each scan what is held back.
    """
    ahead, behind = margins(policy)
    flow.buffer += chunk
    text = flow.buffer
    if not last and len(text) - ahead < flow.cursor and 2 * len(text) > BUFFER_LIMIT and utf16(text, len(text)) - flow.cursor > BUFFER_LIMIT:
        raise RedactionError("BUFFER_LIMIT")
    upto = len(text) if last else max(flow.cursor, len(text) - ahead)
    if not last and upto - flow.cursor < step:
        return []
    while not last and upto > flow.cursor and not aligned(text, upto):
        upto -= 1
    events: list[dict] = []
    if upto > flow.cursor or last:
        state = Restoration(**flow.restoration) if flow.restoration else Restoration()
        found = [m for m in policy.scanner(text) if m.start >= flow.cursor]
        for g in grouped(found):
            if g.start < upto < g.end:
                upto = g.start
        done = [m for m in found if m.end <= upto]
        at = flow.cursor
        parts: list[tuple[str, str]] = []
        for s in render(policy, text, done, state if policy.restore else None):
            parts.append(("text", text[at : s.start]))
            if report:
                group = {"start": flow.base + s.start, "end": flow.base + s.end, "replacement": s.replacement, "matches": [{"start": flow.base + m.start, "end": flow.base + m.end, "rule_id": m.rule_id} for m in s.matches]}
                parts.append(("detection", json.dumps(group)))
                if policy.detect_only:
                    parts.append(("text", s.replacement))
            else:
                parts.append(("text", s.replacement))
            at = s.end
        parts.append(("text", text[at:upto]))
        merged: list[str] = []
        pos = flow.base + flow.cursor
        for kind, value in parts:
            if kind == "text":
                merged.append(value)
                continue
            if said := "".join(merged):
                events.append({"event_type": "text", "pos": pos, "text": said})
            merged = []
            group = json.loads(value)
            pos = group["end"]
            events.append({"event_type": "detection", "pos": group["start"], "text": group["replacement"], "group": value})
        if said := "".join(merged):
            events.append({"event_type": "text", "pos": pos, "text": said})
        flow.restoration = asdict(state) if policy.restore else {}
        flow.cursor = upto
        cut = max(0, flow.cursor - behind)
        flow.buffer, flow.base, flow.cursor = text[cut:], flow.base + cut, flow.cursor - cut
    if last:
        events.append({"event_type": "complete", "pos": flow.base + flow.cursor, "text": "", "map": json.dumps(flow.restoration.get("map", {})) if policy.restore else None})
    return events


def policy_of(redactor: Redactor, restore: bool | None = None) -> Resolved:
    """The policy that a stream works by: ``restore`` says otherwise than the redactor's for this stream; scorers are not asked."""
    if redactor.given.semantic is not None:
        warnings.warn("scorers confirm whole texts only: what this stream finds is not confirmed", stacklevel=3)
    policy = redactor.policy
    if restore is not None and restore != policy.restore:
        if restore and policy.detect_only:
            raise RedactionError("INVALID_CONFIG", "restore")
        policy = replace(policy, restore=restore)
    margins(policy)
    return policy


def events_of(chunks: Iterable[str], redactor: Redactor, report: bool = False, restore: bool | None = None, cancelled: Callable[[], bool] = lambda: False) -> Iterator[dict]:
    """The events of one stream in this process. It ends with CANCELLED once ``cancelled`` says so, and with SOURCE_FAILURE where its source fails."""
    policy, flow, source = policy_of(redactor, restore), Flow(), iter(chunks)
    while True:
        try:
            chunk = next(source, None)
        except RedactionError:
            raise
        except Exception as x:
            raise RedactionError("SOURCE_FAILURE") from x
        if cancelled():
            raise RedactionError("CANCELLED")
        yield from advance(policy, flow, chunk or "", chunk is None, report)
        if chunk is None:
            return


def redact_chunks(chunks: DataFrame, redactor: Redactor, report: bool = False, restore: bool | None = None) -> DataFrame:
    """Batch form: (stream_id, seq, chunk) to events; a stream's last chunk by seq ends it."""
    policy = policy_of(redactor, restore)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flow, held = None, Flow(), None

        def events(last: bool) -> list[dict]:
            return [{"stream_id": now, **e} for e in advance(policy, flow, held or "", last, report, STEP)] if held is not None else []

        names = [x.split()[0] for x in EVENTS.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 4]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([e.get(n) for e in out], t) for n, t in zip(names, types, strict=True)], names)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    out += events(row["stream_id"] != now)
                if row["stream_id"] != now:
                    now, flow = row["stream_id"], Flow()
                held = row["chunk"] or ""
            yield pack(out)
        yield pack(events(True))

    rows = chunks.select(F.col("stream_id").cast("string"), "seq", "chunk").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return rows.mapInArrow(run, EVENTS)


class RedactProcessor(StatefulProcessor):
    """Keyed state of Structured Streaming: one Flow a stream, as JSON."""

    def __init__(self, policy: Resolved, report: bool = False):
        self.policy, self.report = policy, report

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("flow", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flow = Flow(**json.loads(self.state.get()[0])) if self.state.exists() else Flow()
        frame = pd.concat(list(rows)).sort_values("seq")
        out, ended = [], False
        for chunk, last in zip(frame["chunk"], frame["is_last"], strict=True):
            out += advance(self.policy, flow, chunk or "", bool(last), self.report)
            ended = ended or bool(last)
        if ended:
            self.state.clear()
        else:
            self.state.update((json.dumps(asdict(flow)),))
        names = [x.split()[0] for x in EVENTS.split(", ")]
        made = [{"stream_id": key[0], **e} for e in out]
        yield pd.DataFrame({n: pd.Series([e.get(n) for e in made], dtype="int64" if n == "pos" else object) for n in names})

    def close(self) -> None:
        pass


def redact_stream(chunks: DataFrame, redactor: Redactor, report: bool = False, restore: bool | None = None) -> DataFrame:
    """Streaming form: (stream_id, seq, chunk, is_last) to events; within a micro-batch chunks go by seq."""
    policy = policy_of(redactor, restore)
    # The state store's provider for transformWithState must be RocksDB.
    return chunks.groupBy("stream_id").transformWithStateInPandas(RedactProcessor(policy, report), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def joined(events: DataFrame) -> DataFrame:
    """(stream_id, text): a stream's output put together from its events, in order of position."""
    kept = events.where("event_type <> 'complete'").select("stream_id", F.struct("pos", "event_type", "text").alias("e"))
    return kept.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "").alias("text"))


def restore_chunks(chunks: DataFrame, maps: DataFrame) -> DataFrame:
    """(stream_id, seq, text): chunks of redacted text restored by (stream_id, map), placeholders cut between chunks included."""
    rows = chunks.join(maps.select("stream_id", F.to_json("map").alias("given")), "stream_id", "left").repartition("stream_id").sortWithinPartitions("stream_id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, restorer, seq = None, None, 0
        names, types = ["stream_id", "seq", "text"], [pa.string(), pa.int64(), pa.string()]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["stream_id"] != now:
                    if restorer is not None and (rest := restorer.flush()):
                        out.append((now, seq + 1, rest))
                    now, restorer = row["stream_id"], StreamRestorer(json.loads(row["given"] or "{}"))
                seq = row["seq"]
                out.append((now, seq, restorer.push(row["chunk"] or "")))
            yield pack(out)
        if restorer is not None and (rest := restorer.flush()):
            yield pack([(now, seq + 1, rest)])

    return rows.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", "given").mapInArrow(run, "stream_id string, seq long, text string")
