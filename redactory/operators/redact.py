"""Detection and redaction of text columns.

``Redactor`` compiles a policy once on the driver. Its columns are Arrow UDFs: one pass over a batch of texts runs all
active rules, groups overlapping spans and renders, without a shuffle, so wide policies cost one scan. The long form
(one row a detection) is a projection and an explode of the same column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions import names
from redactory.functions.render import Restoration, Segment, restore, segments, stitched
from redactory.functions.scan import ContractError, Match, utf16
from redactory.plans.errors import RedactionError
from redactory.plans.policy import Policy, Resolved, Semantic, describe

MATCH = "struct<start:int,end:int,rule_id:string,entity_type:string,reasons:array<string>,value:string>"
MATCHED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule_id", pa.string()), ("entity_type", pa.string()), ("reasons", pa.list_(pa.string())), ("value", pa.string())])
INSPECTION = f"array<struct<start:int,end:int,replacement:string,matches:array<{MATCH}>>>"
RESTORED = "struct<text:string,map:map<string,string>>"
CONFIRMED = f"struct<text:string,detections:array<{MATCH[:-1]},confirmed:boolean,score:double>>,map:map<string,string>,warnings:array<string>>"


def scan(policy: Resolved, text: str) -> list[Match]:
    """Detections of a text within the policy's limit."""
    if policy.max_input is not None and utf16(text, len(text)) > policy.max_input:
        raise RedactionError("INPUT_LIMIT")
    try:
        return policy.scanner(text)
    except ContractError as x:
        raise RedactionError("DETECTOR_CONTRACT") from x


def prepare(policy: Resolved, texts: Iterable[str | None]) -> None:
    """Asks a policy's recogniser about a whole batch at once."""
    if policy.recogniser is not None:
        names.BATCH.ask(policy.recogniser, texts)
    else:
        names.BATCH.spans = {}


def render(policy: Resolved, text: str, found: list[Match], restoration: Restoration | None = None) -> list[Segment]:
    return segments(text, found, policy.settings, restoration, policy.detect_only)


def redact_text(policy: Resolved, text: str, restoration: Restoration | None = None, seen: int = 0) -> str:
    """The text redacted; its first ``seen`` code points are this policy's output already, and a match must reach beyond them."""
    if policy.restore and restoration is None:
        restoration = Restoration()
    return stitched(text, render(policy, text, [m for m in scan(policy, text) if m.end > seen], restoration))


def _match(text: str, m: Match) -> dict:
    return {"start": m.start, "end": m.end, "rule_id": m.rule_id, "entity_type": m.entity_type, "reasons": list(m.reasons), "value": text[m.start : m.end]}


class Redactor:
    """redact, inspect, detections, restore: columns and frames of one policy. Null texts stay null."""

    def __init__(self, policy: Policy | dict):
        self.given = policy if isinstance(policy, Policy) else Policy.of(policy)
        self.policy = self.given.resolve()

    def describe(self) -> list[dict]:
        return describe(self.policy.specs)

    def redact(self, text: Column, seen: Column | None = None) -> Column:
        """The redacted text; with restoration a struct of text and map.

        ``seen`` is for texts that are redacted again: how many of the first code points this policy has redacted before
        (null: none). What it left there it judged beside the values themselves; beside their placeholders a number that
        ran on into one would pass for a whole one. So only what reaches beyond is redacted.
        """
        policy = self.policy
        if policy.restore and seen is not None:
            raise RedactionError("INVALID_CONFIG", "seen")  # placeholders would be numbered from 1 again; sessions go on with a map
        if policy.restore:

            def both(text: str) -> tuple[str, list]:
                kept = Restoration()
                return redact_text(policy, text, kept), list(kept.map.items())

            @F.arrow_udf(RESTORED)
            def restorable(column: pa.Array) -> pa.Array:
                texts = column.to_pylist()
                prepare(policy, texts)
                found = [both(t) if t is not None else (None, None) for t in texts]
                return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([m for _, m in found], pa.map_(pa.string(), pa.string()))], ["text", "map"])

            return restorable(text)

        @F.arrow_udf("string")
        def plain(column: pa.Array) -> pa.Array:
            texts = column.to_pylist()
            prepare(policy, texts)
            return pa.array([None if t is None else redact_text(policy, t) for t in texts], pa.string())

        @F.arrow_udf("string")
        def further(column: pa.Array, before: pa.Array) -> pa.Array:
            texts = column.to_pylist()
            prepare(policy, texts)
            return pa.array([None if t is None else redact_text(policy, t, seen=n or 0) for t, n in zip(texts, before.to_pylist(), strict=True)], pa.string())

        return plain(text) if seen is None else further(text, seen)

    def inspect(self, text: Column) -> Column:
        """Groups with their replacements and matches; values are the original ones."""
        policy = self.policy

        @F.arrow_udf(INSPECTION)
        def groups(column: pa.Array) -> pa.Array:
            texts, out = column.to_pylist(), []
            prepare(policy, texts)
            for t in texts:
                found = [] if t is None else render(policy, t, scan(policy, t), Restoration() if policy.restore else None)
                out.append([{"start": s.start, "end": s.end, "replacement": s.replacement, "matches": [_match(t, m) for m in s.matches]} for s in found])
            return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string()), ("matches", pa.list_(MATCHED))])))

        return groups(text)

    def detect(self, text: Column) -> Column:
        policy = self.policy

        @F.arrow_udf(f"array<{MATCH}>")
        def matches(column: pa.Array) -> pa.Array:
            texts = column.to_pylist()
            prepare(policy, texts)
            return pa.array([[] if t is None else [_match(t, m) for m in scan(policy, t)] for t in texts], pa.list_(MATCHED))

        return matches(text)

    def detections(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """One row a detection: the key, span, rule, entity, reasons and value."""
        return df.select(key, F.explode(self.detect(F.col(text))).alias("d")).select(key, "d.*")

    def redact_confirmed(self, text: Column) -> Column:
        """Redaction after confirmation of candidates by the policy's scorer, one call a batch; where a scorer fails all candidates of its batch are kept, with a warning."""
        policy, semantic = self.policy, self.given.semantic
        custom = {d.id: d for d in self.given.detectors if d.confirm}

        @F.pandas_udf(CONFIRMED)
        def confirmed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                prepare(policy, texts)
                rows = _confirmed(policy, semantic, custom, list(texts))
                yield pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in ("text", "detections", "map", "warnings")})

        return confirmed(text)


def question(custom: dict, m: Match, value: str, before: str, after: str) -> dict | None:
    """What to ask about a match, or None if it needs no confirmation."""
    if m.rule_id == "person_name_lite":
        return {"task": "Does the candidate name a particular person?", "candidate": value, "before": before, "after": after}
    return custom[m.rule_id].confirm(value, before, after) if m.rule_id in custom else None


def _confirmed(policy: Resolved, semantic: Semantic | None, custom: dict, texts: list[str | None]) -> list[dict]:
    """Texts of a batch redacted; the questions of all of them go to the scorer in one call."""
    found = [[] if t is None else scan(policy, t) for t in texts]
    asked: list[tuple[int, int, dict]] = []
    width = semantic.context_window if semantic else 0
    for i, (t, matches) in enumerate(zip(texts, found, strict=True)):
        for k, m in enumerate(matches if semantic else []):
            q = question(custom, m, t[m.start : m.end], t[max(0, m.start - width) : m.start], t[m.end : m.end + width])
            if q is not None:
                asked.append((i, k, {"rule_id": m.rule_id, **q}))
    answers: dict[tuple[int, int], tuple[float, bool]] = {}
    warning = None
    if asked:
        try:
            scores = list(semantic.scorer([q for _, _, q in asked]))
            for (i, k, q), score in zip(asked, [*scores, *[None] * len(asked)], strict=False):
                limit = semantic.thresholds.get(q["rule_id"], semantic.thresholds.get("default", 0.5))
                answers[i, k] = 1.0 if score is None else float(score), (1.0 if score is None else float(score)) >= limit
        except Exception as x:  # whatever a scorer raises, nothing found is let through
            warning, answers = f"semantic confirmation failed: {type(x).__name__}", {}
    touched = {i for i, _, _ in asked}
    out = []
    for i, (t, matches) in enumerate(zip(texts, found, strict=True)):
        if t is None:
            out.append({"text": None, "detections": [], "map": None, "warnings": []})
            continue
        kept = [m for k, m in enumerate(matches) if answers.get((i, k), (1.0, True))[1]]
        restoration = Restoration() if policy.restore else None
        done = stitched(t, render(policy, t, kept, restoration))
        told = [_match(t, m) | {"confirmed": answers[i, k][1] if (i, k) in answers else None, "score": answers[i, k][0] if (i, k) in answers else None} for k, m in enumerate(matches)]
        out.append({"text": done, "detections": told, "map": restoration.map if restoration else None, "warnings": [warning] if warning and i in touched else []})
    return out


def restored(text: Column, given: Column) -> Column:
    """Texts with numbered placeholders put back from a map column, in built-in functions only.

    The text is cut at placeholders; the pieces between and what the map has for each placeholder are joined in turn.
    """
    pattern = F.lit(r"\[[A-Z][A-Z0-9_]*_[0-9]+\]")
    gaps, names = F.split(text, r"\[[A-Z][A-Z0-9_]*_[0-9]+\]", -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.transform(names, lambda n: F.coalesce(F.try_element_at(given, n), n))
    pieces = F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.when(text.contains("["), F.array_join(pieces, "")).otherwise(text)


def restored_text(text: str, given: dict[str, str]) -> str:
    return restore(text, given)


def detectors_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(describe(), "id string, kind string, entity_type string, replacement string, context_required boolean, before int, after int, max_match int")
