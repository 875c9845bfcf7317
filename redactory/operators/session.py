"""Restorable redaction across the turns of a conversation: a value keeps its placeholder from its first turn on.

A conversation's turns are streamed in order through one task by a shuffle and sort on its key, so state is one
conversation's map. Values are known by their text alone: the entity that saw a value first names it ever after.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.functions.render import Restoration, StreamRestorer, restore
from redactory.plans.errors import VaultError
from redactory.plans.policy import Resolved

from . import vault
from .redact import Redactor, redact_text, restored
from .structured import walk

OUT = "conv_id long, turn long, role string, redacted string, map map<string,string>"


def redact_turns(turns: DataFrame, redactor: Redactor, given: DataFrame | None = None, by_value: bool = True) -> DataFrame:
    """conv_id, turn, role, redacted text and the map that this turn's placeholders need (those seen so far that it holds).

    ``given`` (conv_id, map) hydrates conversations with placeholders of an earlier session. ``by_value=False`` numbers
    every occurrence anew, as a client without a session does.
    """
    policy = redactor.policy
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.join(given.select("conv_id", F.to_json("map").alias("prior")), "conv_id", "left") if given is not None else rows.withColumn("prior", F.lit(None).cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_stream(policy, by_value), OUT)


def _stream(policy: Resolved, by_value: bool):
    import json

    from redactory.functions.scan import NUMBERED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), Restoration(by_value)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, state = row["conv_id"], Restoration(by_value)
                    if row["prior"]:
                        state.hydrate(json.loads(row["prior"]))
                text = None if row["text"] is None else redact_text(policy, row["text"], state)
                used = [(p, state.map[p]) for p in dict.fromkeys(NUMBERED.findall(text or "")) if p in state.map]
                out.append((row["conv_id"], row["turn"], row["role"], text, used))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "redacted", "map"])

    return run


def conversation_maps(redacted: DataFrame) -> DataFrame:
    """(conv_id, map): all placeholders of each conversation, to hydrate a later session with."""
    pairs = redacted.select("conv_id", F.explode("map").alias("placeholder", "original")).distinct()
    return pairs.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("map"))


class Shared:
    """One numbering over all texts it is given, in one process: what adapters of clients work by.

    With ``by_value`` equal values keep one placeholder, as in a session; ``given`` are placeholders of an earlier one.
    """

    def __init__(self, redactor: Redactor, by_value: bool = False, given: dict[str, str] | None = None):
        self.policy, self.by_value, self.given = redactor.policy, by_value, dict(given or {})
        self.reset()

    def reset(self) -> None:
        self.state = Restoration(self.by_value).hydrate(self.given)

    @property
    def map(self) -> dict[str, str]:
        return dict(self.state.map)

    def redact(self, text: str) -> str:
        return redact_text(self.policy, text, self.state)

    def redact_value(self, value: object) -> object:
        return walk(value, self.redact)

    def restore(self, text: str) -> str:
        return restore(text, self.state.map)

    def stream(self) -> StreamRestorer:
        return StreamRestorer(self.map)


def redact_turns_sealed(turns: DataFrame, redactor: Redactor, provider: vault.Provider, given: DataFrame | None = None) -> DataFrame:
    """redact_turns whose maps leave as sealed blobs: conv_id, turn, role, redacted, sealed. ``given`` (conv_id, sealed) hydrates conversations."""
    if redactor.policy.detect_only:
        raise VaultError("VAULT_ENCRYPT_FAILED")
    prior = vault.open_sealed(given, provider) if given is not None else None
    return vault.seal(redact_turns(turns, redactor, prior), provider)


def sealed_conversations(sealed: DataFrame, provider: vault.Provider) -> DataFrame:
    """(conv_id, sealed): the whole map of each conversation, sealed anew, to hydrate a later session with."""
    return vault.seal(conversation_maps(vault.open_sealed(sealed, provider)), provider)


def restore_turns_sealed(sealed: DataFrame, provider: vault.Provider, text: str = "redacted") -> DataFrame:
    """The rows with their texts restored by their sealed maps, which go."""
    opened = vault.open_sealed(sealed, provider)
    return opened.withColumn(text, restored(F.col(text), F.coalesce("map", F.create_map().cast("map<string,string>")))).drop("map")
