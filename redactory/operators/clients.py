"""Adapters of chat clients: requests go out redacted, responses come back restored, whole or streamed.

They wrap any callable that takes a request's fields and gives a response of plain dictionaries and lists, so they run
where the client runs: on the driver, or inside mapInPandas on executors. Columns of requests and responses go by
``structured.redact_messages`` and ``restore_responses`` instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.render import StreamRestorer, restore

from .redact import Redactor
from .session import Shared
from .structured import walk

Create = Callable[..., object]


def _shared(given: Redactor | Shared) -> tuple[Shared, bool]:
    return (given, False) if isinstance(given, Shared) else (Shared(given), given.policy.detect_only)


def _wrapped(create: Create, given: Redactor | Shared, fields: tuple[str, ...], streamed: Callable) -> Create:
    if getattr(create, "redacts", False):
        return create
    shared, as_is = _shared(given)

    def call(**request: object) -> object:
        if as_is:
            return create(**request)
        response = create(**request | {k: shared.redact_value(request[k]) for k in fields if request.get(k)})
        if request.get("stream"):
            return streamed(response, shared.map)
        return walk(response, shared.restore)

    call.redacts = True
    return call


def chat_completions(create: Create, given: Redactor | Shared) -> Create:
    """For requests with messages and responses with choices; a Shared redactor makes it one session."""
    return _wrapped(create, given, ("messages",), choices_restored)


def block_messages(create: Create, given: Redactor | Shared) -> Create:
    """For requests with system and messages and responses in content blocks."""
    return _wrapped(create, given, ("system", "messages"), blocks_restored)


def choices_restored(chunks: Iterable[dict], given: dict[str, str]) -> Iterator[dict]:
    """Streamed choices: text and the arguments of tool calls pass through one restorer, in the order they come."""
    restorer = StreamRestorer(given)

    def call(c: dict) -> dict:
        told = c.get("function") or {}
        return c | {"function": told | {"arguments": restorer.push(told["arguments"])}} if isinstance(told.get("arguments"), str) else c

    def choice(c: dict) -> dict:
        if not c.get("delta"):
            return c
        delta = dict(c["delta"])
        if isinstance(delta.get("content"), str):
            delta["content"] = restorer.push(delta["content"])
        if isinstance(delta.get("tool_calls"), list):
            delta["tool_calls"] = [call(x) for x in delta["tool_calls"]]
        return c | {"delta": delta}

    for chunk in chunks:
        yield chunk | {"choices": [choice(c) for c in chunk.get("choices") or []]}
    if rest := restorer.flush():
        yield {"choices": [{"delta": {"content": rest}, "finish_reason": None, "index": 0}]}


def blocks_restored(events: Iterable[dict], given: dict[str, str]) -> Iterator[dict]:
    """Streamed content blocks: each has a restorer of its own, emptied before the block stops."""
    restorers: dict[int, StreamRestorer] = {}
    for event in events:
        index, delta = event.get("index"), event.get("delta") or {}
        key = {"text_delta": "text", "partial_json": "partial_json"}.get(delta.get("type"))
        if event.get("type") == "content_block_delta" and key:
            restorer = restorers.setdefault(index, StreamRestorer(given))
            yield event | {"delta": delta | {key: restorer.push(delta[key])}}
            continue
        if event.get("type") == "content_block_stop" and index in restorers and (rest := restorers[index].flush()):
            yield {"type": "content_block_delta", "index": index, "delta": {"type": "text_delta", "text": rest}}
        yield event


def redact_prompt(text: str, redactor: Redactor) -> tuple[str, dict[str, str]]:
    """A prompt and the map that restores it."""
    shared = Shared(redactor)
    return shared.redact(text), shared.map


def restore_responses(response: Column, given: Column) -> Column:
    """A column of JSON responses of any nesting, restored by a map column."""

    @F.pandas_udf("string")
    def responses(values: pd.Series, maps: pd.Series) -> pd.Series:
        def one(value: str, given: dict[str, str]) -> str:
            return json.dumps(walk(json.loads(value), lambda t: restore(t, given)), ensure_ascii=False)

        return pd.Series([None if v is None else one(v, json.loads(m or "{}")) for v, m in zip(values, maps, strict=True)], dtype=object)

    return responses(response, F.to_json(given))
