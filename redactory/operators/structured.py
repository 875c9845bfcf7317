"""Redaction of nested columns: strings anywhere in structs, arrays and maps, and whole values of fields with secret names.

Nested columns go to Python as Arrow arrays of their own type: string leaves are rewritten, all other buffers (numbers,
decimals, timestamps, binaries) are handed back as they came. Map keys and values are both redacted; of keys that become
equal the last counts. A field whose name is secret keeps what the detectors make of a string if they find anything, else
becomes [REDACTED]; null stays null; values of other types become [REDACTED] strings, in maps, whose values share a type, null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .redact import Redactor, redact_text

# Field names whose values are secret.
SECRET_FIELDS = frozenset("password passwd secret token authorization auth cookie api_key apikey api_secret credential credentials private_key access_token refresh_token session session_id".split())
SECRET = "[REDACTED]"


def secret(name: str) -> bool:
    return name.lower() in SECRET_FIELDS


def schema_of(kind: T.DataType) -> T.DataType:
    """The type after redaction: secret fields that are no strings turn to strings."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, T.StringType() if secret(f.name) else schema_of(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(schema_of(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType if not isinstance(kind.keyType, T.StringType) else T.StringType(), schema_of(kind.valueType), True)
    return kind


def has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(secret(f.name) or has_text(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_text(kind.keyType) or has_text(kind.valueType)
    return isinstance(kind, T.StringType)


def walk(value: object, text: Callable[[str], str], name: str = "") -> object:
    """A nested Python value redacted; the names of its fields stay."""
    if value is None:
        return None
    if name and secret(name):
        if isinstance(value, str):
            done = text(value)
            return done if done != value else SECRET
        return SECRET
    if isinstance(value, str):
        return text(value)
    if isinstance(value, dict):
        return {k: walk(v, text, k if isinstance(k, str) else "") for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [walk(v, text) for v in value]
    return value


def redact_nested(df: DataFrame, redactor: Redactor, columns: list[str] | None = None) -> DataFrame:
    """df with its columns (all by default) redacted through and through."""
    out: list[Column] = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if columns is not None and f.name not in columns or not (has_text(f.dataType) or secret(f.name)):
            out.append(c)
        elif secret(f.name) and not isinstance(f.dataType, T.StringType):
            out.append(F.when(c.isNotNull(), SECRET).alias(f.name))
        else:
            kind = T.StringType() if secret(f.name) else schema_of(f.dataType)
            out.append(_leaves(redactor.policy, f.name, kind)(c).alias(f.name))
    return df.select(*out)


def _leaves(policy, name: str, kind: T.DataType):
    @F.arrow_udf(kind)
    def rewritten(values: pa.Array) -> pa.Array:
        return rewrite(values, lambda t: redact_text(policy, t), name)

    return rewritten


def _hidden(value: str | None, text: Callable[[str], str]) -> str | None:
    """A secret string: what the detectors make of it, or [REDACTED] if they find nothing."""
    if value is None:
        return None
    done = text(value)
    return done if done != value else SECRET


def rewrite(a: pa.Array, text: Callable[[str], str], name: str = "") -> pa.Array:
    """An Arrow array of any type with its string leaves redacted."""
    kind, strings = a.type, lambda x: pa.types.is_string(x) or pa.types.is_large_string(x)
    if name and secret(name):
        return pa.array([_hidden(v, text) for v in a.to_pylist()] if strings(kind) else [SECRET if ok else None for ok in a.is_valid().to_pylist()], pa.string())
    if strings(kind):
        return pa.array([None if v is None else text(v) for v in a.to_pylist()], pa.string())
    if pa.types.is_struct(kind):
        if not kind.num_fields:
            return a
        children = [rewrite(a.field(i), text, kind.field(i).name) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays(children, [kind.field(i).name for i in range(kind.num_fields)], mask=a.is_null())
    if pa.types.is_map(kind):
        return _rewrite_map(a, text)
    if pa.types.is_list(kind):
        size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, rewrite(a.flatten(), text), mask=a.is_null())
    return a


def _rewrite_map(a: pa.MapArray, text: Callable[[str], str]) -> pa.Array:
    offsets = np.asarray(a.offsets)  # of the slice, into all keys and items
    first, last = int(offsets[0]), int(offsets[-1])
    keys, items = a.keys.slice(first, last - first), a.items.slice(first, last - first)
    named = keys.to_pylist() if pa.types.is_string(keys.type) else None
    done = rewrite(items, text)
    if named is None:
        return pa.MapArray.from_arrays(pa.array((offsets - first).astype(np.int32)), keys, done, mask=a.is_null())
    at = [k for k, name in enumerate(named) if secret(name)]
    if at:
        values = [_hidden(v, text) if isinstance(v, str) else None for v in items.take(pa.array(at)).to_pylist()]
        mask = np.zeros(len(named), bool)
        mask[at] = True
        done = pc.replace_with_mask(done, pa.array(mask), pa.array(values, done.type))
    renamed, kept, ends = [text(k) for k in named], [], [0]
    for begin, end in zip(offsets[:-1] - first, offsets[1:] - first, strict=True):
        kept += sorted({renamed[k]: k for k in range(begin, end)}.values())
        ends.append(len(kept))
    at = pa.array(kept, pa.int64())
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(renamed, pa.string()).take(at), done.take(at), mask=a.is_null())


def redact_json(column: Column, redactor: Redactor) -> Column:
    """A column of JSON log records, redacted as records; text that is no JSON is redacted as text."""
    import json

    policy = redactor.policy

    @F.pandas_udf("string")
    def record(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            try:
                return json.dumps(walk(json.loads(v), lambda t: redact_text(policy, t)), ensure_ascii=False, separators=(",", ":"))
            except json.JSONDecodeError:
                return redact_text(policy, v)

        return pd.Series([one(v) for v in values], dtype=object)

    return record(column)


def redact_messages(messages: Column, redactor: Redactor) -> Column:
    """A request of any nesting (messages with roles, content blocks, tool calls), with one numbering over all its strings.

    Gives struct<messages: string (JSON), map>: equal values have one placeholder, so a response can be restored by the map.
    """
    import json

    from redactory.functions.render import Restoration

    policy = redactor.policy

    @F.pandas_udf("struct<messages:string,map:map<string,string>>")
    def request(values: pd.Series) -> pd.DataFrame:
        texts, maps = [], []
        for v in values:
            state = Restoration(by_value=True)
            texts.append(None if v is None else json.dumps(walk(json.loads(v), lambda t, s=state: redact_text(policy, t, s)), ensure_ascii=False))
            maps.append(state.map)
        return pd.DataFrame({"messages": pd.Series(texts, dtype=object), "map": pd.Series(maps, dtype=object)})

    return request(F.to_json(messages))
