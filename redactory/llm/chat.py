"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, that reply alone trainable. Turns
after the last reply belong to no target; they come as one last example without a trainable span, so that the output
holds every conversation whole.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn `` text</s>``, any other ``[ROLE] role\\ntext [/ROLE]``, a
conversation opens with ``<s>``. Control strings inside texts and roles are split by an escape that reading undoes: each
backslash is doubled, then ``\\.`` goes behind the first character of each control string (a line end in a role is ``\\n``).

Conversations are brought together by one shuffle and sort on conv_id and turn; formatting and reading stream through
the sorted rows, so a task holds one conversation's rendered text at most and never a table of them. The output of the
method itself grows with the square of a conversation's turns; reading it back shuffles each reply once, not the texts.

Defined results: rows order by turn, then role and text; a null text or role is empty; a null conv_id is one
conversation; equal rows stay separate turns; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import arrow_rows

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\|\.|n)")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|\[ROLE\] (?P<role>[^\n]*)\n(?P<text>.*?) \[/ROLE\]", re.S)
EXAMPLES = "conv_id long, example int, n_turns int, text string, target_start long, target_end long"


def escape(text: str) -> str:
    return _CONTROLS.sub(lambda m: f"{m[0][0]}\\.{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where in it the text lies."""
    body = escape(text)
    if role == "user":
        head, tail = "[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = " ", "</s>"
    else:
        head, tail = f"[ROLE] {escape(role).replace(chr(10), chr(92) + 'n')}\n", " [/ROLE]"
    return head + body + tail, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation."""
    return [(role, said) for role, said, _ in _parsed(text)]


def _parsed(text: str) -> list[tuple[str, str, int]]:
    """The turns with the place where each ends."""
    if not text.startswith("<s>"):
        raise ValueError("a formatted conversation begins with <s>")
    at, turns = 3, []
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = next(k for k in ("user", "assistant", "role") if m[k] is not None)
        at = m.end()
        turns.append((unescape(m["role"]), unescape(m["text"]), at) if role == "role" else (role, unescape(m[role]), at))
    return turns


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_EXAMPLE_ROWS = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()), ("target_start", pa.int64()), ("target_end", pa.int64())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("whole", pa.string()), ("before", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])
PARTS = "conv_id long, example int, n_turns long, turns_sha256 string, whole string, before string, loss string, chars long"


def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to examples."""

    def rows() -> Iterator[tuple]:
        now, text, turns, made, open_turns = object(), "", 0, 0, False
        for batch in batches:
            for conv, role, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    if open_turns:
                        yield now, made, turns, text, None, None
                    now, text, turns, made, open_turns = conv, "<s>", 0, 0, False
                piece, start, end = render(role or "", said or "")
                at, turns, open_turns = len(text), turns + 1, True
                text += piece
                if role == "assistant":
                    yield conv, made, turns, text, at + start, at + end
                    made, open_turns = made + 1, False
        if open_turns:
            yield now, made, turns, text, None, None

    return _batches(rows(), _EXAMPLE_ROWS)


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn (and one for turns after the last): the text and the span of it that is trained on. A conversation's rows are adjacent, in order."""
    arrow_rows(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(expand, EXAMPLES)


def read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each example says, from its formatted text alone: its turns, what it trains on, and digests of the whole text and of the text up to the reply before."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for conv, example, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "text", "target_start", "target_end")), strict=True):
                turns, said = _parsed(text), hashlib.sha256()
                for role, told, _ in turns:
                    said.update(f"{role}\n{told}\n".encode("utf-8", "surrogatepass"))
                replies = [at for role, _, at in turns if role == "assistant" and (start is None or at < len(text))]
                before = _sha(text[: replies[-1]]) if replies else None
                yield conv, example, len(turns), said.hexdigest(), _sha(text), before, unescape(text[start:end]) if start is not None else "", len(text)

    return _batches(rows(), _PARTS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(formatted: DataFrame) -> DataFrame:
    """What examples() wrote, read back in whatever order and splits: turns, trained text and length of each conversation.

    Every example is read. Its context must be the example before it, whole: a conversation where one differs has a null turns_sha256.
    """
    told = F.array_sort(F.collect_list(F.struct("example", "n_turns", "turns_sha256", "whole", "before", "loss", "chars"))).alias("e")
    rows = formatted.mapInArrow(read_back, PARTS).groupBy("conv_id").agg(told)
    kept = F.forall(F.sequence(F.lit(0), F.size("e") - 1), lambda k: F.col("e")[k]["before"].eqNullSafe(F.when(k > 0, F.col("e")[k - 1]["whole"])))
    last, loss = F.element_at("e", -1), F.array_join(F.col("e.loss"), "")
    total = F.aggregate(F.col("e.chars"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", last["n_turns"].alias("n_turns"), F.when(kept, last["turns_sha256"]).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), total.alias("formatted_chars"))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def _sql_escape(x: str) -> str:
    out = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '.{c[1:]}')"
    return out


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS n FROM c),
l AS (
  SELECT *, length({_sql_escape("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 8 + 8 + length(replace({_sql_escape("role")}, chr(10), chr(92) || 'n')) END AS piece,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
  FROM o),
p AS (SELECT *, 3 + sum(piece) OVER (PARTITION BY conv_id ORDER BY n) AS upto, max(n) OVER (PARTITION BY conv_id) AS most FROM l)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY n)) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR n = most THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
