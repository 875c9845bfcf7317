"""Logs: line and record sinks that redact before they write, a filter for Python's logging, and columns of log lines."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redact import Redactor, redact_text
from .structured import redact_json, walk


class LineSink:
    """Writes lines redacted as text."""

    def __init__(self, redactor: Redactor, write: Callable[[str], object]):
        self.policy, self.out = redactor.policy, write

    def write(self, line: str) -> None:
        self.out(redact_text(self.policy, line))


class RecordSink:
    """Writes records redacted through and through, one JSON document a line."""

    def __init__(self, redactor: Redactor, write: Callable[[str], object]):
        self.policy, self.out = redactor.policy, write

    def redact(self, record: dict) -> dict:
        return walk(record, lambda t: redact_text(self.policy, t))

    def write(self, record: dict) -> bool:
        self.out(json.dumps(self.redact(record), ensure_ascii=False, separators=(",", ":"), default=str) + "\n")
        return True


class RedactingFilter(logging.Filter):
    """Redacts the message and the arguments of log records before handlers see them."""

    def __init__(self, redactor: Redactor):
        super().__init__()
        self.policy = redactor.policy

    def filter(self, record: logging.LogRecord) -> bool:
        text = lambda t: redact_text(self.policy, t)
        record.msg = walk(record.msg, text)
        if record.args:
            record.args = walk(record.args, text) if isinstance(record.args, dict) else tuple(walk(list(record.args), text))
        return True


def redact_lines(line: Column, redactor: Redactor) -> Column:
    """Log lines: JSON records as records, other lines as text."""
    return F.when(F.trim(line).startswith("{"), redact_json(line, redactor)).otherwise(redactor.redact(line))
