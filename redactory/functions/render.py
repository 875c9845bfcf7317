"""From detections to text: overlapping spans are grouped, each group resolves to one action, and its replacement is put in.

Actions rank remove, redact, format-preserve, token-replace, mask; with restoration every group becomes a numbered
placeholder instead.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import regex

from .detectors import DETECTORS
from .scan import NUMBERED, Match

_SHAPE = str.maketrans({c: "X" if c.isdigit() else "*" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"})
RANK = ("remove", "redact", "format-preserve", "token-replace", "mask")


@dataclass(frozen=True)
class Setting:
    """What happens to a rule's matches."""

    action: str = "redact"
    replacement: str | None = None
    priority: int = 0
    first: int = 0
    last: int = 0
    tokens: tuple[tuple[str, str], ...] = ()


class Group(NamedTuple):
    start: int
    end: int
    matches: tuple[Match, ...]


class Segment(NamedTuple):
    start: int
    end: int
    replacement: str
    matches: tuple[Match, ...]


@dataclass
class Restoration:
    """Placeholders given so far: by placeholder, by entity, and, where values are to keep theirs, by value."""

    by_value: bool = False
    map: dict[str, str] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    known: dict[str, str] = field(default_factory=dict)

    def placeholder(self, entity: str, value: str) -> str:
        if self.by_value and value in self.known:
            return self.known[value]
        n = self.counters[entity] = self.counters.get(entity, 0) + 1
        name = f"[{entity}_{n}]"
        self.map[name] = value
        if self.by_value:
            self.known[value] = name
        return name

    def hydrate(self, given: dict[str, str]) -> Restoration:
        """Takes over placeholders of an earlier session; other keys are passed over, counters go on behind the largest."""
        for name, value in given.items():
            if NUMBERED.fullmatch(name):
                entity, _, n = name[1:-1].rpartition("_")
                self.map[name] = value
                self.known[value] = name
                self.counters[entity] = max(self.counters.get(entity, 0), int(n))
        return self


def grouped(matches: Sequence[Match]) -> list[Group]:
    """Spans that overlap, directly or through others, belong together; touching ones do not."""
    out: list[list] = []
    for m in sorted(matches, key=lambda m: m[:3]):
        if out and m.start < out[-1][1]:
            out[-1][1] = max(out[-1][1], m.end)
            out[-1][2].append(m)
        else:
            out.append([m.start, m.end, [m]])
    return [Group(a, b, tuple(found)) for a, b, found in out]


def winners(matches: Sequence[Match], settings: dict[str, Setting]) -> tuple[str, list[Match]]:
    """The action of a group and the matches that decide it."""
    action = min((settings[m.rule_id].action for m in matches), key=RANK.index)
    found = [m for m in matches if settings[m.rule_id].action == action]
    if action == "redact":
        most = max(settings[m.rule_id].priority for m in found)
        found = [m for m in found if settings[m.rule_id].priority == most]
    return action, found


def default_replacement(m: Match) -> str:
    return DETECTORS[m.rule_id].replacement if m.rule_id in DETECTORS else f"[{m.entity_type.upper()}]"


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def hidden(value: str, first: int, last: int) -> tuple[int, int]:
    """The part of a value that a mask covers: all but the first and last graphemes, or all where those would leave none."""
    ends = [m.end() for m in regex.finditer(r"\X", value)]
    if first + last >= len(ends):
        return 0, len(value)
    return ends[first - 1] if first else 0, ends[len(ends) - last - 1]


def _mask(text: str, group: Group, found: list[Match], settings: dict[str, Setting]) -> str:
    covered: set[int] = set()
    for m in found:
        a, b = hidden(text[m.start : m.end], settings[m.rule_id].first, settings[m.rule_id].last)
        covered |= set(range(m.start + a, m.start + b))
    out = []
    for m in regex.finditer(r"\X", text[group.start : group.end]):
        at = group.start + m.start()
        out.append("*" if at in covered else m[0])
    return "".join(out)


def replacement(text: str, group: Group, settings: dict[str, Setting], restoration: Restoration | None = None) -> str:
    action, found = winners(group.matches, settings)
    value = text[group.start : group.end]
    if restoration is not None:
        entities = {m.entity_type for m in found}
        entity = "REDACTED" if action == "redact" and len(entities) > 1 else found[0].entity_type.upper()
        return restoration.placeholder(entity, value)
    if action == "remove":
        return ""
    if action == "redact":
        choices = {default_replacement(m) if settings[m.rule_id].replacement is None else settings[m.rule_id].replacement for m in found}
        return choices.pop() if len(choices) == 1 else "[REDACTED]"
    if action == "format-preserve":
        return value.translate(_SHAPE)
    if action == "token-replace":
        entity = found[0].entity_type
        own = next((v for m in found for k, v in settings[m.rule_id].tokens if k == entity), None)
        if own is not None:
            return own
        return DETECTORS[entity].token if entity in DETECTORS else f"[REDACTED_{fnv1a(value):08X}]"
    return _mask(text, group, found, settings)


def segments(text: str, matches: Sequence[Match], settings: dict[str, Setting], restoration: Restoration | None = None, detect_only: bool = False) -> list[Segment]:
    return [Segment(g.start, g.end, text[g.start : g.end] if detect_only else replacement(text, g, settings, restoration), g.matches) for g in grouped(matches)]


def stitched(text: str, found: Sequence[Segment]) -> str:
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], s.replacement]
        at = s.end
    return "".join([*out, text[at:]])


def restore(text: str, given: dict[str, str]) -> str:
    """Numbered placeholders back to their values; unknown ones stay."""
    return NUMBERED.sub(lambda m: given.get(m[0], m[0]), text) if "[" in text else text


#: The longest tail that is held as the possible beginning of a placeholder: the longest entity, a bracket on each side, an underscore and ten digits.
HELD = max(map(len, DETECTORS)) + 13


class StreamRestorer:
    """Restores text that comes in pieces, holding back a tail that may be cut inside a placeholder."""

    def __init__(self, given: dict[str, str], held: str = ""):
        self.given, self.held = given, held

    def push(self, chunk: str) -> str:
        text = self.held + chunk
        at = text.rfind("[", max(0, len(text) - HELD))
        cut = at if at >= 0 and re.match(r"\[(?:[A-Z][A-Z0-9_]*)?\Z", text[at:]) else len(text)
        self.held = text[cut:]
        return restore(text[:cut], self.given)

    def flush(self) -> str:
        text, self.held = self.held, ""
        return restore(text, self.given)
