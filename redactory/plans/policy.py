"""Policies: presets, explicit rules, custom detectors and an allowlist resolve to one setting for each active rule.

Resolution happens once on the driver; tasks get the small resolved policy.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from redactory.functions import detectors as built_in
from redactory.functions.detectors import DETECTORS, Detector
from redactory.functions.render import RANK, Setting
from redactory.functions.scan import CustomDetector, Scanner

from .errors import RedactionError

OFF = "off"
#: Most characters that a stream holds back.
STREAM_WINDOW = 65_536
#: Which keys a rule of each action may have beside its action.
_KEYS = {"redact": {"replacement", "priority"}, "format-preserve": set(), "token-replace": {"tokens"}, "mask": {"first", "last"}, "remove": set()}


def setting(value: str | dict | Setting, path: str = "rules") -> Setting | None:
    """A Setting from "off", an action's name, or a dictionary with an action and its own keys."""
    if isinstance(value, Setting):
        return value
    if value == OFF:
        return None
    if isinstance(value, str):
        value = {"action": value}
    if not isinstance(value, dict) or value.get("action") not in RANK or set(value) - {"action"} - _KEYS[value["action"]]:
        raise RedactionError("INVALID_CONFIG", path)
    first, last, priority = value.get("first", 0), value.get("last", 0), value.get("priority", 0)
    whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (first, last, priority))
    texts = [value[k] for k in ("replacement",) if k in value]
    tokens = value.get("tokens", {})
    if not whole or min(first, last) < 0 or not all(isinstance(x, str) for x in texts) or not isinstance(tokens, dict) or not all(isinstance(x, str) for kv in tokens.items() for x in kv):
        raise RedactionError("INVALID_CONFIG", path)
    return Setting(value["action"], value.get("replacement"), priority, first, last, tuple(sorted(tokens.items())))


@dataclass(frozen=True)
class Semantic:
    """Confirmation of candidates by a scorer: questions (rule, value, before, after) in, scores or None out."""

    scorer: object
    thresholds: dict[str, float] = field(default_factory=dict)
    context_window: int = 200


@dataclass
class Policy:
    """What to look for and what to do about it.

    ``max_input`` refuses longer texts (in UTF-16 units) with INPUT_LIMIT, which fails a query: it is for interactive use and off unless set.
    ``names``: names in small letters that the light name detector knows beside its own. ``recogniser``: for rule person_name, texts of a
    batch in, for each the spans of its names out.
    """

    presets: tuple[str, ...] = ()
    rules: dict[str, object] = field(default_factory=dict)
    custom_presets: dict[str, dict[str, object]] = field(default_factory=dict)
    detectors: tuple[CustomDetector, ...] = ()
    allowlist: tuple[str, ...] = ()
    restore: bool = False
    detect_only: bool = False
    max_input: int | None = None
    semantic: Semantic | None = None
    custom_headers: tuple[str | re.Pattern, ...] = ()
    names: frozenset[str] = frozenset()
    recogniser: Callable[[list[str]], Sequence[Iterable[tuple[int, int]]]] | None = None

    @classmethod
    def of(cls, config: dict) -> Policy:
        """From a configuration dictionary; unknown keys and values of a wrong shape are refused."""
        if not isinstance(config, dict) or set(config) - set(cls.__dataclass_fields__):
            raise RedactionError("INVALID_CONFIG", "config")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in config.items()})

    def resolve(self) -> Resolved:
        self._validate()
        custom = {d.id: d for d in self.detectors}
        merged = resolve_presets(self.presets, self.custom_presets)
        for rule, value in self.rules.items():
            given = setting(value, f"rules.{rule}")
            if given is None:
                merged.pop(rule, None)
            else:
                merged[rule] = given
        known = DETECTORS | custom
        for rule in self.rules | merged:
            if rule not in known:
                raise RedactionError("UNKNOWN_RULE", "rules")
        if not merged:
            raise RedactionError("EMPTY_POLICY")
        for rule in custom.keys() & merged.keys():
            if merged[rule].replacement is None and custom[rule].replacement:
                merged[rule] = replace(merged[rule], replacement=custom[rule].replacement)
        specs = tuple(self._spec(known[rule]) for rule in sorted(merged))
        return Resolved(specs, tuple(sorted(merged.items())), frozenset(self.allowlist), self.restore, self.detect_only, self.max_input, self.names, self.recogniser)

    def _spec(self, spec: Detector | CustomDetector) -> Detector | CustomDetector:
        if spec.id != "http_auth_header" or not self.custom_headers:
            return spec
        named = "".join(rf"|{re.escape(h)}\s*:\s*" for h in self.custom_headers if isinstance(h, str))
        own = "".join(f"|{h.pattern}" for h in self.custom_headers if isinstance(h, re.Pattern))
        head, tail = spec.pattern.rsplit(r")(\S+)", 1)
        return Detector(**{**spec.__dict__, "pattern": rf"{head}{named})(\S+){tail}{own}"})

    def _validate(self) -> None:
        def held(ok: object, path: str) -> None:
            if not ok:
                raise RedactionError("INVALID_CONFIG", path)

        named = lambda x: isinstance(x, str) and bool(x)
        count = lambda x: isinstance(x, int) and not isinstance(x, bool)
        held(isinstance(self.presets, tuple) and all(map(named, self.presets)), "presets")
        held(isinstance(self.rules, dict) and all(map(named, self.rules)), "rules")
        held(isinstance(self.custom_presets, dict), "custom_presets")
        for name, rules in self.custom_presets.items():
            held(isinstance(name, str) and re.fullmatch("[a-z][a-z0-9_-]*", name) and isinstance(rules, dict) and all(map(named, rules)), "custom_presets")
            for value in rules.values():
                setting(value, "custom_presets")
        held(isinstance(self.restore, bool), "restore")
        held(isinstance(self.detect_only, bool) and not (self.detect_only and self.restore), "detect_only")
        held(self.max_input is None or (count(self.max_input) and self.max_input > 0), "limits")
        held(isinstance(self.allowlist, tuple) and all(map(named, self.allowlist)), "allowlist")
        held(isinstance(self.custom_headers, tuple) and all(named(h) or isinstance(h, re.Pattern) for h in self.custom_headers), "custom_headers")
        held(isinstance(self.names, frozenset) and all(map(named, self.names)), "names")
        held(self.recogniser is None or callable(self.recogniser), "recogniser")
        held(self.semantic is None or isinstance(self.semantic, Semantic), "semantic")
        if self.semantic:
            given = self.semantic
            fine = lambda t: isinstance(t, int | float) and not isinstance(t, bool) and 0 <= t <= 1
            held(callable(given.scorer), "semantic.scorer")
            held(count(given.context_window) and given.context_window > 0, "semantic.context_window")
            held(isinstance(given.thresholds, dict) and all(map(fine, given.thresholds.values())), "semantic.thresholds")
        held(isinstance(self.detectors, tuple) and all(isinstance(d, CustomDetector) for d in self.detectors), "detectors")
        seen: set[str] = set()
        for d in self.detectors:
            held(named(d.id) and re.fullmatch("[a-z][a-z0-9_]*", d.id) and d.id not in DETECTORS and d.id not in seen and named(d.pattern), "detectors")
            held((d.max_match is None or (count(d.max_match) and d.max_match > 0)) and count(d.left) and count(d.right) and min(d.left, d.right) >= 0, "detectors")
            # A stream must be able to hold the longest match with its context.
            held(d.max_match is None or d.max_match + max(d.left, d.right) < STREAM_WINDOW, "detectors")
            seen.add(d.id)


def resolve_presets(names: tuple[str, ...], custom: dict[str, dict[str, object]]) -> dict[str, Setting]:
    """Presets merged in order. A custom preset goes before a built-in one of its name and has no versions; "off" in a preset takes nothing away; different actions for a rule conflict."""
    merged: dict[str, Setting] = {}
    for given in names:
        name, at, version = given.rpartition("@") if "@" in given else (given, "", "")
        if at and (not re.fullmatch("[a-z][a-z0-9_-]*", name) or not re.fullmatch("[1-9][0-9]*", version)):
            raise RedactionError("UNKNOWN_RULE", "presets")
        if name in custom:
            if at:
                raise RedactionError("UNKNOWN_RULE", "presets", {"preset": name, "reason": "custom_presets_do_not_support_versioning"})
            rules = {rule: setting(value, "custom_presets") for rule, value in custom[name].items()}
        elif name in built_in.PRESETS:
            if at and version != "1":
                raise RedactionError("UNKNOWN_RULE", "presets", {"preset": name, "available_versions": [1]})
            rules = dict.fromkeys(built_in.preset(name), Setting())
        else:
            raise RedactionError("UNKNOWN_RULE", "presets")
        for rule, value in rules.items():
            if value is None:
                continue
            if rule in merged and merged[rule].action != value.action:
                raise RedactionError("POLICY_CONFLICT", "presets")
            merged[rule] = value
    return merged


@dataclass(frozen=True)
class Resolved:
    """An immutable policy that tasks work by."""

    specs: tuple[Detector | CustomDetector, ...]
    rules: tuple[tuple[str, Setting], ...]
    allow: frozenset[str]
    restore: bool
    detect_only: bool
    max_input: int | None
    names: frozenset[str] = frozenset()
    recogniser: Callable | None = None

    @functools.cached_property
    def settings(self) -> dict[str, Setting]:
        return dict(self.rules)

    @functools.cached_property
    def scanner(self) -> Scanner:
        return _scanner(self.specs, self.allow, self.names)

    def __getstate__(self) -> dict:
        """What was made from the fields stays behind when tasks get the policy."""
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}


@functools.lru_cache(maxsize=256)
def _scanner(specs: tuple[Detector | CustomDetector, ...], allow: frozenset[str], known: frozenset[str]) -> Scanner:
    return Scanner(list(specs), allow, known)


def describe(specs: tuple[Detector | CustomDetector, ...] = tuple(DETECTORS.values())) -> list[dict]:
    """What each detector is and whether it needs context."""
    out = []
    for d in specs:
        labels = getattr(d, "labels", "")
        out.append({"id": d.id, "kind": getattr(d, "kind", "custom-pattern"), "entity_type": getattr(d, "entity", d.id), "replacement": d.replacement or f"[{d.id.upper()}]", "context_required": bool(labels or getattr(d, "keywords", ())), "before": d.left, "after": d.right, "max_match": d.max_match})
    return out
