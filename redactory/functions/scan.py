"""Detection in one text: candidates by pattern, then neighbours, checks and context, as the detector's kind asks.

Offsets are code points; ``utf16`` turns them into UTF-16 units. A scanner compiles its rules once per process and
skips a rule whose every match needs a literal (a label, keyword or prefix) that the text does not hold.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import regex

from . import checks, names
from .detectors import DETECTORS, WHITE, Detector, portable

PLACEHOLDER = re.compile(r"\[[A-Z][A-Z0-9_]*\]")
NUMBERED = re.compile(r"\[[A-Z][A-Z0-9_]*_[0-9]+\]")
_NUMBER = re.compile("[0-9]+")
#: Patterns up to this width are looked for around digits; with so few runs of digits in a text that comes before all other tests.
NEAR, FEW = 64, 24
SPACES = re.compile(f"[{WHITE}]")


class ContractError(ValueError):
    """A custom detector broke its contract."""


class Match(NamedTuple):
    start: int
    end: int
    rule_id: str
    entity_type: str
    reasons: tuple[str, ...]


@dataclass(frozen=True)
class CustomDetector:
    """A detector of the caller's: ``validate(value, before, after)`` returns reasons, or None to reject."""

    id: str
    pattern: str
    entity_type: str = ""
    replacement: str = ""
    flags: int = 0
    left: int = 0
    right: int = 0
    max_match: int | None = None
    validate: Callable[[str, str, str], list[str] | None] | None = None
    confirm: Callable[[str, str, str], dict | None] | None = None

    @property
    def entity(self) -> str:
        return self.entity_type or self.id


@functools.lru_cache(maxsize=65_536)
def _wordlike(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def embedded(text: str, start: int, end: int) -> bool:
    """Whether a letter, mark, number or underscore touches the span."""
    return (start > 0 and _wordlike(text[start - 1])) or (end < len(text) and _wordlike(text[end]))


def aligned(text: str, at: int) -> bool:
    """Whether no grapheme is split at a position; between two ASCII characters none is."""
    if at <= 0 or at >= len(text) or (text[at - 1] < "\x80" and text[at] < "\x80"):
        return True
    begin = max(0, at - 64)
    return any(m.end() + begin == at for m in regex.finditer(r"\X", text[begin : at + 64]))


class Context:
    """Labels before a span (an optional colon or hash between) or behind it, in brackets or bare."""

    def __init__(self, labels: str, left: int, right: int):
        self.left, self.right = left, right
        self.before = regex.compile(rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_]){labels}[ \t]{{0,8}}[:#]?[ \t]{{0,8}}\Z", regex.I)
        self.bracketed = regex.compile(rf"[ \t]{{1,8}}\({labels}\)", regex.I)
        self.after = regex.compile(rf"[ \t]{{1,8}}{labels}(?:[^\p{{L}}\p{{M}}\p{{N}}_]|\Z)", regex.I)

    def precedes(self, text: str, start: int) -> bool:
        return bool(self.before.search(text[max(0, start - self.left) : start]))

    def follows(self, text: str, end: int, bracketed: bool = False) -> bool:
        rest = text[end : end + self.right]
        return bool(rest[:1] in (" ", "\t") and (self.bracketed.match(rest) or (not bracketed and self.after.match(rest))))

    def __call__(self, text: str, start: int, end: int) -> bool:
        return self.precedes(text, start) or self.follows(text, end)


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern, without a group around all of it."""
    if pattern.startswith("(?:") and pattern.endswith(")") and _closing(pattern) == len(pattern) - 1:
        pattern = pattern[3:-1]
    out, depth, at, k, inside = [], 0, 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif not inside and c in "()":
            depth += 1 if c == "(" else -1
        elif not inside and c == "|" and not depth:
            out.append(pattern[at:k])
            at = k + 1
        k += 1
    return [*out, pattern[at:]]


def _closing(pattern: str) -> int:
    depth, k, inside = 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "(" and not inside:
            depth += 1
        elif c == ")" and not inside:
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def literal(pattern: str) -> str:
    """The plain text that a pattern begins with."""
    m = re.match(r"(?:[^\\\[\](){}?*+.|^$]|\\[-.])*", pattern)
    found, rest = m[0], pattern[m.end() :]
    if rest[:1] in ("?", "*", "{"):
        found = found[:-1]
    return found.replace("\\", "")


def beginnings(pattern: str) -> list[str]:
    """Plain texts with which, one of them, every match begins."""
    out = []
    for x in alternatives(pattern):
        end = _closing(x) if x.startswith("(?:") else -1
        if end < 0 or x[end + 1 : end + 2] in ("?", "*", "{"):
            out.append(literal(x))
            continue
        for inner in alternatives(x[3:end]):
            begin = literal(inner)
            whole = re.fullmatch(r"(?:[^\\\[\](){}?*+.|^$]|\\[-.])*", inner)
            out.append(begin + literal(x[end + 1 :]) if whole else begin)
    return out


def literals(pattern: str) -> list[str] | None:
    """What texts must hold, one of them, to match; None if that is unknown."""
    found = beginnings(pattern)
    return found if all(len(x) > 1 for x in found) else None


def digital(pattern: str) -> bool:
    """Whether every match of the pattern surely holds a digit."""
    for x in alternatives(pattern):
        depth, k, sure = 0, 0, False
        while k < len(x):
            m = re.compile(r"\\d|\[0-9\]|\{[0-9,]*\}|\[[^\]\\]*(?:\\.[^\]\\]*)*\]|\\.|.", re.S).match(x, k)
            k = m.end()
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if m[0] in ("\\d", "[0-9]", *"0123456789") and not depth and not re.match(r"[?*]|\{0", x[k:]):
                sure = True
        if not sure:
            return False
    return True


class _Digits:
    """Where digits stand in the text at hand; all rules of a scanner ask for the same text in turn."""

    text: str | None = None
    runs: list[tuple[int, int]] = []

    @classmethod
    def of(cls, text: str) -> list[tuple[int, int]]:
        if cls.text is not text:
            cls.text, cls.runs = text, [m.span() for m in _NUMBER.finditer(text)]
        return cls.runs


def _width(pattern: str) -> int:
    """The longest text that a pattern can match; large if there is no bound, or if the pattern looks beyond its match."""
    if re.search(r"\(\?[=!<]|\\[bBAZ]|(?<!\[)\^|\$", pattern):
        return 1 << 30
    return re._parser.parse(portable(pattern), re.A).getwidth()[1]


def _spans(pattern: str, flags: str, near: bool = False) -> Callable[[str], Iterator[tuple[int, int, str]]]:
    """All matches in a text. Those that surely hold a digit and are of bounded width are looked for around digits alone (near)."""
    compiled, reach = re.compile(portable(pattern), re.A | (re.I if "i" in flags else 0)), _width(pattern)

    def everywhere(text: str) -> Iterator[tuple[int, int, str]]:
        return ((m.start(), m.end(), m[0]) for m in compiled.finditer(text) if m.end() > m.start())

    def around(text: str) -> Iterator[tuple[int, int, str]]:
        begin = end = -1
        for a, b in _Digits.of(text):
            if a - reach > end:
                if end >= 0:
                    yield from ((m.start(), m.end(), m[0]) for m in compiled.finditer(text, begin, end) if m.end() > m.start())
                begin = max(0, a - reach)
            end = b + reach
        if end >= 0:
            yield from ((m.start(), m.end(), m[0]) for m in compiled.finditer(text, begin, end) if m.end() > m.start())

    return around if near and reach <= NEAR else everywhere


class Rule:
    """A compiled detector."""

    def __init__(self, spec: Detector | CustomDetector, known: frozenset[str] = frozenset()):
        self.spec, self.id, self.known = spec, spec.id, known
        custom = isinstance(spec, CustomDetector)
        self.entity = spec.entity if custom else spec.id
        self.context = Context(spec.labels, spec.left, spec.right) if not custom and spec.labels else None
        self.gate, self.folded, self.labelled = None, False, None
        self.numeric = not custom and bool(spec.pattern) and (digital(spec.pattern) or spec.id in checks.NEED_DIGIT)
        #: Every match holds a digit and is short, so a few digits in a text leave little to look at.
        self.near = self.numeric and digital(spec.pattern) and _width(spec.pattern) <= NEAR
        if not custom:
            if self.context:
                self.gate, self.folded = literals(spec.labels), True
                self.labelled = re.compile(rf"(?<!\w){spec.labels}", re.I)
            elif spec.keywords:
                self.gate, self.folded = [k.lower() for k in spec.keywords], True
            elif spec.kind in ("token", "custom", "capture") and spec.id not in ("ipv4", "ipv6", "mac_address", "person_name_lite", "url_query_key"):
                self.gate, self.folded = literals(spec.pattern), "i" in spec.flags
            if self.gate and self.folded:
                self.gate = [x.lower() for x in self.gate]
        if custom:
            self.find = self._custom()
        elif hasattr(self, f"_{spec.id}"):
            self.find = getattr(self, f"_{spec.id}")
            self.spans = _spans(spec.pattern, spec.flags, self.near) if spec.pattern else None
        elif spec.kind == "capture":
            self.find = self._capture
            self.compiled = re.compile(portable(spec.pattern), re.A | re.I)
        else:
            self.find, self.spans = self._plain, _spans(spec.pattern, spec.flags, self.near)

    def wanted(self, text: str, lower: str, numbers: int) -> bool:
        """Whether the rule may find something in the text, which holds so many runs of digits."""
        if self.numeric and not numbers:
            return False
        if self.near and numbers <= FEW:
            return True
        if self.id in _FIRST and not _FIRST[self.id](text):
            return False
        if self.id == "person_name_lite" and not any(names.known(w.lower(), self.known) for w in set(_CAPITALISED.findall(text))):
            return False
        if self.gate is not None:
            where = lower if self.folded else text
            for g in self.gate:
                if g in where:
                    return not self.labelled or bool(self.labelled.search(text))
            return False
        return not self.labelled or bool(self.labelled.search(text))

    def __call__(self, text: str) -> list[Match]:
        found = [Match(a, b, self.id, self.entity, tuple(f"{self.id}.{r}" for r in reasons) if not isinstance(self.spec, CustomDetector) else tuple(reasons)) for a, b, reasons in self.find(text)]
        whole = [m for m in found if aligned(text, m.start) and aligned(text, m.end)]
        if isinstance(self.spec, CustomDetector) and len(whole) < len(found):
            raise ContractError(f"{self.id} matched a part of a grapheme")
        return whole

    def _plain(self, text: str) -> Iterator[tuple]:
        kind = self.spec.kind
        for a, b, value in self.spans(text):
            if embedded(text, a, b):
                continue
            reasons = checks.check(self.id, value)
            if reasons is None or (self.context and not self.context(text, a, b)):
                continue
            if kind == "keyword":
                around = (text[max(0, a - 40) : a] + text[b : b + 40]).lower()
                if not any(k.lower() in around for k in self.spec.keywords):
                    continue
                reasons += ("keyword",)
            yield a, b, reasons + (("context",) if self.context else ())

    def _capture(self, text: str) -> Iterator[tuple]:
        for m in self.compiled.finditer(text):
            value = next((g for g in m.groups() if g is not None), None)
            if value is None:
                continue
            # Where the value also stands earlier in the match, its first place counts, for headers its last.
            a = m.start() + (m[0].rfind(value) if self.id == "http_auth_header" else m[0].find(value))
            if embedded(text, a, a + len(value)):
                continue
            if self.id == "generic_api_key":
                if re.search("example|sample|test|fake|demo|placeholder|xxx", value, re.I):
                    continue
                yield a, a + len(value), ("context", "format")
            else:
                yield a, a + len(value), ("format",)

    def _custom(self) -> Callable:
        spec, compiled = self.spec, regex.compile(self.spec.pattern, self.spec.flags)

        def find(text: str) -> Iterator[tuple]:
            for m in compiled.finditer(text):
                a, b = m.span()
                if a == b:
                    raise ContractError(f"{spec.id} matched no text")
                if spec.max_match and b - a > spec.max_match:
                    raise ContractError(f"{spec.id} matched more than {spec.max_match} characters")
                reasons: list[str] | None = ["detector.pattern"]
                if spec.validate:
                    reasons = spec.validate(m[0], text[max(0, a - spec.left) : a], text[b : b + spec.right])
                    if not reasons:
                        continue
                    if not all(isinstance(r, str) and re.fullmatch(r"[a-zA-Z0-9_.-]+", r) for r in reasons):
                        raise ContractError(f"{spec.id} gave reasons that are no identifiers")
                yield a, b, reasons

        return find

    def _email(self, text: str) -> Iterator[tuple]:
        quoted = [m.span() for m in re.finditer(r'"(?:[^"\\]|\\.)*"@', text)] if '"@' in text else []
        for m in re.finditer("@", text):
            at = m.start()
            scheme = text.rfind("://", 0, at)
            if any(a < at < b for a, b in quoted) or (scheme >= 0 and ":" in text[scheme + 3 : at]):
                continue
            a, b = at, at + 1
            while a > 0 and at - a <= 254 and (text[a - 1] in _LOCAL or _wordlike(text[a - 1])):
                a -= 1
            while b < len(text) and b - at <= 254 and (text[b] in "._@-" or _wordlike(text[b])):
                b += 1
            if text[b - 1] == "." and text[b - 2] != "." and (b == len(text) or SPACES.match(text[b])):
                b -= 1
            if at - a <= 64 and b - a <= 254 and text[a - 1 : a] != '"' and _LOCAL_PART.fullmatch(text, a, at) and _DOMAIN.fullmatch(text, at + 1, b):
                yield a, b, ("ascii_dot_atom", "dns_domain")

    def _phone(self, text: str) -> Iterator[tuple]:
        return ((a, b, ("format",)) for a, b, v in self.spans(text) if not embedded(text, a, b) and checks.phone(v))

    def _iban(self, text: str) -> Iterator[tuple]:
        for a, _, value in self.spans(text):
            if a > 0 and _wordlike(text[a - 1]):
                continue
            while not checks.iban(value):
                value, space, last = value.rpartition(" ")
                if not space or last.isdigit():
                    value = ""
                    break
            b = a + len(value)
            if value and not (b < len(text) and _wordlike(text[b])):
                yield a, b, ("checksum", "format")

    def _ipv4(self, text: str) -> Iterator[tuple]:
        return ((a, b, ("format",)) for a, b, v in self.spans(text) if not embedded(text, a, b) and checks.public_ipv4(v))

    def _ipv6(self, text: str) -> Iterator[tuple]:
        return ((a, b, ("format",)) for a, b, v in self.spans(text) if not embedded(text, a, b) and checks.global_ipv6(v)) if "::" in text or text.count(":") > 6 else iter(())

    def _mac_address(self, text: str) -> Iterator[tuple]:
        for a, b, value in self.spans(text):
            longer = text[b : b + 1] == value[2] and re.match("[0-9A-Fa-f]", text[b + 1 : b + 2])
            if not embedded(text, a, b) and not longer:
                yield a, b, ("format",)

    def _url_with_auth(self, text: str) -> Iterator[tuple]:
        for a, b, value in self.spans(text):
            b = a + len(value.rstrip("_"))
            if text[b - 1] == "." and (b == len(text) or SPACES.match(text[b])):
                b -= 1
            if not embedded(text, a, b):
                yield a, b, ("format",)

    def _jwt_token(self, text: str) -> Iterator[tuple]:
        for a, _, value in self.spans(text):
            b = a + len(value.rstrip("_"))
            if not embedded(text, a, b):
                yield a, b, ("format",)

    def _digital_identity(self, text: str) -> Iterator[tuple]:
        for a, b, value in self.spans(text):
            if embedded(text, a, b) or value.lower() in _COMMON or (value.isdigit() and not 17 <= len(value) <= 19):
                continue
            marked = value[0] == "@" or value.isdigit() or re.fullmatch("STEAM_[0-9]:[0-9]:[0-9]+", value)
            if self.context.precedes(text, a) or self.context.follows(text, b, bracketed=not marked):
                yield a, b, ("format", "context")

    def _hr_compensation(self, text: str) -> Iterator[tuple]:
        amounts = {(a, b) for a, b, _ in self.spans(text)}
        coded = {(a, b) for a, b, v in _HR_CODES(text) if re.search("[0-9]", v)}
        for a, b in sorted(amounts | coded):
            if not embedded(text, a, b) and self.context(text, a, b):
                yield a, b, ("format", "context")

    def _person_name_lite(self, text: str) -> Iterator[tuple]:
        for a, _, value in self.spans(text):
            if not value.endswith(names.SUFFIXES):
                value = value.rstrip(".,;:)]}>?!")
            value = value.removesuffix("'s")
            title = re.match(names.TITLE, value)
            words = re.sub(names.SUFFIX, "", value[title.end() :] if title else value).split()
            known = names.known(words[0].lower(), self.known) if len(words) == 1 and title else len(words) > 1 and any(names.known(w.lower(), self.known) and w.lower() not in names.STOPWORDS for w in words)
            if value and known and not embedded(text, a, a + len(value)):
                yield a, a + len(value), ("names",)

    def _person_name(self, text: str) -> Iterator[tuple]:
        for a, b in names.recogniser()(text):
            value = text[a:b].rstrip(".,;:)]}>?!").removesuffix("'s")
            if value and not embedded(text, a, a + len(value)):
                yield a, a + len(value), ("ner",)


# Grammar of addresses, and words that are no user names.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+-/=?^_`{|}~@")
_LOCAL_PART = re.compile(r"[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]+(?:\.[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]+)*")
_DOMAIN = re.compile(r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}")
_COMMON = frozenset("the and for admin but not are was has had this that with from your have more will can all any get set new old one two out how who why yes you its our now".split())
#: Cheap tests that a text must pass for dear patterns: a long run of letters and digits; a known name in capitals.
_RUN = re.compile("[A-Za-z0-9]{20}")
_CAPITALISED = re.compile("[A-Z][a-z]+")
_FIRST = {
    "crypto_address": _RUN.search,
    "ipv4": re.compile(r"[0-9]\.[0-9]").search,
    "mac_address": lambda text: text.count(":") > 4 or text.count("-") > 4,
}
_HR_CODES = _spans("[A-Z0-9]{6,16}", "i")


#: A custom detector as an example: two capitals and six digits behind a label.
_EMPLOYEE_LABEL = regex.compile(r"(?:^|[^\p{L}\p{M}\p{N}_])Employee ID[ \t]{0,8}[:#]?[ \t]{0,8}\Z", regex.I)
EMPLOYEE_ID = CustomDetector(
    "employee_id_example",
    r"(?<![\p{L}\p{M}\p{N}_])[A-Z]{2}[0-9]{6}(?![\p{L}\p{M}\p{N}_])",
    entity_type="employee_id",
    replacement="[EMPLOYEE_ID]",
    left=20,
    max_match=8,
    validate=lambda value, before, after: ["employee_id_example.context"] if _EMPLOYEE_LABEL.search(before) else None,
)


class Scanner:
    """Detections of some rules in a text, without those in placeholders or on the allowlist."""

    def __init__(self, rules: list[Detector | CustomDetector], allow: frozenset[str] = frozenset(), known: frozenset[str] = frozenset()):
        self.rules, self.allow = [Rule(r, known) for r in rules], allow

    def __call__(self, text: str) -> list[Match]:
        lower, numbers = text.lower(), len(_Digits.of(text))
        found = [m for rule in self.rules if rule.wanted(text, lower, numbers) for m in rule(text)]
        if found and "[" in text:
            held = [m.span() for m in PLACEHOLDER.finditer(text)]
            found = [m for m in found if not any(m.start < b and a < m.end for a, b in held)]
        return sorted(m for m in found if text[m.start : m.end] not in self.allow)


@functools.lru_cache(maxsize=64)
def scanner(rules: tuple[str, ...], allow: frozenset[str] = frozenset()) -> Scanner:
    return Scanner([DETECTORS[r] for r in rules], allow)


def utf16(text: str, at: int) -> int:
    """A code-point offset in UTF-16 units."""
    return at if text.isascii() else len(text[:at].encode("utf-16-le", "surrogatepass")) // 2
