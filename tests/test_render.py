import pytest
from hypothesis import given
from hypothesis import strategies as st

from redactory.functions.render import Restoration, Setting, StreamRestorer, fnv1a, grouped, replacement, restore
from redactory.functions.scan import EMPLOYEE_ID, CustomDetector, Match
from redactory.operators.redact import redact_text
from redactory.plans.errors import RedactionError
from redactory.plans.policy import Policy


def redact(text, **config):
    return redact_text(Policy.of(config).resolve(), text)


def m(a, b, rule="r"):
    return Match(a, b, rule, rule, ("x",))


def test_groups_are_transitive_and_half_open():
    assert [(g.start, g.end) for g in grouped([m(0, 3), m(2, 5), m(4, 6), m(6, 8)])] == [(0, 6), (6, 8)]


def test_precedence_and_priority():
    text, pair = "abcdef", [m(0, 4, "a"), m(2, 6, "b")]
    (g,) = grouped(pair)
    rank = [Setting("remove"), Setting("redact", "R"), Setting("format-preserve"), Setting("token-replace"), Setting("mask")]
    expected = ["", "R", "******", f"[REDACTED_{fnv1a('abcdef'):08X}]"]
    for k, (high, out) in enumerate(zip(rank, expected, strict=False)):
        assert replacement(text, g, {"a": high, "b": rank[k + 1]}) == out
    assert replacement(text, g, {"a": Setting("redact", "A", 1), "b": Setting("redact", "B", 2)}) == "B"
    assert replacement(text, g, {"a": Setting("redact", "A"), "b": Setting("redact", "B")}) == "[REDACTED]"
    assert replacement(text, g, {"a": Setting("mask", first=1), "b": Setting("mask", last=1)}) == "a****f"


def test_masks_count_graphemes():
    (g,) = grouped([m(0, 5)])
    assert replacement("éab👍"[:5], g, {"r": Setting("mask", first=1, last=1)}) == "é**👍"
    assert replacement("abcde", g, {"r": Setting("mask", first=3, last=2)}) == "*****"


def test_actions_on_text():
    assert redact("card 4111 1111 1111 1111!", rules={"payment_card": "redact"}) == "card [PAYMENT_CARD]!"
    assert redact("card 4111 1111 1111 1111!", rules={"payment_card": "format-preserve"}) == "card XXXX XXXX XXXX XXXX!"
    assert redact("mail a@b.co", rules={"email": "token-replace"}) == "mail redacted@example"
    assert redact("mail a@b.co", rules={"email": {"action": "token-replace", "tokens": {"email": "x"}}}) == "mail x"
    assert redact("mail a@b.co now", rules={"email": "remove"}) == "mail  now"
    assert redact("a@b.co, a@b.co", rules={"email": "redact"}, restore=True) == "[EMAIL_1], [EMAIL_2]"
    assert redact("a@b.co", rules={"email": "redact"}, detect_only=True) == "a@b.co"
    assert redact("a@b.co c@d.co", rules={"email": "redact"}, allowlist=["a@b.co"]) == "a@b.co [EMAIL]"


@pytest.mark.parametrize("text", ["a@b.co 4111 1111 1111 1111 SSN: 123-45-6789", "Dr. Smith 8.8.8.8", "+1 212 555 0123"])
def test_redaction_twice_is_once(text):
    once = redact(text, presets=["pii", "security"])
    assert redact(once, presets=["pii", "security"]) == once


def test_restoration_by_value_and_hydration():
    r = Restoration(by_value=True)
    assert [r.placeholder("A", "x"), r.placeholder("B", "x"), r.placeholder("A", "y")] == ["[A_1]", "[A_1]", "[A_2]"]
    h = Restoration(by_value=True).hydrate({"[A_7]": "x", "bad": "z"})
    assert h.placeholder("A", "x") == "[A_7]" and h.placeholder("A", "q") == "[A_8]" and "bad" not in h.map


@given(st.text("ab[]_A1", max_size=40), st.integers(1, 7))
def test_stream_restorer_equals_restore(text, size):
    given_map = {"[A_1]": "one", "[AA_11]": "two"}
    s = StreamRestorer(given_map)
    assert "".join([*(s.push(text[k : k + size]) for k in range(0, len(text), size)), s.flush()]) == restore(text, given_map)


def test_policy_errors():
    def code(**config):
        with pytest.raises(RedactionError) as x:
            Policy.of(config).resolve()
        return x.value.code

    assert code() == "EMPTY_POLICY"
    assert code(presets=["nope"]) == code(presets=["pii@2"]) == code(presets=["pii@x"]) == code(rules={"nope": "redact"}) == "UNKNOWN_RULE"
    assert code(rules={"email": "shout"}) == code(rules={"email": {"action": "mask", "first": -1}}) == code(rules={"email": {"action": "redact", "first": 1}}) == code(surprise=1) == "INVALID_CONFIG"
    assert code(rules={"email": "redact"}, restore=True, detect_only=True) == "INVALID_CONFIG"
    assert code(presets=["pii", "mine"], custom_presets={"mine": {"email": "mask"}}) == "POLICY_CONFLICT"
    assert code(rules={"email": "off"}, presets=[]) == "EMPTY_POLICY"
    assert code(detectors=[CustomDetector("email", "x")]) == "INVALID_CONFIG"
    with pytest.raises(RedactionError) as x:
        redact("aa", rules={"email": "redact"}, max_input=1)
    assert x.value.problem()["status"] == 413
    with pytest.raises(ValueError):
        x.value.problem({"INPUT_LIMIT": 503})


def test_custom_detector_in_a_policy():
    text = "Employee ID: AB123456, xAB123456, AB123456"
    config = {"detectors": [EMPLOYEE_ID], "rules": {"employee_id_example": "redact"}}
    assert redact(text, **config) == "Employee ID: [EMPLOYEE_ID], xAB123456, AB123456"
    assert redact(text, **config | {"restore": True}) == "Employee ID: [EMPLOYEE_ID_1], xAB123456, AB123456"
    assert redact(text, **config | {"rules": {"employee_id_example": "token-replace"}}) == f"Employee ID: [REDACTED_{fnv1a('AB123456'):08X}], xAB123456, AB123456"
    assert redact("X-My-Auth: abc9 x", rules={"http_auth_header": "redact"}, custom_headers=["X-My-Auth"]) == "X-My-Auth: [HTTP_AUTH_HEADER] x"


def test_preset_versions_and_off():
    assert len(Policy(presets=("pii@1",)).resolve().specs) == 96
    assert len(Policy(presets=("pii",), rules={"email": "off"}).resolve().specs) == 95
    assert len(Policy(presets=("pii", "mine"), custom_presets={"mine": {"email": "off"}}).resolve().specs) == 96
    assert dict(Policy(presets=("mine",), custom_presets={"mine": {"email": "mask"}}, rules={"email": "remove"}).resolve().rules)["email"].action == "remove"
