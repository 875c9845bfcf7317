"""Every built-in rule on its labelled cases, and the constants that token replacement puts in."""

import string

import pytest

from redactory.functions import names
from redactory.functions.detectors import DETECTORS
from redactory.functions.render import Setting, segments, stitched
from redactory.functions.scan import Scanner, scanner
from redactory.operators import native
from redactory.operators.redact import Redactor, redact_text
from redactory.plans.cases import WRITTEN, cases

GAP = "\n" + "." * 48 + "\nplain words"


@pytest.mark.parametrize("rule", sorted(WRITTEN))
def test_cases(rule):
    held = [c for c in cases() if c.rule_id == rule]
    assert any(c.value for c in held) and any(not c.value for c in held)
    for c in held:
        text = c.before + c.value + c.after + GAP
        got = [(m.start, m.end) for m in scanner((rule,))(text)]
        assert got == ([(len(c.before), len(c.before) + len(c.value))] if c.value else []), c
        if c.value:
            once = redact_text(Redactor({"rules": {rule: "redact"}}).policy, text)
            assert once == c.before + DETECTORS[rule].replacement + c.after + GAP
            assert redact_text(Redactor({"rules": {rule: "redact"}}).policy, once) == once


def test_every_rule_has_cases():
    assert set(WRITTEN) == set(DETECTORS) - {"person_name"}
    assert len(native.RULES) >= 138


#: Of constants that end in a run of zeros: what leads, how many zeros, what follows.
ZEROS = {
    "digitalocean_token": ("doo_v1_", 64, ""), "cloudflare_api_token": ("cfk_", 20, ""), "huggingface_token": ("hf_", 34, ""), "telegram_bot_token": ("0000000000:AA", 35, ""),
    "gitlab_token": ("glpat-", 20, ""), "npm_token": ("npm_", 36, ""), "anthropic_api_key": ("sk-ant-api03-", 93, "AA"), "shopify_token": ("shpat_", 38, ""), "twilio_sid": ("AC", 32, ""),
    "mailchimp_api_key": ("", 32, "-us0"), "notion_token": ("ntn_", 43, ""), "sentry_token": ("sntrys_eyJ", 197, ""), "heroku_api_key": ("HRKU-", 60, ""), "linear_api_key": ("lin_api_", 40, ""),
    "mailgun_api_key": ("key-", 32, ""), "okta_token": ("00", 40, ""), "square_token": ("sq0atp-", 36, ""), "datadog_api_key": ("", 40, ""), "pagerduty_token": ("y", 19, ""), "crypto_tx_hash": ("", 64, ""),
    "slack_webhook_url": ("https://hooks.slack.com/services/T00000000/B00000000/", 24, ""), "github_token": ("ghp_", 36, ""),
}


def test_token_constants():
    for rule, (head, zeros, tail) in ZEROS.items():
        assert DETECTORS[rule].token == head + "0" * zeros + tail, rule
    assert DETECTORS["sendgrid_api_key"].token.split(".") == ["SG", "0" * 22, "0" * 40] and DETECTORS["openai_api_key"].token == f"sk-{'0' * 20}T3BlbkFJ{'0' * 20}"
    assert DETECTORS["discord_bot_token"].token.split(".") == ["0" * 24, "0" * 6, "0" * 27] and DETECTORS["private_key"].token.count("\n") == 1
    for d in DETECTORS.values():
        assert d.token and set(d.token) <= set(string.ascii_letters + string.digits + " +-_.,:;/=@$()\n"), d.id


@pytest.mark.parametrize("rule", sorted(WRITTEN))
def test_token_replacement(rule):
    c = next(c for c in cases() if c.rule_id == rule and c.value)
    found = scanner((rule,))(c.before + c.value + c.after + GAP)
    out = stitched(c.before + c.value + c.after + GAP, segments(c.before + c.value + c.after + GAP, found, {rule: Setting("token-replace")}))
    assert out == c.before + DETECTORS[rule].token + c.after + GAP


def test_more_names():
    more = frozenset({"priya", "sharma", "okonkwo"})
    find = lambda text, known=frozenset(): [text[m.start : m.end] for m in Scanner([DETECTORS["person_name_lite"]], known=known)(text)]
    text = "they met Priya Sharma and Dr. Okonkwo there"
    assert find(text) == [] and find(text, more) == ["Priya Sharma", "Dr. Okonkwo"]
    assert redact_text(Redactor({"rules": {"person_name_lite": "redact"}, "names": more}).policy, text) == "they met [PERSON_NAME] and [PERSON_NAME] there"
    assert names.known("smith") and not names.known("okonkwo")
