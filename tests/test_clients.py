"""Adapters of clients, logs, streams in one process, configuration and standard input."""

import io
import json
import logging
import warnings

import pytest
from pyspark.sql import functions as F

from redactory.functions.scan import CustomDetector
from redactory.operators import clients, logs, session, structured, vault
from redactory.operators.redact import Redactor
from redactory.plans.errors import RedactionError, VaultError
from redactory.plans.policy import Policy, Semantic
from redactory.sources import cli, files
from redactory.streaming import redact as streams

EMAIL = Redactor({"rules": {"email": "redact"}})
SAID = [{"role": "user", "content": "I am jo@example.com"}, {"role": "user", "content": [{"type": "text", "text": "again jo@example.com"}]}]


def test_whole_responses():
    seen = {}

    def create(**request):
        seen.update(request)
        return {"choices": [{"message": {"content": "hello [EMAIL_1]", "tool_calls": [{"function": {"arguments": '{"to": "[EMAIL_2]"}'}}]}}], "n": 3}

    call = clients.chat_completions(create, EMAIL)
    got = call(messages=SAID, model="m")
    assert seen["messages"][0]["content"] == "I am [EMAIL_1]" and seen["messages"][1]["content"][0]["text"] == "again [EMAIL_2]" and seen["model"] == "m"
    assert got["choices"][0]["message"]["content"] == "hello jo@example.com" and got["n"] == 3
    assert got["choices"][0]["message"]["tool_calls"][0]["function"]["arguments"] == '{"to": "jo@example.com"}'
    assert clients.chat_completions(call, EMAIL) is call

    one = session.Shared(EMAIL, by_value=True)
    clients.block_messages(create, one)(messages=SAID, system="for jo@example.com")
    assert seen["system"] == "for [EMAIL_1]" and seen["messages"][1]["content"][0]["text"] == "again [EMAIL_1]" and one.map == {"[EMAIL_1]": "jo@example.com"}
    one.reset()
    assert one.map == {}
    clients.chat_completions(create, Redactor({"rules": {"email": "redact"}, "detect_only": True}))(messages=SAID)
    assert seen["messages"] == SAID


def test_streamed_responses():
    given = {"[EMAIL_1]": "jo@example.com"}
    chunks = [{"choices": [{"delta": {"content": "hi [EMA"}}]}, {"choices": [{"delta": {"content": "IL_1] and ["}}]}, {"choices": [{"finish_reason": "stop"}]}]
    got = list(clients.choices_restored(chunks, given))
    assert "".join(c["delta"].get("content", "") for x in got for c in x["choices"] if "delta" in c) == "hi jo@example.com and ["
    tool = [{"choices": [{"delta": {"tool_calls": [{"function": {"arguments": '{"a":"[EMAIL'}}]}}]}, {"choices": [{"delta": {"tool_calls": [{"function": {"arguments": '_1]"}'}}]}}]}]
    assert "".join(x["choices"][0]["delta"]["tool_calls"][0]["function"]["arguments"] for x in clients.choices_restored(tool, given)) == '{"a":"jo@example.com"}'

    block = lambda i, text, kind="text_delta", key="text": {"type": "content_block_delta", "index": i, "delta": {"type": kind, key: text}}
    events = [block(0, "a [EMAIL"), block(1, '"[EMA', "partial_json", "partial_json"), block(0, "_1] b ["), block(1, 'IL_1]"', "partial_json", "partial_json"), {"type": "content_block_stop", "index": 0}, {"type": "message_stop"}]
    got = list(clients.blocks_restored(events, given))
    assert "".join(e["delta"]["text"] for e in got if e.get("index") == 0 and "delta" in e) == "a jo@example.com b ["
    assert "".join(e["delta"]["partial_json"] for e in got if e.get("index") == 1) == '"jo@example.com"' and got[-1] == {"type": "message_stop"}
    assert [e["type"] for e in got].index("content_block_stop") == 5
    assert clients.redact_prompt("I am jo@example.com", EMAIL) == ("I am [EMAIL_1]", given)


def test_columns_of_responses(spark):
    df = spark.createDataFrame([(1, '{"a": ["[EMAIL_1]", 2]}', {"[EMAIL_1]": "jo@example.com"}), (2, None, None)], "id int, r string, m map<string,string>")
    got = {r.id: r.x for r in df.select("id", clients.restore_responses(F.col("r"), F.col("m")).alias("x")).collect()}
    assert got == {1: '{"a": ["jo@example.com", 2]}', 2: None}


def test_logs(spark):
    out = []
    logs.LineSink(EMAIL, out.append).write("GET /? jo@example.com 200\n")
    assert logs.RecordSink(EMAIL, out.append).write({"msg": "jo@example.com", "password": "x", "level": 30, "in": {"token": 5}})
    assert out == ["GET /? [EMAIL] 200\n", '{"msg":"[EMAIL]","password":"[REDACTED]","level":30,"in":{"token":"[REDACTED]"}}\n']
    log, held = logging.getLogger("redactory.test"), io.StringIO()
    handler = logging.StreamHandler(held)
    log.addHandler(handler)
    log.addFilter(logs.RedactingFilter(EMAIL))
    log.warning("%s wrote", "jo@example.com")
    assert held.getvalue() == "[EMAIL] wrote\n"
    lines = spark.createDataFrame([('{"msg": "jo@example.com", "auth": "k"}',), ("plain jo@example.com",), (None,)], "value string")
    assert [r[0] for r in lines.select(logs.redact_lines(F.col("value"), EMAIL)).collect()] == ['{"msg":"[EMAIL]","auth":"[REDACTED]"}', "plain [EMAIL]", None]


def test_streams_in_one_process():
    text = "x" * 300 + " jo@example.com " + "y" * 300
    pieces = [text[k : k + 7] for k in range(0, len(text), 7)]
    events = list(streams.events_of(pieces, EMAIL, restore=True))
    assert "".join(e["text"] for e in events if e["event_type"] == "text") == text.replace("jo@example.com", "[EMAIL_1]")
    assert events[-1]["event_type"] == "complete" and json.loads(events[-1]["map"]) == {"[EMAIL_1]": "jo@example.com"}
    assert "".join(e["text"] for e in streams.events_of(pieces, Redactor({"rules": {"email": "redact"}, "restore": True}), restore=False)) == text.replace("jo@example.com", "[EMAIL]")

    def broken():
        yield "some text"
        raise OSError("gone")

    with pytest.raises(RedactionError) as x:
        list(streams.events_of(broken(), EMAIL))
    assert x.value.code == "SOURCE_FAILURE"
    left = iter([False, False, True])
    with pytest.raises(RedactionError) as x:
        list(streams.events_of(pieces, EMAIL, cancelled=lambda: next(left)))
    assert x.value.code == "CANCELLED"
    with pytest.warns(UserWarning, match="not confirmed"):
        streams.policy_of(Redactor(Policy(rules={"email": "redact"}, semantic=Semantic(lambda q: []))))
    with pytest.raises(RedactionError):
        streams.policy_of(Redactor({"rules": {"email": "redact"}, "detect_only": True}), restore=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        streams.policy_of(EMAIL)


def test_sealed_sessions(spark):
    turns = spark.createDataFrame([(1, 0, "user", "I am jo@example.com"), (1, 1, "user", "still jo@example.com, and al@example.com"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    provider = vault.LocalProvider(b"k" * 32)
    sealed = session.redact_turns_sealed(turns, EMAIL, provider)
    got = {(r.conv_id, r.turn): (r.redacted, r.sealed) for r in sealed.collect()}
    assert got[1, 1][0] == "still [EMAIL_1], and [EMAIL_2]" and "jo@example" not in str(vault.blob_fields(got[1, 1][1]))
    held = spark.createDataFrame(sealed.collect(), sealed.schema)
    assert [r.redacted for r in session.restore_turns_sealed(held, provider).orderBy("conv_id", "turn").collect()] == [r.text for r in turns.orderBy("conv_id", "turn").collect()]
    later = session.redact_turns_sealed(spark.createDataFrame([(1, 5, "user", "al@example.com or ed@example.com")], turns.schema), EMAIL, provider, session.sealed_conversations(held, provider))
    assert later.first().redacted == "[EMAIL_2] or [EMAIL_3]"
    with pytest.raises(VaultError):
        session.redact_turns_sealed(turns, Redactor({"rules": {"email": "redact"}, "detect_only": True}), provider)


def test_keys_are_in_no_plan(spark, monkeypatch):
    made = []
    real = vault.os.urandom
    monkeypatch.setattr(vault.os, "urandom", lambda n: made.append(real(n)) or made[-1])
    provider = vault.LocalProvider("a phrase nobody should read")
    sealed = vault.seal(spark.createDataFrame([(1, {"[A_1]": "x"})], "id int, map map<string,string>"), provider)
    opened = vault.open_sealed(sealed, provider)
    plans = sealed._jdf.queryExecution().toString() + opened._jdf.queryExecution().toString()
    assert opened.first().map == {"[A_1]": "x"}
    assert len(made) == 2 and not any(k.hex().upper()[:12] in plans.upper() for k in made) and "phrase" not in plans


def test_nested_values_come_back_as_they_were(spark):
    df = spark.sql("""SELECT 1 AS id, struct('jo@example.com' AS e, timestamp'2024-01-02 03:04:05.123456' AS t, CAST('12345678901234567.89' AS DECIMAL(20, 2)) AS d, X'00FF' AS b, double('NaN') AS n,
      array('x', '8.8.4.4', NULL) AS a, map('k', 'jo@example.com', 'token', 'zz') AS m, map('secret', 5, 'b', 6) AS i, CAST(NULL AS STRUCT<a: STRING>) AS z, array(struct('jo@example.com' AS e, 3 AS n), NULL) AS s, 77 AS password) AS r
      UNION ALL SELECT 2, NULL""")
    got = {x.id: x.r for x in structured.redact_nested(df, EMAIL).collect()}
    was = df.where("id = 1").first().r
    r = got[1]
    assert got[2] is None and r.e == "[EMAIL]" and (r.t, r.d, r.b) == (was.t, was.d, was.b) and r.n != r.n and r.a == was.a and r.z is None
    assert r.m == {"k": "[EMAIL]", "token": "[REDACTED]"} and r.i == {"secret": None, "b": 6} and r.s[0].e == "[EMAIL]" and r.s[0].n == 3 and r.s[1] is None and r.password == "[REDACTED]"
    same = structured.redact_nested(df, Redactor({"rules": {"us_ssn": "redact"}}), ["r"]).where("id = 1").first().r
    assert same.e == was.e and same.t == was.t and same.d == was.d


def test_batches_are_asked_once(spark):
    texts = spark.createDataFrame([(k, f"CASE-{k:04d} by Priya") for k in range(40)] + [(99, None)], "id int, text string").coalesce(1)
    ask = CustomDetector("case_no", "CASE-[0-9]{4}", confirm=lambda value, before, after: {"candidate": value})
    scorer = lambda asked: [1.0 if len(asked) == 40 and q["candidate"].endswith("7") else 0.0 for q in asked]
    done = Redactor(Policy(rules={"case_no": "redact"}, detectors=(ask,), semantic=Semantic(scorer)))
    got = {r.id: r.x for r in texts.select("id", done.redact_confirmed(F.col("text")).alias("x")).collect()}
    assert got[7].text == "[CASE_NO] by Priya" and got[8].text == "CASE-0008 by Priya" and got[99].text is None

    def broken(asked):
        raise OSError

    kept = Redactor(Policy(rules={"case_no": "redact"}, detectors=(ask,), semantic=Semantic(broken)))
    got = {r.id: r.x for r in texts.select("id", kept.redact_confirmed(F.col("text")).alias("x")).collect()}
    assert got[8].text == "[CASE_NO] by Priya" and got[8].warnings == ["semantic confirmation failed: OSError"] and got[99].warnings == []

    def people(asked):
        return [[(t.index("Priya"), t.index("Priya") + 5)] for t in asked]

    named = Redactor(Policy(rules={"person_name": "redact"}, recogniser=people))
    assert {r.x for r in texts.select(named.redact(F.col("text")).alias("x")).where("x is not null").limit(3).collect()} <= {f"CASE-{k:04d} by [PERSON_NAME]" for k in range(40)}


@pytest.mark.parametrize(
    "config, path",
    [
        ({"presets": "pii"}, "presets"), ({"presets": [""]}, "presets"), ({"rules": []}, "rules"), ({"custom_presets": {"Bad Name": {}}}, "custom_presets"), ({"custom_presets": {"own": {"email": {"action": "x"}}}}, "custom_presets"),
        ({"restore": "yes"}, "restore"), ({"detect_only": True, "restore": True}, "detect_only"), ({"max_input": 0}, "limits"), ({"max_input": True}, "limits"), ({"allowlist": "a"}, "allowlist"), ({"allowlist": [1]}, "allowlist"),
        ({"custom_headers": [""]}, "custom_headers"), ({"semantic": {}}, "semantic"), ({"semantic": Semantic(None)}, "semantic.scorer"), ({"semantic": Semantic(print, {"email": 2})}, "semantic.thresholds"), ({"semantic": Semantic(print, {}, 0)}, "semantic.context_window"),
        ({"detectors": [CustomDetector("email", "x")]}, "detectors"), ({"detectors": [CustomDetector("own", "x", left=70_000, max_match=1)]}, "detectors"), ({"nothing": 1}, "config"),
    ],
)
def test_wrong_settings(config, path):
    with pytest.raises(RedactionError) as x:
        Redactor({"rules": {"email": "redact"}} | config)
    assert (x.value.code, x.value.path) == ("INVALID_CONFIG", path)


def test_configurations(tmp_path):
    (tmp_path / "redactory.config.jsonc").write_text('{ // a comment\n "rules": {"email": "mask"}, /* more */ "allowlist": ["http://x"],}')
    (tmp_path / "redactory.config.toml").write_text('[rules]\nemail = "mask"')
    (tmp_path / "redactory.config.py").write_text('def config():\n    return {"rules": {"email": "mask"}}')
    for name in ("jsonc", "toml", "py"):
        assert cli.load_config(tmp_path / f"redactory.config.{name}")["rules"] == {"email": "mask"}
    assert cli.load_config(tmp_path / "redactory.config.jsonc")["allowlist"] == ["http://x"]
    (deep := tmp_path / "a" / "b").mkdir(parents=True)
    assert cli.find_config(deep) == tmp_path / "redactory.config.py"
    (tmp_path / "redactory.config.json").write_text("[]")
    with pytest.raises(RedactionError):
        cli.load_config(tmp_path / "redactory.config.json")


def test_standard_input(monkeypatch, capsys, tmp_path):
    said = "I am jo@example.com, " * 9000
    monkeypatch.setattr(cli.sys, "stdin", io.StringIO(said))
    assert cli.main(["redact", "-", "-", "--rule", "email:redact", "--no-config"]) == 0
    assert capsys.readouterr().out == said.replace("jo@example.com", "[EMAIL]")
    monkeypatch.setattr(cli.sys, "stdin", io.StringIO("I am jo@example.com"))
    out = tmp_path / "out.txt"
    cli.main(["redact", "-", str(out), "--rule", "email:redact", "--no-config", "--restore"])
    assert out.read_text() == "I am [EMAIL_1]"
    monkeypatch.setattr(cli.sys, "stdin", io.StringIO(out.read_text()))
    cli.main(["restore", "-", "-", "--map", f"{out}.map.json"])
    assert capsys.readouterr().out == "I am jo@example.com"
    monkeypatch.setattr(cli.sys, "stdin", io.StringIO("I am jo@example.com"))
    cli.main(["inspect", "-", "--rule", "email:redact", "--no-config"])
    assert json.loads(capsys.readouterr().out) == {"rule_id": "email", "start": 5, "end": 19, "value": "jo@example.com"}


def test_inspection_is_whole(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("jo@example.com " * 1500)
    cli.main(["inspect", str(tmp_path / "in.txt"), "--rule", "email:redact", "--no-config"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 1501


def test_name_lists(spark, tmp_path):
    (tmp_path / "names.txt").write_text("SMITH          1.006  1.006      1\nO'Neil 0.1\n\nPriya\n")
    known = files.read_names(spark, str(tmp_path / "names.txt"))
    assert known == {"smith", "o'neil", "priya"}
    with pytest.raises(RedactionError):
        files.read_names(spark, str(tmp_path / "names.txt"), most=2)
    r = Redactor({"rules": {"person_name_lite": "redact"}, "names": known})
    assert spark.createDataFrame([("met Priya Anand",)], "t string").select(r.redact(F.col("t"))).first()[0] == "met [PERSON_NAME]"


def test_shared_restores():
    one = session.Shared(EMAIL, by_value=True, given={"[EMAIL_4]": "al@example.com", "odd": "x"})
    assert one.redact("al@example.com jo@example.com") == "[EMAIL_4] [EMAIL_5]" and one.restore("[EMAIL_5]") == "jo@example.com"
    assert one.redact_value({"a": ["jo@example.com"], "session": "s"}) == {"a": ["[EMAIL_5]"], "session": "[REDACTED]"}
    stream = one.stream()
    assert stream.push("to [EMA") + stream.push("IL_4]") + stream.flush() == "to al@example.com"
