"""Command line: redact, inspect, restore, list-detectors, list-presets over files that Spark reads.

    spark-submit -m redactory.sources.cli redact IN OUT --preset pii --rule email:mask --restore
    tail -f log | python -m redactory.sources.cli redact - - --preset security
"""

from __future__ import annotations

import argparse
import contextlib
import json
import re
import runpy
import sys
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.detectors import PRESETS, preset
from redactory.operators.redact import Redactor, describe, restored, restored_text, scan
from redactory.plans.errors import RedactionError
from redactory.plans.policy import OFF, Policy
from redactory.streaming import redact as streams

from . import files

CONFIGS = ("redactory.config.py", "redactory.config.toml", "redactory.config.json", "redactory.config.jsonc")
STDIN = "-"
CHUNK = 65_536
ACTIONS = ("redact", "mask", "remove", "format-preserve", "token-replace", OFF)


def rule_flag(value: str) -> tuple[str, str]:
    """id:action"""
    rule, colon, action = value.partition(":")
    if not colon or not rule or action not in ACTIONS:
        raise argparse.ArgumentTypeError(f"{value!r}: expected ID:ACTION, with one of {', '.join(ACTIONS)}")
    return rule, action


def find_config(begin: Path) -> Path | None:
    """The nearest configuration file here or above."""
    return next((p / name for p in (begin, *begin.parents) for name in CONFIGS if (p / name).exists()), None)


def load_config(path: Path) -> dict:
    """A configuration file: JSON, with comments in .jsonc, TOML, or Python that defines ``config``, a dictionary or a function that gives one."""
    if path.suffix == ".py":
        found = runpy.run_path(str(path)).get("config")
        found = found() if callable(found) else found
    elif path.suffix == ".toml":
        found = tomllib.loads(path.read_text())
    else:
        # Strings pass as they are, comments and commas before a closing bracket go.
        text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", path.read_text(), flags=re.S) if path.suffix == ".jsonc" else path.read_text()
        text = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text) if path.suffix == ".jsonc" else text
        found = json.loads(text)
    if not isinstance(found, dict):
        raise RedactionError("INVALID_CONFIG", str(path))
    return found


def merged(base: dict, presets: list[str], rules: list[tuple[str, str]], allow: list[str], restore: bool | None, most: int | None) -> Policy:
    """Flags over a configuration: presets are added, rules win, allowlists join."""
    config = dict(base)
    config["presets"] = tuple([*base.get("presets", ()), *presets])
    config["rules"] = {**base.get("rules", {}), **dict(rules)}
    config["allowlist"] = tuple([*base.get("allowlist", ()), *allow])
    if restore is not None:
        config["restore"] = restore
    if most is not None:
        config["max_input"] = most
    return Policy.of(config)


def inspection(df: DataFrame, redactor: Redactor) -> DataFrame:
    """Detections as a table to show: values over 40 characters are clipped."""
    groups = df.select("path", F.explode(redactor.inspect(F.col("text"))).alias("g"))
    rows = groups.select("path", "g.replacement", F.explode("g.matches").alias("m")).select("path", "m.rule_id", "m.entity_type", "m.value", "m.start", "m.end", "replacement", "m.reasons")
    return rows.withColumn("value", F.when(F.length("value") > 40, F.concat(F.substring("value", 1, 37), F.lit("..."))).otherwise(F.col("value")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="redactory")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("redact", "inspect", "restore"):
        v = verbs.add_parser(verb)
        v.add_argument("input")
        if verb != "inspect":
            v.add_argument("output")
            v.add_argument("--force", action="store_true")
        if verb != "redact":
            v.add_argument("--map")
        v.add_argument("--preset", action="append", default=[])
        v.add_argument("--rule", action="append", default=[], type=rule_flag)
        v.add_argument("--allow", action="append", default=[])
        v.add_argument("--allow-file")
        v.add_argument("--config")
        v.add_argument("--no-config", action="store_true")
        v.add_argument("--restore", action=argparse.BooleanOptionalAction, default=None)
        v.add_argument("--max-input", type=int)
        v.add_argument("--json", action="store_true")
    verbs.add_parser("list-detectors")
    verbs.add_parser("list-presets")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if getattr(a, "input", None) == STDIN:
        return _piped(a)
    if a.verb == "list-detectors":
        print(*(f"{d['id']}\t{d['replacement']}" for d in describe()), sep="\n")
        return 0
    if a.verb == "list-presets":
        print(*(f"{name}\t{len(preset(name))}" for name in PRESETS), sep="\n")
        return 0
    spark = spark or SparkSession.builder.appName("redactory").getOrCreate()
    texts = files.whole_texts(spark, a.input)
    if a.verb == "restore":
        maps = files.read_map(spark, a.map or f"{a.input}.map.json", "path", "string").withColumnRenamed("path", "p")
        done = texts.join(maps, F.substring_index("path", "/", -1) == F.substring_index("p", "/", -1), "left")
        files.write_texts(done.select(restored(F.col("text"), F.coalesce("map", F.create_map().cast("map<string,string>"))).alias("text")), a.output, a.force)
        return 0
    found = None if a.no_config else Path(a.config) if a.config else find_config(Path.cwd())
    base = load_config(found) if found else {}
    allow = [*a.allow, *(files.allowlist_values(spark, a.allow_file) if a.allow_file else ())]
    redactor = Redactor(merged(base, a.preset, a.rule, allow, a.restore, a.max_input))
    if a.verb == "inspect":
        rows = inspection(texts, redactor)
        if a.json:
            print(*(r.value for r in rows.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator()), sep="\n")
        else:
            print(*rows.columns, sep="\t")
            for r in rows.toLocalIterator():  # as many as there are, a partition at a time
                print(*(json.dumps(x, ensure_ascii=False) if isinstance(x, list | str) else x for x in r), sep="\t")
        return 0
    done = texts.select("path", redactor.redact(F.col("text")).alias("r"))
    if redactor.policy.restore:
        files.write_map(done.select("path", "r.map"), f"{a.output}.map.json", "path", a.force)
        done = done.select("r.text")
    else:
        done = done.select(F.col("r").alias("text"))
    files.write_texts(done, a.output, a.force)
    return 0


def _piped(a: argparse.Namespace) -> int:
    """Standard input to standard output in this process: redacted in chunks as it comes, inspected or restored as a whole."""
    if a.verb == "restore":
        with open(a.map, encoding="utf-8") as file:
            rows = [json.loads(line) for line in file]
        sys.stdout.write(restored_text(sys.stdin.read(), {r["placeholder"]: r["original"] for r in rows}))
        return 0
    found = None if a.no_config else Path(a.config) if a.config else find_config(Path.cwd())
    allow = [*a.allow, *([x.strip() for x in Path(a.allow_file).read_text().splitlines() if x.strip()] if a.allow_file else ())]
    redactor = Redactor(merged(load_config(found) if found else {}, a.preset, a.rule, allow, a.restore, a.max_input))
    if a.verb == "inspect":
        text = sys.stdin.read()
        for m in scan(redactor.policy, text):
            print(json.dumps({"rule_id": m.rule_id, "start": m.start, "end": m.end, "value": text[m.start : m.end]}, ensure_ascii=False))
        return 0
    out = Path(a.output) if a.output != STDIN else None
    if out and out.exists() and not a.force:
        raise FileExistsError(a.output)
    pieces = iter(lambda: sys.stdin.read(CHUNK), "")
    with open(out, "w", encoding="utf-8") if out else contextlib.nullcontext(sys.stdout) as file:
        for event in streams.events_of(pieces, redactor):
            if event["event_type"] == "text":
                file.write(event["text"])
            elif event["event_type"] == "complete" and event.get("map") and out:
                Path(f"{out}.map.json").write_text("".join(json.dumps({"placeholder": k, "original": v}, ensure_ascii=False) + "\n" for k, v in json.loads(event["map"]).items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
