"""Quality of detection against labelled spans: a full outer join of expected and actual, counts by rule, and a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["case_id", "rule_id", "start", "end"]


def outcomes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every expected or actual span once: outcome tp, fn or fp."""
    a = expected.select(*KEYS).distinct().withColumn("e", F.lit(True))
    b = actual.select(*KEYS).distinct().withColumn("a", F.lit(True))
    return a.join(b, KEYS, "full_outer").select(*KEYS, F.when(F.col("e") & F.col("a"), "tp").when(F.col("e"), "fn").otherwise("fp").alias("outcome"))


def metrics(found: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall by rule, with one row (rule_id null) over all rules, and the mean over rules."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    rows = found.rollup("rule_id").agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    return rows.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))


def macro(by_rule: DataFrame) -> DataFrame:
    return by_rule.where("rule_id is not null").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def false_positive_rate(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Share of negative cases with any detection."""
    negative = cases.where("kind = 'negative'").select("case_id")
    hit = found.where("outcome = 'fp'").select("case_id").distinct().withColumn("hit", F.lit(1))
    return negative.join(hit, "case_id", "left").agg(F.count("*").alias("negatives"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("rate"))


def gate(cases: DataFrame, found: DataFrame, baseline: DataFrame | None = None, negatives: int = 1000, positives: int = 200, precision: float = 0.99, recall: float = 0.95) -> list[str]:
    """Why a release may not go out; empty if it may. One row a rule comes to the driver."""
    out = []
    if cases.where("kind = 'negative'").count() < negatives:
        out.append(f"fewer than {negatives} negative cases")
    rows = {r["rule_id"]: r for r in metrics(found).where("rule_id is not null").collect()}
    for rule, r in sorted(rows.items()):
        if r["tp"] + r["fn"] < positives:
            out.append(f"{rule}: fewer than {positives} positives")
        if r["precision"] < precision or r["recall"] < recall:
            out.append(f"{rule}: precision {r['precision']:.3f}, recall {r['recall']:.3f}")
    if baseline is not None:
        for old in baseline.where("rule_id is not null").collect():
            new = rows.get(old["rule_id"])
            if new is None or new["precision"] < old["precision"] or new["recall"] < old["recall"]:
                out.append(f"{old['rule_id']}: worse than the baseline")
    return out
