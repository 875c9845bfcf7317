"""The relational backend: detection, grouping and redaction as DataFrame expressions and windows, and the same as SQL.

Both forms are made from the detectors' table. Candidates are found by cutting the text at the pattern (gaps and
matches give the offsets); neighbours, keywords and context labels are tested afterwards, as in the Arrow backend.
Rules that need arithmetic on a candidate are here as far as expressions carry it: CHECK_SQL holds their tests in SQL that
Spark and DuckDB share. All rules of a query work in one scan: each gives an array of detections, behind a literal that a
match, label or keyword needs, and what is exploded are detections, never the text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from redactory.functions.checks import CHECKS, NINO_NOT_FIRST, NINO_NOT_SECOND, NINO_SUFFIXES, SPANISH_LETTERS, VIN_VALUES, WEIGHTS
from redactory.functions.detectors import DETECTORS, Detector, portable
from redactory.functions.scan import literals

#: White space in a form that Java, Python and RE2 share.
WHITE = "\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
WORDLIKE = r"[\p{L}\p{M}\p{N}_]"

#: Rules whose check is a weighted sum of the candidate's digits: weights, and what the sum is a multiple of.
WEIGHED = {"us_routing": 10, "pl_pesel": 10, "uk_nhs": 11, "au_tfn": 11, "nl_bsn": 11}


def _int(x: str, at: int, n: int = 2) -> str:
    return f"TRY_CAST(substr({x}, {at}, {n}) AS INT)"


def _dated(x: str, month: int, day: int, *months: tuple[int, int]) -> str:
    """A month of some ranges and a day of the month stand at these places."""
    return "(" + " OR ".join(f"{_int(x, month)} BETWEEN {a} AND {b}" for a, b in months or ((1, 12),)) + f") AND {_int(x, day)} BETWEEN 1 AND 31"


def _sum(x: str, weights: tuple[int, ...], begin: int = 1) -> str:
    return "(" + " + ".join(f"{_int(x, begin + k, 1)} * {w}" for k, w in enumerate(weights) if w) + ")"


def _letter(number: str) -> str:
    return f"substr('{SPANISH_LETTERS}', TRY_CAST({number} AS INT) % 23 + 1, 1)"


_SAME = "'^(?:0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$'"
_RUT = "(" + _sum("lpad(ALL(substr(V, 1, length(V) - 2), '[.]'), 8, '0')", (3, 2, 7, 6, 5, 4, 3, 2)) + " % 11)"
_IRD = "(" + _sum("lpad(N, 9, '0')", WEIGHTS["nz_ird"]) + " % 11)"
_MY_NUMBER = "(" + _sum("N", WEIGHTS["jp_my_number"]) + " % 11)"
_VIN_LETTERS = "".join(c for c in VIN_VALUES if c.isalpha())
_VIN = "(" + _sum(f"translate(V, '{_VIN_LETTERS}', '{''.join(str(VIN_VALUES[c]) for c in _VIN_LETTERS)}')", WEIGHTS["vin"]) + " % 11)"
#: Numbers of different lengths: what is missing counts nothing.
_PADDED = "rpad(N, 11, '0')"
_HAS_DIGIT = "HAS(V, '[0-9]')"
#: Tests in the SQL that both engines share. V is the value, N its digits; LUHN(x), HAS(x, pattern) and ALL(x, pattern), x without all matches, are written by engine.
CHECK_SQL: dict[str, str] = {
    **{r: f"{_sum(_PADDED, WEIGHTS[r])} % {m} = 0" for r, m in WEIGHED.items()},
    **dict.fromkeys(("drivers_license", "hr_recruitment", "hr_screening", "legal_case", "legal_license", "legal_reference"), _HAS_DIGIT),
    **dict.fromkeys(("bh_cpr", "kw_id", "kz_iin", "za_id"), _dated("V", 3, 5)),
    "bg_egn": _dated("V", 3, 5, (1, 12), (21, 32), (41, 52)),
    "ca_sin": "LUHN(N)",
    "cl_rut": f"length(N) + CASE WHEN HAS(V, '[Kk]$') THEN 1 ELSE 0 END BETWEEN 8 AND 9 AND upper(substr(V, length(V), 1)) = CASE {_RUT} WHEN 0 THEN '0' WHEN 1 THEN 'K' ELSE CAST(11 - {_RUT} AS STRING) END",
    "cz_id": _dated("N", 3, 5, (1, 12), (51, 62)),
    "de_id": "length(V) IN (10, 11)",
    "ec_cedula": f"{_int('V', 1)} BETWEEN 1 AND 24 AND ({_int('V', 3, 1)} <= 6 OR substr(V, 3, 1) = '9')",
    "eg_id": _dated("V", 6, 8),
    "es_dni": f"{_letter('substr(V, 1, 8)')} = upper(substr(V, 9, 1))",
    "eu_vat": f"CASE substr(V, 1, 2) WHEN 'DE' THEN true WHEN 'FR' THEN LUHN(substr(V, 5)) WHEN 'IT' THEN LUHN(substr(V, 3)) WHEN 'NL' THEN {_sum('substr(V, 3, 9)', WEIGHTS['nl_vat'])} % 11 = {_int('V', 13)} ELSE length(V) = 10 OR {_letter('substr(V, 3, 8)')} = substr(V, 11) END",
    "fr_insee": f"97 - TRY_CAST(substr(N, 1, 13) AS BIGINT) % 97 = {_int('N', 14)}",
    "imei": f"LUHN(substr(N, 1, 15)) AND NOT HAS(V, {_SAME})",
    "imsi": f"NOT LUHN(V) AND NOT HAS(V, {_SAME})",
    "ipv4": r"NOT HAS(V, '^(?:0\.0\.0\.0|255\.255\.255\.255)$|^0*10\.|^127\.|^192\.168\.|^172\.0?(?:1[6-9]|2[0-9]|3[01])\.')",
    "jp_my_number": f"{_int('N', 12, 1)} = CASE WHEN {_MY_NUMBER} <= 1 THEN 0 ELSE 11 - {_MY_NUMBER} END",
    "license_plate": f"{_HAS_DIGIT} AND length(V) BETWEEN 2 AND 15",
    "medical_code": "CASE WHEN HAS(V, '^[0-9]{5}$') THEN TRY_CAST(N AS INT) BETWEEN 100 AND 99499 ELSE true END",
    "my_ic": _dated("N", 3, 5),
    "nz_ird": f"length(N) IN (8, 9) AND {_IRD} > 0 AND 11 - {_IRD} = TRY_CAST(substr(N, length(N), 1) AS INT)",
    "payment_card": f"HAS(V, '^(?:[0-9]+|(?:[0-9]{{1,6}} )+[0-9]+|(?:[0-9]{{1,6}}-)+[0-9]+)$') AND length(V) <= 37 AND length(N) BETWEEN 13 AND 19 AND NOT HAS(N, {_SAME}) AND LUHN(N)",
    "pe_ruc": "substr(V, 1, 2) IN ('10', '15', '17', '20')",
    "ro_cnp": f"substr(V, 1, 1) <> '0' AND {_dated('V', 4, 6)}",
    "rs_jmbg": _dated("V", 3, 1),
    "th_id": f"(11 - {_sum('V', WEIGHTS['th_id'])} % 11) % 10 = {_int('V', 13, 1)}",
    "uk_nino": f"NOT HAS(upper(V), '^[{NINO_NOT_FIRST}]|^.[{NINO_NOT_SECOND}]') AND HAS(upper(V), '[{NINO_SUFFIXES}]$')",
    "us_dea": f"{_sum('V', (1,) * 6, 3)} % 10 = {_int('V', 9, 1)}",
    "us_npi": "LUHN('80840' || V)",
    "us_ssn": "NOT HAS(N, '^(?:000|666|9)|^...00|0000$')",
    "vin": f"{_HAS_DIGIT} AND length(replace(V, substr(V, 1, 1), '')) > 0 AND V = upper(V) AND substr(V, 9, 1) = CASE {_VIN} WHEN 10 THEN 'X' ELSE CAST({_VIN} AS STRING) END",
}


def pattern(d: Detector) -> str:
    p = portable(d.pattern, WHITE)
    return ("(?i)" if "i" in d.flags else "") + p


def expressible(d: Detector) -> bool:
    """Whether the rule is whole in expressions that Spark and DuckDB share."""
    if d.id in CHECK_SQL:
        return True
    folded = "(?!" in d.pattern or "(?<" in d.pattern
    return d.kind in ("token", "context", "keyword") and d.id not in CHECKS and not folded and d.id not in ("private_key",)


RULES = tuple(d.id for d in DETECTORS.values() if expressible(d))


def _labels(d: Detector) -> tuple[str, str, str]:
    labels = d.labels.replace("['\\u2019]", "['’]")
    w = r"[^\p{L}\p{M}\p{N}_]"
    return rf"(?i)(?:^|{w}){labels}[ \t]{{0,8}}[:#]?[ \t]{{0,8}}\z", rf"(?i)^[ \t]{{1,8}}\({labels}\)", rf"(?i)^[ \t]{{1,8}}{labels}(?:{w}|\z)"


def spans(text: Column, p: str) -> Column:
    """All matches of a pattern in order: start (code points, from 0), end and value."""
    values = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.split(text, p, -1)
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        b = a + F.length(x["v"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["v"].alias("value")))).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["v"].isNotNull()), start, step, lambda acc: acc["out"])


def _written(test: str, engine: str, value: str = "value") -> str:
    """A test of CHECK_SQL in an engine's words, over a column that holds the value."""
    if engine == "spark":
        put = {"LUHN": "luhn_check({0})", "HAS": "{0} RLIKE r{1}", "ALL": "regexp_replace({0}, {1}, '')"}
    else:
        digit = "reverse({0})[i]::INT"
        put = {
            "LUHN": f"(list_sum(list_transform(range(1, len({{0}}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} ELSE (2 * {digit}) // 10 + (2 * {digit}) % 10 END)) % 10 = 0)",
            "HAS": "regexp_matches({0}, {1})",
            "ALL": "regexp_replace({0}, {1}, '', 'g')",
        }
    while m := re.search(r"\b(LUHN|HAS|ALL)\(", test):
        depth, end, quoted = 1, m.end(), False
        while depth:
            quoted ^= test[end] == "'"
            depth += 0 if quoted else {"(": 1, ")": -1}.get(test[end], 0)
            end += 1
        first, _, second = test[m.end() : end - 1].rpartition(", ") if m[1] != "LUHN" else (test[m.end() : end - 1], "", "")
        test = test[: m.start()] + "(" + put[m[1]].format(first, second) + ")" + test[end:]
    return re.sub(r"\bV\b", value, re.sub(r"\bN\b", lambda _: "(" + put["ALL"].format(value, "'[^0-9]'") + ")", test))


#: Pieces to each side of a candidate that its context is put together from: values have a character at least, so they suffice.
PIECES = 81


def _raw(pattern: str) -> str:
    """A pattern as a literal of Spark SQL that needs no escapes."""
    assert '"' not in pattern
    return f'r"{pattern}"'


def _pieces(d: Detector, t: Column) -> Column:
    """The text cut at the rule's pattern: gap, match, gap, match and so on; nothing where it cannot hold a detection."""
    p = pattern(d)
    worth = t.rlike(p)
    if d.labels:
        worth = t.rlike("(?i)" + d.labels) & worth
    elif d.keywords:
        worth = reduce(lambda a, b: a | b, [F.lower(t).contains(k.lower()) for k in d.keywords]) & worth
    if d.kind in ("token", "capture") and "i" not in d.flags and (held := literals(d.pattern)):
        worth = reduce(lambda a, b: a | b, [t.contains(x) for x in held]) & worth
    both = F.zip_with(F.split(t, p, -1), F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))
    return F.when(worth, F.flatten(both))


def _survivors(d: Detector, pieces: str) -> str:
    """SQL of a rule's detections in a text's pieces. Context is taken from the pieces beside a candidate, offsets are summed for detections alone, so long texts cost in proportion."""
    before = f"right(array_join(slice({pieces}, greatest(1, 2 * k - {PIECES}), least(2 * k - 1, {PIECES})), ''), {max(d.left, 1)})"
    after = f"left(array_join(slice({pieces}, 2 * k + 1, {PIECES}), ''), {max(d.right, 1)})"
    tests = [f"NOT concat(right(x.before, 1), ' ', left(x.after, 1)) RLIKE {_raw(WORDLIKE)}"]
    if d.id in CHECK_SQL:
        tests.append("(" + _written(CHECK_SQL[d.id], "spark", "x.value") + ")")
    if d.labels:
        a, b, c = map(_raw, _labels(d))
        tests.append(f"(x.before RLIKE {a} OR x.after RLIKE {b} OR x.after RLIKE {c})")
    if d.keywords:
        tests.append("(" + " OR ".join(f"contains(lower(concat(x.before, x.after)), '{k.lower()}')" for k in d.keywords) + ")")
    found = f"filter(transform(sequence(1, size({pieces}) div 2 - 1), k -> named_struct('k', k, 'value', {pieces}[2 * k - 1], 'before', {before}, 'after', {after})), x -> {' AND '.join(tests)})"
    at = f"aggregate(slice({pieces}, 1, 2 * y.k - 1), 0, (n, z) -> n + length(z))"
    return f"CASE WHEN size({pieces}) > 2 THEN transform({found}, y -> named_struct('rule_id', '{d.id}', 'start', {at}, 'value', y.value)) END"


def detect_all(df: DataFrame, rules: tuple[str, ...], key: str, text: str = "text") -> DataFrame:
    """key, rule_id, start, end, value of all detections of some rules: one scan, which only detections leave."""
    t = F.col(text)
    cut = df.where(t.isNotNull()).select(F.col(key).alias("__key"), *[_pieces(DETECTORS[r], t).alias(f"__{r}") for r in rules])
    none = F.expr("cast(array() as array<struct<rule_id:string,start:int,value:string>>)")
    found = cut.select("__key", F.explode(F.concat(*[F.coalesce(F.expr(_survivors(DETECTORS[r], f"`__{r}`")), none) for r in rules])).alias("d"))
    return found.select(F.col("__key").alias(key), "d.rule_id", "d.start", (F.col("d.start") + F.length("d.value")).alias("end"), "d.value")


def detect(df: DataFrame, rule: str, key: str, text: str = "text") -> DataFrame:
    """key, rule_id, start, end, value of one rule's detections."""
    return detect_all(df, (rule,), key, text)


def groups(detections: DataFrame, key: str) -> DataFrame:
    """Detections with the span of their group: overlapping spans, directly or through others (gaps and islands)."""
    order = W.partitionBy(key).orderBy("start", "end", "rule_id")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    numbered = detections.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("group", F.sum("new").over(order))
    whole = W.partitionBy(key, "group")
    return numbered.withColumn("group_start", F.min("start").over(whole)).withColumn("group_end", F.max("end").over(whole)).drop("new")


def without_placeholders(detections: DataFrame, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Detections that overlap no bracketed placeholder: an interval anti-join by key."""
    held = df.where(F.col(text).contains("[")).select(F.col(key).alias("k"), F.explode(spans(F.col(text), r"\[[A-Z][A-Z0-9_]*\]")).alias("p"))
    return detections.join(held, (F.col(key) == F.col("k")) & (F.col("start") < F.col("p.end")) & (F.col("p.start") < F.col("end")), "left_anti")


def without_allowed(detections: DataFrame, allow: DataFrame, value: str = "value") -> DataFrame:
    """Detections whose value is on no allowlist: an anti-join that Catalyst broadcasts where the list is small."""
    return detections.join(allow.select(F.col(value).alias("allowed")), F.col("value") == F.col("allowed"), "left_anti")


def redact(df: DataFrame, detections: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and redacted text under plain redaction: one replacement a group, [REDACTED] where its rules differ."""
    named = F.when(F.col("rule_id") == "person_name_lite", "[PERSON_NAME]").otherwise(F.concat(F.lit("["), F.upper("rule_id"), F.lit("]")))
    one = groups(detections, key).withColumn("name", named).groupBy(key, "group_start", "group_end").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    one = one.select(key, "group_start", "group_end", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("[REDACTED]").alias("replacement"))
    per = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("group_start", "group_end", "replacement"))).alias("g")).withColumnRenamed(key, "k")
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, g: F.struct(g["group_end"].alias("at"), F.concat(acc["out"], F.substr(t, acc["at"] + 1, g["group_start"] - acc["at"]), g["replacement"]).alias("out"))
    done = F.aggregate("g", start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.length(t))))
    return df.join(per, F.col(key) == F.col("k"), "left").select(key, F.when(F.col("g").isNull(), t).otherwise(done).alias("redacted"))


# The same as SQL for DuckDB. ------------------------------------------------------------------------------------


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_check(d: Detector) -> str:
    return f"({_written(CHECK_SQL[d.id], 'duckdb')})" if d.id in CHECK_SQL else "true"


def sql_detect(rule: str, table: str, key: str, text: str = "text") -> str:
    d = DETECTORS[rule]
    p = _quote(pattern(d))
    tests = [f"NOT regexp_matches(CASE WHEN \"start\" > 0 THEN t[\"start\"] ELSE '' END || ' ' || coalesce(t[\"end\" + 1], ''), {_quote(WORDLIKE)})", _sql_check(d)]
    before, after = f't[greatest("start" - {d.left}, 0) + 1 : "start"]', f't["end" + 1 : "end" + {d.right}]'
    worth = f"regexp_matches({text}, {p})"
    if d.labels:
        worth += f" AND regexp_matches({text}, {_quote('(?i)' + d.labels)})"
        a, b, c = map(_quote, _labels(d))
        tests.append(f"(regexp_matches(CASE WHEN \"start\" = 0 THEN '' ELSE {before} END, {a}) OR regexp_matches({after}, {b}) OR regexp_matches({after}, {c}))")
    if d.keywords:
        tests.append("(" + " OR ".join(f"contains(lower({before}) || lower({after}), {_quote(k.lower())})" for k in d.keywords) + ")")
    return f"""SELECT {key}, '{rule}' AS rule_id, "start"::INT AS "start", "end"::INT AS "end", value FROM (
  SELECT {key}, t, list_sum(list_transform(g[1:i], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0)::INT AS "start",
         list_sum(list_transform(g[1:i], lambda x: length(x)))::INT + list_sum(list_transform(v[1:i], lambda x: length(x)))::INT AS "end", v[i] AS value
  FROM (SELECT {key}, t, g, v, unnest(range(1, len(v) + 1)) AS i FROM (
    SELECT {key}, {text} AS t, string_split_regex({text}, {p}) AS g, regexp_extract_all({text}, {p}) AS v FROM {table} WHERE {worth})))
WHERE {" AND ".join(tests)}"""


def sql_detect_all(rules: tuple[str, ...], table: str, key: str, text: str = "text") -> str:
    return "\nUNION ALL\n".join(sql_detect(r, table, key, text) for r in rules)


def sql_groups(detections: str, key: str) -> str:
    return f"""SELECT {key}, rule_id, "start", "end", value, "group", (min("start") OVER w)::INT AS group_start, (max("end") OVER w)::INT AS group_end FROM (
  SELECT *, (sum(new) OVER (PARTITION BY {key} ORDER BY "start", "end", rule_id))::BIGINT AS "group" FROM (
    SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY {key} ORDER BY "start", "end", rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
    FROM ({detections})))
WINDOW w AS (PARTITION BY {key}, "group")"""


def sql_stitched(pieces: str, table: str, key: str, text: str = "text") -> str:
    """Texts with the groups of ``pieces`` (key, group_start, group_end, r) replaced by r."""
    return f"""
WITH o AS ({pieces}),
s AS (SELECT o.{key}, group_start, group_end, d.{text}[coalesce(lag(group_end) OVER w, 0) + 1 : group_start] || r AS piece FROM o JOIN {table} d ON o.{key} = d.{key} WINDOW w AS (PARTITION BY o.{key} ORDER BY group_start)),
j AS (SELECT {key}, string_agg(piece, '' ORDER BY group_start) AS head, max(group_end) AS at FROM s GROUP BY {key})
SELECT d.{key}, CASE WHEN j.head IS NULL THEN d.{text} ELSE j.head || substring(d.{text}, j.at + 1) END AS redacted FROM {table} d LEFT JOIN j ON d.{key} = j.{key}"""


def sql_entities(detections: str, key: str) -> str:
    """Groups with the entity that a placeholder names: that of their rule, or REDACTED of several."""
    return f"SELECT {key}, group_start, group_end, CASE WHEN count(DISTINCT rule_id) = 1 THEN upper(min(rule_id)) ELSE 'REDACTED' END AS e FROM ({sql_groups(detections, key)}) GROUP BY {key}, group_start, group_end"


def sql_redact(detections: str, table: str, key: str, text: str = "text", numbered: bool = False) -> str:
    """Redaction to bracketed names; numbered by occurrence as restoration does, if asked."""
    n = f" || '_' || row_number() OVER (PARTITION BY {key}, e ORDER BY group_start)" if numbered else ""
    return sql_stitched(f"SELECT {key}, group_start, group_end, '[' || e{n} || ']' AS r FROM ({sql_entities(detections, key)})", table, key, text)
