"""Personal data in texts, by DataFrame functions alone.

Patterns propose spans, checksum validators (Luhn for cards, mod 97 for account numbers) and part
limits confirm them, words near a span raise its score. One pass over the text, no shuffle. A match's
place is found without a Python UDF: the texts between matches come from splitting at the pattern, and
a running sum of their lengths gives code-point offsets. The patterns are written so that each start
is tried once (a match can begin only where a run of its first class begins, or where the last match
ended) and never backtracks, so very long runs cost linear time.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import documents, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Spans of the added kinds are reported from this score on; base kinds are reported always.
LEAST_SCORE, CONTEXT_BONUS, CONTEXT_CHARS = 0.5, 0.3, 40
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit(_ALNUM), F.substr(turned, i, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: Callable[[Column], Column]  # cheap test without which no match can be
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score when they stand shortly before or after


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.6, "mail|contact"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: F.contains(t, F.lit(".")), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.5, "host|addr|server"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", lambda t: F.lit(True), lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)), 0.7, "card|visa|credit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15), 0.5, "tel|phone|call"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", lambda t: F.lit(True), mod97, 0.9, "iban|account"),
    Kind("ssn", r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++", lambda t: F.contains(t, F.lit("-")), lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 0.3, "ssn|social|security"),
)
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _found(kind: Kind, matches: Column, between: Column) -> Column:
    """The confirmed spans of one kind, from its matches and the texts between them."""

    def add(acc: Column, i: Column) -> Column:
        before, match = F.get(between, i), F.get(matches, i)
        start = acc["at"] + F.length(before)
        end = start + F.length(match)
        around = F.concat_ws("\n", F.right(before, F.lit(CONTEXT_CHARS)), F.left(F.get(between, i + 1), F.lit(CONTEXT_CHARS)))
        near = F.lower(around).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        kept = kind.valid(match) if kind.name in BASE_KINDS else kind.valid(match) & (score >= LEAST_SCORE)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, add, lambda acc: acc["out"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, spans array<struct<kind, start, end, score>> by kind as in KINDS, then start.

    start and end are code points, end exclusive. Context is what stands within CONTEXT_CHARS before or after a
    match, up to the next match of its kind. Null and empty texts have no spans; null and repeated
    ids are kept as they are; an empty table gives no rows; further columns of `docs` are not looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.select("id", "text", *(F.when(k.hint(F.col("text")), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, k in enumerate(KINDS)))
    rows = rows.select("id", *(f"m{i}" for i in range(len(KINDS))), *(F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(none).alias(f"b{i}") for i, k in enumerate(KINDS)))
    empty = F.array().cast(_SPANS)
    found = (F.when(F.size(f"m{i}") > 0, _found(k, F.col(f"m{i}"), F.col(f"b{i}"))).otherwise(empty) for i, k in enumerate(KINDS))
    return rows.select(F.col("id").alias(id_col), F.concat(*found).alias("spans"))


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS)))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql() -> str:
    """The same by DuckDB's list functions, with the patterns as the contract has them."""
    digits = "regexp_replace({m}, '[^0-9]', '', 'g')"
    luhn_sql = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * {c} - CASE WHEN {c} > 4 THEN 9 ELSE 0 END ELSE {c} END)) % 10 = 0".replace("{c}", "CAST(substr({d}, CAST(length({d}) - i + 1 AS BIGINT), 1) AS INTEGER)")
    turned = "(substr({m}, 5) || substr({m}, 1, 4))"
    value = f"(instr('{_ALNUM}', substr({turned}, CAST(i AS BIGINT), 1)) - 1)"
    # each letter is two digits; the number fits 128 bits only in parts, so the remainder is folded over the characters
    mod_sql = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length({{m}}) + 1), lambda i: CAST({value} AS BIGINT))), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"
    part = "regexp_matches({m}, '^" + rf"{_PART}(\.{_PART}){{{{3}}}}" + "$')"
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", part),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND " + luhn_sql.replace("{d}", digits)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", mod_sql),
        ("ssn", r"[0-9]+-[0-9]+-[0-9]+", "regexp_matches({m}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') AND regexp_matches(lower(right({b}, 40) || chr(10) || left({a}, 40)), 'ssn|social|security')"),
    )
    sums = "CAST(coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0) AS BIGINT)"
    cols, lists = [], []
    for name, pattern, valid in rules:
        cols.append(f"regexp_extract_all(t, '{pattern}') AS m_{name}, string_split_regex(t, '{pattern}') AS b_{name}")
        check = valid.replace("{{", "{").replace("}}", "}").replace("{m}", f"m_{name}[k]").replace("{b}", f"b_{name}[k]").replace("{a}", f"b_{name}[k+1]")
        start = sums.replace("{x}", f"b_{name}[1:k]") + " + " + sums.replace("{x}", f"m_{name}[1:k-1]")
        lists.append(f"list_transform(list_filter(range(1, len(m_{name}) + 1), lambda k: {check}), lambda k: '{name}:' || ({start}) || ':' || ({start} + length(m_{name}[k]))) AS s_{name}")
    base = "list_concat(" + "list_concat(list_concat(s_email, s_ip), s_card), s_phone)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(cols)} FROM d), s AS (SELECT doc_id, {', '.join(lists)} FROM m)
SELECT doc_id, {', '.join(f'CAST(len(s_{k}) AS BIGINT) AS n_{k}' for k in BASE_KINDS)}, sha256(array_to_string({base}, ',')) AS base_sha256,
  array_to_string(list_concat(list_concat({base}, s_iban), s_ssn), ',') AS spans FROM s
"""


QUERIES = {"op1_pii": op1_pii}
ORACLE_SQL = {"op1_pii": _sql()}
