"""Quality rules, by DataFrame functions alone.

Base rules look at a document by itself: too few words, or too many in repeated eight-word windows.
The method compares it with its language: histograms of character classes and of common words, their
Jensen-Shannon distance to the histograms of all documents of that language that pass the base rules,
and a least length below which a histogram says too little to reject on. One pass over the texts
writes a row of counts per document; references are sums of those rows by language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import WS, documents, text_of, written

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A document of LEAST_JUDGED words or more is rejected beyond one of these distances (0 to 1).
LEAST_JUDGED, CLASS_DISTANCE, WORD_DISTANCE = 60, 0.28, 0.27

# The most common words of each language; other languages are compared by those of English.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit"],
    "fr": ["le", "la", "de", "les", "et", "en", "du", "que"],
    "es": ["el", "los", "de", "la", "que", "y", "en", "las"],
}
CLASSES = ("letter", "upper", "digit", "space", "punctuation", "symbol")


def without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if one has none."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def share(a: Column) -> Column:
        return F.transform(a, lambda x: x / total(a))

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    jsd = total(F.zip_with(share(p), share(q), term))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(jsd, F.lit(0.0))))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row of counts per document."""
    text = F.col("t")
    space = lambda c: without(c, WS)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"), F.when(docs[lang_col].isin(*COMMON_WORDS), docs[lang_col]).otherwise("other").alias("lang"))
    rows = rows.select("*", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"), F.filter(F.split(text, "\n", -1), lambda x: space(x) != "").alias("lines"))
    common = reduce(lambda c, k: c.when(F.col("lang") == k, F.array(*map(F.lit, COMMON_WORDS[k]))), [k for k in COMMON_WORDS if k != "en"], F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array(*map(F.lit, COMMON_WORDS["en"])))
    rows = rows.select("*", F.size("words").alias("n"), common.alias("common"))
    rows = rows.select(
        "id",
        "lang",
        "common",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(text).alias("chars"),
        F.char_length(space(text)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.char_length(text) - F.char_length(without(text, "0123456789"))).alias("digit"),
        (F.char_length(text) - F.char_length(without(text, PUNCTUATION))).alias("punctuation"),
        (F.char_length(text) - F.char_length(without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("upper"),
        F.filter("words", lambda w: F.array_contains("common", F.lower(w))).alias("hits"),
        F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # windows found twice, by sorting; documents without any (nearly all) skip it
    again = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("sorted", F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("sorted", lambda x, k: F.coalesce(F.get("sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    space_n = F.col("chars") - F.col("word_chars")
    letters = F.col("chars") - space_n - F.col("n_symbols") - F.col("digit") - F.col("punctuation") - F.col("upper")
    classes = F.array(*(x.cast("double") for x in (letters, F.col("upper"), F.col("digit"), space_n, F.col("punctuation"), F.col("n_symbols"))))
    per_word = F.transform("common", lambda c: F.size(F.filter("hits", lambda w: F.lower(w) == c)).cast("double"))
    return rows.select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), classes.alias("classes"), F.concat(F.array((F.col("n_words") - F.size("hits")).cast("double")), per_word).alias("common")
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: `id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    Null and empty texts have no words and fail. A null or unknown language is compared with all such
    documents. Null and repeated ids are judged like any others; an empty table gives no rows; further
    columns of `docs` are not looked at.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = written(counts(docs, id_col, text_col, lang_col).withColumn("base_failed", failed), "quality")
    width = {"classes": len(CLASSES), "common": 1 + max(map(len, COMMON_WORDS.values()))}
    sums = rows.where("not base_failed").groupBy("lang").agg(*(F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in width.items() for i in range(n)))
    # one row per known language and one for the rest, whatever the corpus holds
    references = F.broadcast(sums.select(F.col("lang").alias("of"), *(F.array(*(F.col(f"{c}{i}") for i in range(n))).alias(f"all_{c}") for c, n in width.items())))
    rows = rows.join(references, rows.lang == references.of, "left")
    rows = rows.select(rows["*"], js_distance(F.col("classes"), F.col("all_classes")).alias("class_distance"), js_distance(F.col("common"), F.col("all_common")).alias("word_distance"))
    strange = (F.col("n_words") >= LEAST_JUDGED) & ((F.coalesce("class_distance", F.lit(0.0)) > CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_DISTANCE))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~strange).alias("kept"), "class_distance", "word_distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("class_distance", "word_distance")


def _sql() -> str:
    lists = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in COMMON_WORDS.items()}
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lists.items() if k != "en") + f" ELSE {lists['en']} END"
    quoted = PUNCTUATION.replace("'", "''").replace("-", r"\-")
    n = 1 + max(map(len, COMMON_WORDS.values()))
    count = lambda cls: f"len(regexp_replace(t, '[^{cls}]', '', 'g'))"
    js = lambda p, q: (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: "
        + " + ".join(f"CASE WHEN {v} > 0 THEN {v} * log2({v} / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END" for v in (f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"))
        + ")) / 2)) ELSE 0 END"
    )
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {common} AS common FROM d
), h AS (
  SELECT doc_id, i, list_aggregate(words[i:i+7], 'string_agg', ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars,
    {count("0-9")} AS digit, {count(quoted)} AS punctuation, {count("A-Z")} AS upper, words, common FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_transform([word_chars - n_symbols - digit - punctuation - upper, upper, digit, chars - word_chars, punctuation, n_symbols], lambda x: CAST(x AS DOUBLE)) AS classes,
    list_prepend(CAST(len(list_filter(words, lambda x: NOT list_contains(common, lower(x)))) AS DOUBLE), list_transform(common, lambda y: CAST(len(list_filter(words, lambda x: lower(x) = y)) AS DOUBLE))) AS hits FROM c
), a AS (
  SELECT lang, [{', '.join(f'sum(classes[{i + 1}])' for i in range(len(CLASSES)))}] AS all_classes, [{', '.join(f'sum(hits[{i + 1}])' for i in range(n))}] AS all_hits FROM f WHERE NOT base_failed GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {LEAST_JUDGED} AND a.lang IS NOT NULL AND ({js('classes', 'all_classes')} > {CLASS_DISTANCE} OR {js('hits', 'all_hits')} > {WORD_DISTANCE})) AS kept
FROM f LEFT JOIN a USING (lang)
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": _sql()}
