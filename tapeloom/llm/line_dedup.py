"""Line deduplication by a log-template tree, by DataFrame functions alone.

Lines are sorted into a tree of fixed depth: by their number of tokens, then their two leading tokens.
Tokens with a digit are fields at once. In a leaf, a token is fixed at its position where it stands in
MIN_DOCS of the leaf's lines or more, however many other lines the leaf has; any other word is a
variable field. A line's template is its leaf with the fixed tokens, and fields at the other positions;
it counts where it has more fixed tokens than variable words. Dropped from all documents but the first
(that with the smallest id) are

- lines whose template stands in MIN_DOCS documents or more, and
- lines whose very tokens stand in MIN_COPIES documents or more, whatever their length.

Lines are hashed in the row; each document counts a line once before the shuffle, and counts are
summed on the map side, so a line that every document has moves one row per task. Texts are split once
more for the tokens, which are looked at only in leaves that MIN_DOCS documents reach. Joins on lines,
leaves, tokens and templates are salted by how many rows they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import documents, spread_join, text_of, written

#: Documents that make a template and a literal line boilerplate.
MIN_DOCS, MIN_COPIES = 10, 2
_GAP = r"[\x20\x09-\x0D]+"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda binds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _tokens(line: Column) -> Column:
    # most lines have only spaces between their tokens
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, _GAP)).otherwise(F.split(line, " ")), "")


def _field(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def places(line: Column) -> Column:
    """(lit, leaf): hashes of a line's tokens, and of its number of tokens and two leading tokens; null for a line without tokens."""

    def of(tokens: Column) -> Column:
        leading = F.transform(F.slice(tokens, 1, 2), _field)
        return F.when(F.size(tokens) > 0, F.struct(F.xxhash64(tokens).alias("lit"), F.xxhash64(F.size(tokens), leading).alias("leaf")))

    return _let(_tokens(line), of)


def _documents(hits: DataFrame, key: str, least: int, once: bool = False) -> DataFrame:
    """(key, n, first) of the keys that `least` documents have: n of them, first being the smallest id. A row without an id is a document by its text.
    once: hits have a document's key once."""
    hits = hits if once else hits.select("id", F.when(F.col("id").isNull(), F.col("h")).alias("h"), key).distinct()
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_copies: int = MIN_COPIES) -> DataFrame:
    """One row per input row: `id_col`, text (what stays, lines joined by a line feed), n_lines, n_dropped.

    Null and empty texts are one empty line, which stays, like any line without tokens. Rows without an
    id are counted as documents but keep their lines. Rows that share an id are one document; those that
    repeat a text, too, get the same answer. An empty table gives no rows; further columns of `docs` are not looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    lines = written(rows.select("id", "h", F.transform(F.split("t", "\n", -1), places).alias("of")), "lines")
    single = lines.groupBy("id", F.when(F.col("id").isNull(), F.col("h")).alias("h")).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    each = lambda name: lines.select("id", "h", F.explode(F.array_distinct(F.transform("of", lambda x: x[name]))).alias(name)).where(F.col(name).isNotNull())
    copies = written(_documents(each("lit"), "lit", min_copies, single), "copies")
    every = lines.where("id is not null").select("id", "h", F.posexplode("of").alias("at", "x")).where("x is not null").select("id", "h", "at", "x.lit")
    literal = spread_join(every, copies, "lit", "n", by="id").where("id != first").select("id", "h", "at")

    # the lines of leaves that enough documents reach, with a hash of each token (null for a digit field)
    busy = written(_documents(each("leaf"), "leaf", min_docs, single).drop("first"), "leaves")
    split = rows.select("id", "h", F.posexplode(F.split("t", "\n", -1)).alias("at", "line")).withColumn("leaf", places(F.col("line"))["leaf"]).where("leaf is not null")
    keys = F.transform(_tokens(F.col("line")), lambda w: F.when(~w.rlike("[0-9]"), F.xxhash64(w)))
    tokens = written(spread_join(split, busy, "leaf", "n", by="h").select("id", "h", "at", F.xxhash64("id", "h", "at").alias("ln"), "leaf", keys.alias("keys")), "tokens")

    # of each line its fixed tokens: the key of a token is its leaf, place and word; the leading ones stand in every line of the leaf
    known = lambda ks: F.size(F.filter(ks, lambda k: k.isNotNull()))
    tall = tokens.select("ln", F.explode(F.filter(F.transform("keys", lambda k, i: F.when(k.isNotNull() & (i > 1), F.xxhash64("leaf", i, k))), lambda k: k.isNotNull())).alias("key"))
    fixed = written(tall.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs), "fixed")
    hits = spread_join(tall, fixed, "key", "c", by="ln").groupBy("ln").agg(F.sort_array(F.collect_set("key")).alias("fixed"))
    digits = F.xxhash64(F.size("keys"), F.transform("keys", lambda k, i: F.when(k.isNull(), i)))
    marked = tokens.select("id", "h", "at", "ln", known(F.col("keys")).alias("words"), known(F.slice("keys", 1, 2)).alias("leading"), F.xxhash64("leaf", digits).alias("shape")).join(hits, "ln", "left")
    n = F.size(F.coalesce("fixed", F.array().cast("array<long>")))
    apt = marked.where(2 * (n + F.col("leading")) > F.col("words"))
    templates = written(apt.select("id", "h", "at", F.xxhash64("shape", "fixed").alias("template")), "marked")
    common = written(_documents(templates, "template", min_docs), "templates")
    variant = spread_join(templates.where("id is not null"), common, "template", "n", by="id").where("id != first").select("id", "h", "at")

    drop = literal.unionByName(variant).groupBy("id", "h").agg(F.collect_set("at").alias("drop"))
    out = rows.join(drop, ["id", "h"], "left")
    out = out.select("id", F.split("t", "\n", -1).alias("lines"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))  # by hash, in order
    kept = F.when(F.size("drop") > 0, F.transform(stays, lambda i: F.get("lines", i))).otherwise(F.col("lines"))
    return out.select(F.col("id").alias(id_col), F.concat_ws("\n", kept).alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, pos, lines[pos] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM d)),
k AS (SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM l),
w AS (SELECT *, len(raw) AS n, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN NULL ELSE t END) AS w FROM k WHERE len(raw) > 0),
copies AS (SELECT raw, min(doc_id) AS first FROM w GROUP BY raw HAVING count(DISTINCT doc_id) >= {MIN_COPIES}),
leaves AS (SELECT n, w[1:2] AS head FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
b AS (SELECT doc_id, pos, w.n, w.w, w.w[1:2] AS head FROM w JOIN leaves ON w.n = leaves.n AND w.w[1:2] IS NOT DISTINCT FROM leaves.head),
t AS (SELECT doc_id, pos, n, head, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM b),
f AS (SELECT n, head, i, word FROM t WHERE word IS NOT NULL GROUP BY n, head, i, word HAVING count(*) >= {MIN_DOCS}),
m AS (
  SELECT doc_id, pos, t.n, t.head, list(CASE WHEN t.word IS NULL THEN '<0>' WHEN f.word IS NULL THEN '<*>' ELSE '=' || t.word END ORDER BY t.i) AS template,
    count(f.word) AS fixed, count(*) FILTER (WHERE t.word IS NOT NULL AND f.word IS NULL) AS fields
  FROM t LEFT JOIN f ON t.n = f.n AND t.i = f.i AND t.word = f.word AND t.head IS NOT DISTINCT FROM f.head GROUP BY doc_id, pos, t.n, t.head
), a AS (SELECT doc_id, pos, template FROM m WHERE fixed > fields),
c AS (SELECT template, min(doc_id) AS first FROM a GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
x AS (SELECT doc_id, pos FROM w JOIN copies USING (raw) WHERE doc_id <> first UNION SELECT doc_id, pos FROM a JOIN c USING (template) WHERE doc_id <> first),
y AS (SELECT doc_id, list(pos) AS dropped FROM x GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(CASE WHEN dropped IS NULL THEN lines ELSE list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(dropped, i)), lambda i: lines[i]) END, chr(10)), '')) AS text_sha256
FROM d LEFT JOIN y USING (doc_id)
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL = {"op5_line_dedup": OP5_SQL}
