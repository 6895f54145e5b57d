"""Spelling variants: words that differ by one inserted, deleted or replaced letter, by range reporting.

Words of one length stand in two orders: forward, where a shared prefix is an interval, and by their
reversed letters, where a shared suffix is one. A word that differs from w at position i alone lies in
the rectangle of w's prefix before i and w's suffix after i. A wavelet tree over the words in forward
order, holding their ranks in reverse order, reports the words of a rectangle in time that follows
their number. Insertions and deletions look from words of one length into the next.

Groups begin as all words of a length, with all edit positions. A group of more words than GROUP is
halved by edit position: words differing in the first half of the positions agree in the second half
and the other way round, so each half's words are grouped anew by what they agree in. That repeats
until groups are small or one position is left, where a group holds no more words than the alphabet has
letters. Words that differ within a range of positions agree outside of it, so groups of one length and
range can be searched together: small ones share a task's tree. Each word leaves it with a count and its
best neighbour, not with a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import documents, free_memory, text_of, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS, LEAST_COUNT, SLIP = 5, 3, 97
#: Words of one group, at most, while it has more than one edit position; words of the groups that are searched together, about.
GROUP, TOGETHER = 20_000, 5_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WaveletTree:
    """A permutation of 0 .. m - 1; reports the values of many rectangles at once."""

    def __init__(self, values: np.ndarray) -> None:
        m = len(values)
        self.bits = max(1, int(m - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # by level, at p: zeros before p
        now = values.astype(np.int64)
        for level in reversed(range(self.bits)):
            bit = (now >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every value in [low, high) at a place in [start, end), for arrays of queries."""
        q = np.flatnonzero((start < end) & (low < high))
        s, e, base = start[q], end[q], np.zeros(len(q), np.int64)
        for depth, level in enumerate(reversed(range(self.bits))):
            zeros = self.zeros[depth]
            total = zeros[-1]
            s0, e0 = zeros[s], zeros[e]
            s1, e1 = total + s - s0, total + e - e0
            upper = base + (1 << level)
            left = (s0 < e0) & (low[q] < upper)  # values from base to upper - 1
            right = (s1 < e1) & (high[q] > upper)  # values from upper
            left &= high[q] > base
            right &= low[q] < upper + (1 << level)
            q, s, e, base = np.concatenate((q[left], q[right])), np.concatenate((s0[left], s1[right])), np.concatenate((e0[left], e1[right])), np.concatenate((base[left], upper[right]))
        inside = (base >= low[q]) & (base < high[q])
        return q[inside], base[inside]


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the rows of a and b have in common at their beginning."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Order:
    """Distinct words of one length in the order of their letters."""

    def __init__(self, letters: np.ndarray) -> None:
        m, self.length = letters.shape
        self.rows = np.lexsort(letters.T[::-1])
        self.sorted = np.ascontiguousarray(letters[self.rows])
        self.place = np.empty(m, np.int64)
        self.place[self.rows] = np.arange(m)
        self.common = np.concatenate(([-1], _agreeing(self.sorted[1:], self.sorted[:-1])))

    def intervals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """By place: from where to where words share the first k letters of the word there."""
        breaks = np.flatnonzero(self.common < k)
        ends = np.append(breaks[1:], len(self.rows))
        of = np.cumsum(self.common < k) - 1
        return breaks[of], ends[of]

    def nearest(self, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words shorter by a letter: the place of a word that shares the longest beginning, and its length."""
        have, want = self.sorted.view(f"S{self.length}").ravel(), np.ascontiguousarray(shorter).view(f"S{self.length - 1}").ravel()
        at = np.searchsorted(have, want)
        sides = np.clip(np.stack((at - 1, at)), 0, len(have) - 1)
        common = np.stack([_agreeing(self.sorted[p, :-1], shorter) for p in sides])
        best = common.argmax(axis=0)
        return np.take_along_axis(sides, best[None], 0)[0], np.take_along_axis(common, best[None], 0)[0]


def near_pairs(words: list[bytes], shorter: list[bytes], first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, rows of `words`, whether the former are rows of `shorter`): words of one length and words shorter
    by one letter, near by an edit at a position from `first` to before `last`. A pair comes for one position."""
    length = len(words[0])
    letters = np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)
    ahead, behind = Order(letters), Order(letters[:, ::-1])
    tree = WaveletTree(behind.place[ahead.rows])
    if shorter:
        short = np.frombuffer(b"".join(shorter), np.uint8).reshape(-1, length - 1)
        (ahead_at, ahead_k), (behind_at, behind_k) = ahead.nearest(short), behind.nearest(short[:, ::-1])
    for i in range(first, last):
        (start, end), (low, high) = ahead.intervals(i), behind.intervals(length - 1 - i)
        shared = np.flatnonzero((end - start > 1)[ahead.place] & (high - low > 1)[behind.place])  # a word alone in one order is alone in both
        f, r = ahead.place[shared], behind.place[shared]
        a, rank = tree.report(start[f], end[f], low[r], high[r])
        a, b = shared[a], behind.rows[rank]
        yield a[a != b], b[a != b], False
        if shorter:
            meets = np.flatnonzero((ahead_k >= i) & (behind_k >= length - 1 - i))
            f, r = ahead_at[meets], behind_at[meets]
            a, rank = tree.report(start[f], end[f], low[r], high[r])
            a, b = meets[a], behind.rows[rank]
            if i:  # in a run of equal letters, the first is the one that goes
                once = letters[b, i] != letters[b, i - 1]
                a, b = a[once], b[once]
            yield a, b, True


def _best(batch: pa.Table) -> pa.Table:
    """Of a bucket (words of length `size` and of the next smaller length): per word its near words and the best of them."""
    size, first, last = (batch.column(c)[0].as_py() for c in ("size", "first", "last"))
    word, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
    letters = np.array([w.encode("latin-1") for w in word], object)
    lengths = np.array([len(w) for w in letters])
    long, short = np.flatnonzero(lengths == size), np.flatnonzero(lengths == size - 1)
    count, best = np.zeros(len(word), np.int64), np.full(len(word), -1)
    order = np.lexsort((np.argsort(np.argsort(letters)), -n))  # the largest n first, then the smallest word
    place = np.empty(len(word), np.int64)
    place[order] = np.arange(len(word))
    least = np.full(len(word), len(word))
    if len(long) and len(word) > 1:
        for a, b, is_short in near_pairs(letters[long].tolist(), letters[short].tolist(), first, last):
            a, b = (short if is_short else long)[a], long[b]
            count += np.bincount(a, minlength=len(word))
            np.minimum.at(least, a, place[b])
            if is_short:
                count += np.bincount(b, minlength=len(word))
                np.minimum.at(least, b, place[a])
    some = np.flatnonzero(count)
    best[some] = order[least[some]]
    return pa.table({"word": pa.array([word[i] for i in some], pa.string()), "n_near": pa.array(count[some]), "near": pa.array([word[i] for i in best[some]], pa.string()), "near_n": pa.array(n[best[some]], pa.int64())})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, each 97th (by a checksum of id and run) without one of its letters."""
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_of(docs, text_col), _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h, length = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.char_length("run")
    at = (h % length).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    made = runs.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _agreed(lo: Column, hi: Column) -> Column:
    """What a word keeps outside the edit positions from lo to before hi, in words of length `size` (or one less)."""
    return F.concat(F.substring("word", F.lit(1), lo), F.lit("\n"), F.substring("word", hi + 1 - (F.col("size") - F.char_length("word")), F.col("size")))


def grouped(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(size, first, last, bucket, word, n): every word in the buckets in which an edit can find its near words."""
    now = words.select(F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("size"), "word", "n")
    now = now.withColumns({"first": F.lit(0), "last": F.col("size"), "key": F.lit("\n")})
    columns, done = ["size", "first", "last", "key"], None
    while True:
        now = written(now, "variants")
        large = now.groupBy(*columns).agg(F.count("*").alias("rows")).where((F.col("rows") > most) & (F.col("last") - F.col("first") > 1)).drop("rows")
        large = written(large, "large")
        part = now.join(large, columns, "left_anti")
        done = part if done is None else done.unionByName(part)
        if large.isEmpty():
            break
        mid = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("first").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("last").alias("hi")))).alias("p")
        now = now.join(large, columns, "left_semi").select("size", "word", "n", halves).select("size", "word", "n", F.col("p.lo").alias("first"), F.col("p.hi").alias("last"))
        now = now.withColumn("key", _agreed(F.col("first"), F.col("last")))
    buckets = done.groupBy(*columns[:3]).agg(F.ceil(F.count("*") / TOGETHER).alias("buckets"))
    # a row a length, and one more for each halving of many words: the lengths of distinct words add up to the vocabulary, so there are few
    return done.join(F.broadcast(buckets), columns[:3]).select(*columns[:3], F.pmod(F.xxhash64("key"), F.col("buckets")).cast("int").alias("bucket"), "word", "n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) over links (word, form): the last word that forms lead to, found by doubling steps.

    A form occurs at least twice as often as its word, so no chain is longer than 63 links."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words have at least 5 letters and occur at least 3 times; null and empty texts have none, and an empty
    table gives no rows. Rows that share an id or a text all count; a null id counts as the empty text.
    Ties between near words of equal n go to the smaller in code-point order. Further columns aren't looked at.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    parts = grouped(words, group).groupBy("size", "first", "last", "bucket").applyInArrow(_freed, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # strings compare by code points
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _freed(batch: pa.Table) -> pa.Table:
    out = _best(batch)
    if batch.num_rows > TOGETHER // 2:
        free_memory()
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

#: The checksum is computed here from its table of 256 remainders; near words meet by what is left when a letter goes.
_SQL = f"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
rest AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (
  SELECT run, times, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS b FROM counted),
summed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: x::BIGINT)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, rest),
made AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM summed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cut AS (SELECT DISTINCT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM cut a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word FROM cut a JOIN words w ON a.rest = w.word),
near AS (SELECT p.word, count(*) AS n_near, max(w.n) AS most FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word),
best AS (SELECT p.word, min(p.near) AS form FROM pairs p JOIN words w ON p.near = w.word JOIN near m ON m.word = p.word AND m.most = w.n GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.most >= 2 * w.n THEN b.form END AS form, CASE WHEN m.most >= 2 * w.n THEN m.most END AS form_n FROM words w LEFT JOIN near m USING (word) LEFT JOIN best b USING (word)),
chain(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.here AS root FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN roots USING (word)"""
ORACLE_SQL: dict[str, str] = {"op12_spelling_variants": _SQL}
