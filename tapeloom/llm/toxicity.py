"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed rows for the word and two prefixes of it, so rare inflections
share what is learnt about their stem. Filters of widths 1, 2 and 3 slide over the embedded text, max
pooling keeps each filter's best window, a logistic unit reads those maxima. Training (Adagrad, on a
bounded sample of labelled rows) back-propagates through the best windows alone. Scores are calibrated
by language: the language is read from the text's own function words, and each has an offset chosen on
labelled rows set aside, so that 0.5 is the decision for all of them.

Scoring is one Arrow map without a shuffle over whole texts. Each word's filter responses are computed
once a worker and kept in a table of bounded size; a document is then gathered, added and pooled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import documents, free_memory, text_of, written

#: Labelled rows that are learnt from at most, those with the smallest hash of their id; and bytes of text they may have together.
SAMPLE, SAMPLE_BYTES = 6000, 48 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 12, 48, 0.15, 7
#: Small samples are gone over more often, up to this many updates.
UPDATES, MOST_EPOCHS = 1200, 80
PAD = max(WIDTHS) - 1

# Function words by which a language is told from a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he this are or his from at which",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "le la les et des en un du une que est pour qui dans par plus pas au sur ne se avec il ce",
    "es": "el los y del las por con no una su para es al lo como más pero sus le ya o este sí porque",
}
LANGUAGES = ("", *FUNCTION_WORDS)
_LANGUAGE_OF = {w.encode(): LANGUAGES.index(k) for k, ws in reversed(FUNCTION_WORDS.items()) for w in ws.split()}
_SPLIT = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPLIT).split()


def buckets_of(word: bytes) -> tuple[int, int, int]:
    """Rows of the embedding for a word and its prefixes of 4 and 6 bytes; row 0 is the padding."""
    h = xxhash.xxh3_64_intdigest
    return tuple(1 + h(x) % (BUCKETS - 1) for x in (word, b"4" + word[:4], b"6" + word[:6]))


def language_of(words: list[bytes]) -> int:
    n = [0] * len(LANGUAGES)
    for w in words:
        if (k := _LANGUAGE_OF.get(w)) is not None:
            n[k] += 1
    return max(range(len(n)), key=n.__getitem__) if any(n) else 0


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    weight: np.ndarray
    intercept: float
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """What words add to each filter at each place in it: (words, sum of widths * FILTERS)."""
        x = self.embedding[rows].sum(1)
        return np.concatenate([x @ self.filters[w][j] for w in WIDTHS for j in range(w)], 1).astype(np.float32)


def _windows(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per width, the filters' values where windows begin at a word; x as Model.responses, PAD zero rows after every text."""
    n, out, at = len(x) - PAD, [], 0
    valid = np.zeros(len(x) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends, -1)
    hidden = np.flatnonzero(np.cumsum(valid)[:n] == 0)
    for w in WIDTHS:
        c = x[:n, at : at + FILTERS].copy()
        for j in range(1, w):
            c += x[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
        c[hidden] = -1e9
        out.append(c)
        at += w * FILTERS
    return out


def _layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of texts laid one after another with PAD rows after each; an empty text has one padding word."""
    n = np.maximum(np.array(lengths, np.int64), 1)
    starts = np.concatenate(([0], np.cumsum(n + PAD)[:-1]))
    return starts, starts + n


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Fits on four fifths of the texts, calibrates by language on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    # a text is the numbers of its words, which the table turns into rows of the embedding; word 0 is the padding
    number: dict[bytes, int] = {}
    rows = {}
    for d in sorted(fit.tolist()):
        ws = words_of(texts[d])
        rows[d] = np.fromiter((number.setdefault(w, len(number) + 1) for w in ws), np.int32, len(ws)) if ws else np.zeros(1, np.int32)
    table = np.array([(0, 0, 0), *map(buckets_of, number)], np.int32)
    number.clear()
    m = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        {w: rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        np.abs(rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS)).astype(np.float32),
        -1.0,
    )
    m.embedding[0] = 0
    squares = {"e": np.full(BUCKETS, 0.05, np.float32), "b": np.full_like(m.bias, 0.1), "v": np.full_like(m.weight, 0.1), "c": 0.1} | {w: np.full_like(f, 0.1) for w, f in m.filters.items()}
    positive = float(np.clip((labels[fit] == 0).sum() / max(1, labels[fit].sum()), 1, 5))

    def step(name, value, grad):
        squares[name] += grad * grad
        value -= RATE * grad / np.sqrt(squares[name])
        return value

    epochs = max(epochs, min(MOST_EPOCHS, UPDATES * BATCH // max(1, len(fit))))
    for _ in range(epochs if len(fit) else 0):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            docs = fit[at : at + BATCH]
            y = labels[docs].astype(np.float32)
            starts, ends = _layout([len(rows[d]) for d in docs])
            words = np.zeros(ends[-1] + PAD, np.int32)
            for d, s, e in zip(docs, starts, ends):
                words[s:e] = rows[d]
            ids = table[words]
            x = m.embedding[ids].sum(1)
            best = []
            pooled = np.empty((len(docs), len(m.bias)), np.float32)
            parts = np.concatenate([x @ m.filters[w][j] for w in WIDTHS for j in range(w)], 1)
            for k, c in enumerate(_windows(parts, starts, ends)):
                arg = np.array([s + c[s:e].argmax(0) for s, e in zip(starts, ends)])
                best.append(arg)
                pooled[:, k * FILTERS : (k + 1) * FILTERS] = np.take_along_axis(c, arg, 0)
            pre = pooled + m.bias
            act = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.weight + m.intercept, -30, 30)))
            dz = (p - y) * np.where(y > 0, positive, 1) / len(docs)
            da = dz[:, None] * m.weight * (pre > 0)
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                d = da[:, k * FILTERS : (k + 1) * FILTERS]
                gf = np.empty_like(m.filters[w])
                for j in range(w):
                    at_j = best[k] + j
                    gf[j] = np.einsum("bfd,bf->df", x[at_j], d)
                    g = d[:, :, None] * m.filters[w][j].T[None]
                    touched.append(ids[at_j].reshape(-1, 3))
                    grads.append(g.reshape(-1, DIM))
                m.filters[w] = step(w, m.filters[w], gf)
            m.weight = step("v", m.weight, act.T @ dz)
            m.bias = step("b", m.bias, da.sum(0))
            m.intercept = float(step("c", m.intercept, dz.sum()))
            idx, inverse = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
            g = np.zeros((len(idx), DIM), np.float32)
            np.add.at(g, inverse, np.repeat(np.concatenate(grads), 3, 0))
            squares["e"][idx] += (g * g).mean(1)
            m.embedding[idx] -= RATE * g / np.sqrt(squares["e"][idx])[:, None]
            m.embedding[0] = 0
    rows.clear()
    m.offsets = _calibrated(m, [texts[i] for i in held], labels[held])
    return m


def _calibrated(m: Model, texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Per language the cut between the classes with fewest errors (the middle of such cuts); languages with few rows take that of all."""
    scorer = Scorer(m)
    parts = [scorer.read([words_of(t) for t in texts[i : i + 200]]) for i in range(0, len(texts), 200)]
    z = np.concatenate([x for x, _ in parts]) if parts else np.empty(0)
    lang = np.concatenate([x for _, x in parts]) if parts else np.empty(0, int)

    def cut(z: np.ndarray, y: np.ndarray, near: float) -> float:
        cuts = np.concatenate(([z.min() - 1], (np.sort(z)[1:] + np.sort(z)[:-1]) / 2, [z.max() + 1]))
        wrong = np.array([((z >= c) != (y > 0)).sum() for c in cuts])
        good = cuts[wrong == wrong.min()]
        return float(good[np.argmin(np.abs(good - near))])

    whole = cut(z, labels, 0.0) if len(z) and 0 < labels.sum() < len(labels) else 0.0
    out = np.full(len(LANGUAGES), whole)
    for k in range(len(LANGUAGES)):
        mine = lang == k
        if mine.sum() >= 50 and 5 <= labels[mine].sum() < mine.sum():
            out[k] = cut(z[mine], labels[mine], whole)
    return out


class Scorer(dict):
    """Word -> row of a table of filter responses, and of one of language codes; the tables start anew beyond LIMIT words."""

    LIMIT = 100_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.table, self.new = self.model.responses(np.zeros((1, 3), np.int32)), []
        self.codes = bytearray(1)  # language whose function word a word is; 0: none

    def __missing__(self, word: bytes) -> int:
        self.new.append(buckets_of(word))
        self.codes.append(_LANGUAGE_OF.get(word, 0))
        self[word] = i = len(self) + 1
        return i

    def logits(self, words: list[list[bytes]]) -> np.ndarray:
        return self.read(words)[0]

    def read(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's logit and its language, as language_of tells it from all words."""
        if len(self) > self.LIMIT:
            self._reset()
        starts, ends = _layout([len(w) for w in words])
        idx = np.zeros(ends[-1] + PAD, np.int32)
        for w, s in zip(words, starts.tolist()):
            if w:
                idx[s : s + len(w)] = np.fromiter(map(self.__getitem__, w), np.int32, len(w))
        if self.new:
            need = 1 + len(self)
            if need > len(self.table):
                wide = np.empty((max(need, 2 * len(self.table)), self.table.shape[1]), np.float32)
                wide[: len(self.table)] = self.table
                self.table = wide
            self.table[need - len(self.new) : need] = self.model.responses(np.array(self.new, np.int32))
            self.new = []
        codes = np.frombuffer(bytes(self.codes), np.uint8)[idx]
        seen = np.array([np.bincount(codes[s:e], minlength=len(LANGUAGES)) for s, e in zip(starts.tolist(), ends.tolist())])
        seen[:, 0] = 0
        pooled = [np.maximum.reduceat(c, starts, 0) for c in _windows(self.table[idx], starts, ends)]
        return np.maximum(np.concatenate(pooled, 1) + self.model.bias, 0) @ self.model.weight + self.model.intercept, seen.argmax(1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of a language's cut and above: 0.5 and more."""
        z, lang = self.read([words_of(t) for t in texts])
        z = z.astype(np.float64) - self.model.offsets[lang]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


_scorers: dict[int, Scorer] = {}


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    if model.id not in _scorers:
        _scorers.clear()
        _scorers[model.id] = Scorer(model.broadcast.value)
    scorer = _scorers[model.id]
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            texts = part.column("text").cast(pa.binary()).to_pylist()
            scores = pa.array(scorer.scores([t or b"" for t in texts]), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "score"])
    scorer._reset()  # the worker outlives the task
    free_memory()


@dataclass
class _Shipped:
    id: str
    broadcast: object


def held_out(id_: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most `sample` labelled rows that are not held out, chosen by a hash of their id, and at most `sample_bytes` of text.

    An id that is labelled more than once counts as its highest label. Rows of `docs` that repeat an id are all learnt
    from, within the bytes. Without a labelled row, or with one class, the model scores all texts alike.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null").where(~held_out(F.col("id")))
    known = written(known.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id")), "labelled")
    # a cut by the hash first, so that no task hands on more than its share of the sample
    n, low, width = known.count(), -(2.0**63), 2.0**64
    near = known.where(F.col("h").cast("double") <= low + width * min(1.0, (1.2 * sample + 100) / max(1, n)))
    chosen = written(near.orderBy("h", "id").limit(sample).repartition(1), "sample")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    found = written(rows.join(F.broadcast(chosen), "id"), "sample_texts")  # the broadcast holds `sample` rows of three numbers
    sizes = found.select("h", "id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("of")).groupBy("h", "id", "of").agg(F.sum("size").alias("size"))
    run = sizes.withColumn("run", F.sum("size").over(Window.orderBy("h", "id", "of").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("run") <= sample_bytes)
    kept = found.withColumn("of", F.xxhash64("text")).join(run.select("id", "of"), ["id", "of"], "left_semi")
    texts, marks = [], []
    for r in kept.select("h", "id", "text", "label").orderBy("h", "id", "text").toLocalIterator():
        texts.append(bytes(r["text"]))
        marks.append(r["label"])
    return train(texts, np.array(marks, np.int64))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: `id_col`, score (0 to 1), predicted (1 if score >= 0.5), then the columns named in `carry`.

    Null and empty texts are scored as a text of padding. Null and repeated ids are scored like any
    others; an empty table gives no rows; columns of `docs` that aren't carried are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = xxhash.xxh3_64_hexdigest(model.embedding.tobytes() + model.offsets.tobytes() + model.weight.tobytes())
    shipped = _Shipped(key, sent)
    places = {c: "text" if c == text_col else f"carried{i}" for i, c in enumerate(carry)}
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(docs[c].alias(p) for c, p in places.items() if p != "text"))
    scored = rows.mapInArrow(lambda it: _scored(it, shipped), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(p).alias(c) for c, p in places.items()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: SQL has no convolutions; tests/llm measures accuracy on held-out rows.
QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
