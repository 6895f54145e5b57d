"""Best-fit packing by a configuration linear program.

Every document is tokenised once, in one Arrow map that writes its pieces (at most `capacity` tokens
each) with the running number of the piece among those of its length in the task. What the program
needs of the corpus is the histogram of lengths, at most `capacity` counts whatever the corpus holds.
Its columns are configurations, multisets of lengths that fit one sequence. Multiplicative weights on
the lengths start from the best of a family of dual-feasible functions; each round a knapsack dynamic
program prices all room, every length gets a configuration of the going price, and lengths covered less
than the rest gain weight. The fractional solution is rounded, the program is solved again for the rest,
and fewer pieces than there are lengths in use are left to a best-fit filling. The plan (configuration,
length, how many) is then dealt to the pieces by their global number within their length, without
sorting or grouping the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import documents, free_memory, text_of, written

CAPACITY = 2048
#: Bytes of text whose distinct words are looked up together.
SLICE = 12 << 20
#: Rounds of multiplicative weights before a rounding, the share of what is open that a round may cover, how far below the
#: going price a configuration may be at first, and the step of the weights in parts of that. The driver's work depends on
#: the capacity, not on the corpus.
ROUNDS, SHARE, TOLERANCE, STEP = 8, 0.35, 1e-3, 0.1


#: ASCII punctuation that doesn't begin a contraction.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


class WordIds(dict):
    """Token ids (little-endian unsigned 32 bits) of a white-space delimited, ASCII-lower-cased word.

    The tokenizer lower-cases, drops white space and never joins what it separates, so the ids of a text
    are those of its words in turn. Punctuation after a word is looked up by itself.
    """

    LIMIT = 450_000

    def __init__(self, path: str):
        super().__init__()
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 3, bool)  # tokens that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.whole(word)
        return ids

    def learn(self, new: list[bytes]) -> None:
        """Looks up new words together: those of letters alone end with the only end token they have."""
        new = [w for w in new if w.decode().isalpha()]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):  # else some word is several tokens' ends: each is looked up alone
                raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1]))
                self.update(zip(part, [raw[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist())]))

    def table(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        if len(self) > self.LIMIT:
            self.clear()
        parts, stems = [], set()
        for w in words:
            stem = w.rstrip(_PUNCTUATION)
            if len(stem) == len(w) or not stem[-1:].isalpha():  # punctuation after a letter is a token of its own
                stem = w
            parts.append(stem)
            stems.add(stem)
        self.learn(list(stems.difference(self)))
        return [self[stem] if len(stem) == len(w) else self[stem] + self[w[len(stem) :]] for w, stem in zip(words, parts)]

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of these strings; split at white space within [\\x20\\x09-\\x0D], which the tokenizer drops."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)  # special tokens are matched before lower-casing
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        ids, at = self.table(coded.dictionary.cast(pa.binary()).to_pylist()), coded.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        first, flat = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(ids), "<u4")
        for i in range(0, len(texts), 500):
            bounds = ends[i : i + 501]
            w = at[bounds[0] : bounds[-1]]
            n = size[w]
            to = np.cumsum(n, dtype=np.int32)
            tokens = flat[np.repeat(first[w] - to + n, n) + np.arange(n.sum(), dtype=np.int32)].tobytes()
            cuts = 4 * np.concatenate(([0], to))[bounds - bounds[0]]
            for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                yield self.whole(texts[i + k].as_py().encode()) if special[i + k] else tokens[lo:hi]


_tokenizers: dict[str, WordIds] = {}


def token_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("nth", pa.int64())])
_PIECE_DDL = "id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words, seen, chunk = token_ids(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    end = end_id.to_bytes(4, "little")
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy()) // SLICE
        for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
            ids, texts = (b.column(c).slice(part[0], len(part)) for c in ("id", "text"))
            rows = []
            for i, tokens in zip(ids.to_pylist(), words.of_all(texts)):
                tokens += end
                for p, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    piece = tokens[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((i, p, at // 4, n, zlib.crc32(piece), chunk, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)
    free_memory()


def prices(weight: np.ndarray) -> np.ndarray:
    """Knapsack prices: best[c] is the most that pieces of these weights (0: not offered) are worth in c tokens."""
    capacity = len(weight) - 1
    offered = np.where(weight > 0, weight, -np.inf)[::-1].copy()
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (best[:c] + offered[capacity - c : capacity]).max())
    return best


def first_weights(need: np.ndarray) -> np.ndarray:
    """Of the dual-feasible weights "1 beyond capacity - k, 0 below k, else the share of a sequence", those of the highest bound."""
    capacity, length, used = len(need) - 1, np.arange(len(need)), np.flatnonzero(need)
    cuts = np.unique(np.concatenate(([0], used[used <= capacity // 2], capacity - used[used > capacity // 2])))
    bounds = [(need * np.where(length > capacity - k, 1.0, np.where(length < k, 0.0, length / capacity))).sum() for k in cuts]
    k = cuts[int(np.argmax(np.round(bounds, 6)))]
    return np.maximum(np.where(length > capacity - k, 1.0, np.where(length < k, 0.0, length / capacity)), 1e-3 * length / capacity)


def _column(lead: int, weight: np.ndarray, best: np.ndarray, used: np.ndarray, need: np.ndarray, room: np.ndarray, slack: float) -> tuple[dict[int, int], float]:
    """A configuration with `lead`, traced along the prices through lengths that still have room, and what it is worth.

    Of lengths whose price falls short of the best by at most `slack`, that with the largest open share (times length) is taken.
    """
    chosen, c, worth = {lead: 1}, len(weight) - 1 - lead, float(weight[lead])
    while n := int(np.searchsorted(used, c, "right")):
        lengths = used[:n]
        value, open_ = best[c - lengths] + weight[lengths], room[lengths]
        x = np.where(open_ >= 0.25 * room[lead], value, -1.0)
        if x.max() < best[c] - 5 * slack:  # those with plenty of room don't reach the price: any that has room
            x = np.where(open_ > 0, value, -1.0)
            if x.max() < 0:
                break
        l = int(lengths[np.argmax(np.where(x >= x.max() - slack, open_ / need[lengths] * lengths, -1.0))])
        chosen[l] = chosen.get(l, 0) + 1
        worth, c = worth + float(weight[l]), c - l
    return chosen, worth


def program(need: np.ndarray, weight: np.ndarray, tolerance: float) -> dict[tuple, float]:
    """ROUNDS of multiplicative weights on the covering program: configurations ((length, how many), ...) and how often each, in fractions.

    A round prices the lengths, and for each length, longest first, takes a configuration with it that is worth the
    going price (the median over the open tokens) but for `tolerance`, as often as SHARE of what is open allows. Then
    lengths that are covered less than the whole gain weight, the others lose; `weight` is changed in place.
    """
    capacity, used, columns = len(need) - 1, np.flatnonzero(need), {}
    length, whole, left = np.arange(capacity + 1), need.astype(float), need.astype(float)
    for _ in range(ROUNDS):
        tokens = left * length
        # lengths that are all but covered, or hold next to no tokens, can lead a configuration but don't set prices
        best = prices(np.where((left >= np.maximum(0.5, 0.02 * whole)) & (tokens >= 1e-4 * tokens.sum()), weight, 0))
        worth = weight[used] + best[capacity - used]
        order = np.argsort(worth)
        run = np.cumsum(tokens[used][order])
        price = worth[order[min(np.searchsorted(run, run[-1] / 2), len(order) - 1)]] * (1 - tolerance)
        room = SHARE * left
        for lead in used[worth >= price][::-1].tolist():
            if room[lead] <= 0:
                continue
            chosen, value = _column(lead, weight, best, used, whole, room, tolerance / 5)
            often = min(room[l] / m for l, m in chosen.items())
            if value < price or often <= 0:
                continue
            for l, m in chosen.items():
                room[l] -= often * m
                left[l] -= often * m
            key = tuple(sorted(chosen.items()))
            columns[key] = columns.get(key, 0.0) + often
        left[left < 1e-9 * whole] = 0
        open_ = (left * length).sum() / (need * length).sum()
        if open_ < 0.02:
            break
        weight[used] *= np.exp(STEP * tolerance * np.clip(left[used] / whole[used] / open_ - 1, -1, 1))
    return columns


def solve(counts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Configurations (how often, lengths, how many of each) that hold `counts[l]` pieces of every length l exactly.

    The program's configurations are rounded, the most used first, as far as pieces are left, and the program is
    solved again for what remains, with twice the tolerance when that took away less than 30 percent. Fewer pieces
    than there are lengths in use are left to `fill`.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    plan: list[tuple[int, np.ndarray, np.ndarray]] = []
    if left[capacity]:
        plan.append((int(left[capacity]), np.array([capacity]), np.array([1])))
        left[capacity] = 0
    in_use, weight, tolerance = np.count_nonzero(left), first_weights(left), TOLERANCE
    while left.sum() > in_use / 8:
        before = left.sum()
        for key, often in sorted(program(left, weight, tolerance).items(), key=lambda x: (-x[1], x[0])):
            lengths, many = np.array(key).T
            n = min(max(1, round(often)), int((left[lengths] // many).min()))
            if n > 0:
                plan.append((n, lengths, many))
                left[lengths] -= n * many
        if left.sum() > 0.7 * before:
            tolerance *= 2
            if left.sum() < in_use or tolerance > 1:
                break
    return plan + fill(left)


def fill(left: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Best-fit filling of what is left, by classes: the longest length, then the subset of the rest that fills the sequence best."""
    capacity, plan = len(left) - 1, []
    left = left.copy()
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        room, chosen = capacity - top, {top: 1}
        left[top] -= 1
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            exact = _best_pair(left, fits, room)
            for l in exact:
                chosen[l] = chosen.get(l, 0) + 1
                left[l] -= 1
                room -= l
        lengths = np.array(sorted(chosen))
        many = np.array([chosen[l] for l in lengths.tolist()])
        more = int((left[lengths] // many).min())
        left[lengths] -= more * many
        plan.append((1 + more, lengths, many))
    return plan


def _best_pair(left: np.ndarray, fits: np.ndarray, room: int) -> list[int]:
    """One or two lengths that fill `room` as far as one or two can."""
    one = int(fits[-1])
    if one == room:
        return [one]
    partner = np.searchsorted(fits, room - fits, "right") - 1
    ok = partner >= 0
    a, b = fits[ok], fits[partner[ok]]
    same = (a == b) & (left[a] < 2)
    a, b = a[~same], b[~same]
    if not len(a):
        return [one]
    k = int(np.argmax(a + b))
    return [int(a[k]), int(b[k])] if a[k] + b[k] > one else [one]


class Plan:
    """For each length the slots that configurations offer, in a row: slot s of length l -> sequence and offset."""

    def __init__(self, plan: list[tuple[int, np.ndarray, np.ndarray]], capacity: int):
        rows, sequence, offered = [], 0, np.zeros(capacity + 1, np.int64)
        for often, lengths, many in plan:
            at = 0
            for l, m in zip(lengths.tolist(), many.tolist()):
                rows.append((l, int(offered[l]), sequence, m, at))
                offered[l] += often * m
                at += l * m
            sequence += often
        rows.sort()
        self.sequences = sequence
        self.length, self.first, self.sequence, self.many, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5))

    def place(self, length: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << 48
        at = np.searchsorted(self.length * wide + self.first, length * wide + slot, "right") - 1
        k = slot - self.first[at]
        return self.sequence[at] + k // self.many[at], self.offset[at] + k % self.many[at] * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: `id_col`, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone. Null and repeated ids are packed like any other rows.
    An empty table gives no rows; further columns of `docs` are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    pieces = written(rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id), _PIECE_DDL), "pieces")
    by_chunk = written(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_chunk.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    plan = spark.sparkContext.broadcast(Plan(solve(counts), capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, ["length", "chunk"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("slot"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("slot").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(placed, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_bpe())


#: SQL has no tokenizer; tests/llm checks every piece and sequence against the contract.
QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
