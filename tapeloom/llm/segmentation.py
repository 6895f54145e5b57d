"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

A text is a lattice: words begin at spaces (written as U+2581, one more before the text), pieces never
span two words, characters without a piece, and U+2581 itself, fall back to their UTF-8 bytes. A piece of rank r in the
vocabulary weighs (r + 3) ** -ALPHA, a segmentation the product of its pieces; normalised, that is the
distribution sampled from. The k segmentations with the largest Gumbel-perturbed log-probability are k
distinct samples without replacement; they are found without perturbing every segmentation:

- the lattice's backward sums give the exact mass of any set "these first words, then anything", so
  the largest perturbed value in such a set is a Gumbel at its log-mass, cut off at its parent's value;
- the search is A*: it holds disjoint sets of segmentations with their largest perturbed values (exact
  bounds), takes the best set, draws its maximiser, and splits the rest of the set by the word at
  which a segmentation first departs from the one drawn.

inclusion is the log of the probability that a segmentation's perturbed value exceeds the (k+1)-th
largest, the usual weight of an estimate from such samples. Random numbers are hashes of the row key,
the sample, the word and the step: a retried task, or any other batching, draws the same.

One Arrow map without a shuffle. Lattices are built for the distinct words of a few megabytes of text
at a time, all in arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import documents, text_of
from tapeloom.llm.near_dedup import _mix

SPACE = "▁"
K, ALPHA, SEED = 2, 1.0, 11
SLICE = 4 << 20
#: Draws of a departing word that chance gets before it is drawn from the lattice without what its set excludes.
CHANCES = 3
_BASE, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_C = [np.uint64(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BITS = 20


class Vocabulary:
    """The pieces of a SentencePiece model in an open-addressed table from the hash of their characters."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and SPACE not in self.pieces[i][1:]]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.weight = np.full(n, -np.inf)
        self.weight[order] = -alpha * np.log(np.arange(len(order)) + 3.0)
        self.byte_weight = float(-alpha * np.log(len(order) + 3.0))
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.output = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.output[i] = bytes([b])
        # every prefix of a piece has an entry, so that a walk ends where no piece goes on
        entries: dict[int, int] = {}
        for i in plain:
            h = 0
            for c in self.pieces[i]:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                entries.setdefault(h, -1)
            entries[h] = i
        self.keys, self.values, self.probes = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -2, np.int32), 1
        for h, i in entries.items():
            at, n = ((h * int(_SLOT)) & 0xFFFFFFFFFFFFFFFF) >> (64 - _BITS), 1
            while self.values[at] != -2:
                at, n = (at + 1) & ((1 << _BITS) - 1), n + 1
            self.keys[at], self.values[at], self.probes = h, i, max(self.probes, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a prefix of pieces only, -2 for neither."""
        at = ((h * _SLOT) >> np.uint64(64 - _BITS)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.values[at], -2)
        todo = np.flatnonzero((out == -2) & (self.values[at] != -2))
        for k in range(1, self.probes):
            if not len(todo):
                break
            x = (at[todo] + k) & ((1 << _BITS) - 1)
            hit = self.keys[x] == h[todo]
            out[todo[hit]] = self.values[x[hit]]
            todo = todo[~hit & (self.values[x] != -2)]
        return out


class Lattice:
    """The lattices of distinct words, one after another: for each position the pieces that begin there and their probabilities."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        v, wide = vocabulary, vocabulary.longest
        text = "".join([SPACE + w for w in words])
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.first, n = np.cumsum(size) - size, len(c)
        written = c == np.uint64(ord(SPACE) + 1)  # the character itself in a text is in no piece: it goes by its bytes
        written[self.first] = False
        c[written] = np.uint64(0x110002)
        left = np.repeat(self.first + size, size) - np.arange(n)  # characters to the word's end
        self.ids = np.full((n, wide), -1, np.int32)
        at, h, used = np.arange(n), np.zeros(n, np.uint64), 1
        for k in range(wide):
            ok = left[at] > k
            at, h = at[ok], h[ok] * _BASE + c[at[ok] + k]
            found = v.find(h)
            hit = found >= 0
            self.ids[at[hit], k] = found[hit]
            used = k + 1 if hit.any() else used
            go = found != -2
            at, h = at[go], h[go]
            if not len(at):
                break
        wide, self.ids = used, self.ids[:, :used].copy()  # as wide as the longest piece found
        score = np.where(self.ids >= 0, v.weight[self.ids], -np.inf).astype(np.float32)
        bare = np.flatnonzero(self.ids[:, 0] < 0)  # characters without a piece: their bytes
        self.bytes_at = {int(p): v.byte_ids[list(text[p].encode("utf-8", "surrogatepass"))] for p in bare}
        score[bare, 0] = [v.byte_weight * len(self.bytes_at[int(p)]) for p in bare]
        # backward sums, from the words' ends, all words at once
        beta = np.zeros(n + wide + 1, np.float32)
        order = np.argsort(left, kind="stable")
        bounds = np.flatnonzero(np.diff(left[order], prepend=0, append=left.max(initial=0) + 1))
        inside = np.arange(1, wide + 1)
        self.log_p = np.full((n, wide), -np.inf, np.float32)
        self.other = np.zeros((n, wide), np.float32)  # probability of the other lengths, added up: exact where it is next to nothing
        self.cumulated = np.empty((wide, n), np.float32)  # by length, so that a draw reads only as far as it goes
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            p = order[lo:hi]
            d = int(left[p[0]])
            m = min(d, wide)  # longer pieces don't fit
            x = score[p, :m] + np.where(inside[:m] < d, beta[p[:, None] + inside[:m]], 0)
            top = x.max(1)
            beta[p] = top + np.log(np.exp(x - top[:, None]).sum(1))
            self.log_p[p, :m] = x = x - beta[p][:, None]
            e = np.exp(x)
            run = np.cumsum(e, 1)
            self.cumulated[:m, p], self.cumulated[m:, p] = run.T, run[:, -1]
            self.other[p, 1:m] = run[:, :-1]
            self.other[p, : m - 1] += np.cumsum(e[:, :0:-1], 1)[:, ::-1]
        self.end = self.first + size

    def draw(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segmentations of these words, seeded by these keys: log-probabilities, the probabilities of all other segmentations,
        cuts as piece lengths laid end to end, how many each."""
        at, end = self.first[word].copy(), self.end[word]
        log_p, rest_p, steps = np.zeros(len(word)), np.zeros(len(word)), []
        live, k = np.arange(len(word)), 0
        while len(live):
            u = (_mix(key[live] + _times(k, 3)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            p = at[live]
            take, rest, x, goal = np.zeros(len(p), np.int64), np.arange(len(p)), p, u * self.cumulated[-1, p]
            for row in self.cumulated[:-1]:
                beyond = np.flatnonzero(row[x] <= goal)
                if not len(beyond):
                    break
                rest, x, goal = rest[beyond], x[beyond], goal[beyond]
                take[rest] += 1
            rest_p[live] += np.exp(log_p[live]) * self.other[p, take]
            log_p[live] += self.log_p[p, take]
            steps.append((live, take.astype(np.uint8)))
            at[live] = p + take + 1
            live, k = live[at[live] < end[live]], k + 1
        count = np.zeros(len(word), np.int64)
        for live, _ in steps:
            count[live] += 1
        start, out = np.cumsum(count) - count, np.empty(count.sum(), np.uint8)
        for k, (live, take) in enumerate(steps):
            out[start[live] + k] = take
        return log_p, rest_p, out, count

    def _excluded(self, word: int, excluded: list[bytes]) -> list[tuple[int, float, dict[int, int]]]:
        """The tree of excluded segmentations, parents first: (position, probability of getting there, length -> child or -1 for the end)."""
        nodes: list[tuple[int, float, dict[int, int]]] = []
        stack = [(int(self.first[word]), 1.0, [(x, 0) for x in excluded], None, 0)]
        while stack:
            p, mass, group, parent, by = stack.pop()
            if parent is not None:
                nodes[parent][2][by] = len(nodes)
            below: dict[int, list] = {}
            for x, i in group:
                below.setdefault(x[i], []).append((x, i + 1))
            nodes.append((p, mass, dict.fromkeys(below, -1)))
            for take, these in below.items():
                if p + take + 1 < self.end[word]:
                    stack.append((p + take + 1, mass * float(np.exp(self.log_p[p, take])), these, len(nodes) - 1, take))
        return nodes

    def _open(self, p: int, takes) -> float:
        if len(takes) == 1:
            return float(self.other[p, next(iter(takes))])
        e = np.exp(self.log_p[p].astype(np.float64))
        e[list(takes)] = 0
        return float(e.sum())

    def mass_without(self, word: int, excluded: list[bytes]) -> float:
        """Probability of all segmentations of a word but these, from sums alone."""
        return sum(mass * self._open(p, takes) for p, mass, takes in self._excluded(word, excluded))

    def draw_without(self, word: int, excluded: list[bytes], key: np.ndarray) -> tuple[float, bytes] | None:
        """A segmentation other than these: log-probability and cuts; None where there is no other."""
        nodes = self._excluded(word, excluded)
        left = [0.0] * len(nodes)
        for i in reversed(range(len(nodes))):
            p, _, takes = nodes[i]
            left[i] = self._open(p, takes) + sum(float(np.exp(self.log_p[p, t])) * left[c] for t, c in takes.items() if c >= 0)
        if left[0] <= 0:
            return None
        p, node, cuts, log_p = int(self.first[word]), 0, bytearray(), 0.0
        while p < self.end[word]:
            weight = np.exp(self.log_p[p].astype(np.float64))
            if node >= 0:
                for t, c in nodes[node][2].items():
                    weight[t] *= left[c] if c >= 0 else 0.0
            u = float((_mix(key + _times(len(cuts), 3)) >> np.uint64(11))[0]) / 2.0**53
            run = np.cumsum(weight)
            take = min(int(np.searchsorted(run, u * run[-1], "right")), int(np.flatnonzero(weight)[-1]))
            node = nodes[node][2].get(take, -1) if node >= 0 else -1
            log_p += float(self.log_p[p, take])
            cuts.append(take)
            p += take + 1
        return log_p, bytes(cuts)

    def tokens(self, word: np.ndarray, cuts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of segmented words, and how many per word; bytes count singly."""
        steps = cuts.astype(np.int64) + 1
        run = np.cumsum(steps) - steps
        starts = np.cumsum(count) - count
        p = run - np.repeat(run[starts] if len(starts) else run, count) + np.repeat(self.first[word], count)
        ids = self.ids[p, cuts]
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, count
        parts = [self.bytes_at[int(x)] for x in p[bare]]
        n = np.ones(len(ids), np.int64)
        n[bare] = [len(x) for x in parts]
        out = np.repeat(ids, n)
        at = np.cumsum(n) - n
        for i, x in zip(bare, parts):
            out[at[i] : at[i] + len(x)] = x
        return out, np.add.reduceat(n, starts)


def _times(n: int, c: int) -> np.uint64:
    return np.uint64(n * int(_C[c]) & 0xFFFFFFFFFFFFFFFF)


def _gumbel(key: np.ndarray) -> np.ndarray:
    u = ((_mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _cut_off(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A Gumbel value g conditioned on being at most `at`."""
    with np.errstate(invalid="ignore"):
        return np.minimum(at, g) - np.log1p(np.exp(-np.abs(at - g)))


def _log(mass: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(mass)


class _Sample:
    """One drawn segmentation of every live text, and the sets that split off from it, one per word."""

    def __init__(self, log_p, rest, cuts, count, value, bound):
        self.log_p, self.rest, self.cuts, self.count, self.value, self.bound, self.starts = log_p, rest, cuts, count, value, bound, None


def sample(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, sample, ids, log-probability, perturbed value, log inclusion) of at most k distinct segmentations per text."""
    split = [t.split(" ") if t else [] for t in texts]
    flat = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
    word = flat.indices.to_numpy().astype(np.int64)
    n = np.array([len(ws) for ws in split], np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    for t in np.flatnonzero(n == 0):
        yield int(t), 0, np.empty(0, np.int32), 0.0, 0.0, 0.0
    if not len(word):
        return
    lattice = Lattice(vocabulary, flat.dictionary.to_pylist())
    text = np.repeat(np.arange(len(texts)), n)
    place = (np.arange(len(word)) - starts[text]).astype(np.uint64)
    keyed = _mix(keys[text] + (place + np.uint64(1)) * _C[0])
    has = np.flatnonzero(n)
    seg = starts[has]

    def before(x: np.ndarray) -> np.ndarray:
        """Sums of x over the earlier words of the text."""
        s = np.cumsum(x) - x
        return s - s[starts[text]]

    # drawn[s]: the s-th segmentation of every text (as copied from its parent before the word it departs at)
    log_p, rest, cuts, count = lattice.draw(word, _mix(keyed + _C[1]))
    value = np.full(len(texts), -np.inf)
    value[has] = _gumbel(keys[has] + _C[2])
    mass = before(log_p) + _log(rest)
    bound = _cut_off(mass + _gumbel(keyed + _C[2]), value[text])
    bound[~np.isfinite(mass)] = -np.inf
    drawn, excluded = [_Sample(log_p, rest, cuts, count, value, bound)], {}
    found = has
    for s in range(1, k + 1):
        best = np.array([np.maximum.reduceat(d.bound, seg) for d in drawn])
        source, top = best.argmax(0), best.max(0)
        kappa = np.full(len(texts), -np.inf)
        kappa[has] = top
        if s == k:
            break
        alive = np.isfinite(top)
        value = np.full(len(texts), -np.inf)
        value[has] = top
        log_p, parent, depart = np.empty(len(word)), np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        parent[has] = source
        for j, t in enumerate(has):
            if alive[j]:
                depart[t] = starts[t] + int(np.argmax(drawn[source[j]].bound[starts[t] : ends[t]]))
        mine = np.arange(len(word))
        fresh = np.flatnonzero((depart[text] >= 0) & (mine > depart[text]))
        turns = np.flatnonzero(depart >= 0)
        at = depart[turns]
        t_log, t_rest, t_cuts, t_count = lattice.draw(word[at], _mix(keyed[at] + _times(s + 1, 1)))
        pieces = np.split(t_cuts, np.cumsum(t_count)[:-1]) if len(turns) else []
        outs = [excluded.setdefault((int(parent[t]), int(m)), {_cuts_at(drawn[parent[t]], m).tobytes(): drawn[parent[t]].log_p[m]}) for t, m in zip(turns, at)]
        again, tries = range(len(turns)), 0
        while again := [i for i in again if pieces[i].tobytes() in outs[i]]:  # the departing word must differ from what its set excludes
            tries += 1
            if tries > CHANCES:
                for i in again:
                    m = at[i]
                    if (got := lattice.draw_without(int(word[m]), list(outs[i]), _mix(keyed[m : m + 1] + _times((s + 1) << 32, 1)))) is None:
                        value[turns[i]] = -np.inf  # no other segmentation: nothing is drawn
                        continue
                    t_log[i], pieces[i], t_count[i] = got[0], np.frombuffer(got[1], np.uint8), len(got[1])
                break
            more, _, cut, size = lattice.draw(word[at[again]], _mix(keyed[at[again]] + _times((s + 1) << 32 | tries, 1)))
            t_log[again], t_count[again] = more, size
            for i, x in zip(again, np.split(cut, np.cumsum(size)[:-1])):
                pieces[i] = x
        for i, t in enumerate(turns):
            m, src, out = int(at[i]), drawn[parent[t]], outs[i]
            out[pieces[i].tobytes()] = t_log[i]
            rest = lattice.mass_without(int(word[m]), list(out))
            base = src.log_p[starts[t] : m].sum()
            # what is left of the parent's set; its bound follows that of the set just opened
            src.bound[m] = _cut_off(base + np.log(rest) + _gumbel(keyed[m : m + 1] + _times(s + 1, 2)), value[t : t + 1])[0] if rest > 0 and np.isfinite(value[t]) else -np.inf
        new = ((fresh, *lattice.draw(word[fresh], _mix(keyed[fresh] + _times(s + 1, 1)))), (at, t_log, t_rest, np.concatenate(pieces) if pieces else np.empty(0, np.uint8), t_count))
        log_p, rest, count, source_cuts = _assemble(drawn, parent, text, new)
        mass = before(log_p) + _log(rest)
        bound = _cut_off(mass + _gumbel(keyed + _times(s + 1, 3)), value[text])
        bound[~np.isfinite(mass) | (depart[text] < 0) | (mine <= depart[text])] = -np.inf  # before the departure, and at it, the sets are the parent's
        drawn.append(_Sample(log_p, rest, source_cuts, count, value, bound))
    for s, d in enumerate(drawn):
        ids, size = lattice.tokens(word, d.cuts, d.count)
        to = np.concatenate(([0], np.cumsum(size)))
        total = np.add.reduceat(d.log_p, seg)
        for j, t in enumerate(found):
            if np.isfinite(d.value[t]):
                x = total[j] - kappa[t]
                inclusion = 0.0 if kappa[t] == -np.inf else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)
                yield int(t), s, ids[to[starts[t]] : to[ends[t]]], float(total[j]), float(d.value[t]), inclusion


def _starts(d: _Sample) -> np.ndarray:
    if d.starts is None:
        d.starts = np.cumsum(d.count) - d.count
    return d.starts


def _cuts_at(d: _Sample, m: int) -> np.ndarray:
    first = _starts(d)[m]
    return d.cuts[first : first + d.count[m]]


def _assemble(drawn: list[_Sample], parent: np.ndarray, text: np.ndarray, new: tuple) -> tuple[np.ndarray, ...]:
    """Words before the departure from the parent sample, the departing ones and those after as drawn afresh."""
    log_p, rest, count, kept = np.empty(len(text)), np.empty(len(text)), np.empty(len(text), np.int64), np.ones(len(text), bool)
    for at, n_log, n_rest, _, n_count in new:
        log_p[at], rest[at], count[at], kept[at] = n_log, n_rest, n_count, False
    sources = []
    for p, d in enumerate(drawn):
        old = np.flatnonzero(kept & (parent[text] == p)) if len(drawn) > 1 else np.flatnonzero(kept)
        log_p[old], rest[old], count[old] = d.log_p[old], d.rest[old], d.count[old]
        sources.append((old, d.cuts, _starts(d)[old]))
    start = np.cumsum(count) - count
    cuts = np.empty(int(count.sum()), np.uint8)
    for at, _, _, n_cuts, n_count in new:
        sources.append((at, n_cuts, np.cumsum(n_count) - n_count))
    for at, flat, first in sources:
        c = count[at]
        run = np.cumsum(c) - c
        within = np.arange(c.sum())
        cuts[within + np.repeat(start[at] - run, c)] = flat[within + np.repeat(first - run, c)]
    return log_p, rest, count, cuts


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of piece ids: byte pieces are UTF-8, the space before the text goes."""
    return b"".join([vocabulary.output[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


_COLUMNS = "id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def _segmented(batches: Iterator[pa.RecordBatch], path: str, k: int, seed: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy()) // SLICE
        for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
            ids, texts = (b.column(c).slice(part[0], len(part)).to_pylist() for c in ("id", "text"))
            keys = np.array([xxhash.xxh3_64_intdigest(str(i).encode(), seed) for i in ids], np.uint64)
            rows = []
            for t, s, got, log_p, value, inclusion in sample(v, texts, keys, k):
                same = b"".join([v.output[i] for i in got.tolist()])[1:] == texts[t].encode("utf-8", "surrogatepass")
                rows.append((ids[t], s, len(got), zlib.crc32(got.astype("<u4").tobytes()), log_p, value, inclusion, same, *([got] * with_ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def segmentations(docs: DataFrame, model: str, k: int = K, seed: int = SEED, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row and sample (at most k, distinct, fewer where a text has fewer segmentations):
    `id_col`, sample, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip, and ids.

    Null and empty texts have one segmentation without pieces. Rows that repeat an id and a text draw
    the same. An empty table gives no rows; further columns of `docs` are not looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _segmented(it, model, k, seed, with_ids), _COLUMNS + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`rows` with the text of `ids_col`; null ids decode to null."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            texts = [None if x is None else decode(v, x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    return rows.mapInArrow(f, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(documents(spark, sf_dir), piece_bpe(), with_ids=False)


#: SQL has no lattices; tests/llm holds the sampler against all segmentations of short texts, and round trips.
QUERIES = {"op3_sampled_segmentation": op3_sampled_segmentation}
ORACLE_SQL: dict[str, str] = {}
