"""Exact deduplication: owners of equal texts found in Patricia tries.

Texts are equal when identical after every ASCII white-space character is deleted; null counts as
empty. Normalising and hashing stay in the JVM. Each map task first folds its own rows in a trie, so
of a text that fills a third of the table only one row per map task is shuffled. The shuffle deals
by (length, SHA-256), each reduce task inserts the full byte strings into one radix trie, and the
terminal nodes hold the owner: most code points in the original, then smallest id. A trie that
outgrows its budget spills whole subtrees to scratch files and folds them one by one. The answers
return to the rows by a join salted by the size of the group.
"""

from __future__ import annotations

import contextlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import WS, documents, free_memory, spread_join, text_of, written

#: Bytes of keys a trie holds before it spills a subtree (or, on the map side, hands its rows on).
TRIE_BYTES = 64 << 20


class _Node:
    """A node, or the stub of a spilled subtree: `files` are (path from here, file of (rest of the key below that, owner))."""

    __slots__ = ("children", "files", "label", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.children, self.owner, self.files = label, {}, owner, []


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def better(a: tuple, b: tuple) -> tuple:
    """Of two owners (-code points, id is null, id, copies, length, sha) of one key: the smaller one, with both counts."""
    return (*min(a[:3], b[:3]), a[3] + b[3], *a[4:])


class PatriciaTrie:
    """Compressed radix trie from byte strings to owners.

    Beyond `budget` bytes it spills the largest subtrees of its uppermost branching node, each whole and below its
    full label, so a prefix that all keys share is passed over once, however long. The files are the task's own:
    a lost task is run again from its input.
    """

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.held, self.spilled = _Node(b""), budget, 0, 0

    def insert(self, key: bytes, owner: tuple) -> None:
        self.held += self._insert(key, owner)
        if self.held > self.budget:
            self._spill()

    def _insert(self, key: bytes, owner: tuple) -> int:
        node, at = self.root, 0
        while True:
            if node.files:
                pickle.dump((key[at:], owner), node.files[0][1])
                return 0
            if at == len(key):
                node.owner = owner if node.owner is None else better(node.owner, owner)
                return 0
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], owner)
                return len(key) - at + 200
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _common(label, key[at : at + len(label)])
            upper = _Node(label[:n])
            child.label = label[n:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            if at + n == len(key):
                upper.owner = owner
                return 200
            upper.children[key[at + n]] = _Node(key[at + n :], owner)
            return len(key) - at - n + 400

    def _spill(self) -> None:
        node = self.root
        while len(node.children) == 1:
            (node,) = node.children.values()
        resident = sorted(((sum(len(x.label) + 200 for x in _below(c)), c.label[0], c) for c in node.children.values() if not c.files), reverse=True)
        freed = 0
        for size, _, child in resident:
            if 2 * freed >= self.budget:
                break
            file, n = tempfile.TemporaryFile(), len(child.label)
            files = [(b"", file)]
            for key, x in _nodes(child, b""):
                if x.owner is not None:
                    pickle.dump((key[n:], x.owner), file)
                files += [(key[n:] + path, f) for path, f in x.files]  # stubs that came to lie below
            child.children, child.owner, child.files = {}, None, files
            freed += size - len(child.label) - 200
            self.spilled += 1
        self.held -= freed

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """Every key with its owner; spilled subtrees follow, each in a trie of its own."""
        waiting = [(b"", self)]
        while waiting:
            prefix, trie = waiting.pop()
            yield from ((prefix + key, owner) for key, owner in _keys(trie.root, b""))
            stubs = [(prefix + key, node.files) for key, node in _nodes(trie.root, b"") if node.files]
            trie.root = _Node(b"")
            for below, files in stubs:
                trie = PatriciaTrie(self.budget)
                for path, file in files:
                    file.seek(0)
                    with file, contextlib.suppress(EOFError):
                        while True:
                            key, owner = pickle.load(file)
                            trie.insert(path + key, owner)
                if trie.spilled:
                    waiting.append((below, trie))
                else:
                    yield from ((below + key, owner) for key, owner in _keys(trie.root, b""))


def _nodes(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
    """The node and those below it, each with its whole key."""
    stack = [(top, prefix)]
    while stack:
        node, prefix = stack.pop()
        key = prefix + node.label
        yield key, node
        stack += [(c, key) for c in node.children.values()]


def _below(top: _Node) -> Iterator[_Node]:
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack += node.children.values()


def _keys(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
    return ((key, node.owner) for key, node in _nodes(top, prefix) if node.owner is not None)


_MADE = pa.schema([("norm_len", pa.int64()), ("sha", pa.binary()), ("key", pa.binary()), ("chars", pa.int64()), ("owner", pa.int64()), ("copies", pa.int64())])
_MADE_DDL = "norm_len long, sha binary, key binary, chars long, owner long, copies long"


def _batches(items: Iterable[tuple[bytes, tuple]], with_key: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for key, (chars, null_id, owner, copies, length, sha) in items:
        rows.append((length, sha, key if with_key else b"", -chars, None if null_id else owner, copies))
        held += 64 + len(key) * with_key
        if held > 8 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MADE.types)], schema=_MADE)


def _fold(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Map side (last=False): folds copies that meet in this task, handing rows on when the budget is full. Reduce side: the owners."""
    trie = PatriciaTrie(TRIE_BYTES if last else 1 << 62)
    for b in batches:
        for n, sha, key, chars, owner, copies in zip(*(b.column(c).to_pylist() for c in _MADE.names)):
            trie.insert(key, (-chars, owner is None, owner or 0, copies, n, sha))
            if not last and trie.held > TRIE_BYTES:
                yield from _batches(trie.items(), True)
                trie = PatriciaTrie(1 << 62)
    yield from _batches(trie.items(), not last)
    free_memory()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chars, norm, norm_len, sha) per row; all in the JVM."""
    text = text_of(docs, text_col)
    return (
        docs.select(docs[id_col].cast("long").alias("id"), F.char_length(text).cast("long").alias("chars"), F.translate(text, WS, "").alias("norm"))
        .withColumn("norm_len", F.char_length("norm").cast("long"))
        .withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    )


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: norm_len, sha, keep_id, group_size."""
    rows = keyed(docs, id_col, text_col).select("norm_len", "sha", F.col("norm").cast("binary").alias("key"), "chars", F.col("id").alias("owner"), F.lit(1).cast("long").alias("copies"))
    partial = rows.mapInArrow(lambda it: _fold(it, False), _MADE_DDL)
    dealt = partial.repartition("norm_len", "sha")
    return dealt.mapInArrow(lambda it: _fold(it, True), _MADE_DDL).select("norm_len", "sha", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256.

    Empty, null and all-white-space texts are one group. Ties in code points fall to the smallest id.
    Rows that repeat an id and a text are one document: they get the same answer, and count singly in
    group_size. A null id owns a group only if all its ids are null. An empty table gives no rows;
    further columns of `docs` are not looked at.
    """
    left = keyed(docs, id_col, text_col).select("id", "sha")
    found = spread_join(left, written(owners(docs, id_col, text_col), "owners"), "sha", "group_size", by="id")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that own their text, one for each distinct normalised text, with the columns of `docs`.

    Of rows that repeat an id and a text one stays; rows without an id own a text only if no row with an id has it.
    An empty table gives no rows.
    """
    text = F.translate(text_of(docs, text_col), WS, "")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    own = owners(docs, id_col, text_col).select(F.col("sha").alias("s"), F.col("keep_id"))
    # an owner has one row but where an id repeats, so no group of copies meets in one task
    kept = rows.join(own, (rows.sha == own.s) & rows.id.eqNullSafe(own.keep_id))
    return kept.dropDuplicates(["id", "sha"]).select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents
), o AS (SELECT sha, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM k GROUP BY sha)
SELECT k.doc_id, o.keep_id, o.group_size, k.doc_id = o.keep_id AS kept, k.sha AS text_sha256 FROM k JOIN o USING (sha)
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE_SQL = {"op8_exact_dedup": OP8_SQL}
