"""Secret scans with structural confirmation.

Patterns propose candidates in every whole text; a structural reader confirms what has a structure:
base64 or hex is decoded, key encodings (DER, PEM bodies, OpenSSH blobs) must parse with nested
lengths that add up, signed tokens must have a JSON header that names an algorithm. The three base
kinds (assign, access, hex) are reported as their patterns say; the method adds kinds to them:

- jwt: three base64url parts whose first decodes to a JSON object with "alg"
- der: base64 or hex of an ASN.1 SEQUENCE whose lengths fill it at every depth and whose fields are those of a key or
  certificate: PKCS#1, DSA, SEC 1, PKCS#8 (plain or encrypted), SubjectPublicKeyInfo, X.509, PKCS#12
- ssh: base64 or hex of length-prefixed fields that begin with an SSH key type, or an openssh-key-v1 container

Base64 is read in both alphabets. Encoded lines that follow each other are one run, also where they are indented,
quoted, or prefixed, or where the line feed is written as an escape. Every place in a run at which a key could begin is
tried; the decoded lengths say where it ends, which must be a line end. So no pair of places has to be decoded that
can't be a key. Base64 or hex of a whole PEM text is decoded and scanned once more; its span is that of the outer run.

The scan is one Arrow map without a shuffle; memory is one Arrow batch.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import documents, text_of

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "der", "ssh")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
# a line break as a text has it: spaces, quotes and commas, a line feed or its escape, and what may stand before the next line
_BREAK = r"""[\x20\t"',;]*(?:\r?\n|(?:\\{1,2}r)?\\{1,2}n)[\x20\t>#*|"']*"""


def _runs(chars: str, least: int, tail: str = "") -> re.Pattern:
    return re.compile(rf"(?<![{chars}])(?=[{chars}]{{{least}}}|[{chars}]{{1,{least}}}{_BREAK}[{chars}])[{chars}]++(?:{_BREAK}[{chars}]++)*+{tail}")


# as long as the shortest SSH fields, of 12 bytes; a SEQUENCE has 16 or more
_BASE64, _BASE16 = _runs("A-Za-z0-9+/_-", 16, "={0,2}"), _runs("0-9A-Fa-f", 24)
_SEGMENT = {6: re.compile(_BREAK + "|([A-Za-z0-9+/_-]+)"), 4: re.compile(_BREAK + "|([0-9A-Fa-f]+)")}
# how a SEQUENCE, SSH fields, a container and a PEM text begin
_BEGIN = {6: re.compile("M[A-P]|AAAA|b3BlbnNzaC1r|LS0tLS1CRUdJTi"), 4: re.compile("30|000000|6f70656e7373682d|2d2d2d2d2d424547494e", re.I)}
_PEM, _PEM_END = b"-----BEGIN ", re.compile(rb"-----END [A-Z0-9 ]+-----")
_STANDARD = str.maketrans("-_", "+/")
_SSH_TYPES = (b"ssh-", b"ecdsa-", b"sk-ssh-", b"sk-ecdsa-")
_CONTAINER = b"openssh-key-v1\0"


def der_length(b: bytes, at: int) -> tuple[int, int] | None:
    """(start, end) of the contents of the ASN.1 element at `at`, if its length fits."""
    if at + 2 > len(b):
        return None
    n, start = b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or start + k > len(b):
            return None
        n, start = int.from_bytes(b[start : start + k], "big"), start + k
    return (start, start + n) if start + n <= len(b) else None


_TAGS = {0x02: "I", 0x03: "B", 0x04: "O", 0x05: "N", 0x06: "o", 0x30: "S", 0xA0: "0", 0xA1: "1"}
# the fields of a SEQUENCE, those of its own SEQUENCEs in brackets
_SHAPES = re.compile(r"(?P<rsa>I{9}(\(S*\))?)|(?P<public>II)|(?P<dsa>I{6})|(?P<pkcs8>I\(o[NoS]?\)O0?1?)|(?P<sealed>\(o[NoS]?\)O)|(?P<spki>\(o[NoS]?\)B)|(?P<sec1>IO0?1?)|(?P<signed>\([^()]+\)\(o[NoS]?\)B)|(?P<pkcs12>I\(o0\)(\([^()]*\))?)")


def _elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """(tag, start, end) of the contents of each element from `at` to `end`, which they fill."""
    out = []
    while at < end:
        start, stop = der_length(b, at)
        out.append((b[at], start, stop))
        at = stop
    return out


def is_der(b: bytes) -> bool:
    """A SEQUENCE that fills b, with elements that fill constructed ones at every depth, and the fields of a key or certificate."""
    if len(b) < 16 or b[0] != 0x30 or (top := der_length(b, 0)) is None or top[1] != len(b) or b[top[0]] not in (0x02, 0x30):
        return False
    pending = [top]
    while pending:
        at, end = pending.pop()
        while at < end:
            if (x := der_length(b, at)) is None or x[1] > end:
                return False
            if b[at] & 0x20:
                pending.append(x)
            at = x[1]
    fields = _elements(b, *top)
    name = lambda tag: _TAGS.get(tag, "?")
    shape = "".join("(" + "".join(name(t) for t, *_ in _elements(b, x, y)) + ")" if tag == 0x30 else name(tag) for tag, x, y in fields)
    if (m := _SHAPES.fullmatch(shape)) is None:
        return False
    first, size = int.from_bytes(b[fields[0][1] : fields[0][2]], "big"), [y - x for _, x, y in fields]
    match m.lastgroup:
        case "rsa" | "dsa":
            return first <= 1 and size[1] >= 32
        case "public":
            return size[0] >= 32 and 1 <= size[1] <= 8 and b[fields[1][2] - 1] % 2 == 1
        case "pkcs8":
            return first <= 1 and size[2] >= 16
        case "sec1":
            return first == 1 and 16 <= size[1] <= 72
        case "pkcs12":
            return first == 3
        case "sealed" | "spki":
            return size[1] >= 16
    return size[2] >= 16


def is_ssh(b: bytes) -> bool:
    """Length-prefixed fields that fill b, the first a key type; or an openssh-key-v1 container that its nested fields fill."""
    if b.startswith(_CONTAINER):
        return _is_container(b)
    at, n = 0, 0
    while at + 4 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        field = b[at + 4 : at + 4 + size]
        if len(field) != size or n == 0 and not field.startswith(_SSH_TYPES):
            return False
        at, n = at + 4 + size, n + 1
    return at == len(b) and n >= 2


def _is_container(b: bytes) -> bool:
    """Cipher, derivation and its options, then a number of public keys, each with a key type, and one private part; a tag of 16 bytes may follow."""

    def field(at: int) -> int:
        n = int.from_bytes(b[at : at + 4], "big") if at + 4 <= len(b) else len(b)
        return at + 4 + n

    at = field(field(field(len(_CONTAINER))))
    keys, at = int.from_bytes(b[at : at + 4], "big"), at + 4
    while keys and at < len(b):
        if not b[at + 8 :].startswith(_SSH_TYPES):
            return False
        at, keys = field(at), keys - 1
    return not keys and len(b) - field(at) in (0, 16)


def is_signed_token(header: str) -> bool:
    try:
        x = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


class _Encoded:
    """A run of base64 or hex lines: its characters in a row, where lines start and end in them, and their places in the text."""

    def __init__(self, run: re.Match, bits: int):
        lines = [m.span(1) for m in _SEGMENT[bits].finditer(run.string, *run.span()) if m[1]]
        self.bits, body = bits, "".join(run.string[a:b] for a, b in lines)
        self.body = body.translate(_STANDARD) if bits == 6 else body
        self.starts, self.places, self.ends, at = [], [], {}, 0
        for a, b in lines:
            self.starts.append(at)
            self.places.append(a)
            at += b - a
            self.ends[at] = b
        self.ends[at] = run.end()  # padding belongs to the last line

    def place(self, at: int) -> int:
        """Where in the text the character at `at` stands."""
        i = bisect_right(self.starts, at) - 1
        return self.places[i] + at - self.starts[i]

    def bytes(self, start: int, end: int) -> bytes:
        """What the characters stand for; a last one that completes no byte is left out."""
        s = self.body[start:end]
        if self.bits == 4:
            return bytes.fromhex(s[: len(s) & -2])
        s = s[: len(s) - (len(s) % 4 == 1)]
        return base64.b64decode(s + "=" * (-len(s) % 4))

    def end(self, start: int, size: int) -> int | None:
        """The line end at which `size` bytes from `start` end."""
        e = start - (-8 * size // self.bits)
        return e if e in self.ends else None

    def number(self, start: int, at: int) -> int | None:
        """The four bytes at `at` from `start`."""
        first = start + (2 * at if self.bits == 4 else at // 3 * 4)
        b = self.bytes(first, first + 8)[0 if self.bits == 4 else at % 3 :][:4]
        return int.from_bytes(b, "big") if len(b) == 4 else None

    def skip(self, start: int, at: int, fields: int) -> int | None:
        """Where length-prefixed fields end that begin at `at`."""
        room = (len(self.body) - start) * self.bits // 8
        for _ in range(fields):
            if (n := self.number(start, at)) is None or (at := at + 4 + n) > room:
                return None
        return at

    def der(self, start: int, head: bytes) -> int | None:
        k = head[1] & 0x7F if head[1] & 0x80 else 0
        if k > 4:
            return None
        e = self.end(start, 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1]))
        return e if e is not None and is_der(self.bytes(start, e)) else None

    def ssh(self, start: int) -> int | None:
        """Of the line ends that the fields allow, the last."""
        at, n, found = 0, 0, None
        while (at := self.skip(start, at, 1)) is not None:
            n += 1
            if n >= 2 and (e := self.end(start, at)) is not None:
                found = e
        return found if found is not None and is_ssh(self.bytes(start, found)) else None

    def container(self, start: int) -> int | None:
        """The line end that its fields and an authentication tag of 16 bytes or none lead to."""
        at = self.skip(start, len(_CONTAINER), 3)
        n = None if at is None else self.number(start, at)
        at = None if n is None else self.skip(start, at + 4, n + 1)
        ends = [] if at is None else [e for e in (self.end(start, at + 16), self.end(start, at)) if e is not None]
        return next((e for e in ends if is_ssh(self.bytes(start, e))), None)

    def pem(self, start: int) -> tuple[str, int, int]:
        """(kind, end, end) of a PEM text whose body is a key; else no kind, and where to look on."""
        size = 4096
        while (m := _PEM_END.search(text := self.bytes(start, start + size))) is None and start + size < len(self.body):
            size *= 2
        if m is None:
            return "", 0, len(self.body)
        end = start - (-8 * m.end() // self.bits)
        inner = next(_keys(text[: m.start()].decode("latin-1"), nested=True), None)
        return (inner[0] if inner else "", end, end)

    def keys(self, nested: bool) -> Iterator[tuple[str, int, int]]:
        done, clear = 0, {}  # clear: by alignment, before what place no PEM text begins that wasn't read
        if len(self.body) < (16 if self.bits == 6 else 24):
            return
        for m in _BEGIN[self.bits].finditer(self.body):
            start = m.start()
            if start < done:
                continue
            head = self.bytes(start, start + 24)
            kind, e = "", None
            if head.startswith(_PEM):
                if not nested and start >= clear.get(start % 4, 0):
                    kind, e, clear[start % 4] = self.pem(start)
            elif len(head) < 12:
                continue
            elif head[0] == 0x30:
                kind, e = "der", self.der(start, head)
            elif self.bytes(start, start + 30).startswith(_CONTAINER):
                kind, e = "ssh", self.container(start)
            elif any(head[4:].startswith(t[: len(head) - 4]) for t in _SSH_TYPES):
                kind, e = "ssh", self.ssh(start)
            if kind and e is not None:
                done = e
                yield kind, self.place(start), self.ends.get(e) or self.place(e - 1) + 1


def _keys(text: str, nested: bool = False) -> Iterator[tuple[str, int, int]]:
    for pattern, bits in ((_BASE64, 6), (_BASE16, 4)):
        for m in pattern.finditer(text):
            yield from _Encoded(m, bits).keys(nested)


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Signed tokens among dotted parts, each part tried as a header."""
    for m in _DOTTED.finditer(text):
        at, parts, i = m.start(), m[0].split("."), 0
        while i + 2 < len(parts):
            n = 3 if is_signed_token(parts[i]) else 1
            size = sum(map(len, parts[i : i + n])) + n - 1
            if n == 3:
                yield "jwt", at, at + size
            at, i = at + size + 1, i + n


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for m in _HEX.finditer(text):
        found.append(("hex", *m.span()))
        if len(m[0]) % 2 == 0 and m[0].startswith("30") and is_der(bytes.fromhex(m[0])):
            found.append(("der", *m.span()))
    found += _tokens(text)
    found += _keys(text)
    order = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(set(found), key=lambda x: (x[1], order[x[0]], x[2]))


_OUT = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[dict(zip(("kind", "start", "end"), x)) for x in scan(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, spans array<struct<kind, start, end>> by start, then kind.

    Null and empty texts have no spans; null and repeated ids are kept as they are; an empty table gives
    no rows; further columns of `docs` are not looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_scanned, "id long, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def redacted(text: str, mark: str = "<secret>") -> str:
    """The text with every found span, overlapping ones as one, replaced by `mark`."""
    out, at = [], 0
    for _, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the secrets of `text_col` replaced; null texts stay null, other columns and rows stay as they are."""
    at = docs.columns.index(text_col)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([t if t is None else redacted(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(f, docs.schema)


def joined(spans: str):
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = found.withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS)))
    return base.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: SQL can't decode and parse nested key encodings; tests/llm holds the query against a brute-force scan.
QUERIES = {"op10_secret_scans": op10_secret_scans}
ORACLE_SQL: dict[str, str] = {}
