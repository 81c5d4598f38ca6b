"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns look only where one was hit, checksums decide.

Three base kinds (assign, access, hex) are matched leftmost and without overlap within a kind.  Further kinds are tokens
that carry a checksum of their own: they count only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
#: A prefix, 30 characters of entropy, and six of their CRC-32 in base 62.
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The keywords of each kind, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}
#: The order of kinds that begin at one place.
ORDER = {"assign": 0, "access": 1, "hex": 2, "checked": 3}
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Hex runs have no keyword of letters: the text is mapped to two symbols, and the keyword is a run of one of them.
_HEX_MAP = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_KEYWORD = b"\1" * LEAST_HEX


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(entropy: bytes) -> bytes:
    """The CRC-32 of entropy as six digits to the base 62."""
    n, out = zlib.crc32(entropy), bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        out.append(BASE62[d])
    return bytes(reversed(out))


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= LEAST_ASSIGN
    if kind == "access":
        return m.end() - m.start() >= LEAST_ACCESS
    return checksum(m[0][4:34]) == m[0][34:]


def _spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind.  All patterns are ASCII, so bytes and text match alike."""
    found, free = [], dict.fromkeys(PATTERNS, 0)
    for last, (kind, size) in _automaton().iter(data.lower().decode("latin-1")):
        start = last - size + 1
        # hits of one kind come by their ends; no keyword holds another of its kind later on, so starts ascend too
        if start >= free[kind] and (m := PATTERNS[kind].match(data, start)):
            free[kind] = m.end()
            if _passes(kind, m):
                found.append((start, m.end(), kind))
    mapped, at = data.translate(_HEX_MAP), 0
    while (start := mapped.find(_HEX_KEYWORD, at)) >= 0:
        at = HEX.match(data, start).end()
        found.append((start, at, "hex"))
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret in text, in code points, end exclusive; by start, then kind."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = _spans(data)
    if not found or data.isascii():
        return [(kind, a, b) for a, b, kind in found]
    at = points = 0
    place = {}
    for edge in sorted({x for a, b, _ in found for x in (a, b)}):
        # bytes that begin a code point
        points += sum(1 for x in data[at:edge] if x & 0xC0 != 0x80) if edge - at < 64 else len(data[at:edge].decode("utf-8", "replace"))
        at, place[edge] = edge, points
    return [(kind, place[a], place[b]) for a, b, kind in found]


def _row(text: str | None) -> tuple[int, int, int, int, str, str]:
    found = scan(text)
    kinds = [kind for kind, *_ in found]
    told = [f"{kind}:{a}:{b}" for kind, a, b in found]
    base = ",".join(x for x, kind in zip(told, kinds) if kind != "checked")
    return (*(kinds.count(k) for k in ("assign", "access", "hex", "checked")), hashlib.sha256(base.encode()).hexdigest(), ",".join(told))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(x.as_py()) for x in batch.column("text")]
        longs = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, which needs doc_id (long) and text; other columns are ignored.

    Counts of each kind, the SHA-256 of the base spans, and all spans as kind:start:end.  Null and empty texts have no
    span and the digest of an empty string.  Null doc_ids and repeated rows stay as they are.  An empty table gives no rows.  No shuffle: each text is
    scanned where it is read, one at a time.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned, SCHEMA)
