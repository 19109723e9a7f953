"""Secrets in texts: an Aho-Corasick automaton finds keywords, anchored
regular expressions run only where one stands, and kinds that carry a
checksum are kept if it is right.

Every pattern is of ASCII characters, so matching bytes of UTF-8 gives the
same spans as matching code points. The texts of a slice are joined by line
breaks, which no pattern takes in, and go through the automaton as one.

A run of hexadecimal digits has no keyword; its hits are places at which 24
digits follow, found by and-ing shifted masks of the whole slice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from subscope.llm.common import text_slices

# Kinds in the order in which spans of one start are listed,
# their keywords in lower case, and their patterns.
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
PATTERNS = {
    "assign": rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_[A-Za-z0-9]+",
    "npm": rb"npm_[A-Za-z0-9]+",
}
VALUE, ACCESS, HEX = 6, 20, 24  # least lengths
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def base62(n: int, size: int = 6) -> bytes:
    out = bytearray()
    for _ in range(size):
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return bytes(out[::-1])


def checksum_right(token: bytes) -> bool:
    """Of a prefix up to ``_``, 30 characters, and their CRC-32 as six digits
    to the base of 62."""
    body = token[token.index(b"_") + 1:]
    return len(body) == 36 and base62(zlib.crc32(body[:30])) == body[30:]


def _kept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= VALUE
    if kind == "access":
        return m.end() - m.start() >= ACCESS
    return checksum_right(m.group())


class Scanner:
    """Spans of joined texts, by kind."""

    def __init__(self):
        self.words = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                self.words.add_word(w, (kind, len(w)))
        self.words.make_automaton()
        self.patterns = {k: re.compile(p) for k, p in PATTERNS.items()}

    def hits(self, data: bytes) -> dict[str, list[int]]:
        """Starts of keywords in either case, ascending."""
        out: dict[str, list[int]] = {k: [] for k in KEYWORDS}
        for end, (kind, size) in self.words.iter(data.lower().decode("latin-1")):
            out[kind].append(end - size + 1)
        return {k: sorted(x) for k, x in out.items()}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, kind's number), ascending."""
        out = []
        for kind, starts in self.hits(data).items():
            match, at, number = self.patterns[kind].match, 0, KINDS.index(kind)
            for s in starts:
                if s >= at and (m := match(data, s)):
                    at = m.end()  # also of a match that is dropped
                    if _kept(kind, m):
                        out.append((s, at, number))
        out += [(s, e, KINDS.index("hex")) for s, e in hex_runs(np.frombuffer(data, np.uint8))]
        return sorted(out, key=lambda x: (x[0], x[2]))


def hex_runs(data: np.ndarray, least: int = HEX) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` hexadecimal digits."""
    if len(data) < least:
        return []
    digit = _HEX[data]
    runs, size = digit, 1  # runs[i]: a digit stands at i and at the size - 1 places after it
    while size < least:
        step = min(size, least - size)
        runs, size = runs[: len(runs) - step] & runs[step:], size + step
    hits = np.flatnonzero(runs)
    if not len(hits):
        return []
    new = np.r_[True, hits[1:] != hits[:-1] + 1]
    starts, lasts = hits[new], hits[np.r_[new[1:], True]]
    return list(zip(starts.tolist(), (lasts + least).tolist()))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): of every row the secrets of its whole text as
    array<struct<kind, start, end>> in code points, end exclusive, by start
    and then in the order of ``KINDS``. Null and empty texts have none;
    repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for s in text_slices(batch, text_col):
                texts = s.column(1).cast(pa.large_binary()).to_pylist()
                starts = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
                data = b"\n".join(t or b"" for t in texts)
                found = scanner.spans(data)
                doc = np.searchsorted(starts, [f[0] for f in found], side="right") - 1
                out: list[list[dict]] = [[] for _ in texts]
                if found:
                    solid = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
                    for d, (a, b, kind) in zip(doc.tolist(), found):
                        base = solid[starts[d]]
                        out[d].append({"kind": KINDS[kind], "start": int(solid[a] - base), "end": int(solid[b] - base)})
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(out, pa.list_(pa.struct(
                        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=[id_col, "spans"])

    span = StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = docs.select(id_col).schema.add("spans", ArrayType(span))
    return docs.select(id_col, text_col).mapInArrow(run, schema)
