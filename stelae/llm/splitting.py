"""Splitting oversized items at natural boundaries.

A content longer than ``limit`` octets is cut by a hierarchy of separators:
sections, paragraphs, sentences (and line ends), words, characters.  A part that
is still too long is cut by the next separator, down to characters; the parts
are then packed greedily, in order, into pieces of at most ``limit`` octets.  A
piece repeats the end of the piece before it: it starts at the first sentence
start inside its last ``overlap`` octets, else at the first word start there,
else at the first character start.  Parts are at most ``limit - overlap`` octets,
so the repeated end always fits.

Contents are octets.  A character start is any octet that does not continue a
UTF-8 sequence, or the fourth and every later continuation octet in a row, so
invalid text is cut too and valid text never inside a character.

Cases: the octets decide, a length column is not looked at; null, empty and
short contents give no piece; repeated rows are one item; different contents
under one key are different items (``content_id``); a null key is kept; a
content of one unbroken word or of blanks is cut at characters; empty tables
give no row; other columns are ignored.  Contents are processed whole and only
the long ones are shuffled, once, to drop repeats.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4_000
OVERLAP = 200

_LINE = rb"(?:\r\n|\n|\r|\xc2\x85|\xe2\x80\xa8|\xe2\x80\xa9)"
_BLANK = rb"[ \t]*"
#: Separators from coarse to fine; a part ends where a match ends.
_SEPARATORS = (
    (
        "section",
        re.compile(
            rb"\f|" + _LINE + rb"(?:" + _BLANK + _LINE + rb"){2,}|" + _LINE + rb"(?=#{1,6} )|"
            + _LINE + _BLANK + rb"(?:={3,}|-{3,}|\*{3,}|_{3,})" + _BLANK + _LINE
        ),
    ),
    ("paragraph", re.compile(_LINE + rb"(?:" + _BLANK + _LINE + rb")+")),
    (
        "sentence",
        re.compile(
            rb"[.!?]+[\"')\]]*[ \t]+|" + _LINE
            + rb"|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe2\x80\xa6)+(?:\xe3\x80\x8d|\xe3\x80\x8f)?[ \t]*"
        ),
    ),
    ("word", re.compile(rb"(?:[ \t\n\r\v\f]|\xc2\xa0|\xe3\x80\x80)+")),
)
LEVELS = tuple(name for name, _ in _SEPARATORS) + ("character", "end")


def _character_starts(octets: bytes) -> np.ndarray:
    """True at offsets where a piece may start."""
    follows = (np.frombuffer(octets, np.uint8) & 0xC0) == 0x80
    starts = ~follows
    run = follows.copy()
    for _ in range(3):  # a fourth continuation octet in a row continues nothing
        run[1:] &= run[:-1].copy()
        run[:1] = False
    return starts | run


class _Cuts:
    """Sorted cut offsets of one content at every level."""

    def __init__(self, octets: bytes):
        self.octets = octets
        self.levels = [[m.end() for m in pattern.finditer(octets)] for _, pattern in _SEPARATORS]
        self._starts: np.ndarray | None = None

    def character_at_most(self, offset: int, above: int) -> int:
        """The last character start in (above, offset], else ``offset``."""
        if self._starts is None:
            self._starts = _character_starts(self.octets)
        if offset >= len(self.octets):
            return len(self.octets)
        for at in range(offset, max(above, offset - 4), -1):
            if self._starts[at]:
                return at
        return offset

    def character_at_least(self, offset: int, below: int) -> int:
        if self._starts is None:
            self._starts = _character_starts(self.octets)
        for at in range(offset, min(below, offset + 4)):
            if self._starts[at]:
                return at
        return below

    def parts(self, start: int, stop: int, most: int) -> list[tuple[int, int]]:
        """Ends and levels of parts of at most ``most`` octets; the last end is ``stop``."""
        out: list[tuple[int, int]] = []
        work = [(start, stop, 0, len(LEVELS) - 1)]
        while work:
            a, b, level, closing = work.pop()
            if b - a <= most:
                out.append((b, closing))
            elif level == len(self.levels):
                while b - a > most:
                    a = self.character_at_most(a + most, a)
                    out.append((a, level))
                out.append((b, closing))
            else:
                cuts = self.levels[level]
                inner = cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]
                bounds = [a, *inner, b]
                parts = [
                    (x, y, level + 1, closing if y == b else level) for x, y in zip(bounds, bounds[1:])
                ]
                work.extend(reversed(parts))
        return out

    def resume(self, stop: int, overlap: int) -> int:
        """Where the piece after one that ends at ``stop`` starts."""
        least = stop - overlap
        for cuts in (self.levels[2], self.levels[3]):
            at = bisect_left(cuts, least)
            if at < len(cuts) and cuts[at] < stop:
                return cuts[at]
        return self.character_at_least(least, stop)


def split(octets: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """``start, stop, level`` of the pieces of a content, in order.

    ``level`` names the boundary at ``stop``.  A content of at most ``limit``
    octets is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(octets) <= limit:
        return [(0, len(octets), "end")]
    cuts = _Cuts(octets)
    pieces, start, stop, closing = [], 0, 0, 0
    for end, level in cuts.parts(0, len(octets), limit - overlap):
        if end - start > limit:
            pieces.append((start, stop, LEVELS[closing]))
            start = max(cuts.resume(stop, overlap), start + 1) if overlap else stop
        stop, closing = end, level
    pieces.append((start, stop, LEVELS[closing]))
    return pieces


_PIECES = (
    "document string, content_id string, piece int, start long, stop long, level string, overlap int, content binary"
)
_SCHEMA = pa.schema([
    ("document", pa.string()), ("content_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()),
    ("stop", pa.int64()), ("level", pa.string()), ("overlap", pa.int32()), ("content", pa.binary()),
])


def pieces(rows: DataFrame, key: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every content longer than ``limit``, as ``_PIECES``.

    ``overlap`` is the number of octets shared with the piece before.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for name, identity, octets in zip(*(batch.column(i) for i in range(3))):
                octets = octets.as_py()
                before = 0
                for number, (start, stop, level) in enumerate(split(octets, limit, overlap)):
                    shared = max(0, before - start) if number else 0
                    out.append((name.as_py(), identity.as_py(), number, start, stop, level, shared, octets[start:stop]))
                    before, size = stop, size + stop - start
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], schema=_SCHEMA)
                        out, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], schema=_SCHEMA)

    long = rows.filter(F.octet_length(content) > limit).select(
        F.col(key).cast("string").alias("document"),
        F.sha2(F.col(content), 256).alias("content_id"),
        F.col(content).alias("content"),
    )
    return long.dropDuplicates(["document", "content_id"]).mapInArrow(cut, _PIECES)
