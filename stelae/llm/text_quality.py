"""Per-document text quality: natural prose, or a list, a table, or junk.

The spoken lines of a document are its lines without cue numbers, cue times,
file headers and blank lines.  No list of words of any language takes part in the
verdict; three kinds of layout are detected and weighed with what lines are made of.

*Alignment.*  A line can be divided by one of eleven kinds of delimiter: tab, bars,
dot leader, equals sign or many inner commas, wide gap, a comma series, slash, inner
dash, label colon, item mark, number cells.  ``alignment`` is the largest share of
lines divided by the same kind, so of delimiters that stand below each other.
Delimiters count as columns only where they recur in a tenth of the lines; where
one kind runs down six tenths, its lines are structure whatever words stand in them.

*Indentation.*  ``indent_period`` is the largest autocorrelation (lags 1 to 4) of the
white space before lines, 0 where it never varies.

*Line length.*  ``length_autocorrelation`` is that of their lengths.  Where both are
high, all lines are structure.

*Words, symbols, punctuation.*  A line is broken where words make up less than half of
its characters, where tokens repeat, or where its letters cannot be spoken (few
vowels or long runs of consonants, looked at in alphabets that write vowels).  A line is a label where
it holds a few words, or a series of them, without punctuation at its end.  Labels are structure only in
a document that is laid out: by alignment, by a period, or where most lines are
unpunctuated labels and delimiters or lengths recur at least in part.  Songs are
speech; sounds in brackets and bare notes are neither.  All else is speech.

A document is no prose if more lines are structure than speech; it is a *table* if
most of these are in columns, a *list* if most are labels, else *junk*.

``symbol_ratio``, ``mean_word_length``, ``punctuated_lines`` and ``common_words`` are
given beside; common words are the thousand words of most documents of the table itself,
counted over all of them.  Scripts without spaces have few words that can be common.

Texts are processed in blocks by array operations; every distinct token of a
block is looked at once.  The verdict needs no shuffle; the count of common words
shuffles one row per word and task.

Cases: null, empty and blank texts have no lines, ratios 0 and body ``empty``
and are no case; ties are prose; letters decoded wrongly are read again under the
usual wrong decodings, lost ones (``?``) count as letters; very long texts and
repeated rows need no care, each row gives one row; a null id is kept; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.sources.tables import spread

BLOCK_OCTETS = 4 << 20
#: Autocorrelation from which indentation, and line length, count as periodic.
INDENTED, RHYTHMIC = 0.7, 0.5
#: Kinds of delimiters a line can be divided by; the first ones divide cells of a table.
DELIMITERS, CELLS = 11, 5
#: Common words are this many words of most documents.
COMMON_WORDS = 1_000

# How text that is no speech of its own is marked.
_NOTES = "♪♫♩♬#*~"
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\{\\?[^{}]*\}|&(?:[a-z]+|#\d+);|^</?[A-Za-z]\w*$|^[a-z-]+=\"[^\"]*\"/?>?")
_HEADER = frozenset({"WEBVTT", "NOTE", "STYLE", "REGION", "[Script", "[Events]"})
_EDGE = ".,!?…;:\"'()[]{}¿¡«»„“”‘’-–—♪♫、。！？「」『』（）।॥؟،"
_END = tuple(".!?…。！？।॥؟♪\"»”)]）】")
_OPENS, _CLOSES = tuple("[(（【"), tuple("])）】")
_BARE = {"|": 1, "=": 2, "/": 3, "-": 4, "–": 4, "—": 4, ":": 5}
_LEADER = re.compile(r"^\.{3,}$")
_NUMBER = re.compile(r"^[-+]?\(?\d[\d.,:%/]*\)?[.):]?$")

# Vowels of the three alphabets with letters for vowels and consonants,
# and the blocks of those alphabets and of scripts that put no space between words.
_VOWELS = frozenset("aeiouyæœøıаеиоуыэюяієαεηιουω")
_ALPHABETS = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ӿḀ-ỿ]+")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

_SPLIT = re.compile(r"[.,!?…:、。！？「」『』（）・।]+")  # between words without a space

WORD, NUMBER, OTHER, MARKUP, NOTE = range(5)
#: Columns of what is known of a token.
_KNOWN = ("kind", "letters", "symbols", "chars", "worded", "alpha", "vowels", "clustered", "unspaced", "end", "inside", "bare", "opens", "closes", "comma")


def _octets(token: str, page: str) -> bytes | None:
    out = bytearray()
    for c in token:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


def _repaired(token: str) -> list[str]:
    """What a token with letters beyond ASCII may have been before it was decoded wrongly."""
    found = []
    for page in ("cp1252", "cp1251"):
        current = token
        for _ in range(3):
            octets = _octets(current, page)
            if octets is None:
                break
            try:
                current = octets.decode("utf-8")
            except UnicodeDecodeError:
                break
            found.append(current)
    octets = _octets(token, "cp1252")
    if octets and sum(b >= 0xC0 for b in octets) * 2 > len(octets):
        found.append(octets.decode("cp1251", "replace"))
    return found


def _is_word(core: str) -> bool:
    """Letters (with their marks) in the case of a word; a letter that was lost in decoding
    counts as one."""
    plain = _LOST.sub("", core).translate(_JOINERS)
    if not plain.isalpha() and not (plain and all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in plain)):
        return False
    return plain.islower() or plain.isupper() or plain[1:].islower() or not any(c.isupper() or c.islower() for c in plain)


_LOST = re.compile(r"(?<=\w)[?\ufffd]+(?=\w)")
_JOINERS = str.maketrans("", "", "'’-ʼ·\u200c\u200d")


def _sounds(core: str) -> tuple[int, int, int]:
    """Letters of a word that are in an alphabet, its vowels, and letters in runs of four or
    more consonants."""
    alpha = vowels = clustered = 0
    for run in _ALPHABETS.findall(core):
        length = 0
        for c in unicodedata.normalize("NFD", run.lower()):
            if not c.isalpha():
                continue
            alpha += 1
            if c in _VOWELS:
                vowels += 1
                clustered += length if length >= 4 else 0
                length = 0
            else:
                length += 1
        clustered += length if length >= 4 else 0
    return alpha, vowels, clustered


@lru_cache(maxsize=200_000)
def _token(raw: str) -> tuple[int, ...]:
    """What is known of a token, in the order of ``_KNOWN``."""
    if raw[0] in "0123456789" and raw.isascii() and _NUMBER.match(raw):
        letters = sum(map(str.isdigit, raw))
        return NUMBER, 0, len(raw) - letters, len(raw), 0, 0, 0, 0, 0, int(raw.endswith(_END)), 0, 0, 0, 0, int(raw[-1] == ",")
    text = _TAG.sub("", raw) if "<" in raw or "{" in raw or "&" in raw or "=" in raw else raw
    if not text:
        return MARKUP, *(0,) * 14
    core = text.strip(_EDGE)
    end, chars = int(text.endswith(_END)), len(text)
    letters = sum(map(str.isalpha, text))
    symbols = chars - letters - sum(map(str.isdigit, text))
    if not text.isascii():
        symbols -= sum(unicodedata.category(c)[0] == "M" for c in text)
    opens, closes = int(text.startswith(_OPENS)), int(text.endswith(_CLOSES))
    if not core:
        noted = all(c in _NOTES for c in text) and any(c in "♪♫♩♬" for c in text)
        if noted or (not text.isascii() and any("♪" in r for r in _repaired(text))):
            return NOTE, 0, symbols, chars, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0
        return OTHER, 0, symbols, chars, 0, 0, 0, 0, 0, end, 0, 6 if _LEADER.match(text) else _BARE.get(text, 0), opens, closes, 0
    if core in ("♪", "â™ª"):
        return NOTE, 0, symbols, chars, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0
    numeric = bool(_NUMBER.match(core))
    inside = (core.count(",") if not numeric and core.count(",") > 1 else 0) + core.count("=") + core.count("|") + (core.count(";") if core.count(";") > 1 else 0)
    kind, seen = OTHER, core
    if _NUMBER.match(text):
        kind = NUMBER
    elif _is_word(core):
        kind = WORD
    elif not inside:
        for read in (core, *(() if core.isascii() else (r.strip(_EDGE) for r in _repaired(core)))):
            if all(_is_word(part) for part in _SPLIT.split(read)):
                kind, seen = WORD, read
                break
    if kind == WORD and len(core) >= 8 and len(set(core.lower())) <= 3:
        kind = OTHER  # one beat over and over
    unspaced = len(_UNSPACED.findall(seen))
    alpha, vowels, clustered = _sounds(seen) if kind == WORD else (0, 0, 0)
    worded = chars if kind == WORD else 0
    return kind, letters, symbols, chars, worded, alpha, vowels, clustered, unspaced, end, inside, _BARE.get(text, 0), opens, closes, int(text.endswith(","))


class _Lines:
    """Lines and tokens of a block of texts as arrays."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        bounds = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, stop = int(bounds[0]), int(bounds[-1])
        self.octets = np.frombuffer(data, np.uint8)[base:stop] if data is not None and stop > base else np.empty(0, np.uint8)
        self.bounds = bounds - base
        size = len(self.octets)
        table = np.zeros(256, np.uint8)
        table[[9, 11, 12, 32]] = 1
        table[[10, 13]] = 2
        kind = table[self.octets]
        wide = self.octets == 0xC2  # no-break space separates as well
        if wide.any():
            at = np.flatnonzero(wide[:-1] & (self.octets[1:] == 0xA0))
            kind[at], kind[at + 1] = 1, 1
        breaks = np.zeros(size + 1, bool)  # a token never spans two texts
        breaks[self.bounds[:-1][self.bounds[:-1] < size]] = True
        inside = kind == 0
        before = np.concatenate([[False], inside[:-1]]) if size else inside
        after = np.concatenate([inside[1:], [False]]) if size else inside
        self.start = np.flatnonzero(inside & (~before | breaks[:size]))
        self.stop = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        line_breaks = np.cumsum(np.concatenate([[0], (kind == 2).astype(np.int32)]))
        self.text = np.searchsorted(self.bounds, self.start, "right") - 1
        number = line_breaks[self.start] + self.text  # distinct for lines of different texts
        fresh = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.empty(0, bool)
        self.first = np.flatnonzero(fresh)
        self.line = np.cumsum(fresh) - 1 if len(number) else np.empty(0, np.int64)
        self.lines = len(self.first)
        opens = np.zeros(size + 1, bool)  # where lines begin, blank ones too
        opens[np.flatnonzero(kind == 2) + 1] = True
        opens[self.bounds[:-1]] = True
        opened = np.flatnonzero(opens)
        begun = self.start[self.first]
        self.indent = begun - opened[np.searchsorted(opened, begun, "right") - 1] if len(begun) else begun

    def tokens(self) -> tuple[np.ndarray, list[str]]:
        """Code of every token and the distinct tokens."""
        if not len(self.start):
            return np.empty(0, np.int64), []
        offsets = np.empty(2 * len(self.start) + 1, np.int64)
        offsets[0:-1:2], offsets[1::2], offsets[-1] = self.start, self.stop, self.stop[-1]
        offsets[0:-1:2] = self.start
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), 2 * len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.octets.tobytes())]
        )
        coded = pc.dictionary_encode(pieces.take(pa.array(np.arange(0, 2 * len(self.start), 2))))
        return coded.indices.to_numpy(zero_copy_only=False), [t.decode("utf-8", "replace") for t in coded.dictionary.to_pylist()]

    def raw(self, line: int) -> str:
        first = self.first[line]
        last = (self.first[line + 1] if line + 1 < self.lines else len(self.start)) - 1
        return self.octets[self.start[first] : self.stop[last]].tobytes().decode("utf-8", "replace")


def _autocorrelation(values: np.ndarray, group: np.ndarray, groups: int, lags=(1, 2, 3, 4)) -> np.ndarray:
    """Largest autocorrelation over the lags of each group's sequence; 1 for a
    constant sequence of at least six values, 0 for a shorter one."""
    count = np.bincount(group, minlength=groups)
    mean = np.bincount(group, values, groups) / np.maximum(count, 1)
    off = values - mean[group]
    spread = np.bincount(group, off * off, groups)
    best = np.zeros(groups)
    for lag in lags:
        if len(values) <= lag:
            break
        same = group[lag:] == group[:-lag]
        product = np.bincount(group[lag:][same], (off[lag:] * off[:-lag])[same], groups)
        scale = spread * np.maximum(count - lag, 0) / np.maximum(count, 1)
        best = np.maximum(best, np.where(scale > 1e-9, product / np.maximum(scale, 1e-9), 0))
    best = np.where((spread <= 1e-9) & (count > 0), 1.0, np.minimum(best, 1.0))
    return np.where(count >= 6, best, 0.0)


def _recurring(text: np.ndarray, delimiter: np.ndarray, counted: np.ndarray, groups: int) -> np.ndarray:
    """Share of each text's counted lines that are divided by each kind of delimiter; kind 0 is none."""
    kinds = DELIMITERS + 1
    held = np.bincount(text * kinds + delimiter, counted, groups * kinds).reshape(groups, kinds)
    shares = held / np.maximum(held.sum(axis=1, keepdims=True), 1)
    shares[:, 0] = 0.0
    return np.where(held[:, 1:].sum(axis=1, keepdims=True) > 1, shares, 0.0)  # one line is below no other


FIELDS = (
    ("lines", pa.int64(), "long"), ("words", pa.int64(), "long"), ("mean_word_length", pa.float64(), "double"),
    ("symbol_ratio", pa.float64(), "double"), ("punctuated_lines", pa.float64(), "double"),
    ("common_words", pa.float64(), "double"), ("alignment", pa.float64(), "double"), ("indent_period", pa.float64(), "double"),
    ("length_autocorrelation", pa.float64(), "double"), ("structured_lines", pa.float64(), "double"), ("body", pa.string(), "string"),
)


def _spoken(block: _Lines, codes: np.ndarray, distinct: list[str]) -> np.ndarray:
    """The lines that are no cue numbers, times, headers or blanks."""
    flagged = lambda test: np.array([test(t) for t in distinct], bool)[codes] if distinct else np.empty(0, bool)
    alone = flagged(lambda t: t.strip("\ufeff").isdigit() or t in _HEADER or not t.strip("\ufeff\u200b"))
    timed = np.bincount(block.line, flagged(lambda t: t == "-->"), block.lines) > 0
    return ~(timed | ((np.bincount(block.line, minlength=block.lines) == 1) & alone[block.first]))


def _plain(token: str) -> str:
    """A token as a word to be counted: lower case, without marks at its edges."""
    return _TAG.sub("", token).strip(_EDGE).lower().replace("’", "'")


def measure(texts: pa.Array, common: frozenset[str] = frozenset()) -> list[np.ndarray]:
    """The columns ``FIELDS`` for a block of texts without nulls."""
    groups = len(texts)
    block = _Lines(texts)
    codes, distinct = block.tokens()
    table = np.array([_token(t) for t in distinct], np.int32).reshape(len(distinct), len(_KNOWN))
    known = dict(zip(_KNOWN, table[codes].T))
    kind, bare, end = known["kind"], known["bare"], known["end"]
    line, lines = block.line, block.lines
    total = lambda v: np.bincount(line, v, lines)
    spoken = _spoken(block, codes, distinct)

    # Gaps between tokens of a line: tabs and wide spaces are delimiters.
    gap = np.zeros(len(line), np.int64)
    tab, again = np.zeros(len(line), bool), np.zeros(len(line), bool)
    if len(line) > 1:
        width = block.start[1:] - block.stop[:-1]
        same = line[1:] == line[:-1]
        gap[:-1] = np.where(same, width, 0)
        tab[:-1] = same & (width == 1) & (block.octets[np.minimum(block.stop[:-1], len(block.octets) - 1)] == 9)
        again[1:] = same & (codes[1:] == codes[:-1])
    n = total(np.ones(len(line)))
    first, last = block.first, np.concatenate([block.first[1:], [len(line)]])[:lines] - 1
    at_first = np.zeros(len(line), bool)
    at_first[first] = True
    at_last = np.zeros(len(line), bool)
    at_last[last] = True

    words, numbers = total(kind == WORD), total(kind == NUMBER)
    marks, notes = total(kind == MARKUP), total(kind == NOTE)
    real = n - marks - notes
    ended = end[last].astype(bool)
    tabs, wides = total(tab), total(gap >= 2)
    bars, equals, leaders = total(bare == 1), total(bare == 2), total((bare == 6) & ~at_last)
    inner, slashes, colons = total(known["inside"]), total(bare == 3), total(bare == 5)
    dashes = total((bare == 4) & ~at_first)  # not those that open a turn of speech
    commas = total(known["comma"])
    columns = (tabs > 0) | (bars >= 2) | (wides >= 2) | (inner >= 2) | (leaders > 0)

    # Sounds are marked at both ends; like a bare note they are neither speech nor structure.
    second = np.minimum(first + 1, last)
    opened = known["opens"][first] | ((bare[first] == 4) & known["opens"][second])
    neutral = spoken & ~columns & ((notes > 0) & (real == 0) | ((opened > 0) & (known["closes"][last] > 0)))

    # What a line is made of: words, or symbols, numbers, repeats, letters in no order.
    chars, alpha = np.maximum(total(known["chars"] * (kind != NOTE)), 1), total(known["alpha"])
    wordless = total(known["worded"]) < 0.5 * chars
    repeating = (n >= 4) & (2 * total(again) >= n)
    unpronounced = (alpha >= 6) & ((total(known["vowels"]) < 0.26 * alpha) | (total(known["clustered"]) >= 0.3 * alpha))
    broken = spoken & ~neutral & ~columns & (wordless | repeating | unpronounced)
    short = words <= 12  # parts of an entry, not of sentences
    slashes, dashes, colons = slashes * short, dashes * short, colons * short
    delimited = (equals > 0) | (slashes > 0) | (dashes > 0) | (colons > 0)
    series = ~ended & (commas >= 2) & (words + numbers <= 2 * (commas + 1))
    # A label names something: a few words that end in no punctuation, or parts of a series.
    label = spoken & ~neutral & ~columns & ~broken & ~ended & (notes == 0) & (total(known["unspaced"]) == 0)
    label &= (words <= 3) & (commas == 0) | delimited & (words <= 6) | series

    # Delimiters, margins and lengths of the lines of each text.
    text_of = block.text[first]
    at = np.flatnonzero(spoken)
    group = text_of[at]
    per = lambda v: np.bincount(text_of, v * spoken, groups)
    shown = per(np.ones(lines))
    lengths = (block.stop[last] - block.start[first])[at].astype(float)
    marked = label & ((kind[first] == NUMBER) | (kind[first] == OTHER)) & (n > 1)
    delimiter = np.select(
        [tabs > 0, bars >= 2, leaders > 0, (equals > 0) | (inner >= 2), (wides >= 2) | (wides > 0) & label, series, slashes > 0, dashes > 0,
         colons > 0, marked, label & (numbers > 0)],
        np.arange(1, DELIMITERS + 1), 0,
    )
    counted = spoken & ~neutral
    recurring = _recurring(text_of, delimiter, counted, groups)
    alignment, delimited_lines = recurring.max(axis=1, initial=0.0), recurring.sum(axis=1)
    aligned = recurring[text_of, delimiter]
    margins = block.indent[at].astype(float)
    varies = np.bincount(group, margins != margins[np.searchsorted(group, group)], groups) > 0
    indent = np.where(varies, _autocorrelation(margins, group, groups), 0.0)
    rhythm = _autocorrelation(lengths, group, groups)
    punctuated = per(ended.astype(float)) / np.maximum(shown, 1)

    # Delimiters are columns where they recur down the document; where they run down most of
    # it, or indentation and length are periodic together, they make structure of any words.
    laid_out = ((indent >= INDENTED) & (rhythm >= RHYTHMIC))[text_of] & (notes == 0)
    in_columns = (columns & (aligned >= 0.1)) | (aligned >= 0.6)
    # Labels are structure where the document is laid out: by columns, by a period, or where
    # most of its lines are labels and its delimiters or lengths recur at least in part.
    plain = counted & ~columns & ~broken
    share = lambda v: per((v & plain).astype(float)) / np.maximum(per(plain.astype(float)), 1)
    labels = share(label)
    listed = (
        (alignment >= 0.5) | (indent >= INDENTED) | (rhythm >= RHYTHMIC) & (labels >= 0.25)
        | (labels >= 0.5) & (share(ended) < 0.4) & ((delimited_lines >= 0.25) | (rhythm >= RHYTHMIC / 2))
    )
    structure = counted & (in_columns | broken | laid_out | label & listed[text_of])
    speech = counted & ~structure

    structured, spoke = per(structure.astype(float)), per(speech.astype(float))
    within = structure.astype(float)
    tabled = per(within * (in_columns & (delimiter <= CELLS)))
    named = per(within * (label | laid_out | (in_columns & (delimiter > CELLS))))
    case = structured > spoke
    body = np.where(
        shown == 0, "empty",
        np.where(~case, "prose", np.where(2 * tabled > structured, "table", np.where(2 * named >= structured, "list", "junk"))),
    )
    in_spoken = spoken[line]
    word_text = block.text[(kind == WORD) & in_spoken]
    n_words = np.bincount(word_text, minlength=groups)
    spoken_text = block.text[in_spoken]
    of_spoken = lambda c: np.bincount(spoken_text, known[c][in_spoken], groups)
    usual = np.array([_plain(t) in common for t in distinct], float)[codes] if common and distinct else np.zeros(len(line))
    return [
        shown.astype(np.int64), n_words,
        np.bincount(word_text, known["letters"][(kind == WORD) & in_spoken], groups) / np.maximum(n_words, 1),
        of_spoken("symbols") / np.maximum(of_spoken("chars"), 1), punctuated,
        np.bincount(word_text, usual[(kind == WORD) & in_spoken], groups) / np.maximum(n_words, 1),
        alignment, indent, rhythm, structured / np.maximum(structured + spoke, 1), body,
    ]


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into blocks of bounded octets, or of one text."""
    for batch in batches:
        sizes, start = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_OCTETS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _measured(result: pa.Schema, common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, 1):
            columns = measure(part.column(1), common)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, f[1]) for c, f in zip(columns, FIELDS))], schema=result
            )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, held`` per block: in how many of its texts a spoken word stands."""
    for part in _blocks(batches, 0):
        block = _Lines(part.column(0))
        codes, distinct = block.tokens()
        named = [_plain(t) for t in distinct]
        words = sorted({w for w in named if _is_word(w)})
        place = {w: i for i, w in enumerate(words)}
        if not words:
            continue
        word = np.array([place.get(w, -1) for w in named])[codes]
        kept = _spoken(block, codes, distinct)[block.line] & (word >= 0)
        pairs = np.unique(block.text[kept] * len(words) + word[kept])
        held = np.bincount(pairs % len(words), minlength=len(words))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in seen]), pa.array(held[seen], pa.int64())], names=["word", "held"])


def common_words(docs: DataFrame, text: str, most: int = COMMON_WORDS) -> DataFrame:
    """``word, documents``: the ``most`` words that stand in the spoken lines of most
    documents, whatever their languages; ties in order of the words."""
    counts = spread(docs.filter(F.length(text) > 0).select(text)).mapInArrow(_counted, "word string, held long")
    return counts.groupBy("word").agg(F.sum("held").alias("documents")).orderBy(F.col("documents").desc(), "word").limit(most)


def layouts(docs: DataFrame, key: str, text: str, common: frozenset[str] = frozenset()) -> DataFrame:
    """``key`` and ``FIELDS`` for every row of ``docs``; no words but ``common`` are common."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    result = pa.schema([pa.field("id", to_arrow_type(kind)), *(pa.field(n, t) for n, t, _ in FIELDS)])
    ddl = ", ".join([f"id {kind.simpleString()}", *(f"{n} {d}" for n, _, d in FIELDS)])
    texts = spread(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return texts.mapInArrow(_measured(result, common), ddl).withColumnRenamed("id", key)


def statistics(docs: DataFrame, key: str, text: str, most: int = COMMON_WORDS) -> DataFrame:
    """``key`` and ``FIELDS`` for every row of ``docs``, common words being those of
    ``docs`` itself.  They are ``most`` short rows, which the driver hands to the tasks."""
    common = frozenset(r.word for r in common_words(docs, text, most).collect())
    return layouts(docs, key, text, common)


def not_prose(measured: DataFrame) -> DataFrame:
    """The documents that are lists, tables or junk."""
    return measured.filter(F.col("body").isin("list", "table", "junk"))
