"""Encoding of a whole corpus with a public byte-level tokenizer.

Byte-pair merges never cross the words of the tokenizer's own pattern, so a
corpus is encoded word by word and every distinct word only once.

1. *Split.*  Spark splits each text by the tokenizer's pattern and keeps the
   words' octet lengths; words are then slices of the text by position.  Texts
   with code points that this Java does not know (``\\p{Cn}``) are split by the
   tokenizer itself, since their class may differ there.
2. *Blocks.*  Texts are hashed into blocks of about ``block_octets`` octets.  The
   distinct words of each block are taken once (``block, word``).
3. *Distinct words.*  The words of these pairs, combined on the map side, are encoded
   once each: the table ``word, ids`` has one row per word.  It is joined back to the
   pairs, of which a common word has one per block; its side of the join is unique, so
   adaptive execution splits such a word's pairs over tasks.
4. *Ids by position.*  Each block meets its own dictionary; words are replaced by
   their ids by position, without a row or a Python object per word.

Decoding goes the same way back: the distinct ids of every block are joined with the
table of pieces by id, and each block puts its texts together by position.

Nothing but one number, the size of the corpus, reaches the driver.  The table of pieces is
as large as the vocabulary, whatever the corpus.  A task holds one block at a time, or one text where a text is larger
than a block; texts are never cut.  The number of shuffle partitions follows the size of the
corpus, up to ``MOST_PARTITIONS``; beyond that partitions grow, blocks do not.

Cases: empty and null texts have the empty list of ids (0 tokens); blank texts
are encoded like others; a null id is kept; repeated rows and repeated ids give
one result row each; strings of special tokens in a text are ordinary text; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.sources.tables import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_OCTETS = 4 << 20
#: Text per shuffle partition, and the most partitions of one shuffle.
PARTITION_OCTETS = 8 << 20
MOST_PARTITIONS = 50_000

# The pattern of the byte-level vocabularies, with the white space
# of the tokenizer spelled out because Java's \s is ASCII only.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^SPACE\p{L}\p{N}]++|[SPACE]+(?![^SPACE])|[SPACE]+"
).replace("SPACE", _SPACE)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _word_octets(text: str, path: str) -> list[int]:
    """Octet lengths of a text's words as the tokenizer itself splits it."""
    spans = _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)
    return [len(text[a:b].encode()) for _, (a, b) in spans]


def word_octets(text: Column) -> Column:
    """Octet lengths of a text's words; null where Java cannot split it as the
    tokenizer does."""
    words = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(~text.rlike(r"\p{Cn}"), F.transform(words, F.octet_length))


class _Words:
    """The words of a column of texts, as slices of its octets, without copies."""

    def __init__(self, texts: pa.Array, lengths: pa.Array, path: str):
        unsplit = np.flatnonzero(lengths.is_null().to_numpy(zero_copy_only=False))
        if len(unsplit):
            split = lengths.to_pylist()
            for row in unsplit:
                split[row] = _word_octets(texts[int(row)].as_py(), path)
            lengths = pa.array(split, pa.list_(pa.int32()))
        counts = pc.list_value_length(lengths).to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        sizes = pc.list_flatten(lengths).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)).buffers()[1]
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if int(sizes.sum()) != int(ends[-1] - ends[0]):
            raise ValueError("the words of a text do not make up the text")
        self.words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes), [None, offsets, (data or pa.py_buffer(b"")).slice(int(ends[0]))]
        )


def _distinct_words(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``block, word`` once per block and batch, from texts sorted by block."""
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy(zero_copy_only=False)  # sorted
            starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            for start, stop in zip(starts, [*starts[1:], len(blocks)]):
                part = batch.slice(int(start), int(stop - start))
                words = _Words(part.column(2), part.column(3), path).words
                found = pc.unique(words).cast(pa.binary())
                for at in range(0, len(found), 50_000):
                    some = found.slice(at, 50_000)
                    block = pa.array(np.full(len(some), blocks[start]), pa.int32())
                    yield pa.RecordBatch.from_arrays([block, some.cast(pa.string())], names=["block", "word"])

    return run


def _encoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``word, ids`` of every word."""
        for batch in batches:
            coded = _tokenizer(path).encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.ids for e in coded], pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _by_position(path: str, ids_wanted: bool, result: pa.Schema) -> Callable:
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return result.empty_table()
        texts, words = texts.combine_chunks(), words.combine_chunks()
        column = lambda t, name: t.column(name).chunk(0) if t.num_rows else pa.array([], t.schema.field(name).type)
        split = _Words(column(texts, "text"), column(texts, "lengths"), path)
        known = column(words, "word").cast(pa.large_binary())
        at = pc.index_in(split.words, value_set=known)
        if at.null_count:
            raise ValueError("a word of a text is not in the table of words")
        at = at.to_numpy(zero_copy_only=False)
        lists = column(words, "ids")
        first = lists.offsets.to_numpy(zero_copy_only=False)
        each = np.diff(first)[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        keys = texts.column("id").combine_chunks()
        if not ids_wanted:
            tokens = pa.array(ends[split.bounds[1:]] - ends[split.bounds[:-1]], pa.int64())
            return pa.table([keys, tokens], schema=result)
        from_ = np.repeat(first[:-1][at] - ends[:-1], each) + np.arange(ends[-1])
        ids = lists.values.to_numpy(zero_copy_only=False)[from_]
        of_text = pa.ListArray.from_arrays(pa.array(ends[split.bounds], pa.int32()), pa.array(ids, pa.int32()))
        return pa.table([keys, of_text.cast(result.field("ids").type)], schema=result)

    return run


def _partitions(rows: DataFrame, octets: int, blocks: int) -> int:
    """Shuffle partitions for texts of ``octets`` in ``blocks``: as many as their size asks for
    or the session can run at once, never more than there are blocks."""
    asked = min(-(-octets // PARTITION_OCTETS), MOST_PARTITIONS)
    return max(1, min(blocks, max(asked, rows.sparkSession.sparkContext.defaultParallelism)))


def word_table(pairs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``word, ids`` of every distinct word of ``pairs``, each encoded once."""
    return pairs.select("word").distinct().mapInArrow(_encoder(path), "word string, ids array<int>")


def _encoded(docs: DataFrame, key: str, text: str, path: str, block_octets: int, ids_wanted: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    octets = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-octets // block_octets))
    content = F.coalesce(F.col(text), F.lit(""))
    split = spread(docs.select(F.col(key).alias("id"), content.alias("text"))).select(
        F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text", word_octets(F.col("text")).alias("lengths")
    )
    texts = split.repartition(_partitions(docs, octets, blocks), "block")
    # All columns, though the ids are not needed: with the same columns on all
    # paths the texts are split and shuffled once and the exchange is reused.
    pairs = texts.sortWithinPartitions("block").mapInArrow(_distinct_words(path), "block int, word string")
    dictionary = pairs.join(word_table(pairs, path), "word").select("block", "word", "ids")
    kind = docs.schema[key].dataType
    out = pa.field("ids", pa.list_(pa.int32())) if ids_wanted else pa.field("tokens", pa.int64())
    result = pa.schema([pa.field("id", to_arrow_type(kind)), out])
    named = "ids array<int>" if ids_wanted else "tokens long"
    return (
        texts.groupBy("block")
        .cogroup(dictionary.groupBy("block"))
        .applyInArrow(_by_position(path, ids_wanted, result), f"id {kind.simpleString()}, {named}")
        .withColumnRenamed("id", key)
    )


def encoded(docs: DataFrame, key: str, text: str, path: str = TOKENIZER, block_octets: int = BLOCK_OCTETS) -> DataFrame:
    """``key, ids`` of every row, without special tokens."""
    return _encoded(docs, key, text, path, block_octets, True)


def token_counts(docs: DataFrame, key: str, text: str, path: str = TOKENIZER, block_octets: int = BLOCK_OCTETS) -> DataFrame:
    """``key, tokens`` of every row: the lengths of ``encoded`` without the lists."""
    return _encoded(docs, key, text, path, block_octets, False)


def _byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the rest, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def pieces(path: str = TOKENIZER) -> list[bytes]:
    """Octets of every piece by id; as many entries as the vocabulary has."""
    byte = _byte_of_character()
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        table[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return table


def piece_table(spark: SparkSession, path: str = TOKENIZER) -> DataFrame:
    """``token, piece``: the octets of every piece of the vocabulary."""
    rows = [(i, bytearray(p)) for i, p in enumerate(pieces(path))]
    return spark.createDataFrame(rows, "token int, piece binary")


def _distinct_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, token`` once per block and batch, from lists sorted by block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        for start, stop in zip(starts, [*starts[1:], len(blocks)]):
            ids = np.unique(pc.list_flatten(batch.column(2).slice(int(start), int(stop - start))).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), blocks[start]), pa.int32()), pa.array(ids, pa.int32())], names=["block", "token"])


def _put_together(result: pa.Schema) -> Callable:
    def run(lists: pa.Table, known: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return result.empty_table()
        lists, known = lists.combine_chunks(), known.combine_chunks()
        ids = lists.column("ids").chunk(0)
        tokens = pc.list_flatten(ids)
        at = pc.index_in(tokens, value_set=known.column("token").chunk(0) if known.num_rows else pa.array([], pa.int32()))
        if at.null_count:
            raise ValueError("an id has no piece")
        found = (known.column("piece").chunk(0) if known.num_rows else pa.array([], pa.binary())).take(at).cast(pa.large_binary())
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])]
        octets = memoryview(data or b"")
        texts = [bytes(octets[a:b]).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.table([lists.column("id"), pa.array(texts, pa.string())], schema=result)

    return run


def decoded(ids: DataFrame, key: str, column: str = "ids", path: str = TOKENIZER, block_octets: int = BLOCK_OCTETS) -> DataFrame:
    """``key, text``: the inverse of ``encoded``, by a join of ids with pieces.

    The ids of each block of texts, every one once, are joined with the table of pieces
    by id; the blocks then put their texts together by position.  Octets that are no
    UTF-8 become replacement characters; an empty or null list gives the empty text; an
    id without a piece fails.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    tokens = ids.agg(F.sum(F.size(F.coalesce(F.col(column), F.array())))).first()[0] or 0
    blocks = max(1, -(-4 * tokens // block_octets))
    lists = ids.select(
        F.pmod(F.xxhash64(F.col(key), F.col(column)), F.lit(blocks)).cast("int").alias("block"),
        F.col(key).alias("id"),
        F.coalesce(F.col(column), F.array().cast("array<int>")).alias("ids"),
    ).repartition(_partitions(ids, 4 * tokens, blocks), "block")
    pairs = lists.sortWithinPartitions("block").mapInArrow(_distinct_ids, "block int, token int").distinct()
    known = pairs.join(piece_table(ids.sparkSession, path), "token")
    kind = ids.schema[key].dataType
    result = pa.schema([pa.field("id", to_arrow_type(kind)), pa.field("text", pa.string())])
    return (
        lists.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(_put_together(result), f"id {kind.simpleString()}, text string")
        .withColumnRenamed("id", key)
    )
