"""Cross-entropy difference of a target and a background bigram model.

Both models share one vocabulary: all distinct words of the corpus (A-Z lower-cased). The target
model counts the documents marked as target, the background model counts all documents;
counts cover every word of every text and are exact: words and bigrams are told apart by
63 bits of a hash, and nothing shares a place. The larger corpus is scaled to the tokens of
the smaller, so both models are smoothed alike: p(w|u) = (c(u,w) + MU * p(w)) / (c(u) + MU),
p(w) = (c(w) + ALPHA) / (N + ALPHA * V).

A document's score is the mean over its words of the target model's loss less the
background model's (lower: more like the target). Its own words are taken out of both
models first, or else its membership in the target corpus would outweigh what it says.

Documents are put into blocks of about ``BLOCK`` words, one row each. A block sends the
counts of its distinct words and bigrams, its entries, to the parts of the range of hashes;
a part adds up what all blocks say and answers each with the totals of its own entries, in
the order in which they came, so answers need no keys. An entry reaches its part once a block,
however frequent it is, and the number of parts follows the corpus: no task holds more than
some ``PART`` entries or one block, and nothing of the models passes through the driver but
five sums.

Defined results: null and wordless texts have n_tokens 0 and null losses; without target
documents the target model is uniform; marks that are null or match no document count for
nothing; repeated rows are counted and scored as often as they occur. A text of more than
``BLOCK`` words is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.texts import ascii_lower, portions, stored, words

BLOCK = 1 << 19  # words
PART = 1 << 21  # entries of blocks
BITS = 1 << 25  # buckets of target ids
ALPHA = 0.1
MU = 4.0

BLOCKS = (
    "block bigint, n_words bigint, n_texts bigint, target_words bigint, target_texts bigint,"
    " doc_ids array<bigint>, targets array<int>, sizes array<int>, words array<bigint>, entries array<int>"
)
# Counts are a byte each; from ``LARGE`` on the byte is ``LARGE`` and the count follows in a list.
LARGE = 255
COUNTS = "target binary, target_large array<bigint>, everything binary, everything_large array<bigint>"
PARTIAL = f"part bigint, block bigint, keys array<bigint>, {COUNTS}"
ANSWERS = f"part bigint, block bigint, {COUNTS}, n_words bigint"
# Words of a block ascend, so Parquet's second version writes them as differences.
COMPACT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
SCORES = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def _hashes() -> Column:
    """The hashes of a text's words, in order."""
    found = words(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.transform(found, lambda w: F.xxhash64(w)).alias("hashes")


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """A list per pair of neighbours in ``ends``."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _packed(ends: np.ndarray, target: np.ndarray, everything: np.ndarray) -> list[pa.Array]:
    """Arrays for ``COUNTS``, with a row per pair of neighbours in ``ends``."""
    arrays = []
    for counts in (target, everything):
        small = np.minimum(counts, LARGE).astype(np.uint8)
        large = small == LARGE
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(small)]
        arrays.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers))
        before = np.append(0, np.cumsum(large))
        arrays.append(_lists(before[ends], counts[large].astype(np.int64)))
    return arrays


def unpacked(rows: pa.Table, name: str) -> np.ndarray:
    """All counts of some rows, ``target`` or ``everything``, in order."""
    small, large = (rows.column(c).combine_chunks() for c in (name, f"{name}_large"))
    ends = np.frombuffer(small.buffers()[1], np.int32)[small.offset : small.offset + len(small) + 1]
    counts = np.frombuffer(small.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    counts[counts == LARGE] = large.flatten().to_numpy()
    return counts


def marked_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``target``: 1 where ``marked`` has the doc_id, else null.

    Bitmaps of ``BITS`` buckets of ids, some kilobytes a row and 4 MB in all, tell most rows that are not
    marked, so their texts need not be shuffled to the ids.
    """
    target = marked.where("doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(1))
    bucket = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(BITS - 1)) + 1
    at = F.bitmap_bit_position(bucket)
    maps = target.groupBy(F.bitmap_bucket_number(bucket).alias("_map")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0).cast("byte"))
    mapped = docs.withColumn("_map", F.bitmap_bucket_number(bucket)).join(F.broadcast(stored(maps, "marks")), "_map", "left")
    near = mapped.where(found == 1).select("doc_id", "text").join(target.hint("merge"), "doc_id", "left")
    far = mapped.where(found == 0).select("doc_id", "text", F.lit(None).cast("int").alias("target"))
    return near.unionByName(far)


def word_blocks(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """All rows of ``docs`` in blocks; a block's words are numbered in the order of their hashes.

    marked: doc_id of the target documents.
    """

    names = [column.split()[0] for column in BLOCKS.split(", ")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, rows in enumerate(portions(batches, 2, BLOCK)):
            column = rows.column(2)
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int32)
            distinct, entries = np.unique(column.flatten().to_numpy() | 1, return_inverse=True)
            targets = rows.column(1).fill_null(0)
            inside = targets.to_numpy() == 1
            counts = [sizes.sum(), (sizes > 0).sum(), sizes[inside].sum(), (sizes[inside] > 0).sum()]
            lists = [targets.to_numpy(), sizes, distinct, entries.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + n]), *[pa.array([int(c)], pa.int64()) for c in counts]]
                + [pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64()))]
                + [_lists(np.array([0, len(v)]), v) for v in lists],
                names=names,
            )

    told = marked_rows(docs.select("doc_id", "text"), marked)
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), "target", _hashes()).mapInArrow(gather, BLOCKS)


class Block:
    """The words of some texts, with their contexts and the block's entries by key."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, entries: np.ndarray) -> None:
        self.filled = np.flatnonzero(sizes)
        self.lengths = sizes[self.filled].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.texts = np.repeat(np.arange(len(self.filled)), self.lengths)
        before = np.empty(len(entries), np.int64)
        before[1:] = entries[:-1]
        before[self.starts] = len(words)  # the start of a text
        codes, pairs = np.unique(before * (len(words) + 1) + entries, return_inverse=True)
        unsorted = np.concatenate([words.view(np.uint64), bigram_keys(words, codes)])
        order = np.argsort(unsorted, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = unsorted[order]
        self.words = place[entries]
        self.pairs = place[len(words) + pairs]

    def counts(self, inside: np.ndarray) -> np.ndarray:
        """How often each entry occurs in the texts that ``inside`` tells."""
        keep = inside[self.texts]
        found = np.bincount(self.words[keep], minlength=len(self.keys))
        return found + np.bincount(self.pairs[keep], minlength=len(self.keys))

    def own(self, places: np.ndarray) -> np.ndarray:
        """How often the entry of each word occurs in the word's own text."""
        _, inverse, counts = np.unique(
            self.texts * np.int64(len(self.keys)) + places, return_inverse=True, return_counts=True
        )
        return counts[inverse]

    def losses(self, model: Model, counts: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """-log p of each word given the one before, in a model of the other texts.

        counts: of the block's entries in the model; counted: 1 for each text that they include.
        """
        inside, scale = counted[self.texts], model.scale
        single = (counts[self.words] - self.own(self.words) * inside) * scale
        pair = (counts[self.pairs] - self.own(self.pairs) * inside) * scale
        context = np.empty_like(single)
        context[1:] = single[:-1]
        context[self.starts] = (model.texts - counted) * scale
        total = (model.words - self.lengths * counted)[self.texts] * scale
        alone = (single + ALPHA) / (total + ALPHA * model.vocabulary)
        return -np.log((pair + MU * alone) / (context + MU))


def bigram_keys(words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Keys of bigrams, even; those of words are odd. code: place of the context times (number of
    words + 1), plus place of the word."""
    hashes = np.append(words.view(np.uint64), np.uint64(0))
    mixed = hashes[codes // (len(words) + 1)] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed + hashes[codes % (len(words) + 1)]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))) & ~np.uint64(1)


def _block(rows: pa.RecordBatch | pa.Table, at: int = 0) -> tuple[Block, np.ndarray]:
    """A row of ``word_blocks`` as a Block, and which of its filled texts are targets."""
    sizes, words, entries, targets = (
        rows.column(name)[at].values.to_numpy() for name in ("sizes", "words", "entries", "targets")
    )
    block = Block(sizes, words, entries)
    return block, targets[block.filled]


def block_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """The counts of each block's entries, one row per part that it has entries of."""

    names = [column.split()[0] for column in COUNTS.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, targets = _block(batch, at)
                if not len(block.keys):
                    continue
                parts = ((block.keys >> np.uint64(32)) >> np.uint64(32 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.diff(parts, prepend=-1))
                ends = np.append(starts, len(parts))
                counts = block.counts(targets == 1), block.counts(np.ones(len(targets), bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts[starts]), pa.array(np.full(len(starts), batch.column(0)[at].as_py()))]
                    + [_lists(ends, block.keys.view(np.int64)), *_packed(ends, *counts)],
                    names=["part", "block", "keys", *names],
                )

    return blocks.select("block", "targets", "sizes", "words", "entries").mapInArrow(count, PARTIAL)


def total_counts(partial: DataFrame) -> DataFrame:
    """For each row of ``block_counts`` the totals of its entries, in its order.

    n_words: distinct words of the part, on one of its rows, else 0.
    """

    names = [column.split()[0] for column in ANSWERS.split(", ")]

    def add(rows: pa.Table) -> pa.Table:
        keys = rows.column("keys").combine_chunks()
        ends = keys.offsets.to_numpy() - keys.offsets[0].as_py()
        distinct, inverse = np.unique(keys.flatten().to_numpy(), return_inverse=True)
        # Sums of doubles are exact up to 2^53.
        totals = (np.bincount(inverse, unpacked(rows, c)).astype(np.int64)[inverse] for c in ("target", "everything"))
        n_words = np.zeros(rows.num_rows, np.int64)
        n_words[0] = (distinct & 1).sum()
        counts = _packed(ends, *totals)
        return pa.table([rows.column("part"), rows.column("block"), *counts, pa.array(n_words)], names=names)

    return partial.groupBy("part").applyInArrow(add, ANSWERS)


@dataclass
class Model:
    """What a model has besides its counts; scale brings it to the tokens of the smaller one."""

    words: int
    texts: int
    vocabulary: int
    scale: float


def models(sums, vocabulary: int) -> tuple[Model, Model]:
    tokens = [sums.target_words, sums.n_words]
    least = min([n for n in tokens if n], default=0)
    texts = [sums.target_texts, sums.n_texts]
    target, everything = (Model(n, t, max(vocabulary, 1), least / max(n, 1)) for n, t in zip(tokens, texts))
    return target, everything


def score(blocks: DataFrame, answers: DataFrame, both: tuple[Model, Model]) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of each row."""

    def score_block(rows: pa.Table, answered: pa.Table) -> pa.Table:
        n = rows.column("sizes")[0].values.to_numpy().astype(np.int64)
        means = np.full((2, len(n)), np.nan)
        block, targets = _block(rows)
        if len(block.keys):
            answered = answered.sort_by("part")
            for row, (name, counted) in enumerate((("target", targets), ("everything", np.ones_like(targets)))):
                each = block.losses(both[row], unpacked(answered, name), counted)
                means[row, block.filled] = np.add.reduceat(each, block.starts) / block.lengths
        empty = n == 0
        found = [means[0], means[1], means[0] - means[1]]
        return pa.table(
            [rows.column("doc_ids")[0].values, pa.array(n), *[pa.array(a, mask=empty) for a in found]],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    told = blocks.select("block", "doc_ids", "targets", "sizes", "words", "entries").groupBy("block")
    return told.cogroup(answers.drop("n_words").groupBy("block")).applyInArrow(score_block, SCORES)


def cross_entropy_difference(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Score every row of ``docs`` for its likeness to the documents in ``marked``."""
    blocks = stored(word_blocks(docs, marked), "blocks", **COMPACT)
    columns = ("n_words", "n_texts", "target_words", "target_texts")
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).first()
    # A word has an entry and a bigram at most.
    bits = min(max(2 * sums.n_words // PART, 0).bit_length(), 32)
    answers = stored(total_counts(block_counts(blocks, bits)), "counts", **COMPACT)
    vocabulary = answers.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    return score(blocks, answers, models(sums, vocabulary))
