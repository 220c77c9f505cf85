"""Token ids of documents, packed into fixed-width rows.

Each task reads its documents once, turns them into token ids with a byte-level BPE
vocabulary, and packs windows of about ``window_tokens`` tokens: pieces in decreasing
order, each into the row that it fits best, found in a segment tree over the rows' free
places. Documents longer than a row are cut into full rows and a rest, without loss.
Nothing is shuffled, and a task holds one window (or one longer document) at a time.

A packed row has the id matrix line, cumulative segment lengths and positions that start
again at each segment, as little-endian binary, with the ids and offsets of its documents.

A run of white space of over 65 536 characters is encoded in parts of that length, since the
pattern engine cannot take a run of any length at once; the ids of all other texts are those
of the vocabulary's own encoding, and the text always comes back whole.

Defined results: null and empty texts have no tokens and are in no row; an empty table
gives no rows; repeated rows are packed as often as they occur; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern this vocabulary's merges were made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space that is encoded at once, in characters.
SPACE_AT_ONCE = 1 << 16
_SPACES = re.compile(rf"\s{{{SPACE_AT_ONCE}}}")
SCHEMA = (
    "shard int, row int, used int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<bigint>, doc_starts array<int>"
)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def dtype_for(values: int) -> str:
    return "<u2" if values <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def _encoding(ranks: tuple):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


class Encoder:
    """Text to ids of the smallest type that holds them and the padding."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._encode = _encoding(tuple(ranks.items())).encode_ordinary
        self._dtype = dtype_for(max(ranks.values(), default=0) + 2)

    def ids(self, text: str | None) -> np.ndarray:
        text, found, at = text or "", [], 0
        if len(text) > SPACE_AT_ONCE:
            for run in _SPACES.finditer(text):
                found += self._encode(text[at : run.end()])
                at = run.end()
        found += self._encode(text[at:] if at else text)
        return np.array(found, dtype=self._dtype)


class FreePlaces:
    """Rows by free places, in a segment tree that tells where any row is."""

    def __init__(self, width: int) -> None:
        self._leaves = 1 << width.bit_length()
        self._some = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, free: int, by: int) -> None:
        node = free + self._leaves
        while node:
            self._some[node] += by
            node >>= 1

    def put(self, row: int, free: int) -> None:
        self._rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the fewest free places that suffice, and their number."""
        node, some = need + self._leaves, self._some
        while not some[node]:
            # Up to the first ancestor with a later sibling that holds a row.
            while node & 1 or not some[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self._leaves:
                node = 2 * node if some[2 * node] else 2 * node + 1
        free = node - self._leaves
        self._add(free, -1)
        return self._rows[free].pop(), free


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers, by best fit in decreasing order of length."""
    rows: list[list[int]] = []
    free = FreePlaces(width)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[piece])
        if found is None:
            rows.append([])
            found = len(rows) - 1, width
        row, places = found
        rows[row].append(piece)
        if places > lengths[piece]:
            free.put(row, places - lengths[piece])
    return rows


def _window(pieces: list, width: int, pad: int, shard: int, first: int, dtype: str) -> pa.RecordBatch:
    """Packed rows of (doc_id, start, ids) pieces."""
    lengths = [len(ids) for _, _, ids in pieces]
    rows = best_fit(lengths, width)
    place = dtype_for(width)
    count = np.arange(width, dtype=place)
    out: dict[str, list] = {name: [] for name in ("ids", "cu", "positions", "docs", "starts", "used")}
    for row in rows:
        line = np.full(width, pad, dtype)
        positions = np.zeros(width, place)
        cu = [0]
        for i in row:
            at, n = cu[-1], lengths[i]
            line[at : at + n] = pieces[i][2]
            positions[at : at + n] = count[:n]
            cu.append(at + n)
        out["ids"].append(line.tobytes())
        out["positions"].append(positions.tobytes())
        out["cu"].append(cu)
        out["used"].append(cu[-1])
        out["docs"].append([pieces[i][0] for i in row])
        out["starts"].append([pieces[i][1] for i in row])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * len(rows), pa.int32()),
            pa.array(range(first, first + len(rows)), pa.int32()),
            pa.array(out["used"], pa.int32()),
            pa.array(out["ids"], pa.binary()),
            pa.array(out["cu"], pa.list_(pa.int32())),
            pa.array(out["positions"], pa.binary()),
            pa.array(out["docs"], pa.list_(pa.int64())),
            pa.array(out["starts"], pa.list_(pa.int32())),
        ],
        names=["shard", "row", "used", "ids", "cu_seqlens", "positions", "doc_ids", "doc_starts"],
    )


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, width: int = 2048, window_tokens: int = 1 << 21
) -> DataFrame:
    """Rows of ``width`` ids of the texts in ``docs`` (doc_id, text).

    shard and row name a row; used is the number of ids before the padding (the id after
    the last of the vocabulary); ids and positions are binary, two bytes an entry where
    that suffices; segment i is cu_seqlens[i] up to cu_seqlens[i + 1] of the row and the
    tokens from doc_starts[i] of doc_ids[i]. The vocabulary is read by the driver and
    sent to the tasks; it is as large as its file.
    """
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    pad = max(ranks.values(), default=-1) + 1
    dtype = dtype_for(pad + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        shard, row, pieces, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py())
                pieces += [(doc_id, at, ids[at : at + width]) for at in range(0, len(ids), width)]
                held += len(ids)
                if held >= window_tokens:
                    packed = _window(pieces, width, pad, shard, row, dtype)
                    row, pieces, held = row + packed.num_rows, [], 0
                    yield packed
        if pieces:
            yield _window(pieces, width, pad, shard, row, dtype)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(pack, SCHEMA)
