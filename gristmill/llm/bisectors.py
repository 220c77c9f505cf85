"""Clusters of integer vectors around centroids, found by a tournament of bisectors.

For each pair of centroids i < j a vector v is nearer to j exactly where
``2 (c_j - c_i) . v > |c_j|^2 - |c_i|^2``. These normals and thresholds are computed once a
round. A vector's centroid is then found by k - 1 linear tests: the winner so far meets the
next centroid, a positive side lets the newcomer win, and zero leaves the smaller number.
The distance is computed to the last winner only. All arithmetic is exact: in 64-bit
integers where components are small enough, else in integers of any length.

A round reads the vectors once; a task adds up its vectors by cluster and returns a row
per cluster, component and limb of 40 bits, so at most ``k * (dims + 1)`` small sums reach
the driver, where a centroid becomes the floor of sum by count. Centroids (k vectors) are
the only thing sent to the tasks.

Defined results: vectors of another length, or with a component that is null or not
finite, are left out; fewer vectors than centroids make as many centroids as vectors, none
an empty result; equal vectors may both be centroids, of which the larger number stays empty
and keeps its place; a null id counts as an id after all others; distances and sums that a
long cannot hold are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.texts import stored

CENTROIDS = 16
DIMS = 64
ROUNDS = 3
SCALE = 64
SEED = 1
BLOCK = 4096  # vectors compared at a time
LIMB = 40  # bits of a partial sum's row
SMALL = 1 << 26  # components below it need no more than 64 bits in any step
LONG = (1 << 63) - 1


def as_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component; Python integers where any is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    # A float beyond 2 ** 53 is an integer, and its product may not fit a float.
    exact = [math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _narrow(rows: list[list[int]]) -> np.ndarray:
    if all(abs(x) < SMALL for row in rows for x in row):
        return np.array(rows, dtype=np.int64)
    return np.array(rows, dtype=object)


class Tournament:
    """The nearest of a list of centroids, by bisectors."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.centroids = c = _narrow(centroids)
        squares = (c * c).sum(axis=1)
        self.normals = 2 * (c[None, :] - c[:, None])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each vector."""
        if self.centroids.dtype == object:
            vectors = vectors.astype(object)
        winner = np.zeros(len(vectors), dtype=np.int64)
        for j in range(1, len(self.centroids)):
            side = (vectors * self.normals[winner, j]).sum(axis=1) - self.thresholds[winner, j]
            winner[(side > 0).astype(bool)] = j
        apart = vectors - self.centroids[winner]
        return winner, (apart * apart).sum(axis=1)


def _vectors(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the rows that hold a whole vector, in blocks."""
    for batch in batches:
        whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
        batch = batch.filter(whole)
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            # A null component becomes NaN.
            values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            finite = np.isfinite(values).all(axis=1)
            yield part.column(0).filter(pa.array(finite)), as_integers(values[finite], scale)


def _limbs(total: int) -> list[int]:
    """Parts of LIMB bits with the sign of the number, the least first."""
    sign, rest, found = (-1 if total < 0 else 1), abs(total), []
    while rest:
        found.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return found


def _sums(vectors: DataFrame, tournament: Tournament, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each cluster that is not empty."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tournament.centroids)
        sums = np.zeros((k, dims + 1), dtype=object)
        for _, found in _vectors(batches, dims, scale):
            winner, _ = tournament.nearest(found)
            for c in np.unique(winner):
                own = found[winner == c]
                sums[c, :dims] += own.sum(axis=0).astype(object)
                sums[c, dims] += len(own)
        rows = [(c, d, i, part) for c in range(k) for d in range(dims + 1) for i, part in enumerate(_limbs(int(sums[c, d])))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["c", "d", "i", "part"])

    parts = vectors.mapInArrow(add_up, "c int, d int, i int, part long")
    added: dict[int, list[int]] = {}
    # At most one row per cluster, component and limb.
    for row in parts.groupBy("c", "d", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        added.setdefault(row.c, [0] * (dims + 1))[row.d] += int(row.part) << (LIMB * row.i)
    return {c: (sums[dims], sums[:dims]) for c, sums in added.items()}


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The k whole vectors whose ``seed:id`` has the smallest sha256; equal ones by vector."""

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    whole = vectors.where((F.size("vector") == dims) & F.forall("vector", finite))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = whole.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    return as_integers(np.array([r.vector for r in rows], dtype=np.float64).reshape(-1, dims), scale).tolist()


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster and distance of every whole vector, and the centroids.

    vectors: id and vector (a list of numbers).
    """
    read = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    centroids = first_centroids(read, k, dims, scale, seed)
    schema = "id long, cluster int, distance long"
    if not centroids:
        return read.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        for c, (count, sums) in _sums(read, Tournament(centroids), dims, scale).items():
            centroids[c] = [total // count for total in sums]
    tournament = Tournament(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _vectors(batches, dims, scale):
            winner, distance = tournament.nearest(found)
            if distance.dtype == object:
                distance = [d if d <= LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(winner, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"]
            )

    return read.mapInArrow(assign, schema), centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances and the centroid's digest."""
    named = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found, centroids = cluster_vectors(named)
    found = stored(found, "clusters")
    sums = {c: 0 for c in range(len(centroids))}
    # A row for each centroid.
    added = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("wide")
    )
    for row in added.collect():
        sums[row.cluster] = None if row.wide else int(row.total)
    whole = None if None in sums.values() else sum(sums.values())

    def long(value: int | None):
        return F.lit(value if value is not None and value <= LONG else None).cast("long")

    def of_cluster(values: list, kind: str):
        return F.get(F.array(*values).cast(f"array<{kind}>"), F.col("cluster"))

    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of_cluster([long(sums[c]) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        long(whole).alias("inertia"),
        of_cluster([F.lit(centroid_digest(c)) for c in centroids], "string").alias("centroid_sha256"),
    )
