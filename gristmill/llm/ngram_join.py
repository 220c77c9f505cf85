"""Similarity join of documents on word n-grams by vertical partitioning.

A document is the set of its distinct n-grams of words. Sets link when their Jaccard
similarity reaches a percentage; linked sets are one component. The length of the n-grams
and the percentage are arguments (a ``Rule``; triples and 90 per cent by default).

*Order and fragments.* N-grams are ordered by a 64-bit hash, and that order is cut into
fragments of equal width. Two similar sets differ in few n-grams (at most a nineteenth of
their sizes' sum at 90 per cent), so among ``differ + 1 + slack`` fragments at least
``1 + slack`` hold the same part of both. Each set is therefore listed under the hash of
its part in every fragment. The number of fragments goes by classes of the set size (its
powers of two; of their square root below 90 per cent, where more fragments would be
empty); sets are also listed in each next class that holds sets they may link to.

*Prefixes.* Below 90 per cent a set would have nearly as many fragments as n-grams. There
it is listed under the first n-grams of the order instead: of n n-grams, two linked sets
share at least ``m = ceil(n * percent / 100)``, so the first k that they share are among the
first ``n - m + k`` of either. k is a tenth of the set (``SPARE``) and one more. A set that shares fewer
than k of its listed n-grams with others links to none; the rest are suspects. So a
passage that many documents quote makes suspects only of those of which it is a large part.

*Candidates.* In fragments, of its listings a set may leave out the ``slack`` most frequent: two similar
sets still share their least frequent common one. That removes fragments which hold only
a passage that many documents quote. The sets that still share a listing are suspects;
among them the n-grams themselves are ordered by frequency, and a set is listed under its
rarest, as many as two linked sets need to meet (a prefix filter with places). All sets
under one n-gram are first compared to one leader, the most central; sets found to be linked are one
component, and only n-grams that still touch several components are looked at again, with
new leaders, until few pairs are left or a round finds no link. Then every pair of an
n-gram in different components is compared whose sizes and places allow a link. So a
group of thousands of near copies costs a few comparisons per member, and no link between
components is missed.

*Counting.* Each set has a small bitmap of its n-grams. An n-gram behind a bit that only one
of two sets has is not shared, so most pairs that do not link go by their bitmaps. For the
others the overlap is counted in each fragment on its own, by a join of the two parts, and
summed per pair; only sets of such pairs are sent.

Equal sets are one node from the start. Sets and their parts are told apart by 64-bit
hashes. Defined results: a text of fewer words than an n-gram is one n-gram; null, empty and
wordless texts have no n-gram, no link and are their own component; repeated rows are
copies like any others; rows with a null id belong to the component of their set, whose
id is the smallest that is not null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.components import components
from gristmill.llm.texts import ascii_lower, near, stored, words

WORDS = 3
PERCENT = 90
PARTS = 8  # fragments in which overlaps are counted
BITS = 1024  # of a set's bitmap; sets of many more n-grams fill it and are told by their parts
STAR_ROUNDS = 8
FRAGMENTED = 90  # per cent, from which suspects are found by fragments
SPARE = 10  # of so many n-grams of a set, one more is listed in its prefix
PRUNINGS = 2  # how often sets that share too few listed n-grams are left out
# Star rounds end where the pairs left are at most so many per listing.
ALL_PAIRS = 8
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Rule:
    """When two texts link: words of an n-gram, and the least Jaccard similarity."""

    words: int = WORDS
    percent: int = PERCENT

    def prefix(self, n: int) -> tuple[int, int]:
        """(listed, shared): how many of its n-grams a set of n is listed under, and how many
        of these it shares at least with any set it links to."""
        least = -(-n * self.percent // 100)
        return min(n, n - least + 1 + n // SPARE), min(least, 1 + least // SPARE)

    @property
    def per_doubling(self) -> int:
        """Size classes from a set size to its double."""
        return 1 if self.percent >= 90 else 2


def class_start(size_class: int, rule: Rule = Rule()) -> int:
    """The smallest set size of a class."""
    return math.ceil(2 ** (size_class / rule.per_doubling))


def size_classes(n: int, rule: Rule = Rule()) -> list[int]:
    """The classes of the sizes from n up to the largest that a set of n may link to."""
    own = rule.per_doubling * (n.bit_length() - 1)
    while class_start(own + 1, rule) <= n:
        own += 1
    listed = [own]
    while 100 * n >= rule.percent * class_start(listed[-1] + 1, rule):
        listed.append(listed[-1] + 1)
    return listed


def fragments(size_class: int, rule: Rule = Rule()) -> tuple[int, int]:
    """(fragments, slack) for the sets of a class (see ``class_start``).

    Sets of sizes a and b link when they differ in at most (a + b) * (100 - percent) /
    (100 + percent) n-grams.
    """
    largest = class_start(size_class + 1, rule) - 1
    differ = 2 * largest * (100 - rule.percent) // (100 + rule.percent)
    slack = differ // 4
    return differ + 1 + slack, slack


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX[3]
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _factors(count: int) -> list[np.uint64]:
    """Odd numbers that tell the places in an n-gram apart."""
    more = _mixed(np.arange(len(_MIX), max(count, len(_MIX)), dtype=np.uint64)) | np.uint64(1)
    return [*_MIX, *more][:count]


def ngram_set(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of ``size`` words, from the words' hashes."""
    n = len(hashes)
    if n < size:
        whole = sum((h * m for h, m in zip(hashes, _factors(n), strict=True)), np.uint64(n))
        return _mixed(np.array([whole], np.uint64)) if n else hashes
    return np.unique(_mixed(sum(hashes[i : n - size + 1 + i] * m for i, m in enumerate(_factors(size)))))


_BOUNDS: dict[int, np.ndarray] = {}


def _bounds(count: int) -> np.ndarray:
    """First hash of each fragment."""
    if count not in _BOUNDS:
        _BOUNDS[count] = np.array([-(-(i << 64) // count) for i in range(count)], np.uint64)
    return _BOUNDS[count]


def _keys(found: np.ndarray, sums: np.ndarray, size_class: int, rule: Rule) -> np.ndarray:
    """A hash of the set's part in each fragment of a class."""
    count, _ = fragments(size_class, rule)
    at = np.append(np.searchsorted(found, _bounds(count)), len(found))
    part = sums[at[1:]] - sums[at[:-1]]
    return _mixed(part + _mixed(np.arange(count, dtype=np.uint64) + np.uint64(size_class << 32)))


def _sets(batch: pa.RecordBatch, column: int, rule: Rule) -> Iterator[np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy().view(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(batch.num_rows):
            yield ngram_set(values[offsets[i] : offsets[i + 1]], rule.words)


def _identity(found: np.ndarray) -> int:
    """A hash of a whole set."""
    with np.errstate(over="ignore"):
        return int(_mixed(np.array([_mixed(found).sum(dtype=np.uint64) + np.uint64(len(found))]))[0].view(np.int64))


def _list_keys(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The size, identity and listings of each set, beside the row's id and text hash.

    classes: the size classes of the listings; of a prefix, how many must be shared.
    """

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, classes, keys = [], [], [], []
            with np.errstate(over="ignore"):
                for found in _sets(batch, 2, rule):
                    n = len(found)
                    sizes.append(n)
                    nodes.append(_identity(found) if n else 0)
                    if n and rule.percent < FRAGMENTED:
                        listed, shared = rule.prefix(n)
                        classes.append([shared])
                        keys.append([found[:listed].view(np.int64)])
                        continue
                    listed = size_classes(n, rule) if n else []
                    sums = np.append(np.uint64(0), np.cumsum(_mixed(found), dtype=np.uint64)) if n else None
                    classes.append(listed)
                    keys.append([_keys(found, sums, c, rule).view(np.int64) for c in listed])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(classes, pa.list_(pa.int32())),
                    pa.array(keys, pa.list_(pa.list_(pa.int64()))),
                ],
                names=["doc_id", "said", "n", "node", "classes", "keys"],
            )

    return list_all


def _bitmap(found: np.ndarray) -> np.ndarray:
    """One bit per n-gram, in words of 64 bits."""
    held = np.zeros(BITS, np.uint8)
    held[found & np.uint64(BITS - 1)] = 1
    return np.packbits(held).view(np.int64)


def _cut_sets(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The parts of each set in the counting fragments; the first one has the set's bitmap."""
    bounds = _bounds(PARTS)

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parts, values, bits = [], [], [], []
            for wanted, found in zip(batch.column(0).to_pylist(), _sets(batch, 1, rule), strict=True):
                if len(found) and _identity(found) == wanted:
                    at = np.append(np.searchsorted(found, bounds), len(found))
                    filled = np.flatnonzero(at[1:] > at[:-1]).tolist()
                    for part in filled:
                        nodes.append(wanted)
                        parts.append(part)
                        values.append(found[at[part] : at[part + 1]].view(np.int64))
                        bits.append(_bitmap(found) if part == filled[0] else None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.array(values, lists), pa.array(bits, lists)],
                names=["node", "part", "grams", "bits"],
            )

    return cut_all


def _hashes() -> Column:
    found = words(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.transform(found, lambda w: F.xxhash64(w)).alias("hashes")


def _said() -> Column:
    """A hash of a row's text, by which rows of one id are told apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _prefix_suspects(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that share enough n-grams of their prefixes with other sets.

    prints: node, classes (how many must be shared) and keys, repeated for each of the
    node's copies. Listings go to their n-grams once a turn; sets are left out before
    their listings are made.
    """
    by_key = Window.partitionBy("key")
    for turn in range(PRUNINGS):
        if turn:
            prints = near(prints, F.xxhash64("node"), found.select(F.xxhash64("node"))).where("_near").drop("_near")
            prints = prints.join(found, "node", "left_semi")
        listings = prints.select("node", F.get("classes", F.lit(0)).alias("class"), F.explode(F.get("keys", F.lit(0))).alias("key"))
        told = listings.select("node", "class", F.min("node").over(by_key).alias("lo"), F.max("node").over(by_key).alias("hi"))
        met = told.where("lo <> hi").groupBy("node", "class").agg(F.count(F.lit(1)).alias("k"))
        enough = met.join(nodes.select("node", "copies"), "node").where("k >= class * copies")
        found = stored(enough.select("node"), "suspects")
    return found


def _suspects(prints: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Nodes that may link: those with a listing that another set shares, beyond the most
    frequent ones that a set may leave out."""
    if rule.percent < FRAGMENTED:
        return _prefix_suspects(prints.select("node", "classes", "keys"), nodes)
    listings = prints.select("node", F.explode(F.arrays_zip("classes", "keys")).alias("l")).select(
        "node", F.col("l.classes").alias("class"), F.explode("l.keys").alias("key")
    )
    # Copies of one set count into its keys' frequency; any order of keys will do.
    shared = listings.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = shared.where("lo <> hi").select("key", "k")
    slacks = [fragments(c, rule)[1] for c in range(30 * rule.per_doubling)]
    slack = F.get(F.array(*map(F.lit, slacks)), F.col("class"))
    # A set has a bounded number of listings, by its size.
    by_set = listings.join(shared, "key").groupBy("node", "class").agg(F.collect_set(F.struct("k", "key")).alias("l"))
    kept = F.slice(F.sort_array("l", asc=False), slack + 1, F.greatest(F.size("l") - slack, F.lit(0)))
    listed = stored(by_set.select("node", F.explode(kept).alias("l")).select("l.key", "node"), "listings")
    several = listed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return listed.join(several.select("key"), "key", "left_semi").select("node").distinct()


def _least_overlap(sizes: Column, rule: Rule) -> Column:
    """What two linked sets share at least, given the sum of their sizes."""
    return F.ceil(F.lit(rule.percent) * sizes / F.lit(float(100 + rule.percent)))


def _listings(parts: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """key, node, n, at, indexed: the rarest n-grams of the suspects.

    N-grams are ordered by how many suspects hold them; ``at`` is the place in a set's
    own order, which n-grams that no other suspect holds come first in. The first n-gram
    that two linked sets share is among the first of either; the smaller set need only
    list (as ``indexed``) those from which a set no smaller can still be reached.
    """
    grams = parts.select("node", F.explode("grams").alias("key"))
    shared = grams.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    by_set = grams.join(shared.where("lo <> hi").select("key", "k"), "key").groupBy("node").agg(
        F.collect_set(F.struct("k", "key")).alias("l")
    )
    sized = by_set.join(nodes.select("node", "n"), "node").select("node", "n", F.sort_array("l").alias("l"))
    first = F.col("n") - F.ceil(F.lit(rule.percent) * F.col("n") / 100) + 1 - (F.col("n") - F.size("l"))
    short = F.slice("l", 1, F.greatest(first, F.lit(0)).cast("int"))
    placed = sized.select("node", "n", F.size("l").alias("held"), F.posexplode(short).alias("i", "l")).select(
        F.col("l.key").alias("key"), "node", "n", (F.col("n") - F.col("held") + F.col("i") + 1).alias("at")
    )
    marked = placed.withColumn("indexed", F.col("at") <= F.col("n") - _least_overlap(2 * F.col("n"), rule) + 1)
    listed = stored(marked, "listings")
    # Listings that can meet no indexed one say nothing: theirs are all too large.
    smallest = listed.where("indexed").groupBy("key").agg(F.min("n").alias("least"))
    able = (F.lit(100 + rule.percent) * (F.col("n") - F.col("at") + 1)) / float(rule.percent) - F.col("n")
    useful = listed.join(smallest, "key").where(F.col("indexed") | (F.col("least") <= able))
    return stored(useful.drop("least"), "listings")


def _possible(a: str, b: str, rule: Rule) -> Column:
    """Whether a listing of set ``a`` and one of set ``b`` may be the first n-gram of a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at")) + 1
    return (F.col(f"{a}.component") != F.col(f"{b}.component")) & (most >= _least_overlap(na + nb, rule))


def _ordered(a: str, b: str) -> list[Column]:
    """Both sets and their sizes, the smaller node first."""
    first = F.col(f"{a}.node") < F.col(f"{b}.node")
    return [
        F.least(f"{a}.node", f"{b}.node").alias("a"),
        F.greatest(f"{a}.node", f"{b}.node").alias("b"),
        F.when(first, F.col(f"{a}.n")).otherwise(F.col(f"{b}.n")).alias("na"),
        F.when(first, F.col(f"{b}.n")).otherwise(F.col(f"{a}.n")).alias("nb"),
    ]


def _bitmaps(parts: DataFrame) -> DataFrame:
    """node, bits of each set; those of repeated rows are alike."""
    return parts.where("bits is not null").groupBy("node").agg(F.first("bits").alias("bits"))


def _likely(pairs: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, na, nb) that may link by their sets' bitmaps."""

    def alone(x: str, y: str) -> Column:
        """At least so many n-grams of x are not in y."""
        return sum(F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(BITS // 64))

    left = bits.select(F.col("node").alias("a"), F.col("bits").alias("x"))
    right = bits.select(F.col("node").alias("b"), F.col("bits").alias("y"))
    shared = F.least(F.col("na") - alone("x", "y"), F.col("nb") - alone("y", "x"))
    least = _least_overlap(F.col("na") + F.col("nb"), rule)
    return pairs.join(left, "a").join(right, "b").where(shared >= least).select("a", "b", "na", "nb")


def _linked(pairs: DataFrame, parts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold. pairs is read twice.

    One row per pair and fragment; parts repeat where a row repeats, so the maximum of a
    fragment's counts is summed.
    """
    sets = pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))))
    few = near(parts, F.xxhash64("node"), sets).where("_near")
    left = few.select(F.col("node").alias("a"), "part", F.col("grams").alias("ga"))
    right = few.select(F.col("node").alias("b"), "part", F.col("grams").alias("gb"))
    met = pairs.join(left, "a").join(right, ["b", "part"])
    partial = met.select("a", "b", "na", "nb", "part", F.size(F.array_intersect("ga", "gb")).alias("c"))
    each = partial.groupBy("a", "b", "na", "nb", "part").agg(F.max("c").alias("c"))
    total = each.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    union = F.col("na") + F.col("nb") - F.col("c")
    return total.where(F.lit(100) * F.col("c") >= F.lit(rule.percent) * union).select("a", "b")


def _link_all(listed: DataFrame, parts: DataFrame, rule: Rule) -> DataFrame:
    """node, component over all links among the listed sets."""
    joined, found = listed.sparkSession.createDataFrame([], "node bigint, component bigint"), True
    placed, bits = listed.withColumn("component", F.col("node")), stored(_bitmaps(parts), "bitmaps")
    for turn in range(STAR_ROUNDS + 1):
        # The set with the fewest rarer n-grams is the most central one of an n-gram; later
        # rounds ask that of one component of the n-gram each.
        turned = (F.xxhash64(F.lit(turn), "component") if turn else F.lit(0).cast("long")).alias("order")
        leader = F.min(F.when(F.col("indexed"), F.struct(turned, "at", "node", "n", "component")))
        parted = placed.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("m"), F.count_if("indexed").alias("i"), leader.alias("leader")
        )
        keys = parted.groupBy("key").agg(
            F.count(F.lit(1)).alias("components"),
            F.sum("m").alias("members"),
            (F.sum("m") * F.sum("i") - F.sum(F.col("m") * F.col("i"))).alias("pairs"),
            F.min("leader").alias("leader"),
        )
        keys = stored(keys.where("components > 1 and leader is not null"), "keys")
        work = keys.agg(F.sum("pairs"), F.sum("members")).first()
        if not work[0]:
            return joined
        last = not found or turn == STAR_ROUNDS or work[0] <= ALL_PAIRS * work[1]
        if last:
            # Few pairs of different components remain, or stars find no more links.
            open_keys = stored(placed.join(keys.select("key"), "key", "left_semi"), "open")
            small, large = open_keys.where("indexed").alias("x"), open_keys.alias("y")
            met = small.join(large, (F.col("x.key") == F.col("y.key")) & (F.col("x.n") <= F.col("y.n")) & _possible("x", "y", rule))
            pairs = met.select(*_ordered("x", "y"))
        else:
            led = placed.alias("x").join(keys.select("key", F.col("leader").alias("y")), "key").where(_possible("x", "y", rule))
            pairs = led.select(*_ordered("x", "y"))
        likely = stored(_likely(pairs.distinct(), bits, rule), "pairs")
        found = not likely.isEmpty()
        if found:
            links = stored(_linked(likely, parts, rule), "links")
            found = not links.isEmpty()
        if found:
            known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = stored(components(known.unionAll(links)), "components")
        if last:
            break
        # N-grams of one component stay so; only the others are looked at again, with the
        # components of their sets.
        again = placed.join(keys.select("key"), "key", "left_semi").drop("component").join(joined, "node", "left")
        placed = stored(again.withColumn("component", F.coalesce("component", "node")), "listings")
    return joined


def _told(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, said (a hash of the text), n_shingles, component_id and keeper of each row.

    keeper: (no id, doc_id, said) of the component's first row; null without n-grams.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _said().alias("said"), _hashes())
    schema = "doc_id bigint, said bigint, n bigint, node bigint, classes array<int>, keys array<array<bigint>>"
    prints = stored(rows.mapInArrow(_list_keys(rule), schema), "prints")
    filled = prints.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "said")).alias("keeper")
    nodes = stored(filled.groupBy("node").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "nodes")
    suspects = _suspects(filled, nodes, rule).join(nodes, "node").select("node", "keeper.doc_id")
    parts = stored(_parts(docs, stored(suspects, "suspects"), rule), "parts")
    joined = _link_all(_listings(parts, nodes, rule), parts, rule)
    placed = nodes.join(joined, "node", "left").select("node", "keeper", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "placed")
    least = placed.groupBy("component").agg(F.min("keeper").alias("keeper"))
    labels = stored(placed.select("node", "component").join(least, "component").select("node", "keeper"), "labels")
    told = prints.select("doc_id", "said", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    found = told.join(labels, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    return found.select("doc_id", "said", "n_shingles", own.alias("component_id"), "keeper")


def similar_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each row."""
    return _told(docs, rule).select("doc_id", "n_shingles", "component_id")


def _parts(docs: DataFrame, suspects: DataFrame, rule: Rule) -> DataFrame:
    """node, part, grams, bits of one document of each suspect set."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = near(few, F.xxhash64("doc_id"), suspects.select(F.xxhash64("doc_id"))).where("_near").drop("_near")
    # Null ids name no row: they are compared as a value.
    same = few["doc_id"].eqNullSafe(suspects["doc_id"])
    rows = few.join(suspects, same).select("node", _hashes())
    return rows.mapInArrow(_cut_sets(rule), "node bigint, part int, grams array<bigint>, bits array<bigint>")


def one_of_each(docs: DataFrame, rule: Rule = Rule(), repeats: bool = True) -> DataFrame:
    """The first row of each component by id (null last), columns unchanged.

    Rows are told apart by id and text. repeats: whether rows that repeat the id and the
    text of the first one stay too. Rows without n-grams all stay.
    """
    told = stored(_told(docs, rule).where("keeper is not null"), "told")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "said") == F.col("keeper")
    named = [F.col("doc_id").alias("_id"), F.col("said").alias("_said")]
    # Structs compare nulls inside as equal.
    gone = stored(told.where(~first).select(*named).distinct(), "gone")

    def at(keys: DataFrame, kind: str, rows: DataFrame) -> DataFrame:
        same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_said"))
        return rows.join(keys, same, kind)

    rows = docs.select(F.struct("*").alias("_row"), _said().alias("_text"))
    apart = near(rows, F.xxhash64(F.col("_row.doc_id").cast("long"), "_text"), gone.select(F.xxhash64("_id", "_said")))
    rows = at(gone, "left_anti", apart.where("_near").drop("_near")).unionByName(apart.where("not _near").drop("_near"))
    if not repeats:
        again = told.where(first).groupBy("doc_id", "said").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = stored(again.select(*named), "again")
        if not again.isEmpty():
            once = at(again, "left_semi", rows).withColumn("_id", F.col("_row.doc_id")).groupBy("_id", "_text")
            rows = at(again, "left_anti", rows).select("_row").unionAll(once.agg(F.first("_row").alias("_row")).select("_row"))
    return rows.select("_row.*")
