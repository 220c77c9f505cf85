"""Mix sources to target weights with an exact, repeatable draw of blocks.

1. *Targets.* Sources in code-point order (null last) take weights from a repeating
   list. They share all words by weight; a target stops at ``max_repeat`` times its
   source's words and the excess is shared again, until none is above.
2. *Quotas.* A document is cut into blocks of ``block_words`` words (None: the whole
   document is one block). A source's blocks are permuted by hash. Its target is met by
   whole rounds over the permutation and then a leading run of it; with cut blocks the
   last one is shortened, so the source takes exactly its rounded target, with whole
   documents the run ends where it comes nearest. The number of draws is the quota.
3. *Splitting tree.* The output shards form a binary tree. At each node the quotas are
   split between the two halves by a multivariate hypergeometric draw, one source after
   another, each conditional on the rest: the mix of every shard is that of drawing
   without replacement, yet only counts are touched. Draws are inverse distribution
   functions of a hash of (seed, node, source), so reruns agree.
4. *Blocks.* Each shard takes the next run of the permuted blocks of each source
   (disjoint by construction) and orders its draws by hash.

A hot source is no hot key: places in its permutation come from counts per hash range
(a bounded table) and an order within each range. A tree node is one row with an entry
for each source; sources are taken to be a dimension, not a fact table.

Defined results: null and empty texts have size 0 and are never taken; an empty table
gives an empty result; repeated rows are told apart by a copy number and drawn on their
own; null sources are one source; null doc_id is a value like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.texts import SPACES, nullable, stored

WEIGHTS = (5, 2, 1)
RANGES = 4096
ROW = ["doc_id", "rank", "size", "copy"]


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{SPACES}]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """key, rank, source_size and target of each source. sizes: key, source, size.

    Sources fill up in the order of limit / weight, so those at their limit are a prefix
    of that order and the others share what is left by weight.
    """
    by_source = sizes.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = by_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights))
    limited = ranked.select(
        "key", "rank", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeat).alias("limit")
    )
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = limited.select("*", ((total - before) / rest).alias("level"))
    full = F.col("limit") <= F.col("level") * F.col("weight")
    first = F.struct(F.col("limit") / F.col("weight"), "rank", "level")
    common = F.min(F.when(~full, first)).over(Window.partitionBy())["level"]
    share = F.when(full, F.col("limit").cast("double")).otherwise(common * F.col("weight"))
    return level.select("key", F.col("rank").cast("int").alias("rank"), "source_size", share.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` draws without replacement are good: the inverse distribution
    function at ``uniform``.

    Probabilities are relative to that of the mode and reach twelve deviations from it,
    beyond which a double holds nothing of the mass.
    """
    n, k, m = (c.cast("double") for c in (population, good, drawn))
    reach = F.ceil(12 * F.sqrt(m * k / n * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0)))) + 12
    given = F.struct(
        n.alias("n"),
        k.alias("k"),
        m.alias("m"),
        F.greatest(F.lit(0.0), m - (n - k)).alias("low"),
        F.least(k, m).alias("high"),
        F.floor((m + 1) * (k + 1) / (n + 2)).cast("double").alias("mode"),
        reach.cast("double").alias("reach"),
    )

    def up(g, x):
        return (g["k"] - x) * (g["m"] - x) / ((x + 1) * (g["n"] - g["k"] - g["m"] + x + 1))

    def down(g, x):
        return x * (g["n"] - g["k"] - g["m"] + x) / ((g["k"] - x + 1) * (g["m"] - x + 1))

    def walk(g, to, ratio, stop=None):
        """Mass from the mode to ``to``; or the first place where it exceeds ``stop``."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"))

        def step(a, place):
            x = place.cast("double")
            reached = a["sum"] + a["w"]
            at = a["at"] if stop is None else F.when((a["at"] < 0) & (reached > stop), x).otherwise(a["at"])
            return F.struct((a["w"] * ratio(g, x)).alias("w"), reached.alias("sum"), at.alias("at"))

        return F.aggregate(F.sequence(g["mode"].cast("long"), to.cast("long")), start, step)

    def draw(g):
        top, bottom = F.least(g["high"], g["mode"] + g["reach"]), F.greatest(g["low"], g["mode"] - g["reach"])

        def choose(mass):
            wanted = uniform * (mass["up"] + mass["down"] - 1)
            above = walk(g, top, up, wanted)["at"]
            below = walk(g, bottom, down, wanted - mass["up"] + 1)["at"]
            return F.when(
                wanted < mass["up"], F.when(above < 0, top).otherwise(above)
            ).otherwise(F.when(below < 0, bottom).otherwise(below))

        masses = F.struct(walk(g, top, up)["sum"].alias("up"), walk(g, bottom, down)["sum"].alias("down"))
        return _let(masses, choose)

    return _let(given, draw).cast("long")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, rank, start, count: each shard's run in the draw list of each source.

    quotas: rank, quota. Nodes are rows with an entry per source; each level is a map.
    """
    part = "array<struct<rank:int,start:bigint,count:bigint>>"
    entry = F.struct("rank", F.lit(0).cast("long").alias("start"), F.col("quota").alias("count"))
    nodes = quotas.where("quota > 0").agg(
        F.array_sort(F.collect_list(entry)).cast(part).alias("parts"), F.sum("quota").alias("all")
    )
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "all", "parts")

    def edge(shard: Column) -> Column:
        return F.floor(F.col("all") * (shard / F.lit(float(shards)))).cast("long")

    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = edge(middle) - edge(F.col("lo"))
        whole = edge(F.col("hi")) - edge(F.col("lo"))
        start = F.struct(
            whole.alias("n"), left.alias("m"), F.array().cast("array<bigint>").alias("xs")
        )

        def step(a, p):
            u = _uniform(F.lit(seed), F.col("lo"), F.col("hi"), p["rank"])
            x = F.when(a["m"] <= 0, F.lit(0).cast("long")).otherwise(hypergeometric(a["n"], p["count"], a["m"], u))
            return _let(
                x,
                lambda v: F.struct(
                    (a["n"] - p["count"]).alias("n"),
                    (a["m"] - v).alias("m"),
                    F.concat(a["xs"], F.array(v)).alias("xs"),
                ),
            )

        drawn = nodes.select("lo", "hi", "all", "parts", middle.alias("mid"), F.aggregate("parts", start, step)["xs"].alias("xs"))

        def half(first: bool):
            pick = F.transform(
                "parts",
                lambda p, i: F.struct(
                    p["rank"].alias("rank"),
                    (p["start"] + (F.lit(0) if first else F.get("xs", i))).cast("long").alias("start"),
                    (F.get("xs", i) if first else p["count"] - F.get("xs", i)).alias("count"),
                ),
            )
            lo, hi = (F.col("lo"), F.col("mid")) if first else (F.col("mid"), F.col("hi"))
            return F.struct(lo.alias("lo"), hi.alias("hi"), F.filter(pick, lambda p: p["count"] > 0).alias("parts"))

        leaf = F.array(F.struct("lo", "hi", "parts"))
        children = F.when(F.col("hi") - F.col("lo") > 1, F.array(half(True), half(False))).otherwise(leaf)
        nodes = drawn.select("all", F.explode(children).alias("c")).select("c.lo", "c.hi", "all", "c.parts")
        if level % 6 == 5:
            nodes = nodes.repartition("lo")
    runs = nodes.select(F.col("lo").alias("shard"), F.explode("parts").alias("p"))
    return runs.select("shard", "p.rank", "p.start", "p.count")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, copy: what the mix needs of each row."""
    sizes = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), nullable("source").alias("key"), word_count(F.col("text")).alias("size")
    )
    counted = sizes.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("doc_id", "source", "key", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def _draws(rows: DataFrame, block_words: int | None, seed: int) -> DataFrame:
    """ROW, place, start, words, round, quota: every draw of a block, with its place in
    the draw list of its source. rows: ROW, source_size, target."""
    wanted = F.round("target").cast("long")
    if block_words is None:
        blocks = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("words")))
    else:
        last = F.floor((F.col("size") - 1) / block_words).cast("long")
        blocks = F.transform(
            F.sequence(F.lit(0).cast("long"), last),
            lambda i: F.struct((i * block_words).alias("start"), F.least(F.lit(block_words), F.col("size") - i * block_words).alias("words")),
        )
    cut = rows.where("size > 0").select(
        *ROW,
        wanted.alias("wanted"),
        "source_size",
        F.explode(blocks).alias("block"),
    ).select("*", "block.start", "block.words")
    hashed = cut.drop("block").withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "size", "copy", "start"))
    hashed = hashed.withColumn("range", F.shiftrightunsigned("u", 64 - RANGES.bit_length() + 1))
    # Places and words before each hash range: a bounded table per source.
    ranges = hashed.groupBy("rank", "range").agg(F.count(F.lit(1)).alias("k"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "rank",
        "range",
        F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"),
        F.sum("k").over(Window.partitionBy("rank")).alias("blocks"),
    )
    within = Window.partitionBy("rank", "range").orderBy("u", *ROW, "start")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.select(
        "*", (F.row_number().over(within) - 1).alias("k1"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("w1")
    ).join(offsets, ["rank", "range"])
    before = F.col("w0") + F.col("w1")
    rounds = F.floor(F.col("wanted") / F.col("source_size")).cast("long")
    rest = F.col("wanted") - rounds * F.col("source_size")
    part = F.greatest(F.least(F.col("words"), rest - before), F.lit(0))
    if block_words is None:
        part = F.when(2 * (rest - before) > F.col("words"), F.col("words")).otherwise(F.lit(0))
    told = placed.select(*ROW, "start", "words", "blocks", (F.col("k0") + F.col("k1")).alias("k"), rounds.alias("rounds"), part.alias("part"))
    times = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("rounds")),
        lambda r: F.struct(r.alias("round"), F.when(r < F.col("rounds"), F.col("words")).otherwise(F.col("part")).alias("words")),
    )
    drawn = told.select(*ROW, "start", "blocks", "k", F.explode(times).alias("t")).where("t.words > 0")
    return drawn.select(*ROW, "start", "t.round", "t.words", (F.col("t.round") * F.col("blocks") + F.col("k")).alias("place"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_repeat: int = 3,
    block_words: int | None = 256,
    shard_words: int = 1 << 20,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(rows, draws).

    rows: doc_id, key, rank, size, copy, source_size, target of every row of ``docs``.
    draws: doc_id, rank, size, copy, start, round, words, shard, turn: the block of
    ``words`` words from word ``start`` (0-based) is the one at ``turn`` (a hash) of
    ``shard``. Writing a shard in the order of ``turn`` gives its local shuffle.
    """
    sized = stored(_rows(docs), "sizes")
    aims = stored(targets(sized, weights, max_repeat), "targets")
    rows = sized.join(aims, "key").select("doc_id", "key", "rank", "size", "copy", "source_size", "target")
    draws = stored(_draws(rows, block_words, seed), "draws")
    quotas = draws.groupBy("rank").agg(F.count(F.lit(1)).alias("quota"))
    words = draws.agg(F.sum("words")).first()[0] or 0
    runs = split_quotas(quotas, max(1, math.ceil(words / shard_words)), seed)
    places = runs.select(
        "shard", "rank", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("place")
    )
    sharded = draws.join(places.hint("merge"), ["rank", "place"]).withColumn(
        "turn", F.xxhash64(F.lit(seed), "shard", "rank", "place")
    )
    return rows, sharded.drop("place")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and pieces (draws of its blocks) of each
    row of ``docs``."""
    rows, draws = mix(docs, **options)
    taken = draws.groupBy(*[F.col(c).alias(f"_{c}") for c in ROW]).agg(
        F.sum("words").alias("taken"), F.count("shard").alias("pieces")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]
    found = rows.join(taken, same[0] & same[1] & same[2] & same[3], "left")
    none = F.lit(0).cast("long")
    return found.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("pieces", none).alias("pieces")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, whole, as often as the mix takes them, columns unchanged."""
    rows, draws = mix(docs, block_words=None, **options)
    takes = draws.groupBy(nullable("doc_id").alias("_id"), "rank", "size").agg(F.count("shard").alias("_takes"))
    groups = rows.groupBy(nullable("doc_id").alias("_id"), "key", "rank", "size").agg(F.count(F.lit(1)).alias("_rows"))
    times = groups.join(takes, ["_id", "rank", "size"]).select(
        "_id", F.col("key").alias("_key"), F.col("size").alias("_size"), "_rows", "_takes"
    )
    whole = docs.select(
        F.struct("*").alias("_row"),
        nullable("doc_id").alias("_id"),
        nullable("source").alias("_key"),
        word_count(F.col("text")).alias("_size"),
    )
    # Rows alike in all three share their draws; numbering them needs the same shuffle
    # as the join that follows.
    alike = Window.partitionBy("_id", "_key", "_size").orderBy(F.lit(0))
    numbered = whole.withColumn("_n", F.row_number().over(alike)).join(times, ["_id", "_key", "_size"])
    each = F.floor(F.col("_takes") / F.col("_rows")) + F.when(
        F.col("_n") <= F.col("_takes") % F.col("_rows"), 1
    ).otherwise(0)
    repeated = numbered.select("_row", F.explode(F.array_repeat(F.lit(0), each.cast("int"))))
    return repeated.select("_row.*")
