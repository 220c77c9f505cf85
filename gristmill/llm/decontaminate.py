"""Find passages of benchmark items in documents, allowing for substituted words.

Texts are sequences of normalised words (A-Z lower-cased; runs of letters and digits). An
item is found at an offset of a document if some window of ``WINDOW`` consecutive item
words equals the document's words there in all but ``SUBSTITUTIONS`` places. An item of fewer
words is one window, with as many substitutions as the masks allow (see ``allowed``).

Every document position is hashed under fixed masks that ignore some of the words they
span. The masks are chosen so that, wherever the substitutions fall in a window, one of
them fits between: no such window is missed. Items shorter than any mask are hashed whole,
and documents at each of the lengths that such items have. Seeds of documents and items are joined by
hash; the offsets of the hits are then verified word by word.

Document seeds are made inside the scan and first looked up in a table of hash buckets
(at most ``BUCKETS`` rows, so it can be sent to every task); only the few that pass are
shuffled. Hits are reduced to distinct offsets before the texts of the documents that
have any are joined, again past a bounded bucket table.

Defined results: null texts and texts without words hold nothing; places before the
start or past the end of a document count as substitutions; an item that occurs at
several offsets is reported for each; rows that repeat a document or item are one; rows
with one id and different texts are each searched, null ids like any other.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.texts import ascii_lower, nullable, stored

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 7, 8))
BUCKETS = 1 << 21
SHORTEST = 1 + min(mask[-1] for mask in MASKS)


def allowed(window: int) -> int:
    """The most substitutions, up to ``SUBSTITUTIONS``, that leave a mask wherever they fall."""
    placed = [{at + i for i in mask} for mask in MASKS for at in range(window - mask[-1])]
    for most in range(SUBSTITUTIONS, 0, -1):
        if placed and all(any(p.isdisjoint(c) for p in placed) for c in combinations(range(window), most)):
            return most
    return 0


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the normalised words of a text."""
    clean = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    hashes = F.transform(F.split(clean, " "), lambda w: F.xxhash64(w))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(hashes)


def _bucket(value: Column, buckets: int) -> Column:
    return value.bitwiseAND(F.lit(buckets - 1))


def seeds(rows: DataFrame, lengths: tuple[int, ...] = (), masks: bool = True) -> DataFrame:
    """id, at and key of each mask at each place it fits, and of each run of one of
    ``lengths`` words. rows: id, words."""
    shapes = [(number, mask) for number, mask in enumerate(MASKS) if masks]
    shapes += [(len(MASKS) + length, tuple(range(length))) for length in lengths]
    last = F.size("words") - 1 - min(places[-1] for _, places in shapes)
    placed = rows.where(last >= 0).select("id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    keys = [
        F.when(
            F.col("at") + places[-1] < F.size("words"),
            F.xxhash64(F.lit(number), *[F.get("words", F.col("at") + place) for place in places]),
        )
        for number, places in shapes
    ]
    return placed.select("id", "at", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, end_word, matched: the document's words from
    start_word up to end_word (0-based, end excluded) hold all windows found at one
    offset, ``matched`` of them equal to the item's."""
    return _leaks(docs, benchmark).drop("said").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``contaminated`` returns, and said: a hash of the row's text."""
    items = benchmark.select(F.col("item_id").alias("id"), word_hashes(F.col("text")).alias("words"))
    items = stored(items.where(F.size("words") > 0).distinct(), "items")
    short = items.where(F.size("words") < SHORTEST).select(F.size("words").alias("n")).distinct().collect()
    lengths = tuple(sorted(r.n for r in short))
    found = seeds(items)
    for length in lengths:
        found = found.unionAll(seeds(items.where(F.size("words") == length), (length,), masks=False))
    known = stored(found.select("key", F.col("id").alias("item_id"), F.col("at").alias("item_at")), "seeds")
    texts = docs.select(nullable("doc_id").alias("id"), F.col("doc_id"), "text")
    # At most BUCKETS rows of eight bytes.
    buckets = known.select(_bucket(F.col("key"), BUCKETS).alias("bucket")).distinct()
    looked = (
        seeds(texts.select("id", word_hashes(F.col("text")).alias("words")), lengths)
        .withColumn("bucket", _bucket(F.col("key"), BUCKETS))
        .join(F.broadcast(buckets), "bucket", "left_semi")
    )
    hits = looked.join(known, "key").select("id", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    hits = stored(hits, "hits")
    # Documents with hits, by bounded buckets of their ids, then by the ids.
    few = BUCKETS >> 3
    ids = hits.select(_bucket(F.xxhash64("id"), few).alias("bucket")).distinct()
    suspects = (
        texts.withColumn("bucket", _bucket(F.xxhash64("id"), few))
        .join(F.broadcast(ids), "bucket", "left_semi")
        .select("id", "doc_id", _said().alias("said"), word_hashes(F.col("text")).alias("words"))
    )
    pairs = hits.join(suspects.distinct(), "id").join(
        items.select(F.col("id").alias("item_id"), F.col("words").alias("item")), "item_id"
    )
    return _verified(pairs)


def _said() -> Column:
    """A hash of a row's text, by which rows of one id are told apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _verified(pairs: DataFrame) -> DataFrame:
    """The windows that hold. pairs: doc_id, said, item_id, offset, words, item."""
    # F.get is null outside the document, which then differs.
    equal = F.transform(
        "item", lambda w, i: F.when(F.get("words", F.col("offset") + i) == w, F.lit(1)).otherwise(F.lit(0))
    )
    compared = pairs.select("doc_id", "said", "item_id", "offset", F.size("words").alias("n"), equal.alias("equal"))
    window = F.least(F.lit(WINDOW), F.size("equal"))
    needed = F.get(F.array(*[F.lit(n - allowed(n)) for n in range(WINDOW + 1)]), window)
    enough = F.filter(
        F.sequence(F.lit(0), F.size("equal") - window),
        lambda i: F.aggregate(F.slice("equal", i + 1, window), F.lit(0), lambda a, x: a + x) >= needed,
    )
    found = compared.select("*", enough.alias("windows")).where(F.size("windows") > 0)
    first, last = F.col("windows")[0], F.element_at("windows", -1) + F.least(F.lit(WINDOW), F.size("equal"))
    spans = found.select("doc_id", "said", "item_id", "offset", "n", "equal", first.alias("first"), last.alias("last"))
    inside = F.aggregate(F.slice("equal", F.col("first") + 1, F.col("last") - F.col("first")), F.lit(0), lambda a, x: a + x)
    return spans.select(
        "doc_id",
        "said",
        "item_id",
        F.greatest(F.col("offset") + F.col("first"), F.lit(0)).cast("long").alias("start_word"),
        F.least(F.col("offset") + F.col("last"), F.col("n")).cast("long").alias("end_word"),
        inside.cast("long").alias("matched"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, by_row: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns unchanged.

    by_row: only rows with the text that holds one go, else all rows of its id.
    """
    leaks = _leaks(docs, benchmark).select(nullable("doc_id").alias("_id"), F.col("said").alias("_said"))
    same = ["_id", "_said"] if by_row else ["_id"]
    found = stored(leaks.select(*same).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("_row"), nullable("doc_id").alias("_id"), _said().alias("_said"))
    return rows.join(found, same, "left_anti").select("_row.*")
