"""Records of CSV files that quote line breaks, read in splits.

Whether a line starts inside quotes depends on all lines before it. A line either keeps,
swaps or sets that state, and such steps can be put together in any grouping: each split's
lines are first summed to one step, the steps of a file's splits are put together in order
(a table of one row per split), and every split then knows the state that it starts with.
Within a split the state before a line is the last one set and the number of swaps since.
Splits are cut into chunks of ``CHUNK`` lines, and "split" means such a chunk below.

So a file is read by many tasks, none of which holds more than about ``TASK`` bytes or one chunk. Lines that are a record of their own
go on at once, only those of records with breaks are put together; a record that runs over
the end of a split is joined from the splits' pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.scratch import cut_lineage

# A quoted cell at the start of a line or after a comma, and one that is not closed.
_CELL = r'(^|,)[ \t]*"(?:[^"]|"")*+"(?!")'
_OPEN = r'(^|,)[ \t]*"'
_CLOSE = r'^(?:[^"]|"")*+"(?!")'
SPLIT = ["file", "split", "chunk"]
CHUNK = 1 << 13  # lines
TASK = 1 << 25  # bytes


def _ends_open(line: Column) -> Column:
    return F.regexp_replace(line, _CELL, "$1").rlike(_OPEN)


def _steps(lines: DataFrame) -> DataFrame:
    """Lines with set (the state after it, or null) and swap (0 or 1)."""
    text = F.col("value")
    quoted = F.contains(text, F.lit('"'))
    # What follows the quote that closes a cell is no start of another one.
    after = F.concat(F.lit("."), F.regexp_replace(text, _CLOSE, ""))
    outside = F.when(quoted, _ends_open(text)).otherwise(False)
    inside = F.when(~quoted, True).when(text.rlike(_CLOSE), _ends_open(after)).otherwise(True)
    told = lines.withColumns({"outside": outside, "inside": inside})
    same = F.col("outside") == F.col("inside")
    return told.withColumns(
        {
            "set": F.when(same, F.col("outside").cast("int")),
            "swap": (F.col("outside") & ~F.col("inside")).cast("int"),
        }
    ).drop("outside", "inside")


def _state(before: Window, start: Column | int) -> Column:
    """The state after the rows of a frame: set and swap are theirs, ``swaps`` the number
    of swaps up to each row."""
    last = F.last(F.when(F.col("set").isNotNull(), F.col("set") + F.col("swaps")), ignorenulls=True).over(before)
    swaps = F.coalesce(F.sum("swap").over(before), F.lit(0))
    return (F.coalesce(last, start if isinstance(start, Column) else F.lit(start)) + swaps) % 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    told = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    return told.withColumn("chunk", F.floor(F.col("at") / CHUNK))


def _starts(steps: DataFrame) -> DataFrame:
    """SPLIT, start (the state in which each split starts), begin (``at`` of the first line of
    all its chunks) and size (bytes); one row per split."""
    last = F.max(F.when(F.col("set").isNotNull(), F.struct("at", "set")))
    # Swaps after the last line that sets the state; counted from the split's start if none.
    of_split = steps.groupBy(*SPLIT).agg(
        last.alias("last"), F.min("at").alias("least"), F.sum(F.octet_length("value")).alias("size")
    )
    marked = steps.join(of_split, SPLIT).groupBy(*SPLIT).agg(
        F.first("last.set").alias("set"),
        F.first("least").alias("least"),
        F.first("size").alias("size"),
        F.coalesce(F.sum(F.when(F.col("last").isNull() | (F.col("at") > F.col("last.at")), F.col("swap"))), F.lit(0)).alias("own"),
    )
    # A split that sets the state ends in what it sets and the swaps after that.
    step = marked.select(
        *SPLIT,
        F.when(F.col("set").isNotNull(), (F.col("set") + F.col("own")) % 2).alias("set"),
        F.when(F.col("set").isNull(), F.col("own") % 2).otherwise(0).alias("swap"),
        F.min("least").over(Window.partitionBy("file", "split")).alias("begin"),
        "size",
    )
    by_file = Window.partitionBy("file").orderBy("split", "chunk")
    counted = step.withColumn("swaps", F.sum("swap").over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.select(*SPLIT, "begin", "size", _state(by_file.rowsBetween(Window.unboundedPreceding, -1), 0).alias("start"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame | None:
    """file, split, line (the place of the record's first line in the file's split) and text
    of every record; None where no record has a line break."""
    steps = _steps(_lines(spark, path))
    if steps.where("set = 1 OR swap = 1").isEmpty():
        return None
    starts = cut_lineage(_starts(steps))
    size = starts.agg(F.sum("size")).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    in_order = Window.partitionBy(*SPLIT).orderBy("at")
    upto, before = (in_order.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    dealt = steps.repartition(tasks, *SPLIT).join(starts.drop("size"), SPLIT)
    counted = dealt.withColumns({"line": F.col("at") - F.col("begin") + 1, "swaps": F.sum("swap").over(upto)})
    told = counted.select(
        *SPLIT, "at", "line", "value", _state(before, F.col("start")).alias("opened"), _state(upto, F.col("start")).alias("left_open")
    )
    # Where the record of a line began; 0 for one from an earlier split. One order for all
    # windows: the lines are sorted once.
    first = F.coalesce(F.max(F.when(F.col("opened") == 0, F.col("line"))).over(upto), F.lit(0))
    placed = cut_lineage(told.withColumn("first", first).drop("at"))
    single = (F.col("opened") == 0) & (F.col("left_open") == 0)
    whole = placed.where(single).select("file", "split", "line", F.col("value").alias("text"))

    def together(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Pieces of a record in order; as long as the record."""
        listed = F.array_sort(F.collect_list(F.struct(order, "value")))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda p: p["value"]), "\n").alias("value"), F.max_by("left_open", order).alias("left_open"))

    pieces = together(placed.where(~single), [*SPLIT, "first"], "line")
    inside = pieces.where("first > 0 AND left_open = 0").select("file", "split", F.col("first").alias("line"), F.col("value").alias("text"))
    # At most two pieces of a split are left: the end of a record, and the start of one.
    cut = pieces.where("first = 0 OR left_open = 1")
    by_file = Window.partitionBy("file").orderBy(*SPLIT[1:], "first").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("first") > 0, F.struct("split", "first")), ignorenulls=True).over(by_file)
    joined = together(
        cut.withColumn("begun", begun).withColumn("place", F.struct(*SPLIT[1:], "first")), ["file", "begun"], "place"
    ).select("file", F.col("begun.split").alias("split"), F.col("begun.first").alias("line"), F.col("value").alias("text"))
    return whole.unionByName(inside).unionByName(joined)


def split_records(records: DataFrame, options: dict[str, str]) -> DataFrame:
    """Columns of the records' cells, named by the first record of the first file."""
    bare = records.withColumn("text", F.regexp_replace("text", r"\r$", ""))
    bare = bare.withColumn("header", (F.col("split") == 0) & (F.col("line") == 1))
    header = bare.where("header").agg(F.min_by("text", "file")).first()[0] or ""
    spark = records.sparkSession
    shape = spark.range(1).select(F.schema_of_csv(F.lit(header), options).alias("s")).first()["s"]
    width = shape.count("_c")
    schema = ", ".join(f"_c{i} STRING" for i in range(width))
    named = spark.createDataFrame([(header,)], "text string").select(F.from_csv("text", schema, options).alias("r")).select("r.*").first()
    cells = [(c or f"_c{i}") for i, c in enumerate(named)]
    lowered = [c.lower() for c in cells]
    names = [f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]
    rows = bare.where(~F.col("header") & (F.trim("text") != ""))
    return rows.select(F.from_csv("text", schema, options).alias("r")).select("r.*").toDF(*names)
