"""Judge URLs by curated rules, and by association rules mined from what these decide.

A URL becomes a set of tokens: its scheme, the labels of its host and their last two
together, its path segments (numbers as one token) and the names of its query fields.
FP-growth mines token sets from labelled URLs, the label being one more token; sets of
at most ``max_tokens`` tokens whose label holds with enough confidence and support become
rules. Tokens of the same labelled URLs are mined as one item, and URLs of many items are
projected to parts of them, so a popular long URL costs no more than its sets of that size.
A rule is indexed under its least frequent item. Distinct token sets look their items up
in that index, rules whose other items are missing fall away, and the best rule decides:
by confidence, then support, then fewer tokens, then text order.

Defined results: a null URL, or one without ``://``, has neither host, path nor tokens;
URLs that no rule fits are allowed; without labelled URLs there are no mined rules;
repeated rows each get the same verdict.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.texts import ascii_lower, stored

# Curated (verdict, host and path) rules; the longest that fits decides.
CURATED = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
LABEL = "="
DEFAULT = "allow"
WIDE = 12  # items of a transaction, whose 2 ** 12 subsets FP-growth may list


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(cast(url as string), instr(cast(url as string), '://') + 3)"))
    split = pages.select("page_id", url.alias("url"), F.coalesce(rest, F.lit("")).alias("rest"))
    return split.select(
        "page_id",
        "url",
        "rest",
        ascii_lower(F.regexp_extract("rest", "^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def curated_rule(rules: list[tuple[str, str]] = CURATED) -> Column:
    """The longest rule that fits host and path, as (length, rule, verdict), or null."""
    fits = []
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        own = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        fit = own & F.startswith("path", F.lit(f"/{path}"))
        entry = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(fit, entry))
    return F.array_max(F.array(*fits))


def url_tokens() -> Column:
    """Distinct tokens of a row with url, rest, host and path, in order."""
    labels = F.split("host", r"\.")
    ends = F.slice(labels, -2, 2)
    suffix = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(ends, "."))))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    query = F.regexp_extract("rest", r"^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda f: F.split(f, "=")[0]), lambda f: f != "")
    none = F.array().cast("array<string>")
    tokens = F.concat(
        F.array(F.concat(F.lit("s:"), ascii_lower(F.substring_index("url", "://", 1)))),
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.coalesce(suffix, none),
        F.transform(segments, lambda s: F.when(s.rlike("^[0-9]+$"), "p:#").otherwise(F.concat(F.lit("p:"), s))),
        F.transform(names, lambda f: F.concat(F.lit("q:"), f)),
    )
    return F.when(F.col("host") == "", none).otherwise(F.array_sort(F.array_distinct(tokens)))


def token_classes(urls: DataFrame, least: int) -> DataFrame:
    """token, item, n and rank of each token of ``least`` URLs or more.

    Tokens of exactly the same URLs (told by 128 bits of hashes) are one item, named by
    the first of them. n counts the URLs, rank numbers the items by n. There are at most
    as many tokens as URLs have on average, divided by the support.
    """
    each = urls.groupBy("tokens").count().select(
        F.explode("tokens").alias("token"),
        "count",
        F.xxhash64(F.lit(1), "tokens").alias("a"),
        F.xxhash64(F.lit(2), "tokens").alias("b"),
    )
    told = each.groupBy("token").agg(F.sum("count").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    same = Window.partitionBy("n", "a", "b")
    named = told.where(F.col("n") >= least).select("token", F.min("token").over(same).alias("item"), "n")
    return named.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"), "item")) - 1)


def _combinations(blocks: Column, most: int) -> Column:
    """All ascending lists of one to ``most`` of the ascending distinct numbers."""
    found = level = F.transform(blocks, lambda b: F.array(b))
    for _ in range(most - 1):
        level = F.flatten(
            F.transform(level, lambda c: F.transform(F.filter(blocks, lambda b: b > F.element_at(c, -1)), lambda b: F.concat(c, F.array(b))))
        )
        found = F.concat(found, level)
    return found


def transactions(urls: DataFrame, classes: DataFrame, max_tokens: int, wide: int = WIDE) -> DataFrame:
    """items of the projections of each URL in which its sets of up to ``max_tokens`` are mined.

    FP-growth lists every subset of a frequent transaction. Where a URL has more than
    ``wide`` items, these are dealt to blocks, and a URL is projected to each combination
    of up to ``max_tokens`` blocks: a set is counted where it has items of every block, so
    in one projection of each of its URLs. Items carry their combination and their block.
    """
    owned = urls.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(classes, "token")
    held = stored(owned.groupBy("tokens").agg(F.collect_set(F.struct("rank", "item")).alias("held")), "items")
    widest = held.agg(F.max(F.size("held"))).first()[0] or 0
    blocks = 1 if widest <= wide else max(max_tokens, math.ceil(widest * max_tokens / wide))
    dealt = held.select(
        "tokens", F.transform("held", lambda h: F.struct((h["rank"] % blocks).alias("block"), h["item"].alias("item"))).alias("held")
    )
    present = F.array_sort(F.array_distinct(F.transform("held", lambda h: h["block"])))
    parts = dealt.select("tokens", "held", F.explode(_combinations(present, max_tokens)).alias("part"))
    tag = F.array_join(F.col("part").cast("array<string>"), ",")
    items = F.transform(
        F.filter("held", lambda h: F.array_contains(F.col("part"), h["block"])),
        lambda h: F.concat(tag, F.lit("|"), h["block"].cast("string"), F.lit("|"), h["item"]),
    )
    lists = parts.select("tokens", F.struct(tag.alias("tag"), items.alias("items")).alias("t"))
    # One row per URL and projection; equal URLs stay separate rows, as their number is the support.
    label = F.concat(F.col("t.tag"), F.lit("||"), F.lit(LABEL), F.col("verdict"))
    return urls.join(lists, "tokens").select(F.concat("t.items", F.array(label)).alias("items"))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, max_tokens: int = 3, wide: int = WIDE
) -> tuple[DataFrame, DataFrame]:
    """Rules (needs, verdict, confidence, support, index) over items, and the classes of tokens.

    labelled: tokens (distinct, sorted) and verdict. support counts the URLs that have
    the items and the label.
    """
    spark = labelled.sparkSession
    urls = stored(labelled.where(F.size("tokens") > 0).select("tokens", "verdict"), "urls")
    least = max(1, math.ceil(min_support * urls.count()))
    classes = stored(token_classes(urls, least), "classes")
    mined = stored(transactions(urls, classes, max_tokens, wide), "transactions")
    total = mined.count()
    if not total:
        return spark.createDataFrame([], "needs array<string>, verdict string, confidence double, support bigint, index string"), classes
    # Half a row less, so that rounding cannot ask for one row more.
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=1.0).fit(mined).freqItemsets
    parts = F.transform("items", lambda i: F.split(i, r"\|", 3))
    sets = found.where(F.size("items") <= max_tokens + 1).select("freq", parts.alias("parts"))

    def is_label(part):
        return part[1] == ""

    plain_parts = F.filter("parts", lambda p: ~is_label(p))
    whole = sets.select(
        "freq",
        F.array_sort(F.transform(plain_parts, lambda p: p[2])).alias("needs"),
        F.substring(F.get(F.filter("parts", is_label), 0)[2], len(LABEL) + 1, 1 << 20).alias("verdict"),
        # Only a set with items of every block of its projection is counted whole.
        (F.size(F.array_distinct(F.transform(plain_parts, lambda p: p[1]))) == F.size(F.split(F.col("parts")[0][0], ","))).alias("full"),
    )
    counted = stored(whole.where((F.size("needs") > 0) & (F.size("needs") <= max_tokens) & F.col("full")), "itemsets")
    plain = counted.where("verdict is null").select("needs", F.col("freq").alias("n"))
    told = counted.where("verdict is not null").select("needs", "verdict", F.col("freq").alias("support"))
    rules = told.join(plain, "needs").withColumn("confidence", F.col("support") / F.col("n"))
    kept = rules.where(F.col("confidence") >= min_confidence).select("needs", "verdict", "confidence", "support")
    # The index item: the least frequent of a rule, ties by text.
    single = classes.select("item", F.col("n").alias("common")).distinct()
    rarest = (
        kept.select("*", F.explode("needs").alias("item"))
        .join(single, "item")
        .groupBy("needs", "verdict", "confidence", "support")
        .agg(F.min(F.struct("common", "item"))["item"].alias("index"))
    )
    return stored(rarest, "rules"), classes


def match_rules(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """tokens and mined verdict of each token set that a rule fits.

    A set has an item if it has any of its tokens; the first of those stands for it in
    text order.
    """
    own = sets.select("tokens", F.explode("tokens").alias("token")).join(classes, "token")
    first = own.groupBy("tokens", "item").agg(F.min("token").alias("token"))
    held = first.groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("held"))
    looked_up = held.select("tokens", "held", F.explode(F.map_keys("held")).alias("index")).join(rules, "index")
    fitting = looked_up.where(F.size(F.array_except("needs", F.map_keys("held"))) == 0)
    shown = F.array_sort(F.transform("needs", lambda i: F.col("held")[i]))
    best = F.min(
        F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("needs").alias("k"), shown.alias("needs"), "verdict")
    )
    return fitting.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.verdict").alias("mined"))


def judge_urls(pages: DataFrame, curated: list[tuple[str, str]] = CURATED, **options) -> DataFrame:
    """page_id, host, path, rule (of the curated list, or null) and verdict of each row."""
    ruled = with_parts(pages).withColumn("fit", curated_rule(curated))
    judged = stored(
        ruled.select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("told"), url_tokens().alias("tokens")
        ),
        "judged",
    )
    rules, classes = mine_rules(judged.where("told is not null").select("tokens", F.col("told").alias("verdict")), **options)
    open_sets = judged.where("told is null").select("tokens").distinct()
    mined = stored(match_rules(open_sets, rules, classes), "mined")
    found = judged.join(mined, "tokens", "left")
    verdict = F.coalesce("told", "mined", F.lit(DEFAULT)).alias("verdict")
    return found.select("page_id", "host", "path", "rule", verdict)
