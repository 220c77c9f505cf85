"""Text columns that carry JSON, delimited records, XML or HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^\s]*$"
LINK = r"<a\s[^>]*?href=[\"']([^\"']*)[\"']"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def json_flatten(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed columns from JSON text; ``paths`` maps a name to (path, type)."""
    parsed = df.withColumn("_json", F.try_parse_json(F.col(column)))
    picked = {n: F.try_variant_get("_json", path, kind) for n, (path, kind) in paths.items()}
    return parsed.withColumns(picked).drop("_json")


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """How often each top-level key occurs."""
    keys = df.select(F.explode(F.json_object_keys(F.col(column))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def json_failures(df: DataFrame, column: str) -> DataFrame:
    text = F.col(column)
    bad = text.isNotNull() & F.try_parse_json(text).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("failures"))


def delimited_flatten(df: DataFrame, column: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text as columns; unreadable records keep their text in ``_bad``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "sep": sep}
    parsed = F.from_csv(F.col(column), f"{schema}, _bad STRING", options)
    return df.withColumn("_record", parsed).select(*df.columns, "_record.*")


def xml_flatten(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("_record", F.from_xml(F.col(column), schema)).select(
        *df.columns, "_record.*"
    )


def page_titles(df: DataFrame, html: str) -> DataFrame:
    return df.withColumn("title", F.trim(F.regexp_extract(F.col(html), TITLE, 1)))


def page_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per link of a page, in document order."""
    links = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    return df.select(key, F.posexplode(links).alias("position", "target"))


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """Validity, host and path depth of a URL column."""
    valid = F.coalesce(F.col(url).rlike(URL), F.lit(False))
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    steps = F.size(F.filter(F.split(path, "/"), lambda step: step != ""))
    return df.withColumns(
        {
            "valid": valid,
            "host": F.when(valid, F.try_parse_url(F.col(url), F.lit("HOST"))),
            "depth": F.when(valid, steps),
        }
    )


def url_host_stats(df: DataFrame, url: str) -> DataFrame:
    parts = url_parts(df, url)
    return parts.groupBy(F.coalesce("host", F.lit("—")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.max("depth").alias("max_depth"),
    )
