"""URL tables derived from the given tables; :mod:`checks.sql_views` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.functions.features import count_char, count_digits
from urlgauge.operators.metrics import decide


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL, labelled by its scheme."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ordinal"),
        "url",
        F.col("url").startswith("http://").cast("int").alias("label"),
        F.lit("site").alias("source"),
    )


def urls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with padding, missing URLs, odd label spellings and repeats."""
    base = urls(spark, sf_dir)
    n = F.col("ordinal")
    url = (
        F.when(n % 75 == 0, None)
        .when(n % 75 == 25, "")
        .when(n % 75 == 50, "nan")
        .when(n % 10 == 3, F.concat(F.lit("  "), "url", F.lit(" \t")))
        .otherwise(F.col("url"))
    )
    bad = F.when(n % 2 == 0, " bad ").otherwise("BAD")
    good = F.when(n % 2 == 0, "Good").otherwise("good")
    label = F.when(n % 40 == 7, "unknown").when(F.col("label") == 1, bad).otherwise(good)
    first = base.select(url.alias("url"), label.alias("label"), n.alias("ordinal"))
    again = base.filter(n % 15 == 4).select(
        "url", F.when(F.col("label") == 1, "good").otherwise("bad").alias("label"), (n + 1000000000).alias("ordinal")
    )
    return first.unionByName(again)


def feed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page: some known URLs, new ones for the others, and repeats of half of these."""
    n = F.col("ordinal")
    url = F.when(n % 7 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/feed")))
    rows = urls(spark, sf_dir).select(url.alias("url"), "ordinal")
    again = rows.filter((n % 7 != 0) & (n % 2 == 0)).withColumn("ordinal", n + 1000000000)
    return rows.unionByName(again)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, pos, url``: every link of every page, made absolute."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    site = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", site.alias("site"), F.posexplode(hrefs).alias("pos", "href"))
    absolute = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat("site", "href"))
    return rows.select("page_id", "pos", absolute.alias("url"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a rule score full of ties."""
    url = F.col("url")
    score = count_digits(url) / F.lit(12.0) + F.lit(0.25) * count_char(url, "?") + F.lit(0.2) * F.col("label")
    proba = F.round(F.least(F.lit(1.0), score), 2)
    return urls(spark, sf_dir).withColumn("proba", proba).withColumn(
        "pred", decide(F.col("proba"), 0.5)
    )


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large scored table: many distinct scores, two slices."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("source"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") / 105000.0).alias("proba"),
        (F.col("l_extendedprice") / 105000.0 >= 0.5).cast("int").alias("pred"),
    )


def short_url_score(df: DataFrame) -> DataFrame:
    """A detector that trusts long URLs, so padding a URL fools it."""
    return df.withColumn("proba", 1 - F.length("url") / F.lit(100.0)).withColumn(
        "pred", decide(F.col("proba"), 0.5)
    )
