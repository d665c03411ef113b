"""Tables stored by key: same rows as the plain operators, and no shuffle of what is stored."""

import re

from urlgauge.operators.dedup import keep_first
from urlgauge.operators.overlap import common_urls, only_new, union_keep_first
from urlgauge.operators.stored import store_by_key, stored_common, stored_new, stored_union_first


def rows(df):
    return sorted(map(str, df.collect()))


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def test_stored_tables_stay_where_they_are(spark):
    first = spark.createDataFrame([(f"u{i % 700}", i, i % 2) for i in range(1000)] + [(None, 5, 1)], "url string, ordinal int, label int")
    second = spark.createDataFrame([(f"u{i}", i, 3) for i in range(500, 1500)] + [("u3", -1, 3), (None, 9, 3)], first.schema)
    a, b = store_by_key(first, buckets=4), store_by_key(second, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = [
            (keep_first(a), keep_first(first)),
            (stored_new(b, a), only_new(second, first)),
            (stored_common(a, b), common_urls(first, second).where("url is not null")),
            (stored_union_first(a, b), union_keep_first(first, second).where("url is not null")),
        ]
        for got, want in pairs:
            assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))
            assert exchanges(got) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty(spark):
    empty = store_by_key(spark.createDataFrame([], "url string, ordinal int"), buckets=4)
    assert stored_new(empty, empty).count() == stored_common(empty, empty).count() == stored_union_first(empty, empty).count() == 0
