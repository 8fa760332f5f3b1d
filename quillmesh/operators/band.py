"""Joins of rows whose times lie within a band.

A plain condition on the distance of two times makes a nested loop. Here one
side is put in buckets as wide as the band, the other in its own bucket and both
beside it, and they meet by equality of buckets (and of further keys, where
there are any); the exact condition, to the microsecond, follows. Each pair
meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def band_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, keys: list[tuple[str, str]] = (), condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs with |left_ts - right_ts| <= seconds; columns of both sides must differ in name. how: inner, left_semi or left_anti."""
    a = left.withColumn("__band", band_of(left_ts, seconds))
    b = right.withColumn("__near", F.explode(F.array(*(band_of(right_ts, seconds) + k for k in (-1, 0, 1)))))
    on = (F.col("__band") == F.col("__near")) & text.within_seconds(left_ts, right_ts, seconds)
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    if condition is not None:
        on = on & condition
    out = a.join(b, on, how)
    return out.drop("__band", "__near")


def band_of(ts: str, seconds: int) -> Column:
    return F.floor(text.micros(ts) / F.lit(max(1, seconds) * 1_000_000)).cast("long")


def first_words(rows: DataFrame, words: str, least: float, name: str) -> DataFrame:
    """Rows without words go, others come once for each of their first n - ceil(least n) + 1 words in one order of all words: two sets of that similarity share one."""
    n = F.size(words)
    return rows.where(n > 0).withColumn(name, F.explode(F.slice(F.sort_array(words), 1, (n - F.ceil(n * least) + 1).cast("int"))))


def word_band_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, left_words: str, right_words: str, least: float, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs within the band whose word sets have a Jaccard similarity of `least` or more (above 0).

    First words are the join's keys, beside the bucket.
    how: inner (a pair comes for each key it shares) or left_semi (left rows, for each key that finds a partner).
    """
    similar = text.jaccard(left_words, right_words) >= least
    on = similar if condition is None else condition & similar  # the cheap one first
    pairs = band_join(first_words(left, left_words, least, "__lw"), first_words(right, right_words, least, "__rw"), left_ts, right_ts, seconds, keys=[("__lw", "__rw")], condition=on, how=how)
    return pairs.drop("__lw", "__rw")


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l_set, l_band, r_set, r_band of the similar word sets in one band or in bands side by side. Sides: words, band; each set of a band counts once, however many rows have it."""
    once = lambda rows, prefix: rows.groupBy(word_key("words").alias(prefix + "set"), F.col("band").alias(prefix + "band")).agg(F.first("words").alias(prefix + "words"))
    a = first_words(once(left, "l_"), "l_words", least, "__word").withColumn("__near", F.col("l_band"))
    b = first_words(once(right, "r_"), "r_words", least, "__word").withColumn("__near", F.explode(F.array(*(F.col("r_band") + k for k in (-1, 0, 1)))))
    return a.join(b, ["__near", "__word"]).where(text.jaccard("l_words", "r_words") >= least).select("l_set", "l_band", "r_set", "r_band").distinct()


def word_key(words: str) -> Column:
    """One text for equal sets of words."""
    return F.array_join(F.sort_array(words), " ")


def nearest_in_band(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """id, distance, value: of each left row (id, key, at) the nearest right row (key, at, value) of its key within the band, ties to the smallest value.

    No pairs are made: both sides are put in order of time, in buckets of the
    band's width that also have the last point before them and the first after.
    """
    row = Window.partitionBy("key", "band")
    points = right.where("key is not null and at is not null").groupBy("key", "at").agg(F.min("value").alias("value")).withColumn("band", band_of("at", seconds)).withColumn("point", F.struct(text.micros("at").alias("us"), "value"))
    edges = points.groupBy("key", "band").agg(F.min("point").alias("first"), F.max("point").alias("last"))
    beside = edges.select("key", (F.col("band") - 1).alias("band"), F.col("first").alias("point")).unionByName(edges.select("key", (F.col("band") + 1).alias("band"), F.col("last").alias("point")))
    known = points.select("key", "band", "point").unionByName(beside).withColumn("us", F.col("point.us"))
    asked = left.where("key is not null and at is not null").select("id", "key", band_of("at", seconds).alias("band"), text.micros("at").alias("us"))
    rows = asked.unionByName(known, allowMissingColumns=True)
    before = F.last("point", ignorenulls=True).over(row.orderBy("us"))
    after = F.last("point", ignorenulls=True).over(row.orderBy(F.desc("us")))
    rows = rows.withColumn("before", before).withColumn("after", after).where("id is not null")

    def reach(side: str) -> Column:
        distance = F.abs(F.col("us") - F.col(side + ".us"))
        return F.when(distance <= seconds * 1_000_000, F.struct(distance.alias("distance"), F.col(side + ".value").alias("value")))

    return rows.select("id", F.least(reach("before"), reach("after")).alias("x")).where("x is not null").select("id", "x.distance", "x.value")
