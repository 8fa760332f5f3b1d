"""Duplicates among events: repeats of official ones, and reminders of earlier announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .band import band_join, band_of, nearest_in_band, similar_sets, word_band_join, word_key

OFFICIAL_SECONDS, REMINDER_SECONDS = 2700, 1800
OFFICIAL_LEAST, REMINDER_LEAST = 0.5, 0.4


def _side(events: DataFrame, prefix: str) -> DataFrame:
    """What the conditions need, words computed once a row."""
    rows = events.withColumn("words", text.similarity_words("title"))
    return rows.select(*(F.col(c).alias(prefix + c) for c in ("id", "starts_at", "host_org_id", "location_id", "created_at", "words")))


def _recent(events: DataFrame, as_of: Column) -> DataFrame:
    return events.where(text.micros("starts_at") > text.micros(as_of) - 86_400_000_000)


def official_duplicates(events: DataFrame, as_of: Column) -> DataFrame:
    """id, duplicate_of: active listserv events that repeat an active official one, the nearest in time (then of the smallest id)."""
    active = events.where("status = 'active'")
    side = lambda rows: rows.select("id", F.col("starts_at").alias("at"), "host_org_id", text.similarity_words("title").alias("words"))
    mine, theirs = side(_recent(active.where("source = 'listserv'"), as_of)), side(active.where("source = 'myprincetonu'"))
    # Events of one host meet by host and time, those without a host by time and the word sets like their own; in time only the nearest is looked at.
    host, words = F.concat(F.lit("host "), "host_org_id"), lambda c: F.concat(F.lit("words "), c)
    unknown = mine.where("host_org_id is null").withColumn("band", band_of("at", OFFICIAL_SECONDS))
    sets = similar_sets(unknown, theirs.withColumn("band", band_of("at", OFFICIAL_SECONDS)), OFFICIAL_LEAST).select("l_set", "l_band", "r_set").distinct()
    alike = unknown.withColumn("l_set", word_key("words")).withColumnRenamed("band", "l_band").join(sets, ["l_set", "l_band"])
    left = mine.select("id", host.alias("key"), "at").unionByName(alike.select("id", words(F.col("r_set")).alias("key"), "at"))
    right = theirs.select(host.alias("key"), "at", F.col("id").alias("value")).unionByName(theirs.select(words(word_key("words")).alias("key"), "at", F.col("id").alias("value")))
    found = nearest_in_band(left, right, OFFICIAL_SECONDS)
    return found.groupBy("id").agg(F.min_by("value", F.struct("distance", "value")).alias("duplicate_of"))


def _roots(active: DataFrame) -> DataFrame:
    """Events that no similar one within the band precedes.

    Of one word set in one bucket only the first can be such. It is preceded if
    another set's first is near and earlier, which two small tables tell, or
    another event of a similar set, which only sets are asked for that come
    before it and whose first didn't tell.
    """
    sides = _side(active, "o_").withColumn("set", word_key("o_words")).withColumn("band", band_of("o_starts_at", REMINDER_SECONDS))
    columns = [c for c in sides.columns if c not in ("set", "band")]
    worded = sides.where(F.size("o_words") > 0)
    made = F.struct("o_created_at", "o_id")
    heads = worded.groupBy("set", "band").agg(F.min_by(F.struct(*columns), made).alias("x")).select("set", "band", "x.*")
    classes = heads.select("band", F.col("o_words").alias("words"))
    similar = similar_sets(classes, classes, REMINDER_LEAST)
    own = heads.select(F.col("set").alias("l_set"), F.col("band").alias("l_band"), F.col("o_id").alias("l_id"), F.col("o_starts_at").alias("l_at"), F.struct("o_created_at", "o_id").alias("l_made"))
    other = heads.select(F.col("set").alias("r_set"), F.col("band").alias("r_band"), F.col("o_starts_at").alias("r_at"), made.alias("r_made"))
    earlier = similar.join(own, ["l_set", "l_band"]).join(other, ["r_set", "r_band"]).where(F.col("r_made") < F.col("l_made"))
    near = text.within_seconds("l_at", "r_at", REMINDER_SECONDS)
    told = earlier.groupBy("l_id").agg(F.max(F.coalesce(near, F.lit(False))).alias("near"))
    asked = earlier.join(told.where("not near"), "l_id", "left_semi").select("l_id", "l_at", "l_made", F.col("r_set").alias("set"), F.col("r_band").alias("band"))
    seen = worded.select("set", "band", F.col("o_starts_at").alias("r_at"), made.alias("r_made")).join(asked, ["set", "band"]).where((F.col("r_made") < F.col("l_made")) & near).select("l_id").distinct()
    preceded = told.where("near").select("l_id").unionByName(seen)
    single = sides.where("size(o_words) = 0").select(*columns)
    return heads.select(*columns).unionByName(single).join(preceded, F.col("o_id") == F.col("l_id"), "left_anti")


def reminders(events: DataFrame, as_of: Column) -> DataFrame:
    """id, duplicate_of: active listserv events announced earlier by one that isn't itself preceded by a similar one; the earliest such."""
    active = events.where("status = 'active' and source = 'listserv'")
    older = lambda a, b: F.struct(f"{a}_created_at", f"{a}_id") < F.struct(f"{b}_created_at", f"{b}_id")
    roots = _roots(active)
    later = _side(_recent(active, as_of), "l_")
    host, other = F.col("l_host_org_id"), F.col("o_host_org_id")
    close = (text.jaccard("l_words", "o_words") >= REMINDER_LEAST) | F.col("l_location_id").eqNullSafe(F.col("o_location_id"))
    hosted = band_join(later, roots, "l_starts_at", "o_starts_at", REMINDER_SECONDS, keys=[("l_host_org_id", "o_host_org_id")], condition=older("o", "l") & close)
    # Where one of the two has no host, words decide.
    for mine, theirs in ((later.where(host.isNull()), roots), (later.where(host.isNotNull()), roots.where(other.isNull()))):
        hosted = hosted.unionByName(word_band_join(mine, theirs, "l_starts_at", "o_starts_at", REMINDER_SECONDS, "l_words", "o_words", REMINDER_LEAST, older("o", "l")))
    pairs = hosted
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.min_by("o_id", F.struct("o_created_at", "o_id")).alias("duplicate_of"))


def mark_duplicates(events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Events with both kinds marked, the second looking at what the first left; and the ids of the events that were repeated, which consumers must read again."""

    def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
        hits = found.select("id", F.col("duplicate_of").alias("hit"))
        columns = rows.columns
        out = rows.join(hits, "id", "left")
        return out.withColumn("status", F.when(F.col("hit").isNotNull(), "duplicate").otherwise(F.col("status"))).withColumn("duplicate_of", F.coalesce("hit", "duplicate_of")).select(*columns)

    official = official_duplicates(events, as_of)
    once = marked(events, official)
    again = reminders(once, as_of)
    targets = official.select("duplicate_of").unionByName(again.select("duplicate_of")).distinct().withColumnRenamed("duplicate_of", "id")
    return marked(once, again), targets
