"""Merging copies of one message that several lists delivered.

Copies that share a message id or a delivery key form a component; inside it
they are replayed in order of arrival, as the outcome depends on that order. A
component holds the copies of one delivery, so it is small; finding components
takes a few joins, replaying them one grouped pass.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text
from .band import band_join

SECONDS = 120


def same_delivery(a_rfc: Column, a_key: Column, a_at: Column, b_rfc: Column, b_key: Column, b_at: Column) -> Column:
    rfc, key = F.coalesce(a_rfc == b_rfc, F.lit(False)), F.coalesce(a_key == b_key, F.lit(False))
    return rfc | key & text.within_seconds(a_at, b_at, SECONDS)


def first_matches(messages: DataFrame) -> DataFrame:
    """id, match_id: the earliest copy (by arrival, then id) on another list with the same message id, or the same key within two minutes. Two equi-joins, not one disjunction."""
    mine = messages.select("id", "listserv", "rfc_message_id", "delivery_key", "sent_at")
    other = messages.select(F.col("id").alias("o_id"), F.col("listserv").alias("o_list"), F.col("rfc_message_id").alias("o_rfc"), F.col("delivery_key").alias("o_key"), F.col("sent_at").alias("o_sent"), F.col("ingested_at").alias("o_at"))
    apart = (F.col("id") != F.col("o_id")) & (F.col("listserv") != F.col("o_list"))
    by_rfc = mine.join(other, (F.col("rfc_message_id") == F.col("o_rfc")) & apart).select("id", "o_id", "o_at")
    by_key = band_join(mine, other, "sent_at", "o_sent", SECONDS, keys=[("delivery_key", "o_key")], condition=apart).select("id", "o_id", "o_at")
    return by_rfc.unionByName(by_key).groupBy("id").agg(F.min_by("o_id", F.struct("o_at", "o_id")).alias("match_id"))


def components(messages: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable over shared message ids and delivery keys."""
    rows = messages.select("id", "rfc_message_id", "delivery_key", F.col("id").alias("component"))
    while True:
        least = F.least(
            F.col("component"), *(F.when(F.col(k).isNotNull(), F.min("component").over(Window.partitionBy(k))) for k in ("rfc_message_id", "delivery_key"))
        )
        grown = rows.withColumn("next", least).checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.withColumn("next", least).cache()
        changed = grown.where("next <> component").limit(1).count()
        rows = grown.select("id", "rfc_message_id", "delivery_key", F.col("next").alias("component"))
        if not changed:
            return rows.select("id", "component")


class _Arrived:
    """Copies of one message id, or of one delivery key in one stretch of SECONDS, that arrived so far: what later copies can still match."""

    def __init__(self):
        self.first: dict[str, int] = {}  # of each list
        self.later: dict[str, tuple[list, list]] = {}  # of each list, those sent after all before them
        self.earlier: dict[str, tuple[list, list]] = {}  # those sent before all before them, by falling time, negated

    def add(self, at: int, listserv: str, sent: int) -> None:
        self.first.setdefault(listserv, at)
        for held, value in ((self.later, sent), (self.earlier, -sent)):
            sents, places = held.setdefault(listserv, ([], []))
            if not sents or value > sents[-1]:
                sents.append(value)
                places.append(at)

    def whole(self, listserv: str):
        return (at for name, at in self.first.items() if name != listserv)

    def since(self, listserv: str, sent: int, held: dict):
        """The first of each other list sent at `sent` or later (held: later), or at -sent or before (held: earlier)."""
        for name, (sents, places) in held.items():
            i = bisect_left(sents, sent)
            if name != listserv and i < len(sents):
                yield places[i]


def _replay(copies: pd.DataFrame) -> pd.DataFrame:
    """Canonical ids of one component's copies, which arrive one after another."""
    copies = copies.sort_values(["ingested_at", "id"])
    width = SECONDS * 1_000_000
    ids: list[str] = []
    canonical: dict[str, str | None] = {}
    followers: dict[str, set[str]] = defaultdict(set)
    by_rfc: dict[str, _Arrived] = defaultdict(_Arrived)
    by_key: dict[tuple[str, int], _Arrived] = defaultdict(_Arrived)
    for at, me in enumerate(copies.itertuples(index=False)):
        canonical[me.id] = me.canonical_id if isinstance(me.canonical_id, str) else None
        if canonical[me.id] is not None:
            followers[canonical[me.id]].add(me.id)
        has_rfc, has_key = isinstance(me.rfc_message_id, str), isinstance(me.delivery_key, str) and me.sent_at is not pd.NaT
        sent = me.sent_at.value // 1000 if me.sent_at is not pd.NaT else 0
        band = sent // width
        if canonical[me.id] is None and me.residential and (has_rfc or has_key):
            found: list[int] = []
            if has_rfc and me.rfc_message_id in by_rfc:
                found += by_rfc[me.rfc_message_id].whole(me.listserv)
            if has_key:
                before, same, after = (by_key.get((me.delivery_key, band + k)) for k in (-1, 0, 1))
                found += same.whole(me.listserv) if same else ()
                found += before.since(me.listserv, sent - width, before.later) if before else ()
                found += after.since(me.listserv, -(sent + width), after.earlier) if after else ()
            if found:
                other = ids[min(found)]
                root = canonical[other] or other
                if root != me.id:
                    for k in (me.id, *followers.pop(me.id, ())):
                        canonical[k] = root
                        followers[root].add(k)
        ids.append(me.id)
        if has_rfc:
            by_rfc[me.rfc_message_id].add(at, me.listserv, sent)
        if has_key:
            by_key[me.delivery_key, band].add(at, me.listserv, sent)
    return pd.DataFrame({"id": list(canonical), "canonical_id": list(canonical.values())})


def reconcile(messages: DataFrame) -> DataFrame:
    """id, canonical_id of every message (null: canonical itself). messages: id, listserv, rfc_message_id, delivery_key, sent_at, ingested_at, canonical_id."""
    keyed = messages.select("id", "listserv", "rfc_message_id", "delivery_key", "sent_at", "ingested_at", "canonical_id")
    linked = keyed.where("rfc_message_id is not null or delivery_key is not null")
    alone = keyed.where("rfc_message_id is null and delivery_key is null").select("id", "canonical_id")
    rows = linked.withColumn("residential", text.is_residential("listserv")).join(components(linked), "id")
    several = rows.withColumn("copies", F.count("*").over(Window.partitionBy("component")))
    one = several.where("copies = 1").select("id", "canonical_id")
    replayed = several.where("copies > 1").drop("copies").groupBy("component").applyInPandas(_replay, "id string, canonical_id string")
    return alone.unionByName(one).unionByName(replayed)


def bridge(messages: DataFrame) -> DataFrame:
    """message_id, listserv: the lists that each canonical message reached: its copies' own, and the residential ones they name. messages: id, canonical_id, listserv, recipient_lists."""
    named = F.filter(F.coalesce("recipient_lists", F.array().cast("array<string>")), lambda x: F.upper(x).isin(*fixed.RESIDENTIAL_LISTS))
    return messages.select(F.coalesce("canonical_id", "id").alias("message_id"), F.explode(F.array_union(F.array("listserv"), named)).alias("listserv")).distinct()


def inherit_bodies(messages: DataFrame) -> DataFrame:
    """Canonical messages without a whole body take that of their first whole copy."""
    columns = messages.columns
    body = ("body_text", "body_html", "links", "media")
    whole = messages.where("complete and canonical_id is not null").groupBy(F.col("canonical_id").alias("c_id")).agg(F.min_by(F.struct(*body), F.struct("ingested_at", "id")).alias("best"))
    rows = messages.join(whole, F.col("id") == F.col("c_id"), "left")
    takes = F.col("best").isNotNull() & ~F.col("complete")
    return rows.withColumns({b: F.when(takes, F.col(f"best.{b}")).otherwise(F.col(b)) for b in body} | {"complete": F.col("complete") | takes}).select(*columns)
