"""The poll cycle: listings first, then the bodies of the newest messages that lack theirs.

Fetching is the caller's (Fetcher). A list's poll stores previews of what it
hasn't seen, then whole messages for at most 25 previews of the last 14 days; its
health is recorded either way, and a list that fails is left alone for longer
each time, up to half an hour.
"""

from __future__ import annotations

from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import store
from ..sources import feeds
from . import ingest

INTERVAL = 60


class Fetcher(Protocol):
    def listing(self, list_name: str, as_of: datetime) -> DataFrame:
        """Previews as feeds.listing gives them; raises where the archive can't be read."""

    def bodies(self, pending: DataFrame) -> DataFrame:
        """source_url, headers, body_html, attachments of those of the pending messages that can be had, as feeds.message_pages gives them."""


def raw(rows: DataFrame) -> DataFrame:
    """Rows in the shape of raw messages (schemas.RAW_MESSAGE); columns that they lack are null."""
    shape = rows.sparkSession.createDataFrame([], schemas.RAW_MESSAGE).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields))


def poll_list(tables: store.Store, fetcher: Fetcher, list_name: str, organizations: DataFrame, locations: DataFrame, as_of: datetime, days: int = 14, per_list: int = 25) -> dict:
    """One poll of one list; returns what was seen, stored and, where it failed, why."""
    stats: dict = {"list": list_name, "seen": 0, "created": 0, "bodies": 0, "error": None}
    now = F.lit(as_of)
    try:
        items = tables.stage(fetcher.listing(feeds.check_list(list_name), as_of))
        stats["seen"] = items.count()
        new = tables.stage(feeds.unseen(items, tables.read("messages", schemas.MESSAGES)).drop("id"))
        stats["created"] = new.count()
        if stats["created"]:
            ingest.ingest_batch(tables, raw(new), organizations, locations, as_of)
        own = tables.read("messages", schemas.MESSAGES).where(F.col("listserv") == list_name)
        pending = tables.stage(feeds.pending_bodies(own, now, days, per_list).select("listserv", "archive_id", "source_url", "subject", F.col("sender_name").alias("author_name"), F.col("sender_email").alias("author_email"), "sent_at"))
        if not pending.isEmpty():
            whole = tables.stage(raw(pending.join(fetcher.bodies(pending), "source_url").withColumn("complete", F.lit(True))))
            stats["bodies"] = whole.count()
            if stats["bodies"]:
                ingest.ingest_batch(tables, whole, organizations, locations, as_of)
    except Exception as error:  # any failure of a list is its own: it is recorded, and the others go on
        stats["error"] = str(error) or type(error).__name__
    polls = tables.spark.createDataFrame([(list_name, as_of, stats["error"])], "listserv string, polled_at timestamp, error string")
    tables.write("sources", tables.stage(store.source_health(tables.read("sources", schemas.SOURCES), polls)))
    tables.clear_stage()
    return stats


def due(sources: DataFrame, lists: list[str], as_of: datetime, interval: int = INTERVAL) -> list[str]:
    """The lists that aren't being left alone after failures."""
    wait = F.when(F.col("failures") > 0, feeds.backoff("failures", interval)).otherwise(F.lit(0))
    resting = sources.where((F.col("failures") > 0) & (text.micros("last_polled_at") + wait * 1_000_000 > text.micros(F.lit(as_of))))
    names = {r.listserv for r in resting.where(F.col("listserv").isin(lists)).select("listserv").collect()}  # at most the lists that are polled
    return [name for name in lists if name not in names]


def cycle(tables: store.Store, fetcher: Fetcher, lists: list[str], organizations: DataFrame, locations: DataFrame, as_of: datetime, interval: int = INTERVAL) -> list[dict]:
    """One round over the lists that are due."""
    return [poll_list(tables, fetcher, name, organizations, locations, as_of) for name in due(tables.read("sources", schemas.SOURCES), lists, as_of, interval)]
