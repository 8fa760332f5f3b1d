"""Ingest as a batch plan, and as a stream that replays the same plan on every micro-batch.

Ids are made from list and archive id and tables are merged by id, so a batch
that is run again changes nothing; a batch's tables change together or not at
all. That is what makes the stream exact.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import html, text
from ..operators import classify, events as event_ops, reconcile, store

KEYS = ("rfc_message_id", "delivery_key")


def normalize(raw: DataFrame, organizations: DataFrame, as_of: datetime, previous: DataFrame | None = None) -> DataFrame:
    """Messages (schemas.MESSAGES without revision) from raw ones. A stored message's relay is remembered."""
    lists = F.upper("listserv")
    rows = raw.withColumn("listserv", lists).withColumn("id", text.message_id("listserv", "archive_id")).dropDuplicates(["id"])
    if previous is not None:
        rows = rows.join(previous.select("id", F.col("via").isNotNull().alias("was_relayed")), "id", "left")
    else:
        rows = rows.withColumn("was_relayed", F.lit(False))
    rows = rows.select(
        "*", text.subject_of("subject", "listserv").alias("title"), html.readable_text_column(F.coalesce("body_text", F.lit("")), F.col("body_html")).alias("clean"),
    )
    rows = rows.withColumn("author", html.sender_column(F.col("author_name"), F.col("author_email"), F.col("clean"), F.col("body_html"), F.coalesce("via_hoagie", F.lit(False)) | F.coalesce("was_relayed", F.lit(False))))
    kinds = classify.classify(rows.select("id", F.col("title").alias("subject"), F.col("clean").alias("body"), F.col("author.name").alias("sender"), F.col("author.email").alias("sender_email"), "listserv"), organizations)
    rows = rows.join(kinds, "id")
    page = F.col("body_html")
    key = F.when(F.col("complete") & page.isNotNull(), html.delivery_key_column(F.col("headers"), page))
    resolved = F.col("organization_id").isNotNull()
    return rows.select(
        "id", "listserv", "archive_id", "source_url", F.col("title").alias("subject"), F.col("author.name").alias("sender_name"), F.col("author.email").alias("sender_email"), F.col("author.via").alias("via"),
        F.col("author.attribution").alias("sender_attribution"), "sent_at", html.preview_column(F.col("clean"), page).alias("preview"), F.col("clean").alias("body_text"), "body_html", "complete", text.extract_links("body_html").alias("links"),
        html.media_column(page, F.col("attachments")).alias("media"), F.col("headers.rfc_message_id").alias("rfc_message_id"), key.alias("delivery_key"), F.coalesce("headers.headers_complete", F.lit(False)).alias("headers_complete"),
        F.lit(None).cast("string").alias("canonical_id"), "category", "organization_id", F.when(resolved, F.col("organization")).alias("organization_name"), F.col("confidence").alias("org_confidence"),
        F.struct("evidence", F.col("input_hash").alias("hash")).alias("org_evidence"), F.col("version").alias("classifier_version"), F.lit(None).cast("string").alias("extraction_version"), F.lit(None).cast("string").alias("extraction_method"),
        F.lit(None).cast("boolean").alias("is_event"), F.lit(None).cast("array<string>").alias("extraction_notes"), F.lit(as_of).alias("ingested_at"), F.lit(as_of).alias("updated_at"),
        F.coalesce("headers.recipient_lists", F.array().cast("array<string>")).alias("recipient_lists"),
    )


def ingest_batch(tables: store.Store, raw: DataFrame, organizations: DataFrame, locations: DataFrame, as_of: datetime, extractor: event_ops.Extractor | None = None) -> dict[str, int]:
    """Normalize, upsert, reconcile, extract, mark duplicates; the next version of messages, message_lists and events. Returns counts of changes."""
    now = F.lit(as_of)
    current, events = tables.read("messages", schemas.MESSAGES), tables.read("events", schemas.EVENTS)
    bridge = tables.read("message_lists", schemas.MESSAGE_LISTS)
    incoming = tables.stage(normalize(raw, organizations, as_of, current))
    merged = store.upsert_messages(current, incoming.drop("recipient_lists").withColumn("revision", F.lit(None).cast("long")))
    merged = tables.stage(merged.withColumn("changed", F.col("change").isNotNull()))
    roots = reconcile.reconcile(merged).withColumnRenamed("canonical_id", "root")
    joined = merged.join(roots, "id")
    moved = ~F.col("canonical_id").eqNullSafe(F.col("root"))
    joined = joined.withColumn("change", F.when(moved, F.coalesce("change", F.lit("update"))).otherwise(F.col("change"))).withColumn("canonical_id", F.col("root")).drop("root")
    before = joined.select("id", F.col("complete").alias("was_complete"))
    whole = reconcile.inherit_bodies(joined).join(before, "id")
    whole = whole.withColumn("change", F.when(F.col("complete") & ~F.col("was_complete"), F.coalesce("change", F.lit("update"))).otherwise(F.col("change"))).drop("was_complete")
    whole = tables.stage(whole)
    todo = event_ops.needs_extraction(whole, now)
    found = extracted(tables, todo.select("id", "subject", F.col("body_text").alias("body"), "sent_at", "links", "listserv", "organization_id", "organization_name"), locations, extractor)
    stamp = found.select("id", F.col("version").alias("x_version"), F.col("method").alias("x_method"), F.col("is_event").alias("x_event"), F.col("notes").alias("x_notes"))
    whole = whole.join(stamp, "id", "left")
    hit = F.col("x_version").isNotNull()
    for column, new in (("extraction_version", "x_version"), ("extraction_method", "x_method"), ("is_event", "x_event"), ("extraction_notes", "x_notes")):
        whole = whole.withColumn(column, F.when(hit, F.col(new)).otherwise(F.col(column)))
    whole = tables.stage(whole.withColumn("change", F.when(hit, F.coalesce("change", F.lit("update"))).otherwise(F.col("change"))))
    named = incoming.select("id", "recipient_lists")
    reached = reconcile.bridge(whole.join(named, "id").select("id", "canonical_id", "listserv", "recipient_lists"))
    next_bridge = bridge.unionByName(reached).distinct()

    saved = tables.stage(store.save_extraction(events, found, now))
    gone = store.withdraw_merged(saved.drop("change"), whole).select("id", F.col("change").alias("gone"), F.col("status").alias("after"))
    saved = saved.join(gone, "id").withColumn("status", F.col("after")).withColumn("change", F.coalesce("change", "gone")).drop("gone", "after")
    saved = tables.stage(saved.withColumn("created_at", F.coalesce("created_at", now)))
    marked, targets = event_ops_mark(saved.drop("change"), now)
    was = saved.select("id", F.col("status").alias("was"), F.col("change").alias("own"))
    last = store.touch(marked, targets).join(was, "id")
    last = tables.stage(last.withColumn("change", F.when(F.col("status") != F.col("was"), F.lit("update")).otherwise(F.coalesce("own", "change"))).drop("was", "own"))

    top = max(current.agg(F.max("revision")).first()[0] or 0, events.agg(F.max("revision")).first()[0] or 0)
    messages_out = tables.stage(store.with_revisions(whole.select(*current.columns, "change"), top, ["id"]).withColumn("updated_at", F.when(F.col("change").isNotNull(), now).otherwise(F.col("updated_at"))))
    n_messages = messages_out.where("change is not null").count()
    events_out = tables.stage(store.with_revisions(last.select(*events.columns, "change"), top + n_messages, ["id"]).withColumn("updated_at", F.when(F.col("change").isNotNull(), now).otherwise(F.col("updated_at"))))
    n_events = events_out.where("change is not null").count()
    changed = {"messages": messages_out.select(*current.columns), "message_lists": next_bridge} if n_messages else {}
    if n_events:
        changed["events"] = events_out.select(*events.columns)
    if changed:
        tables.commit(changed)
    tables.clear_stage()
    return {"messages": n_messages, "events": n_events}


def extracted(tables: store.Store, messages: DataFrame, locations: DataFrame, extractor: event_ops.Extractor | None) -> DataFrame:
    """What the extractor finds; where it fails, what the rules find, with a note of why."""
    if extractor is not None:
        try:
            return tables.stage(event_ops.extract_with(messages, locations, extractor))
        except Exception as error:
            note = f"extractor failed, rules used: {type(error).__name__}"
            return tables.stage(event_ops.extract(messages, locations).withColumn("notes", F.array_append("notes", F.lit(note))))
    return tables.stage(event_ops.extract(messages, locations))


def event_ops_mark(events: DataFrame, now):
    from ..operators import dedupe

    return dedupe.mark_duplicates(events, now)


def sync_feed(tables: store.Store, items: DataFrame, organizations: DataFrame, locations: DataFrame, as_of: datetime, least: int = 20) -> dict[str, int]:
    """One pull of the official feed into events, then duplicates."""
    now = F.lit(as_of)
    events = tables.read("events", schemas.EVENTS)
    feed = event_ops.with_series(event_ops.without_generic_images(event_ops.map_feed(items, locations, organizations)))
    synced = tables.stage(store.sync_official(events, tables.stage(feed), now, least).withColumn("created_at", F.coalesce("created_at", now)))
    marked, targets = event_ops_mark(synced.drop("change"), now)
    was = synced.select("id", F.col("status").alias("was"), F.col("change").alias("own"))
    last = store.touch(marked, targets).join(was, "id")
    last = tables.stage(last.withColumn("change", F.when(F.col("status") != F.col("was"), F.lit("update")).otherwise(F.coalesce("own", "change"))).drop("was", "own"))
    messages = tables.read("messages", schemas.MESSAGES)
    top = max(messages.agg(F.max("revision")).first()[0] or 0, events.agg(F.max("revision")).first()[0] or 0)
    out = tables.stage(store.with_revisions(last.select(*events.columns, "change"), top, ["id"]).withColumn("updated_at", F.when(F.col("change").isNotNull(), now).otherwise(F.col("updated_at"))))
    counts = {k: out.where(c).count() for k, c in (("changed", "change is not null"), ("withdrawn", "change is not null and status = 'withdrawn'"), ("duplicates", "status = 'duplicate'"))}
    if counts["changed"]:
        tables.write("events", out.select(*events.columns))
    tables.clear_stage()
    return counts


def stream_messages(spark: SparkSession, path: str, tables: store.Store, organizations: DataFrame, locations: DataFrame, checkpoint: str, clock=datetime.utcnow, interval: str | None = None) -> StreamingQuery:
    """Raw messages (JSON lines, schemas.RAW_MESSAGE) that appear under path, ingested batch by batch; with an interval it keeps polling, without one it ends when all is read."""

    def batch(rows: DataFrame, _epoch: int) -> None:
        ingest_batch(tables, rows, organizations, locations, clock())

    writer = spark.readStream.schema(schemas.RAW_MESSAGE).json(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def change_feed(spark: SparkSession, path: str, schema: str, after: int) -> DataFrame:
    """Rows of a change log (Parquet files of one table's changed rows) above a cursor, as a stream; the consumer keeps the largest revision."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("revision") > after)
