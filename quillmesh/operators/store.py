"""Snapshots that change by merging: upserts, change detection, withdrawal, and revisions.

Merging makes a table's next version, a Parquet folder of its own. One
writer gives revisions, counting on from the largest: changed rows only are
numbered, in order of their keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Ranges of rows that are numbered apart.
RANGES = 256


def differs(columns: Sequence[str], old: str = "cur", new: str = "upd") -> Column:
    """Whether any column differs, null being equal to null."""
    return ~F.struct(*(F.col(f"{old}.{c}") for c in columns)).eqNullSafe(F.struct(*(F.col(f"{new}.{c}") for c in columns)))


def merge_snapshot(current: DataFrame, updates: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The next snapshot, with `change` (insert, update or null).

    Rows of updates replace those of equal keys if one of the compared columns
    (all, unless given) differs; columns in keep, and those that updates lack,
    stay as they were.
    """
    given = [c for c in updates.columns if c not in keys]
    compare = [c for c in (compare or given) if c not in keep]
    cur, upd = current.withColumn("__here", F.lit(True)).alias("cur"), updates.withColumn("__there", F.lit(True)).alias("upd")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"cur.{k}") == F.col(f"upd.{k}"))
    is_new = F.col("cur.__here").isNull()
    changed = F.col("upd.__there").isNotNull() & (is_new | differs(compare))
    out = []
    for c in current.columns:
        old = F.col(f"cur.{c}")
        if c in keys:
            out.append(F.coalesce(old, F.col(f"upd.{c}")).alias(c))
        elif c in updates.columns:
            out.append(F.when(is_new | (changed & F.lit(c not in keep)), F.col(f"upd.{c}")).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    change = F.when(changed, F.when(is_new, "insert").otherwise("update")).alias("change")
    return cur.join(upd, on, "full").select(*out, change)


def with_revisions(rows: DataFrame, start: int, order: Sequence[str], when: str = "change is not null") -> DataFrame:
    """revision start + 1, start + 2, ... on the rows that changed, in order; the others keep theirs.

    Numbers are counted within ranges and shifted by the sizes of the ranges
    before, so no task sees all changed rows. The ranges' bounds are taken from
    the rows' keys alone: a plan reads the rows more than once, and must find each
    in the same range every time, whatever order or partitions they come in.
    """
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    changed = rows.where(when)
    sample = changed.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h", "k").limit(RANGES * 16)
    bounds = sample.agg(F.sort_array(F.collect_list("k")).alias("s")).select(F.filter("s", lambda k, i: i % 16 == 15).alias("__fine")).withColumn("__coarse", F.filter("__fine", lambda k, i: i % 16 == 15))
    keyed = changed.crossJoin(F.broadcast(bounds)).withColumn("__key", key)  # one row of RANGES bounds at most
    passed = F.size(F.filter("__coarse", lambda b: b <= F.col("__key")))
    part = passed * 16 + F.size(F.filter(F.slice("__fine", passed * 16 + 1, 16), lambda b: b <= F.col("__key")))
    keyed = keyed.withColumn("__part", part).drop("__fine", "__coarse", "__key")
    numbered = keyed.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = keyed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.__part") < F.col("x.__part"), "left").groupBy(F.col("x.__part").alias("__part")).agg(F.coalesce(F.sum("y.__n"), F.lit(0)).alias("__before"))
    numbered = numbered.join(F.broadcast(before), "__part").withColumn("revision", F.col("__own") + F.col("__before") + start).select(*rows.columns)  # a row for each range
    return numbered.unionByName(rows.where(f"not coalesce({when}, false)"))


def upsert_messages(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Messages upserted by id: a whole body is never replaced by a preview, unchanged ones are left, own identity and extraction stay."""
    body = ("body_text", "body_html", "links", "media")
    old = current.select("id", F.col("complete").alias("o_complete"), *(F.col(c).alias("o_" + c) for c in (*body, "rfc_message_id", "delivery_key", "headers_complete")))
    rows = incoming.join(old, "id", "left")
    holds = F.coalesce(F.col("o_complete") & ~F.col("complete"), F.lit(False))
    rows = rows.withColumns(
        {c: F.when(holds, F.col("o_" + c)).otherwise(F.col(c)) for c in body}
        | {"complete": F.col("complete") | holds, "rfc_message_id": F.coalesce("rfc_message_id", "o_rfc_message_id"), "delivery_key": F.coalesce("delivery_key", "o_delivery_key"), "headers_complete": F.coalesce("headers_complete", F.lit(False)) | F.coalesce("o_headers_complete", F.lit(False))}
    ).select(*incoming.columns)
    compare = [c for c in ("classifier_version", "subject", "body_text", "complete", "rfc_message_id", "org_evidence") if c in incoming.columns]
    keep = [c for c in ("listserv", "archive_id", "ingested_at", "canonical_id", "extraction_version", "extraction_method", "is_event", "extraction_notes", "revision") if c in incoming.columns]
    return merge_snapshot(current, rows, ["id"], compare, keep)


OFFICIAL_COMPARED = ("title", "summary", "starts_at", "ends_at", "location_text", "status", "image_url", "publishable", "series_size")


def sync_official(events: DataFrame, feed: DataFrame, as_of: Column, least: int = 20) -> DataFrame:
    """Events after a pull of the official feed: upserts by (source, external_id), and withdrawal of coming ones that the feed no longer has.

    A feed of fewer than `least` items is an error, raised when the plan runs.
    """
    guard = feed.agg(F.count("*").alias("items")).select(F.assert_true(F.col("items") >= least, F.concat(F.lit("the feed has only "), F.col("items"), F.lit(" events; nothing is withdrawn"))).alias("ok"), F.lit(1).alias("one"))
    merged = merge_snapshot(events, feed, ["source", "external_id"], OFFICIAL_COMPARED, keep=["id", "created_at"]).crossJoin(F.broadcast(guard))  # one row
    seen = feed.select(F.lit("myprincetonu").alias("s_source"), F.col("external_id").alias("s_id")).distinct()
    gone = merged.join(seen, (F.col("source") == F.col("s_source")) & (F.col("external_id") == F.col("s_id")), "left")
    lost = (F.col("source") == "myprincetonu") & (F.col("status") == "active") & (text.micros("starts_at") > text.micros(as_of)) & F.col("s_id").isNull() & F.col("ok").isNull()
    return gone.withColumn("change", F.when(lost, F.lit("update")).otherwise(F.col("change"))).withColumn("status", F.when(lost, F.lit("withdrawn")).otherwise(F.col("status"))).select(*events.columns, "change")


def save_extraction(events: DataFrame, extracted: DataFrame, as_of: Column) -> DataFrame:
    """Events after extraction at a time. extracted: id (of the message), version, events.

    Upserts by (message_id, idx); a duplicate stays one, anything else becomes
    active; active ones beyond what was found now are withdrawn.
    """
    new = extracted.select(F.col("id").alias("message_id"), "version", F.posexplode("events").alias("idx", "e")).select(
        text.event_id("message_id", "idx").alias("id"), F.lit("listserv").alias("source"), "message_id", "idx", F.lit("active").alias("status"), "e.*", F.col("version").alias("extraction_version")
    )
    had = events.where("source = 'listserv'").select("message_id", "idx", F.col("status").alias("had"))
    new = new.join(had, ["message_id", "idx"], "left").withColumn("status", F.when(F.col("had") == "duplicate", "duplicate").otherwise("active")).drop("had")
    # Every extraction touches its rows, so all of them count as changed.
    merged = merge_snapshot(events, new.withColumn("updated_at", as_of.cast("timestamp")), ["message_id", "idx"], ["updated_at"], keep=["id", "source", "created_at"])
    found = extracted.select(F.col("id").alias("x_id"), F.size("events").alias("found"))
    rows = merged.join(found, (F.col("message_id") == F.col("x_id")) & (F.col("source") == "listserv"), "left")
    lost = (F.col("status") == "active") & (F.col("idx") >= F.col("found"))
    return rows.withColumn("change", F.when(lost, F.lit("update")).otherwise(F.col("change"))).withColumn("status", F.when(lost, F.lit("withdrawn")).otherwise(F.col("status"))).select(*events.columns, "change")


def withdraw_merged(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Active events of messages that turned out to be copies are withdrawn; `change` tells which."""
    copies = messages.where("canonical_id is not null").select(F.col("id").alias("c_id"))
    rows = events.join(copies, F.col("message_id") == F.col("c_id"), "left")
    lost = F.col("c_id").isNotNull() & (F.col("status") == "active")
    return rows.withColumn("change", F.when(lost, F.lit("update"))).withColumn("status", F.when(lost, F.lit("withdrawn")).otherwise(F.col("status"))).select(*events.columns, "change")


def touch(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """`change` set on the rows whose id is among the targets."""
    hit = targets.select(F.col("id").alias("t_id")).distinct()
    return rows.join(hit, F.col("id") == F.col("t_id"), "left").withColumn("change", F.when(F.col("t_id").isNotNull(), F.lit("update"))).drop("t_id")


def source_health(current: DataFrame, polls: DataFrame) -> DataFrame:
    """sources after polls (listserv, polled_at, error): success clears the count of failures, an error (at most 500 characters) adds one."""
    rows = polls.alias("p").join(current.alias("c"), "listserv", "full")
    ok, polled = F.col("p.error").isNull(), F.col("p.polled_at").isNotNull()
    return rows.select(
        "listserv", F.coalesce("p.polled_at", "c.last_polled_at").alias("last_polled_at"), F.when(polled & ok, F.col("p.polled_at")).otherwise(F.col("c.last_success_at")).alias("last_success_at"),
        F.when(polled, F.substring("p.error", 1, 500)).otherwise(F.col("c.last_error")).alias("last_error"),
        F.when(polled, F.when(ok, 0).otherwise(F.coalesce("c.failures", F.lit(0)) + 1)).otherwise(F.col("c.failures")).cast("int").alias("failures"),
    )


class Store:
    """Versioned Parquet tables in a folder.

    A numbered manifest names the folder of each table; the one of the largest number holds.
    Manifests are written whole under another name and renamed, and none is
    ever deleted or replaced: a writer that dies leaves the tables as they were,
    and several tables change together. One writer at a time; a second one that
    takes the same number is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), uuid.uuid4().hex
        self.fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def manifest(self) -> tuple[int, dict[str, str]]:
        """Its number (0: none yet) and the folder of each table."""
        folder = self._place(f"{self.path}/_manifest")
        if not self.fs.exists(folder):
            return 0, {}
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)
        if not number:
            return 0, {}
        file = self.fs.open(self._place(f"{self.path}/_manifest/{number:012d}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def version(self, table: str) -> int:
        """How often the table was written."""
        return int(self.manifest()[1].get(table, "v0")[1:].split("-")[0])

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        folder = self.manifest()[1].get(table)
        if folder is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{table}/{folder}")

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows written to this writer's staging folder and read again: plans stay small, and lost executors lose nothing."""
        path = f"{self.path}/_staging/{self.run}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_stage(self) -> None:
        self.fs.delete(self._place(f"{self.path}/_staging/{self.run}"), True)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write the next version of some tables, then name them all at once: readers see the old ones or the new ones."""
        number, folders = self.manifest()
        folders = dict(folders)
        for table, rows in tables.items():
            folders[table] = f"v{int(folders.get(table, 'v0')[1:].split('-')[0]) + 1}-{self.run}"
            rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{folders[table]}")
        return self._publish(number + 1, folders)

    def _publish(self, number: int, folders: dict[str, str]) -> int:
        part, whole = self._place(f"{self.path}/_manifest/_{number:012d}-{self.run}.tmp"), self._place(f"{self.path}/_manifest/{number:012d}.json")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self.fs.exists(whole) or not self.fs.rename(part, whole):
            raise RuntimeError(f"another writer has committed {whole}")
        return number

    def write(self, table: str, rows: DataFrame) -> int:
        self.commit({table: rows})
        return self.version(table)
