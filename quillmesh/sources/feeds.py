"""Sources: archive listings and messages, the official feed, legacy archives, dimensions.

Fetching is the caller's: sources read what lies in files (XML, JSON, HTML),
however it got there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed, html, text

RSS_ITEM = "title string, link string, author string, pubDate string, description string"


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def check_list(name: str) -> str:
    import re

    if not re.fullmatch(r"[A-Z0-9_-]{2,40}", name):
        raise ValueError(f"Invalid list name: {name}")
    return name


def read_xml_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of RSS files, all values as text."""
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(schema).load(path)


def listing(spark: SparkSession, path: str, list_name: str, as_of: Column, limit: int = 300) -> DataFrame:
    """Previews from a list's RSS files, newest `limit` (1 to 50,000). Items without an archive id go; bad dates are as_of.

    Files without items that aren't feeds either (an archive that asks to sign in) are an error.
    """
    check_list(list_name)
    if read_xml_items(spark, path, RSS_ITEM).isEmpty() and spark.read.text(path, wholetext=True).where(F.col("value").rlike("(?i)<rss")).isEmpty():
        raise ValueError(f"{list_name}: archive access unavailable (subscription or owner approval required)")
    return listing_items(read_xml_items(spark, path, RSS_ITEM), list_name, as_of).orderBy(F.desc("sent_at"), "archive_id").limit(clamp(limit, 1, 50_000))


def listing_items(items: DataFrame, list_name: str, as_of: Column) -> DataFrame:
    archive = F.nullif(F.regexp_extract("link", "A2=([^&]+)", 1), F.lit(""))
    who = text.parse_address("author")
    date = F.regexp_replace(text.collapse("pubDate"), r"^[A-Za-z]{3},\s*", "")
    moment = F.coalesce(F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss zzz")), F.try_to_timestamp(F.col("pubDate")), as_of)
    return items.where(archive.isNotNull()).select(
        F.lit(list_name).alias("listserv"), F.url_decode(archive).alias("archive_id"), text.clean_archive_url("link").alias("source_url"), F.coalesce(F.nullif(text.trim("title"), F.lit("")), F.lit("(No subject)")).alias("subject"),
        who["name"].alias("author_name"), who["email"].alias("author_email"), moment.alias("sent_at"), F.lit(None).cast("string").alias("body_html"), F.coalesce("description", F.lit("")).alias("body_text"), F.lit(False).alias("complete"),
    )


def message_pages(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Whole messages from stored pages (source_url, page) and parts (url, content): headers, attachments, and the html part, else the plain one in pre."""
    pattern = r'href="(/cgi-bin/wa\?A3=[^"]+)"[^>]*>([^<]+)</a>'
    urls = F.transform(F.regexp_extract_all("page", F.lit(pattern), F.lit(1)), lambda u: F.concat(F.lit("https://" + fixed.LIST_HOST), F.replace(u, F.lit("&amp;"), F.lit("&"))))
    kinds = F.transform(F.regexp_extract_all("page", F.lit(pattern), F.lit(2)), lambda k: text.trim(k))
    pairs = F.arrays_zip(urls.alias("url"), kinds.alias("type"))
    once = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["url"]), p["url"]) == i + 1)
    rows = pages.select("source_url", html.archive_headers_column("page").alias("headers"), once.alias("attachments"))
    first = lambda kind: F.get(F.filter("attachments", lambda a: a["type"].contains(kind)), F.lit(0))["url"]
    rows = rows.withColumn("html_url", first("text/html")).withColumn("part_url", F.regexp_replace(F.coalesce("html_url", first("text/plain")), "&header=1", ""))
    escaped = F.replace(F.replace(F.replace(F.col("content"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.when(F.col("html_url").isNotNull(), F.col("content")).otherwise(F.concat(F.lit("<pre>"), escaped, F.lit("</pre>")))
    cleaned = F.transform("attachments", lambda a: F.struct(text.clean_archive_url(a["url"]).alias("url"), a["type"].alias("type")))
    return rows.join(parts, F.col("part_url") == F.col("url")).select("source_url", "headers", body.alias("body_html"), cleaned.alias("attachments"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of the official feed, uncoerced."""
    return read_xml_items(spark, path, schemas.FEED_ITEM)


ARCHIVE = (
    "listserv string, messages array<struct<listserv: string, date: string, message_id: string, identity_fields: array<string>, rfc_message_id: string, recipient_lists: array<string>, headers_complete: boolean, listserv_url: string, "
    "subject: string, hoagiemail_sender_name: string, author_name: string, hoagiemail_sender_email: string, author_email: string, body_html: string, body_text: string, body_complete: boolean, is_hoagiemail: boolean>>"
)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages from legacy JSON archives; records without a list, an id or a sound date go. A relay's author wins over the archive's."""
    rows = spark.read.schema(ARCHIVE).json(path, multiLine=True).select(F.col("listserv").alias("file_list"), F.explode("messages").alias("m"))
    text_of = lambda *c: F.coalesce(*(F.nullif(F.col(f"m.{x}"), F.lit("")) for x in c), F.lit(""))
    fields = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get("m.identity_fields", i), F.lit("")))
    headers = F.struct(fields.alias("identity_fields"), F.col("m.rfc_message_id").alias("rfc_message_id"), F.coalesce("m.recipient_lists", F.array().cast("array<string>")).alias("recipient_lists"), F.coalesce("m.headers_complete", F.lit(False)).alias("headers_complete"))
    return rows.select(
        F.upper(F.coalesce(F.nullif(F.col("m.listserv"), F.lit("")), F.col("file_list"), F.lit(""))).alias("listserv"), F.col("m.message_id").alias("archive_id"), F.col("m.listserv_url").alias("source_url"), text_of("subject").alias("subject"),
        text_of("hoagiemail_sender_name", "author_name").alias("author_name"), text_of("hoagiemail_sender_email", "author_email").alias("author_email"), F.try_to_timestamp(F.col("m.date")).alias("sent_at"), F.col("m.body_html").alias("body_html"),
        F.col("m.body_text").alias("body_text"), F.coalesce("m.body_complete", F.lit(False)).alias("complete"), F.when(F.col("m.rfc_message_id").isNotNull(), headers).alias("headers"),
        F.lit(None).cast("array<struct<url: string, type: string>>").alias("attachments"), F.coalesce("m.is_hoagiemail", F.lit(False)).alias("via_hoagie"),
    ).where("listserv <> '' and archive_id <> '' and sent_at is not null")


def unseen(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items (listserv, archive_id) whose message id isn't among the known ids."""
    keyed = items.withColumn("id", text.message_id("listserv", "archive_id"))
    return keyed.join(known.select("id"), "id", "left_anti")


def pending_bodies(messages: DataFrame, as_of: Column, days: int = 14, per_list: int = 25) -> DataFrame:
    """The newest previews of each list that still lack their body."""
    from pyspark.sql.window import Window

    rows = messages.where(~F.col("complete") & F.col("source_url").isNotNull() & (text.micros("sent_at") > text.micros(as_of) - days * 86_400_000_000))
    rank = F.row_number().over(Window.partitionBy("listserv").orderBy(F.desc("sent_at"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_list).drop("rank")


def backoff_seconds(interval: int, failures: int, most: int = 1800) -> int:
    """How long to leave a source alone after failures."""
    return min(most, interval * 2 ** min(failures, 5))


def backoff(failures: str, interval: int, most: int = 1800) -> Column:
    """The same as a column."""
    return F.least(F.lit(most), F.lit(interval) * F.pow(F.lit(2), F.least(F.col(failures), F.lit(5)))).cast("long")


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)
