"""Events: extraction from messages by rules, mapping of the official feed, series and default images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import dates, fixed, html, text
from . import dims

RULES_VERSION, FEED_VERSION = "rules-1", "mpu-1"


def rlike(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(fixed.ascii_words(pattern)), F.lit(False))


def score(exact: Column, dated: Column, placed: Column, named: Column, eventful: Column, free_food: Column, denied_title: Column, denied_body: Column) -> Column:
    """Points for being an event; all arguments are booleans without nulls. placed: a known or online place; named: any."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    place = F.when(placed, 2).when(named, 1).otherwise(0)
    return points(exact, 2) + points(dated, 1) + place + points(eventful, 1) + points(free_food, 1) - F.when(denied_title, 3).when(denied_body, 1).otherwise(0)


def confidence(points: Column, exact: Column, denied: Column) -> Column:
    value = F.lit(0.35) + points * 0.1 + F.when(exact, 0.1).otherwise(0.0) - F.when(denied, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), value), 2)


def find_places(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """id, place struct (phrase, location, room, online): of each message the first phrase of its body, else of its subject, that is a known place; else a labelled one; else online."""
    sources = messages.select("id", F.posexplode(F.array(F.coalesce("body", F.lit("")), F.coalesce("subject", F.lit("")))).alias("part", "source"))
    phrases = sources.select("id", "part", F.posexplode(text.location_candidates("source")).alias("place", "phrase")).withColumn("key", F.struct("id", "part", "place"))
    known = phrases.join(dims.resolve_locations(phrases.select("key", "phrase"), locations), "key")
    first = known.groupBy("id", "part").agg(F.min_by(F.struct("phrase", "location_id", "location_name", "latitude", "longitude", "room", (F.col("location_id") == fixed.ONLINE_ID).alias("online")), "place").alias("known"))
    online = dict(location_id=F.lit(fixed.ONLINE_ID))
    label = text.location_label("source")
    label_online = rlike(label, fixed.ONLINE) | F.coalesce(label.rlike("(?i)^(?:zoom|online|virtual)"), F.lit(False))
    named = sources.withColumn("label", label).withColumn("label_online", label_online).withColumn("says_online", rlike(F.col("source"), fixed.ONLINE))
    names = locations.where(F.col("id") == fixed.ONLINE_ID).agg(F.min("name").alias("online_name"))
    rows = named.join(first, ["id", "part"], "left").crossJoin(F.broadcast(names))  # one row
    none = F.lit(None).cast("string")
    nowhere = F.lit(None).cast("double")

    def free(phrase: Column, is_online: Column) -> Column:
        return F.struct(
            phrase.alias("phrase"), F.when(is_online, online["location_id"]).alias("location_id"), F.when(is_online, F.col("online_name")).alias("location_name"), nowhere.alias("latitude"), nowhere.alias("longitude"), none.alias("room"), is_online.alias("online")
        )

    chosen = F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("label").isNotNull(), free(F.col("label"), F.col("label_online"))).when(F.col("says_online"), free(F.lit("Online"), F.lit(True)))
    return rows.withColumn("chosen", chosen).groupBy("id").agg(F.min_by("chosen", F.when(F.col("chosen").isNotNull(), F.col("part"))).alias("place"))


def extract(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """id, version, method, is_event, notes, events array of each message (id, subject, body, sent_at, links, listserv, organization_id, organization_name)."""
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    rows = messages.withColumn("when", dates.pick_column(F.col("subject"), F.col("body"), F.col("sent_at"))).join(find_places(messages, locations), "id", "left")
    both = F.concat(subject, F.lit("\n"), body)
    flag = lambda c: F.coalesce(c, F.lit(False))
    free_food = rlike(both, fixed.TAG_RULES["free food"]) | flag(F.col("listserv") == "FREEFOOD")
    exact, dated = flag(F.col("when.exact")), F.col("when.starts_at").isNotNull()
    known = F.col("place.location_id").isNotNull() | flag(F.col("place.online"))
    points = score(exact, dated, known, F.col("place").isNotNull(), rlike(both, fixed.EVENT_WORDS), free_food, rlike(subject, fixed.NOT_EVENT), rlike(F.substring(body, 1, 1500), fixed.NOT_EVENT))
    rows = rows.withColumns({"both": both, "exact": exact, "free_food": free_food, "points": points})
    rows = rows.withColumns({"found": F.col("when.starts_at").isNotNull() & (F.col("points") >= 4), "sure": confidence(F.col("points"), F.col("exact"), rlike(F.col("both"), fixed.NOT_EVENT))})
    is_event, sure = F.col("found"), F.col("sure")
    tags = F.slice(F.array_distinct(F.concat(F.when(F.col("free_food"), F.array(F.lit("free food"))).otherwise(dims.empty_list()), text.tags_from_text("both"))), 1, 4)
    event = F.struct(
        text.clean_title(subject).alias("title"), text.summarize(body).alias("summary"), F.col("when.starts_at").alias("starts_at"), F.col("when.ends_at").alias("ends_at"),
        F.when(F.col("exact"), "exact").otherwise("date").alias("time_precision"), F.col("place.phrase").alias("location_text"), F.col("place.location_id").alias("location_id"), F.col("place.location_name").alias("location_name"),
        F.col("place.latitude").alias("latitude"), F.col("place.longitude").alias("longitude"), F.col("place.room").alias("room"), flag(F.col("place.online")).alias("online"), tags.alias("tags"), F.col("free_food").alias("free_food"),
        F.get(F.filter("links", lambda u: u.rlike("(?i)" + fixed.RSVP_URL)), F.lit(0)).alias("rsvp_url"), F.col("organization_id").alias("host_org_id"), F.col("organization_name").alias("host_org_name"), sure.alias("confidence"),
        (F.col("exact") & F.col("place.phrase").isNotNull() & (sure >= 0.7)).alias("publishable"),
    )
    notes = F.when(F.col("when.starts_at").isNull(), F.array(F.lit("no future date or time found"))).otherwise(dims.empty_list())
    return rows.select("id", F.lit(RULES_VERSION).alias("version"), F.lit("rules").alias("method"), is_event.alias("is_event"), notes.alias("notes"), F.coalesce(F.when(is_event, F.array(event)), F.array().cast(schemas.EXTRACTED)).alias("events"))


Extractor = Callable[[DataFrame], DataFrame]


def extract_with(messages: DataFrame, locations: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """A pluggable extractor (messages in, rows as extract() gives them out), or the rules."""
    return extractor(messages) if extractor else extract(messages, locations)


def validate_extracted(rows: DataFrame, as_of: Column) -> DataFrame:
    """What an outside extractor found, made sound: events without a date or in the past go, sign-up links must be the message's, confidence follows what is known.

    rows: id, links, events (schemas.EXTRACTED).
    """
    def checked(e: Column) -> Column:
        sure = F.lit(0.6) + F.when(e["time_precision"] == "exact", 0.15).otherwise(0.0) + F.when(e["location_id"].isNotNull(), 0.15).when(e["location_text"].isNotNull(), 0.05).otherwise(0.0) + F.when(e["host_org_id"].isNotNull(), 0.05).otherwise(0.0)
        rounded = F.round(sure, 2)
        out = e.withField("rsvp_url", F.when(F.array_contains(F.coalesce("links", dims.empty_list()), e["rsvp_url"]), e["rsvp_url"]))
        return out.withField("confidence", rounded).withField("publishable", (e["time_precision"] == "exact") & e["location_text"].isNotNull() & (rounded >= 0.7))

    sound = F.filter("events", lambda e: e["starts_at"].isNotNull() & (F.coalesce(e["ends_at"], e["starts_at"]) >= as_of))
    return rows.withColumn("events", F.transform(sound, checked))


def needs_extraction(messages: DataFrame, as_of: Column, within_days: int = 45, mode: str = "rules") -> DataFrame:
    """Canonical messages with a whole body, sent lately, whose extraction is missing, of another mode, or older than the body (column changed)."""
    outdated = F.col("extraction_version").isNull() | ~F.col("extraction_version").startswith(mode)
    recent = text.micros(as_of) - text.micros("sent_at") <= within_days * 86_400_000_000
    return messages.where(F.col("canonical_id").isNull() & F.col("complete") & recent & (outdated | F.coalesce(F.col("changed"), F.lit(False))))


# The official feed.


def map_feed(items: DataFrame, locations: DataFrame, organizations: DataFrame) -> DataFrame:
    """Events from feed items (schemas.FEED_ITEM); items without an id or a sound start go."""
    s = lambda *names: F.coalesce(*(F.nullif(text.trim(F.col(f"`{n}`")), F.lit("")) for n in names))
    moment = lambda c: F.try_to_timestamp(c)
    place, kind = s("eventLocation"), F.coalesce(s("locationType"), F.lit(""))
    hidden = place.isNull() | place.rlike("(?i)private location|sign in to display|^tbd$")
    online = kind.rlike("(?i)virtual|online") | F.coalesce(place.rlike("(?i)zoom|virtual|online"), F.lit(False))
    rows = items.select(
        s("eventId").alias("external_id"), moment(s("eventStartDateTime", "start")).alias("starts_at"), moment(s("eventEndDateTime", "end")).alias("ends_raw"), F.when(~hidden, place).alias("location_text"), online.alias("online"),
        F.coalesce(html.html_to_text_column(s("fullDescription", "description")), F.lit("")).alias("description"), F.coalesce(s("eventTopics"), F.lit("")).alias("topics"), F.coalesce(s("title"), F.lit("Untitled event")).alias("title_raw"),
        F.coalesce(s("foodProvided") == "1", F.lit(False)).alias("free_food"), s("groupId").alias("group_id"), s("group").alias("group_name"), F.coalesce(s("allDayEvent") == "1", F.lit(False)).alias("all_day"),
        s("eventLink", "link").alias("external_url"), s("eventPhotoFullUrl", "eventFlyerFullUrl").alias("image_url"), F.coalesce(s("eventDelete") == "1", F.lit(False)).alias("deleted"),
        s("externalRegistrationLink", "eventExternalRegistrationLink", "eventLink").alias("rsvp_url"),
    ).where("external_id is not null and starts_at is not null")
    found = dims.resolve_locations(rows.select(F.col("external_id").alias("key"), F.col("location_text").alias("phrase")).where("phrase is not null").distinct(), locations).withColumnRenamed("key", "external_id")
    online_name = F.broadcast(locations.where(F.col("id") == fixed.ONLINE_ID).agg(F.min("name").alias("online_name")))
    rows = rows.join(found, "external_id", "left").crossJoin(online_name)  # one row
    hosts = organizations.select(F.col("id").alias("host_org_id"), F.col("name").alias("host_name"))
    rows = rows.withColumn("host_org_id", F.concat(F.lit("mpu:"), "group_id")).join(hosts, "host_org_id", "left")
    hours = (text.micros("ends_raw") - text.micros("starts_at")) / 3_600_000_000
    topic_tags = F.create_map(*(F.lit(x) for pair in fixed.TOPIC_TAGS.items() for x in pair))
    topics = F.array_compact(F.transform(F.split("topics", "[,;]"), lambda t: topic_tags[text.trim(t)]))
    tags = F.slice(F.array_distinct(F.concat(F.when(F.col("free_food"), F.array(F.lit("free food"))).otherwise(dims.empty_list()), topics, text.tags_from_text(F.concat("title_raw", F.lit("\n"), "description"), 22))), 1, 4)
    elsewhere = F.col("location_id").isNull() & F.col("online")
    return rows.select(
        text.official_event_id("external_id").alias("id"), F.lit("myprincetonu").alias("source"), F.lit(None).cast("string").alias("message_id"), F.lit(0).alias("idx"), "external_id", "external_url", "image_url",
        F.when(F.col("deleted"), "withdrawn").otherwise("active").alias("status"), F.substring("title_raw", 1, 200).alias("title"), F.substring("description", 1, 1500).alias("summary"), "starts_at",
        F.when(F.col("ends_raw") > F.col("starts_at"), F.col("ends_raw")).alias("ends_at"), F.when(F.col("all_day"), "date").otherwise("exact").alias("time_precision"), "location_text",
        F.when(elsewhere & F.col("online_name").isNotNull(), F.lit(fixed.ONLINE_ID)).otherwise(F.col("location_id")).alias("location_id"), F.when(elsewhere, F.col("online_name")).otherwise(F.col("location_name")).alias("location_name"),
        "latitude", "longitude", "room", "online", tags.alias("tags"), "free_food", "rsvp_url", "host_org_id", F.coalesce("host_name", "group_name").alias("host_org_name"), F.lit(1.0).alias("confidence"),
        (~(F.coalesce(hours, F.lit(0.0)) > 36) & ~F.col("deleted")).alias("publishable"), F.lit(FEED_VERSION).alias("extraction_version"),
    )


def without_generic_images(events: DataFrame, hosts: int = 5) -> DataFrame:
    """Images that several hosts share, or that are named as defaults, become null. Hosts are counted exactly; null is one host."""
    shared = events.where("image_url is not null").groupBy("image_url").agg(F.countDistinct(F.coalesce("host_org_id", F.lit(""))).alias("image_hosts")).where(F.col("image_hosts") >= hosts)
    generic = F.col("image_hosts").isNotNull() | F.col("image_url").rlike(r"(?i)MyPrinceton_\d+x\d+")
    return events.join(shared, "image_url", "left").withColumn("image_url", F.when(~F.coalesce(generic, F.lit(False)), F.col("image_url"))).select(*events.columns)


def with_series(events: DataFrame) -> DataFrame:
    """series_id and series_size of events whose series has more than one."""
    rows = events.drop("series_id", "series_size").withColumn("series_key", text.series_key("host_org_id", "title"))
    size = F.count("*").over(Window.partitionBy("series_key"))
    rows = rows.withColumn("size", size.cast("int"))
    several = F.col("size") > 1
    return rows.withColumn("series_id", F.when(several, F.col("series_key"))).withColumn("series_size", F.when(several, F.col("size"))).drop("series_key", "size")
