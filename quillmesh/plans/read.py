"""The read model: searching and reading messages, events, organizations, status, and change feeds, as DataFrames.

Every method returns a plan. Filters that aren't asked for aren't in it.
Pages are bounded as the clamps say; `total` is the number of all matches, also
on a page past the end, and comes from a count of its own (``total_of``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, fts, html, text
from ..operators import classify, dims, events as event_ops
from ..sources.feeds import clamp


@dataclass(frozen=True)
class MessageFilters:
    query: str | None = None
    organization: str | None = None
    sender: str | None = None
    listserv: str = "all"
    since: str | None = None
    until: str | None = None
    limit: int = 20
    offset: int = 0
    sort: str | None = None


@dataclass(frozen=True)
class EventFilters:
    since: str | None = None
    until: str | None = None
    organization: str | None = None
    tag: str | None = None
    query: str | None = None
    publishable_only: bool = False
    limit: int = 50
    offset: int = 0


def day_after(moment: str, zone: str) -> Column:
    """The end of an inclusive end day: its date or time, in the zone, and a day more."""
    return F.to_utc_timestamp(F.lit(moment).cast("timestamp_ntz").cast("timestamp"), zone) + F.expr("INTERVAL 1 DAY")


def since(moment: str, zone: str) -> Column:
    return F.to_utc_timestamp(F.lit(moment).cast("timestamp_ntz").cast("timestamp"), zone)


def list_filter(rows: DataFrame, bridge: DataFrame, key: str, name: str) -> DataFrame:
    """Rows that reached the list; ALL is no filter, RESIDENTIAL any residential list."""
    name = name.upper()
    if name == "ALL":
        return rows
    wanted = text.is_residential("listserv") if name == "RESIDENTIAL" else F.col("listserv") == name
    members = bridge.where(wanted).select(F.col("message_id").alias("__member")).distinct()
    return rows.join(members, rows[key] == F.col("__member"), "left_semi")


def lists_of(bridge: DataFrame) -> DataFrame:
    """message_id, lists: sorted lists of each message."""
    return bridge.groupBy("message_id").agg(F.sort_array(F.collect_list("listserv")).alias("lists"))


def organization_payload(organizations: DataFrame, logos: DataFrame | None = None, origin: str = "") -> DataFrame:
    """The public fields of organizations; acronyms only where written as such, only social links that are there."""
    social = F.create_map(*(x for k in ("instagram", "facebook", "linkedin", "twitter", "youtube") for x in (F.lit(k), F.col(f"profile.{k}"))))
    club = F.regexp_extract("id", r"^mpu:(\d+)$", 1)
    rows = organizations.join(logos.select(F.col("id").alias("logo_id"), F.regexp_replace("src", "^/", "").alias("logo_path"), F.col("source_url").alias("logo_source")), F.col("id") == F.col("logo_id"), "left") if logos is not None else organizations.withColumns({"logo_path": F.lit(None).cast("string"), "logo_source": F.lit(None).cast("string")})
    return rows.select(
        "id", "name", "aliases", "group_type", "categories", text.forum_category("group_type", "categories").alias("forum_category"),
        F.when(F.col("profile.acronym").rlike("^[A-Z][A-Z0-9&-]{1,11}$"), F.col("profile.acronym")).alias("acronym"), F.col("profile.tagline").alias("tagline"), F.col("profile.description").alias("description"),
        F.col("profile.whatWeDo").alias("what_we_do"), F.col("profile.website").alias("website"), F.col("profile.email").alias("contact_email"), F.map_filter(social, lambda k, v: v.isNotNull()).alias("socials"),
        F.col("profile.memberCount").alias("member_count"), F.col("urls").alias("websites"),
        F.when(club != "", F.concat(F.lit("https://my.princeton.edu/feeds?type=club&type_id="), club, F.lit("&tab=about"))).alias("group_url"),
        F.when(F.col("logo_path").isNotNull(), F.concat(F.lit(origin + "/"), "logo_path")).alias("logo_url"), F.col("logo_source").alias("logo_source_url"),
    )


class Engine:
    """Queries over one snapshot of the tables (schemas.MESSAGES, MESSAGE_LISTS, EVENTS, SOURCES, ORGANIZATIONS)."""

    def __init__(self, messages: DataFrame, bridge: DataFrame, events: DataFrame, organizations: DataFrame, sources: DataFrame | None = None, locations: DataFrame | None = None, logos: DataFrame | None = None, origin: str = "", zone: str = fixed.TIME_ZONE, postings: DataFrame | None = None):
        """postings: of the messages (fts.postings); with them search reads no text."""
        self.postings = postings
        self.messages, self.bridge, self.events, self.organizations = messages, bridge, events, organizations
        self.sources, self.locations, self.logos, self.origin, self.zone = sources, locations, logos, origin.rstrip("/"), zone

    # Messages.

    def _summary(self, rows: DataFrame, *more) -> DataFrame:
        """rows need `lists`; further columns follow."""
        return rows.select(
            "id", "subject", F.col("sender_name").alias("sender"), F.coalesce("sender_email", F.lit("")).alias("sender_email"), "sent_at", F.coalesce("lists", F.array("listserv")).alias("listservs"),
            F.when(F.col("organization_id").isNotNull(), F.struct(F.col("organization_id").alias("id"), F.col("organization_name").alias("name"))).alias("organization"), "category", F.coalesce("preview", F.lit("")).alias("preview"),
            F.coalesce("complete", F.lit(False)).alias("complete"), "is_event", F.concat(F.lit(self.origin + "/email/"), "id").alias("url"), F.col("source_url").alias("archive_url"), "revision", *more,
        )

    def _organization_id(self, value: str) -> DataFrame:
        """One row or none: the id itself, else the first directory hit."""
        by_id = self.organizations.where(F.col("id") == value).select("id", F.lit(1).alias("order"))
        by_search = dims.search_directory(self.organizations, value).agg(F.min("id").alias("id")).where("id is not null").select("id", F.lit(2).alias("order"))
        return by_id.unionByName(by_search).agg(F.min_by("id", "order").alias("org_key")).where("org_key is not null")

    def matching_messages(self, f: MessageFilters) -> DataFrame:
        """All messages that meet the filters, with `rank`."""
        rows = self.messages.where("canonical_id is null")
        if f.since:
            rows = rows.where(F.col("sent_at") >= since(f.since, self.zone))
        if f.until:
            rows = rows.where(F.col("sent_at") < day_after(f.until, self.zone))
        if f.sender:
            like = f"%{f.sender}%"  # % and _ in it are wildcards
            rows = rows.where(F.col("sender_name").ilike(like) | F.col("sender_email").ilike(like))
        if f.organization:
            rows = rows.join(F.broadcast(self._organization_id(f.organization)), F.col("organization_id") == F.col("org_key"), "left_semi")
        rows = list_filter(rows, self.bridge, "id", f.listserv)
        query = (f.query or "").strip()
        if not query:
            return rows.withColumn("rank", F.lit(0.0))
        if self.postings is not None:
            return rows.join(fts.search(self.postings, query, self.messages), "id")
        found = fts.evaluate_column(F.col("subject"), F.concat_ws(" ", "sender_name", "organization_name"), F.col("body_text"), query)
        return rows.withColumn("found", found).where("found.matches").withColumn("rank", F.col("found.rank")).drop("found")

    def search_messages(self, f: MessageFilters = MessageFilters()) -> DataFrame:
        order = [F.asc("sent_at")] if f.sort == "oldest" else [F.desc("rank"), F.desc("sent_at")] if (f.query or "").strip() and f.sort != "newest" else [F.desc("sent_at")]
        page = self.matching_messages(f).orderBy(*order, "id").offset(clamp(f.offset, 0, 5000)).limit(clamp(f.limit, 1, 100))
        rows = page.join(lists_of(self.bridge), F.col("id") == F.col("message_id"), "left")
        return self._summary(rows, "rank").orderBy(*order, "id")

    def total_of(self, f: MessageFilters | EventFilters, of_page: bool = False) -> DataFrame:
        """One row: total. of_page: 0 where the page that is asked for lies past the end."""
        rows = self.matching_messages(f) if isinstance(f, MessageFilters) else self.matching_events(f)
        total = rows.agg(F.count("*").alias("total"))
        return total.select(F.when(F.col("total") > clamp(f.offset, 0, 5000), F.col("total")).otherwise(F.lit(0).cast("long")).alias("total")) if of_page else total

    def read_messages(self, ids: list[str], offset: int = 0, length: int = 12_000) -> DataFrame:
        """Canonical messages of at most five ids, in the order asked for, with a stretch of their body."""
        asked = self.messages.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids[:5])], "asked string, place int")
        target = self.messages.join(F.broadcast(asked), F.col("id") == F.col("asked")).groupBy(F.coalesce("canonical_id", "id").alias("target")).agg(F.min("place").alias("place"))  # at most five rows
        rows = self.messages.join(F.broadcast(target), F.col("id") == F.col("target")).join(lists_of(self.bridge), F.col("id") == F.col("message_id"), "left")
        body = F.coalesce("body_text", F.lit(""))
        end = offset + length
        return self._summary(
            rows, F.substring(body, offset + 1, length).alias("body"), F.length(body).alias("body_length"), F.when(F.length(body) > end, F.lit(end)).alias("next_offset"), F.coalesce("links", dims.empty_list()).alias("links"), "media",
            F.coalesce("org_evidence.evidence", dims.empty_list()).alias("organization_evidence"), "place",
        ).orderBy("place").drop("place")

    def message_changes(self, after: int, limit: int = 200) -> DataFrame:
        """Messages of revisions above `after`, copies too, in order; the largest revision is the next cursor."""
        rows = self.messages.where(F.col("revision") > after).orderBy("revision").limit(min(limit, 1000))
        rows = rows.join(lists_of(self.bridge), F.coalesce("canonical_id", "id") == F.col("message_id"), "left")
        return self._summary(
            rows, "canonical_id", F.coalesce("body_text", F.lit("")).alias("body_text"), "body_html", "links", "media", "rfc_message_id", "delivery_key", F.coalesce("headers_complete", F.lit(False)).alias("headers_complete"), "via",
            "sender_attribution", F.col("org_confidence").alias("organization_confidence"), F.coalesce("org_evidence.evidence", dims.empty_list()).alias("organization_evidence"), "classifier_version",
        ).orderBy("revision")

    # Events.

    def matching_events(self, f: EventFilters, as_of: datetime | None = None) -> DataFrame:
        start = since(f.since, self.zone) if f.since else (F.current_timestamp() if as_of is None else F.lit(as_of)) - F.expr("INTERVAL 3 HOURS")
        rows = self.events.where((F.col("status") == "active") & (F.coalesce("ends_at", "starts_at") >= start))
        if f.until:
            rows = rows.where(F.col("starts_at") < day_after(f.until, self.zone))
        if f.organization:
            rows = rows.join(F.broadcast(self._organization_id(f.organization)), F.col("host_org_id") == F.col("org_key"), "left_semi")
        if f.tag:
            rows = rows.where(F.array_contains("tags", f.tag))
        if f.query:
            like = f"%{f.query}%"
            rows = rows.where(F.col("title").ilike(like) | F.col("summary").ilike(like) | F.coalesce(F.col("host_org_name").ilike(like), F.lit(False)))
        return rows.where("publishable") if f.publishable_only else rows

    def event_payload(self, rows: DataFrame) -> DataFrame:
        """Events with place, host, announcements, series and source. What repeats of an event say is aggregated once, by the event they repeat."""
        m = self.messages.select(F.col("id").alias("m_id"), F.col("subject").alias("m_subject"), F.col("sender_name").alias("m_sender"), F.col("sent_at").alias("m_sent"), F.col("source_url").alias("m_source"))
        lists = lists_of(self.bridge).withColumnRenamed("message_id", "l_id")
        repeats = self.events.where("duplicate_of is not null").select("duplicate_of", "message_id", F.col("id").alias("r_id")).join(rows.select(F.col("id").alias("e_id")), F.col("duplicate_of") == F.col("e_id"), "left_semi")
        repeats = repeats.join(m, F.col("message_id") == F.col("m_id"), "left").join(lists, F.col("message_id") == F.col("l_id"), "left")
        repeats = repeats.groupBy(F.col("duplicate_of").alias("d_id")).agg(F.count("*").alias("repeat_count"), F.flatten(F.collect_list(F.coalesce("lists", dims.empty_list()))).alias("repeat_lists"), F.min("m_sent").alias("repeat_first"))
        hosts = organization_payload(self.organizations, self.logos, self.origin)
        hosts = hosts.select(F.col("id").alias("h_id"), F.struct(*hosts.columns).alias("h"))
        e = rows.join(m, F.col("message_id") == F.col("m_id"), "left").join(lists, F.col("message_id") == F.col("l_id"), "left").join(repeats, F.col("id") == F.col("d_id"), "left").join(hosts, F.col("host_org_id") == F.col("h_id"), "left")
        own = F.coalesce("lists", dims.empty_list())
        official = F.col("source") == "myprincetonu"
        unknown = F.from_json(F.to_json(F.struct(F.col("host_org_id").alias("id"), F.coalesce("host_org_name", "host_org_id").alias("name"))), hosts.schema["h"].dataType)
        return e.select(
            "id", "status", "title", F.coalesce("summary", F.lit("")).alias("summary"), "starts_at", "ends_at", "time_precision",
            F.struct(F.col("location_text").alias("text"), F.col("location_id").alias("id"), F.col("location_name").alias("name"), "latitude", "longitude", "room", F.coalesce("online", F.lit(False)).alias("online")).alias("location"),
            F.coalesce("tags", dims.empty_list()).alias("tags"), F.coalesce("free_food", F.lit(False)).alias("free_food"), "rsvp_url", F.when(F.col("host_org_id").isNotNull(), F.coalesce("h", unknown)).alias("host"), "confidence",
            F.coalesce("publishable", F.lit(False)).alias("publishable"), "extraction_version", "image_url",
            F.struct(
                (F.when(F.col("source") == "listserv", 1).otherwise(0) + F.coalesce("repeat_count", F.lit(0))).alias("emails"), F.array_sort(F.array_union(own, F.coalesce("repeat_lists", dims.empty_list()))).alias("listservs"),
                F.least("m_sent", "repeat_first").alias("first_announced_at"),
            ).alias("announcements"),
            F.when(F.col("series_id").isNotNull(), F.struct(F.col("series_id").alias("id"), F.col("series_size").alias("size"))).alias("series"), "duplicate_of",
            F.struct(
                F.col("source").alias("kind"), F.when(~official, F.col("message_id")).alias("message_id"), F.when(~official, F.coalesce("m_subject", F.lit(""))).alias("subject"),
                F.when(official, F.col("host_org_name")).otherwise(F.coalesce("m_sender", F.lit(""))).alias("sender"), F.when(~official, F.col("m_sent")).alias("sent_at"), F.when(official, dims.empty_list()).otherwise(own).alias("listservs"),
                F.when(official, F.col("external_url")).otherwise(F.concat(F.lit(self.origin + "/email/"), "message_id")).alias("url"), F.when(~official, F.col("m_source")).alias("archive_url"),
            ).alias("source"),
            "updated_at", "revision",
        )

    def list_events(self, f: EventFilters = EventFilters(), as_of: datetime | None = None) -> DataFrame:
        page = self.matching_events(f, as_of).orderBy("starts_at", "id").offset(clamp(f.offset, 0, 5000)).limit(clamp(f.limit, 1, 200))
        return self.event_payload(page).orderBy("starts_at", "id")

    def get_event(self, event_id: str) -> DataFrame:
        return self.event_payload(self.events.where(F.col("id") == event_id))

    def event_changes(self, after: int, limit: int = 200) -> DataFrame:
        return self.event_payload(self.events.where(F.col("revision") > after).orderBy("revision").limit(min(limit, 1000))).orderBy("revision")

    # Organizations and status.

    def search_organizations(self, query: str = "", limit: int = 20) -> DataFrame:
        """Directory hits with the number of canonical messages of each."""
        hits = dims.search_directory(self.organizations, query).orderBy("id").limit(min(limit, 1000))
        counts = self.messages.where("canonical_id is null and organization_id is not null").groupBy(F.col("organization_id").alias("o_id")).agg(F.count("*").alias("n"))
        rows = organization_payload(hits, self.logos, self.origin).join(counts, F.col("id") == F.col("o_id"), "left")
        return rows.withColumn("email_count", F.coalesce("n", F.lit(0))).drop("o_id", "n")

    def status(self, as_of: datetime) -> DataFrame:
        """One row of counts over messages and events."""
        canonical = F.col("canonical_id").isNull()
        m = self.messages.agg(
            F.count_if(canonical).alias("messages"), F.count("*").alias("copies"), F.count_if(F.col("complete") & canonical).alias("full_bodies"), F.min("sent_at").alias("earliest"), F.max("sent_at").alias("latest"),
            F.max("ingested_at").alias("last_ingested"),
        )
        active, coming = F.col("status") == "active", F.col("starts_at") >= F.lit(as_of)
        e = self.events.agg(
            F.count_if(active).alias("active"), F.count_if(active & coming).alias("upcoming"), F.count_if(active & coming & F.col("publishable")).alias("upcoming_publishable"),
            F.count_if(active & coming & (F.col("source") == "myprincetonu")).alias("upcoming_official"), F.count_if(F.col("status") == "duplicate").alias("duplicates_of_official"),
        )
        o = self.organizations.agg(F.count("*").alias("organizations"))
        return m.crossJoin(e).crossJoin(o)  # one row each

    def source_status(self) -> DataFrame:
        return self.sources.withColumn("residential", text.is_residential("listserv")).orderBy("listserv")

    def analyze(self, emails: DataFrame, as_of: datetime) -> DataFrame:
        """What the engine makes of messages that it doesn't keep. emails: id, subject, body, body_html, sender_name, sender_email, listserv, sent_at (null: as_of)."""
        return analyze(emails, self.organizations, self.locations, as_of)


def analyze(emails: DataFrame, organizations: DataFrame, locations: DataFrame, as_of: datetime) -> DataFrame:
    rows = emails.select(
        "id", F.coalesce("subject", F.lit("")).alias("subject"), html.readable_text_column(F.col("body"), F.col("body_html")).alias("body"),
        html.sender_column(F.col("sender_name"), F.col("sender_email"), F.col("body"), F.col("body_html"), F.lit(False)).alias("author"), "listserv", F.coalesce("sent_at", F.lit(as_of)).alias("sent_at"), text.extract_links("body_html").alias("links"),
    )
    kinds = classify.classify(rows.select("id", "subject", "body", F.col("author.name").alias("sender"), F.col("author.email").alias("sender_email"), "listserv"), organizations)
    full = rows.join(kinds, "id")
    found = event_ops.extract(full.select("id", "subject", "body", "sent_at", "links", "listserv", "organization_id", F.when(F.col("organization_id").isNotNull(), F.col("organization")).alias("organization_name")), locations)
    return full.join(found.withColumnRenamed("version", "extraction_version"), "id")


__all__ = ["Engine", "EventFilters", "MessageFilters", "analyze", "day_after", "list_filter", "lists_of", "organization_payload", "replace", "since"]
