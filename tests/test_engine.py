import json
from datetime import datetime, timedelta

import data
import pytest
from pyspark.sql import functions as F

from quillmesh import schemas
from quillmesh.functions import dates
from quillmesh.operators import band, classify, dedupe, dims, events, reconcile, store
from quillmesh.plans import catalog, constructed, read
from quillmesh.sources import feeds
from quillmesh.streaming import ingest, poll

SENT = datetime(2026, 9, 28, 14)


def classified(spark, **given):
    row = {"id": "1", "subject": "", "body": "", "sender": "Student", "sender_email": "", "listserv": "WHITMANWIRE"} | given
    return classify.classify(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)), data.organizations(spark)).first()


def test_registry(spark):
    orgs = {r.id: r for r in data.organizations(spark).collect()}
    assert orgs["mpu:2"].name == "Twin Name (Student organization)" and orgs["mpu:3"].name == "Twin Name (Campus Rec)"
    assert "Princeton University Players" in orgs["mpu:4"].aliases and "OrangeHat" in orgs["mpu:71474"].aliases
    assert orgs["plaintext"].group_type == "Student organization" and not orgs["mpu:70043"].url_subdomains
    assert [r.id for r in dims.find_organization(data.organizations(spark), "orangehat").collect()] == ["mpu:71474"]
    assert {r.id for r in dims.search_directory(data.organizations(spark), "twin").collect()} == {"mpu:2", "mpu:3"}
    with pytest.raises(Exception, match="needs a name"):
        dims.registry(spark.createDataFrame([], schemas.DIRECTORY), spark.createDataFrame([("x", None, None, None, None, None, None, None)], schemas.OVERRIDES)).collect()


def test_classifier(spark):
    row = classified(spark, subject="[OrangeHat] Mini-CTF", sender="Orangehat Cybersecurity Collective")
    assert row.organization_id == "mpu:71474" and row.confidence == "high"
    row = classified(spark, subject="Selling my desk", body="Pick up at Butler")
    assert row.organization == "Campus community" and row.organization_id is None and row.evidence == ["No directory match"]
    assert classified(spark, sender="HoagieMail").organization_id is None
    assert classified(spark, sender_email="ChessCircle@princeton.edu").organization_id == "mpu:1"
    assert classified(spark, body="see https://wintersession.campusapps.org/course/123").organization_id is None
    assert classified(spark, body="see https://campusapps.org/.").organization_id == "mpu:70043"
    assert classified(spark, body="https://my.princeton.edu/feeds?club_id=52941").organization_id == "mpu:52941"
    assert classified(spark, subject="plaintext kickoff meeting", sender="plaintext").organization_id == "plaintext"
    assert classified(spark, listserv="FREEFOOD").category == "Free food"


def test_locations(spark):
    phrases = ["McCosh 50", "Frist MPR", "the E-Quad", "Zoom", "somewhere nice", "TI", "we may ti one or another", "Friend Center 000"]
    rows = spark.createDataFrame([(p, p) for p in phrases], "key string, phrase string")
    got = {r.key: (r.location_id, r.room) for r in dims.resolve_locations(rows, data.locations(spark)).collect()}
    assert got == {"McCosh 50": ("mccosh-hall", "50"), "Frist MPR": ("frist-campus-center", None), "the E-Quad": ("engineering-quadrangle", None), "Zoom": ("online", None), "TI": ("tiger-inn", None), "Friend Center 000": ("friend-center", None)}


def test_gazetteer(spark):
    pois = spark.createDataFrame([(1, "Blair", "Blair Hall", "c", "university", 40.1234567, -74.0, None), (2, "Ivy", None, "c", "building", 40.0, -74.0, None), (3, "Shed", None, "c", "building", 40.0, -74.0, None), (4, "#12", None, "c", "library", 0.0, 0.0, None)], schemas.POIS)
    got = {r.id: r for r in dims.locations_from_pois(pois).collect()}
    assert set(got) == {"blair-hall", "ivy"} and got["ivy"].name == "Ivy Club" and got["blair-hall"].aliases == ["Blair"] and got["blair-hall"].latitude == 40.123457
    overrides = spark.createDataFrame([("ivy", None, None, None, True), ("blair-hall", "Blair", None, ["Arch"], False)], schemas.LOCATION_OVERRIDES)
    rows = dims.gazetteer(dims.locations_from_pois(pois), overrides, data.locations(spark)).collect()
    assert "ivy" not in {r.id for r in rows} and next(r for r in rows if r.id == "blair-hall").aliases == ["Blair", "Arch", "Blair Hall"]


def extracted(spark, subject, body, sent=SENT, listserv="WHITMANWIRE"):
    rows = spark.createDataFrame([("1", subject, body, sent, ["https://forms.gle/x"], listserv, None, None)], "id string, subject string, body string, sent_at timestamp, links array<string>, listserv string, organization_id string, organization_name string")
    return events.extract(rows, data.locations(spark)).first()


def test_extraction(spark):
    row = extracted(spark, "Talk: The Future of AI", "When: Wednesday 4:30-6pm\nWhere: McCosh 50\nSpeaker: Prof. X")
    e = row.events[0]
    assert row.is_event and e.publishable and e.starts_at == datetime(2026, 9, 30, 20, 30) and e.ends_at == datetime(2026, 9, 30, 22, 0) and e.location_id == "mccosh-hall" and e.room == "50" and e.rsvp_url
    e = extracted(spark, "This Monday 5:30 - Dinner and conversation", "Join us in Whitman College for dinner.", datetime(2026, 9, 27, 14)).events[0]
    assert e.starts_at == datetime(2026, 9, 28, 21, 30) and e.location_id == "whitman-college"
    for subject, body in (("Selling my desk", "Pick up at Butler tomorrow at 5pm"), ("DUE IN 24 HOURS: Apply to the program", "apply now"), ("[APPLY] Business Today", "Applications due 11:59 pm tonight")):
        assert not extracted(spark, subject, body).is_event


def test_dates():
    assert dates.pick("", "noon on Oct 3", SENT)[0].replace(tzinfo=None) == datetime(2026, 10, 3, 16)
    assert dates.pick("", "Jan 5 at 8pm", SENT)[0].replace(tzinfo=None) == datetime(2027, 1, 6, 1)
    assert dates.pick("", "13/45 at 99:99", SENT) is None and dates.pick(None, None, SENT) is None


ITEM = dict.fromkeys([c.split()[0].strip("`") for c in schemas.FEED_ITEM.split(", ")])


def feed(spark, *items):
    return spark.createDataFrame([tuple((ITEM | i).values()) for i in items], schemas.FEED_ITEM)


def test_feed(spark):
    items = feed(
        spark,
        {"eventId": "1", "title": "Dinner", "groupId": "52941", "eventStartDateTime": "2026-09-28T19:30:00-04:00", "eventEndDateTime": "2026-09-28T20:30:00-04:00", "eventLocation": "Friend Center 101", "foodProvided": "1", "eventTopics": "Networking; Social"},
        {"eventId": "2", "title": "Interest list", "start": "2026-06-01T00:00:00Z", "end": "2026-12-31T00:00:00Z", "eventLocation": "Private Location (sign in to display)"}, {"eventId": "3", "start": "never"}, {"title": "no id", "start": "2026-06-01T00:00:00Z"},
    )
    got = {r.external_id: r for r in events.map_feed(items, data.locations(spark), data.organizations(spark)).collect()}
    assert set(got) == {"1", "2"} and not got["2"].publishable and got["2"].location_text is None
    one = got["1"]
    assert one.host_org_id == "mpu:52941" and one.host_org_name == "ACM" and one.location_id == "friend-center" and one.room == "101" and one.free_food and one.publishable and one.tags[:3] == ["free food", "career", "social event"]


def test_generic_images_and_series(spark):
    rows = spark.createDataFrame([(f"h{i}", "same", "Weekly chess") for i in range(5)] + [("h1", "own", "Weekly chess 2"), (None, None, "x")], "host_org_id string, image_url string, title string")
    got = events.with_series(events.without_generic_images(rows)).collect()
    assert {r.image_url for r in got} == {None, "own"} and sorted(r.series_size or 0 for r in got) == [0] * 5 + [2, 2]


def test_band_join_bounds(spark):
    t = datetime(2026, 1, 1)
    a = spark.createDataFrame([(1, t)], "a int, ta timestamp")
    b = spark.createDataFrame([(k, t + timedelta(microseconds=us)) for k, us in enumerate((-120_000_001, -120_000_000, 0, 120_000_000, 120_000_001))], "b int, tb timestamp")
    assert sorted(r.b for r in band.band_join(a, b, "ta", "tb", 120).collect()) == [1, 2, 3]


def event_rows(spark, *rows):
    base = dict.fromkeys([c.split(" ")[0] for c in schemas.EVENTS.split(", ")])
    full = [base | {"source": "listserv", "status": "active", "idx": 0, "message_id": r["id"], "created_at": SENT, "starts_at": SENT + timedelta(days=1)} | r for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], schemas.EVENTS)


def test_duplicates(spark):
    day = SENT + timedelta(days=1)
    rows = event_rows(
        spark,
        {"id": "o", "source": "myprincetonu", "external_id": "o", "title": "Chess night finals", "host_org_id": "mpu:1"}, {"id": "l1", "title": "Chess night", "starts_at": day + timedelta(minutes=45)}, {"id": "l2", "title": "Other thing entirely", "host_org_id": "mpu:1", "starts_at": day - timedelta(minutes=45)},
        {"id": "l3", "title": "Chess night finals", "starts_at": day + timedelta(minutes=46), "created_at": SENT - timedelta(days=3)},
        {"id": "r1", "title": "Free boba party", "created_at": SENT, "starts_at": day + timedelta(hours=5)}, {"id": "r2", "title": "Reminder free boba party", "created_at": SENT + timedelta(hours=1), "starts_at": day + timedelta(hours=5, minutes=20)},
        {"id": "r3", "title": "free boba party again", "created_at": SENT + timedelta(hours=2), "starts_at": day + timedelta(hours=5, minutes=40)}, {"id": "old", "title": "Free boba party", "starts_at": SENT - timedelta(days=40)},
    )
    marked, targets = dedupe.mark_duplicates(rows, F.lit(SENT))
    got = {r.id: r.duplicate_of for r in marked.where("status = 'duplicate'").collect()}
    assert got == {"l1": "o", "l2": "o", "r2": "r1"}  # r3 is too far from r1, and r2 isn't a root
    assert {r.id for r in targets.collect()} == {"o", "r1"}


def copies(spark, *rows):
    return spark.createDataFrame([(i, l, rfc, key, SENT + timedelta(seconds=s), SENT + timedelta(seconds=k), None) for k, (i, l, rfc, key, s) in enumerate(rows)], "id string, listserv string, rfc_message_id string, delivery_key string, sent_at timestamp, ingested_at timestamp, canonical_id string")


def test_reconcile_in_order_of_arrival(spark):
    rows = copies(
        spark,
        ("a", "WHITMANWIRE", None, "k", 0), ("b", "BUTLERBUZZ", None, "k", 100), ("c", "ROCKYWIRE", None, "k", 200),  # a chain: a and c are apart
        ("d", "FREEFOOD", "r", None, 0), ("e", "HUOHUB", "r", None, 900), ("f", "FREEFOOD", "r", None, 1),  # a list that isn't residential never merges itself
        ("g", "HUOHUB", "s", None, 0), ("h", "HUOHUB", "s", None, 0), ("i", "HUOHUB", None, None, 0), ("j", "WHITMANWIRE", None, "m", 0), ("k", "BUTLERBUZZ", None, "m", 121),
    )
    got = {r.id: r.canonical_id for r in reconcile.reconcile(rows).collect()}
    assert got == {"a": None, "b": "a", "c": "a", "d": None, "e": "d", "f": None, "g": None, "h": None, "i": None, "j": None, "k": None}
    assert {r.id: r.match_id for r in reconcile.first_matches(rows).collect()}["b"] == "a"


def test_q_reconcile_replays_all_events(spark, sf, monkeypatch):
    """The registered query against a sequential replay of all events, by message id and by key."""
    got = {r.id: r.canonical_id for r in constructed.q_reconcile(spark, sf).collect()}
    with monkeypatch.context() as m:
        m.setattr(constructed.reconcile, "reconcile", lambda rows: rows)
        rows = sorted(constructed.q_reconcile(spark, sf).collect(), key=lambda r: (r.ingested_at, r.id))
    arrived, canonical, by_id_alone = [], {}, 0
    for me in rows:
        canonical[me.id] = None
        for other in arrived:
            same = me.rfc_message_id is not None and me.rfc_message_id == other.rfc_message_id
            near = me.delivery_key == other.delivery_key and abs((me.sent_at - other.sent_at).total_seconds()) <= 120
            if me.listserv != other.listserv and (same or near):
                canonical[me.id] = canonical[other.id] or other.id
                by_id_alone += not near
                break
        arrived.append(me)
    assert got == canonical and len(got) == spark.read.parquet(f"{sf}/events.parquet").count() and by_id_alone


def raw(spark, *rows):
    base = {"listserv": "FREEFOOD", "archive_id": "x", "source_url": None, "subject": "s", "author_name": "Pat", "author_email": "pat@princeton.edu", "sent_at": SENT, "body_html": None, "body_text": None, "complete": True, "headers": None, "attachments": None, "via_hoagie": False}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schemas.RAW_MESSAGE)


NOW = datetime(2026, 9, 28, 15)
DINNER = {"subject": "Dinner talk tomorrow 6pm", "body_html": "<p>Join us for a talk tomorrow at 6pm in Frist MPR. Free dinner!</p>"}


def test_cross_posts_merge_and_extract_once(spark, tmp_path):
    tables, orgs, places = store.Store(spark, str(tmp_path / "t")), data.organizations(spark), data.locations(spark)
    headers = (["A <a@x.edu>", "", "Dinner", "2026-09-28T14:00:00.000Z"], "x1@princeton.edu", ["WHITMANWIRE", "BUTLERBUZZ"], True)
    first = raw(spark, {"listserv": "WHITMANWIRE", "archive_id": "w1", "headers": headers, **DINNER})
    second = raw(spark, {"listserv": "BUTLERBUZZ", "archive_id": "b1", "headers": headers, **DINNER})
    ingest.ingest_batch(tables, first, orgs, places, NOW)
    ingest.ingest_batch(tables, second, orgs, places, NOW + timedelta(minutes=1))
    messages = {r.archive_id: r for r in tables.read("messages").collect()}
    assert messages["b1"].canonical_id == messages["w1"].id and messages["w1"].canonical_id is None
    active = tables.read("events").where("status = 'active'").collect()
    assert len(active) == 1 and active[0].location_id == "frist-campus-center" and active[0].message_id == messages["w1"].id
    lists = tables.read("message_lists").where(F.col("message_id") == messages["w1"].id).collect()
    assert sorted(r.listserv for r in lists) == ["BUTLERBUZZ", "WHITMANWIRE"]
    # A preview doesn't replace the body, and doing it again changes nothing.
    ingest.ingest_batch(tables, raw(spark, {"listserv": "WHITMANWIRE", "archive_id": "w1", "subject": DINNER["subject"], "body_text": "short", "complete": False}), orgs, places, NOW + timedelta(minutes=2))
    kept = tables.read("messages").where("archive_id = 'w1'").first()
    assert kept.complete and "Frist MPR" in kept.body_text
    assert ingest.ingest_batch(tables, second, orgs, places, NOW + timedelta(minutes=3)) == {"messages": 0, "events": 0}
    revisions = [r.revision for t in ("messages", "events") for r in tables.read(t).collect()]
    assert len(set(revisions)) == len(revisions) and None not in revisions


def test_reminders_collapse_and_count(spark, tmp_path):
    tables, orgs, places = store.Store(spark, str(tmp_path / "t")), data.organizations(spark), data.locations(spark)
    ingest.ingest_batch(tables, raw(spark, {"archive_id": "r1", "sent_at": datetime(2026, 9, 28, 13), **DINNER}), orgs, places, NOW)
    ingest.ingest_batch(tables, raw(spark, {"archive_id": "r2", "sent_at": datetime(2026, 9, 28, 14), **DINNER, "subject": "REMINDER: " + DINNER["subject"]}), orgs, places, NOW + timedelta(minutes=1))
    engine = read.Engine(tables.read("messages"), tables.read("message_lists"), tables.read("events"), orgs)
    found = engine.list_events(read.EventFilters(since="2026-09-28")).collect()
    assert len(found) == 1 and found[0].announcements.emails == 2 and found[0].announcements.first_announced_at == datetime(2026, 9, 28, 13) and found[0].announcements.listservs == ["FREEFOOD"]
    assert engine.event_changes(0).count() == 2 and engine.get_event(found[0].id).count() == 1
    assert engine.search_messages(read.MessageFilters(query="dinner")).count() == 2 and engine.message_changes(0).count() == 2
    status = engine.status(NOW).first()
    assert status.messages == 2 and status.active == 1 and status.duplicates_of_official == 1


class Lost(Exception):
    pass


def test_a_writer_that_dies_leaves_the_tables_as_they_were(spark, tmp_path, monkeypatch):
    """Killed at several steps, before and while the tables are written: nothing is seen of it, and the next run gives what an undisturbed one gives."""
    orgs, places = data.organizations(spark), data.locations(spark)
    rows = raw(spark, {"archive_id": "r1", **DINNER})
    columns = {"messages": ["id", "subject", "extraction_version", "is_event", "revision"], "message_lists": ["message_id", "listserv"], "events": ["id", "status", "title", "starts_at", "revision"]}
    show = lambda s: {t: sorted(map(str, s.read(t).select(*c).collect())) for t, c in columns.items()}
    plain = store.Store(spark, str(tmp_path / "plain"))
    ingest.ingest_batch(plain, rows, orgs, places, NOW)
    for name, step in (("stage", 3), ("stage", 8), ("_publish", 1)):
        path, calls = str(tmp_path / f"{name}{step}"), []
        with monkeypatch.context() as m:
            whole = getattr(store.Store, name)

            def dies(self, *args):
                calls.append(1)
                if len(calls) == step:
                    raise Lost
                return whole(self, *args)

            m.setattr(store.Store, name, dies)
            with pytest.raises(Lost):
                ingest.ingest_batch(store.Store(spark, path), rows, orgs, places, NOW)
        again = store.Store(spark, path)
        assert again.manifest() == (0, {}) and again.read("messages", schemas.MESSAGES).isEmpty()
        ingest.ingest_batch(again, rows, orgs, places, NOW)
        assert show(again) == show(plain) and again.manifest()[0] == 1
    with pytest.raises(RuntimeError, match="another writer"):
        plain._publish(plain.manifest()[0], {})


def test_an_extractor_that_fails_gives_way_to_the_rules(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "t"))

    def broken(messages):
        return messages.select(F.raise_error(F.lit("no answer")).alias("id"))

    ingest.ingest_batch(tables, raw(spark, {"archive_id": "r1", **DINNER}), data.organizations(spark), data.locations(spark), NOW, broken)
    kept = tables.read("messages").first()
    assert kept.is_event and kept.extraction_version == "rules-1" and "extractor failed" in kept.extraction_notes[0] and tables.read("events").count() == 1


class Archive:
    """A fetcher over two messages, of which one has its body; a list whose name isn't known can't be read."""

    def __init__(self, spark):
        self.spark = spark

    def listing(self, list_name, as_of):
        if list_name != "FREEFOOD":
            raise ValueError("archive access unavailable")
        items = self.spark.createDataFrame([(f"Dinner talk tomorrow 6pm {i}", f"https://lists.princeton.edu/cgi-bin/wa?A2=m{i}", '"Pat" <p@x.edu>', "Mon, 28 Sep 2026 10:00:00 -0400", "short") for i in range(2)], feeds.RSS_ITEM)
        return feeds.listing_items(items, list_name, F.lit(as_of))

    def bodies(self, pending):
        none = F.lit(None)
        return pending.where("archive_id = 'm1'").select("source_url", none.cast("struct<identity_fields: array<string>, rfc_message_id: string, recipient_lists: array<string>, headers_complete: boolean>").alias("headers"), F.lit(DINNER["body_html"]).alias("body_html"), none.cast("array<struct<url: string, type: string>>").alias("attachments"))


def test_poll_cycle(spark, tmp_path):
    tables, orgs, places = store.Store(spark, str(tmp_path / "t")), data.organizations(spark), data.locations(spark)
    first = poll.cycle(tables, Archive(spark), ["FREEFOOD", "HUOHUB"], orgs, places, NOW)
    assert [(s["seen"], s["created"], s["bodies"], s["error"]) for s in first] == [(2, 2, 1, None), (0, 0, 0, "archive access unavailable")]
    assert {r.archive_id: r.complete for r in tables.read("messages").collect()} == {"m0": False, "m1": True} and tables.read("events").count() == 1
    health = {r.listserv: r.failures for r in tables.read("sources").collect()}
    assert health == {"FREEFOOD": 0, "HUOHUB": 1}
    lists = ["FREEFOOD", "HUOHUB"]
    assert poll.due(tables.read("sources"), lists, NOW + timedelta(seconds=119)) == ["FREEFOOD"] and poll.due(tables.read("sources"), lists, NOW + timedelta(seconds=120)) == lists
    second = poll.poll_list(tables, Archive(spark), "FREEFOOD", orgs, places, NOW + timedelta(minutes=1))
    assert (second["seen"], second["created"], second["bodies"]) == (2, 0, 0)


def test_stream_equals_batch(spark, tmp_path):
    orgs, places = data.organizations(spark), data.locations(spark)
    rows = [{"archive_id": f"a{i}", "subject": f"Note {i}", "body_text": "hello"} for i in range(4)]
    folder = tmp_path / "in"
    for i in range(2):
        raw(spark, *rows[2 * i : 2 * i + 2]).write.mode("append").json(str(folder))
    streamed, batched = store.Store(spark, str(tmp_path / "s")), store.Store(spark, str(tmp_path / "b"))
    ingest.stream_messages(spark, str(folder), streamed, orgs, places, str(tmp_path / "c"), clock=lambda: NOW).awaitTermination()
    ingest.ingest_batch(batched, raw(spark, *rows), orgs, places, NOW)
    columns = ["id", "subject", "body_text", "category", "complete"]
    assert sorted(streamed.read("messages").select(*columns).collect()) == sorted(batched.read("messages").select(*columns).collect())


def test_official_sync(spark):
    old = event_rows(spark, *({"id": f"e{i}", "source": "myprincetonu", "external_id": str(i), "title": f"T{i}", "summary": "", "publishable": True} for i in range(30)))
    new = old.where("external_id <> '7'").withColumn("title", F.when(F.col("external_id") == "3", "new title").otherwise(F.col("title"))).withColumn("tags", F.array(F.lit("x")))
    out = {r.external_id: r for r in store.sync_official(old, new, F.lit(SENT)).collect()}
    assert out["7"].status == "withdrawn" and out["7"].change == "update" and out["3"].change == "update" and out["4"].change is None and out["4"].tags is None
    with pytest.raises(Exception, match="only 5 events"):
        store.sync_official(old, new.limit(5), F.lit(SENT)).collect()


def test_merge_and_revisions(spark):
    cur = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "k int, v string, w int")
    upd = spark.createDataFrame([(1, "a", None), (2, "c", 1), (3, None, None)], "k int, v string, w int")
    merged = store.merge_snapshot(cur, upd, ["k"])
    assert {r.k: (r.v, r.change) for r in merged.collect()} == {1: ("a", None), 2: ("c", "update"), 3: (None, "insert")}
    revised = store.with_revisions(merged.withColumn("revision", F.lit(0).cast("long")), 10, ["k"])
    assert {r.k: r.revision for r in revised.collect()} == {1: 0, 2: 11, 3: 12}
    health = spark.createDataFrame([("A", SENT, SENT, None, 2)], schemas.SOURCES)
    polls = spark.createDataFrame([("A", SENT, "x" * 600), ("B", SENT, None)], "listserv string, polled_at timestamp, error string")
    got = {r.listserv: r for r in store.source_health(health, polls).collect()}
    assert got["A"].failures == 3 and len(got["A"].last_error) == 500 and got["B"].failures == 0


def test_save_extraction(spark):
    e = {"title": "t", "summary": "", "starts_at": SENT, "ends_at": None, "time_precision": "exact", "location_text": None, "location_id": None, "location_name": None, "latitude": None, "longitude": None, "room": None, "online": False, "tags": [], "free_food": False, "rsvp_url": None, "host_org_id": None, "host_org_name": None, "confidence": 0.7, "publishable": False}
    old = event_rows(spark, {"id": "a0", "message_id": "m", "idx": 0, "status": "duplicate"}, {"id": "a1", "message_id": "m", "idx": 1}, {"id": "b0", "message_id": "n", "idx": 0, "status": "withdrawn"})
    found = spark.createDataFrame([("m", "rules-1", [tuple(e.values())]), ("n", "rules-1", [tuple(e.values())])], f"id string, version string, events {schemas.EXTRACTED}")
    got = {(r.message_id, r.idx): r.status for r in store.save_extraction(old, found, F.lit(SENT)).collect()}
    assert got == {("m", 0): "duplicate", ("m", 1): "withdrawn", ("n", 0): "active"}


def test_sources(spark, tmp_path):
    rss = tmp_path / "a.xml"
    rss.write_text('<rss><channel><item><title>Hi</title><link>https://lists.princeton.edu/cgi-bin/wa?A2=ind%3A1&amp;L=X&amp;P=9</link><author>"Pat Lee" &lt;p@x.edu&gt;</author><pubDate>Mon, 28 Sep 2026 10:00:00 -0400</pubDate><description>d</description></item><item><title>no id</title><link>x</link></item></channel></rss>')
    got = feeds.listing(spark, str(rss), "WHITMANWIRE", F.lit(NOW)).collect()
    assert len(got) == 1 and got[0].archive_id == "ind:1" and got[0].author_email == "p@x.edu" and got[0].sent_at == datetime(2026, 9, 28, 14) and "P=9" not in got[0].source_url
    with pytest.raises(ValueError):
        feeds.check_list("bad name")
    page = tmp_path / "login.html"
    page.write_text("<html><body>Please sign in</body></html>")
    with pytest.raises(ValueError, match="access unavailable"):
        feeds.listing(spark, str(page), "WHITMANWIRE", F.lit(NOW))
    page.write_text("<rss><channel></channel></rss>")
    assert feeds.listing(spark, str(page), "WHITMANWIRE", F.lit(NOW)).count() == 0
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"listserv": "freefood", "messages": [{"message_id": "1", "date": "2026-09-28T14:00:00Z", "author_name": "A", "hoagiemail_sender_name": "B", "subject": "s"}, {"date": "2026-09-28"}, {"message_id": "2", "date": "bad"}]}))
    got = feeds.read_archive(spark, str(old)).collect()
    assert len(got) == 1 and got[0].listserv == "FREEFOOD" and got[0].author_name == "B" and not got[0].complete
    pages = spark.createDataFrame([("u", '<a href="/cgi-bin/wa?A3=1&amp;T=text%2Fhtml&amp;header=1">text/html</a><a href="/cgi-bin/wa?A3=2">image</a>')], "source_url string, page string")
    parts = spark.createDataFrame([("https://lists.princeton.edu/cgi-bin/wa?A3=1&T=text%2Fhtml", "<p>x</p>")], "url string, content string")
    got = feeds.message_pages(pages, parts).first()
    assert got.body_html == "<p>x</p>" and len(got.attachments) == 2
    assert feeds.backoff_seconds(60, 0) == 60 and feeds.backoff_seconds(60, 9) == 1800


def test_analyze(spark):
    rows = spark.createDataFrame([("1", "Chess talk tomorrow 6pm", "", "<p>Meet in Frist MPR</p>", "Chess Circle", "x@princeton.edu", "WHITMANWIRE", SENT)], "id string, subject string, body string, body_html string, sender_name string, sender_email string, listserv string, sent_at timestamp")
    got = read.analyze(rows, data.organizations(spark), data.locations(spark), NOW).first()
    assert got.organization_id == "mpu:1" and got.is_event and got.events[0].host_org_name == "Chess Circle"


def test_organization_payload(spark):
    got = {r.id: r for r in read.organization_payload(data.organizations(spark)).collect()}
    assert got["mpu:52941"].acronym == "ACM" and got["mpu:52941"].group_url.endswith("type_id=52941&tab=about") and got["mpu:52941"].socials == {"instagram": "https://instagram.com/x"} and got["department:math"].group_url is None
    assert got["department:math"].forum_category == "academics" and got["mpu:1"].forum_category == "athletics" and all(r.forum_category for r in got.values())
