"""Work that must follow the size of the input, on rows with many copies."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillmesh.operators import dedupe
from quillmesh.plans.registered import instant


def most_rows(frame):
    """Rows of the result, and the largest number that a step of its plan gave."""
    rows = frame.collect()
    most, left = 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return rows, most


def same_events(spark, n, hosts):
    """n listed and n official events within 20 minutes, half a second apart; the ids of neighbours tie in time."""
    k = F.col("id")
    at = F.timestamp_micros(F.lit(1705327200_000000) + (k / 4).cast("long") * 1_000_000)
    return spark.range(2 * n).select(
        k.cast("string").alias("id"), F.when(k % 2 == 0, "listserv").otherwise("myprincetonu").alias("source"), F.lit("active").alias("status"), F.concat(F.lit("chess night "), F.when(k % 4 < 2, "first").otherwise("second")).alias("title"), at.alias("starts_at"),
        F.when(F.lit(hosts), "mpu:1").alias("host_org_id"), F.lit(None).cast("string").alias("location_id"), at.alias("created_at"),
    )


def test_official_copies_make_no_pairs(spark):
    for hosts in (False, True):
        rows, most = most_rows(dedupe.official_duplicates(same_events(spark, 1000, hosts), instant("2024-01-01 00:00:00")))
        assert {r.id: r.duplicate_of for r in rows} == {str(i): min(str(i // 4 * 4 + 1), str(i // 4 * 4 + 3)) for i in range(0, 2000, 2)}
        assert most <= 20_000


def test_nearest_official_event_on_the_bands_edge(spark):
    base = datetime(2024, 1, 15, 14)
    rows = [("l", "listserv", 0), ("a", "myprincetonu", -2700), ("b", "myprincetonu", 2700), ("c", "myprincetonu", 2701)]
    events = spark.createDataFrame([(i, s, "active", "chess night", base + timedelta(seconds=n), None, None, base) for i, s, n in rows], "id string, source string, status string, title string, starts_at timestamp, host_org_id string, location_id string, created_at timestamp")
    assert [tuple(r) for r in dedupe.official_duplicates(events, instant("2024-01-01 00:00:00")).collect()] == [("l", "a")]
    assert not dedupe.official_duplicates(events.where("id not in ('a', 'b')"), instant("2024-01-01 00:00:00")).collect()


def test_reminders_ask_each_copy_a_few_times(spark):
    """Every event announces the same; the first of all is the only one that isn't preceded."""
    rows, most = most_rows(dedupe.reminders(same_events(spark, 1000, True), instant("2024-01-01 00:00:00")))
    assert {r.id: r.duplicate_of for r in rows} == {str(i): "0" for i in range(2, 2000, 2)}
    assert most <= 3_000


def test_reminders_over_a_buckets_edge(spark):
    """The first of a bucket is preceded by a late one of the bucket before, though that bucket's first is too far away."""
    base = datetime(2024, 1, 15, 14)
    rows = [("a", 0), ("b", 1700), ("c", 1900), ("d", 7300), ("e", 7200 + 1700)]
    events = spark.createDataFrame([(i, "listserv", "active", "chess night", base + timedelta(seconds=n), "mpu:1", None, base + timedelta(seconds=n)) for i, n in rows], "id string, source string, status string, title string, starts_at timestamp, host_org_id string, location_id string, created_at timestamp")
    found = {r.id: r.duplicate_of for r in dedupe.reminders(events, instant("2024-01-01 00:00:00")).collect()}
    assert found == {"b": "a", "e": "d"}


def test_revisions_do_not_depend_on_how_rows_lie(spark):
    """The plan reads the rows twice; here they come in other partitions and another order each time."""
    from quillmesh.operators import store

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    had = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).repartition(7, F.rand()).select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("body"), F.lit(0).cast("long").alias("revision"), F.when(F.col("id") % 5 > 0, "update").alias("change"))
        numbered = store.with_revisions(rows, 100, ["key"]).where("change is not null").toPandas()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    found = list(numbered.sort_values("key")["revision"])
    assert found == list(range(101, 16_101))


def test_rules_of_long_texts_are_those_of_short_ones(spark):
    from quillmesh.functions import fixed, html, text

    bodies = ["", None, "free PIZZA", "a career fair, jazz\nand a lecture on AI", "Étude: preREsearch", "x" * 50_000 + " study break, hackathon and debate, chess"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, b string")
    for r in rows.select("id", "b", html.tags_column(F.col("b")).alias("new"), text.tags_from_text("b").alias("old"), html.rules_column([(F.col("b"), fixed.EVENT_WORDS), (F.lit("concert"), fixed.EVENT_WORDS)]).alias("met")).collect():
        assert r.new == r.old and r.met[1] and r.met[0] == (r.id in (3, 5)), r.id


def test_work_in_python_is_dealt_to_all_cores(spark, sf):
    """A table of short rows lies in one piece; each of these queries works long on every row."""
    from quillmesh.plans import catalog

    cores = spark.sparkContext.defaultParallelism
    for name in ("q_media", "q_headers_and_keys"):
        assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() >= cores, name


def test_one_search_makes_postings_once(spark, sf):
    from quillmesh.plans import catalog

    plan = catalog.QUERIES["q_fts"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2


def test_replay_of_many_copies():
    import time

    import pandas as pd

    from quillmesh.operators import reconcile

    n, base = 12_000, pd.Timestamp("2024-01-15")
    times = [base + pd.Timedelta(seconds=200 * i) for i in range(n)]
    copies = pd.DataFrame({"id": [f"{i:06d}" for i in range(n)], "listserv": ["A", "B"] * (n // 2), "rfc_message_id": None, "delivery_key": "k", "sent_at": times, "ingested_at": times, "canonical_id": None, "residential": True})
    began = time.time()
    assert reconcile._replay(copies)["canonical_id"].isna().all()
    assert time.time() - began < 10


def test_similar_sets_make_no_rows_for_other_pairs(spark, tmp_path):
    """Texts over few words share first words with most others; of the pairs only similar ones become rows."""
    import random

    from quillmesh.plans import catalog

    draw = random.Random(1)
    sets = [sorted(draw.sample(range(100, 220), 30)) for _ in range(500)]
    spark.createDataFrame([(i, " ".join(f"word{k}" for k in s)) for i, s in enumerate(sets)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows, most = most_rows(catalog.QUERIES["q_jaccard_pairs"](spark, str(tmp_path)))
    like = {(a, b): round(len(x & y) / len(x | y), 6) for b, y in enumerate(map(set, sets)) for a, x in enumerate(map(set, sets[:b])) if 10 * len(x & y) >= 6 * len(x | y)}
    assert {(r.a, r.b): r.j for r in rows} == like
    assert most <= 10_000


def test_similar_sets_of_all_sizes(spark, monkeypatch):
    """Blocks of a few sets, sizes that fill several blocks, copies and empty sets; words with and without a short code."""
    import random

    from quillmesh.operators import setpairs

    draw = random.Random(2)
    sets = [set()] * 3 + [{"one"}] * 4 + [{"one", "two"}, {"one", "two", "six"}]
    for _ in range(60):
        base = draw.sample(range(400), draw.choice((1, 2, 5, 20, 90, 200)))
        sets += [{f"w{k}" for k in base if draw.random() < keep} | {f"w{draw.randrange(400)}" for _ in range(draw.randrange(4))} for keep in (1, 1, 0.95, 0.8, 0.65)]
    rows = spark.createDataFrame([(7 * i, sorted(s)) for i, s in enumerate(sets)], "doc_id long, words array<string>")
    for name, value in (("BLOCK_WORDS", 1500), ("CODED", 100), ("CHUNK", 50)):
        monkeypatch.setattr(setpairs, name, value)
    for least in (0.6, 0.85):
        like = {(7 * a, 7 * b): len(x & y) / len(x | y) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if x and y and len(x & y) / len(x | y) >= least}
        assert {(r.a, r.b): r.j for r in setpairs.similar_pairs(rows, least).collect()} == like and like
    assert not setpairs.similar_pairs(rows.limit(3), 0.6).collect()


def test_long_texts_are_cleaned_as_short_ones(spark):
    """Blanks before a footer aren't tried one after the other; what goes is what the patterns say."""
    import random
    import re
    import time

    from quillmesh.functions import fixed, html, text

    footer = f"{fixed.RELAY_FOOTER} Hoagie Mail. Email composed by A B (a@b.edu) - please report it to hoagie@princeton.edu."
    notice = "This email was sent to you as a subscriber of WHITMANWIRE@princeton.edu."
    signoff = 'If you would like to unsubscribe from this listserv, please send a "SIGNOFF WHITMANWIRE" command to LISTSERV@PRINCETON.EDU.'
    link = "to UNSUBSCRIBE, click the following link: https://lists.princeton.edu/cgi-bin/wa?SUBED1=WHITMANWIRE&A=1"
    blanks = "a" + " " * 60_000 + "b"
    began = time.time()
    assert html.readable_text(blanks + "\n" + footer) == blanks
    assert time.time() - began < 2

    def head(x):
        x = re.sub(fixed.UNSUBSCRIBE, "", x).rstrip()
        return re.sub(r"\s*[-_]{3,}\s*$", "", x[: x.index(fixed.RELAY_FOOTER)]).rstrip() + " z"

    draw = random.Random(3)
    bodies = ["".join(draw.choices(["a", " ", "  ", "\n", "\t", "-", "---", "__", "_-_", signoff, link, notice + "\n"], (8, 6, 2, 3, 1, 3, 3, 2, 2, 1, 1, 1), k=draw.randrange(12))) + draw.choice(("", " ", "\n", "---\n")) + footer + " z" for _ in range(300)]
    assert [html.drop_footer(b) for b in bodies] == [head(b) for b in bodies]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, b string").select("id", text.display_text("b").alias("shown"), text.is_relay_footer("b").alias("footer")).collect()
    assert {r.id: r.shown for r in rows} == {i: head(b) for i, b in enumerate(bodies)}
    for r in spark.createDataFrame(list(enumerate(notice + "\n" + b for b in bodies)), "id int, b string").select("b", text.readable("b").alias("old"), html.readable_text_column(F.col("b"), F.lit(None).cast("string")).alias("new")).collect():
        assert r.old.split() == r.new.split()  # white space is cleaned in one of them
    assert {r.id: r.footer for r in rows} == {i: html.is_relay_footer(b) for i, b in enumerate(bodies)}
    assert spark.createDataFrame([(None,)], "b string").select(text.is_relay_footer("b").alias("f"), text.display_text("b").alias("d")).first() == (None, None)
    pages = [f"<p>{b}</p><hr><h2>t  {link}</h2>" for b in bodies]
    for p in pages:
        assert html.drop_notices(p) == re.sub(fixed.SUBSCRIBER_NOTICE, "", re.sub(fixed.FORMS_WARNING, "", re.sub(fixed.SUBSCRIBER_NOTICE, "", p, count=1), count=1), count=1)
        assert "  " not in html.page_text(p).replace("\n", "") and not re.search(r"[ \t]+$", html.page_text(p), re.M)
