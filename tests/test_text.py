from datetime import datetime

from pyspark.sql import functions as F

from quillmesh.functions import fts, html, text

FOOTER = "This email was instantly sent to all college listservs with Hoagie Mail. Email composed by Jane Doe (jdoe@princeton.edu) — if inappropriate, please report it to hoagie@princeton.edu."


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_footers_go_and_signatures_stay(spark):
    body = "Come to our event!\n- Jane\n\n" + FOOTER
    assert one(spark, body, text.display_text) == html.drop_footer(body) == "Come to our event!\n- Jane"
    wire = 'Hello\nIf you would like to unsubscribe from this listserv, please send a "SIGNOFF WHITMANWIRE" command to LISTSERV@PRINCETON.EDU'
    assert one(spark, wire, text.display_text) == html.drop_footer(wire) == "Hello"
    assert one(spark, "plain", text.display_text) == "plain"


def test_preview_and_readable_text():
    assert html.preview("&lt;p&gt;Hi &amp; welcome&lt;/p&gt;") == "Hi & welcome"
    assert len(html.preview("x" * 500)) <= 230
    assert html.readable_text("", "<div>This email was sent to you as a subscriber of WHITMANWIRE@princeton.edu.</div><p>Pizza at <b>Frist</b></p>") == "Pizza at Frist"
    assert html.readable_text(None, None) == html.preview(None, None) == html.display_html(None) == ""


def test_sender():
    found = html.resolve_sender("HoagieMail", "hoagie@princeton.edu", "Email composed by Pat Lee (plee@princeton.edu)", None)
    assert found == {"name": "Pat Lee", "email": "plee@princeton.edu", "via": "HoagieMail", "attribution": "hoagiemail-footer"}
    assert html.resolve_sender("HoagieMail", "hoagie@princeton.edu", "no footer", None)["email"] == ""
    assert html.resolve_sender(None, None, None, None)["attribution"] == "display-name-only"


def test_ids_and_subjects(spark):
    row = spark.createDataFrame([("FREEFOOD", "x", "[freefood] Boba")], "l string, a string, s string").select(text.message_id("l", "a").alias("i"), text.message_id(F.lit("WHITMANWIRE"), "a").alias("j"), text.subject_of("s", "l").alias("s")).first()
    assert len(row.i) == 24 and row.i != row.j and row.s == "Boba"
    assert one(spark, "", lambda x: text.subject_of(x, F.lit("A_B"))) == "(No subject)"


PAGE = (
    '<div class="archive"><b>From:</b> A &lt;a@x.edu&gt;</div><div class="archive"><b>Message-ID:</b> &lt;abc@mail.com&gt;</div>'
    '<div class="archive"><b>To:</b> WHITMANWIRE@PRINCETON.EDU, butlerbuzz@princeton.edu, FREEFOOD@princeton.edu</div><div class="archive"><b>Date:</b> Mon, 28 Sep 2026 10:00:00 -0400</div><div class="archive"><b>Subject:</b> Hi</div>'
)


def test_headers_and_delivery_keys(spark):
    headers = html.archive_headers(PAGE)
    assert headers["rfc_message_id"] == "abc@mail.com" and headers["recipient_lists"] == ["BUTLERBUZZ", "WHITMANWIRE"] and headers["headers_complete"]
    footer = 'To unsubscribe from the whitmanwire list, click the following link: <a href="https://lists.princeton.edu/cgi-bin/wa?SUBED1=whitmanwire&A=1">https://lists.princeton.edu/cgi-bin/wa?SUBED1=whitmanwire&amp;A=1</a>'
    key = html.delivery_key(headers, "<p>Hello   there</p>")
    assert key and key == html.delivery_key(headers, f"<p>Hello there</p><p>{footer}</p>")
    assert html.delivery_key(headers, "<p>Hello you</p>") != key and html.delivery_key(None, "x") is None
    rows = spark.createDataFrame([(PAGE, "<p>Hello there</p>"), (None, None)], "page string, body string")
    got = rows.select(html.delivery_key_column(html.archive_headers_column("page"), F.col("body")).alias("k")).collect()
    assert [r.k for r in got] == [key, None]
    a = datetime(2026, 9, 28, 10)
    assert html.same_delivery(None, "k", a, None, "k", a.replace(minute=1, second=30)) and not html.same_delivery(None, "k", a, None, "k", a.replace(minute=5))
    assert html.same_delivery("r", None, a, "r", None, a.replace(hour=20)) and html.same_delivery(None, "k", a, None, "k", a.replace(minute=2))


def test_media():
    url = html.clean_media_url("https://lists.princeton.edu/cgi-bin/wa?A3=ind&P=123&X=SECRET&Y=me@x")
    assert "P=123" in url and "SECRET" not in url and "me@x" not in url
    assert html.clean_media_url("javascript:alert(1)") is None and html.clean_media_url(None) is None
    assert html.media_of('<img src="cid:1"><img src="https://a.b/s.png" width="10"><img src="https://a.b/c.png"><img src="https://a.b/c.png">')[0]["url"] == "https://a.b/c.png"
    assert len(html.media_of("".join(f'<img src="https://a.b/{i}.png">' for i in range(60)))) == 40


def test_safe_html():
    out = html.display_html('<p onclick="x">Hi <script>bad()</script><a href="/rel">r</a> <a href="https://a.b">t</a> see https://c.d/e.</p><img src=x>')
    assert "script" not in out and "onclick" not in out and "<span>r</span>" in out and 'href="https://c.d/e"' in out and "<img" not in out


def test_links(spark):
    page = '<a href="https://a.b/x?y=1&amp;z=2">1</a><a href="/rel">2</a><a HREF=\'https://nam.safelinks.protection.outlook.com/?url=https%3A%2F%2Fc.d%2Fe&data=1\'>3</a><a href="https://lists.princeton.edu/cgi-bin/wa?A=1">4</a><a href="https://a.b/x?y=1&amp;z=2">5</a>'
    assert one(spark, page, text.extract_links) == ["https://a.b/x?y=1&z=2", "https://c.d/e"]
    assert one(spark, None, text.extract_links) == []
    assert one(spark, "https://l.p/wa?A2=ind&X=1&Y=2&P=3", text.clean_archive_url) == "https://l.p/wa?A2=ind"


def test_titles(spark):
    for given, wanted in {
        "[WHITMANWIRE] Fwd: TONIGHT: Free boba": "Free boba", "[OrangeHat] Mini-CTF Competition THIS Tuesday @4:30 in Frist 207": "Mini-CTF Competition", "NEWB ARCH TONIGHT (9/26) @ 9 PM in BLAIR ARCH": "NEWB ARCH",
        "[POPS] Boris Godunov Screening Oct 1!": "Boris Godunov Screening Oct 1", "Friday Night Lights": "Friday Night Lights",
    }.items():
        assert one(spark, given, text.clean_title) == wanted


def test_summary_keeps_whole_paragraphs(spark):
    body = "\n\n".join(["a" * 300, "b" * 200, "c" * 200])
    assert one(spark, body, text.summarize) == "a" * 300 + "\n\n" + "b" * 200
    assert one(spark, "x" * 900, text.summarize) == "x" * 600


def test_times_at_offset_changes(spark):
    for given, wanted in {"2026-09-30T16:30": datetime(2026, 9, 30, 20, 30), "2026-12-01T16:30": datetime(2026, 12, 1, 21, 30), "2026-11-01T01:30": datetime(2026, 11, 1, 5, 30), "2026-03-08T02:30": datetime(2026, 3, 8, 6, 30)}.items():
        assert one(spark, given, lambda x: text.local_to_utc(x).cast("timestamp_ntz")) == wanted, given
    assert one(spark, "nonsense", text.local_to_utc) is None


def test_series_keys(spark):
    key = lambda h, t: one(spark, t, lambda x: text.series_key(F.lit(h), x))
    assert key("mpu:1", "Daily Prayer Monday 9/28") == key("mpu:1", "Daily Prayer Tuesday 9/29") != key("mpu:2", "Daily Prayer")


def test_words_are_ascii(spark):
    assert one(spark, "éfree food here", text.tags_from_text) == ["free food"]
    row = spark.createDataFrame([("the cat sat", "cat sat"), (None, "")], "a string, b string").select(text.jaccard(text.similarity_words("a"), text.similarity_words("b")).alias("j")).collect()
    assert abs(row[0].j - 2 / 3) < 1e-9 and row[1].j == 0


def test_stems():
    """Words of the published sample of the rules, and of their special cases."""
    given = "consign consigned consigning consignment consist consistency consistent consolation consolatory consolidate consolidating knack knackeries knavish kneel kneeling knightly knitted knobs knocking skies dying news sensational hopping hoping tied flies cries by say communism community generate generously relational happily proceed succeeds luxuriated agreed national feed sized".split()
    wanted = "consign consign consign consign consist consist consist consol consolatori consolid consolid knack knackeri knavish kneel kneel knight knit knob knock sky die news sensat hop hope tie fli cri by say communism communiti generat generous relat happili proceed succeed luxuri agre nation feed size".split()
    assert [fts.stem(w) for w in given] == wanted


def test_search(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Free pizza", "ACM", None, "come and eat pizzas"), ("2", "Chess night", "Chess Circle", None, "no pizza here"), ("3", None, None, None, None), ("4", "Chess", None, None, "x " * 200 + "pizza")], "id string, subject string, sender_name string, organization_name string, body_text string")
    fts.postings(rows).write.partitionBy("part").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    found = rows.withColumn("names", F.concat_ws(" ", "sender_name", "organization_name"))

    def hits(q):
        own = found.withColumn("f", fts.evaluate_column(F.col("subject"), F.col("names"), F.col("body_text"), q)).where("f.matches").select("id", "f.rank").collect()
        read = fts.search(stored, q, rows).collect()
        assert sorted(map(tuple, own)) == sorted(map(tuple, read))
        return [r.id for r in sorted(own, key=lambda r: (-r.rank, r.id))]

    assert hits("pizza") == ["1", "2", "4"] and hits('"free pizza"') == ["1"] and hits("pizza -chess") == ["1"] and hits("chess or eating") == ["2", "4", "1"] and hits("") == []
    assert hits("pizzas chess") == ["2", "4"] and hits("-pizza") == ["3"] and hits("the") == []
