from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import clock, corpus, navigation
from folio.operators.sites import page_sites
from folio.operators.timestamps import format_posteriors, normalise_timestamps, parse_value
from folio.sources.pages import page_list, raw_files, route_responses, scrape_records, write_records

SITES = [("uk.example", "en", "Europe/London", "dmy"), ("us.example", "en", "America/New_York", "mdy"), ("fr.example", "fr", "Europe/Paris", "dmy"), ("ru.example", "ru", "Europe/Moscow", "dmy")]
CASES = [
    ("uk.example", "2024-07-01T10:00:00", "2024-07-01T09:00:00"), ("uk.example", "2024-07-01 10:00:00,750", "2024-07-01T09:00:00"), ("us.example", "03/04/2024 5:06 PM", "2024-03-04T22:06:00"), ("uk.example", "03/04/2024 17:06", "2024-04-03T16:06:00"),
    ("us.example", "13/04/2024 17:06", "2024-04-13T21:06:00"), ("uk.example", "2024-03-31T01:30", None), ("uk.example", "2024-10-27 01:30", None), ("uk.example", "2024-10-27T01:30+01:00", "2024-10-27T00:30:00"), ("uk.example", "2024-03-31", None),
    ("fr.example", "12 AOÛT 2024 08:09", "2024-08-12T06:09:00"), ("ru.example", "31 августа 2021, 17:05", "2021-08-31T14:05:00"), ("us.example", "May 5, 2024 at 12:10 AM", "2024-05-05T04:10:00"), ("us.example", "1700000000", "2023-11-14T22:13:20"),
    ("us.example", "1700000000999", "2023-11-14T22:13:20"), ("uk.example", "Sat Oct 26 2024 07:58:55 GMT-0700", "2024-10-26T14:58:55"), ("uk.example", "Tue, 30 Apr 2025 09:59:57 CEST", "2025-04-30T07:59:57"), ("uk.example", "2022-11-12T14:49:54+00:00[Europe/London]", "2022-11-12T14:49:54"),
    ("us.example", "2024-01-02 03:04 Europe/Paris", "2024-01-02T02:04:00"), ("us.example", "2024-01-02 03:04 Nowhere/Land", None), ("uk.example", "31.02.2024 10:00", None), ("uk.example", "2024-01-02 25:61", None), ("uk.example", "yesterday", None),
    ("uk.example", "20250623T094228Z", "2025-06-23T09:42:28"), ("uk.example", "3.11.24 08:41", "2024-11-03T08:41:00"), (None, "2024-01-02T03:04", None), (None, "2024-01-02T03:04Z", "2024-01-02T03:04:00"), ("uk.example", "", None), ("uk.example", "8:19 PM", None),
    ("uk.example", "Wed, 10 Nov 2021 18:05:04 JST", "2021-11-10T09:05:04"), ("uk.example", "May 5, 2024 at 13:10 PM", None),
]


def test_timestamps(spark):
    values = spark.createDataFrame([(k, "published", v, s) for k, (s, v, _) in enumerate(CASES)] + [(99, "modified", None, "uk.example")], "page_id bigint, field string, value string, site string")
    sites = spark.createDataFrame(SITES, "site string, lang string, tz string, date_order string")
    clash = values.withColumn("lang", F.lit("xx")).withColumn("tz", F.lit("x")).withColumn("format", F.lit(1)).withColumn("local", F.lit(2)).withColumn("p_day", F.lit(3))
    got = {r.page_id: r for r in normalise_timestamps(clash, sites).collect()}
    for k, (_, v, want) in enumerate(CASES):
        s = None if want is None else int(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp())
        assert got[k].utc_s == s, (v, got[k])
    assert got[5].state == "skipped" and got[6].state == "repeated" and got[99].state == "no date"


@settings(max_examples=80, deadline=None)
@given(st.datetimes(datetime(2000, 1, 1), datetime(2049, 12, 31)), st.sampled_from(["%Y-%m-%dT%H:%M:%S%z", "%Y%m%dT%H%M%S%z", "%a, %d %b %Y %H:%M:%S %z", "%a %b %d %Y %H:%M:%S GMT%z", "%Y/%m/%d %H:%M:%S %z"]), st.integers(-11, 13))
def test_written_and_read_back(t, form, hours):
    from datetime import timedelta

    zone = timezone(timedelta(hours=hours))
    t = t.replace(microsecond=0, tzinfo=zone)
    p = parse_value(t.strftime(form), "en")
    assert p is not None and p[1] - p[3] == int(t.timestamp())


def test_mixture_of_formats():
    one = lambda *c, declared=None: format_posteriors([(*c, 0.0, 0.0)], declared)[0]
    assert one(0, 0, 5, declared="dmy") > 0.9 and one(0, 0, 5, declared="mdy") < 0.1
    assert one(90, 0, 40) > 0.9 and one(0, 90, 40) < 0.1
    assert 0.4 < one(0, 0, 9) < 0.6  # nothing decides: ambiguous
    assert one(0, 1000, 500, declared="dmy") < 0.1  # a wrong declaration is overruled
    assert 0.1 < one(400, 500, 100, declared="dmy") < 0.9  # a source that writes both ways
    # two shapes of one source: each by its own values, an unseen one by the others
    dots, slashes, dashes = format_posteriors([(500.0, 0.0, 9.0, 0.0, 0.0), (0.0, 500.0, 9.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0)], "dmy")
    assert dots > 0.9 and slashes < 0.1 and 0.1 < dashes < 0.9
    assert format_posteriors([(0.0, 0.0, 0.0, 30.0, 0.0)], None)[0] > 0.9 and format_posteriors([(0.0, 0.0, 0.0, 0.0, 300.0)], "dmy")[0] < 0.1  # weekdays decide


def test_declared_order_is_overruled_and_weekdays_speak(spark):
    """Without the mixture the declared order would decide all of these."""
    sites = spark.createDataFrame([("wrong.example", "en", "UTC", "dmy"), ("right.example", "en", "UTC", "dmy")], "site string, lang string, tz string, date_order string")
    rows = [(k, "published", f"0{1 + k % 9}/{13 + k % 15}/2024 10:00", "wrong.example") for k in range(240)]
    rows += [(1000, "published", "03/04/2024 10:00", "wrong.example"), (1001, "published", "03.04.2024 10:00", "right.example"), (1002, "published", "Mon, 04/03/2024 10:00", "right.example"), (1003, "published", "Wednesday 04/03/2024 10:00", "right.example")]
    got = {r.page_id: r for r in normalise_timestamps(spark.createDataFrame(rows, "page_id bigint, field string, value string, site string"), sites).collect()}
    at = lambda m, d: int(datetime(2024, m, d, 10, tzinfo=timezone.utc).timestamp())
    assert got[1000].utc_s == at(3, 4) and got[1001].utc_s == at(4, 3)
    assert got[1002].utc_s == at(3, 4)  # 4 March was a Monday
    assert got[1003].utc_s == at(4, 3)  # 3 April was a Wednesday, whatever the site declares
    long = spark.createDataFrame([(1, "published", "2024-01-02 10:00" + " " * 200 + "Z (" + "x" * 200 + ")", "right.example")], "page_id bigint, field string, value string, site string")
    assert normalise_timestamps(long, sites).first().utc_s == int(datetime(2024, 1, 2, 10, tzinfo=timezone.utc).timestamp())


def test_undecided_orders_are_marked(spark):
    values = spark.createDataFrame([(1, "published", "03/04/2024 10:00 +0000", None)], "page_id bigint, field string, value string, site string")
    sites = spark.createDataFrame(SITES, "site string, lang string, tz string, date_order string")
    assert normalise_timestamps(values, sites).first().state == "ambiguous"
    assert normalise_timestamps(values.where("false"), sites).count() == 0


def test_zone_rules_agree_with_another_library(spark):
    zones = ["Europe/London", "America/Sao_Paulo", "Australia/Lord_Howe", "Asia/Kolkata", "America/New_York"]
    times = [f"{y}-{m:02d}-{d:02d}T{h:02d}:30" for y in (2018, 2024) for m in (2, 3, 4, 10, 11) for d in (1, 3, 7, 10, 31 if m in (3, 10) else 28) for h in (0, 1, 2, 3)]
    rows = [(k, f"{t} {z}") for k, (t, z) in enumerate((t, z) for t in times for z in zones)]
    values = spark.createDataFrame([(k, "published", v, None) for k, v in rows], "page_id bigint, field string, value string, site string")
    got = {r.page_id: r.utc_s for r in normalise_timestamps(values, spark.createDataFrame(SITES, "site string, lang string, tz string, date_order string")).collect()}
    for k, v in rows:
        t, z = v.split(" ")
        a, b = (datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(z), fold=f) for f in (0, 1))
        back = datetime.fromtimestamp(a.timestamp(), timezone.utc).astimezone(ZoneInfo(z)).replace(tzinfo=None)
        want = None if a.utcoffset() != b.utcoffset() or back != datetime.fromisoformat(t) else int(a.timestamp())
        assert got[k] == want, v


def test_sites(spark):
    pages = spark.createDataFrame([(k,) for k in range(1, 7)], "page_id bigint")
    report = spark.createDataFrame([(1, "https://WWW.uk.Example:443/x"), (1, "https://WWW.uk.Example:443/x"), (2, "http://notuk.example/"), (3, None), (4, "https://us.example"), (5, "https://m.us.example./p"), (7, "https://us.example/")], "page_id bigint, final_url string")
    got = page_sites(pages, report, spark.createDataFrame(SITES, "site string, lang string, tz string, date_order string"))
    assert {(r.page_id, r.site) for r in got.collect()} == {(1, "uk.example"), (4, "us.example"), (5, "us.example")}


def test_clock(spark):
    rows = [(1, 1, 5, False, "timeout"), (1, 2, -3, False, "timeout"), (1, 3, 4000, True, "interval"), (1, 4, 99_999, False, "timeout"), (1, 5, 1, False, "idle"), (1, 6, 7, False, "timeout")]
    timers = spark.createDataFrame(rows, "k int, timer_id int, delay_ms int, repeat boolean, kind string")
    off = spark.createDataFrame([(1, 6)], "k int, timer_id int")
    got = [(r.timer_id, r.due_ms) for r in clock.fire_order(timers, off, keys=["k"]).orderBy("rank").collect()]
    assert got == [(2, 0), (1, 5), (3, 4000), (3, 8000), (5, 1)]
    assert clock.fire_order(timers, keys=["k"], max_fired=2).count() == 2


def test_short_intervals_fire_too(spark, tmp_path):
    from folio.queries import queries

    by_delay = {d: next(e for e in range(1, 15_001) if e * 37 % 15_000 == d) for d in (0, 1, 7, 499, 500, 9_999, 10_001)}
    rows = [(5, e, "view") for e in by_delay.values()] + [(5, by_delay[7] + 15_000, "click")]
    spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.timer_id: (r.fired, r.last_ms) for r in queries()["timer_intervals"](spark, str(tmp_path)).collect()}
    # a delay of 0 fires at once and then every millisecond
    assert got == {e: (10_000 // d, 10_000 // d * d) if d else (10_001, 10_000) for d, e in by_delay.items() if d <= 10_000}


def test_navigation(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "x"), ("l", "m"), ("m", "l")], "url string, target string")
    starts = spark.createDataFrame([("a",), ("x",), ("l",), ("z",), (None,)], "start string")
    got = {r.start: (r.url, r.hops, r.stopped) for r in navigation.follow(starts, edges, 3).collect()}
    assert got == {"a": ("d", 3, "limit"), "x": ("x", 0, "loop"), "l": ("m", 1, "loop"), "z": ("z", 0, "end")}


def test_reads(spark):
    rows = [(1, "s", 500, 500, None, 10, 200, 1), (1, "s", 500, 500, None, 10, 200, 0), (2, "s", None, None, "dns", None, None, 0), (3, "s", 10, 500, None, 30, 200, 0), (4, "s", 200, 500, None, 20, 200, 0), (5, "s", 0, 10, None, 40, 200, 0), (None, "s", 900, 10, None, 50, 404, 0)]
    reads = corpus.dedup_deliveries(spark.createDataFrame(rows, "read_id bigint, site string, text int, chrome_text int, failure string, ms bigint, status int, arrived_at int"))
    assert reads.count() == 6
    assert {r["class"]: r.reads for r in corpus.class_counts(reads).collect()} == {"reads": 1, "refused": 1, "empty": 1, "partial": 1, "both empty": 1, "browser empty, engine has text": 1}
    r = corpus.latency(reads, ["site"]).first()
    assert (r.reads, r.median_ms, r.p90_ms) == (4, 25.0, 40)


def test_sources(spark, tmp_path):
    assert [r.url for r in page_list(spark.createDataFrame([(" a ",), ("",), ("# b",), ("c",)], "value string")).collect()] == ["a", "c"]
    routes = spark.createDataFrame([(2, "/a", 200, "t", "second"), (1, "/a/b", 404, "t", "first")], "ord int, pattern string, status int, content_type string, body string")
    got = route_responses(spark.createDataFrame([("h/a/b",), ("h/a",), ("h",)], "url string"), routes)
    assert [r.body for r in got.orderBy("url").collect()] == [None, "second", "first"]
    records = spark.createDataFrame([("u1", None, "T"), ("u2", "down", None)], "url string, error string, title string").select(scrape_records(F.col("url"), F.col("error"), title=F.col("title")).alias("record"))
    assert [r.record for r in records.collect()] == ['{"title":"T","url":"u1"}', '{"error":"down","url":"u2"}']
    write_records(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.bin").write_bytes(b"\x00\xff")
    assert bytes(raw_files(spark, str(tmp_path / "raw")).first().content) == b"\x00\xff"


def test_streams(spark, tmp_path, data):
    from folio.streaming.reader import deduplicated, fire_timers, page_stream, read_stream, tumbling_counts

    pages = spark.read.parquet(f"{data}/pages.parquet")
    folder = str(tmp_path / "pages")
    pages.repartition(2).write.parquet(folder)
    q = read_stream(page_stream(spark, folder, pages.schema, 1)).writeStream.format("memory").queryName("readings").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("readings").count() == pages.count()
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = tumbling_counts(stream(), "ts", ["event_type"]).writeStream.outputMode("update").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(e) from (select max(events) e from hours group by start, event_type)").first()[0] == events.count()
    q = deduplicated(stream(), "user_id", "ts").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() < events.count()
    timers = spark.createDataFrame([(1, 1, 10, False), (1, 2, 4000, True)], "page_id bigint, timer_id bigint, delay_ms bigint, repeat boolean")
    timers.write.parquet(str(tmp_path / "timers"))
    q = fire_timers(spark.readStream.schema(timers.schema).parquet(str(tmp_path / "timers"))).writeStream.outputMode("append").format("memory").queryName("fired").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.timer_id, r.due_ms) for r in spark.table("fired").collect()) == [(1, 10), (2, 4000), (2, 8000)]
