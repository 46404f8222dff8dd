"""The feed against a server of its own, tables in buckets, stored marks."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pricewren.sources.feed import PagedFeed
from pricewren.streaming import incremental, keyed, marks


class Server(BaseHTTPRequestHandler):
    records: list[dict] = []
    asked: list[dict] = []
    failures: list[tuple[int, dict]] = []
    page = 10_000
    port = 0

    def do_GET(self):
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        Server.asked.append(query)
        if Server.failures:
            code, headers = Server.failures.pop()
            self.send_response(code)
            for name, value in headers.items():
                self.send_header(name, value)
            self.end_headers()
            return
        rows = Server.records
        for part in query.get("$where", "").replace(" = ", "=").replace(" >= ", ">=").split(" AND "):
            part = part.strip("()")
            if ">=" in part:
                rows = [r for r in rows if r.get(part.split(">=")[0]) and r[part.split(">=")[0]] >= part.split(">=")[1].strip("'")]
            elif "=" in part:
                rows = [r for r in rows if r.get(part.split("=")[0]) == part.split("=")[1].strip("'")]
        if "$select" in query:
            out = [{"most": max((r["day"] for r in rows), default=None)}]
        else:
            a = int(query["$offset"])
            out = rows[a : a + min(int(query["$limit"]), Server.page)]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def feed(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.records = [{"k": str(i), "day": f"2024/01/{1 + i % 3:02d}", "v": None if i % 5 == 0 else i} for i in range(23)]
    Server.asked, Server.failures, Server.page, Server.port = [], [], 10_000, server.server_port
    spark.dataSource.register(PagedFeed)
    yield lambda **o: spark.read.format("paged_feed").schema("k string, day string, v string").options(url=f"http://127.0.0.1:{server.server_port}/", wait="0.01", **o)
    server.shutdown()


def keys(df):
    return sorted(int(r["k"]) for r in df.collect())


@pytest.mark.parametrize("count", [0, 1, 4, 5, 8, 20, 23])
@pytest.mark.parametrize("ends", ["empty", "short"])
def test_end_of_a_feed_is_found(feed, count, ends):
    Server.records = Server.records[:count]
    for pages in (1, 3):
        got = feed(limit=4, pages=pages, ends=ends).load()
        assert keys(got) == list(range(count))
    assert len([q for q in Server.asked if q["$limit"] == "1"]) < 60


def test_pages_end_by_either_rule(feed):
    Server.page = 3  # the server gives less than is asked for
    assert keys(feed(limit=4, pages=100, ends="short").load()) == [0, 1, 2]
    assert len(keys(feed(limit=4, pages=100, ends="empty").load())) == 18
    with pytest.raises(Exception, match="empty or short"):
        feed(limit=4, ends="never").load().collect()


def test_filters_and_the_latest_day_reach_the_feed(spark, feed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = feed(limit=4, push="true").load().where("day = '2024/01/02' and v is not null and length(k) = 1")
    assert keys(got) == [1, 4, 7]
    wheres = {q.get("$where", "") for q in Server.asked}
    assert all("day = '2024/01/02'" in w and "v IS NOT NULL" in w and "length" not in w for w in wheres)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    Server.asked.clear()
    assert keys(feed(limit=4, latest="day").load()) == [i for i in range(23) if i % 3 == 2]
    assert Server.asked[0]["$select"] == "max(day) as most" and all(q["$where"] == "(day='2024/01/03')" for q in Server.asked[1:])


def test_busy_servers_are_asked_again(feed):
    Server.failures = [(429, {"Retry-After": "0.05"}), (503, {}), (500, {})]
    assert keys(feed(limit=50, total=23).load()) == list(range(23))
    Server.failures = [(404, {})]
    with pytest.raises(Exception, match="404"):
        feed(limit=50, total=23).load().collect()
    Server.failures = [(503, {})] * 3
    with pytest.raises(Exception, match="503"):
        feed(limit=50, total=23, tries=2).load().collect()
    Server.failures = []


def test_feed_as_a_stream_goes_on_where_it_stopped(spark, feed, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "table"), "k string, day string, v string", ["k"], 4)

    def run():
        stream = spark.readStream.format("paged_feed").schema("k string, day string, v string").options(url=f"http://127.0.0.1:{port}/", wait="0.01", limit="4").load()
        stream.writeStream.foreachBatch(keyed.merging_into(table, [F.col("day").desc()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()

    port = Server.port
    Server.records, later = Server.records[:9], Server.records[9:]
    run()
    assert keys(table.read()) == list(range(9))
    Server.records = Server.records + later
    Server.asked.clear()
    run()
    assert keys(table.read()) == list(range(23))
    assert min(int(q["$offset"]) for q in Server.asked if q["$limit"] != "1") == 9


def test_merges_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], 8)
    assert table.read().count() == 0
    rows = spark.createDataFrame([(i, "a") for i in range(100)], "k int, v string")
    assert table.merge(rows) == list(range(8))
    files = {p.parent.name: {x.name for x in p.parent.iterdir()} for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    touched = table.merge(spark.createDataFrame([(5, "b")], "k int, v string"))
    assert len(touched) == 1
    after = {p.parent.name: {x.name for x in p.parent.iterdir()} for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    assert {b for b in files if files[b] != after[b]} == {f"bucket={touched[0]}"}
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 100 and got[5] == "b" and got[6] == "a"
    assert table.merge(rows.limit(0)) == []
    table.merge(spark.createDataFrame([(5, "b")], "k int, v string"))
    assert table.read().count() == 100


def test_staged_merges_are_put_in_place_after_a_loss(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], 2)
    table.merge(spark.createDataFrame([(i, "a") for i in range(10)], "k int, v string"))
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_place", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([(3, "b")], "k int, v string"))
    again = keyed.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], 2)
    assert {r["k"]: r["v"] for r in again.read().collect()}[3] == "b" and again.read().count() == 10
    (tmp_path / "t.staged").mkdir()  # not staged as a whole
    assert again.read().count() == 10 and not (tmp_path / "t.staged").exists()


def test_marks_outlive_a_restart_and_skip_what_is_not_newer(spark, tmp_path):
    first = marks.Marks(spark, str(tmp_path / "marks"))
    ran = []
    read = lambda since: ran.append(since) or 7
    assert first.sync("cum/1", "2024-01-05", read) == {"source": "cum/1", "status": "ok", "mark": "2024-01-05", "result": 7}
    again = marks.Marks(spark, str(tmp_path / "marks"))
    assert again.get("cum/1") == "2024-01-05" and again.get("other") is None
    assert again.sync("cum/1", "2024-01-05", read)["status"] == "skipped"
    assert again.sync("cum/1", "2024-01-04", read)["status"] == "skipped"
    assert again.sync("cum/1", "2024-02-01", read)["status"] == "ok" and ran == [None, "2024-01-05"]
    failed = again.sync("cum/1", "2024-03-01", lambda since: 1 / 0)
    assert failed["status"] == "error" and "ZeroDivisionError" in failed["error"] and again.get("cum/1") == "2024-02-01"
    assert again.sync("cum/1", None, read)["status"] == "ok" and again.get("cum/1") == "2024-02-01"
    number = again._last("cum/1")[0]
    assert first.advance("cum/1", "2024-03-05", number) and not again.advance("cum/1", "2024-03-06", number)
    (tmp_path / "marks" / "cum%2F1" / "000000000099").write_text('{"ma')  # a run was lost here
    assert again.get("cum/1") == "2024-03-05" and again.advance("cum/1", "2024-04-01") and first.get("cum/1") == "2024-04-01"


def test_sources_share_a_table_of_marks(spark, tmp_path):
    store = marks.Marks(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "s string, t int")
    taken = {}
    for since in (5, 9):
        for s in ("a", "b"):
            taken[s, since] = store.sync(s, since if s == "a" else 2, lambda m, s=s: incremental.above_mark(df.where(F.col("s") == s), "t", m).count())["status"]
    assert taken == {("a", 5): "ok", ("b", 5): "ok", ("a", 9): "ok", ("b", 9): "skipped"}
