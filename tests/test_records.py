"""The records data source: filters in the plan and in the request, byte ranges, odd lines, limits with ties."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from evigrid.sources.records import RecordsReader, records
from evigrid.sources import shared

FIELDS = "id bigint, lat double, lon double, name string, v double, ok boolean"


@pytest.fixture(scope="module")
def folder(spark):
    path = shared.new_path(spark, "records")
    rows = spark.range(3000).selectExpr("id", "40.5D + id / 10000D AS lat", "-74D AS lon", "concat('n', id) AS name", "CASE WHEN id % 10 = 3 THEN NULL ELSE CAST(id % 7 AS DOUBLE) END AS v", "id % 2 = 0 AS ok")
    rows.repartition(3).write.json(path)
    return path


def test_filters_go_to_the_source(spark, folder):
    found = records(spark, folder, FIELDS, circle=(40.6, -74.0, 2000.0)).where("v >= 2 AND id IN (1000, 1001, 1002, 1003, 2000) AND name LIKE 'n1%' AND name LIKE '%2' AND v + 1 > 0 AND ok = true")
    plan = found._jdf.queryExecution().executedPlan().toString()
    text = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert all(x in pushed for x in ("GreaterThanOrEqual(v,2.0)", "StringStartsWith(name,n1)", "In(id", "EqualTo(ok,true)")) and "EndsWith" not in pushed
    condition = next(line for line in text.splitlines() if line.startswith("Condition"))
    assert "EndsWith" in condition and "v" in condition and "StartsWith(name" not in condition and "IN (" not in condition and "BatchScan" in plan
    assert [r.id for r in found.collect()] == []  # 1002 % 7 = 1
    more = records(spark, folder, FIELDS, circle=(40.6, -74.0, 2000.0)).where("v > 1 AND name LIKE '%4'")
    want = [i for i in range(3000) if abs(i / 10000 - 0.1) * 111194.9266 <= 2000 and i % 10 == 4 and i % 7 > 1]
    assert sorted(r.id for r in more.collect()) == want and want


def test_every_line_is_read_once(spark, folder):
    for split in (500, 7919, 1 << 25):
        got = records(spark, folder, FIELDS, split_bytes=split)
        assert sorted(r.id for r in got.select("id").collect()) == list(range(3000))
    assert records(spark, folder, FIELDS, split_bytes=20_000).rdd.getNumPartitions() > 3


def test_limits_with_ties_and_nulls(spark, folder):
    every = [(i, None if i % 10 == 3 else float(i % 7)) for i in range(3000)]
    for descending in (False, True):
        key = lambda r: ((r[1] is None) == descending, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0])
        for split in (3000, 1 << 25):
            got = [(r.id, r.v) for r in records(spark, folder, FIELDS, order="v", descending=descending, limit=700, split_bytes=split).collect()]
            assert sorted(got, key=repr) == sorted(sorted(every, key=key)[:700], key=repr)
    with pytest.raises(ValueError):
        records(spark, folder, FIELDS, limit=5)


def test_odd_lines(spark, tmp_path):
    lines = ['{"id": 1, "lat": "40.5", "lon": -74, "v": "x", "ok": "true", "name": 5}', "", "no json", "[1]", '{"id": 2.5, "v": 1e400, "extra": 1}', '{"id": 3, "lat": null, "lon": -74.0, "name": {"a": 1}}', '{"id": "4", "lat": 40.5, "lon": -74.0, "v": 2, "ok": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("")
    got = {r.id: tuple(r)[1:] for r in records(spark, f"file://{tmp_path}", FIELDS, split_bytes=30).collect()}
    assert got == {1: (40.5, -74.0, "5", None, True), None: (None, None, None, float("inf"), None), 3: (None, -74.0, '{"a": 1}', None, None), 4: (40.5, -74.0, None, 2.0, None)}
    assert sorted(r.id for r in records(spark, f"file://{tmp_path}", FIELDS, circle=(40.5, -74.0, 10.0)).collect()) == [1, 4]
    (tmp_path / "none").mkdir()
    assert records(spark, f"file://{tmp_path}/none", FIELDS).count() == 0


def test_a_service_is_asked_for_what_is_wanted(spark):
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            rows = [{"id": i, "v": i / 2, "name": f"n{i}"} for i in range(25)]
            begin = int(q.get("$offset", 0))
            body = [{"count": "25"}] if "$select" in q else rows[begin : begin + int(q["$limit"])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = records(spark, f"http://127.0.0.1:{server.server_port}/x", "id bigint, v double, name string", circle=(40.5, -74.0, 100.0), page=10).where("v >= 1.5 AND name = 'it''s'")
        assert found.count() == 25  # the service is trusted with what was pushed
        assert {q["$offset"] for q in asked if "$offset" in q} == {"0", "10", "20"}
        want = "within_circle(lat, lon, 40.5, -74.0, 100.0) AND v IS NOT NULL AND name IS NOT NULL AND v >= 1.5 AND name = 'it''s'"
        assert all(q["$where"] == want for q in asked)
        asked.clear()
        assert records(spark, f"http://127.0.0.1:{server.server_port}/x", "id bigint, v double", order="v", descending=True, limit=12, page=10).count() == 12
        assert sorted((q["$order"], q["$limit"], q["$offset"]) for q in asked) == [("v DESC", "10", "0"), ("v DESC", "2", "10")]
    finally:
        server.shutdown()


def test_filters_that_are_left_to_spark(spark):
    from pyspark.sql.datasource import EqualTo, Not, StringEndsWith
    from pyspark.sql.types import StructType

    reader = RecordsReader(StructType.fromDDL("a bigint, b string"), {"url": "file:///none"})
    kept = [Not(EqualTo(("a",), 1)), StringEndsWith(("b",), "x"), EqualTo(("c", "d"), 1)]
    assert list(reader.pushFilters([*kept, EqualTo(("a",), 1)])) == kept and reader.pushed == [("a", "=", 1)]
