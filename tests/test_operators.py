"""Operators by hand-made cases: places, scores, files, text and streams."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.functions import citations, geo, scoring, text
from evigrid.operators import aggregates, raster, spatial, timeseries
from evigrid.plans import records
from evigrid.plans import text as text_plans
from evigrid.sources import manifests, readers, sinks
from evigrid.streaming import events as streams


def test_radius_join_equals_nested_loop(spark):
    rnd = random.Random(3)
    a = [(i, rnd.uniform(-80, 80), rnd.uniform(-179, 179)) for i in range(60)]
    b = [(i, lat + rnd.uniform(-0.3, 0.3), lon + rnd.uniform(-0.3, 0.3)) for i, (_, lat, lon) in enumerate(a * 3)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")

    def metres(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    for r in (500.0, 20_000.0):
        got = {(x.query_id, x.feature_id) for x in spatial.radius_join(frame(a), frame(b), r).collect()}
        assert got == {(p[0], q[0]) for p in a for q in b if metres(p, q) <= r}
    near = {x.query_id: x.feature_id for x in spatial.nearest_any(frame(a), frame(b[:20]), 1000.0).collect()}
    assert near == {p[0]: min(b[:20], key=lambda q: (metres(p, q), q[0]))[0] for p in a}
    missing = spark.createDataFrame([(1, None, 2.0)], "id long, lat double, lon double")
    assert spatial.radius_join(missing, frame(b), 1e5).count() == 0


def test_points_within_radius(spark):
    rows = [("A", 40.7282, -73.7950, 3.0), ("B", 40.7300, -73.7950, 1.0), ("C", 40.7500, -73.7950, 5.0)]
    sites = spark.createDataFrame(rows, "id string, lat double, lon double, severity double")
    here = spark.createDataFrame([(1, 40.7282, -73.7949)], "id long, lat double, lon double")
    found = spatial.radius_join(here, sites, 500.0).join(sites.select(F.col("id").alias("feature_id"), "severity"), "feature_id")
    row = found.agg(F.count("*").alias("n"), *aggregates.declared({"most": ("max", "severity")}), F.min_by("feature_id", "distance_m").alias("nearest")).first()
    assert (row.n, row.most, row.nearest) == (2, 3.0, "A")
    empty = sites.where("false").agg(*aggregates.declared({"n": ("count", "severity"), "s": ("sum", "severity")})).first()
    assert empty.n is None and empty.s is None
    with pytest.raises(ValueError):
        aggregates.declared({"x": ("median", "severity")})


def test_geometry(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    rings = [[(float(x), float(y)) for x, y in ring] for ring in (outer, hole)]
    cases = [(3.0, 3.0, True, rings), (1.5, 1.5, False, rings), (5.0, 1.0, False, rings)]
    rows = spark.createDataFrame(cases, "x double, y double, inside boolean, rings array<array<struct<x:double,y:double>>>")
    got = rows.select("inside", geo.point_in_rings(F.col("x"), F.col("y"), F.col("rings")).alias("got"), geo.ring_area(F.col("rings")[0]).alias("area"), geo.ring_distance(F.col("x"), F.col("y"), F.col("rings")[0]).alias("d")).collect()
    assert all(r.inside == r.got and r.area == 16.0 for r in got) and [r.d for r in got] == [1.0, 1.5, 1.0]
    x, y = geo.lambert_feet(F.lit(40 + 10 / 60), F.lit(-74.0))
    origin = spark.range(1).select(F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), geo.utm_zone(F.lit(40.7), F.lit(-74.0)).alias("z")).first()
    assert origin.x == pytest.approx(984250.0, abs=0.01) and origin.y == pytest.approx(0.0, abs=0.01) and origin.z == "18N"


def test_scores(spark):
    c = F.col("v")
    rows = spark.createDataFrame([(0.5,), (2.0,), (9.0,), (12.0,), (None,)], "v double")
    got = rows.select(scoring.band("hand", c).alias("h"), scoring.band("twi", c).alias("t"), scoring.tier(c).alias("k"), scoring.tier(F.lit(0.0), F.lit(True)).alias("f")).collect()
    assert [r.h for r in got] == [1.0, 0.66, 0.33, 0.0, 0.0] and [r.t for r in got] == [0.0, 0.0, 0.33, 1.0, 0.0]
    assert [r.k for r in got] == [3, 1, 1, 1, 0] and {r.f for r in got} == {2}


def test_text_rules(spark):
    cases = ["Projected rise is 2 ft.", "No forecast data is available.", "Projected rise by 2050.", "It will flood.", "It may flood; it will flood."]
    rules = {r.name: r for r in text.RULES}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select(text.passes(rules["projection_has_horizon"], F.col("t")).alias("p"), text.passes(rules["no_bare_flood_claim"], F.col("t")).alias("f")).collect()
    assert [r.p for r in got] == [False, True, True, True, True] and [r.f for r in got] == [True, True, True, False, True]
    questions = {"flood risk at 250 Broadway": "250 Broadway", "Is 80 Pioneer Street at risk of flooding?": "80 Pioneer Street", "Coney Island": "Coney Island", "what's the flood risk for Red Hook": "Red Hook", "flood": "flood"}
    got = spark.createDataFrame([(q,) for q in questions], "q string").select("q", text.address(F.col("q")).alias("a")).collect()
    assert {r.q: r.a for r in got} == questions


def test_chunks(spark):
    rnd = random.Random(1)
    texts = [" ".join("w" * rnd.randint(1, 300) + "." for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.chunks(F.col("t")).alias("c")).collect()
    for r in got:
        want = []
        for s in texts[r.i].split():
            if want and len(want[-1]) + 1 + len(s) <= 700:
                want[-1] += " " + s
            else:
                want.append(s)
        assert r.c == want


def test_files(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-73.79, 40.72]}, "properties": {"name": "near"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}, "properties": {"name": "p"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}, "properties": {}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(shape))
    got = readers.geojson(spark, f"file://{tmp_path}/a.geojson", ["name"]).orderBy("ord").collect()
    assert (got[0].lat, got[0].lon, got[0].name) == (40.72, -73.79, "near") and len(got[1].rings) == 1 and len(got[2].rings) == 2 and got[1].rings[0][1].x == 2.0
    assert readers.points_only(readers.geojson(spark, f"file://{tmp_path}/a.geojson")).count() == 1
    (tmp_path / "p.csv").write_text("site_id;latitude;longitude\nA;40.1;-73.0\nB;x;1\nC;;\n")
    assert [r.site_id for r in readers.csv_points(spark, f"file://{tmp_path}/p.csv", sep=";").collect()] == ["A"]
    (tmp_path / "stub.tif").write_text("version https://git-lfs.github.com/spec/v1\noid 1\n")
    with pytest.raises(FileNotFoundError):
        readers.not_a_stub(spark, f"file://{tmp_path}/stub.tif")
    rows = spark.createDataFrame([(1, 40.0, -73.0), (2, 41.0, -73.0)], "id long, lat double, lon double")
    at = f"file://{tmp_path}/register"
    assert sinks.append_new(rows.limit(1), at) == 1 and sinks.append_new(rows, at) == 2 and sinks.append_new(rows, at) == 2
    sinks.feature_lines(rows, f"file://{tmp_path}/out", ["id"])
    lines = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sorted(x["properties"]["id"] for x in lines) == [1, 2] and lines[0]["geometry"]["type"] == "Point"


def test_fetch_failures_are_rows(spark):
    def fetch(row):
        if row["query_id"] == 2:
            raise RuntimeError("down")
        return None if row["query_id"] == 3 else {"data": {"score": 7}, "items": [{"name": "x"}]}

    got = readers.fetched(spark.range(1, 4).withColumnRenamed("id", "query_id"), fetch)
    rows = {r.query_id: r for r in got.withColumn("score", readers.json_path(F.col("value"), "items[0].name")).collect()}
    assert rows[1].status == "ok" and rows[1].score == "x" and rows[2].error == "RuntimeError: down" and rows[3].status == "offline"


def test_manifests():
    with pytest.raises(ValueError):
        manifests.Manifest.parse({"id": "Bad", "title": "", "kind": "live", "role": "r", "adapter": "a"})
    with pytest.raises(ValueError):
        manifests.Manifest.parse({"id": "ok", "title": "", "kind": "live", "role": "r", "adapter": "a", "extra": 1})
    assert manifests.Manifest.parse({"id": "ok", "title": "t", "kind": "live", "role": "r", "adapter": "a"}).tier is None


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/in")
    source = lambda: streams.read(spark, f"file://{tmp_path}/in")

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        query.awaitTermination(120)
        return spark.table(name)

    got = {(r.day.isoformat(), r.user_id): r.n for r in run(streams.daily(source(), "40 days"), "daily", "complete").collect()}
    want = {(r.d.isoformat(), r.user_id): r["count"] for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "user_id").count().collect()}
    assert got == want
    peaks = {r.user_id: r.p for r in run(streams.running_peak(source()), "peaks", "append").groupBy("user_id").agg(F.max("peak").alias("p")).collect()}
    assert peaks == {r.user_id: r.p for r in events.groupBy("user_id").agg(F.max("value").alias("p")).collect()}
    assert run(streams.deduplicated(source(), "40 days"), "once", "append").count() == events.select("event_id").distinct().count()


def test_raster_areas_and_outlines(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    for _ in range(20):
        wet = rnd.random((12, 9)) < 0.5
        label, seen = raster.labelled(wet), {}
        todo = {tuple(p) for p in np.argwhere(wet)}
        while todo:
            group, front = set(), [todo.pop()]
            while front:
                r, c = front.pop()
                group.add((r, c))
                near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & todo
                todo -= near
                front += near
            names = {label[p] for p in group}
            assert len(names) == 1 and not names & set(seen)
            seen[names.pop()] = group
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (2.0, 1.0), (2.01, 2.0), (0.0, 2.0), (0.0, 0.0)]
    got = spark.createDataFrame([(line,)], "ring array<struct<x:double,y:double>>").transform(raster.simplified, "ring", 0.1).first().ring
    assert [(p.x, p.y) for p in got] == [(0.0, 0.0), (2.0, 0.0), (2.01, 2.0), (0.0, 2.0), (0.0, 0.0)]


def test_similar_vectors_in_blocks(spark, tmp_path, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    some = rnd.normal(size=(90, 8)).astype(np.float32)
    some[30:40] = some[20]  # ties go to the smaller id
    rows = [(i, some[i].tolist(), int(i % 7)) for i in range(90)] + [(1000, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = some.astype(float) / np.linalg.norm(some.astype(float), axis=1, keepdims=True)
    cosine = (unit @ unit.T).round(9)
    want = {(q, *min_) for q in range(0, 90, 5) for min_ in [(v, p) for p, v in enumerate(sorted((v for v in range(90) if v != q), key=lambda v: (-cosine[q, v], v))[:6], 1)]}
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("query vectors went through the driver"))
    for asked, searched in ((256, 1024), (4, 7)):
        monkeypatch.setattr(text_plans, "ASKED", asked)
        monkeypatch.setattr(text_plans, "SEARCHED", searched)
        found = text_plans.similar(spark, str(tmp_path), 5, 6)
        assert "CartesianProduct" in found._jdf.queryExecution().toString()
        assert {(r.query, r.vec_id, r.place) for r in found.collect()} == want


def test_sentences_and_chunks_of_every_document(spark, tiny, tmp_path):
    import re

    given = spark.read.parquet(f"{tiny}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    given.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, r.text, r.lang) for r in given.collect()]
    assert {lang for _, _, lang in docs} > {"en", None}
    cut = lambda t: [s for s in (x.strip(" ") for x in re.sub(r"([.!?])\s+", "\\1\x1e", t, flags=re.ASCII).split("\x1e")) if s]
    want = sorted((i, len(cut(t)), max(map(len, cut(t)), default=None)) for i, t, _ in docs if t is not None)
    got = [tuple(r) for r in text_plans.sentence_split(spark, str(tmp_path)).collect()]
    assert len(got) == len(docs) and sorted(r for r in got if r[1] is not None) == want
    chunked = {}
    for r in text_plans.chunk_documents(spark, str(tmp_path)).collect():
        chunked.setdefault(r.doc_id, []).append((r.chunk, r.text))
    assert {i: " ".join(t for _, t in sorted(c)) for i, c in chunked.items()} == {i: " ".join(cut(t)) for i, t, _ in docs if t and cut(t)}


def test_sentences_keep_the_digits_at_their_ends(spark):
    """Each sentence but the first was trimmed of the digits of its own number, and of no blanks."""
    given = "Zero. 19.37.233.111! 2381 houses in 2012 ? 33"
    got = spark.createDataFrame([(given,)], "x string").select(text.sentences(F.col("x"))).first()[0]
    assert got == ["Zero.", "19.37.233.111!", "2381 houses in 2012 ?", "33"]
    assert spark.createDataFrame([("  One.  Two. ",)], "x string").select(text.sentences(F.col("x"))).first()[0] == ["One.", "Two."]


def test_alerts_of_the_last_day_of_each_user(spark, tmp_path):
    rows = [(1, 1, "view", "2024-01-20 10:00:00"), (2, 1, "alarm", "2024-01-20 11:00:00"), (3, 1, "flood", "2024-02-03 09:00:00"), (4, 1, "view", "2024-02-03 23:59:59"), (5, 2, "alarm", "2024-01-20 00:00:00"), (6, 2, "view", "2024-01-21 00:00:00")]
    rows += [(10 + i, 3, f"k{i}", "2024-03-31 12:00:00") for i in range(4)] + [(20, 4, "old", "2023-12-20 12:00:00"), (21, 4, "new", "2024-01-20 12:00:00"), (30, 5, "alarm", None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.line for r in records.alert_narrative(spark, str(tmp_path)).collect()}
    assert got == {1: "alert: flood", 2: "no alert", 3: "4 alerts: k0, k1, k2, ...", 4: "alert: new", 5: "no alert"}


def test_claims_without_citation():
    both = "- 20 Coffey St. new building. [permits].\nThe majority of projects fall within the zone and involve 63 total permits."
    cases = {
        "There were **63** requests within 300 m of the address.": ["There were 63 requests within 300 m of the address."],
        "There were **63** requests [albany_311] within **300 m** of it.": [],
        "Projects stand at 62 Imlay St, 570 Smith St and 206 Van Brunt Street.": [],
        "- **20 Coffey St (BBL 3-00589-0003).** new building, issued 11/26/2025; class: 3. [permits]": [],
        "- **20 Coffey St.** new building, issued 2025.": ["- 20 Coffey St. new building, issued 2025."],
        both: ["The majority of projects fall within the zone and involve 63 total permits."],
        "Three of 10 sites. Of 40 sites two.": ["Of 40 sites two."],
        "": [],
    }
    assert {k: citations.uncited_spans(k) for k in cases} == cases
    assert citations.uncited_spans(None) == []


def test_nearest_at_any_distance(spark):
    rnd = random.Random(5)
    features = [(i, 40.7 + rnd.gauss(0, 0.01), -74 + rnd.gauss(0, 0.01)) for i in range(200)] + [(200, -33.9, 179.99), (201, 89.9, 10.0)]
    queries = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)] + [(60, -33.9, -179.99), (61, None, 1.0), (62, 90.0, 180.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")

    def metres(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(h, 1)))

    got = {x.query_id: x.feature_id for x in spatial.nearest_any(frame(queries), frame(features), 500.0).collect()}
    assert got == {p[0]: min(features, key=lambda q: (metres(p, q), q[0]))[0] for p in queries if p[1] is not None}
    assert spatial.nearest_any(frame(queries), frame([]), 500.0).count() == 0


def test_nearest_n_of_places_equals_sorting(spark):
    """Rows at one place, fewer than n within a part of the radius, and none at all."""
    rnd = random.Random(9)
    at = lambda k: (40 + rnd.randrange(k) / 500, -74 + rnd.randrange(k) / 500)
    a, b = [(i, *at(12)) for i in range(60)] + [(60, 10.0, 10.0), (61, None, 1.0)], [(i, *at(8)) for i in range(150)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
    metres = {(x.query_id, x.feature_id): x.distance_m for x in spatial.radius_join(frame(a), frame(b), 1500.0).collect()}
    expected = {(q, f) for q, *_ in a for _, f in sorted((m, f) for (p, f), m in metres.items() if p == q)[:4]}
    found = spatial.back(frame(a), spatial.nearest_n(frame(a), frame(b), 4, 1500.0), "inner")
    assert {(x.id, x.feature_id) for x in found.collect()} == expected and expected


def test_zones_hold_their_edges(spark, tmp_path):
    """Places on the edges of the diamonds: the rule of SQL, |x| + |y| <= half, tells."""
    from evigrid.plans import spatial as places
    from compare import difference

    spark.range(32_000, 34_000).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(0, 60_000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("pip_flag", "pip_max_class"):
        assert difference(spark, str(tmp_path), *places.QUERIES[name]) == ""


def test_traced_rings():
    grid = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]], bool)
    rings = raster.traced(raster.labelled(grid) == raster.labelled(grid)[0, 0])
    area = lambda ring: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:])) / 2
    assert sorted(map(area, rings)) == [-1, 9]
    assert all(r[0] == r[-1] for r in rings)


def test_interpolation_is_by_known_hours(spark):
    rows = [(1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 00:50:00", 4.0), (1, "2024-01-01 03:00:00", 9.0), (1, "2024-01-01 02:00:00", None), (2, "2024-01-01 05:00:00", 1.0), (3, "2024-01-01 05:00:00", None)]
    frame = spark.createDataFrame(rows, "k long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = [(x.k, x.hour.hour, x.v, x.filled) for x in timeseries.interpolated(frame, "k").orderBy("k", "hour").collect()]
    assert got == [(1, 0, 3.0, False), (1, 1, 5.0, True), (1, 2, 7.0, True), (1, 3, 9.0, False), (2, 5, 1.0, False)]


def test_tiles_are_read_some_at_a_time(spark):
    """More tiles than are held at once, some of their cells without values, give what each gives alone."""
    n = 2 * raster.TILES + 3
    cells = spark.createDataFrame([(4 * t + k // 4, k % 4, None if (t + k) % 7 == 0 else float((t * 5 + k * 3) % 10)) for t in range(n) for k in range(16)], "row long, col long, value double")
    tiles = raster.tiled(cells, 4).coalesce(1)
    seen = [len(g) for g in raster._grids(tiles.orderBy("tile_row").toArrow().combine_chunks().to_batches()[0], 4)]
    assert seen == [3] * n
    got = {r.tile_row: (r.share, r.areas, r.largest) for r in raster.areas(tiles, 4, 6.0).collect()}
    for t in (0, raster.TILES, n - 1):
        wet = np.array([(t + k) % 7 != 0 and (t * 5 + k * 3) % 10 >= 6 for k in range(16)]).reshape(4, 4)
        _, size = np.unique(raster.labelled(wet)[wet], return_counts=True)
        assert got[t] == (wet.mean(), len(size), size.max())
    assert sum(r.cells for r in raster.outlines(tiles, 4).collect()) == sum((t + k) % 7 != 0 and (t * 5 + k * 3) % 10 > 0 for t in range(n) for k in range(16))


def test_flow_is_joined_by_shuffles(spark):
    """No table of cells is broadcast, small as it may look: each round of the doubling would send one through the driver."""
    from evigrid.operators import terrain

    cells = spark.createDataFrame([(r, c, float(40 - r - c)) for r in range(12) for c in range(5)], "row long, col long, value double")
    out = terrain.indices(cells, 30.0, 5)
    for df in (terrain.directions(cells), out):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 60
