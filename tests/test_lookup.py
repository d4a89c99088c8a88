"""Names with mistakes: all pairs by the plain edit distance, short and hot names, the order of branches, odd rows."""

import random
import re

from evigrid.operators import lookup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def allowed(q):
    return 0 if len(q) < 4 else 1 if len(q) < 8 else 2


def changed(word, rnd):
    w = list(word)
    for _ in range(rnd.randint(0, 3)):
        i = rnd.randrange(len(w) + 1)
        kind = rnd.choice("idr")
        w[i : i + (kind != "i")] = [] if kind == "d" else [rnd.choice("abcxyz ")]
    return "".join(w).strip()


def test_all_names_within_the_edits(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 20, 40) for _ in range(14)] + ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaaaa", "red hook", "é漢字 straße"]
    names = sorted({re.sub(" +", " ", w) for w in words})
    queries = sorted({re.sub(" +", " ", changed(w, rnd)) for w in names for _ in range(3)} - {""})
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows + rows[:5]], "s string")
    got = {(r.q, r.name, r.distance) for r in lookup.near_names(frame(queries), frame(names)).collect()}
    want = {(q, n, d) for q in queries for n in names if (d := distance(q, n)) <= allowed(q)}
    assert got == want and len({q for q, _, d in want if d == 2}) > 20
    assert lookup.near_names(frame(queries), frame(names).limit(0)).count() == 0


RECORDS = [
    (1, "Downing Street 10", 51.5, -0.1, "gb"), (2, "Downing Street 10", 40.7, -74.0, "us"), (3, "Main Street", 34.0, -118.0, "us"), (4, "Main Street", 40.75, -73.95, "US"), (5, "Main Street", 40.71, -73.9, "us"),
    (6, "Far Away Road", 10.0, 10.0, "us"), (7, "Rue de Lyon", 45.7, 4.8, "fr"), (8, None, 40.7, -74.0, "us"), (None, "Main Street", 40.7, -74.0, "us"), (9, "Maine Street", None, None, "us"), (10, "Elm", 40.7, -74.0, None),
]
ASKED = [
    (1, "downing street 10", None, "region", 2, 0), (2, "Downing Streat 10", "is it flooded at Downing Street 10, London", "abroad", None, None), (3, "main  street!", None, "region", 4, 0), (4, "Mian Street", None, "region", 4, 2),
    (5, "Maine Street", None, "region", 4, 1), (6, "far away raod", None, "national", 6, 2), (7, "Rue de Lyon", None, "none", None, None), (8, "rue de lyon", "how is it, in France", "abroad", None, None), (9, None, None, "none", None, None),
    (10, "?!", None, "none", None, None), (11, "elm", None, "none", None, None), (12, "Main Street", "nothing like it, in Paris", "region", 4, 0), (3, "main street", None, "region", 4, 0),
]


def test_order_of_branches(spark):
    records = spark.createDataFrame(RECORDS, "record_id long, name string, lat double, lon double, country string")
    asked = spark.createDataFrame([a[:3] for a in ASKED], "id long, text string, hint string")
    got = lookup.resolve(asked, records, (-74.1, 40.6, -73.8, 40.8)).collect()
    plain = lambda rows: sorted(rows, key=repr)
    want = [(a, *rest) for a, _, _, *rest in ASKED]
    # The best hit of "Main Street" is a record of the country (the one with the least id), so that naming Paris does not rule it out.
    assert plain((r.id, r.branch, r.record_id, r.distance) for r in got) == plain(want)
    assert lookup.resolve(asked, records.limit(0), (-74.1, 40.6, -73.8, 40.8)).where("branch IN ('region', 'national')").count() == 0


def test_one_name_of_very_many_records(spark):
    """A name that all records and queries share is looked up once; no pairs of records and queries are made."""
    records = spark.range(20_000).selectExpr("id AS record_id", "'Same Place' AS name", "40.7D AS lat", "-74.0D AS lon", "'us' AS country")
    asked = spark.range(20_000).selectExpr("id", "'same plaace' AS text", "CAST(NULL AS STRING) AS hint")
    got = lookup.resolve(asked, records, (-74.1, 40.6, -73.8, 40.8))
    assert got.where("branch = 'region' AND record_id = 0 AND distance = 1").count() == 20_000
