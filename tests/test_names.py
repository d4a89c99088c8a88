"""Names of areas: branches of precedence and rules of texts against plain Python, several automata, odd rows."""

import random
import re

import pytest

from evigrid.operators import names

AREAS = [
    ("A1", "Kew Gardens", "Queens", "East Side"), ("A2", "Kew Gardens Hills", "Queens", "East Side"), ("A3", "Red Hook", "Brooklyn", "Harbour Front"), ("A4", "Hook", "Brooklyn", "Harbour Front"), ("A5", "Astoria (Central)", "Queens", "North Shore"),
    ("A6", "Astoria (North)", "Queens", "North Shore"), ("A7", "St. Mary's", "Bronx", None), ("A8", None, "Bronx", "Old Town"), ("A9", "Red Hook", "Staten Island", "Harbour Front"), ("B1", "Elm", None, "Elm Park"),
]
ALIASES = [("astoria", "Astoria (Central)"), ("lic", "Nowhere At All"), ("the hook", "Red Hook"), (None, "Hook"), ("hills", "Kew Gardens Hills"), ("mary", "St. Mary's")]
BOROUGHS = [("queens", "Queens", 0), ("bk", "Brooklyn", 1), ("richmond", "Nobody", 2), ("staten island", "Staten Island", 3), ("the bronx", "Bronx", 4), ("bronx", "Bronx", 5)]


def normal(s):
    return re.sub("[^a-z]+", "", (s or "").lower())


def resolved(query):
    q = (query or "").strip().lower()
    if not q:
        return None
    borough = {k: b for k, b, _ in BOROUGHS}.get(q)
    alias = {k: n for k, n in ALIASES if k}.get(q)
    by_closeness = lambda key: sorted((a for a in AREAS if normal(q) and normal(q) in normal(a[key])), key=lambda a: (abs(len(normal(a[key])) - len(normal(q))), a[0]))
    for branch, hits in (
        ("borough", sorted(a for a in AREAS if borough and a[2] == borough)), ("alias", sorted(a[:1] for a in AREAS if alias and a[1] == alias)), ("exact", sorted(a[:1] for a in AREAS if (a[1] or "").lower() == q)),
        ("part", by_closeness(1)), ("parent", by_closeness(3)),
    ):
        if hits:
            return branch, hits[0][0], len(hits)
    return None


def named(text):
    t = (text or "").lower()
    at = f" {t} "
    for key, _, _ in BOROUGHS:
        if f" {key} " in at and resolved(key):
            return key, 0
    for key in sorted((k for k, _ in ALIASES if k), key=lambda k: (-len(k), k)):
        if key in t and resolved(key):
            return key, 1
    every = sorted({a[1].lower() for a in AREAS if a[1] and len(a[1]) >= 4}, key=lambda k: (-len(k), k))
    for key in every:
        if any(f" {key}{end}" in at for end in " .,?"):
            return key, 2
    for key in every:
        if key in t:
            return key, 3
    return None


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(AREAS, "code string, name string, borough string, parent string"), spark.createDataFrame(ALIASES, "alias string, name string"), spark.createDataFrame(BOROUGHS, "key string, borough string, ord int"),
    )


QUERIES = ["Queens", " BK ", "richmond", "Richmond Hill", "astoria", "LIC", "kew gardens", "KEW GARDENS", "gardens", "ew-gar", "astoria (", "hook", "st marys", "St. Mary's", "harbour", "front", "o", "el", "town", "?!", "", None, "zzz", "elm", "the bronx", "red  hook"]


def test_branches(spark, tables):
    asked = spark.createDataFrame(list(enumerate([*QUERIES, "Queens"])), "id long, query string")
    got = {r.id: (r.branch, r.code, r.n_hits) for r in names.resolve(asked, *tables).collect()}
    assert got == {i: r for i, q in enumerate([*QUERIES, "Queens"]) if (r := resolved(q))} and {r[0] for r in got.values()} == set(names.BRANCHES)
    none = [t.limit(0) for t in tables]
    assert names.resolve(asked, *none).count() == 0 and names.resolve(asked.limit(0), *tables).count() == 0


def test_texts(spark, tables):
    rnd = random.Random(4)
    some = [k for k, *_ in BOROUGHS] + [k for k, _ in ALIASES if k] + [a[1] for a in AREAS if a[1]] + ["queensland", "flood", "red", "hookers", "İstanbul", "near"]
    texts = ["".join(rnd.choice(some) + rnd.choice([" ", " ", ".", ", ", "? ", "-", ""]) for _ in range(rnd.randint(0, 5))) for _ in range(300)]
    texts += [None, "", "Red Hook", "in red hook.", "(red hook)", "Kew Gardens Hills", "in queens", "queens.", "x" * 100_000 + " red hook?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {i: (k[0], k[1], *resolved(k[0])[1:]) for i, t in enumerate(texts) if (k := named(t))}
    for most in (names.NAMES_MOST, 4):  # the second deals the names to several automata
        assert {r.doc_id: (r.key, r.rule, r.code, r.n_hits) for r in names.in_texts(docs, *tables, names_most=most).collect()} == want
    assert {r for _, r, *_ in want.values()} == {0, 1, 2, 3}
    assert names.in_texts(docs, *[t.limit(0) for t in tables]).count() == 0
