"""Near duplicates by sketches, and what both set joins share: brute force, hot buckets, very long texts, properties of the sketch."""

import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from test_corpus import bag, number
from test_corpus import classes as alnum_classes

from evigrid.llm import chosenpath, setjoin, sketching
from evigrid.llm.anchors import identified
from evigrid.llm.common import ALNUM, SPACED
from evigrid.llm.setjoin import Shingles

TWO_WORDS = Shingles(2, SPACED.tobytes())


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def components(texts):
    """doc_id, set size, smallest doc_id that links reach, of each text."""
    sets, root = [shingle_set(t) for _, t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return [(doc, len(sets[i]), ids.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(texts)]


def test_near_duplicates(spark, docs, texts, none):
    want = bag(components(texts))
    for options in ({}, {"bucket_most": 2, "block": 2, "block_shingles": 50}):  # the second deals buckets and groups in many blocks
        got = sketching.near_duplicates(docs, **options).toPandas()
        assert bag((number(r.doc_id), r.n, number(r.class_id)) for r in got.itertuples()) == want
    assert sketching.near_duplicates(none).count() == 0
    one = sketching.one_of_each(docs)
    kept = [(number(r.doc_id), r.text) for r in one.toPandas().itertuples()]
    assert one.columns == docs.columns and all(doc == root for doc, _, root in components(kept) if doc is not None)


def test_near_duplicates_of_the_table(spark, small):
    table = pd.read_parquet(f"{small}/documents.parquet")
    got = sketching.op13(spark, small).toPandas()
    want = components(list(zip(table.doc_id.tolist(), table.text)))
    assert bag(zip(got.doc_id, got.n_shingles, got.component_id, got.kept)) == bag((d, n, c, d == c) for d, n, c in want) and (~got.kept).sum() > 20


def variants(n, seed, words=60):
    """Texts about the border: copies of one text with a growing number of changed words, and others with half of its words."""
    rnd = random.Random(seed)
    base, out = [f"b{i}" for i in range(words)], []
    for i in range(n):
        w = list(base)
        for at in rnd.sample(range(words), rnd.choice([1, 2, 3, 4, 5, 8, 20])):
            w[at] = f"x{i}y{at}"
        out.append((i, " ".join(w)))
    return out


def test_links_about_the_border(spark):
    texts = variants(300, 1)
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert bag((r.doc_id, r.n, r.class_id) for r in sketching.near_duplicates(table, bucket_most=50, block=40).collect()) == bag(components(texts))
    assert bag((r.doc_id, r.class_id, r.n_links) for r in chosenpath.join(table, bucket_most=50, block=40).collect()) == bag(x[:3] for x in alnum_classes(texts))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc ", max_size=60), min_size=1, max_size=8))
def test_every_coordinate_is_filled(texts):
    sets = TWO_WORDS.sets(pa.array(texts))
    found, rounds = sketching.sketch(sets)
    assert rounds <= 2 * sketching.SKETCH and ((found == sketching._EMPTY).all(1) == (sets.n == 0)).all() and ((found == sketching._EMPTY).any(1) == (sets.n == 0)).all()
    again, _ = sketching.sketch(TWO_WORDS.sets(pa.array(texts[::-1])))
    assert (again[::-1] == found).all()


def test_coordinates_agree_as_often_as_sets():
    for words, similarity in ((2000, 0.8), (100, 0.8), (12, 0.8), (400, 0.5), (30, 0.2)):
        shared = round(2 * words * similarity / (1 + similarity))
        rows = []
        for i in range(400):
            own = [[f"{i}{side}{k}" for k in range(words - shared)] for side in "ab"]
            rows += [" ".join(f"{i}s{k} {w}" for k, w in enumerate(o)) for o in ([*(f"{i}c{k}" for k in range(shared)), *x] for x in own)]
        sets = TWO_WORDS.sets(pa.array(rows))
        found, _ = sketching.sketch(sets)
        real = np.mean([len(a & b) / len(a | b) for a, b in ((set(sets.shingles[sets.doc == 2 * i]), set(sets.shingles[sets.doc == 2 * i + 1])) for i in range(40))])
        agree = (found[::2] == found[1::2]).mean(1)
        assert abs(agree.mean() - real) < 0.01 and agree.std() < 1.2 * np.sqrt(real * (1 - real) / sketching.SKETCH)


def test_no_task_holds_a_large_bucket(spark, monkeypatch):
    """Thousands of texts with one common shingle, or with three of four, and no links: buckets are split, or dealt in blocks."""
    n, most = 3000, 200
    monkeypatch.setattr(chosenpath, "ALIKE", 0.9)  # groups of texts that look alike are not the subject here
    for text in ("all rights reserved by the w{}", "all rights reserved by the author and w{}"):
        table = spark.createDataFrame([(i, text.format(i)) for i in range(n)], "doc_id long, text string").repartition(6)
        shingles = Shingles(5, ALNUM.tobytes())
        rows, runs = identified(table), chosenpath.runs_needed()
        levels = chosenpath.filters(rows, shingles, 0.8, runs, most)
        dealt = chosenpath.buckets(rows, shingles, 0.8, runs, levels).where("part >= 0")
        held = max((np.unique(np.frombuffer(b"".join(r.key for r in part), np.uint64), return_counts=True)[1].max() for part in groups(dealt.collect())), default=0)
        assert held <= 2 * most, held
        assert chosenpath.candidate_trees(rows, shingles, 0.8, 0.9999, most).count() == 0
    assert len(levels) == 3 and len(levels[-1][1])  # the second kind of texts is too large at the deepest level


def groups(rows):
    by = {}
    for r in rows:
        by.setdefault(r.part, []).append(r)
    return by.values()


def test_growth_without_links(spark):
    """Texts with a common shingle take time in proportion to their number."""
    taken = []
    for n in (1500, 6000):
        table = spark.createDataFrame([(i, f"all rights reserved by the w{i}") for i in range(n)], "doc_id long, text string").repartition(4)
        begin = time.perf_counter()
        assert chosenpath.join(table).where("n_links > 0").count() == 0
        taken.append(time.perf_counter() - begin)
    assert taken[1] < 6 * taken[0]


def test_blocks_are_bounded_by_shingles(spark):
    """Twelve texts of 3,000 words are one block by their number, and six by their shingles; all are found linked."""
    texts = [(i, " ".join(f"w{k}" for k in range(3000)) + f" end{i}") for i in range(12)]
    rows, shingles = identified(spark.createDataFrame(texts, "doc_id long, text string")), Shingles(5, ALNUM.tobytes())
    members = chosenpath.set_ids(rows, shingles)
    trees = members.selectExpr("sid AS u").crossJoin(members.selectExpr("min(sid) AS v"))
    for most in (1 << 20, 6000):
        got = setjoin.linked(rows, members, trees, shingles, 0.8, block_shingles=most).collect()
        assert {(r.n_links, r.class_id) for r in got} == {(11, 0)}
        told = setjoin.verify(rows, members, setjoin.components(trees, "t"), shingles, 0.8, block_shingles=most).where("other IS NULL").count()
        assert told == 12 if most > 6000 else told > 12  # each set is told of by each pair of blocks that it has links in
