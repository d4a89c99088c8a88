"""The approximate vector index: measured recall, lists that are hot, odd rows, and the quantiser against its definition."""

import numpy as np
import pandas as pd

from evigrid.operators import vectors
from evigrid.plans import search


def exact(ids, x, asked, k=10):
    x = vectors.normalised(np.array(x, float))
    out = {}
    for i in np.flatnonzero(np.isin(ids, asked)):
        score = np.round(x @ x[i], 9)
        score[ids == ids[i]] = -2
        out[int(ids[i])] = [int(j) for j in ids[np.lexsort((ids, -score))][:k]]
    return out


def recall(got, want):
    found = {q: set(g.vec_id) for q, g in got.groupby("query")}
    return sum(len(found.get(q, set()) & set(t)) for q, t in want.items()) / sum(map(len, want.values()))


def test_recall_of_the_table(spark, small):
    table = pd.read_parquet(f"{small}/embeddings.parquet")
    got = search.vector_index_topk(spark, small).toPandas()
    asked = [i for i in table.vec_id if i % 20 == 0]
    want = exact(table.vec_id.to_numpy(), table.embedding.tolist(), asked)
    assert recall(got, want) >= 0.9 and set(got["query"]) == set(asked)
    assert (got.groupby("query")["rank"].max() == 10).all() and (got.vec_id != got["query"]).all()


def clustered(n, size=16, centres=40):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(centres, size)) * 3
    return middle[rnd.integers(0, centres, n)] + rnd.normal(size=(n, size)) * 0.5


def test_clustered_vectors_are_found_in_few_lists(spark):
    x = clustered(3000)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    made = vectors.fit(table, most=1000)  # a part of the rows only
    blocks = vectors.build(table, made)
    asked = table.where("vec_id % 20 = 0")
    got = vectors.search(blocks, made, table, asked).toPandas()
    assert recall(got, exact(np.arange(3000), x, range(0, 3000, 20))) >= 0.9
    assert vectors.scanned_share(blocks, made, asked) < 0.5
    held = np.concatenate([np.frombuffer(r.ids, np.int64) for r in blocks.collect()])
    assert sorted(held.tolist()) == list(range(3000))


def test_odd_rows_and_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_BLOCK", 50)
    x = clustered(200, 5).tolist()
    rows = list(enumerate(x)) + [(1000 + i, x[7]) for i in range(300)]  # more than half of all rows in one list
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] * 5), (2005, [1.0, 2.0]), (None, [1.0] * 5)]
    zero = (2006, [0.0] * 5)
    table = spark.createDataFrame([*rows, *odd, zero], "vec_id long, embedding array<double>")
    made = vectors.fit(table)
    blocks = vectors.build(table, made)
    sizes = [len(r.ids) // 8 for r in blocks.collect()]
    assert sum(sizes) == 501 and max(sizes) <= 50
    got = vectors.search(blocks, made, table, table, k=5).toPandas()
    assert set(got["query"]) == {i for i, _ in rows} | {2006}
    copies = got[got["query"] == 7]
    assert (copies.score == 1).all() and (got[got["query"] == 2006].score == 0).all()
    none = table.limit(0)
    assert vectors.fit(none) is None and vectors.build(none, made).count() == 0 and vectors.search(blocks, made, table, none).count() == 0


def test_codes_measure_what_they_say():
    x = vectors.normalised(clustered(400, 10))
    centres = vectors.k_means(x, 9)
    made = vectors.Quantiser(10, centres, [], 3)
    left = x - centres[vectors.nearest(x, centres)]
    made.words = [vectors.k_means(left[:, g], 256) for g in made.groups()]
    of, codes = made.encode(x)
    for list_ in range(9):
        mine = np.flatnonzero(of == list_)
        told = made.tables(x[:5], list_)
        for i in mine[:4]:
            placed = centres[list_] + np.concatenate([w[c] for w, c in zip(made.words, codes[i])])
            assert np.allclose(((x[:5] - placed) ** 2).sum(1), [sum(t[g, c] for g, c in enumerate(codes[i])) for t in told])
    assert [s.stop - s.start for s in made.groups()] == [4, 4, 2] and (made.lists(x)[:, 0] == of).all()
    assert len(vectors.k_means(np.ones((50, 3)), 5)) == 1


def test_queries_are_sent_by_shards_not_by_lists(spark):
    """What a search shuffles to its lists grows with queries and shards; several parts of queries and of lists find what one finds."""
    rnd = np.random.default_rng(8)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rnd.normal(size=(900, 8)).tolist())], "vec_id long, embedding array<double>")
    made = vectors.fit(table)
    blocks = vectors.build(table, made).cache()
    asked = table.where("vec_id % 9 = 0")
    plan = vectors.search(blocks, made, table, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    found = []
    for shards, vectors_each, most in ((1, 1 << 20, 1 << 20), (3, 1 << 20, 1 << 20), (1, 100, 30)):
        before = vectors.SHARDS, vectors.SHARD_VECTORS, vectors.PARTS, vectors.ASKED_MOST
        vectors.SHARDS, vectors.SHARD_VECTORS, vectors.PARTS, vectors.ASKED_MOST = shards, vectors_each, 1, most
        try:
            found.append(sorted(tuple(r) for r in vectors.search(blocks, made, table, asked).collect()))
        finally:
            vectors.SHARDS, vectors.SHARD_VECTORS, vectors.PARTS, vectors.ASKED_MOST = before
    assert len(found[0]) == 1000 and found[0] == found[1] == found[2]
