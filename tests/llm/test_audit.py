"""The audit of filters, and whitening: brute force in plain Python and NumPy, edge cases and SQL."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import difference

from evigrid.llm import interactions, whitening
from evigrid.llm.common import SPACED, TextBlock

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(text, earlier):
    words = WORD.findall(text)
    tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)
    return {f for f, t in zip("ABCDE", tests) if t}


def audited(rows, judged):
    """rows: doc_id, text, part; judged: (doc_id, good, toxic) of the labels."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good, toxic = ({d for d, *x in judged if x[i] == 1} for i in (0, 1))
    each = [(part or "", doc, failing(text or "", doc is not None and doc > first[text or ""])) for doc, text, part in rows]
    out = {}
    for part in {p for p, *_ in each}:
        mine, shares = [(d, f) for p, d, f in each if p == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine), sum(d in good for d in gone), sum(d in toxic for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shares[row[-1]]
    return {(*k, *v) for k, v in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark, docs, none):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    judged = [(0, 1, 0), (0, 0, 1), (1, None, None), (3, 1, 1), (10_000, 1, 0), (None, 1, 1), (10_005, 0, 1), (99_999, 1, 1)]
    labels = spark.createDataFrame(judged, "doc_id long, quality int, toxic int")
    got = interactions.audit(docs, labels)
    assert got.columns == AUDIT and {tuple(r) for r in got.collect()} == audited(rows, [j for j in judged if j[0] is not None])
    copies = [(i, "same text", "hot") for i in range(500)] + [(None, "same text", None), (7, "same text", "hot"), (7, "same text", "")]
    assert {tuple(r) for r in interactions.audit(spark.createDataFrame(copies, "doc_id int, text string, source string"), labels).collect()} == audited(copies, [j for j in judged if j[0] is not None])
    assert interactions.audit(none, labels).count() == 0
    assert interactions.audit(docs, labels.limit(0)).count() == got.count()


def test_audit_sql(spark, small):
    assert difference(spark, small, interactions.op11, interactions.OP11_SQL) == ""


def test_distinct_words_whose_hashes_collide():
    texts = ["a b a bb c", "", "x", "é é e x x", "aa bb cc aa"]
    for same in (None, lambda self, lower=False: np.zeros(len(self.starts), np.uint64)):
        words = TextBlock(pa.array(texts)).words(SPACED)
        if same:
            words.hashes = same.__get__(words)
        assert interactions.distinct_words(words).tolist() == [len(set(WORD.findall(t))) for t in texts]


# ---------------------------------------------------------------- whitening


def whitened(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    z = fit - total / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ turn[:, ::-1], values[::-1]


def judged(got, ids, vectors):
    n, deviation, projected, values = whitened(vectors)
    shown = min(16, len(values))
    assert got.groupby("vec_id").component.apply(lambda c: sorted(c) == list(range(1, shown + 1))).all() and set(got.n) == {n} and len(got) == len(ids) * shown
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert got[got.component == 1].set_index("vec_id").deviation.loc[ids].tolist() == deviation.tolist()
    want = projected[:, :shown] / np.sqrt(values[:shown])
    assert np.allclose(table * np.sign((table * want).sum(0)), want, atol=1e-7) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:shown] / values.sum(), rtol=1e-9)


def test_whitening(spark, small):
    table = pd.read_parquet(f"{small}/embeddings.parquet")
    judged(whitening.op12(spark, small).toPandas(), table.vec_id.tolist(), table.embedding.tolist())


def test_whitening_of_odd_rows(spark):
    rnd = np.random.default_rng(3)
    good = (rnd.normal(size=(300, 5)) * [1, 2, 0.5, 30, 0.2]).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, good[7]) for i in range(400)]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [1.0] * 6]
    table = spark.createDataFrame([(*r, 1, 1, b"x") for r in rows + [(5000 + i, v) for i, v in enumerate(odd)]], "vec_id long, embedding array<double>, size int, n long, x binary").repartition(3)
    judged(whitening.whiten(table).toPandas(), [i for i, _ in rows], [v for _, v in rows])


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(one).collect()
    assert len(got) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)
    assert whitening.whiten(one.limit(0)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    far = whitening.Centre(10**9, np.array([10**15 + 3, 7], object))
    assert far.deviations(np.array([[10**6 + 5, 9], [2 * 10**6, 0]])) == [None, None] and whitening.Centre(3, np.array([3 * 10**6], object)).deviations(np.array([[10**6 + 2**29]])) == [9 * 2**58]


@pytest.mark.parametrize("size", [1, 2, 7, 24])
def test_jacobi(size):
    rnd = np.random.default_rng(size)
    turn, _ = np.linalg.qr(rnd.normal(size=(size, size)))
    scales = 10.0 ** np.linspace(0, -14, size)
    graded = np.sqrt(scales)[:, None] * (np.eye(size) + 0.1 * (turn + turn.T) / 2) * np.sqrt(scales)[None, :]
    for matrix in (turn @ np.diag(np.arange(1.0, size + 1)) @ turn.T, graded):
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.jacobi(matrix)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-13 * size) and np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13 * size) and (np.diff(values) <= 0).all()
    # Small eigenvalues of a graded matrix to full relative accuracy: those of its inverse are their inverses.
    assert np.allclose(np.sort(1 / values), np.sort(whitening.jacobi(np.linalg.inv(graded))[0]), rtol=1e-8)


def test_sums_are_exact(spark):
    big = [(i, np.array([2**55 - i, -(2**55) + i], "<i8").tobytes()) for i in range(600)]
    n, total = whitening.sums(spark.createDataFrame(big, "vec_id long, x binary"), 2)
    assert (n, total.tolist()) == (600, [sum(2**55 - i for i in range(600)), -sum(2**55 - i for i in range(600))])
