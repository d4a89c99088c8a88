"""Operators on the whole corpus: brute force in plain Python, exact round trips, and properties."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrid.llm import automata, chosenpath, common, packing, quality, suffixes, tokenfiles, tokens

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def bag(rows):
    return sorted(map(repr, rows))


def number(v):
    return None if v is None or pd.isna(v) else int(v)


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [(doc, np.array([*e.ids, end], "<u4")) for (doc, _), e in zip(texts, t.encode_batch([t or "" for _, t in texts], add_special_tokens=False))]


def test_texts_made_to_collide(spark):
    """Thue-Morse words agree in polynomials modulo 2 ** 64, whatever the base; every operator must tell them apart."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    key = lambda w: common.TextBlock(pa.array([w])).words(common.SPACED).hashes()[0]
    assert key(a) != key(b)
    rest = " ".join(f"w{i}" for i in range(30))
    texts = [(1, a), (2, b), (3, f"{a}\n{b}\n{rest}"), (4, f"{rest[:40]} {a} {rest}"), (5, f"{rest[:40]} {b} {rest}")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    want = {i: (len(x), zlib.crc32(x.tobytes())) for i, x in encoded(texts, 1)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenfiles.write(table).documents().collect()} == want
    pieces = {(i, p): zlib.crc32(x[p * 2048 : (p + 1) * 2048].tobytes()) for i, x in encoded(texts, 0) for p in range(-(-len(x) // 2048))}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(table).collect()} == pieces
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(table, labels).collect()}[3] == 0
    assert {r.doc_id: r.n_removed for r in automata.dedup(table).collect()} == {1: 0, 2: 0, 3: 0, 4: 30, 5: 31}  # the third text has b before the rest
    assert bag((r.doc_id, r.class_id, r.n_links) for r in chosenpath.join(table).collect()) == bag(x[:3] for x in classes(texts))
    # Parts that do agree in their keys are found out.
    coder, plain = tokens.WordEncoder(tokens.vocabulary_path()), tokens.part_keys
    try:
        tokens.part_keys = lambda data, starts, ends: (np.full(len(starts), 1 << 63, np.uint64), np.arange(len(starts)), data[common.ragged(starts, ends - starts)])
        ids, n = coder.encode(pa.array([t for _, t in texts]))
    finally:
        tokens.part_keys = plain
    assert ids.tolist() == [i for _, x in encoded(texts, 0) for i in x[:-1].tolist()] and len(n) == len(texts)


# ---------------------------------------------------------------- token files


def test_token_files(spark, docs, texts, none):
    files = tokenfiles.write(docs)
    got = files.documents().toPandas().sort_values(["part", "place"])
    want = sorted(encoded(texts, 1), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [number(i) for i in got.doc_id] == [i for i, _ in want]
    assert got.start.tolist() == np.cumsum([0, *got.n_tokens])[:-1].tolist()
    assert bag(zip(map(number, got.doc_id), got.n_tokens, got.ids_crc32)) == bag((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    shard = files.manifest.orderBy("part").first()
    reader = tokenfiles.ShardReader(shard.path, files.dictionary)
    some = reader.index[5]
    by_id = dict((i, x) for i, x in want)
    assert any((ids == by_id[int(some["doc_id"])]).all() for ids in reader.find(int(some["doc_id"])))
    try:
        tokenfiles.ShardReader(shard.path, files.dictionary + b"x")
        raise AssertionError("another dictionary was accepted")
    except ValueError:
        pass
    assert sum(r.bytes for r in files.manifest.collect()) < sum(r.id_bytes for r in files.manifest.collect())
    assert tokenfiles.write(none).documents().count() == 0


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    texts = ["It's ΑΣ é ́x <|endoftext|> a b c 12,345 don't\t\x1fend", "", "x" * 500, "漢字 ﬁ ½ 😀😀", "İ ß ẞ"]
    t = Tokenizer.from_file(tokens.vocabulary_path())
    import pyarrow as pa

    coder = tokens.WordEncoder(tokens.vocabulary_path())
    for _ in range(2):  # with and without known words
        ids, n = coder.encode(pa.array(texts))
        assert ids.tolist() == [i for e in t.encode_batch(texts, add_special_tokens=False) for i in e.ids] and len(n) == len(texts)


# ---------------------------------------------------------------- packing


def test_packing(spark, docs, texts, none):
    got = packing.pack(docs, with_ids=True).toPandas()
    want = encoded(texts, 0)
    pieces = [(doc, p, p * 2048, min(2048, len(x) - p * 2048), zlib.crc32(x[p * 2048 : (p + 1) * 2048].tobytes())) for doc, x in want for p in range(-(-len(x) // 2048))]
    assert bag((number(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == bag(pieces)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.cumsum([0, *s.length])[:-1].tolist() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-sum(len(x) for _, x in want) // 2048) + 2
    joined = packing.sequences(spark.createDataFrame(got[["sequence_id", "offset", "ids"]])).toPandas()
    assert sum(len(x) for x in joined.ids) == 4 * sum(len(x) for _, x in want)
    assert packing.pack(none).count() == 0


def fewest(sizes, capacity):
    """The fewest bins, by search over all ways to place the pieces."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_the_optimum(sizes):
    counts = Counter(sizes)
    left = packing.Counts(dict(counts))
    fixed = packing.reduce_by_dominance(left, 20)
    rest = [x for x, n in left.n.items() for _ in range(n)]
    used = Counter(x for lengths, times in fixed for x in lengths * times)
    assert used + Counter(rest) == counts and all(sum(lengths) <= 20 for lengths, _ in fixed)
    assert sum(times for _, times in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)
    packed = packing.pack_histogram(dict(counts), 20)
    assert Counter(x for lengths, times in packed for x in lengths * times) == counts and all(sum(x) <= 20 for x, _ in packed)


def test_packing_in_bulk():
    rnd = random.Random(5)
    counts = Counter(min(2048, int(rnd.lognormvariate(5, 1.2)) + 1) for _ in range(50_000))
    patterns = packing.pack_histogram({k: v * 1000 for k, v in counts.items()})
    total = sum(k * v * 1000 for k, v in counts.items())
    assert sum(times for _, times in patterns) <= -(-total // 2048) * 1.001
    assert len(patterns) < 20_000


# ---------------------------------------------------------------- Jaccard join


def classes(texts, size=5, least=0.8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = []
    for _, t in texts:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [texts[j][0] for j in seen if texts[j][0] is not None]
        out.append((texts[i][0], min(ids, default=None), len(links[i]), min(seen)))
    return out


def test_jaccard_join(spark, docs, texts, none):
    judged = classes(texts)
    want = bag(x[:3] for x in judged)
    for options in ({}, {"bucket_most": 2, "block": 2}):  # the second splits buckets and groups all the way
        got = chosenpath.join(docs, **options).toPandas()
        assert bag((number(r.doc_id), number(r.class_id), r.n_links) for r in got.itertuples()) == want
    assert chosenpath.join(none).count() == 0
    one = chosenpath.one_of_each(docs)
    assert one.columns == docs.columns
    kept = one.toPandas()
    again = [(number(r.doc_id), r.text) for r in kept.itertuples()]
    assert len(kept) == len({first for *_, first in judged})
    assert all(n == 0 for _, _, n, _ in classes(again))


def test_jaccard_join_sql(spark, small):
    assert difference(spark, small, chosenpath.op5, chosenpath.OP5_SQL) == ""


def test_components(spark):
    rnd = random.Random(2)
    name = lambda i: i.to_bytes(16, "big")
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    got = {r.u: r.root for r in chosenpath.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "u binary, v binary"), "test").collect()}
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {bytes(k): bytes(v) for k, v in got.items()} == {name(x): name(find(x)) for e in edges if e[0] != e[1] for x in e}


# ---------------------------------------------------------------- substrings


def test_suffix_dedup(spark, docs, texts, none):
    data = [(doc, (t or "").encode()) for doc, t in texts]
    found = Counter(t[i : i + 400] for _, t in data for i in range(len(t) - 399))
    want = []
    for doc, t in data:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if found[t[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want.append((doc, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    got = suffixes.dedup(docs).toPandas()
    assert bag((number(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.itertuples()) == bag(want)
    assert suffixes.dedup(none).count() == 0


def words_repeated(rows, size):
    """Of each row: the words within `size` consecutive ones that also start elsewhere."""
    split = [SPACED.findall((t or "").encode()) for _, t in rows]
    found = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - size + 1):
            if found[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        yield doc, len(gone)


def test_suffix_dedup_words(spark, docs, texts):
    for size in (50, 9):
        got = suffixes.dedup(docs, words=size).toPandas()
        assert bag((number(r.doc_id), r.n_words_repeated) for r in got.itertuples()) == bag(words_repeated(texts, size))


def test_suffix_dedup_short_passages(spark):
    """Passages of over 50 words and under 400 bytes, between other words and blanks, are told; those of 49 words are not."""
    rnd = random.Random(7)
    some = lambda n: [f"{rnd.randrange(10**6):x}" for _ in range(n)]
    passage, short = some(51), some(49)
    rows = [(1, " ".join(some(80) + passage + some(30))), (2, " ".join(some(9)) + "\n" + "\t ".join(passage)), (3, " ".join(some(120))), (4, " ".join(some(5) + short)), (5, " ".join(short + some(70)))]
    rows += [(6, " ".join(some(100) + ["\x01é\u00a0", "#", "x" * 70_000] * 40)), (7, " ".join(passage[1:50] + some(9))), (8, None)]
    got = {r.doc_id: (r.n_removed, r.n_words_repeated) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(" ".join(passage)) < 400
    assert {d: n for d, (_, n) in got.items()} == dict(words_repeated(rows, 50)) == {1: 51, 2: 51, 3: 0, 4: 0, 5: 0, 6: 120, 7: 0, 8: 0}
    assert all(got[d][0] == 0 for d in (1, 2, 3, 4, 5, 7, 8))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"aa", b"\x01", b"\xff"]), max_size=9), min_size=1, max_size=5), st.integers(1, 5))
def test_repeats_of_words(texts, size):
    """Suffixes at every word, each with all windows over it: repeated windows are those of brute force."""
    found = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    entries = []
    for t, w in enumerate(texts):
        for at in range(len(w)):
            low, high = max(0, at - size + 1), min(at, len(w) - size)
            if low <= high:
                entries.append((b"".join(x + b" " for x in w[at : high + size]), b"".join(b" " + x for x in w[low:at]), at - high, t, at))
    entries.sort()
    shared, _ = suffixes.front_coded([e[0] for e in entries])
    prefix = np.array([suffixes.words_in(e[0][:n]) for e, n in zip(entries, shared)], np.int64)
    most, least = suffixes.repeats(prefix, [e[1] for e in entries], np.array([e[2] for e in entries], np.int64), np.ones(len(entries), np.int64), size, suffixes.words_in)
    for (*_, t, at), far, near in zip(entries, most.tolist(), least.tolist()):
        w = texts[t]
        want = [at - i for i in range(max(0, at - size + 1), min(at, len(w) - size) + 1) if found[tuple(w[i : i + size])] > 1]
        # All offsets here are of windows at the same anchor's place in the text, so that equal windows meet.
        assert (far, near) == ((max(want), min(want)) if want else (-1, size))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda x: bytes(c % 2 for c in x)), max_size=8), min_size=1, max_size=6))
def test_loser_tree(lists):
    runs = [sorted(x) for x in lists]
    got = list(suffixes.merged([suffixes.Run(*suffixes.front_coded(r)) for r in runs]))
    assert [x[2] for x in got] == sorted(x for r in runs for x in r)
    assert [x[3] for x in got[1:]] == [suffixes.common_prefix(a[2], b[2]) for a, b in zip(got, got[1:])]


def test_automaton_dedup(spark, docs, texts, none):
    # One document for equal doc_id and text; those that share a doc_id only follow the hashes of their texts.
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted({(d is not None, d or 0, hashes[t], t or "") for d, t in texts})
    assert any(a[:2] == b[:2] for a, b in zip(rows, rows[1:]))
    seen, want = set(), {}
    for told, d, _, t in rows:
        w = SPACED.findall(t.encode())
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = True
            seen.add(tuple(w[i : i + 20]))
        want[d if told else None, t] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    for large in (automata.LARGE, 3):  # the second deals the windows of most anchors singly
        got = automata.dedup(docs, large=large).toPandas()
        assert bag((number(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.itertuples()) == bag((d, *want[d, t or ""]) for d, t in texts)
    assert automata.dedup(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=6), st.integers(1, 4), st.integers(1, 9))
def test_seen_windows(passages, size, shard_words):
    passages = [p for p in passages if len(p) >= size]
    seen, want = set(), []
    for p in passages:
        windows = [tuple(p[i : i + size]) for i in range(len(p) - size + 1)]
        want.append([i for i, w in enumerate(windows) if w in seen])
        seen |= set(windows)
    assert list(automata.seen_windows(iter(passages), size, shard_words)) == want
