"""Role repair: brute force over all role sequences, and conversations cut over many partitions."""

import itertools
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrid.llm import chat

GIVEN = ["system", "user", "assistant", "tool", None, " User "]


def best(roles):
    """(cost, roles) of the cheapest repair, by all sequences in order."""
    found = None
    for way in itertools.product(range(3), repeat=len(roles)):
        cost, before = 0, chat.START
        for role, now in zip(roles, way):
            cost += 0 if role and role.strip().lower() == chat.ROLES[now] else chat.RELABEL
            if before == now:
                cost += chat.MERGE
            elif now == 0:
                cost += 0 if before == chat.START else float("inf")
            elif now == 2:
                cost += 0 if before == 1 else chat.INSERT
            before = now
        cost += {0: 2 * chat.INSERT, 1: chat.INSERT, 2: 0}[before]
        if found is None or cost < found[0]:
            found = (cost, list(way))
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(GIVEN), min_size=1, max_size=7), st.lists(st.integers(1, 6), max_size=3))
def test_stretches_equal_brute_force(roles, cuts):
    assert chat.choose(roles, chat._ENDING[:3], chat.START) == best(roles)[1]
    # The same conversation over several partitions.
    at = sorted({0, len(roles), *[c for c in cuts if c < len(roles)]})
    parts = [roles[a:b] for a, b in zip(at, at[1:])]
    rows = [{"part": i, "first_id": 5, "first_costs": chat.stretch(p).ravel().tolist(), "first_ranks": chat.ranks(p).ravel().tolist(), "first_turns": len(p), "only": True} for i, p in enumerate(parts)]
    found = chat.borders(rows)
    way = [x for i, p in enumerate(parts) for x in chat.choose(p, found[i, "first"][2], found[i, "first"][0])]
    assert way == best(roles)[1] and found[len(parts) - 1, "first"][3]


def test_repair(spark):
    rnd = random.Random(4)
    turns = [(conv, t, rnd.choice(GIVEN), rnd.choice(["hi", "", None, "x\ny"])) for conv in range(40) for t in range(rnd.randint(1, 7))]
    turns += [(99, t, rnd.choice(GIVEN[1:3]), f"t{t}") for t in range(600)] + [(None, 1, "user", "nobody"), (None, None, "assistant", "first"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, piece string, place int").repartition(5)
    got = chat.repair(df).toPandas()
    assert len(got) == len(turns)
    order = lambda t: tuple((v is not None, v or 0 if isinstance(v, int) or v is None else v) for v in t[:2]) + ((t[2] is not None, t[2] or ""),)
    for conv in {t[0] for t in turns}:
        mine = got[got.conv_id.isna() if conv is None else got.conv_id == conv].sort_values("place")
        roles = [t[2] for t in sorted((t for t in turns if t[0] == conv), key=order)]
        assert mine.place.tolist() == list(range(len(roles)))
        assert [None if pd.isna(x) else x for x in mine.given] == roles
        if len(roles) <= 9:
            cost, way = best(roles)
            assert mine.cost.sum() == cost and mine.role.tolist() == [chat.ROLES[r] for r in way]
        text = "".join(mine.piece)
        heads = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
        heads = heads[1:] if heads[0] == "system" else heads
        assert heads == ["user", "assistant"] * (len(heads) // 2) and len(heads) >= 2
    assert chat.repair(df.where("false")).count() == 0
    # Equal numbers and roles follow the hashes of their texts.
    ties = spark.createDataFrame([(1, 0, "user", x) for x in ("b", "a", None, "", "c", "a")], "conv_id long, turn long, role string, text string")
    order = [r.text for r in ties.orderBy(F.xxhash64("text"), "text").collect()]
    assert [r.piece.split("|>")[-1].strip() for r in chat.repair(ties).orderBy("place").collect()][:-1] == [x or "" for x in order][:-1]
    one = chat.conversations_rendered(chat.repair(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string"))).first()
    assert one.text == "<|user|>\na\nb<|end|>\n<|assistant|>\n<|end|>\n" and one.cost == chat.MERGE + chat.INSERT
