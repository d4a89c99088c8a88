"""Chat formatting: the cheapest repair of a conversation's roles, found by dynamic programming over an automaton of legal turns.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one an assistant's.
A turn may be relabelled, merged with the turn before it (if both have the same role then), or preceded by an empty turn;
an empty assistant turn may end the conversation. The repair with the smallest total cost is taken; of equal ones, that whose
roles come first in the order system, user, assistant at the earliest turn where they differ.

The automaton's step for a turn is a 4 x 4 matrix of costs (from the role before to the role after), and a stretch of turns
is the (min, +) product of its steps. So turns are sorted over the cluster by conversation and turn, and a conversation may
be as long as it likes: tasks send the products of the conversations that cross their borders (two small matrices each),
the driver joins these to costs before and after each border, and tasks then choose their own turns' roles.

A row of the result is a turn with what is rendered for it; the pieces of a conversation in order are its rendered text.

Edge cases: turns without number come first; equal numbers follow role (nulls first), then xxhash64 of the text, then the text; a
null or unknown role can take any role at the cost of a relabel; a null text renders as empty; turns without conversation id are one conversation; an empty table gives
no rows; repeated rows are turns like others (and merge); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
START = 3
#: Costs of the repairs. A merge keeps all words and no claim of who spoke changes, so it is the cheapest.
MERGE, INSERT, RELABEL = 1, 2, 4
#: Cost of the turns that must be inserted between the last role (row; START: none yet) and the next one (column).
_BETWEEN = np.array([[MERGE, 0, INSERT], [np.inf, MERGE, 0], [np.inf, 0, MERGE], [0, 0, INSERT]])
#: What is inserted there, as roles.
_INSERTED = {(0, 2): (1,), (3, 2): (1,)}
#: Cost of ending after a role: a system or user turn is followed by what is missing, an assistant's by nothing.
_ENDING = np.array([2 * INSERT, INSERT, 0, np.inf])
_ENDED = {0: (1, 2), 1: (2,), 2: ()}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

SORTED_SCHEMA = "part int, conv_id long, turn long, role string, text string"
BORDER_SCHEMA = "part int, first_id long, first_costs array<double>, first_ranks array<int>, first_turns long, last_id long, last_costs array<double>, last_ranks array<int>, last_turns long, only boolean"
TURN_SCHEMA = "conv_id long, place long, turn long, role string, given string, action string, cost long, piece string"


@lru_cache(maxsize=1000)
def step(role: str | None) -> np.ndarray:
    """Costs from the role before (rows, START last) to the role of this turn (columns)."""
    name = role.strip().lower() if role else ""
    return _BETWEEN + np.array([0 if name == r else RELABEL for r in ROLES])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of costs of two stretches: 4 x 3 each; nothing leads back to START."""
    return (a[:, :, None] + b[None, :3, :]).min(1)


def stretch(roles: list[str | None]) -> np.ndarray:
    total = None
    for role in roles:
        total = step(role) if total is None else product(total, step(role))
    return total


def ranks(roles: list[str | None]) -> np.ndarray:
    """For each role before a stretch: which of the cheapest ways to each last role comes first, second and third."""
    out = np.zeros((4, 3), np.int64)
    for before in range(4):
        ways = [choose(roles, np.where(np.arange(3) == last, 0.0, np.inf), before) for last in range(3)]
        out[before, sorted(range(3), key=lambda last: ways[last])] = range(3)
    return out


def choose(roles: list[str | None], after: np.ndarray, before: int) -> list[int]:
    """The roles of a stretch, given the role before it and the least cost after it for each last role."""
    ahead = [after]
    for role in reversed(roles[1:]):
        ahead.append((step(role)[:3] + ahead[-1][None, :]).min(1))
    chosen, state = [], before
    for role, rest in zip(roles, reversed(ahead)):
        state = int(np.argmin(step(role)[state] + rest))
        chosen.append(state)
    return chosen


def rendered(role: int, before: int, text: str | None, last: bool, given: str | None) -> tuple[str, str, int]:
    """(piece, action, cost) of a turn with its role, after a turn with the role before."""
    actions, cost, out = [], 0, []
    if (given or "").strip().lower() != ROLES[role]:
        actions.append("relabel")
        cost += RELABEL
    if before == role:
        actions.append("merge")
        cost += MERGE
        out.append("\n")
    else:
        out.append(CLOSE if before != START else "")
        for r in _INSERTED.get((before, role), ()):
            actions.append(f"insert {ROLES[r]}")
            cost += INSERT
            out += [OPEN.format(ROLES[r]), CLOSE]
        out.append(OPEN.format(ROLES[role]))
    out.append(text or "")
    if last:
        out.append(CLOSE)
        for r in _ENDED[role]:
            actions.append(f"append {ROLES[r]}")
            cost += INSERT
            out += [OPEN.format(ROLES[r]), CLOSE]
    return "".join(out), ",".join(actions) or "keep", cost


# ---------------------------------------------------------------- Spark side


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The turns of each conversation in each part; they come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["part"], held[0]["conv_id"]) != (row["part"], row["conv_id"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def borders(rows: list[dict]) -> dict[tuple[int, str], tuple[int, int, np.ndarray, bool]]:
    """For the first and last conversation of each partition: the role and the number of turns before its stretch, the costs
    after it for each last role, and whether the conversation ends there. `rows` are those of BORDER_SCHEMA, in order."""
    chains: list[list[tuple]] = []
    previous = None
    for r in rows:
        first = ((r["part"], "first"), np.array(r["first_costs"]).reshape(4, 3), np.array(r["first_ranks"]).reshape(4, 3), r["first_turns"])
        if previous == (r["first_id"],):
            chains[-1].append(first)
        else:
            chains.append([first])
        if not r["only"]:
            chains.append([((r["part"], "last"), np.array(r["last_costs"]).reshape(4, 3), np.array(r["last_ranks"]).reshape(4, 3), r["last_turns"])])
        previous = (r["first_id"] if r["only"] else r["last_id"],)
    out = {}
    for chain in chains:
        afters = [_ENDING[:3]]
        for _, costs, _, _ in reversed(chain[1:]):
            afters.append((costs[:3] + afters[-1][None, :]).min(1))
        state, place = START, 0
        for i, ((key, costs, order, turns), after) in enumerate(zip(chain, reversed(afters))):
            out[key] = (state, place, after, i == len(chain) - 1)
            total = costs[state] + after
            state = int(min(np.flatnonzero(total == total.min()), key=lambda last: order[state, last]))
            place += turns
    return out


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """The turns in order, stored with the number of their range."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    spread = turns.repartitionByRange(common.partitions(conversations.sparkSession), "conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text")
    return common.stored(spread.select(F.spark_partition_id().alias("part"), *order), "turns")


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each turn: its place from 0, its role now and as given, what was done, its cost, and what is rendered for it."""
    turns = sorted_turns(conversations)
    spread = turns.repartition(common.partitions(turns.sparkSession), "part").sortWithinPartitions("part", "conv_id", "turn", "role", F.xxhash64("text"), "text")

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], bool, bool]]:
        """(part, turns, is first, is last) of each stretch."""
        before = None
        for stretch_ in _stretches(batches):
            if before is not None:
                yield *before, before[0] != stretch_[0]["part"]
            first = before is None or before[0] != stretch_[0]["part"]
            before = (stretch_[0]["part"], stretch_, first)
        if before is not None:
            yield *before, True

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict = {}
        for part, held, first, last in by_partition(batches):
            if not (first or last):
                continue
            roles = [t["role"] for t in held]
            told = [held[0]["conv_id"], stretch(roles).ravel().tolist(), ranks(roles).ravel().tolist(), len(held)]
            if first:
                row = {"part": part} | dict(zip(("first_id", "first_costs", "first_ranks", "first_turns"), told))
            if last:
                row |= dict(zip(("last_id", "last_costs", "last_ranks", "last_turns"), told)) | {"only": first}
                kinds = {"part": pa.int32(), "first_costs": pa.list_(pa.float64()), "last_costs": pa.list_(pa.float64()), "first_ranks": pa.list_(pa.int32()), "last_ranks": pa.list_(pa.int32()), "only": pa.bool_()}
                yield pa.record_batch({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})

    found = borders([r.asDict() for r in spread.mapInArrow(measure, BORDER_SCHEMA).orderBy("part").collect()])  # a row for each partition
    sent = turns.sparkSession.sparkContext.broadcast(found)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, first, last in by_partition(batches):
            state, place, after, ends = sent.value[part, "first" if first else "last"] if first or last else (START, 0, _ENDING[:3], True)
            out: dict[str, list] = {k.split()[0]: [] for k in TURN_SCHEMA.split(", ")}
            chosen = choose([t["role"] for t in held], after, state)
            for i, (turn, role) in enumerate(zip(held, chosen)):
                piece, action, cost = rendered(role, state, turn["text"], ends and i == len(held) - 1, turn["role"])
                values = (turn["conv_id"], place + i, turn["turn"], ROLES[role], turn["role"], action, cost, piece)
                for column, value in zip(out.values(), values):
                    column.append(value)
                state = role
            text = pa.string()
            kinds = (pa.int64(), pa.int64(), pa.int64(), text, text, text, pa.int64(), text)
            yield pa.record_batch([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    return spread.mapInArrow(mend, TURN_SCHEMA)


def conversations_rendered(turns: DataFrame) -> DataFrame:
    """conv_id, text and cost of each conversation, from ``repair``: for conversations that fit in a row."""
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("text"), F.sum("cost").alias("cost"))


def op1(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
