"""Sentences held against sources, fences, headers within lines, and the five checks, by hand-made cases and a plain version."""

import random
import re

import pytest
from compare import difference
from pyspark.sql import functions as F

from evigrid import registry
from evigrid.functions import citations, grounding
from evigrid.functions.text import TRIVIAL

SOURCES = "Depth 3.25 ft in 2021; 1250 people; 88.5 million; -7.5 C"


def plain(text, sources):
    """(kept text, dropped sentences with their numbers), line by line."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*$", "", text or "", flags=re.MULTILINE).strip()
    for h in grounding.HEADERS:
        text = text.replace(f"**{h}.**", f"\n**{h}.**\n")
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    blocks, dropped, body = [], [], []

    def has(n):
        bare = n.replace(",", "")
        return any(f in sources for f in (n, bare, bare.rstrip("0").rstrip(".") if "." in bare else bare))

    def close():
        kept = []
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\[])", " ".join(body).strip()):
            s = s.strip()
            clean = re.sub(r"\[[a-z0-9_]+\]", "", re.sub(r"\*\*([^*]+)\*\*", r"\1", s), flags=re.I)
            bad = [n for n in re.findall(r"(?:(?<=^)|(?<=[\s(\[/]))-?\d[\d,]*(?:\.\d+)?", clean) if n not in TRIVIAL and not has(n)]
            if bad:
                dropped.append((s, bad))
            elif s:
                kept.append(s)
        body.clear()
        if kept:
            blocks.append(" ".join(kept))

    for line in text.split("\n"):
        if re.match(r"^\s*\*\*[A-Z][A-Za-z\s/]+\.\*\*\s*$", line):
            close()
            blocks.append(line.strip())
        else:
            body.append(line.strip())
    close()
    return "\n".join(blocks).strip() or grounding.NOTHING, dropped


CASES = [
    None, "", "```", "**Status.**\nSomething happened [pop].\n\n```", "```\n**Status.**\nSomething happened [pop].", "```markdown\n**Status.**\nSomething happened [pop].", "The field is `x` in the data [pop].", "a ``` b\n```x y\n``` \nend",
    "**Status.** It was 3.25 ft. It was 4.5 ft. **Empirical evidence.** None. **Policy context.**", "About 1,250 people. About 1,251 people! Fine? [pop] says 12.", "**Own header.**\n  **Other / one.**  \nText 88.50 million.\nMore\nlines 99.", "No numbers. 311 calls, 100 of 10.",
    "x **12** y. A **3.25** z.", "Cold: -7.5 and (-7.5) and /-8.1.", "Ends with 55", "55. Next 1250.", "one\n\n\n\ntwo.\n\n**Status.**\n\n\nThree 77.", "**lower.**\n**Status**\n** Status.**", "v2 and B12 and 2021-05.", "1,250.00 is 1250. 3.250 too.",
]


def test_kept_and_dropped(spark):
    rnd = random.Random(9)
    bits = ["It was 3.25 ft.", "It was 41 m.", "**Status.**", "**Modeled scenarios.**", "**Any Title.**", "```", "```text", "\n", "\n\n", " ", "And [pop] then", "1,250!", "x", "(88.5)", "(89)", "In 2021.", "In 2022?"]
    cases = CASES + ["".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    table = spark.createDataFrame([(i, c, SOURCES) for i, c in enumerate(cases)], "id long, text string, sources string")
    rows = table.withColumn("s", grounding.judged(F.col("text"), F.col("sources"))).select("id", grounding.grounded_text(F.col("s")).alias("kept"), F.filter("s", lambda x: F.size(x.numbers) > 0).alias("dropped")).collect()
    got = {r.id: (r.kept, [(x.text, list(x.numbers)) for x in r.dropped]) for r in rows}
    for i, c in enumerate(cases):
        assert got[i] == plain(c, SOURCES), c


@pytest.mark.parametrize(
    "text, failed",
    [
        ("There were 1250 people [pop] in the area at that time, all of them named.", set()),
        ("There were 1250 people (pop) in the area at that time, all of them named.", {"citations_dense"}),
        ("Short [pop].", {"non_empty"}), (None, {"non_empty"}), ("", {"non_empty"}),
        ("There were 1777 people [pop] in the area at that time, all of them named.", {"numerics_grounded"}),
        ("There were 1250 people [doc_id] in the area at that time, all of them named.", {"no_placeholder_tokens", "citations_resolve"}),
        ("There were people [SOURCE] in the area at that time; all of them named, it says.", {"no_placeholder_tokens"}),
        ("<document id=1> There were people in the area at that time, all of them named.", {"no_placeholder_tokens"}),
        ("There were 1250 people [census] in the area at that time, all of them named.", {"citations_resolve"}),
        ("The flagged projects stand on 20 Coffey St and 100 Sullivan St, with more to come.", set()),  # numbers of houses
        ("- 20 Coffey St. Depth of 3.25 ft. Seen in 2021 [hwm]\n- no more than that, all in all", set()),  # one citation for an item of a list
    ],
)
def test_checks(spark, text, failed):
    table = citations.with_uncited(spark.createDataFrame([(text,)], "text string"))
    found = grounding.checks(F.col("text"), F.lit(SOURCES), F.array(F.lit("pop"), F.lit("hwm")), F.size("uncited"))
    (row,) = table.select(*[c.alias(n) for n, c in found.items()]).collect()
    assert {n for n, ok in row.asDict().items() if not ok} == failed


def test_address_is_no_source(spark):
    docs = F.array(*[F.struct(F.lit(i).alias("doc_id"), F.lit(t).alias("text")) for i, t in (("geocode", "80 Pioneer Street"), ("pop", "0.8%"), ("x", None))])
    (row,) = spark.range(1).select(grounding.haystack(docs).alias("h")).collect()
    assert row.h == "0.8%\n"


def test_digits_of_the_address_ground_no_uncited_sentence(spark, tmp_path):
    keys = [77123, 177123, 771230, 771239, 64 * 23, 5]  # the first four have the people's number in their names
    rows = [(k, f"Customer#{k:09d}", 1, -1.0 if k % 2 else 1.0, "FURNITURE") for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"file://{tmp_path}/customer.parquet")
    assert difference(spark, str(tmp_path), registry.queries()["final_text"], registry.oracle_sql()["final_text"]) == ""
