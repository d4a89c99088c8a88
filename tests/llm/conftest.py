import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key string, part int, root string, hash string, stay_id string, dirty_id string, n string"
PASSAGE = " ".join(f"shared{i} word{i % 7} of{i % 3} passage" for i in range(40))


def rows():
    """The smallest documents, and rows that are null, empty, long, repeated, tied or full of one character."""
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    out = [(int(i), t, "en", "s", len(t)) for i, t in zip(d.doc_id, d.text)]
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
    more = [None, "", "   \n\t ", "one", "a b c d", PASSAGE, "start " + PASSAGE + " end", PASSAGE.upper(), long, "a" * 3000, "x y " * 600, "é ü ß 　 漢字 " * 50, "!?!? --- ..."]
    out += [(10_000 + i, t, None, None, None) for i, t in enumerate(more)]
    out += [(10_005, PASSAGE, "en", "s", 1), (10_005, PASSAGE + " other", "en", "s", 1), (None, PASSAGE + " nobody", None, None, None), (None, None, None, None, None), (3, out[3][1], "en", "s", 1)]
    return [(*r, "clash", "clash", 1, "clash", "clash", "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
