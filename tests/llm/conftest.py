import os
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, rank int, tile string, spans string, n long, "
          "shard int, score double, g string, place int, token string")
LONG = "lorem ipsum dolor " * 3000


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    from tidebars.llm.queries import set_up

    set_up(spark)


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; the other columns clash with names used inside."""
    texts = [None, "", "   \n\t ", "word", "Ärger é 😀 ñ", LONG, LONG, "same text here now", "same text here now", "\n".join(["a line of text"] * 9),
             "x" * 3000, "the end of it all . " * 3, None, "#$%& *** <<>>", "one two three four five six seven eight nine ten " * 12]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "ä"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], rows[8], (None, "id is null", "en", "a"), (None, None, None, None), (3, "other text, same id", "de", "b")]
    return [(*r, None, 7, 1, "t", "s", 9, 3, 0.5, "g", 4, "k") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
