"""Each query against its SQL, in another engine, over the driver's tables."""

import pytest

from colloquy import catalogue
from tests.compare import connect, difference

SF = "/root/testdata/sf0.01"
NAMES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_says_what_its_sql_says(spark, con, name):
    assert difference(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name]) is None


def test_person_stats_of_texts_that_outlast_their_turn(spark, con, tmp_path):
    """A turn is 2,000 characters on the clock that the SQL makes up; the turn after a longer one is not an interruption there."""
    rows = [(1, 0, "user", "x" * 300), (1, 1, "assistant", "y" * 2_900), (1, 2, "user", "z" * 40), (1, 3, "assistant", ""), (2, 0, "system", "s" * 5_000), (2, 1, "user", "x" * 4_100), (2, 2, "assistant", "y" * 10)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    sql = f"WITH conversations AS (FROM '{path}/*.parquet') SELECT * FROM ({catalogue.oracle_sql()['person_stats']})"
    assert difference(catalogue.queries()["person_stats"](spark, str(tmp_path)), con, sql) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(NAMES)))
def test_query_without_sql_runs_and_repeats(spark, name):
    q = catalogue.queries()[name]
    first = sorted(map(str, q(spark, SF).collect()))
    assert first and first == sorted(map(str, q(spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.speaker_id for r in e.entry(spark).collect()} == {1, 2}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_text_operators_are_optional():
    """With the subpackage gone the entry still imports; any other failure to import shows."""
    import subprocess
    import sys

    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "colloquy.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "person_stats" in e.queries() and "pipeline" not in e.queries() and not any(q.startswith("op") for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
