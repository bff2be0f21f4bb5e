"""Every query of the library proper against its SQL, on the smallest tables."""

import duckdb
import pytest

from sieveline.functions.spans import masked, match_spans
from sieveline.operators import catalog, scan
from sieveline.plans import flows, gates, grids, hybrid, reports, supply

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {k: (m.QUERIES[k], m.ORACLES[k]) for m in (grids, gates, supply, hybrid, flows, reports) for k in m.ORACLES}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(format(v, ".9g") if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_sql(spark, duck, name):
    run, sql = ALL[name]
    mine, theirs = run(spark, DIR).toPandas(), duck.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_every_rule_is_a_valid_pattern(spark):
    one = spark.createDataFrame([(1, "p", "python", "nothing here")], "file_id long, path string, language string, content string")
    for rules in catalog.GRIDS.values():
        assert scan.grid(one, rules, "x").count() == 0


def test_spans_and_masks(spark):
    df = spark.createDataFrame([("é eval(eval(x)) my_eval(y) a.exec(z) exec (1)",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(match_spans(F.col("t"), r"(?<![\w.])", "(?:eval|exec)", r"\s*\(", "m")).collect()]
    assert [(h.start, h.hit) for h in got[0]] == [(2, "eval"), (7, "eval"), (37, "exec")]
    assert got[1] == [] and not got[2]
    assert [r[0] for r in spark.createDataFrame([("",), ("12345678",), ("abcdefghij",)], "t string").select(masked(F.col("t"))).collect()] == ["", "*" * 8, "ab******ij"]
