import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from riskweft.session import session

    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a Spark result and a SQL text give the same rows."""

    def check(df, sql):
        got, want = df.toPandas(), duck.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        duck.register("got", got[columns])
        duck.register("want", want[columns])
        odd = duck.execute("(SELECT 'spark' AS side, * FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)) UNION ALL (SELECT 'sql', * FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)) LIMIT 6").fetchall()
        assert len(got) == len(want) and not odd, odd

    return check
