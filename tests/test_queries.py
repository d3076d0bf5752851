"""Every query with SQL gives DuckDB's rows over the small tables."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from cowrie.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE_SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    names = lambda t: sorted(r[0] for r in duck.execute(f"DESCRIBE {t}").fetchall())
    assert names("got") == names("want")
    cols = ", ".join(f'"{c}"' for c in names("got"))
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_entry_has_rows(spark):
    assert driver.entry(spark).limit(1).count() == 1
    assert set(ORACLE_SQL) <= set(driver.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_works_without_the_training_data_operators(tmp_path, pipeline_too):
    root = pathlib.Path(driver.__file__).parent
    shutil.copytree(root / "cowrie", tmp_path / "cowrie", ignore=lambda at, names: [n for n in names if n in ("llm", "__pycache__")])
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (not pipeline_too)]:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; from cowrie.plans import queries as p; assert set(e.queries()) == set(p.QUERIES) and set(e.oracle_sql()) == set(p.ORACLE_SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)
