"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"synth_render"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def canon(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    q = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in q.fetchall()]
    assert canon(df.select(*[f"`{c}`" for c in cols]).collect()) == canon(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_query_runs_and_repeats(spark, name):
    a = registry.QUERIES[name](spark, SF)
    b = registry.QUERIES[name](spark, SF)
    assert a.schema == b.schema and canon(a.collect()) == canon(b.collect())


@pytest.mark.parametrize("module", ["synth", "judge", "kernels"])
def test_plan_modules_import_alone(module):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import plumbline.plans.{module}"], cwd=root, check=True)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_entry_without_the_corpus_operators(tmp_path):
    """The library stands without them."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') for x in n) and 'pipeline' not in n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
