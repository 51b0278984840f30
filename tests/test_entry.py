"""The driver's contract: names, columns against the oracles, and independence from the llm subpackage."""

import ast
from pathlib import Path

import duckdb
import pytest

from leafproof.plans import oracle, registry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(oracle.sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(shown(row[names.index(c)]) for c in order) for row in got.fetchall())
    assert want, "an empty result shows nothing"
    assert sorted(tuple(shown(x) for x in r) for r in df.select(*order).collect()) == want


def test_every_query_has_an_oracle():
    assert set(oracle.sql()) == set(registry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "leafproof").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_entry_runs(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 10


def test_the_rest_works_without_the_subpackage_and_the_pipeline(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(x.startswith('op') or x == 'pipeline' for x in q))"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(registry.queries())), str(len(oracle.sql())), "False"]


def test_filters_reach_the_scan_of_the_page_index(spark):
    from leafproof.sources.corpus import Corpus

    c = Corpus(spark, SF)
    plan = c.pages.filter("doc_id = 'src1' and is_current").select("page_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,src1)" in plan and "seen" not in plan.split("ReadSchema")[1]
    assert "In(term" in c.postings.filter("term in ('a', 'b')")._jdf.queryExecution().executedPlan().toString()
