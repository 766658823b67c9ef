"""Every query with SQL against DuckDB on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from labelloom.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{round(float(x), 5):.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    result = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(names).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(__spark_entry__.queries())


def test_words_of_many_kinds(spark, duck, tmp_path, monkeypatch):
    """Frequent words are looked up where the text is, others by word; a document's rows count together; null and empty texts have none."""
    from labelloom.plans import datasets

    docs = [(i % 17, " ".join(f"w{chr(97 + (i * j) % 19)}" for j in range(i % 13)) if i % 7 else None, "en", None if i % 3 else "web", 0) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for most in (4, 1 << 18):
        monkeypatch.setattr(datasets, "FREQUENT", most)
        features = datasets.words(spark, str(tmp_path)).features
        plan = features._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(example_id#\d+L, \d", plan) and not re.search(r"hashpartitioning\(example_id#\d+L, word", plan)
        for name in ("xfm_04_document_frequency", "xfm_10_tf_idf", "xfm_11_tf_idf_real", "xfm_16_density"):
            df, result = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.ORACLE[name])
            names = [c[0] for c in result.description]
            assert sorted(tuple(map(plain, r)) for r in df.select(names).collect()) == sorted(tuple(map(plain, r)) for r in result.fetchall())


def test_hashing_deals_orders_once(spark, monkeypatch):
    """By order, over more tasks as there are more lines: sums, hashed sums and norms of an order are formed where its lines are."""
    from labelloom.plans import datasets

    monkeypatch.setattr(datasets, "LINES", 1000)
    for name in ("xfm_02_normalize", "xfm_07_hashing", "xfm_09_pipeline"):
        plan = registry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"hashpartitioning\(\w*(?:example_id|orderkey)#\d+L.*?(\d+)\)", plan) == ["6"]


def test_labelled_ranks_are_made_in_rows(spark):
    """Of the labels ranked for an example only the first five become rows: no window sorts a row for each pair."""
    plan = registry.QUERIES["met_28_psndcg"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "% 41" in plan and not re.search(r"Sort \[example_id#\d+L[^\n]*_w", plan)
