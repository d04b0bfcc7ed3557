"""Every core query against its oracle, on whole tables."""

import __spark_entry__ as entry_module
import pytest

from .conftest import canonical

CORE = {name: f for r in entry_module._REGISTRIES for name, f in r.queries.items()}
SQL = {name: sql for r in entry_module._REGISTRIES for name, sql in r.sql.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(name, spark, sf_dir, duck):
    df = CORE[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)


def test_entry_has_a_stable_schema(spark, sf_dir):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "repo", "path", "language", "score"]


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_library_does_not_import_llm():
    from pathlib import Path

    root = Path(entry_module.__file__).parent / "seine"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "seine.llm" not in f.read_text(), f


def test_runs_twice_alike(spark, sf_dir):
    for name in ("search_scope_receipt", "coverage_fingerprint", "corpus_digest"):
        assert CORE[name](spark, sf_dir).collect() == CORE[name](spark, sf_dir).collect()


def test_hidden_rows_change_nothing(spark, sf_dir):
    """What a caller may not see influences neither counts nor digests."""
    from pyspark.sql import functions as F

    from seine.plans import search as S
    from seine.queries.search import files, repos

    visible = repos(spark, sf_dir).where("is_public").select(F.col("name").alias("repo"))
    all_files = files(spark, sf_dir)
    cleared = all_files.join(visible, "repo", "left_semi")
    assert S.search_stats(all_files, "beacon", visible=visible).collect() == S.search_stats(cleared, "beacon", visible=visible).collect()


def test_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = CORE["assertion_prefix_list"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(object,harborlight.)" in plan and "EqualTo(predicate,REFERENCES_PROTO_FIELD)" in plan
    assert "received_at" not in plan
