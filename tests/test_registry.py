"""Driver contract: every registered query runs on the smallest tables, names
all its columns, and has an oracle unless its values are not deterministic."""

import re

from conftest import SF_SMALL

ROWS_ONLY = {"embedding_timing"}


def test_every_query_runs_with_named_columns(spark):
    from tessera.plans.oracle import oracle_queries
    from tessera.plans.registry import registry
    queries, oracle = registry(), oracle_queries()
    assert set(queries) - set(oracle) == ROWS_ONLY and set(oracle) <= set(queries)
    for name, fn in queries.items():
        df = fn(spark, SF_SMALL)
        assert all(re.fullmatch(r"[a-z_][a-z0-9_]*", c) for c in df.columns), (name, df.columns)
        assert len(set(df.columns)) == len(df.columns), name
        df.count()   # runs over the whole tables (a sparse corpus may give 0 rows)


def test_entry_names():
    import __spark_entry__ as entry
    from tessera.plans.registry import registry
    assert set(registry()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["model_name", "doc", "avg_coherence", "section_boundary_contrast",
                          "semantic_search_precision", "overall_score"]
    assert df.count() > 0
