"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from siltstone import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(map(repr, pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, db, name):
    got = rows(queries.QUERIES[name](spark, FOLDER).toPandas())
    want = rows(db.execute(queries.SQL[name]).fetch_df())
    assert got[0] == want[0]
    assert got[1] == want[1]


#: Queries without SQL, and the test that holds each against plain loops or exact results.
TESTED = {
    "cache_hit_rates": "test_streams.test_cache_queries",
    "cache_replayed": "test_streams.test_cache_queries",
    "chunk_document": "test_folds.test_document_chunks",
    "chunk_html": "test_embedding.test_html_chunks_hold_all_text_under_the_tags",
    "chunk_markdown": "test_folds.test_markdown_chunks",
    "chunk_sentence": "test_folds.test_sentence_chunks_cover_their_texts",
    "chunk_structural": "test_folds.test_structural_chunks",
    "connected_components_all": "test_folds.test_components_of_all_edges",
    "cooccurrence": "test_operators.test_entities_and_cooccurrence",
    "late_search": "test_late.test_recall_of_the_index",
    "rate_limit_exact": "test_folds.test_exact_rate_limit",
    "running_average_all": "test_queries.test_both_running_averages",
    "search_routed": "test_folds.test_routed",
    "strategy_adaptive": "test_folds.test_adaptive_and_unseen",
    "strategy_cascade": "test_folds.test_strategies_keep_their_promises",
    "strategy_hybrid": "test_folds.test_hybrid",
    "strategy_iterative": "test_folds.test_strategies_keep_their_promises",
    "strategy_unseen": "test_folds.test_adaptive_and_unseen",
}


def test_every_query_without_sql_has_a_test():
    assert set(TESTED) == set(queries.QUERIES) - set(queries.SQL)
    for place in TESTED.values():
        file, name = place.split(".")
        with open(os.path.join(os.path.dirname(__file__), f"{file}.py"), encoding="utf-8") as f:
            assert f"def {name}(" in f.read(), place


def test_both_running_averages(spark):
    one, two = (sorted((r["customer"], r["average"]) for r in queries.QUERIES[n](spark, FOLDER).collect()) for n in ("running_average", "running_average_all"))
    assert len(one) == len(two) > 0 and all(a == c and abs(b - d) <= 1.1e-4 for (a, b), (c, d) in zip(one, two))
