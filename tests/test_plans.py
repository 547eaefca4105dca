"""Physical plans: what must and what must not be in them."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from compare import TABLES, check, connect
from starweave.operators import neighbours as N
from starweave.sources import fixture_views as T

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(frame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


OWN = set(entry._QUERIES)  # the queries of the rating part; those on text have their own tests
MODELS = {name for name in OWN if name.startswith("gbt_")}


@pytest.mark.parametrize("name", sorted(OWN - MODELS))
def test_query_matches_its_sql(spark, name):
    query = entry.queries()[name]
    found, n = check(spark, connect(FOLDER), query, entry.oracle_sql()[name], FOLDER)
    assert found == [] and n > 0


def test_no_slow_operators(spark):
    for name in ("predict_pearson_cf", "predict_cosine_cf", "co_rating_stats", "hybrid_feature_table", "popular_item_pairs"):
        text = plan(entry.queries()[name](spark, FOLDER))
        for operator in FORBIDDEN:
            assert operator not in text, (name, operator)


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(N.pearson_neighbours(T.train_ratings(spark, FOLDER), entry.pairs(spark, FOLDER)))
    assert text.count("WindowGroupLimit") >= 2


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["user_mean_rating"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    text = plan(entry.queries()["scan_validation_pairs"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01" in text


def test_every_registered_query_has_sql_or_is_a_model():
    assert OWN - set(entry.oracle_sql()) == {"gbt_feature_model", "gbt_hybrid_model", "gbt_selector_model"}
    assert set(entry.oracle_sql()) <= set(entry.queries()) and OWN <= set(entry.queries())
    assert len(TABLES) == 14


def test_staged_predictions_scan_the_facts_at_most_twice(spark):
    # ratings are staged; the requested pairs are read for the answer, once whole and once for blank ids
    for name in ("predict_pearson_cf", "predict_cosine_cf", "top_neighbours"):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert sum("Location" in line and "lineitem.parquet" in line for line in text.splitlines()) <= 2, name


def test_popular_items_are_filtered_below_the_aggregate(spark):
    text = plan(entry.queries()["popular_pair_similarity"](spark, FOLDER))
    assert "CartesianProduct" not in text and "INSET" in text.replace(" IN (", "INSET")


def test_dictionary_does_not_open_the_facts(spark):
    ratings, users, businesses = (f(spark, FOLDER) for f in (T.train_ratings, T.users, T.businesses))
    for part in entry.X.entity_rows(ratings, users, businesses):
        assert "Generate" not in plan(part)
