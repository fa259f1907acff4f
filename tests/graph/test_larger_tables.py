"""Queries keep their results where tables are larger than the driver's smallest ones."""

import pytest
from juriscope.plans import indexes, oracles, queries
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "customer", "nation", "region")


def same_as_sql(spark, name, sf_dir=SF):
    """Rows of the query and of its SQL over the tables of ``sf_dir``, equal as bags."""
    sql = duckdb.connect()
    for t in TABLES:
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sql.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want.fetchall())), name


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The tables with keys of a million more, every row twice: citations of both halves."""
    at = tmp_path_factory.mktemp("shifted")
    keys = {"orders": {"o_orderkey": 1_000_000}, "lineitem": {"l_orderkey": 1_000_000, "l_partkey": 999_990}}
    for t in TABLES:
        more = ", ".join(f"{c} + {n} * i AS {c}" for c, n in keys.get(t, {}).items())
        copies = 2 if t in keys else 1
        duckdb.sql(f"COPY (SELECT * REPLACE ({more}) FROM '{SF}/{t}.parquet', range({copies}) r(i)) TO '{at}/{t}.parquet'" if more else f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{at}/{t}.parquet'")
    return str(at)


def test_writings_ids_are_no_ids_of_opinions(spark, shifted):
    same_as_sql(spark, "citing_scope", shifted)


#: Queries that deal out numbers only: the table of edges with all fields of both opinions
#: was over 40 times as large as the input, shuffles included.
NARROW = ["edge_validation", "treatment_labels", "act_verbs", "history_edges", "history_components", "later_courts_status", "history_reach", "reported_acts_antijoin", "later_courts_ranks", "pill_validation", "later_courts_pills", "history_chain", "drawn_reports", "history_summary", "card_labels", "history_layout_full", "home_search_counts"]


@pytest.fixture()
def no_wide_edges(monkeypatch):
    def refuse(self):
        raise AssertionError("edges with all fields of both opinions were asked for")

    monkeypatch.setattr(indexes.Graph, "views", property(refuse))
    monkeypatch.setattr(indexes, "_GRAPHS", {})


@pytest.mark.parametrize("name", NARROW)
def test_queries_deal_out_numbers_only(spark, no_wide_edges, name):
    same_as_sql(spark, name)


def test_marks_are_judged_as_the_wide_edges(spark):
    g = indexes.graph(spark, SF)
    fields = ["citing", "cited", "treatment", "verdict", "relation", "severity", "citing_level", "cited_is_scoped"]
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*fields).collect())))
    assert rows(g.views.withColumn("cited_is_scoped", F.coalesce("cited_is_scoped", F.lit(False)))) == rows(g.judged)


def test_opinions_of_one_id_and_hubs(spark, no_wide_edges, monkeypatch, tmp_path):
    """An id that two opinions have makes two rows of an edge, as in SQL."""
    for t in TABLES:
        twice = f" UNION ALL SELECT * FROM '{SF}/{t}.parquet' WHERE o_orderkey < 40" if t == "orders" else ""
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet'{twice}) TO '{tmp_path}/{t}.parquet'")
    monkeypatch.setattr(indexes.hubs, "hubs", lambda rows, group, most=0: rows.groupBy(group).count().filter("count > 5").select(group))
    for name in ("treatment_labels", "edge_validation", "history_edges"):
        same_as_sql(spark, name, str(tmp_path))
