"""Places within groups that no task holds equal those of a sort in memory."""

import random

from juriscope.operators import hubs
from pyspark.sql import functions as F


def slow(rows):
    out = {}
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        first = {r: i for i, r in enumerate(own)}
        by_name = {r: i for i, r in enumerate(sorted(own, key=lambda r: (r[3], first[r])))}
        constant = first
        for r in own:
            out[r[0], r[1]] = (first[r], by_name[r], constant[r])
    return out


def placed(frame, most):
    first = ("dom", [F.col("size").desc(), F.col("member").asc()])
    return hubs.places(frame, "grp", "member", first, {"by_name": [F.lower("name").asc()], "tied": [F.lit(1).asc()]}, most)


def test_one_group_holds_most_rows(spark):
    draw = random.Random(3)
    rows = [(0 if i % 3 else i % 40, i, draw.randrange(4), draw.choice("abc") * draw.randrange(3)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "grp long, member long, size int, name string").repartition(7)
    want = slow(rows)
    for most in (0, 20, 1000, 5000):
        got = {(r.grp, r.member): (r.dom, r.by_name, r.tied) for r in placed(frame, most).collect()}
        assert got == want


def test_null_groups_and_no_rows(spark):
    schema = "grp long, member long, size int, name string"
    rows = [(None, 1, 1, "b"), (None, 2, 1, "a"), (5, 3, None, None), (5, 4, 2, "x"), (5, 5, 2, None)]
    for most in (0, 1, 9):
        got = {(r.grp, r.member): (r.dom, r.by_name, r.tied) for r in placed(spark.createDataFrame(rows, schema), most).collect()}
        assert got == {(None, 1): (0, 1, 0), (None, 2): (1, 0, 1), (5, 3): (2, 1, 2), (5, 4): (0, 2, 0), (5, 5): (1, 0, 1)}
    assert placed(spark.createDataFrame([], schema), 3).count() == 0


def test_windows_see_no_row_of_a_hub(spark, monkeypatch):
    frame = spark.range(2000).selectExpr("if(id < 1990, 0L, id) AS grp", "id AS member", "1 AS size", "'n' AS name")
    windows, seen = hubs._in_windows, []
    monkeypatch.setattr(hubs, "_in_windows", lambda rows, *a: seen.append(rows.count()) or windows(rows, *a))
    assert placed(frame, 100).agg(F.max("dom")).head()[0] == 1989 and seen == [10]
