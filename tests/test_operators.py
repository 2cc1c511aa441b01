import datetime
import math
import random

from pyspark.sql import functions as F

from gritmill.functions import cvss_base, pct_delta, round_half_up, version_key
from gritmill.operators import graph, intervals, relational
from gritmill.plans import core


def test_pct_delta(spark):
    cases = [(0.0, 0.0, 0.0), (0.0, 10.0, 100.0), (0.0, -5.0, -100.0), (10.0, 15.0, 50.0), (20.0, 10.0, -50.0), (1.0, 1000.0, 99900.0), (None, None, 0.0)]
    df = spark.createDataFrame(cases, "p double, c double, want double")
    assert df.where(pct_delta(F.col("p"), F.col("c")) != F.col("want")).count() == 0


def test_versions_and_rounding(spark):
    r = spark.sql("select '1.10.0' a, 'v1.9' b").select(version_key(F.col("a")) > version_key(F.col("b")), round_half_up(F.lit(-0.5))).first()
    assert r[0] and r[1] == 0


def test_intervals(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 4, 6), ("k", 9, 9), ("k", 2, 2)], "k string, s int, e int")
    assert sorted(map(tuple, intervals.merge_intervals(df, ["k"], "s", "e").select("s", "e").collect())) == [(1, 6), (9, 9)]


def test_reach_star_with_tail(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5)], "src long, dst long")
    got = dict(map(tuple, graph.reach(e, spark.createDataFrame([(1,)], "node long"), 3).collect()))
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}


def test_diff_and_merge(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 4), ("w", 5)], "k string, v int")
    got = {r.k: r.change for r in relational.snapshot_diff(a, b, ["k"], "v").collect()}
    assert got == {"x": "REMOVED", "y": "UNCHANGED", "z": "MODIFIED", "w": "ADDED"}
    assert dict(map(tuple, relational.merge_rows(a, b, ["k"]).collect())) == {"x": 1, "y": 2, "z": 4, "w": 5}


def test_cvss(spark):
    cases = [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H", 7.5),
        ("cvss:3.0/av:n/ac:l/pr:n/ui:r/s:c/c:l/i:l/a:n", 6.1), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0),
        ("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None), ("CVSS:2.0/AV:N", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(cases, "v string, want double")
    assert df.where(~cvss_base(F.col("v")).eqNullSafe(F.col("want"))).count() == 0


def _tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_degrees_of_suppliers_and_parts(spark, tmp_path):
    d = _tables(
        spark, tmp_path, supplier=spark.createDataFrame([(0,), (1,), (2,)], "s_suppkey long"), part=spark.createDataFrame([(0,), (1,), (2,)], "p_partkey long"),
        lineitem=spark.createDataFrame([(0, 0, 50.0), (0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "l_suppkey long, l_partkey long, l_quantity double"),
    )
    got = {r.node: (r.fan_in, r.fan_out) for r in core.QUERIES["degree_metrics"](spark, d).collect()}
    assert got == {0: (0, 2), 1: (0, 1), 2: (0, 0), -1: (1, 0), -2: (2, 0), -3: (0, 0)}


def test_tree_rollup_reaches_the_leaves(spark, tmp_path):
    d = _tables(spark, tmp_path, pages=spark.createDataFrame([(1, "http://h/a/b/c?x#y"), (2, "http://h/a/b/"), (3, "http://h"), (4, None), (5, "")], "page_id long, url string"))
    got = {r.prefix: r.n for r in core.QUERIES["tree_rollup"](spark, d).collect()}
    assert got == {"h": 3, "h/a": 2, "h/a/b": 2, "h/a/b/c": 1}


def test_defect_scores_sum_all_features(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, 0, 1, 50.0, "R", "O", 0.0, day), (1, 2, 0, 2, 2.0, "R", "O", 0.1, day), (2, 2, 0, 7, 5.0, "N", "F", 0.1, day + datetime.timedelta(40)), (3, 3, 1, 1, 9.0, "N", "F", 0.1, day)]
    d = _tables(spark, tmp_path, lineitem=spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_shipdate timestamp_ntz"))
    # lines, ship months, flags, small open, small finished, mean and largest line number, parts, orders, large returns, no discount
    vectors = {0: (3, 2, 2, 1, 1, 10 / 3, 7, 2, 2, 1, 1), 1: (1, 1, 1, 0, 0, 1, 1, 1, 1, 0, 0)}
    model = [
        (0.957, 998.0886, 1952.563), (-0.4329, 37.5443, 91.7371), (-0.278, 4.4962, 15.9435), (1.3524, 9.9646, 18.7364), (0.8165, 36.057, 89.5209), (-0.0807, 3.3122, 4.4512),
        (0.7963, 12.0051, 17.5816), (-0.0875, 43.1646, 114.7328), (-0.5085, 212.3266, 405.4502), (1.1824, 5.8443, 12.8372), (0, 0, 1),
    ]
    got = {r.l_suppkey: (r.probability, r.score) for r in core.QUERIES["defect_scoring"](spark, d).collect()}
    for key, x in vectors.items():
        logit = 0.8294944851331408 + sum(w * (v - mu) / sd for v, (w, mu, sd) in zip(x, model))
        p = 1 / (1 + math.exp(-0.9812037165617706 * logit - 0.3323704321727805))
        assert got[key] == (round(p, 4), max(5, min(98, math.floor(100 * p + 0.5))))


def test_trajectory_takes_its_weeks_from_the_data(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    rows = [(1, "error", day(35)), (1, "error", day(42)), (2, "error", day(42)), (1, "view", day(49))]
    d = _tables(spark, tmp_path, events=spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz"))
    assert {tuple(r) for r in core.QUERIES["pairwise_trajectory"](spark, d).collect()} == {(7, 1, 1, 0), (8, 0, 0, 2)}


def test_calibration_error(spark, tmp_path):
    d = _tables(spark, tmp_path, labels=spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"), documents=spark.createDataFrame([(1, 2000), (2, 2000), (3, 90_000)], "doc_id long, n_chars long"))
    assert tuple(core.QUERIES["calibration_ece_whole"](spark, d).first()) == (3, 0.0)
    d = _tables(spark, tmp_path / "b", labels=spark.createDataFrame([(1, 1)], "doc_id long, quality int"), documents=spark.createDataFrame([(1, 2000)], "doc_id long, n_chars long"))
    assert tuple(core.QUERIES["calibration_ece_whole"](spark, d).first()) == (1, 0.5)


def test_rule_search_and_pivot_parts(spark, tmp_path):
    d = _tables(
        spark, tmp_path, lineitem=spark.createDataFrame([(1, 48.0, 0.1, "N", 1), (2, 42.0, 0.0, "N", 1)], "l_orderkey long, l_quantity double, l_discount double, l_returnflag string, l_suppkey long"),
        part=spark.createDataFrame([(1, "x bolt", "b", "t"), (2, "x bolts", "b", "t"), (3, "x", "RED", "t")], "p_partkey long, p_name string, p_brand string, p_type string"),
        events=spark.createDataFrame([(1, "click", 2.0), (1, "error", 3.0), (2, "click", 4.0)], "user_id long, event_type string, value double"),
    )
    assert {(r.l_orderkey, r.rule, r.severity) for r in core.QUERIES["rule_engine"](spark, d).collect()} == {(1, "DEEP_DISCOUNT", "low"), (1, "LARGE_LINES", "high"), (2, "LARGE_LINES", "medium")}
    assert {r.p_partkey for r in core.QUERIES["search_ilike"](spark, d).collect()} == {1, 3}
    r = core.QUERIES["conditional_pivot_whole"](spark, d).first()
    assert (r.users, r.click_sum, r.click_avg, r.error_avg, r.purchase_max, r.with_errors) == (2, 6.0, 3.0, 1.5, 0.0, 1)


def test_null_keys_match_null_keys(spark):
    a = spark.createDataFrame([(None, 1, 5), (1, None, 6), (2, 2, 7)], "k int, l int, v int")
    b = spark.createDataFrame([(None, 1, 8), (1, None, 6), (None, None, 9)], "k int, l int, v int")
    got = {(r.k, r.l): (r.old_value, r.new_value, r.change) for r in relational.snapshot_diff(a, b, ["k", "l"], "v").collect()}
    assert got == {(None, 1): (5, 8, "MODIFIED"), (1, None): (6, 6, "UNCHANGED"), (2, 2): (7, None, "REMOVED"), (None, None): (None, 9, "ADDED")}
    assert sorted(map(str, map(tuple, relational.merge_rows(a, b, ["k", "l"]).collect()))) == sorted(map(str, [(2, 2, 7), (None, 1, 8), (1, None, 6), (None, None, 9)]))
    assert {r.change for r in relational.snapshot_diff(a.limit(0), b, ["k", "l"], "v").collect()} == {"ADDED"}
    assert relational.merge_rows(a, b.limit(0), ["k", "l"]).count() == 3
    first = relational.latest_per_group(spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, None, "c"), (1, 0, "d")], "k int, o int, v string"), ["k"], ["o"])
    assert {(r.k, r.v) for r in first.collect()} == {(None, "b"), (1, "d")} and relational.latest_per_group(first.limit(0), ["k"], ["o"]).count() == 0


def test_clone_windows_equal_a_plain_count(spark, monkeypatch):
    import hashlib

    from gritmill.operators import text

    monkeypatch.setattr(text, "COUNTED", 50, raising=False)
    rng, stems = random.Random(3), ["a", "bé", "c", "d" * 40, "\t"]
    rows = [(i, rng.choice([" ", "  "]).join(rng.choices(stems, k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(5, rows[6][1]), (5, rows[5][1]), (None, rows[7][1]), (None, rows[7][1]), (90, None), (91, " "), (92, "a " * 300), (93, " a" * 300)]
    rows += [(100, "x1 x2 x3 x4 x5 x6 x7 x8"), (100, "x1 x2 x3 x4 x5 x6 x7 x8"), (None, "y1 y2 y3 y4 y5 y6 y7 y8"), (101, "y1 y2 y3 y4 y5 y6 y7 y8")]
    docs = spark.createDataFrame(rows, "id long, t string")
    for size in (1, 2, 8, 70):
        want: dict = {}
        for i, t in rows:
            w = [x for x in (t or "").split(" ") if x]
            for k in range(len(w) - size + 1):
                ids, n = want.get(x := " ".join(w[k : k + size]), (set(), 0))
                want[x] = (ids | ({i} - {None}), n + 1)
        want = {hashlib.sha256(x.encode()).hexdigest(): (len(ids), n) for x, (ids, n) in want.items() if len(ids) >= 2}
        assert {r.hash: (r.n_docs, r.n_places) for r in text.clone_windows(docs, "id", "t", size).collect()} == want


def test_clone_windows_where_all_hashes_are_equal():
    """The words decide: kernels whose hashes are all 0 give the same counts."""
    import numpy as np

    from gritmill.operators import text

    real, rows = text._runs, [b"a b c d a b c e a b c d", b"x b c d y a b c"]
    blocks = []
    for runs in (real, lambda h, size: np.zeros(len(h) - size + 1, np.uint64)):
        text._runs = runs
        try:
            blocks.append(text._Block(rows, 3).new().tolist())
        finally:
            text._runs = real
    assert blocks[0] == blocks[1] and not all(blocks[0])


def test_clone_windows_move_less_than_a_row_for_each():
    """A row for each window and its digest is some 80 bytes; packed stretches are a fraction of it."""
    import pyarrow as pa

    from gritmill.operators import text

    rng = random.Random(5)
    value = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(40_000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([value], pa.binary()), pa.nulls(1, pa.string()), pa.array([True])], names=["value", "own", "once"])
    out = list(text._stretch(8, 8)([batch]))
    assert sum(b.nbytes for b in out) < 12 * 40_000
