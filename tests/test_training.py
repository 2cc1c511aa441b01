import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritmill.operators import splits, training, usage
from gritmill.sources.advisory_json import read_advisories


def newton(x, y, w, ridge):
    """Weighted logistic regression, the intercept without ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    r = np.full(x.shape[1], ridge)
    r[-1] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(r) + 1e-12 * np.eye(len(b)), x.T @ (w * (p - y)) + r * b)
    return b


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 10, 0] + [0, 5, 3]
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.1 * x[:, 1])))).astype(int)
    g = rng.integers(0, 40, 600)
    return spark.createDataFrame([(*map(float, r), int(k), f"g{i}") for r, k, i in zip(x, y, g)], "a double, b double, c double, y int, project string"), x, y, g


def test_training_against_newton(spark, sample, tmp_path):
    df, x, y, g = sample
    got = training.train_defects(df, ["a", "b", "c"], "y", "project", forest=(5, 3))
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[2] = 1
    z = (x - mean) / std

    def fit(rows):
        w = np.where(y[rows] == 1, len(rows) / (2 * y[rows].sum()), len(rows) / (2 * (1 - y[rows]).sum()))
        return newton(z[rows][:, :2], y[rows], w, 1 / training.INVERSE_RIDGE)

    b = fit(np.arange(600))
    assert np.allclose([got["features"]["a"]["weight"], got["features"]["b"]["weight"], got["intercept"]], b, atol=1e-4) and abs(got["features"]["c"]["weight"]) < 1e-6
    assert np.allclose([got["features"]["b"]["mean"], got["features"]["b"]["std"]], [mean[1], std[1]])
    folds = {r.project: r.f for r in df.select("project", (splits.seeded(F.col("project"), "fold") % training.FOLDS).alias("f")).distinct().collect()}
    fold = np.array([folds[f"g{i}"] for i in g])
    score = np.zeros(600)
    for k in range(training.FOLDS):
        m = fit(np.flatnonzero(fold != k))
        score[fold == k] = z[fold == k][:, :2] @ m[:2] + m[2]
    n1, n0 = y.sum(), 600 - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    assert np.allclose(got["platt"], newton(score[:, None], t, np.ones(600), 0), atol=1e-3) and len(got["forest_platt"]) == 2

    training.save_artifact(spark, got, str(tmp_path / "m"))
    again = training.load_artifact(spark, str(tmp_path / "m"), {})
    assert again == json.loads(json.dumps(got)) and training.load_artifact(spark, str(tmp_path / "none"), {"x": 1}) == {"x": 1}
    p = np.array([r.p for r in df.select(training.defect_probability(again).alias("p")).collect()])
    want = 1 / (1 + np.exp(-(got["platt"][0] * (z[:, :2] @ b[:2] + b[2]) + got["platt"][1])))
    assert np.allclose(p, want, atol=1e-3)
    assert spark.createDataFrame([(None, None, None)], "a double, b double, c double").select(training.defect_probability(again)).first()[0] is not None
    with pytest.raises(ValueError, match="both labels"):
        training.train_defects(df.where("y = 1"), ["a"], "y", "project")


def test_parts_share_no_group_and_keep_their_shares(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"p{int(g)}" if g else None, int(rng.random() < (g % 4) / 4), "x") for g in rng.integers(0, 300, 6000)]
    df = spark.createDataFrame(rows, "project string, y int, part string")
    parts = splits.group_parts(df, "project", "y").collect()
    assert len(parts) == len({r.group for r in parts}) == len({g for g, _, _ in rows})
    largest = max(r.rows for r in parts)
    for name, share in splits.SHARES.items():
        own = sum(r.rows for r in parts if r.part == name)
        assert abs(own - share * len(rows)) <= splits.STRATA * largest
    out = splits.with_part(df, "project", "y")
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(rows) and out.groupBy("project").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    manifest = splits.write_parts(out, str(tmp_path), "y")
    assert sum(p["rows"] for p in manifest["parts"].values()) == len(rows) and manifest["columns"] == ["project", "y"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/parts").count() == len(rows) and json.loads(spark.read.text(f"{tmp_path}/manifest").first()[0]) == manifest
    assert splits.group_parts(df.limit(0), "project", "y").count() == 0
    one = splits.group_parts(spark.createDataFrame([("a", None)], "project string, y int"), "project", "y").collect()
    assert [(r.rows, r.positives, r.part) for r in one] == [(1, 0, "train")]


def test_usage_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abAé/."), n))
    names = [word(int(rng.integers(1, 6))) for _ in range(60)] + ["aaa", "AAA", "", None, "long-name-of-a-package", "%_"]
    texts = [word(int(rng.integers(0, 30))) for _ in range(200)] + ["aaaa", "aaaa", None, "", "x/Long-Name-of-a-package/y", "a" * 5000]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r.name: r.uses for r in usage.contained(n, t).collect()}
    assert got == {x: sum(x in y.lower() for y in texts if y) for x in {x.lower() for x in names if x}}
    assert usage.contained(n.limit(0), t).count() == 0 and {r.uses for r in usage.contained(n, t.limit(0)).collect()} == {0}


def test_advisories_of_odd_shapes(spark):
    v = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    bodies = [
        None, "", "{", "[]", "3", '"text"', "{}", json.dumps({"id": " X ", "aliases": "no", "severity": [{"type": "CVSS_V3", "score": 7}], "affected": {"a": 1}}),
        json.dumps({"database_specific": {"severity": "high", "cvss": {"score": 0, "vectorString": v}}}), json.dumps({"severity": [{"type": "CVSS_V3", "score": "bad"}, {"type": "CVSS_V3", "score": v}, {"type": "CVSS_V3", "score": "worse"}]}),
        json.dumps({"affected": [{"versions": ["1", " 1 ", None], "ranges": [{"type": "GIT", "events": [{"introduced": "0"}, {"last_affected": "2"}, {"fixed": 3}, {"fixed": ""}, {"fixed": "4"}]}]}, None, 5]}),
    ]
    got = [r.advisory for r in read_advisories(spark.createDataFrame([(b, 1) for b in bodies], "body string, advisory int")).collect()]
    for a in got[:7]:
        assert (a.canonical, a.score, a.vector, a.severity, a.versions, a.fixed, a.ranges) == ("UNKNOWN", None, None, "UNKNOWN", [], [], [])
    assert (got[7].canonical, got[7].score, got[7].ranges) == ("X", None, [])
    assert (got[8].score, got[8].vector, got[8].severity) == (0.0, v, "HIGH")
    assert (got[9].score, got[9].vector, got[9].severity) == (9.8, "worse", "CRITICAL")
    assert got[10].versions == ["1"] and got[10].fixed == ["4"] and [tuple(e) for e in got[10].ranges[0].events][:2] == [("0", None, None), (None, None, "2")]
