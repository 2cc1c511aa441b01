import json

from pyspark.sql import functions as F

from gritmill.functions import advisories, age_seconds, kilobytes, metric_delta, overview_health, paths, version_key
from gritmill.operators import diffs, filters, graph, metrics
from gritmill.sources import manifests

TESTS = """test/validators.js test/sanitizers.js test/app.router.js test/res.send.js tests/test_cli.py tests/test_termui.py spec/helper.js specs/core.spec.js src/test/foo.js src/tests/bar.js
packages/core/__tests__/index.ts src/components/Button.test.jsx src/utils/math.spec.ts test_parser.py client_test.py GsonTest.java UserTestCase.java src/test-helpers/mock.js source/index.test-d.ts""".split()
SOURCES = """src/contest/leaderboard.js src/attestation/verifier.py src/testimony/quote.js src/speedtest/bandwidth.ts src/latest/release.java src/detest/filter.js lib/protest/handler.js lib/router/index.js lib/response.js
src/lib/isMobilePhone.js src/lib/isEmail.js packages/zod/src/types.ts axios/lib/adapters/xhr.js bottle.py requests/models.py src/main/java/com/google/gson/Gson.java""".split()
OTHERS = "docs/conf.py docs/api/index.ts examples/auth/index.js build-browser.js .configs/rollup.config.js vite.config.ts webpack.config.js dist/axios.min.js .claude/skills/triage/scripts/reindex.mjs a.d.ts README.md".split()


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(None).cast("string").alias("none"))
    return row.select(column.alias("x")).first().x


def test_paths(spark):
    rows = [(p, True, False) for p in TESTS] + [(p, False, True) for p in SOURCES] + [(p, False, False) for p in [*OTHERS, "", None]]
    df = spark.createDataFrame(rows, "p string, test boolean, source boolean")
    got = df.where((paths.is_test_path(F.col("p")) != F.col("test")) | (paths.is_production_path(F.col("p")) != F.col("source")))
    assert got.count() == 0
    names = {"./src/foo.js": "src/foo.js", "src\\lib\\bar.js": "src/lib/bar.js", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "p string, want string")
    assert df.where(paths.normal_path(F.col("p")) != F.col("want")).count() == 0
    langs = {"foo.js": "javascript", "foo.ts": "typescript", "foo.tsx": "typescript", "foo.py": "python", "foo.java": "java", "README.md": "unknown", "js": "unknown"}
    df = spark.createDataFrame(list(langs.items()), "p string, want string")
    assert df.where(paths.language_of(F.col("p")) != F.col("want")).count() == 0
    routes = {("/api", "/users/"): "/api/users", ("", ""): "/", ("api", "x"): "/api/x", (None, "//a//b"): "/a/b"}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in routes.items()], "a string, b string, want string")
    assert df.where(paths.route_path(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_file_decisions(spark):
    rows = [
        ("src/components/Button.jsx", 1500, None, "javascript", "source"), ("backend/api/main.py", 2500, None, "python", "source"), ("pkg/service/handler.go", 3000, None, "go", "source"),
        ("src/lib.rs", 4000, None, "rust", "source"), ("package.json", 800, None, "json", "config"), ("README.md", 1200, None, "markdown", "documentation"), (".env.example", 1, None, "text", "config"), ("Dockerfile", None, None, "docker", "config"),
        ("node_modules/react/index.js", 500, "excluded_directory", None, None), (".git/objects/pack/pack-123.pack", 5000, "excluded_directory", None, None), ("dist/assets/index.js", 5000, "excluded_directory", None, None),
        ("assets/logo.png", 12000, "excluded_binary_or_media", None, None), ("tools/tool.exe", 50000, "excluded_binary_or_media", None, None), ("archive.tar.gz", 80000, "excluded_binary_or_media", None, None),
        ("data/large_dataset.json", 2000000, "file_too_large", None, None), (".hidden", 1, "excluded_dotfile", None, None), ("a.min.js", 1, "excluded_minified_bundle", None, None), ("LICENSE", 1, "unsupported_extension", None, None), ("", 1, "invalid_path", None, None), (None, 1, "invalid_path", None, None),
    ]
    df = spark.createDataFrame(rows, "p string, n long, reason string, language string, type string").withColumn("d", paths.file_decision(F.col("p"), F.col("n")))
    bad = df.where(~F.col("d.reason").eqNullSafe(F.col("reason")) | ~F.col("d.language").eqNullSafe(F.col("language")) | ~F.col("d.type").eqNullSafe(F.col("type")) | (F.col("d.include") != F.col("reason").isNull()))
    assert bad.collect() == []


def test_versions_order_and_change(spark):
    order = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0", "1.0.1+build", "^2", "2.1", "10.0.0"]
    df = spark.createDataFrame(list(enumerate(order)), "i int, v string").withColumn("k", advisories.version_order(F.col("v")))
    assert [r.i for r in df.orderBy("k").collect()] == list(range(len(order)))
    assert one(spark, advisories.version_order(F.col("v")).isNull(), v="latest")
    cases = [(None, "1", "ADDED"), ("1", None, "REMOVED"), ("1.0", "1.0", "UNCHANGED"), ("1.9", "1.10", "UPGRADED"), ("2", "1.9", "DOWNGRADED"), ("x", "y", "UPDATED"), (None, None, None)]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert df.where(~advisories.version_change(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    long = spark.createDataFrame([("1.2.3.4.5", "1.2.3.4.6")], "a string, b string")
    assert long.where(version_key(F.col("a")) < version_key(F.col("b"))).count() == 1 and long.where(version_key(F.lit("1.0")) == version_key(F.lit("1"))).count() == 1


def test_affected_versions(spark):
    ev = lambda *e: [{"events": [{"introduced": None, "fixed": None, "last_affected": None, **x} for x in e]}]
    fixed, last = ev({"introduced": "0"}, {"fixed": "4.17.21"}), ev({"introduced": "1.0.0"}, {"last_affected": "1.2.3"})
    two = ev({"introduced": "1.0.0"}, {"fixed": "1.1.0"}, {"introduced": "2.0.0"})
    rows = [
        ("4.17.19", None, fixed, True), ("4.17.21", None, fixed, False), ("4.18.0", None, fixed, False), ("1.0.0", None, last, True), ("1.2.3", None, last, True), ("1.2.4", None, last, False), ("0.9.9", None, last, False),
        ("1.0.1", ["1.0.0", "1.0.1"], None, True), ("1.0.3", ["1.0.0", "1.0.1"], None, False), ("v1.0.1", ["1.0.1"], None, True), ("1.0.5", None, two, True), ("1.5.0", None, two, False), ("9.0.0", None, two, True),
        ("9.9.9", None, None, True), (None, None, fixed, False), ("", None, None, False), ("latest", None, fixed, False), ("1.0.0", None, [{"events": []}], True), ("4.17.21-rc.1", None, fixed, True), ("1.0.0", None, ev({"fixed": "2.0.0"}), True),
    ]
    df = spark.createDataFrame(rows, "v string, versions array<string>, ranges array<struct<events: array<struct<introduced: string, fixed: string, last_affected: string>>>>, want boolean")
    assert df.where(~advisories.is_affected(F.col("v"), F.col("versions"), F.col("ranges")).eqNullSafe(F.col("want"))).collect() == []
    r = spark.createDataFrame([(["1.2.0", "2.0.0", "1.1.0"], "1.0.5"), (["1.2.0", "x"], "3"), ([], "1"), (None, "1")], "f array<string>, v string").select(advisories.remediation(F.col("f"), F.col("v"), F.lit("my-pkg")).alias("x")).collect()
    assert [x.x.split(".")[0][:32] for x in r][2:] == ["No official fixed version curren"] * 2
    assert r[0].x == "Upgrade my-pkg to version 1.1.0 or later." and r[1].x == "Upgrade my-pkg to version 1.2.0 or later."


def test_names_ids_and_severities(spark):
    assert one(spark, advisories.package_name(F.col("e"), F.col("n")), e="PyPI", n=" Foo__bar.Baz ") == "foo-bar-baz"
    assert one(spark, advisories.package_name(F.col("e"), F.col("n")), e="npm", n="@Scope/A_b") == "@scope/a_b"
    assert one(spark, advisories.bare_version(F.col("v")), v="^~1.2") == "1.2" and one(spark, advisories.bare_version(F.col("none"))) == "1.0.0"
    ids = [("X-1", ["cve-2021-9", "CVE-2020-1", None], "CVE-2020-1"), ("GHSA-aaaa-bbbb-cccc", [], "GHSA-aaaa-bbbb-cccc"), (" id ", None, "id"), (None, None, "UNKNOWN")]
    df = spark.createDataFrame(ids, "i string, a array<string>, want string")
    assert df.where(advisories.canonical_id(F.col("i"), F.col("a")) != F.col("want")).count() == 0
    sev = [("low", 9.0, "CRITICAL"), (None, 7.0, "HIGH"), ("", 4.0, "MEDIUM"), (None, 0.1, "LOW"), ("moderate", 0.0, "MEDIUM"), (" high ", None, "HIGH"), ("odd", None, "UNKNOWN"), (None, float("nan"), "UNKNOWN")]
    df = spark.createDataFrame(sev, "t string, s double, want string")
    assert df.where(advisories.severity_of(F.col("t"), F.col("s")) != F.col("want")).count() == 0
    assert one(spark, advisories.alert_severity(F.col("none"))) == "MEDIUM" and one(spark, advisories.alert_severity(F.col("v")), v="low") == "LOW"
    assert [one(spark, advisories.queryable(F.col("v")), v=v) for v in ("1", "", "git+x", "https://x")] == [True, False, False, False]
    refs = spark.createDataFrame([([(None, "u"), ("A", ""), ("B", "v")],)], "r array<struct<type: string, url: string>>").select(advisories.references_of(F.col("r")).alias("x")).first().x
    assert [tuple(r) for r in refs] == [("WEB", "u"), ("B", "v")]
    assert one(spark, kilobytes(F.col("v")), v=1536) == "1.5 KB" and one(spark, overview_health(F.col("c"), F.col("s")), c=60, s=0) == 10
    assert tuple(one(spark, metric_delta(F.col("a"), F.col("b")), a=10, b=14)) == (10.0, 14.0, 4.0, 40.0)
    assert one(spark, age_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:30").cast("timestamp"))) == 90


LOCK = {
    "lockfileVersion": 3,
    "packages": {
        "": {"dependencies": {"express": "^4.19.2", "pg": "^8.11.3"}, "devDependencies": {"vitest": "^1.6.0"}, "optionalDependencies": {"fsevents": "^2.3.3"}},
        "node_modules/express": {"version": "4.19.2", "dependencies": {"accepts": "~1.3.8", "body-parser": "1.20.2"}}, "node_modules/pg": {"version": "8.11.3", "dependencies": {"pg-pool": "^3.6.1"}},
        "node_modules/vitest": {"version": "1.6.0", "dev": True}, "node_modules/fsevents": {"version": "2.3.3", "optional": True, "dev": True},
        "node_modules/accepts": {"version": "1.3.8", "dependencies": {"mime-types": "~2.1.34"}}, "node_modules/body-parser": {"version": "1.20.2"}, "node_modules/mime-types": {"version": "2.1.35"},
        "node_modules/pg-pool": {"version": "3.6.1"}, "node_modules/express/node_modules/cookie": {"version": "0.6.0"},
    },
}


def test_lockfiles_and_manifests(spark):
    legacy = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0", "dev": True}}}, "c": {"optional": True}}}
    pom = "<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>\n<dependency><groupId>g</groupId><artifactId>b</artifactId></dependency></dependencies>"
    files = [
        ("package-lock.json", json.dumps(LOCK)), ("package.json", json.dumps({"dependencies": {"ignored": "1"}})), ("x/package-lock.json", json.dumps(legacy)), ("x/package.json", json.dumps({"dependencies": {"a": "^1"}})),
        ("y/package.json", json.dumps({"dependencies": {"q": "1"}, "devDependencies": {"r": None}})), ("y/requirements.txt", "# c\nFlask>=2.0\r\n-r other\nplain\n bad line here\n"), ("z/pom.xml", pom),
        ("z/build.gradle", "implementation 'g:n:1.0'\napi \"h:m:2\""), ("bad/package-lock.json", "{"), ("empty/package-lock.json", " "), ("null/package-lock.json", None), ("list/package-lock.json", "[1]"), ("src/a.py", "x"),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    rows = manifests.dependencies(df).collect()
    by = lambda path: {r.package_name: (r.version, r.version_specifier, r.dependency_type, r.is_direct, r.depth, r.parent_package) for r in rows if r.path == path}
    lock = by("package-lock.json")
    assert len(lock) == 9 and sum(v[3] for v in lock.values()) == 4
    assert lock["express"] == ("4.19.2", "^4.19.2", "direct", True, 1, None) and lock["vitest"][2:5] == ("development", True, 1) and lock["fsevents"][2:4] == ("optional", True)
    assert lock["accepts"] == ("1.3.8", None, "transitive", False, 2, "express") and lock["mime-types"][4:] == (3, "accepts") and lock["cookie"][4:] == (2, "express")
    assert by("x/package-lock.json") == {"a": ("1.0.0", "^1", "direct", True, 1, None), "b": ("2.0.0", None, "development", False, 2, "a"), "c": ("0.0.0", None, "optional", False, 1, None)}
    assert {k: v[:3] for k, v in by("y/package.json").items()} == {"q": ("1", "1", "direct"), "r": ("*", "*", "development")}
    assert {k: v[0] for k, v in by("y/requirements.txt").items()} == {"Flask": "2.0", "plain": "*"}
    assert {k: (v[0], v[2]) for k, v in by("z/pom.xml").items()} == {"g:a": ("1", "test"), "g:b": ("*", "direct")}
    assert {k: v[0] for k, v in by("z/build.gradle").items()} == {"g:n": "1.0", "h:m": "2"}
    assert {r.path for r in rows} == {"package-lock.json", "x/package-lock.json", "y/package.json", "y/requirements.txt", "z/pom.xml", "z/build.gradle"}
    assert manifests.dependencies(df.limit(0)).count() == 0


DIFF = """diff --git a/src/math.js b/src/math.js
index 1111111..2222222 100644
--- a/src/math.js
+++ b/src/math.js
@@ -10,5 +10,7 @@ function add(a, b) {
   const c = a + b;
-  return c;
+  const d = c * 2;
+  const e = d + 1;
+  return e;
 }
diff --git a/src/new.js b/src/new.js
new file mode 100644
--- /dev/null
+++ b/src/new.js
@@ -0,0 +1,4 @@
+a
+b
+c
+
diff --git a/old.js b/old.js
deleted file mode 100644
--- a/old.js
+++ /dev/null
@@ -1,3 +0,0 @@
-a
-b
-c
diff --git a/a.js b/b.js
similarity index 90%
rename from a.js
rename to b.js
diff --git a/i.png b/i.png
Binary files a/i.png and b/i.png differ
diff --git a/bad.js b/bad.js
--- a/bad.js
+++ b/bad.js
@@ invalid hunk header @@
+hello
"""


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "--- x.py\n+++ y.py\n@@ -1 +1,2 @@\n a\n+b\n\\ No newline at end of file")], "diff_id long, diff string")
    lines = diffs.diff_lines(df)
    files = {(r.diff_id, r.file_path): (r.old_path, r.new_path, r.change_type, r.is_binary, r.additions, r.deletions) for r in diffs.diff_files(lines).collect()}
    assert files == {
        (1, "src/math.js"): ("src/math.js", "src/math.js", "modified", False, 3, 1), (1, "src/new.js"): ("/dev/null", "src/new.js", "added", False, 4, 0), (1, "old.js"): ("old.js", "/dev/null", "deleted", False, 0, 3),
        (1, "b.js"): ("a.js", "b.js", "renamed", False, 0, 0), (1, "i.png"): ("i.png", "i.png", "modified", True, 0, 0), (1, "bad.js"): ("bad.js", "bad.js", "modified", False, 0, 0), (4, "y.py"): ("x.py", "y.py", "renamed", False, 1, 0),
    }
    new = {(r.diff_id, r.file_no): (r.first, r.last) for r in diffs.changed_ranges(lines, "new").collect()}
    old = {(r.diff_id, r.file_no): (r.first, r.last) for r in diffs.changed_ranges(lines, "old").collect()}
    assert new == {(1, 1): (11, 13), (1, 2): (1, 4), (4, 1): (2, 2)} and old == {(1, 1): (11, 11), (1, 3): (1, 3)}
    hunks = {(r.diff_id, r.file_no): (r.old_start, r.old_count, r.new_start, r.new_count, r.heading) for r in diffs.diff_hunks(lines).collect()}
    assert hunks[1, 1] == (10, 5, 10, 7, "function add(a, b) {") and hunks[4, 1] == (1, 1, 1, 2, "")
    assert "malformed hunk header" in {r.warning for r in diffs.diff_warnings(lines).collect()}
    assert diffs.diff_lines(df.limit(0)).count() == 0


def test_impact_and_neighbours(spark):
    e = spark.createDataFrame([("a", "base"), ("b", "base"), ("c", "base"), ("d", "c"), ("base", "a"), ("d", "d"), (None, "base")], "src string, dst string")
    got = {r.node: (r.depth, r.via) for r in graph.impact(e, spark.createDataFrame([("base",)], "node string")).collect()}
    assert got == {"a": (1, "base"), "b": (1, "base"), "c": (1, "base"), "d": (2, "c")}
    assert {r.node for r in graph.cycles_of_two_steps(e).collect()} == {"a", "base"}
    assert graph.neighbours(e, spark.createDataFrame([("d",)], "node string")).count() == 2


def test_upserts_and_first_rows(spark):
    t = spark.createDataFrame([(1, "a", "OPEN"), (2, "b", "RESOLVED"), (None, "n", "OPEN")], "k int, v string, status string")
    s = spark.createDataFrame([(1, "A", "NEW"), (2, "B", "NEW"), (3, "C", "NEW"), (None, "N", "NEW")], "k int, v string, status string")
    got = {tuple(r) for r in filters.upsert_keeping(t, s, ["k"], ["status"], F.col("status") == "RESOLVED").collect()}
    assert got == {(1, "A", "OPEN"), (2, "b", "RESOLVED"), (3, "C", "NEW"), (None, "N", "OPEN")}
    assert {tuple(r) for r in filters.insert_absent(t, s, ["k"]).collect()} == {(1, "a", "OPEN"), (2, "b", "RESOLVED"), (None, "n", "OPEN"), (3, "C", "NEW")}
    d = spark.createDataFrame([(1, 5, "x"), (1, 5, "w"), (1, 9, "a"), (None, 1, "n")], "k int, o int, v string")
    assert {tuple(r) for r in filters.keep_first(d, ["k"], ["o"]).collect()} == {(1, 5, "w"), (None, 1, "n")}
    assert filters.page_bounds(None, None) == (20, 1) and filters.page_bounds(0, -3) == (1, 1) and filters.page_bounds(1000, 2) == (100, 2)
    rows = spark.createDataFrame([("7", 3), ("x", 7), ("y", 8)], "id string, n int")
    assert rows.where(filters.number_or_id(F.col("n"), F.col("id"), "7")).count() == 2 and rows.where(filters.number_or_id(F.col("n"), F.col("id"), "y")).count() == 1


def test_classifier_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (None, 0.5), (1, None)], "label int, score double")
    r = metrics.classifier_metrics(df).first()
    assert (r.n, r.positives, r.roc_auc, r.tp, r.fp, r.tn, r.fn, r.recall) == (4, 2, 0.875, 2, 1, 1, 0, 1.0) and abs(r.pr_auc - (1 + 2 / 3) / 2) < 1e-12
    empty = metrics.classifier_metrics(df.limit(0)).first()
    assert empty.roc_auc is None and empty.n is None
