import random

import pytest
from pyspark.sql import functions as F

from gritmill.operators import alerts, clones, endpoints, graph, relations, review, snapshots
from gritmill.sources import commits, python_code


def reachable(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        new = {b for a, b in edges if a == x} - seen
        seen |= new
        todo += new
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)]
    nodes = {x for p in pairs for x in p}
    near = {x: reachable(pairs, x) for x in nodes}
    want = {x: min(y for y in near[x] if x in near[y]) for x in nodes}
    df = spark.createDataFrame(pairs + [pairs[0], (None, 3), (4, None)], "src int, dst int")
    assert {r.node: r.component for r in graph.strong_components(df).collect()} == want
    sizes = graph.cycle_sizes(graph.strong_components(df)).collect()
    assert sum(r["size"] for r in sizes) == sum(1 for x in nodes if list(want.values()).count(want[x]) > 1)


def test_graphs_without_rows_and_distances(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert graph.strong_components(none).count() == 0
    roots = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    assert [tuple(r) for r in graph.distances(none, roots).collect()] == [(1, 1, None)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(1, 5), (2, 2), (3, None)], "src int, dst int")
    got = {r.node: (r.depth, r.via) for r in graph.distances(chain, roots).collect()}
    assert got[5] == (2, 1) and got[6] == (3, 5) and got[20] == (17, 19) and got[4] == (4, 3) and len(got) == 20
    assert graph.distances(chain, roots.where("node > 9")).count() == 0
    nodes, edges = graph.graph_export(chain)
    assert nodes.count() == 20 and edges.count() == 21 and graph.within(edges, nodes.where("node < 4")).count() == 3


ENDPOINT = "method string, path string, is_public boolean, authenticated boolean, authorized boolean, is_async boolean, has_try boolean, database boolean, external boolean, statuses array<int>, completeness string, depth int"


def test_endpoints(spark):
    rows = [
        ("POST", "/a", False, False, False, True, False, True, True, [200, 404], "UNKNOWN", 4),
        ("GET", "/a/:id", False, True, False, False, True, False, False, [200], "COMPLETE", 1),
        ("GET", "/health", True, False, False, False, False, False, False, None, "PARTIAL", 1),
        (None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, ENDPOINT).withColumn("api", F.lit("x"))
    found = endpoints.findings(e, ["api", "path"])
    by = {p: sorted(r.rule for r in found.collect() if r.path == p) for p in ("/a", "/a/:id", "/health", None)}
    assert len(by["/a"]) == 7 and by["/a/:id"] == ["API_MISSING_AUTHORIZATION"] and by["/health"] == [] and by[None] == ["API_MISSING_AUTH"]
    (r,) = endpoints.reliability(e, found, ["api"]).collect()
    assert (r.endpoints, r.unauthenticated, r.unknown, r.methods, r.high, r.medium, r.low) == (4, 2, 1, {"POST": 1, "GET": 2}, 3, 3, 3)
    assert r.score == round(100 - 36 - 18 - 6 - 15 * 2 / 3 - 10 / 4, 2)
    assert endpoints.reliability(e.limit(0), found, ["api"]).count() == 0
    pick = lambda *c: spark.range(1).select(*[x.alias(f"x{i}") for i, x in enumerate(c)]).first()
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    got = pick(endpoints.completeness(yes, F.lit(1)), endpoints.completeness(no, F.lit(0)), endpoints.completeness(yes, F.lit(None).cast("int")), endpoints.error_coverage(yes, yes), endpoints.error_coverage(none, yes), endpoints.error_coverage(no, no), endpoints.call_depth(yes, yes, yes))
    assert tuple(got) == ("COMPLETE", "UNKNOWN", "PARTIAL", "IDENTIFIED", "UNIDENTIFIED", "PARTIAL", 4)
    changed = endpoints.changes(e, e.where("path is null or path <> '/health'").withColumn("statuses", F.array(F.lit(200))), ["statuses", "authenticated"])
    assert {r.path: (r.change, r.changed) for r in changed.collect()} == {"/a": ("MODIFIED", ["statuses"]), "/a/:id": ("UNCHANGED", []), "/health": ("REMOVED", []), None: ("MODIFIED", ["statuses"])}


def test_review(spark):
    names = "id int, files long, churn long, complexity_delta int, nesting_delta int, high long, medium long, other long, extreme boolean, direct long, transitive long, affected_files long, worst_defect long, risky_files long"
    rows = [(1, 0) + (900,) + (None,) * 11, (2, 1, 10) + (0,) * 5 + (None,) + (0,) * 5, (3, 9, 5000, 20, 9, 3, 0, 0, True, 9, 9, 18, 90, 2), (4, 1, 600, 0, 0, 0, 1, 0, False, 1, 0, 1, 0, 0)]
    got = {r.id: r for r in review.assessed(spark.createDataFrame(rows, names)).collect()}
    assert (got[1].score, got[1].category, got[1].gate, got[1].reasons) == (0, "LOW", "APPROVED", [])
    assert (got[2].score, got[2].gate) == (5, "APPROVED")
    assert (got[3].score, got[3].category, got[3].gate, got[3].reasons) == (100, "CRITICAL", "BLOCKED", ["SCORE_85", "EXTREME_COMPLEXITY", "CRITICAL_BLAST_RADIUS"])
    assert (got[4].score, got[4].gate, got[4].reasons) == (28, "WARNING", ["NEW_MEDIUM_SMELL", "LARGE_CHURN"])
    old = spark.createDataFrame([("a", "f", 3, 1), ("a", "g", 9, 2)], "file string, symbol string, complexity int, nesting int")
    new = spark.createDataFrame([("a", "f", 9, 1), ("a", "h", 4, 2)], old.schema)
    deltas = review.structural_deltas(old, new)
    assert {r.symbol: (r.complexity_delta, r.nesting_delta) for r in deltas.collect()} == {"f": (6, 0), "h": (4, 2)}
    s = "rule string, file string, symbol string"
    a, b = spark.createDataFrame([("X", "a", None), ("Y", "a", "f")], s), spark.createDataFrame([("X", "a", None), ("Z", "a", "f"), ("Z", "a", "f")], s)
    smells = review.smell_delta(a, b)
    assert {r.rule: r.state for r in smells.collect()} == {"X": "pre-existing", "Y": "fixed", "Z": "new"}
    files = spark.createDataFrame([("a", 61), ("b", 85), ("c", 10)], "file string, score int")
    found = review.item_findings(deltas.withColumn("id", F.lit(1)), smells.withColumn("severity", F.lit("low")).withColumn("id", F.lit(1)), files.withColumn("id", F.lit(1)), ["id"])
    assert sorted((r.finding, r.severity) for r in found.collect()) == [("COMPLEXITY_INCREASE", "high"), ("COMPLEXITY_INCREASE", "medium"), ("HIGH_DEFECT_PROPENSITY_FILE", "high"), ("HIGH_DEFECT_PROPENSITY_FILE", "medium"), ("NEW_CODE_SMELL", "low")]


def test_snapshots(spark):
    paths = ["src/a.js", "src/a.test.js", "lib/b.py", "tests/lib/b_test.py", "c.java", "cTest.java", "test_d.py", "e.js", "e.js", None]
    got = {r.path: r.has_test for r in snapshots.has_test(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"src/a.js": 1, "src/a.test.js": 1, "lib/b.py": 1, "tests/lib/b_test.py": 1, "c.java": 1, "cTest.java": 1, "test_d.py": 1, "e.js": 0}
    files = spark.createDataFrame([("a", 10, 1, 2, 3, 4, 5, 1), ("b", 20, 0, 0, 0, None, None, None)], "path string, lines int, class_count int, import_count int, export_count int, fan_in int, fan_out int, has_test int")
    functions = spark.createDataFrame([("a", 3), ("a", 4)], "path string, complexity int")
    f = snapshots.file_features(files, functions, spark.createDataFrame([("b",)], "path string"))
    rows = {r.path: r for r in f.collect()}
    assert (rows["a"].function_count, rows["a"].avg_complexity, rows["a"].max_complexity, rows["a"].code_smell_count) == (2, 3.5, 4, 0) and (rows["b"].avg_complexity, rows["b"].fan_in, rows["b"].code_smell_count) == (0.0, 0, 1)
    assert snapshots.as_entities(f, "file", "path").count() == 22
    one = snapshots.profile(spark.createDataFrame([(1, 10, 0, 2, 1), (1, 5, 4, None, None)], "s int, lines int, complexity int, smells int, has_test int"), ["s"]).first()
    assert tuple(one) == (1, 2, 15, 2.5, 4, 2, 50.0)
    k = "path string, lines int, complexity int, smells int"
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, None), ("d", 1, 1, 1)], k)
    new = spark.createDataFrame([("a", 100, 2, 0), ("c", 1, 1, 0), ("d", 2, 1, 1), ("e", 1, 1, 1)], k)
    got = {r.path: (r.change, r.is_regression, r.is_improvement, r.factors) for r in snapshots.file_changes(old, new, ["path"]).collect()}
    assert got == {"a": ("MODIFIED", True, True, ["COMPLEXITY_INCREASED", "LARGE_CHURN_WITH_COMPLEXITY"]), "b": ("REMOVED", False, False, []), "c": ("UNCHANGED", False, False, []), "d": ("MODIFIED", False, False, []), "e": ("ADDED", False, False, [])}
    base = {r.measure: (r.previous, r.current, r.absolute_delta, r.percentage_delta) for r in snapshots.compared(old.limit(0), new.limit(1), ["lines", "smells"]).collect()}
    assert base == {"lines": (None, 100.0, None, None), "smells": (None, 0.0, None, None)}
    c = "clone_hash string, instances int"
    t = snapshots.clone_trajectory(spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], c), spark.createDataFrame([("a", 2), ("b", 3), ("d", 2)], c))
    assert {r.clone_hash: r.state for r in t.collect()} == {"a": "PERSISTENT", "b": "CHANGED", "c": "RESOLVED", "d": "NEW"}
    h = snapshots.health_table(old, spark.createDataFrame([("a", 50)], "path string, score int"), spark.createDataFrame([("b", 7)], "path string, duplicated_lines int"))
    assert [r.path for r in snapshots.hotspots_or_complex(h, 1).collect()] == ["a"]
    assert [r.path for r in snapshots.hotspots_or_complex(h.withColumn("score", F.lit(None).cast("int")).withColumn("complexity", F.when(F.col("path") == "c", 9).otherwise(1)), 1).collect()] == ["c"]


def test_alerts(spark):
    v = spark.createDataFrame([("CVE-1", "p", "CRITICAL"), ("CVE-2", "q", "HIGH"), ("CVE-3", "r", "LOW"), (None, "s", None)], "canonical string, package string, severity string")
    a = alerts.vulnerability_alerts(v, ["package"])
    assert {r.dedup_key: r.rule for r in a.collect()} == {"SEC:CVE-1:p": "SEC_CRITICAL_VULNERABILITY", "SEC:CVE-2:q": "SEC_HIGH_VULNERABILITY"}
    e = spark.createDataFrame([("API_MISSING_AUTH", "SECURITY", "GET", "/a"), ("ASYNC_NO_TRY_CATCH", "RELIABILITY", "GET", "/b"), ("X", "CONTRACT", "GET", "/c")], "rule string, category string, method string, path string")
    assert sorted(r.dedup_key for r in alerts.endpoint_alerts(e, []).collect()) == ["API_ASYNC:GET:/b", "API_AUTH:GET:/a"]
    s = spark.createDataFrame([(1, 69, 70.0, 0.31), (2, 70, 69.9, 0.3), (3, None, None, None)], "id int, security_score int, api_score double, duplication_ratio double")
    assert sorted(r.dedup_key for r in alerts.snapshot_alerts(s, "id").collect()) == ["API_SCORE_DROP:2", "DUP_SPIKE:1", "SEC_SCORE_LOW:1"]
    stored = spark.createDataFrame([("SEC:CVE-1:p", "x", "OPEN"), ("SEC:CVE-9:p", "x", "ACKNOWLEDGED"), ("SEC:CVE-8:p", "x", "DISMISSED"), ("SEC_SCORE_LOW:1", "SEC_SCORE_LOW", "OPEN"), ("API_AUTH:GET:/z", "API_MISSING_AUTH", "OPEN")], "dedup_key string, rule string, status string")
    assert sorted(r.dedup_key for r in alerts.auto_resolved(stored, a).collect()) == ["API_AUTH:GET:/z", "SEC:CVE-9:p"]
    trail = [(1, "CREATED", 1), (1, "RESOLVED", 2), (1, "REOPENED", 3), (1, "COMMENTED", 4), (2, "CREATED", 1), (2, "ACKNOWLEDGED", 2), (2, "DISMISSED", 5), (3, None, 1), (4, "COMMENTED", 1)]
    got = {r.id: tuple(r)[1:] for r in alerts.lifecycle(spark.createDataFrame(trail, "id int, action string, t int"), "id", "action", ["t"]).collect()}
    assert got == {1: ("OPEN", None, None, None, 4), 2: ("DISMISSED", 2, None, 5, 3), 3: ("OPEN", None, None, None, 1), 4: ("OPEN", None, None, None, 1)}
    u = spark.createDataFrame([(1, "HIGH", "MEDIUM", True, True, True), (2, "LOW", "HIGH", True, True, True), (3, "HIGH", "LOW", False, False, True), (4, "HIGH", "LOW", True, None, False), (5, "critical", "HIGH", None, True, None)], "id int, s string, m string, in_app boolean, email boolean, c boolean")
    told = u.where(alerts.eligible(F.col("s"), F.col("m"), F.col("in_app"), F.col("email"), F.col("c")))
    assert sorted((r.id, r.channel, r.status) for r in alerts.notifications(told, ["id"]).collect()) == [(1, "email", "FAILED"), (1, "in_app", "DELIVERED"), (5, "email", "FAILED")]


def test_relationships(spark):
    files = spark.createDataFrame([("src/a.js",), ("src/b/index.js",), ("lib/c.py",), ("d.js",), ("src/a.js",)], "path string")
    imports = spark.createDataFrame(
        [("src/a.js", "./b", ["f"], 1), ("src/a.js", "../lib/c.py", ["*"], 2), ("src/a.js", "react", ["useState"], 3), ("src/b/index.js", "../../d", ["g"], 1), ("d.js", "./../x", [], 1), ("d.js", "./gone/", ["z"], 2), ("d.js", None, None, 3)],
        "file string, target string, symbols array<string>, line int",
    )
    got = {(r.file, r.line): r.resolved for r in relations.resolved_imports(imports, files).collect()}
    assert got == {("src/a.js", 1): "src/b/index.js", ("src/a.js", 2): "lib/c.py", ("src/a.js", 3): "react", ("src/b/index.js", 1): "d.js", ("d.js", 1): "../x", ("d.js", 2): "gone/", ("d.js", 3): None}
    symbols = spark.createDataFrame([("src/a.js", "main", "FUNCTION", 1), ("src/b/index.js", "f", "FUNCTION", 1), ("lib/c.py", "f", "FUNCTION", 1), ("lib/c.py", "h", "FUNCTION", 5), ("lib/c.py", "Base", "CLASS", 9), ("d.js", "Base", "CLASS", 1), ("d.js", "Shape", "INTERFACE", 2)], "file string, name string, type string, line int")
    heirs = spark.createDataFrame([("src/a.js", "Kid", "Base", False, 1), ("src/a.js", "Kid", "Shape", True, 1), ("src/a.js", "Kid", "Gone", False, 1), ("src/a.js", "Kid", None, False, 1)], "file string, class_name string, parent string, is_interface boolean, line int")
    calls = spark.createDataFrame([("src/a.js", "main", "f", 3), ("src/a.js", "main", "h", 4), ("src/a.js", "main", "main", 5), ("src/a.js", "main", "nowhere", 6)], "file string, caller string, callee string, line int")
    out = relations.relationships(files, imports, heirs, calls, symbols).collect()
    assert {(r.type, r.name): r.target_file for r in out if r.type != "IMPORTS"} == {
        ("EXTENDS", "Base"): "d.js", ("EXTENDS", "Gone"): None, ("IMPLEMENTS", "Shape"): "d.js", ("CALLS", "f"): "src/b/index.js", ("CALLS", "h"): "lib/c.py", ("CALLS", "main"): "src/a.js", ("CALLS", "nowhere"): None,
    }
    assert len(out) == 7 + 3 + 4


def test_commits(spark):
    log = spark.createDataFrame([("a1|p1|Fixes #12 | now", 1), ("a2|p1 p2|fix: merge", 1), ("a3|p3|Prefix 12", 1), ("broken", 1), (None, 1), ("a4|p4|fix(core): x", 1), ("a5|p5|Resolved 7", 1)], "line string, x int")
    c = commits.log_lines(log)
    assert {r.commit: (r.parents, r.message) for r in c.collect()}["a1"] == (["p1"], "Fixes #12 | now")
    changed = spark.createDataFrame([("a1", "M\tsrc/a.js"), ("a1", "M\tsrc/a.test.js"), ("a1", "A\tsrc/n.js"), ("a4", "M  src/b c.js"), ("a3", "M\tsrc/a.js"), ("a5", ""), ("a5", None)] + [("a5", f"M\tsrc/x{i}.js") for i in range(11)], "commit string, line string")
    fixed = commits.fixes(c, commits.change_lines(changed))
    assert sorted(tuple(r) for r in fixed.collect()) == [("a1", "p1", "src/a.js"), ("a4", "p4", "src/b c.js")]
    tree = [(k, f"100644 blob {b}\t{p}") for k in ("a1", "a4") for b, p in (("b1", "src/a.js"), ("b2", "src/b c.js"), ("b3", "src/c.js"), ("b4", "src/d.js"), ("b5", "test/e.js"))] + [("a1", "040000 tree t\tsrc"), ("a1", "odd")]
    t = commits.tree_lines(spark.createDataFrame(tree, "commit string, line string"))
    rows = sorted(tuple(r) for r in commits.labelled(fixed, t).collect())
    assert [r for r in rows if r[3] == 1] == [("a1", "src/a.js", "b1", 1), ("a4", "src/b c.js", "b2", 1)]
    clean = [r for r in rows if r[3] == 0]
    assert 1 <= len(clean) <= 2 and len({r[0] for r in clean}) == len(clean) and not {r[1] for r in clean} & {"test/e.js"}
    assert rows == sorted(tuple(r) for r in commits.labelled(fixed, t.repartition(5)).collect())


PYTHON = """import os, sys as s
from lib.base import Base, helper as h

class Kid(Base):
    # a comment
    def run(self, a, b: int = 1) -> int:
        if a and b:
            for x in a:
                helper(x, len(x))

        return s.go(b)

    async def skipped(self):
        pass

def top(x):
    try:
        return Kid(x)
    except ValueError:
        return None
"""


def test_python_outline(spark):
    o = python_code.read_python(spark.createDataFrame([("k.py", PYTHON), ("e.py", ""), ("n.py", None), (None, "def (:\n\tclass\n")], "path string, content string"))
    got = {r.path: r for r in o.collect()}
    k = got["k.py"]
    assert [(x.type, x.name, x.start, x.end) for x in k.symbols] == [("FILE", "k.py", 1, 21), ("IMPORT", "os", 1, 1), ("IMPORT", "sys", 1, 1), ("IMPORT", "lib.base", 2, 2), ("CLASS", "Kid", 4, 14), ("METHOD", "run", 6, 11), ("FUNCTION", "top", 16, 20)]
    run, top = k.functions
    assert (run.lines, run.parameter_count, run.complexity, run.nesting, run.branch_count, run.loop_count, run.conditional_count, run.return_count, run.call_count) == (6, 2, 4, 3, 2, 1, 2, 1, 2)
    assert (top.lines, top.complexity, top.return_count, top.call_count) == (5, 2, 2, 1)
    assert [(c.caller, c.callee, c.line) for c in k.calls] == [("run", "helper", 9), ("run", "s.go", 11), ("top", "Kid", 18)]
    assert [(i.target, i.symbols) for i in k.imports] == [("os", ["os"]), ("sys", ["sys"]), ("lib.base", ["Base", "helper"])] and [(i.class_name, i.parent) for i in k.inheritance] == [("Kid", "Base")]
    assert (got["e.py"].line_count, got["n.py"].line_count, got[None].line_count) == (1, 1, 3) and not got["e.py"].functions


BODY = "function {0}(a, b) {{\n  let total = 0;\n  for (let i = 0; i < a.length; i++) {{\n    if (a[i] > b) {{\n      total += a[i] * 2;\n    }} else {{\n      total -= b;\n    }}\n  }}\n  return total;\n}}\n"


def test_tokens(spark):
    text = "// note\nimport x\nlet a = 'it\\'s' + 4.5; \n\nif (a === b) a++;"
    (r,) = clones.tokens(spark.createDataFrame([("a.js", text), ("n.js", None)], "path string, content string")).collect()
    assert [(t.raw, t.norm, t.line) for t in r.tokens][:7] == [("let", "kw:let", 3), ("a", "$ID", 3), ("=", "op:=", 3), ("'it\\'s'", "$LIT", 3), ("+", "op:+", 3), ("4.5", "$LIT", 3), (";", "del:;", 3)]
    assert [t.raw for t in r.tokens][7:] == ["if", "(", "a", "===", "b", ")", "a", "++", ";"] and r.lines == 5


def test_clones(spark):
    same, other = BODY.format("sum"), BODY.format("sum").replace("total", "acc")
    files = [("a.js", same), ("b.js", "const q = 1\n" + same), ("c.js", "var z;\n\n" + other), ("d.js", "let x = 1;\n"), ("e.js", ""), ("f.js", None)]
    t = clones.tokens(spark.createDataFrame(files, "path string, content string"))
    regions = clones.clone_regions(t)
    groups = clones.clone_groups(regions).collect()
    assert [(g.type, g.instances, g.line_count, g.is_intra_file) for g in groups] == [("TYPE_2", 3, 11, False)]
    assert sorted((r.path, r.start_line, r.end_line) for r in regions.collect()) == [("a.js", 1, 11), ("b.js", 2, 12), ("c.js", 3, 13)]
    (d,) = clones.duplication(t, regions).collect()
    assert (d.total_lines, d.duplicated_lines, d.clones, d.groups, d.intra, d.inter) == (12 + 13 + 14 + 2 + 1, 33, 3, 1, 0, 1) and d.ratio == round(33 / 42, 4)
    # within one file, written alike
    two = clones.tokens(spark.createDataFrame([("a.js", same + "\nvar gap = 3;\n" + same)], "path string, content string"))
    assert [(g.type, g.instances, g.is_intra_file) for g in clones.clone_groups(clones.clone_regions(two)).collect()] == [("TYPE_1", 2, True)]
    none = clones.tokens(spark.createDataFrame([], "path string, content string"))
    assert clones.duplication(none, clones.clone_regions(none)).first().ratio == 0.0


def test_windows_against_brute_force(spark):
    rnd = random.Random(3)
    lines = ["a = b + 1;", "f(x);", "if (a) { b(); }", "}", "return a.b.c;"]
    files = [(f"p{i}", "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(4, 40)))) for i in range(8)]
    t = clones.tokens(spark.createDataFrame(files, "path string, content string"))
    want = set()
    for r in t.collect():
        for i in range(len(r.tokens) - 11):
            w = r.tokens[i : i + 12]
            if w[-1].line - w[0].line >= 2 and sum(x.kind == "delimiter" for x in w) <= 9 and sum(x.kind in ("keyword", "identifier", "literal") for x in w) >= 5:
                want.add((r.path, i))
    assert {(r.path, r.start) for r in clones.windows(t, 12, 3).collect()} == want and want
