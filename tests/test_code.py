import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from compare import clone_groups
from conftest import ROOT
from pyspark.sql import functions as F

from gritmill.functions.paths import is_public_route
from gritmill.operators import clones, diffs, discovery, endpoints, impact
from gritmill.sources import code, javascript, manifests, python_code, routes

PAYMENT = """
import { savePayment } from "./database.js";
import express, * as all from "express";
import "./side.js";
import type { T, type U as V } from './types';

export function processPayment(user, amount) {
    if (!user) {
        return false;
    }
    if (amount <= 0) {
        return false;
    }
    savePayment(user, amount);
    return true;
}

export const complexValidator = (data) => {
    if (data.a) { if (data.b) { if (data.c) { if (data.d) { if (data.e) {
        return "very_deep";
    } } } } }
    return "ok";
};
"""


def measures(text, path="t.js"):
    o = javascript.outline(path, text)
    assert o["status"] == "analyzed", o["error"]
    return {f["name"]: f for f in o["functions"]}


def test_javascript_outline():
    o = javascript.outline("src/payment.js", PAYMENT)
    assert [(i["target"], i["symbols"]) for i in o["imports"]] == [("./database.js", ["savePayment"]), ("express", ["default", "*"]), ("./side.js", []), ("./types", ["T", "U"])]
    f = {x["name"]: x for x in o["functions"]}
    assert (f["processPayment"]["parameter_count"], f["processPayment"]["complexity"], f["processPayment"]["call_count"], f["processPayment"]["return_count"]) == (2, 3, 1, 3)
    assert (f["complexValidator"]["nesting"], f["complexValidator"]["complexity"], f["complexValidator"]["start"], f["complexValidator"]["end"]) == (5, 6, 18, 23)
    assert o["calls"] == [{"caller": "processPayment", "callee": "savePayment", "line": 14}]
    assert [(e["name"], e["is_default"]) for e in o["exports"]] == [("processPayment", False), ("complexValidator", False)]
    assert [s["type"] for s in o["symbols"]] == ["FILE", "IMPORT", "IMPORT", "IMPORT", "IMPORT", "FUNCTION", "FUNCTION"]


@pytest.mark.parametrize("body, nesting, complexity", [
    ("return 1;", 0, 1), ("if (a) { return 1; }", 1, 2), ("if (a) { if (b) { return 1; } }", 2, 3), ("for (const i of a) { if (i) { f(i); } }", 2, 3), ("if (a) {} if (b) {}", 1, 3),
    ("if (a) f()\nelse if (b) g()\nelse h()", 2, 3), ("if (a) if (b) f()", 2, 3), ("do { a() } while (b || c)", 1, 3), ("try { a() } catch { if (b) c() } finally { d() }", 3, 3),
    ("switch (a) { case 1: case 2: b(); default: c() }", 1, 3), ("return a ? b : c ?? d", 0, 3), ("a?.b; a ??= b; a &&= c", 0, 1), ("const g = () => { if (x) y() }; return g", 0, 1),
    ("return { m() { if (x) y() } }", 1, 2), ("while (a) b: for (;;) { break b }", 2, 3), ("const s = `${a ? `}` : '{'}`; // if (x)\nreturn s", 0, 2), ("return /if (a) { [/}]/.test(a) / b / c", 0, 1),
    ("return <A b={c => c && d}>if (x) don't {e && <i/>}</A>", 0, 2), ("for await (const x of y) z(x)", 1, 2), ("a\n++b\nif (a) /x'/.exec(b)", 1, 2),
])
def test_javascript_measures(body, nesting, complexity):
    f = measures(f"function t(a, b) {{ {body} }}")["t"]
    assert (f["nesting"], f["complexity"]) == (nesting, complexity)


def test_javascript_symbols_and_calls():
    text = """class A extends B { #p = q(); static x = () => g(); constructor(a) { super(a); } async *m({a, b}, ...c) { w(); } 'str'() {} get v() { return 1 } #h() { return 2 } }
const { m, n } = require('./mn'); const w = require("w"), z = function named(a = f(), [b]) { return new Foo(bar()).baz(); };
a.b().c(d); a[b](1); a['k'](2); foo()(); x?.y(); this.go(); items.map(i => inner(i));
export { z as g, A }; export * as ns from './ns'; export default z;
export default class Q {}
"""
    o = javascript.outline("t.jsx", text)
    assert [(s["type"], s["name"]) for s in o["symbols"]][1:] == [
        ("CLASS", "A"), ("CONSTRUCTOR", "constructor"), ("METHOD", "m"), ("METHOD", "method"), ("METHOD", "v"), ("FUNCTION", "z"), ("EXPORT", "z"), ("CLASS", "Q"), ("EXPORT", "Q"),
    ]
    assert [(c["caller"], c["callee"]) for c in o["calls"]] == [
        ("global", "q"), ("global", "g"), ("m", "w"), ("named", "bar"), ("named", "baz"), ("global", "a.b"), ("global", "c"), ("global", "a.b"), ("global", "a.k"), ("global", "foo"), ("global", "go"), ("global", "items.map"), ("global", "inner"),
    ]
    assert [(i["target"], i["symbols"]) for i in o["imports"]] == [("./mn", ["*"]), ("w", ["w"])]
    assert [(e["name"], e["is_default"]) for e in o["exports"]] == [("g", False), ("A", False), ("ns", False), ("z", True), ("Q", True)]
    assert o["inheritance"] == [{"class_name": "A", "parent": "B", "line": 1}]


def test_typescript():
    text = """interface I { a?: string; f(x: number): void }
type U = { a: string } | null
export enum E { A = 1, B }
declare function gone(a: string): void;
abstract class K<T extends object> extends L<T> implements I { private readonly a: Map<string, number> = new Map(); constructor(private b?: string) { super(); } abstract q(): void; run<S>(x: S, y?: number): Promise<S> { return x! } }
export const arrow = <T,>(x: T, y: Array<string>): Promise<T> => x ? run(x) : null;
function over(a: string): void;
function over(a: any): { k: number } { if (a as string) return { k: a } }
namespace N { export function inside() {} }
"""
    o = javascript.outline("t.ts", text)
    assert o["status"] == "analyzed"
    assert [(f["name"], f["parameter_count"], f["complexity"]) for f in o["functions"]] == [("constructor", 1, 1), ("run", 2, 1), ("arrow", 2, 2), ("over", 1, 2), ("inside", 0, 1)]
    assert [e["name"] for e in o["exports"]] == ["E", "arrow", "inside"] and o["inheritance"][0]["parent"] == "L"


def test_code_of_all_languages(spark):
    deep = "(" * 50_000 + ")" * 50_000
    files = [("a.js", "function f() {}"), ("b.tsx", "f(<a>b</a>)"), ("bad.js", "f( {"), ("deep.js", deep), ("c.py", "def f(a):\n    return a"), ("d.java", "class A {}\n"), ("e.js", None), ("f.js", ""), (None, "x"), ("a.js", "function f() {}"), ("open.js", "const a = 'x\nf(`${b")]
    got = sorted((str(r.path), r.language, r.status, len(r.symbols)) for r in code.read_code(spark.createDataFrame(files, "path string, content string")).collect())
    assert got == sorted([
        ("a.js", "javascript", "analyzed", 2), ("a.js", "javascript", "analyzed", 2), ("b.tsx", "typescript", "analyzed", 1), ("bad.js", "javascript", "parse_failed", 0), ("deep.js", "javascript", "parse_failed", 0), ("c.py", "python", "analyzed", 2),
        ("d.java", "java", "unsupported", 1), ("e.js", "javascript", "analyzed", 1), ("f.js", "javascript", "analyzed", 1), ("None", "unknown", "unsupported", 1), ("open.js", "javascript", "parse_failed", 0),
    ])


# --- clones

def of(tokenized):
    return {r.path: [(t.norm, t.raw, t.kind, t.line, t.end) for t in r.tokens] for r in tokenized.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_clone_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    lines = [f"{a} {o} {b};" for a in ("x", "return", "y1") for o in "+=*" for b in ("2", "z")][: 6 if seed % 2 else 18]
    blocks = [[rng.choice(lines) for _ in range(rng.randint(3, 14))] for _ in range(4)]
    files = []
    for k in range(9):
        body = [line for _ in range(rng.randint(1, 5)) for line in (rng.choice(blocks) if rng.random() < 0.8 else [rng.choice(lines)])]
        files.append((f"f{k}.{'py' if k % 2 else 'js'}", "\n".join(body)))
    files.append(("long.js", "x = 2;\ny1 + z;\n" * 12))
    t = clones.tokens(spark.createDataFrame(files, "path string, content string"))
    got = sorted((r.type, r.token_count, r.path, r.start_line, r.end_line) for r in clones.clone_regions(t, 12, 3).collect())
    assert got and got == sorted((kind, n, *x) for kind, n, at in clone_groups(of(t), 12, 3) for x in at)


def test_clones_of_a_pattern_that_repeats(spark):
    two = "total = total + first * 2;\nother = f(total, 'x', first) - 1;\n"
    files = [("a.js", two * 2), ("b.js", two * 6)]
    t = clones.tokens(spark.createDataFrame(files, "path string, content string"))
    got = sorted((r.type, r.token_count, r.path, r.start_line, r.end_line) for r in clones.clone_regions(t, 20, 2).collect())
    assert got == sorted((kind, n, *x) for kind, n, at in clone_groups(of(t), 20, 2) for x in at)
    assert {(p, a, b) for _, n, p, a, b in got if n == 42} >= {("a.js", 1, 4), ("b.js", 1, 4), ("b.js", 9, 12)}


def test_near_places_of_one_file_are_no_clones(spark):
    t = clones.tokens(spark.createDataFrame([("a.js", "x = 1;\n" * 9), ("e.js", ""), ("n.js", None), ("i.js", "import a, {\n  b\n} from 'x';\nimport 'y'\nimport('z');\n")], "path string, content string"))
    got = of(t)
    assert [x[1] for x in got["i.js"]] == ["import", "(", "'z'", ")", ";"] and got["e.js"] == [] and "n.js" not in got
    found = sorted((r.token_count, r.start_line, r.end_line) for r in clones.clone_regions(t, 24, 4).collect())
    assert found == sorted((n, a, b) for _, n, at in clone_groups(got, 24, 4) for _, a, b in at)


def test_scripts_are_scanned(spark):
    text = "const a = `x ${b} y`; /* if */ return /a[/]'b/ / 2; // it's\nlet s = <p q=\"r\">don't</p>;"
    (r,) = clones.tokens(spark.createDataFrame([("a.jsx", text)], "path string, content string")).collect()
    assert [(t.raw, t.norm) for t in r.tokens if t.kind == "literal"] == [("x ", "$LIT"), (" y", "$LIT"), ("/a[/]'b/", "$LIT"), ("2", "$LIT"), ('"r"', "$LIT"), ("don't", "$LIT")]


# --- manifests and executors

def test_dependencies_of_damaged_and_installed_packages(spark):
    package = json.dumps({"dependencies": {"a": "^1.2", "both": ""}, "devDependencies": {"both": ">=3", "b": "~ 2"}, "peerDependencies": []})
    nested = {"version": "1"}
    for _ in range(3000):
        nested = {"version": "1", "dependencies": {"d": nested}}
    lock = '{"dependencies": {"d": ' + '{"version": "1", "dependencies": {"d": ' * 400 + "{}" + "}}" * 400 + "}}"
    files = [
        ("x\\package-lock.json", "{"), ("x/package.json", package), ("y/node_modules/q/package.json", package), ("site-packages/requirements.txt", "z"), ("r/requirements-dev.txt", "Flask >= 2.0\r\nplain\n"),
        ("n/package-lock.json", lock), ("n/package.json", package), ("long/package.json", "{" * 100_000), ("one/package-lock.json", "[" * 100_000), (None, package), ("v/package.json", None),
    ]
    rows = manifests.dependencies(spark.createDataFrame(files, "path string, content string")).collect()
    by = lambda path: sorted((r.package_name, r.version, r.version_specifier, r.dependency_type) for r in rows if r.path == path)
    assert by("x/package.json") == [("a", "1.2", "^1.2", "direct"), ("b", "2", "~ 2", "development"), ("both", "*", "*", "direct"), ("both", "3", ">=3", "development")]
    assert by("r/requirements-dev.txt") == [("Flask", "2.0", ">= 2.0", "direct"), ("plain", "*", "*", "direct")]
    assert {r.path for r in rows} == {"x/package.json", "r/requirements-dev.txt", "n/package-lock.json"}


def test_kernels_run_where_workers_have_no_package(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from gritmill.operators import clones, diffs
from gritmill.sources import code, manifests
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([("a.js", "f()"), ("b.py", "def f():\\n  pass"), ("package-lock.json", '{{"dependencies": {{"a": {{}}}}}}')], "path string, content string")
assert code.read_code(df).count() == 3 and manifests.dependencies(df).count() == 1
assert clones.clone_regions(clones.tokens(df)).count() == 0 and diffs.diff_lines(df, "path", "content").count() == 0
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


# --- routes

SERVER = """
import express from 'express';
import authRoutes from './routes/auth.js';
const repoRoutes = require('./routes/repositories');
import other from 'outside';
const app = express();
app.get('/health', (req, res) => res.status(200).send('OK'));
app.use('/api/auth', authRoutes);
app.use('/api/repositories', repoRoutes);
app.use('/x', other);
app.use(cors());
"""
AUTH = """
const router = express.Router();
router.post('/google', (req, res) => {
  const { credential } = req.body;
  res.status(200).json({ token: 'xyz' });
});
router.get(`/me`, verifyToken, async (req, res) => { res.status(200).json({ id: req.user.id }); });
router.get(dynamic, handler);
"""
REPOSITORIES = """
router.use(requireAuth());
router.get('/', async (req, res) => { const page = req.query.page; res.status(200).json({ repositories: [] }); });
router.get('/:id', checkRole('x'), auth.ofUser, controllers.get);
router.all('/:id/', load);
router.get('/', again);
async function load(req, res) { try { await db.create(req.body); fetch(u); } catch (e) { return res.sendStatus(500); } }
"""


def test_route_discovery(spark):
    files = [("src/server.js", SERVER), ("src/routes/auth.js", AUTH), ("src/routes/repositories.js", REPOSITORIES), ("src/bad.js", "app.get('/x', ("), ("src/n.js", None), ("a.py", "app.get('/y', f)")]
    declared = routes.read_routes(spark.createDataFrame(files, "path string, content string"))
    e = {(r.method, r.path): r for r in discovery.discover(declared).collect()}
    assert set(e) == {("GET", "/health"), ("POST", "/api/auth/google"), ("GET", "/api/auth/me"), ("GET", "/api/repositories"), ("GET", "/api/repositories/:id"), ("ALL", "/api/repositories/:id")}
    assert not e["GET", "/health"].authenticated and e["GET", "/health"].is_public and e["GET", "/health"].middleware == ["cors()"]
    google = e["POST", "/api/auth/google"]
    assert google.fields == ["credential"] and google.shapes == [["token"]] and google.is_public and google.statuses == [200]
    assert e["GET", "/api/auth/me"].authenticated and e["GET", "/api/auth/me"].auth_middleware == ["verifyToken"] and e["GET", "/api/auth/me"].is_async
    listed = e["GET", "/api/repositories"]
    assert listed.authenticated and [(p.name, p.place) for p in listed.parameters] == [("page", "query")] and listed.completeness == "COMPLETE" and listed.line == 3
    one = e["GET", "/api/repositories/:id"]
    assert one.authorized and one.middleware == ["requireAuth()", "checkRole()", "ofUser"] and one.handler == "controllers.get" and not one.found and [(p.name, p.place) for p in one.parameters] == [("id", "path")]
    load = e["ALL", "/api/repositories/:id"]
    assert load.found and load.has_try and load.database and load.external and load.statuses == [500] and load.downstream == ["db.create", "external.fetch"] and load.depth == 4 and load.error_coverage == "IDENTIFIED"
    assert discovery.discover(declared.limit(0)).count() == 0


def test_mounts_are_followed_and_circles_cut(spark):
    use = lambda *to: "".join(f"import r{i} from './{n}.js';\napp.use('/{p}', r{i});\n" for i, (n, p) in enumerate(to)) + "app.get('/', h);\n"
    files = [("a.js", use(("b", "b"), ("c", "c"))), ("b.js", use(("c", "bc"), ("b", "self"))), ("c.js", use(("b", "cb"))), ("x.js", use(("y", "y"))), ("y.js", use(("x", "x"))), ("z.js", "import q from './gone.js';\napp.use(q);\napp.get('/z', h);")]
    declared = routes.read_routes(spark.createDataFrame(files, "path string, content string"))
    got = sorted((r.file, r.path) for r in discovery.discover(declared).collect())
    assert got == sorted([("a.js", "/"), ("b.js", "/b"), ("b.js", "/c/cb"), ("c.js", "/c"), ("c.js", "/b/bc"), ("x.js", "/x"), ("y.js", "/y"), ("z.js", "/z")])


def test_rules_of_discovered_endpoints(spark):
    text = "router.post('/api/records/create', async (req, res) => { const item = await db.create(req.body); res.status(200).json(item); });"
    e = discovery.discover(routes.read_routes(spark.createDataFrame([("routes.js", text)], "path string, content string")))
    found = {(r.rule, r.severity) for r in endpoints.findings(e, ["method", "path"]).collect()}
    assert {("API_MISSING_AUTH", "HIGH"), ("API_UNHANDLED_ASYNC", "HIGH"), ("API_DATABASE_NO_ERROR_HANDLING", "HIGH")} <= found
    score = endpoints.reliability(e.withColumn("g", e.method), endpoints.findings(e.withColumn("g", e.method), ["g"]), ["g"]).first()
    assert 0 < score.score < 100


def test_public_routes(spark):
    paths = ["/health", "/health/x", "/healthy", "/api/auth/login", "/api/auth/me", "/api/webhooks/github", "/api/docs", "/favicon.ico", "/public", "/api/repositories", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_public_route(F.col("p"))).collect()
    assert [r[1] for r in got] == [True, True, False, True, False, True, True, True, True, False, False]


# --- impact

def impact_of(spark, diff, base, head):
    lines = diffs.diff_lines(spark.createDataFrame([("d", diff)], "diff_id string, diff string"))
    side = lambda files: code.read_code(spark.createDataFrame(list(files.items()), "path string, content string")).selectExpr("'d' AS diff_id", "path", "line_count", "symbols")
    rows = impact.impact(diffs.diff_files(lines), diffs.changed_ranges(lines, "new"), diffs.changed_ranges(lines, "old"), side(base), side(head)).collect()
    return {(r.type, r.name): (r.change, [tuple(x) for x in r.ranges], r.own_lines) for r in rows}


def test_impact(spark):
    total = "\nfunction total(items) {\n  let sum = 0;\n  for (const i of items) {\n    sum += i.price%s;\n  }\n  return sum;\n}\n\nfunction format(v) {\n  return '$' + v;\n}\n"
    diff = "diff --git a/src/b.js b/src/b.js\n--- a/src/b.js\n+++ b/src/b.js\n@@ -4,3 +4,3 @@ function total(items) {\n   for (const i of items) {\n-    sum += i.price;\n+    sum += i.price * 2;\n   }\n"
    got = impact_of(spark, diff, {"src/b.js": total % ""}, {"src/b.js": total % " * 2"})
    assert got == {("FILE", "src/b.js"): ("MODIFIED", [(5, 5)], 0), ("FUNCTION", "total"): ("MODIFIED", [(5, 5)], 1), ("FUNCTION", "format"): ("UNCHANGED", [], 0)}

    keep, gone = "function keep() {\n  return 1;\n}\n", "function gone() {\n  return 0;\n}\n\n"
    diff = "diff --git a/h.js b/h.js\n--- a/h.js\n+++ b/h.js\n@@ -1,4 +0,0 @@\n-function gone() {\n-  return 0;\n-}\n-\n@@ -7,0 +4,3 @@\n+function fresh() {\n+  return 2;\n+}\n"
    got = impact_of(spark, diff, {"h.js": gone + keep}, {"h.js": keep + "function fresh() {\n  return 2;\n}\n"})
    assert got == {("FILE", "h.js"): ("MODIFIED", [(4, 6)], 0), ("FUNCTION", "keep"): ("UNCHANGED", [], 0), ("FUNCTION", "fresh"): ("ADDED", [(4, 6)], 3), ("FUNCTION", "gone"): ("DELETED", [(1, 4)], 3)}

    klass = "class P {\n  process(a) {\n    %s\n  }\n}\n"
    diff = "diff --git a/s.js b/s.js\n--- a/s.js\n+++ b/s.js\n@@ -3,1 +3,2 @@\n-    return a;\n+    if (a) throw a;\n+    return 1;\n"
    got = impact_of(spark, diff, {"s.js": klass % "return a;"}, {"s.js": klass % "if (a) throw a;\n    return 1;"})
    assert got[("CLASS", "P")] == ("MODIFIED", [(3, 4)], 0) and got[("METHOD", "process")] == ("MODIFIED", [(3, 4)], 2)

    diff = "diff --git a/l.js b/l.js\nnew file mode 100644\n--- /dev/null\n+++ b/l.js\n@@ -0,0 +1,2 @@\n+export class L {\n+}\ndiff --git a/o.py b/o.py\ndeleted file mode 100644\n--- a/o.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-def f():\n-  pass\n"
    got = impact_of(spark, diff, {"o.py": "def f():\n  pass"}, {"l.js": "export class L {\n}\n"})
    assert {k: v[0] for k, v in got.items()} == {("FILE", "l.js"): "ADDED", ("CLASS", "L"): "ADDED", ("FILE", "o.py"): "DELETED", ("FUNCTION", "f"): "DELETED"}


def test_innermost_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        spans = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(1, 20)
            b = rng.randint(a, 20)
            if all(e < a or s > b or (s <= a and b <= e) or (a <= s and e <= b) for s, e in spans):
                spans.append((a, b))
        lines = [rng.randint(1, 22) for _ in range(6)]
        want = [0] * len(spans)
        for line in lines:
            over = [(s, -e, k) for k, (s, e) in enumerate(spans) if s <= line <= e]
            if over:
                want[max(over)[2]] += 1
        assert impact.innermost(spans, np.array(lines)) == want


def test_lines_that_look_like_headers(spark):
    diff = "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,2 @@\n a\n--- text\n-b\n+++ more\n@@ -9 +9 @@\n--- x\n+++ y\n"
    plain = "--- a/q.sql\n+++ b/q.sql\n@@ -1,9 +1,9 @@\n-x\n--- a/r.sql\n+++ b/r.sql\n@@ -1 +1 @@\n-y\n"
    lines = diffs.diff_lines(spark.createDataFrame([("a", diff), ("b", plain)], "diff_id string, diff string"))
    got = {r.diff_id: (r.old_path, r.new_path, r.change_type, r.additions, r.deletions) for r in diffs.diff_files(lines).collect()}
    assert got == {"a": ("q.sql", "q.sql", "modified", 2, 3), "b": ("r.sql", "r.sql", "modified", 0, 2)}


def test_python_outline_still_reads(spark):
    assert python_code.read_python(spark.createDataFrame([("a.py", "x" * 1_000_000)], "path string, content string")).count() == 1
