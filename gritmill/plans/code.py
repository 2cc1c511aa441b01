"""Queries over source files, manifests and diffs that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs, discovery, impact
from ..sources import code, javascript, manifests, routes, table
from .core import query

_DEEP = """// it's counted
export const f = async (a, { b, c = [1] }) => {
  if (a && b) {
    for (const x of a) { g.h(x, k(`${x ? "}" : '{'}`)); }
  }
  return /[/}']+/.test(a) ? <p title="it's">don't {m(a)} }</p> : new Q(a);
};
"""
_FLAT = """class C extends D {
  #p = 1;
  run(a) { /* if (x) */ switch (a) { case 1: return this.k(a); default: return a / 2 / a; } }
}
"""


@query("""SELECT l_orderkey, CAST(count(*) AS INTEGER) AS functions, CAST(max(CASE WHEN l_returnflag='R' THEN 6 ELSE 2 END) AS INTEGER) AS complexity, CAST(max(CASE WHEN l_returnflag='R' THEN 2 ELSE 1 END) AS INTEGER) AS nesting,
  CAST(sum(CASE WHEN l_returnflag='R' THEN 4 ELSE 1 END) AS INTEGER) AS calls, CAST(count(*) FILTER (l_returnflag='R') AS INTEGER) AS exports, CAST(count(*) FILTER (l_returnflag<>'R') AS INTEGER) AS classes, CAST(count(*) AS INTEGER) AS comments,
  CAST(2 + sum(CASE WHEN l_returnflag='R' THEN 7 ELSE 4 END) AS INTEGER) AS line_count, 'analyzed' AS status FROM lineitem GROUP BY 1""")
def js_parse(spark, d):
    """A JavaScript file of each order, with an arrow function or a class for each line."""
    body = F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "R", _DEEP).otherwise(_FLAT)), "")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('import q, { w as v } from "./q.js";\n'), body).alias("content"))
    o = javascript.read_javascript(g.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".jsx")).alias("path"), "content"))
    top = lambda name: F.array_max(F.transform("functions", lambda f: f[name])).alias(name)
    classes = F.size(F.filter("symbols", lambda s: s["type"] == "CLASS")).alias("classes")
    return o.select(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("l_orderkey"), F.size("functions").alias("functions"), top("complexity"), top("nesting"), F.size("calls").alias("calls"), F.size("exports").alias("exports"), classes, F.col("comment_count").alias("comments"), "line_count", "status")


@query("""SELECT CASE p_partkey % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'java' ELSE 'unknown' END AS language,
  CASE WHEN p_partkey % 5 < 2 AND p_size % 3 = 0 THEN 'parse_failed' WHEN p_partkey % 5 < 3 THEN 'analyzed' ELSE 'unsupported' END AS status, count(*) AS files,
  CAST(sum(CASE WHEN p_partkey % 5 < 2 AND p_size % 3 = 0 THEN 0 WHEN p_partkey % 5 < 3 THEN 2 ELSE 1 END) AS BIGINT) AS symbols FROM part GROUP BY 1, 2""")
def code_dispatch(spark, d):
    """Files of several languages made from the parts; some don't parse."""
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in (".js", ".ts", ".py", ".java", ".md")]), (k % 5 + 1).cast("int"))
    text = F.when(k % 5 == 2, "def f(a):\n    return a\n").otherwise(F.when(F.col("p_size") % 3 == 0, "function f( { return 1 }").otherwise("function f() { return 1 }"))
    o = code.read_code(table(spark, d, "part").select(F.concat(F.lit("src/p"), k, ending).alias("path"), text.alias("content")))
    return o.groupBy("language", "status").agg(F.count("*").alias("files"), F.sum(F.size("symbols")).alias("symbols"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part),
  r AS (SELECT k, 'f' || k || '/package.json' AS path, 'npm' AS ecosystem, 'Lib' || n AS package_name, '1.' || n AS version, '^1.' || n AS version_specifier, 'direct' AS dependency_type, true AS is_direct, 1 AS depth, CAST(NULL AS VARCHAR) AS parent_package FROM p WHERE k % 6 IN (0, 2)
    UNION ALL SELECT k, 'f' || k || '/package.json', 'npm', 'tool', '2', '~2', 'development', true, 1, NULL FROM p WHERE k % 6 IN (0, 2)
    UNION ALL SELECT k, 'f' || k || '/package-lock.json', 'npm', 'Lib' || n, '1.' || n || '.0', '^1.' || n, 'direct', true, 1, NULL FROM p WHERE k % 6 = 1
    UNION ALL SELECT k, 'f' || k || '/package-lock.json', 'npm', 'deep', '3.0.' || n, NULL, 'transitive', false, 2, 'Lib' || n FROM p WHERE k % 6 = 1
    UNION ALL SELECT k, 'f' || k || '/requirements-dev.txt', 'pypi', 'A_b.' || n, CAST(n AS VARCHAR), '>=' || n, 'direct', true, 1, NULL FROM p WHERE k % 6 = 3
    UNION ALL SELECT k, 'f' || k || '/pom.xml', 'maven', 'g:a' || n, CAST(n AS VARCHAR), CAST(n AS VARCHAR), 'test', true, 1, NULL FROM p WHERE k % 6 = 4)
  SELECT path, ecosystem, package_name, CASE ecosystem WHEN 'pypi' THEN replace(replace(lower(package_name), '_', '-'), '.', '-') ELSE lower(package_name) END AS normalized_name, version, version_specifier, dependency_type, is_direct, CAST(depth AS INTEGER) AS depth, parent_package FROM r""")
def manifest_dependencies(spark, d):
    """A folder of manifests for each part: a package.json alone, with a lockfile, or with a damaged one, requirements, a pom,
    or a manifest of an installed package, which doesn't count."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    package = F.concat(F.lit('{"dependencies": {"Lib'), n, F.lit('": "^1.'), n, F.lit('"}, "devDependencies": {"tool": "~2"}}'))
    lock = F.concat(F.lit('{"lockfileVersion": 3, "packages": {"node_modules/Lib'), n, F.lit('": {"version": "1.'), n, F.lit('.0", "dependencies": {"deep": "*"}}, "node_modules/deep": {"version": "3.0.'), n, F.lit('"}}}'))
    kind = k % 6
    files = F.when(kind == 0, F.array(F.struct(F.lit("package.json").alias("name"), package.alias("content"))))
    entry = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    files = (
        files.when(kind == 1, F.array(entry("package.json", package), entry("package-lock.json", lock))).when(kind == 2, F.array(entry("package.json", package), entry("package-lock.json", F.lit("{"))))
        .when(kind == 3, F.array(entry("requirements-dev.txt", F.concat(F.lit("# x\nA_b."), n, F.lit(" >="), n, F.lit("\n-r other")))))
        .when(kind == 4, F.array(entry("pom.xml", F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>a"), n, F.lit("</artifactId><version>"), n, F.lit("</version><scope>test</scope></dependency>")))))
        .otherwise(F.array(entry("node_modules/x/package.json", package)))
    )
    f = table(spark, d, "part").select(k, F.explode(files).alias("f")).select(F.concat(F.lit("f"), k, F.lit("/"), F.col("f.name")).alias("path"), "f.content")
    return manifests.dependencies(f)


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS k, '' AS prefix FROM part WHERE p_partkey = 1 UNION ALL SELECT p_partkey, w.prefix || '/p' || p_partkey FROM part JOIN w ON p_partkey // 2 = w.k AND p_partkey > 1),
  a AS (SELECT p_partkey, p_size, p_retailprice, coalesce(w.prefix, '') AS prefix FROM part LEFT JOIN w ON k = p_partkey)
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, prefix || '/x' || p_partkey || '/:id' AS path, 'src/f' || p_partkey || '.js' AS file, p_partkey % 3 = 0 OR p_size > 25 AS authenticated, p_size > 40 AS authorized,
  p_partkey % 7 = 0 AS database, p_partkey % 7 = 0 AS is_async, CASE WHEN p_partkey % 7 = 0 THEN '404' WHEN p_partkey % 7 = 1 THEN '200,201' ELSE '200' END AS statuses, 'id:path' || CASE WHEN p_partkey % 7 = 1 THEN ',page:query' ELSE '' END AS parameters,
  CASE WHEN p_partkey % 7 = 1 THEN 'name' ELSE '' END AS fields, p_partkey % 7 <= 2 AS found FROM a""")
def route_discovery(spark, d):
    """A file for each part that mounts those of twice its key, so prefixes go through many files."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part")
    child = p.where("p_partkey > 1").select(F.floor(k / 2).alias("up"), k.alias("c"))
    used = F.concat(F.lit("import r"), F.col("c"), F.lit(" from './f"), F.col("c"), F.lit("';\napp.use('/p"), F.col("c"), F.lit("', r"), F.col("c"), F.lit(");\n"))
    below = child.groupBy(F.col("up").alias("p_partkey")).agg(F.array_join(F.collect_list(used), "").alias("uses"))
    shared = F.when(k % 3 == 0, "router.use(verifyToken);\n").otherwise("")
    own = F.when(n > 40, "requireAuth, requireRole('x'), ").when(n > 25, "requireAuth, ").otherwise("")
    handler = (
        F.when(k % 7 == 0, "async (req, res) => { const r = await pool.query(`q`); if (!r) return res.sendStatus(404); res.json({ r }); }")
        .when(k % 7 == 1, "function (req, res) { const { page } = req.query; res.status(201).json({ a: req.body.name, page }); }")
        .when(k % 7 == 2, F.concat(F.lit("named"), k)).otherwise("unknown")
    )
    named = F.when(k % 7 == 2, F.concat(F.lit("const named"), k, F.lit(" = (req, res) => { res.send('ok'); };\n"))).otherwise("")
    method = F.when(k % 2 == 0, "get").otherwise("post")
    text = F.concat(F.coalesce("uses", F.lit("")), shared, named, F.lit("router."), method, F.lit("('/x' + '"), k, F.lit("/:id', "), own, handler, F.lit(");\nexport default router;\n"))
    files = p.join(below.hint("merge"), "p_partkey", "left").select(F.concat(F.lit("src/f"), k, F.lit(".js")).alias("path"), text.alias("content"))
    e = discovery.discover(routes.read_routes(files))
    joined = F.array_join(F.transform("parameters", lambda x: F.concat(x["name"], F.lit(":"), x["place"])), ",").alias("parameters")
    return e.select("method", "path", "file", "authenticated", "authorized", "database", "is_async", F.array_join("statuses", ",").alias("statuses"), joined, F.array_join("fields", ",").alias("fields"), "found")


@query("""WITH n AS (SELECT l_orderkey AS o, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS i FROM lineitem),
  l AS (SELECT *, i - 1 AS before, count(*) FILTER (f <> 'A') OVER (PARTITION BY o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM n),
  e AS (SELECT o, 'FUNCTION' AS type, 'f' || i AS name, CASE f WHEN 'R' THEN 'MODIFIED' WHEN 'A' THEN 'DELETED' ELSE 'UNCHANGED' END AS change, 1 + 3 * CASE f WHEN 'A' THEN before ELSE kept END AS first, CASE f WHEN 'R' THEN 1 WHEN 'A' THEN 3 ELSE 0 END AS own_lines FROM l)
  SELECT o AS l_orderkey, type, name, change, CAST(first AS INTEGER) AS start, CAST(first + 2 AS INTEGER) AS "end", CAST(own_lines AS INTEGER) AS own_lines FROM e
  UNION ALL SELECT o, 'FILE', 'src/o.js', CASE WHEN bool_or(f <> 'N') THEN 'MODIFIED' ELSE 'UNCHANGED' END, 1, CAST(greatest(1, 3 * count(*) FILTER (f <> 'A')) AS INTEGER), 0 FROM l GROUP BY o""")
def diff_impact(spark, d):
    """A diff of each order: functions of its lines are changed, deleted or left, by their return flags."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("diff_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("flag")))).alias("x"))
    function = lambda i, n: F.array(F.concat(F.lit("function f"), (i + 1).cast("string"), F.lit("() {")), F.lit(f"  return {n};"), F.lit("}"))
    marked = lambda mark, a: F.transform(a, lambda x: F.concat(F.lit(mark), x))
    changed = F.array(F.lit("-  return 1;"), F.lit("+  return 2;"), F.lit(" }"))

    def new(x, i):
        return F.when(x["flag"] == "A", F.array().cast("array<string>")).when(x["flag"] == "R", function(i, 2)).otherwise(function(i, 1))

    def shown(x, i):
        return F.when(x["flag"] == "A", marked("-", function(i, 1))).when(x["flag"] == "R", F.concat(marked(" ", F.slice(function(i, 1), 1, 1)), changed)).otherwise(marked(" ", function(i, 1)))

    part = lambda f: F.flatten(F.transform("x", f))
    g = g.select("diff_id", part(lambda _, i: function(i, 1)).alias("old"), part(new).alias("new"), part(shown).alias("shown"))
    hunk = F.concat(F.lit("@@ -1,"), F.size("old"), F.lit(" +"), F.when(F.size("new") > 0, "1").otherwise("0"), F.lit(","), F.size("new"), F.lit(" @@\n"))
    text = F.concat(F.lit("diff --git a/src/o.js b/src/o.js\n--- a/src/o.js\n+++ b/src/o.js\n"), hunk, F.array_join("shown", "\n"))
    found = diffs.diff_lines(g.select("diff_id", text.alias("diff")))
    named = lambda c: g.select(F.concat("diff_id", F.lit(".js")).alias("path"), F.array_join(c, "\n").alias("content"))
    side = lambda c: javascript.read_javascript(named(c)).select(F.regexp_extract("path", "^([0-9]+)", 1).alias("diff_id"), F.lit("src/o.js").alias("path"), "line_count", "symbols")
    r = impact.impact(diffs.diff_files(found), diffs.changed_ranges(found, "new"), diffs.changed_ranges(found, "old"), side("old"), side("new"))
    return r.select(F.col("diff_id").cast("long").alias("l_orderkey"), "type", "name", "change", "start", "end", "own_lines")


def _scratch(spark, name):
    """A folder in the shared one that no other run uses."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gritmill-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus = 'F' AS failed, CASE o_orderpriority WHEN '1-URGENT' THEN '' ELSE o_orderpriority || chr(10) || 'é' || chr(10) || o_custkey END AS content, o_custkey % 3 = 0 AS late FROM orders)
  SELECT o_orderkey, CAST(CASE WHEN failed THEN 3 WHEN late THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN failed THEN 'status 503 after 3 attempts' END AS error, CASE WHEN NOT failed THEN content END AS content,
  CAST(CASE WHEN NOT failed THEN CASE WHEN content = '' THEN 0 ELSE 3 END END AS INTEGER) AS line_count, CAST(CASE WHEN NOT failed THEN strlen(content) END AS INTEGER) AS size FROM b""")
def recorded_blobs(spark, d):
    """Blobs recorded from the orders: some answer at the second attempt, some never."""
    from ..sources import recorded

    path = _scratch(spark, "recorded")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.concat("o_orderpriority", F.lit("\r\né\r\n"), F.col("o_custkey").cast("string")))
    good = F.struct(F.lit(200).alias("status"), F.to_json(F.struct(F.base64(F.encode(text, "UTF-8")).alias("content"))).alias("body"))
    bad = F.struct(F.lit(503).alias("status"), F.lit(None).cast("string").alias("body"))
    answers = F.when(F.col("o_orderstatus") == "F", F.array(bad)).when(F.col("o_custkey") % 3 == 0, F.array(bad, good)).otherwise(F.array(good))
    table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("request"), answers.alias("answers"))).alias("value")).write.text(path)
    answered = recorded.recorded(spark, path, pause=0)
    rows = recorded.blobs(answered, "attempts", "error", failed=True)
    return rows.select(F.col("request").cast("long").alias("o_orderkey"), "attempts", "error", "content", "line_count", "size")


@query("""WITH e AS (SELECT *, user_id % 2 = 0 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'error', 'view', 'click'))
  SELECT user_id, count(*) * 2 AS deliveries, CASE WHEN a THEN count(*) ELSE 0 END AS repeated, CASE max(event_type) FILTER (r = 1) WHEN 'purchase' THEN 'merged' WHEN 'error' THEN 'closed' ELSE 'open' END AS status FROM e GROUP BY user_id, a""")
def delivery_states(spark, d):
    """All events delivered twice and out of order, by two providers; the state after each, kept by a stream."""
    from .. import streaming
    from ..streaming import deliveries

    spark.conf.set(*deliveries.STATE_STORE)
    root = _scratch(spark, "deliveries")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    kind, number, at = F.col("event_type"), F.col("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    action = F.when(kind.isin("purchase", "error"), "closed").when(kind == "view", "opened").when(kind == "click", "synchronize").otherwise("labeled")
    a = F.to_json(F.struct(action.alias("action"), F.struct(F.lit("Org/Repo").alias("full_name")).alias("repository"), F.struct(number.alias("number"), (kind == "purchase").alias("merged"), at.alias("updated_at")).alias("pull_request")))
    done = F.when(kind == "purchase", "merge").when(kind == "error", "close").when(kind == "view", "open").otherwise("update")
    kept = F.when(kind.isin("purchase", "error", "view", "click"), "merge_request").otherwise("note")
    b = F.to_json(F.struct(kept.alias("object_kind"), F.struct(F.lit("org/repo").alias("path_with_namespace")).alias("project"), F.struct(number.alias("iid"), done.alias("action"), at.alias("updated_at")).alias("object_attributes")))
    first = F.col("user_id") % 2 == 0
    body = F.when(first, a).otherwise(b)
    sign = F.when(first, F.concat(F.lit("sha256="), deliveries.hmac_sha256(body, "secret"))).otherwise("token")
    rows = e.select(
        F.when(first, "a").otherwise("b").alias("provider"), sign.alias("signature"), F.when(first, F.format_string("%020d", "event_id")).alias("delivery"), F.lit("pull_request").alias("event"), body.alias("body"),
    ).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows.repartitionByRange(4, F.xxhash64("body", "copy")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    streaming.drain(deliveries.changes(deliveries.routed(stream, "secret", "token").where("outcome = 'change'")), f"{root}/out", f"{root}/state")
    done = spark.read.parquet(f"{root}/out")
    last = F.max_by("status", F.when(F.col("applied"), F.struct("at", F.coalesce("delivery", F.lit("")))))
    return done.groupBy(F.col("number").alias("user_id")).agg(F.count("*").alias("deliveries"), F.count_if("repeated").alias("repeated"), last.alias("status"))
