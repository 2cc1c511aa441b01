"""Queries of the repository analyses over the driver tables: graphs, endpoints, reviews, snapshots, alerts, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, clones, diffs, endpoints, graph, relations, review, snapshots
from ..sources import commits, python_code, table
from .core import _WEEK, _week, query


def _ring_edges(spark, d):
    """Parts in blocks of five that use each other in a ring, and each part uses the one of half its key."""
    p = table(spark, d, "part").select("p_partkey")
    block = F.floor(F.col("p_partkey") / 5)
    ends = p.groupBy(block.alias("b")).agg(F.sort_array(F.collect_list("p_partkey")).alias("k"))
    ring = ends.select(F.explode(F.transform("k", lambda x, i: F.struct(x.alias("src"), F.element_at("k", (i + 1) % F.size("k") + 1).alias("dst")))).alias("e")).select("e.*")
    return ring.union(p.select("p_partkey", F.floor(F.col("p_partkey") / 2)).join(p.select(F.col("p_partkey").alias("dst")), F.floor(F.col("p_partkey") / 2) == F.col("dst"), "left_semi"))


@query("SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_partkey // 5) AS component, count(*) OVER (PARTITION BY p_partkey // 5) AS size FROM part")
def cycle_components(spark, d):
    c = graph.strong_components(_ring_edges(spark, d))
    sizes = c.groupBy("component").agg(F.count("*").alias("size"))
    return c.join(sizes, "component").select("node", "component", "size")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 <> p_partkey UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 <> p_partkey),
  r AS (SELECT p_partkey AS node, 1 AS depth FROM part WHERE p_size = 50 UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src = r.node), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
  SELECT m.node, m.depth, min(p.node) AS via FROM m LEFT JOIN (SELECT p.node, p.depth, e.dst FROM m p JOIN e ON e.src = p.node) p ON p.dst = m.node AND p.depth = m.depth - 1 GROUP BY m.node, m.depth""")
def package_distance(spark, d):
    """Steps from the parts of size 50 along the parts that each part uses, without a bound."""
    p = table(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")).union(p.select("p_partkey", F.floor(F.col("p_partkey") / 3)))
    return graph.distances(e, p.where("p_size = 50").select(F.col("p_partkey").alias("node")))


_ENDPOINTS = """SELECT p_partkey, p_brand, ['GET','POST','PUT','DELETE','PATCH'][p_partkey % 5 + 1] AS method, CASE WHEN p_size > 25 THEN '/parts/:id' ELSE '/parts' END AS path, p_partkey % 11 = 0 AS is_public,
  p_size % 3 <> 0 AS authenticated, p_size % 2 = 0 AS authorized, p_partkey % 4 = 0 AS is_async, p_partkey % 3 = 0 AS has_try, p_size > 10 AS db, p_size > 40 AS ext, p_partkey % 7 = 0 AS two_codes,
  CASE WHEN p_size > 25 THEN 'COMPLETE' WHEN p_partkey % 6 = 0 THEN 'UNKNOWN' ELSE 'PARTIAL' END AS completeness, 2 + CAST(p_size > 10 AS INT) + CAST(p_size > 40 AS INT) AS depth FROM part"""
_API = f"""WITH e AS ({_ENDPOINTS}), f AS (
  SELECT p_partkey, p_brand, 'API_MISSING_AUTH' AS rule, CASE WHEN method <> 'GET' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'SECURITY' AS category FROM e WHERE NOT is_public AND NOT authenticated
  UNION ALL SELECT p_partkey, p_brand, 'API_MISSING_AUTHORIZATION', 'MEDIUM', 'SECURITY' FROM e WHERE authenticated AND NOT authorized AND (path LIKE '%:id' OR method <> 'GET')
  UNION ALL SELECT p_partkey, p_brand, 'API_UNHANDLED_ASYNC', 'HIGH', 'RELIABILITY' FROM e WHERE is_async AND NOT has_try
  UNION ALL SELECT p_partkey, p_brand, 'API_INCONSISTENT_STATUS', 'LOW', 'RELIABILITY' FROM e WHERE two_codes AND NOT has_try
  UNION ALL SELECT p_partkey, p_brand, 'API_DATABASE_NO_ERROR_HANDLING', 'HIGH', 'RELIABILITY' FROM e WHERE db AND NOT has_try
  UNION ALL SELECT p_partkey, p_brand, 'API_EXTERNAL_DEPENDENCY_EXPOSURE', 'MEDIUM', 'RELIABILITY' FROM e WHERE ext AND NOT has_try
  UNION ALL SELECT p_partkey, p_brand, 'API_CONTRACT_INCOMPLETE', 'LOW', 'CONTRACT' FROM e WHERE completeness = 'UNKNOWN'
  UNION ALL SELECT p_partkey, p_brand, 'API_EXCESSIVE_DEPENDENCY_DEPTH', 'LOW', 'PERFORMANCE' FROM e WHERE depth >= 4)"""


def _endpoints(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    methods = F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE", "PATCH")])
    codes = F.when(k % 7 == 0, F.array(F.lit(200), F.lit(404))).otherwise(F.array(F.lit(200)))
    return table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_size", F.element_at(methods, (k % 5 + 1).cast("int")).alias("method"), F.when(n > 25, "/parts/:id").otherwise("/parts").alias("path"), (k % 11 == 0).alias("is_public"),
        (n % 3 != 0).alias("authenticated"), (n % 2 == 0).alias("authorized"), (k % 4 == 0).alias("is_async"), (k % 3 == 0).alias("has_try"), (n > 10).alias("database"), (n > 40).alias("external"), codes.alias("statuses"),
        endpoints.completeness(k % 6 != 0, F.when(n > 25, 1)).alias("completeness"), endpoints.call_depth(n > 10, n > 40, F.lit(True)).alias("depth"),
    )


@query(f"{_API} SELECT p_partkey, rule, severity, category FROM f")
def endpoint_findings(spark, d):
    return endpoints.findings(_endpoints(spark, d), ["p_partkey"])


@query(f"""{_API}, c AS (SELECT p_partkey // 4 AS service, count(*) AS endpoints, count(*) FILTER (NOT is_public) AS closed, count(*) FILTER (NOT is_public AND NOT authenticated) AS unauthenticated, count(*) FILTER (completeness='UNKNOWN') AS unknown,
    count(*) FILTER (method='GET') AS gets FROM e GROUP BY 1), s AS (SELECT p_partkey // 4 AS service, count(*) FILTER (severity='HIGH') AS high, count(*) FILTER (severity='MEDIUM') AS medium, count(*) FILTER (severity='LOW') AS low FROM f GROUP BY 1)
  SELECT service, endpoints, unauthenticated, unknown, gets, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
  round(greatest(0, least(100, 100 - coalesce(12*high+6*medium+2*low, 0) - coalesce(15.0::DOUBLE*unauthenticated/nullif(closed, 0), 0) - 10.0::DOUBLE*unknown/endpoints)), 2) AS score FROM c LEFT JOIN s USING (service)""")
def api_reliability(spark, d):
    """Scores of services of four endpoints each."""
    e = _endpoints(spark, d).withColumn("service", F.floor(F.col("p_partkey") / 4))
    r = endpoints.reliability(e, endpoints.findings(e, ["service"]), ["service"])
    return r.select("service", "endpoints", "unauthenticated", "unknown", F.coalesce(F.col("methods")["GET"], F.lit(0)).alias("gets"), "high", "medium", "low", "score")


@query(f"""WITH e AS ({_ENDPOINTS}), a AS (SELECT * FROM e WHERE p_partkey % 10 <> 1), b AS (SELECT * REPLACE ((p_partkey % 13 = 0) <> authenticated AS authenticated, CASE WHEN p_partkey % 17 = 0 THEN 'UNKNOWN' ELSE completeness END AS completeness) FROM e WHERE p_partkey % 10 <> 2)
  SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'ADDED' WHEN b.p_partkey IS NULL THEN 'REMOVED' WHEN a.authenticated <> b.authenticated OR a.completeness <> b.completeness THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change,
  concat_ws(',', CASE WHEN a.authenticated <> b.authenticated THEN 'authenticated' END, CASE WHEN a.completeness <> b.completeness THEN 'completeness' END) AS changed FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def endpoint_changes(spark, d):
    e = _endpoints(spark, d)
    k = F.col("p_partkey")
    b = e.where(k % 10 != 2).withColumn("authenticated", (k % 13 == 0) != F.col("authenticated")).withColumn("completeness", F.when(k % 17 == 0, "UNKNOWN").otherwise(F.col("completeness")))
    out = endpoints.changes(e.where(k % 10 != 1), b, ["authenticated", "completeness", "statuses"], ["p_partkey"])
    return out.select("p_partkey", "change", F.array_join("changed", ",").alias("changed"))


_REVIEW = """WITH m AS (SELECT l_orderkey, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) * 4 AS churn, max(l_linenumber) - 3 AS dc, min(l_linenumber) - 1 AS dn, count(*) FILTER (l_returnflag='R' AND l_tax > 0.06) AS high, count(*) FILTER (l_returnflag='A' AND l_tax > 0.04) AS medium,
    count(*) FILTER (l_returnflag='N' AND l_tax > 0.04) AS other, bool_or(l_quantity >= 50 AND l_returnflag='R') AS extreme, count(*) FILTER (l_linestatus='O') AS direct, count(*) FILTER (l_linestatus='F') AS transitive,
    CAST(max(l_partkey) % 100 AS BIGINT) AS worst, count(*) FILTER (l_partkey % 100 >= 80) AS risky FROM lineitem GROUP BY l_orderkey),
  s AS (SELECT *, CAST(least(100, 5 + least(25, floor(churn*25/1000.0::DOUBLE + 0.5)) + least(20, least(12, floor(1.5::DOUBLE*greatest(0,dc)+0.5)) + least(8, 2*greatest(0,dn))) + least(25, high*10+medium*5+other*2) + least(15, floor(3*direct+1.5::DOUBLE*transitive+0.5))
    + CASE WHEN worst>=80 THEN 15 WHEN worst>=60 THEN 10 WHEN worst>=40 THEN 5 ELSE 0 END) AS BIGINT) AS score FROM m),
  g AS (SELECT *, CASE WHEN score>=80 THEN 'CRITICAL' WHEN score>=60 THEN 'HIGH' WHEN score>=30 THEN 'MEDIUM' ELSE 'LOW' END AS category, CASE WHEN score>=85 OR extreme OR (direct+transitive>=15 AND high>0) THEN 'BLOCKED' WHEN high>0 OR dc>=10 OR score>=60 OR risky>=2 THEN 'CHANGES_REQUESTED'
    WHEN medium>0 OR score>=35 OR churn>500 OR direct+transitive>=3 THEN 'WARNING' ELSE 'APPROVED' END AS gate FROM s)"""


def _reviewed(spark, d):
    r, n = F.col("l_returnflag"), F.col("l_tax")
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("files"), (F.sum("l_quantity").cast("long") * 4).alias("churn"), (F.max("l_linenumber") - 3).alias("complexity_delta"), (F.min("l_linenumber") - 1).alias("nesting_delta"), F.count_if((r == "R") & (n > 0.06)).alias("high"),
        F.count_if((r == "A") & (n > 0.04)).alias("medium"), F.count_if((r == "N") & (n > 0.04)).alias("other"), F.bool_or((F.col("l_quantity") >= 50) & (r == "R")).alias("extreme"), F.count_if(F.col("l_linestatus") == "O").alias("direct"),
        F.count_if(F.col("l_linestatus") == "F").alias("transitive"), (F.max("l_partkey") % 100).alias("worst_defect"), F.count_if(F.col("l_partkey") % 100 >= 80).alias("risky_files"),
    )
    return review.assessed(m.withColumn("affected_files", F.col("direct") + F.col("transitive")))


@query(f"""{_REVIEW} SELECT l_orderkey, score, category, gate, CASE gate WHEN 'BLOCKED' THEN CAST(score>=85 AS INT) + CAST(extreme AS INT) + CAST(direct+transitive>=15 AS INT) WHEN 'CHANGES_REQUESTED' THEN CAST(high>0 AS INT) + CAST(dc>=10 AS INT) + CAST(score>=60 AS INT) + CAST(risky>=2 AS INT)
  WHEN 'WARNING' THEN CAST(medium>0 AS INT) + CAST(score>=35 AS INT) + CAST(churn>500 AS INT) + CAST(direct+transitive>=3 AS INT) ELSE 0 END AS reasons FROM g""")
def review_gate(spark, d):
    """Orders as changes and their lines as files: all five parts of the score, the gate and the number of its reasons."""
    return _reviewed(spark, d).select("l_orderkey", "score", "category", "gate", F.size("reasons").alias("reasons"))


@query(f"""{_REVIEW} SELECT l_orderkey, 'BROAD_BLAST_RADIUS' AS finding, CASE WHEN direct+transitive >= 8 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE direct+transitive >= 3 UNION ALL SELECT l_orderkey, 'LARGE_CHURN', 'medium' FROM g WHERE churn > 500""")
def review_findings(spark, d):
    return review.change_findings(_reviewed(spark, d), ["l_orderkey"])


@query(f"""{_REVIEW} SELECT l_orderkey AS number, rule, CASE WHEN rule='PR_HIGH_RISK' THEN 'HIGH' ELSE 'CRITICAL' END AS severity, CASE rule WHEN 'PR_BLOCKED' THEN 'PR_BLOCKED:' WHEN 'PR_CRITICAL_RISK' THEN 'PR_CRITICAL:' ELSE 'PR_HIGH:' END || l_orderkey AS dedup_key
  FROM (SELECT *, CASE WHEN gate='BLOCKED' THEN 'PR_BLOCKED' WHEN category='CRITICAL' THEN 'PR_CRITICAL_RISK' WHEN category='HIGH' THEN 'PR_HIGH_RISK' END AS rule FROM g) WHERE rule IS NOT NULL""")
def change_alerts(spark, d):
    return alerts.change_alerts(_reviewed(spark, d).withColumnRenamed("l_orderkey", "number"))


_FILES = f"SELECT {_WEEK} AS week, user_id, count(*) AS lines, count(*) FILTER (event_type='error') AS complexity, count(*) FILTER (event_type='view') AS smells, max(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS has_test FROM events GROUP BY ALL"


def _files(spark, d):
    k = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy(_week().alias("week"), "user_id").agg(F.count("*").alias("lines"), k("error").alias("complexity"), k("view").alias("smells"), F.max((F.col("event_type") == "signup").cast("int")).alias("has_test"))


@query(f"""WITH f AS ({_FILES}), a AS (SELECT * FROM f WHERE week=1), b AS (SELECT * FROM f WHERE week=2), j AS (SELECT coalesce(a.user_id,b.user_id) AS user_id, a.user_id AS o, b.user_id AS n, b.lines-a.lines AS dl, b.complexity-a.complexity AS dc, b.smells-a.smells AS ds FROM a FULL JOIN b ON a.user_id=b.user_id)
  SELECT user_id, CASE WHEN o IS NULL THEN 'ADDED' WHEN n IS NULL THEN 'REMOVED' WHEN dl<>0 OR dc<>0 OR ds<>0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change, dl AS lines_delta, dc AS complexity_delta, ds AS smells_delta, coalesce(dc>0 OR ds>0,false) AS is_regression, coalesce(dc<0 OR ds<0,false) AS is_improvement,
  coalesce(CAST(dc>0 AS INT)+CAST(ds>0 AS INT)+CAST(dl>50 AND dc>0 AS INT),0) AS factors FROM j""")
def file_changes(spark, d):
    f = _files(spark, d)
    return snapshots.file_changes(f.where("week = 1").drop("week", "has_test"), f.where("week = 2").drop("week", "has_test"), ["user_id"]).withColumn("factors", F.size("factors"))


_PROFILE = f"WITH f AS ({_FILES}), p AS (SELECT week, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(avg(greatest(1,complexity)),2) AS avg_complexity, max(greatest(1,complexity)) AS max_complexity, CAST(sum(smells) AS BIGINT) AS smells, round(sum(has_test)*100/count(*)::DOUBLE,1) AS guard_pct FROM f GROUP BY week)"


@query(f"{_PROFILE} SELECT *, CAST(greatest(10, least(100, floor(100 - 2.5::DOUBLE*avg_complexity - 1.5::DOUBLE*(smells/files::DOUBLE) + 0.5))) AS INTEGER) AS maintainability FROM p")
def snapshot_profile(spark, d):
    """A profile of each week; the smells that maintainability counts are those of a mean file, as a week has hundreds."""
    p = snapshots.profile(_files(spark, d), ["week"])
    return p.withColumn("maintainability", snapshots.maintainability(F.col("avg_complexity"), F.lit(0), F.col("smells") / F.col("files")))


@query(f"""{_PROFILE}, u AS (UNPIVOT (SELECT week, CAST(files AS DOUBLE) AS files, CAST(lines AS DOUBLE) AS lines, CAST(avg_complexity AS DOUBLE) AS avg_complexity, CAST(max_complexity AS DOUBLE) AS max_complexity, CAST(smells AS DOUBLE) AS smells, CAST(guard_pct AS DOUBLE) AS guard_pct FROM p)
    ON files, lines, avg_complexity, max_complexity, smells, guard_pct INTO NAME measure VALUE v)
  SELECT b.measure, a.v AS previous, b.v AS "current", round(b.v-a.v,4) AS absolute_delta, round(CASE WHEN a.v=0 THEN CASE WHEN b.v=0 THEN 0 ELSE sign(b.v)*100 END ELSE (b.v-a.v)*100/abs(a.v) END,2) AS percentage_delta FROM (SELECT * FROM u WHERE week=2) b LEFT JOIN (SELECT * FROM u WHERE week=1) a USING (measure)""")
def snapshot_compared(spark, d):
    p = snapshots.profile(_files(spark, d), ["week"])
    return snapshots.compared(p.where("week = 1"), p.where("week = 2"), [c for c in p.columns if c != "week"])


@query("""WITH a AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'ACKNOWLEDGED' WHEN 'error' THEN 'RESOLVED' WHEN 'signup' THEN 'DISMISSED' WHEN 'purchase' THEN 'REOPENED' ELSE 'COMMENTED' END AS action, event_id FROM events),
  g AS (SELECT user_id, arg_max(action, (ts, event_id)) FILTER (action <> 'COMMENTED') AS last, max(ts) FILTER (action='ACKNOWLEDGED') AS acknowledged_at, max(ts) FILTER (action='RESOLVED') AS r, max(ts) FILTER (action='DISMISSED') AS d, max(ts) FILTER (action='REOPENED') AS o, count(*) AS steps FROM a GROUP BY user_id)
  SELECT user_id, CASE last WHEN 'REOPENED' THEN 'OPEN' ELSE coalesce(last,'OPEN') END AS status, acknowledged_at, CASE WHEN o IS NULL OR r > o THEN r END AS resolved_at, CASE WHEN o IS NULL OR d > o THEN d END AS dismissed_at, steps FROM g""")
def alert_lifecycle(spark, d):
    t = F.col("event_type")
    action = F.when(t == "view", "ACKNOWLEDGED").when(t == "error", "RESOLVED").when(t == "signup", "DISMISSED").when(t == "purchase", "REOPENED").otherwise("COMMENTED")
    return alerts.lifecycle(table(spark, d, "events").withColumn("action", action), "user_id", "action", ["ts", "event_id"])


@query("""WITH f AS (SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_orderkey) // 20 AS import_count, count(DISTINCT l_partkey) // 30 AS fan_in, max(l_linenumber) * 3 AS complexity, count(*) FILTER (l_returnflag='R') // 40 AS nesting FROM lineitem GROUP BY 1)
  SELECT l_suppkey, 'LARGE_FILE' AS rule, 'medium' AS severity, CAST(lines AS DOUBLE) AS measured FROM f WHERE lines > 500 UNION ALL SELECT l_suppkey, 'HIGH_IMPORT_COUNT', 'low', CAST(import_count AS DOUBLE) FROM f WHERE import_count > 20
  UNION ALL SELECT l_suppkey, 'HIGH_DEPENDENT_COUNT', 'medium', CAST(fan_in AS DOUBLE) FROM f WHERE fan_in > 10 UNION ALL SELECT l_suppkey, 'LARGE_FUNCTION', 'medium', CAST(lines AS DOUBLE) FROM f WHERE lines > 50
  UNION ALL SELECT l_suppkey, 'HIGH_COMPLEXITY', CASE WHEN complexity > 20 THEN 'high' ELSE 'medium' END, CAST(complexity AS DOUBLE) FROM f WHERE complexity > 10 UNION ALL SELECT l_suppkey, 'DEEP_NESTING', 'medium', CAST(nesting AS DOUBLE) FROM f WHERE nesting > 4""")
def smell_rules(spark, d):
    """All six rules, suppliers as files and as functions."""
    f = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("lines"), F.floor(F.count_distinct("l_orderkey") / 20).alias("import_count"), F.floor(F.count_distinct("l_partkey") / 30).alias("fan_in"),
        (F.max("l_linenumber") * 3).alias("complexity"), F.floor(F.count_if(F.col("l_returnflag") == "R") / 40).alias("nesting"),
    )
    return snapshots.file_smells(f, ["l_suppkey"]).unionByName(snapshots.function_smells(f, ["l_suppkey"]))


_PATHS = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/p' || p_partkey || '.js' WHEN 1 THEN 'lib/q' || p_partkey || '.py' WHEN 2 THEN 'test/src/p' || (p_partkey - 2) || '.spec.js' ELSE 'lib/q' || (p_partkey // 8 * 8 + 1) || '_test.py' END AS path FROM part"""


def _paths(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("src/p"), k, F.lit(".js"))).when(k % 4 == 1, F.concat(F.lit("lib/q"), k, F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit("test/src/p"), k - 2, F.lit(".spec.js")))
    return table(spark, d, "part").select(path.otherwise(F.concat(F.lit("lib/q"), F.floor(k / 8) * 8 + 1, F.lit("_test.py"))).alias("path"))


@query(f"""WITH p AS (SELECT DISTINCT path FROM ({_PATHS})) SELECT path, CASE WHEN path LIKE '%.spec.js' OR path LIKE '%_test.py' THEN 1 WHEN EXISTS (SELECT 1 FROM p q WHERE q.path IN (regexp_replace(p.path,'\\.py$','_test.py'), 'test/' || regexp_replace(p.path,'\\.js$','.spec.js')) AND q.path <> p.path) THEN 1 ELSE 0 END AS has_test FROM p""")
def test_presence(spark, d):
    return snapshots.has_test(_paths(spark, d))


@query("""SELECT p.p_partkey, CASE WHEN p.p_partkey % 5 = 0 THEN 'express' WHEN q.p_partkey IS NULL THEN 'src/a' || (p.p_partkey // 2 * 3 % 10) || '/p' || (p.p_partkey // 2 * 3) ELSE 'src/a' || (q.p_partkey % 10) || '/p' || q.p_partkey || CASE q.p_partkey % 2 WHEN 0 THEN '.js' ELSE '/index.js' END END AS resolved
  FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey // 2 * 3""")
def import_resolution(spark, d):
    """Each part's file imports that of another by a relative path without an ending; some name a package or no file."""
    k = F.col("p_partkey")
    place = lambda n: F.concat(F.lit("a"), n % 10, F.lit("/p"), n)
    p = table(spark, d, "part")
    files = p.select(F.concat(F.lit("src/"), place(k), F.when(k % 2 == 0, ".js").otherwise("/index.js")).alias("path"))
    folder = F.concat(F.lit("src/a"), k % 10, F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("/p"), k)))
    target = F.concat(F.when(k % 2 == 0, "../").otherwise(".././../"), place(F.floor(k / 2) * 3))
    i = p.select("p_partkey", F.concat(folder, F.lit("/f.js")).alias("file"), F.when(k % 5 == 0, "express").otherwise(target).alias("target"))
    return relations.resolved_imports(i, files).select("p_partkey", "resolved")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS diff_id, 'src/o' || l_orderkey || '.txt' AS file_path, count(*) FILTER (l_returnflag='A') AS additions, count(*) FILTER (l_returnflag='R') AS deletions FROM lineitem GROUP BY l_orderkey""")
def diff_parse(spark, d):
    """A unified diff of each order, its lines added, removed or context by their flag, read back by the parser."""
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(sign, F.lit("line "), "l_partkey"))), "\n").alias("body"), F.count_if(F.col("l_returnflag") != "A").alias("o"), F.count_if(F.col("l_returnflag") != "R").alias("n"),
    )
    path = F.concat(F.lit("src/o"), "l_orderkey", F.lit(".txt"))
    text = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), "o", F.lit(" +1,"), "n", F.lit(" @@\n"), "body")
    return diffs.diff_files(diffs.diff_lines(g.select(F.col("l_orderkey").cast("string").alias("diff_id"), text.alias("diff")))).select("diff_id", "file_path", "additions", "deletions")


@query("""WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 5 IN (1, 2)), f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'N' AND l_suppkey % 3 <> 0),
  k AS (SELECT l_orderkey FROM f GROUP BY l_orderkey HAVING count(*) <= 3) SELECT CAST(l_orderkey AS VARCHAR) AS "commit", CAST(l_orderkey - 1 AS VARCHAR) AS parent, 'src/s' || l_suppkey || '.js' AS path FROM f JOIN k USING (l_orderkey) JOIN c ON o_orderkey = l_orderkey""")
def commit_fixes(spark, d):
    """Orders as commits, their suppliers as files: merges, other messages, tests, unmodified and bulk changes fall out."""
    k = F.col("o_orderkey")
    subject = F.when(k % 5 == 1, "Fixes #12 | parser").when(k % 5 == 2, "fix(core): guard").when(k % 5 == 3, "Prefix 12 things").otherwise("Add a page")
    log = table(spark, d, "orders").select(F.concat(k, F.lit("|"), k - 1, F.when(k % 4 == 3, " 7").otherwise(""), F.lit("|"), subject).alias("line"))
    s = F.col("l_suppkey")
    path = F.when(s % 3 == 0, F.concat(F.lit("test/s"), s, F.lit(".test.js"))).otherwise(F.concat(F.lit("src/s"), s, F.lit(".js")))
    changed = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), F.concat(F.when(F.col("l_returnflag") == "N", "A").otherwise("M"), F.lit("\t"), path).alias("line"))
    return commits.fixes(commits.log_lines(log), commits.change_lines(changed), largest=3)


@query("""SELECT l_orderkey, CAST(count(*) AS INTEGER) AS functions, CAST(max(CASE WHEN l_returnflag='R' THEN 4 ELSE 3 END) AS INTEGER) AS max_complexity, CAST(max(CASE WHEN l_returnflag='R' THEN 3 ELSE 2 END) AS INTEGER) AS nesting, CAST(count(*) + count(*) FILTER (l_returnflag='R') AS INTEGER) AS calls,
  CAST(2 + sum(CASE WHEN l_returnflag='R' THEN 6 ELSE 4 END) AS INTEGER) AS line_count FROM lineitem GROUP BY 1""")
def py_parse(spark, d):
    """A Python file of each order with a function for each line: the parser's measures."""
    plain = "def f(self, a, b=1):\n    if a and b:\n        return g(a)\n"
    deep = "def f(a):\n    if a or len(a):\n        for x in range(a):\n            g.h(x, k(x))\n    return 1\n"
    body = F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "R", deep + "# end if\n").otherwise(plain + "\n")), "")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("import os, sys as s\n"), body).alias("content"))
    o = python_code.read_python(g.select(F.col("l_orderkey").cast("string").alias("path"), "content"))
    top = lambda name: F.array_max(F.transform("functions", lambda f: f[name])).alias(name)
    return o.select(F.col("path").cast("long").alias("l_orderkey"), F.size("functions").alias("functions"), top("complexity").alias("max_complexity"), top("nesting"), F.size("calls").alias("calls"), "line_count")


@query()
def token_clones(spark, d):
    """Source files made from the parts: those of one size hold the same statements under other names. Tested against brute
    force, as SQL has no tokens."""
    k, n = F.col("p_partkey"), F.col("p_size")
    ops = F.array(*[F.lit(o) for o in ("+", "-", "*", "/", "%", "&", "|", "^")])
    op = lambda i, m: F.element_at(ops, (F.pmod(n * (i * m + 1) + i * i, F.lit(8)) + 1).cast("int"))
    line = lambda i: F.concat(F.lit("v"), F.when(k % 2 == 0, k.cast("string")).otherwise("w"), F.lit(" = a "), op(i, 3), F.lit(" b "), op(i, 5), F.lit(" 7;"))
    f = table(spark, d, "part").select(F.concat(F.lit("src/p"), k, F.lit(".js")).alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), line), "\n").alias("content"))
    t = clones.tokens(f)
    return clones.clone_groups(clones.clone_regions(t))
