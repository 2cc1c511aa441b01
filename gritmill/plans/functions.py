"""Queries over the column functions and the smaller operators, on values that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import advisories as adv
from ..functions import paths
from ..operators import alerts, clones, filters, graph, relations, review, snapshots, splits, training, usage
from ..operators.rounds import spread
from ..sources import advisory_json, table
from .core import query


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_FOLDERS = ["src", "test", "src/tests", "docs", "node_modules/x", ".hidden", "lib\\win", "latest"]
_ENDINGS = [".js", ".py", ".java", ".test.js", ".png", ".min.js", ".md", ".d.ts"]


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 8 AS f, (p_partkey // 8) % 8 AS e, p_partkey % 9 = 0 AS dot FROM part),
  d AS (SELECT *, ['src', 'test', 'src/tests', 'docs', 'node_modules/x', '.hidden', 'lib/win', 'latest'][f + 1] || '/f' || k || ['.js', '.py', '.java', '.test.js', '.png', '.min.js', '.md', '.d.ts'][e + 1] AS normal,
    CASE WHEN dot OR f IN (4, 5) THEN 'excluded_directory' WHEN e = 5 THEN 'excluded_minified_bundle' WHEN e = 4 THEN 'excluded_binary_or_media' WHEN n > 40 THEN 'file_too_large' END AS reason FROM p)
  SELECT k AS p_partkey, normal, CASE e WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 4 THEN 'unknown' WHEN 6 THEN 'unknown' WHEN 7 THEN 'typescript' ELSE 'javascript' END AS language, f IN (1, 2) OR e = 3 AS is_test,
    e IN (0, 1, 2) AND f IN (0, 5, 6, 7) AS is_production, reason IS NULL AS included, reason, CASE WHEN reason IS NULL THEN CASE e WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 6 THEN 'markdown' WHEN 7 THEN 'typescript' ELSE 'javascript' END END AS kept_language,
    CASE WHEN reason IS NULL THEN CASE e WHEN 6 THEN 'documentation' ELSE 'source' END END AS type, CASE WHEN k % 3 = 0 THEN '/a/b' WHEN k % 3 = 1 THEN '/' || k ELSE '/' END AS route, k % 4 < 2 AS public FROM d""")
def path_functions(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 9 == 0, "./").otherwise(""), _pick(_FOLDERS, k % 8), F.lit("/f"), k.cast("string"), _pick(_ENDINGS, F.floor(k / 8) % 8))
    p = table(spark, d, "part").select("p_partkey", path.alias("path"), (F.col("p_size") * 25_000).alias("size"))
    path, x = F.col("path"), paths.file_decision(F.col("path"), F.col("size"))
    route = F.when(k % 3 == 0, paths.route_path(F.lit("/a/"), F.lit("//b/"))).when(k % 3 == 1, paths.route_path(F.lit(None).cast("string"), k.cast("string"))).otherwise(paths.route_path(F.lit(""), F.lit("/")))
    public = paths.is_public_route(_pick(["/health", "/api/auth/login", "/api/auth/me", "/healthy"], k % 4))
    return p.select(
        "p_partkey", paths.normal_path(path).alias("normal"), paths.language_of(path).alias("language"), paths.is_test_path(path).alias("is_test"), paths.is_production_path(path).alias("is_production"),
        x["include"].alias("included"), x["reason"].alias("reason"), x["language"].alias("kept_language"), x["type"].alias("type"), route.alias("route"), public.alias("public"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'flask-cors-' || p_size ELSE 'flask_cors.' || p_size END AS name, CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size WHEN 1 THEN p_size || '.0' ELSE '1.0.0' END AS bare,
  CASE p_partkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS alert, CASE p_partkey % 3 WHEN 0 THEN 'CVE-2020-' || (1000 + p_size) WHEN 1 THEN 'GHSA-aaaa-bbbb-cccc' ELSE 'X-' || p_size END AS canonical,
  p_partkey % 4 < 2 AS queryable, CASE WHEN p_size >= 10 THEN 'Upgrade lib to version 10.0.0 or later.' WHEN p_size >= 2 THEN 'Upgrade lib to version ' || CASE WHEN p_size <= 5 THEN '5.1.0' ELSE '10.0.0' END || ' or later.' ELSE 'No official fixed version currently available for lib. Review advisory details for mitigation.' END AS remediation,
  'WEB:u' || p_size || ',FIX:v' AS refs, printf('%.1f', p_size * 100 / 1024.0) || ' KB' AS kb, CAST(p_size AS DOUBLE) / 2 AS age, CAST(greatest(10, least(100, floor(100 - 2.5 * (p_size % 20) - 2 * (p_partkey % 7) + 0.5))) AS INTEGER) AS health, p_partkey = 7 OR 'id' || p_partkey = '7' AS found FROM part""")
def advisory_functions(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    raw = F.when(k % 2 == 0, adv.package_name(F.lit("PyPI"), F.concat(F.lit(" Flask__Cors."), text(n)))).otherwise(adv.package_name(F.lit("npm"), F.concat(F.lit("Flask_Cors."), text(n))))
    spec = F.when(k % 4 == 0, F.concat(F.lit("^~1."), text(n))).when(k % 4 == 1, F.concat(F.lit(">= "), text(n), F.lit(".0"))).when(k % 4 == 2, "")
    word = F.when(k % 4 == 0, " critical").when(k % 4 == 1, "Low").when(k % 4 == 2, "moderate")
    aliases = F.when(k % 3 == 0, F.array(F.lit("GHSA-aaaa-bbbb-cccc"), F.concat(F.lit("cve-2020-"), text(n + 1000)), F.lit("CVE-2021-1"))).when(k % 3 == 1, F.array(F.lit("GHSA-zzzz-bbbb-cccc"), F.lit("GHSA-aaaa-bbbb-cccc"), F.lit(None).cast("string")))
    version = F.when(k % 4 == 0, "1.0").when(k % 4 == 1, "v2").when(k % 4 == 2, "git+ssh://x").otherwise("")
    fixed = F.when(n >= 2, F.array(F.lit("10.0.0"), F.lit("5.1"), F.lit("nothing"))).otherwise(F.array().cast("array<string>"))
    reference = lambda t, u: F.struct(t.cast("string").alias("type"), u.cast("string").alias("url"))
    refs = adv.references_of(F.array(reference(F.lit(None), F.concat(F.lit("u"), text(n))), reference(F.lit("X"), F.lit("")), reference(F.lit("FIX"), F.lit("v"))))
    then = F.timestamp_micros(F.lit(0)) + F.make_interval(secs=(n / 2).cast("decimal(18,6)"))
    return spread(table(spark, d, "part")).select(
        "p_partkey", raw.alias("name"), adv.bare_version(spec).alias("bare"), adv.alert_severity(word).alias("alert"), adv.canonical_id(F.concat(F.lit("X-"), text(n)), aliases).alias("canonical"), adv.queryable(version).alias("queryable"),
        adv.remediation(fixed, F.concat(text(n), F.lit(".0.0")), F.lit("lib")).alias("remediation"), F.array_join(F.transform(refs, lambda r: F.concat(r["type"], F.lit(":"), r["url"])), ",").alias("refs"), fn.kilobytes(n * 100).alias("kb"),
        fn.age_seconds(F.timestamp_micros(F.lit(0)), then).alias("age"), fn.overview_health(n % 20, k % 7).alias("health"), filters.number_or_id(k, F.concat(F.lit("id"), text(k)), "7").alias("found"),
    )


@query("""WITH a AS (SELECT o_orderkey, o_custkey, CASE CAST(substr(o_orderpriority, 1, 1) AS INT) WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS s FROM orders),
  u AS (SELECT c_custkey, c_custkey % 2 = 0 AS in_app, c_custkey % 3 = 0 AS email, 1 + c_nationkey % 4 AS least, c_custkey % 5 <> 0 AS on_ FROM customer), e AS (SELECT * FROM a JOIN u ON o_custkey = c_custkey WHERE (in_app OR email) AND s >= least AND on_)
  SELECT o_orderkey, 'in_app' AS channel, 'DELIVERED' AS status FROM e WHERE in_app UNION ALL SELECT o_orderkey, 'email', 'FAILED' FROM e WHERE email""")
def notification_dispatch(spark, d):
    """Orders as alerts, customers as the users whose channels and least severities decide."""
    s = _pick(["critical", "HIGH", "Medium", "LOW", "INFO"], F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), s.alias("severity"))
    k = F.col("c_custkey")
    u = table(spark, d, "customer").select("c_custkey", (k % 2 == 0).alias("in_app"), (k % 3 == 0).alias("email"), _pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], F.col("c_nationkey") % 4).alias("least"), (k % 5 != 0).alias("on"))
    told = a.join(u, "c_custkey").where(alerts.eligible(F.col("severity"), F.col("least"), F.col("in_app"), F.col("email"), F.col("on")))
    return alerts.notifications(told, ["o_orderkey"])


@query("""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_size > 45 THEN 'CRITICAL' WHEN p_size > 35 THEN 'HIGH' ELSE 'LOW' END AS s, p_size FROM part),
  b AS (SELECT p_brand, CAST(sum(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) AS BIGINT) AS c, avg(p_size) AS m FROM part GROUP BY p_brand)
  SELECT CAST(k AS VARCHAR) AS subject, CASE s WHEN 'CRITICAL' THEN 'SEC_CRITICAL_VULNERABILITY' ELSE 'SEC_HIGH_VULNERABILITY' END AS rule, s AS severity, 'SEC:C' || k || ':lib' AS dedup_key FROM f WHERE s <> 'LOW'
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE p_partkey % 3 WHEN 0 THEN 'API_MISSING_AUTH' ELSE 'API_UNHANDLED_ASYNC' END, 'HIGH', CASE p_partkey % 3 WHEN 0 THEN 'API_AUTH:' ELSE 'API_ASYNC:' END || 'GET:/x' || p_size FROM part WHERE p_partkey % 3 < 2
  UNION ALL SELECT p_brand, 'SEC_SCORE_LOW', 'HIGH', 'SEC_SCORE_LOW:' || p_brand FROM b WHERE 100 - 10 * c < 70 UNION ALL SELECT p_brand, 'API_SCORE_DROP', 'HIGH', 'API_SCORE_DROP:' || p_brand FROM b WHERE m < 25
  UNION ALL SELECT p_brand, 'CODE_DUPLICATION_SPIKE', 'HIGH', 'DUP_SPIKE:' || p_brand FROM b WHERE m / 80 > 0.30""")
def snapshot_rules(spark, d):
    """Alerts of findings, of endpoints, and of snapshots, made from the parts and their brands."""
    p, k, n = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    text = k.cast("string").alias("subject")
    severity = F.when(n > 45, "CRITICAL").when(n > 35, "HIGH").otherwise("LOW").alias("severity")
    a = alerts.vulnerability_alerts(p.select(text, severity, F.concat(F.lit("C"), k).alias("canonical"), F.lit("lib").alias("package")), ["subject"])
    rule = _pick(["API_MISSING_AUTH", "ASYNC_NO_TRY_CATCH", "API_CONTRACT_INCOMPLETE"], k % 3).alias("rule")
    b = alerts.endpoint_alerts(p.select(text, rule, F.when(k % 3 == 0, "SECURITY").otherwise("RELIABILITY").alias("category"), F.lit("GET").alias("method"), F.concat(F.lit("/x"), n).alias("path")), ["subject"])
    g = p.groupBy(F.col("p_brand").alias("subject")).agg((100 - 10 * F.count_if(n > 45)).alias("security_score"), F.when(F.avg(n) < 25, 60).otherwise(80).alias("api_score"), (F.avg(n) / 80).alias("duplication_ratio"))
    return a.unionByName(b).unionByName(alerts.snapshot_alerts(g, "subject"))


@query("""WITH w AS (SELECT user_id, event_type, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) + 1 AS week, count(*) AS n FROM events GROUP BY 1, 2, 3),
  k AS (SELECT DISTINCT user_id, event_type, a.week FROM w, (SELECT DISTINCT week FROM w) a WHERE a.week > (SELECT min(week) FROM w))
  SELECT k.week, k.user_id || ':' || k.event_type AS clone_hash, CASE WHEN o.n IS NULL THEN 'NEW' WHEN c.n IS NULL THEN 'RESOLVED' WHEN o.n <> c.n THEN 'CHANGED' ELSE 'PERSISTENT' END AS state
  FROM k LEFT JOIN w o ON o.user_id = k.user_id AND o.event_type = k.event_type AND o.week = k.week - 1 LEFT JOIN w c ON c.user_id = k.user_id AND c.event_type = k.event_type AND c.week = k.week WHERE o.n IS NOT NULL OR c.n IS NOT NULL""")
def clone_states(spark, d):
    """All consecutive weeks: kinds of events of a user as clone groups, their number as instances."""
    from .core import _week

    w = table(spark, d, "events").groupBy("user_id", "event_type", _week().alias("week")).agg(F.count("*").alias("instances"))
    first, last = w.agg(F.min("week"), F.max("week")).first()
    key = lambda shift: w.where(F.col("week") + shift <= last).where(F.col("week") + shift > first).select(F.concat_ws("|", F.col("week") + shift, F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).alias("clone_hash"), "instances")
    s = snapshots.clone_trajectory(key(1), key(0))
    return s.select(F.split_part("clone_hash", F.lit("|"), F.lit(1)).cast("int").alias("week"), F.split_part("clone_hash", F.lit("|"), F.lit(2)).alias("clone_hash"), "state")


@query("""WITH l AS (SELECT l_orderkey AS o, l_suppkey AS f, l_partkey % 5 AS s, max(CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS INT) END) AS a, max(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INT) + l_suppkey % 7 END) AS b FROM lineitem GROUP BY 1, 2, 3)
  SELECT 'COMPLEXITY_INCREASE' AS finding, CASE WHEN b - coalesce(a, 0) >= 5 THEN 'high' ELSE 'medium' END AS severity, o AS l_orderkey, 's' || f AS file FROM l WHERE b - coalesce(a, 0) >= 3
  UNION ALL SELECT 'NEW_CODE_SMELL', 'low', o, 's' || f FROM l WHERE a IS NULL AND b IS NOT NULL
  UNION ALL SELECT 'HIGH_DEFECT_PROPENSITY_FILE', CASE WHEN f % 100 >= 80 THEN 'high' ELSE 'medium' END, o, 's' || f FROM (SELECT DISTINCT o, f FROM l) WHERE f % 100 >= 60""")
def review_items(spark, d):
    """Orders as changes, suppliers as files: functions that grew, smells that are new, and risky files."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("file"), (F.col("l_partkey") % 5).alias("symbol"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_suppkey")
    keys = ["l_orderkey", "file", "symbol"]
    old = s.where("l_returnflag <> 'A'").groupBy(*keys).agg(F.max("q").alias("complexity"), F.lit(0).alias("nesting"))
    new = s.where("l_returnflag <> 'R'").groupBy(*keys).agg(F.max(F.col("q") + F.col("l_suppkey") % 7).alias("complexity"), F.lit(0).alias("nesting"))
    smells = review.smell_delta(old, new, keys).withColumn("severity", F.lit("low"))
    files = s.select("l_orderkey", "file", (F.col("l_suppkey") % 100).alias("score")).distinct()
    return review.item_findings(review.structural_deltas(old, new, keys), smells, files, ["l_orderkey"])


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey + 1 AS n, p_partkey + 2 AS o, max(p_partkey) OVER () AS m, 'src/f' || p_partkey || '.js' AS file FROM part)
  SELECT 'IMPORTS' AS type, file AS source_file, NULL AS source_symbol, CASE WHEN k % 4 = 0 THEN 'outside' ELSE 'src/f' || n || CASE WHEN n > m THEN '' ELSE '.js' END END AS target_file, NULL AS target_symbol, CASE WHEN k % 3 = 0 THEN '*' ELSE 'g' || n END AS name FROM p
  UNION ALL SELECT 'EXTENDS', file, 'C' || k, CASE WHEN o <= m THEN 'src/f' || o || '.js' END, CASE WHEN o <= m THEN 'C' || o END, 'C' || o FROM p
  UNION ALL SELECT 'CALLS', file, 'g' || k, file, 'g' || k, 'g' || k FROM p
  UNION ALL SELECT 'CALLS', file, 'g' || k, CASE WHEN k % 4 <> 0 AND n <= m THEN 'src/f' || n || '.js' END, CASE WHEN k % 4 <> 0 AND n <= m THEN 'g' || n END, 'g' || n FROM p""")
def relationship_kinds(spark, d):
    """A file for each part that imports the next one, extends a class of the one after, and calls its own function and the
    imported one."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("src/f"), k, F.lit(".js")).alias("file"))
    name = lambda front, n: F.concat(F.lit(front), (k + n).cast("string"))
    imports = p.select("file", F.when(k % 4 == 0, "outside").otherwise(name("./f", 1)).alias("target"), F.array(F.when(k % 3 == 0, "*").otherwise(name("g", 1))).alias("symbols"), F.lit(1).alias("line"))
    inheritance = p.select("file", name("C", 0).alias("class_name"), name("C", 2).alias("parent"), F.lit(False).alias("is_interface"), F.lit(2).alias("line"))
    calls = p.select("file", name("g", 0).alias("caller"), F.explode(F.array(name("g", 0), name("g", 1))).alias("callee"), F.lit(3).alias("line"))
    symbols = p.select("file", F.explode(F.array(F.struct(name("C", 0).alias("name"), F.lit("CLASS").alias("type"), F.lit(2).alias("line")), F.struct(name("g", 0).alias("name"), F.lit("FUNCTION").alias("type"), F.lit(3).alias("line")))).alias("s")).select("file", "s.*")
    return relations.relationships(p.select(F.col("file").alias("path")), imports, inheritance, calls, symbols)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 97 AS dst FROM lineitem), n AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey % 2 = 0)
  SELECT src, dst FROM e WHERE src IN (SELECT k FROM n) AND dst IN (SELECT k FROM n)""")
def sub_graph(spark, d):
    """The edges between suppliers of every other nation, of a graph that is exported as nodes and edges first."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst"))
    nodes, edges = graph.graph_export(l)
    kept = nodes.join(table(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("node")), "node")
    return graph.within(edges, kept)


@query("""WITH f AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 2 END AS score, p_partkey % 50 AS complexity, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END AS duplicated_lines FROM part)
  SELECT p_partkey AS path, p_size AS lines, score, complexity, duplicated_lines FROM f ORDER BY score DESC NULLS LAST, p_size DESC, p_partkey LIMIT 10""")
def health_hotspots(spark, d):
    """The ten worst files of the health table: measures with predictions and duplicated lines."""
    k, n = F.col("p_partkey").alias("path"), F.col("p_size")
    p = table(spark, d, "part")
    metrics = p.select(k, n.alias("lines"), (F.col("p_partkey") % 50).alias("complexity"))
    scores = p.where("p_partkey % 3 <> 0").select(k, (n * 2).alias("score"))
    doubled = p.where("p_partkey % 4 = 0").select(k, n.alias("duplicated_lines"))
    return snapshots.hotspots_or_complex(snapshots.health_table(metrics, scores, doubled)).select("path", "lines", "score", "complexity", "duplicated_lines")


@query("""WITH n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT DISTINCT lower(substr(p_name, 1, 2)) FROM part UNION SELECT DISTINCT lower(p_brand) FROM part), t AS (SELECT lower(p_type || '/' || p_name || '.js') AS x FROM part)
  SELECT name, count(x) AS uses FROM n LEFT JOIN t ON contains(x, name) WHERE name <> '' GROUP BY name""")
def dependency_usage(spark, d):
    """Words of the parts' names as packages, types and names as the paths of imports that may hold them."""
    p = table(spark, d, "part")
    names = p.select(F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.substring("p_name", 1, 2), F.col("p_brand"))).alias("name"))
    return usage.contained(names, p.select(F.concat("p_type", F.lit("/"), "p_name", F.lit(".js")).alias("text")))


@query("""WITH g AS (SELECT source AS "group", count(*) AS rows, count(*) FILTER (quality = 1) AS positives FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
  s AS (SELECT *, least(3, floor(positives * 4 / rows)) AS stratum, CAST('0x' || substr(md5('split|' || coalesce("group", 'null')), 1, 15) AS BIGINT) AS u FROM g),
  c AS (SELECT *, (sum(rows) OVER (PARTITION BY stratum ORDER BY u, "group" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows / 2) / sum(rows) OVER (PARTITION BY stratum) AS middle FROM s)
  SELECT "group", rows, positives, CASE WHEN middle < 0.7 THEN 'train' WHEN middle < 0.85 THEN 'validation' ELSE 'test' END AS part FROM c""")
def group_split(spark, d):
    """Sources as projects: each in one part, by the share of good documents."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return splits.group_parts(docs, "source", "quality")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'CVE-2020-' || (1000 + p_size) ELSE 'OSV-' || p_partkey END AS canonical, CASE p_partkey % 4 WHEN 0 THEN p_size / 5.0 WHEN 1 THEN 9.8 WHEN 2 THEN 7.5 END AS score,
  CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size / 5.0 >= 9 THEN 'CRITICAL' WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' ELSE 'LOW' END WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE p_partkey % 4 WHEN 1 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' WHEN 2 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N' END AS vector, '1.' || p_size || ',2.0' AS versions, '3.' || p_size AS fixed, 2 AS ranges FROM part""")
def advisory_json_fields(spark, d):
    """Advisories as JSON of four shapes, made from the parts."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    own = F.when(k % 4 == 0, F.concat(F.lit('"database_specific": {"cvss": {"score": '), (F.col("p_size") / 5.0).cast("string"), F.lit("}},")))
    own = own.when(k % 4 == 1, '"severity": [{"type": "CVSS_V2", "score": "x"}, {"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], "database_specific": {"cvss": {"score": "1.0"}},')
    own = own.when(k % 4 == 2, '"database_specific": {"severity": "LOW", "cvss": {"vectorString": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"}},').otherwise('"severity": "odd", "database_specific": {"severity": "moderate"},')
    alias = F.when(k % 2 == 0, F.concat(F.lit('"aliases": ["GHSA-aaaa-bbbb-cccc", "cve-2020-'), (F.col("p_size") + 1000).cast("string"), F.lit('", 7],'))).otherwise("")
    affected = F.concat(F.lit('"affected": [{"versions": [" 1.'), n, F.lit('", 5, "2.0"], "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": " 3.'), n, F.lit('"}]}]}, {"versions": ["2.0"], "ranges": [{"events": "none"}]}, {"ranges": null}]'))
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit('{"id": "OSV-'), k.cast("string"), F.lit('", '), own, alias, affected, F.lit("}")).alias("body"))
    a = F.col("advisory")
    return advisory_json.read_advisories(p).select("p_partkey", a["canonical"].alias("canonical"), F.round(a["score"], 6).alias("score"), a["severity"].alias("severity"), a["vector"].alias("vector"), F.array_join(a["versions"], ",").alias("versions"), F.array_join(a["fixed"], ",").alias("fixed"), F.size(a["ranges"]).alias("ranges"))


@query("""SELECT 'src/p' || p_partkey || '.py' AS path, CASE WHEN p_size % 2 = 0 THEN 12 ELSE 0 END AS windows FROM part""")
def window_rules(spark, d):
    """Files of which every other one has windows that qualify: 12 tokens over three lines."""
    k, n = F.col("p_partkey"), F.col("p_size")
    line = F.when(n % 2 == 0, "a = b + 7").otherwise("( ) [ ] ;")  # five tokens, words or delimiters alone
    f = table(spark, d, "part").select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), F.array_join(F.array_repeat(line, 5), "\n").alias("content"))
    t = clones.tokens(f)
    w = clones.windows(t, 14, 3).groupBy("path").agg(F.count("*").alias("windows"))
    return t.select("path").join(w, "path", "left").fillna(0, ["windows"])


@query()
def defect_training(spark, d):
    """The weights of a model of the documents' labels over the shapes of their texts, calibrated by folds of sources; the fit
    is tested against Newton's method."""
    text = F.coalesce("text", F.lit(""))
    shapes = {"chars": F.length(text), "words": F.regexp_count(text, F.lit(r"\S+")), "line_ends": F.regexp_count(text, F.lit("\n")), "digits": F.regexp_count(text, F.lit("[0-9]")), "symbols": F.regexp_count(text, F.lit(r"[^\w\s]"))}
    docs = table(spark, d, "documents").select("doc_id", "source", *[v.alias(k) for k, v in shapes.items()])
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    artifact = training.train_defects(rows, list(shapes), "quality", "source")
    slope, shift = artifact["platt"]
    out = [(k, f["weight"], f["mean"], f["std"]) for k, f in artifact["features"].items()] + [("intercept", artifact["intercept"], 0.0, 1.0), ("calibration", slope, shift, 1.0)]
    frame = spark.createDataFrame(out, "feature string, weight double, mean double, std double")
    return frame.select("feature", *[F.round(c, 4).alias(c) for c in ("weight", "mean", "std")])
