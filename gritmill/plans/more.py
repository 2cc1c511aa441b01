"""More queries over the driver tables: filters, sorts, aggregates, upserts, versions and classifier metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import SEVERITY_RANK, file_maintainability, hash_prefix, metric_delta, ranked, risk_class
from ..functions.advisories import is_affected, severity_of, version_change
from ..operators import filters, graph, metrics
from ..sources import table
from .core import _SEV, _WEEK, _week, query


def _severity():
    kinds = {"error": "CRITICAL", "purchase": "HIGH", "view": "MEDIUM", "click": "LOW"}
    out = F.lit("INFO")
    for k, v in kinds.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL AND upper(o_orderstatus) IN ('O','P')""")
def filter_builder(spark, d):
    """A null sentinel and a comma-separated list, put together from parameters."""
    o = table(spark, d, "orders").withColumn("owner", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return o.where(filters.all_of(filters.or_null(F.col("owner"), "unassigned"), filters.in_list(F.col("o_orderstatus"), " o, p ,"), filters.one_of(F.col("o_orderpriority"), "ALL", "ALL"))).select("o_orderkey", "o_custkey")


@query(f"SELECT event_id, {_SEV} AS severity FROM events WHERE {_SEV} = 'CRITICAL' AND user_id % 2 = 0")
def severity_scope(spark, d):
    e = table(spark, d, "events").withColumn("severity", _severity())
    return e.where(filters.all_of(filters.one_of(F.col("severity"), "critical", "ALL"), filters.scope(F.col("user_id") % 2 == 0, "direct"))).select("event_id", "severity")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey) IN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def composite_membership(spark, d):
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return li.join(li.where("l_returnflag = 'R'").select(*keys), keys, "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY nullif(p_size, 50) DESC NULLS LAST, p_partkey LIMIT 100 OFFSET 100""")
def sorted_page(spark, d):
    """A feature: the second page, its size clamped to 100, by an allowed column with nulls last."""
    size, number = filters.page_bounds(500, 2)
    p = table(spark, d, "part").withColumn("size", F.nullif("p_size", F.lit(50)))
    rows = filters.ordered(p, "size", {"size": F.col("size"), "price": F.col("p_retailprice")}, "price", True, ["p_partkey"])
    return rows.offset(size * (number - 1)).limit(size).select("p_partkey", "p_retailprice")


@query(f"""SELECT event_id, severity FROM (SELECT event_id, ts, {_SEV} AS severity FROM events)
  ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, ts DESC, event_id LIMIT 50""")
def rank_sorted(spark, d):
    """A feature: the 50 first by rank of severity, then latest."""
    e = table(spark, d, "events").withColumn("severity", _severity())
    return e.orderBy(ranked(F.col("severity"), SEVERITY_RANK).desc(), F.desc("ts"), "event_id").limit(50).select("event_id", "severity")


@query("""SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL""")
def keep_first(spark, d):
    return filters.keep_first(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


@query("SELECT l_suppkey AS node FROM lineitem UNION SELECT -l_partkey-1 FROM lineitem")
def node_union(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("node")).distinct().union(li.select((-F.col("l_partkey") - 1).alias("node")).distinct()).distinct()


@query("""WITH p AS (SELECT user_id, max(CASE WHEN event_type='error' THEN value ELSE 1 END) AS complexity, count(*) AS lines, count(*) FILTER (event_type='view') AS smells FROM events GROUP BY user_id)
  SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(avg(complexity),4) AS mean_complexity, max(complexity) AS max_complexity, round(sum(complexity*lines)/sum(lines),4) AS weighted FROM p""")
def second_level(spark, d):
    """A pivot with the default 1, then sum, mean, largest and the mean weighted by lines."""
    e = table(spark, d, "events")
    p = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value")).otherwise(1)).alias("complexity"), F.count("*").alias("lines"))
    c, n = F.col("complexity"), F.col("lines")
    return p.agg(F.count("*").alias("files"), F.sum(n).alias("lines"), F.round(F.avg(c), 4).alias("mean_complexity"), F.max(c).alias("max_complexity"), F.round(F.sum(c * n) / F.sum(n), 4).alias("weighted"))


@query("""SELECT user_id, day, CAST(greatest(10, least(100, floor(100 - 2.5::DOUBLE*c - 4*n - 5*s + 0.5))) AS INTEGER) AS maintainability,
  CASE WHEN 20*c>=80 THEN 'CRITICAL' WHEN 20*c>=60 THEN 'HIGH' WHEN 20*c>=40 THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, count(*) FILTER (event_type='error') AS c, count(*) FILTER (event_type='view') AS n, count(*) FILTER (event_type='click') AS s FROM events GROUP BY 1, 2)""")
def maintainability(spark, d):
    """A user's day as a file: errors as complexity, views as nesting, clicks as smells."""
    k = lambda t: F.count_if(F.col("event_type") == t)
    g = table(spark, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day")).agg(k("error").alias("c"), k("view").alias("n"), k("click").alias("s"))
    return g.select("user_id", "day", file_maintainability(F.col("c"), F.col("n"), F.col("s")).alias("maintainability"), risk_class(20 * F.col("c")).alias("risk"))


@query("""SELECT o_custkey, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS churn, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS largest, bool_or(o_orderstatus='F') AS any_final,
  count(*) FILTER (o_totalprice > 100000) AS big, max(o_totalprice) AS most FROM orders GROUP BY o_custkey""")
def churn(spark, d):
    """Totals, the arg-max (the first of equal ones), any and count-if in one aggregation."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(
        F.sum("o_totalprice").cast("decimal(18,2)").alias("churn"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"),
        F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.max("o_totalprice").alias("most"),
    )


@query(f"""SELECT coalesce(max(event_id),0)+1 AS next_number, count(*) FILTER (value IS NULL OR value < 50) AS unread, count(*) FILTER ({_SEV}='CRITICAL') AS critical,
  count(*) FILTER (user_id % 2 = 0) AS direct, count(*) FILTER (user_id % 2 <> 0) AS transitive, count(DISTINCT user_id) AS packages, round(avg(value),4) AS mean_value FROM events""")
def overview_kpis(spark, d):
    e, direct = table(spark, d, "events"), F.col("user_id") % 2 == 0
    return e.agg(
        (F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_number"), F.count_if(F.col("value").isNull() | (F.col("value") < 50)).alias("unread"), F.count_if(_severity() == "CRITICAL").alias("critical"),
        F.count_if(direct).alias("direct"), F.count_if(~direct).alias("transitive"), F.count_distinct("user_id").alias("packages"), F.round(F.avg("value"), 4).alias("mean_value"),
    )


@query("""SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (l_linestatus='O') AS open_, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def count_by_kind(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open_"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""WITH s AS (SELECT quality AS y, 1/(1+exp(-(CAST(n_chars AS DOUBLE)-2000)/2000)) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
  r AS (SELECT round(p,6) AS s, count(*) AS n, sum(y) AS k FROM s GROUP BY 1), w AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS above, sum(k) OVER (ORDER BY s DESC) AS hits FROM r),
  a AS (SELECT sum(k) AS pos, sum(n) AS cnt, sum((n-k)*(hits-k/2.0::DOUBLE)) AS pairs, sum(k*hits/above::DOUBLE) AS ap FROM w), t AS (SELECT count(*) FILTER (p>=0.5 AND y=1) AS tp, count(*) FILTER (p>=0.5 AND y<>1) AS fp, avg((p-y)*(p-y)) AS brier FROM s),
  e AS (SELECT sum(g)/(SELECT count(*) FROM s) AS ece FROM (SELECT abs(sum(y)-sum(p)) AS g FROM s GROUP BY least(4, floor(p*5))))
  SELECT CAST(cnt AS BIGINT) AS n, CAST(pos AS BIGINT) AS positives, round(pairs/(pos*(cnt-pos)),6) AS roc_auc, round(ap/pos,6) AS pr_auc, round(brier,6) AS brier, round(ece,6) AS ece, tp, fp,
  CAST(cnt-pos-fp AS BIGINT) AS tn, CAST(pos-tp AS BIGINT) AS fn, round(tp/(tp+fp)::DOUBLE,6) AS "precision", round(tp/pos::DOUBLE,6) AS recall, round(2.0::DOUBLE*tp/(2*tp+fp+pos-tp),6) AS f1 FROM a, t, e""")
def classifier_metrics(spark, d):
    j = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    m = metrics.classifier_metrics(j.withColumn("score", 1 / (1 + F.exp(-(F.col("n_chars").cast("double") - 2000) / 2000))))
    exact = ("n", "positives", "tp", "fp", "tn", "fn")
    return m.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in m.columns])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 <> p_partkey UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 <> p_partkey),
  r AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT e.src, r.depth+1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3),
  m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT m.node, m.depth, min(p.node) AS via, CASE WHEN m.depth = 1 THEN 'direct' ELSE 'transitive' END AS reach
  FROM m JOIN e ON e.src = m.node JOIN m p ON p.node = e.dst AND p.depth = m.depth - 1 WHERE m.depth > 0 GROUP BY m.node, m.depth""")
def blast_radius(spark, d):
    """Parts that use part 5 within three steps; part k uses k // 2 and k // 3."""
    p = table(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")).union(p.select("p_partkey", F.floor(F.col("p_partkey") / 3)))
    out = graph.impact(e, spark.range(5, 6).select(F.col("id").alias("node")), 3)
    return out.withColumn("reach", F.when(F.col("depth") == 1, "direct").otherwise("transitive"))


_ADVISORIES = [
    ("A1", "Brand#11", [("1.0.0", None, None), (None, "20.0.0", None), ("30", None, None), (None, None, "35.5.0")]),
    ("A2", "Brand#11", [("0", None, None), (None, "8.0.0", None)]),
    ("A3", "Brand#23", [("40.0.0", None, None)]),
    ("A4", "Brand#55", [("10.0.0", None, None), (None, None, "12.3.0")]),
]


@query("""SELECT p_partkey, a AS advisory FROM part JOIN (VALUES ('A1','Brand#11',1,0,20,0,false),('A1','Brand#11',30,0,35,5,true),('A2','Brand#11',0,0,8,0,false),('A3','Brand#23',40,0,9999,0,false),('A4','Brand#55',10,0,12,3,true)) t(a,b,lo,lo2,hi,hi2,incl)
  ON p_brand = b AND (p_size, p_partkey % 10) >= (lo, lo2) AND ((p_size, p_partkey % 10) < (hi, hi2) OR incl AND (p_size, p_partkey % 10) = (hi, hi2))""")
def advisory_match(spark, d):
    """Installed versions against advisories: an equi join on the package, then event spans on the matching rows only."""
    a = spark.createDataFrame([(i, b, [(ev,)]) for i, b, ev in _ADVISORIES], "advisory string, p_brand string, ranges array<struct<events: array<struct<introduced: string, fixed: string, last_affected: string>>>>")
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.lit("0")).alias("version"))
    return p.join(a, "p_brand").where(is_affected(F.col("version"), F.array().cast("array<string>"), F.col("ranges"))).select("p_partkey", "advisory")


@query("""WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 7 AS b FROM part), n AS (SELECT p_partkey - 1 AS p_partkey, a, b FROM v WHERE p_partkey % 3 <> 0)
  SELECT coalesce(v.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN v.a IS NULL THEN 'ADDED' WHEN n.a IS NULL THEN 'REMOVED' WHEN (n.a,n.b) = (v.a,v.b) THEN 'UNCHANGED' WHEN (n.a,n.b) > (v.a,v.b) THEN 'UPGRADED' ELSE 'DOWNGRADED' END AS change
  FROM v FULL JOIN n ON v.p_partkey = n.p_partkey""")
def dependency_changes(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 7, F.lit(".0")).alias("old"))
    n = v.where("p_partkey % 3 <> 0").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("old").alias("new"))
    return v.join(n, "p_partkey", "full").select("p_partkey", version_change(F.col("old"), F.col("new")).alias("change"))


@query("""SELECT p_partkey, CASE WHEN p_size/5.0 >= 9 THEN 'CRITICAL' WHEN p_size/5.0 >= 7 THEN 'HIGH' WHEN p_size/5.0 >= 4 THEN 'MEDIUM' WHEN p_size > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS severity,
  substr(sha256(p_brand || chr(10) || p_type),1,16) AS key FROM part""")
def scored_severity(spark, d):
    return table(spark, d, "part").select("p_partkey", severity_of(F.lit(""), F.col("p_size") / 5).alias("severity"), hash_prefix(F.array("p_brand", "p_type")).alias("key"))


@query(f"""WITH w AS (SELECT user_id, {_WEEK} AS week, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT * FROM w WHERE week=1), b AS (SELECT * FROM w WHERE week=2)
  SELECT user_id, n, 1 AS first_week FROM a UNION ALL SELECT user_id, n, 2 FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def insert_if_absent(spark, d):
    w = table(spark, d, "events").groupBy("user_id", _week().alias("first_week")).agg(F.count("*").alias("n")).select("user_id", "n", "first_week")
    return filters.insert_absent(w.where("first_week = 1"), w.where("first_week = 2"), ["user_id"])


@query(f"""WITH w AS (SELECT user_id, {_WEEK} AS week, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS status FROM w WHERE week=1), b AS (SELECT * FROM w WHERE week=2)
  SELECT coalesce(a.user_id,b.user_id) AS user_id, CASE WHEN b.n IS NULL OR a.status='RESOLVED' THEN a.n ELSE b.n END AS evidence, coalesce(a.status,'OPEN') AS status, coalesce(a.week,b.week) AS first_seen FROM a FULL JOIN b ON a.user_id=b.user_id""")
def finding_upsert(spark, d):
    """Findings of week 2 onto those of week 1: status and first sight are kept, resolved ones stay untouched."""
    w = table(spark, d, "events").groupBy("user_id", _week().alias("first_seen")).agg(F.count("*").alias("evidence"))
    old = w.where("first_seen = 1").select("user_id", "evidence", F.when(F.col("evidence") % 4 == 0, "RESOLVED").otherwise("ACKNOWLEDGED").alias("status"), "first_seen")
    new = w.where("first_seen = 2").select("user_id", "evidence", F.lit("OPEN").alias("status"), "first_seen")
    return filters.upsert_keeping(old, new, ["user_id"], ["status", "first_seen"], F.col("status") == "RESOLVED")


@query(f"""WITH w AS (SELECT {_WEEK} AS week, count(*) AS n, count(*) FILTER (event_type='error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
  l AS (SELECT *, lag(n) OVER o AS pn, lag(errors) OVER o AS pe, lag(users) OVER o AS pu, row_number() OVER o AS k FROM w WINDOW o AS (ORDER BY week))
  SELECT 'Snap #' || k AS label, CAST(n - coalesce(pn,0) AS DOUBLE) AS n_delta, CAST(errors - coalesce(pe,0) AS DOUBLE) AS errors_delta, round(CASE WHEN coalesce(pu,0)=0 THEN 100.0 ELSE (users-pu)*100.0::DOUBLE/pu END,2) AS users_pct,
  CASE WHEN pn IS NULL THEN 'BASELINE' ELSE 'COMPARED' END AS state FROM l""")
def history_timeline(spark, d):
    """Several measures of each snapshot against the one before; rows are one for each week."""
    g = table(spark, d, "events").groupBy(_week().alias("week")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))
    by = Window.orderBy("week")
    before = lambda c: metric_delta(F.lag(c).over(by), F.col(c))
    return g.select(
        F.concat(F.lit("Snap #"), F.row_number().over(by).cast("string")).alias("label"), before("n")["absoluteDelta"].alias("n_delta"), before("errors")["absoluteDelta"].alias("errors_delta"),
        before("users")["percentageDelta"].alias("users_pct"), F.when(F.lag("n").over(by).isNull(), "BASELINE").otherwise("COMPARED").alias("state"),
    )


@query("""SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'merged' WHEN 'error' THEN 'closed' ELSE 'open' END AS status, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN false WHEN 'error' THEN false ELSE true END AS analysed
  FROM events WHERE event_type IN ('purchase','error','view','click') GROUP BY user_id""")
def pull_request_state(spark, d):
    """The state after the last routed event, ties by event id; closed ones are not analysed."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error", "view", "click"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    status = F.when(F.col("t") == "purchase", "merged").when(F.col("t") == "error", "closed").otherwise("open")
    return last.select("user_id", status.alias("status"), (status == "open").alias("analysed"))


@query("""SELECT c_custkey, c_name AS name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'""")
def star_left_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_totalprice")
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")).join(o, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")


@query("""SELECT l_orderkey, l_linenumber, p_partkey, p_brand, s_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE l_returnflag = 'A'""")
def two_left_joins(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, d, "part").where("p_size > 25").select("p_partkey", "p_brand")
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("l_partkey", "l_suppkey", "s_suppkey")


@query("""WITH g AS (SELECT user_id, CASE WHEN event_type='error' AND value>95 THEN 'BLOCKED' WHEN event_type='error' AND value>80 THEN 'CRITICAL' WHEN event_type='purchase' AND value>95 THEN 'HIGH' END AS rule FROM events)
  SELECT user_id, CASE min(CASE rule WHEN 'BLOCKED' THEN 1 WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 3 END) WHEN 1 THEN 'PR:BLOCKED' WHEN 2 THEN 'PR:CRITICAL' ELSE 'PR:HIGH' END AS rule_id FROM g WHERE rule IS NOT NULL GROUP BY user_id""")
def exclusive_alert_rules(spark, d):
    """One alert for each user: the first of the exclusive rules that holds."""
    t, v = F.col("event_type"), F.col("value")
    rule = F.when((t == "error") & (v > 95), 1).when((t == "error") & (v > 80), 2).when((t == "purchase") & (v > 95), 3)
    g = table(spark, d, "events").select("user_id", rule.alias("rule")).where("rule is not null").groupBy("user_id").agg(F.min("rule").alias("r"))
    return g.select("user_id", F.when(F.col("r") == 1, "PR:BLOCKED").when(F.col("r") == 2, "PR:CRITICAL").otherwise("PR:HIGH").alias("rule_id"))
