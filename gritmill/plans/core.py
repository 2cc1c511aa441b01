"""Queries over the driver tables, each a composition of operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import SEVERITY_RANK, clamp, cvss_base, logistic, posture_score, ranked, round_half_up, version_key
from ..operators import graph, intervals, relational, text
from ..sources import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _week(ts="ts"):
    return F.floor((F.unix_date(F.to_date(ts)) - 19723) / 7).cast("int") + 1


_WEEK = "CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) + 1"
_SEV = "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'view' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'INFO' END"


def _count_if(kind: str):
    return F.count_if(F.col("event_type") == kind)


@query("""SELECT user_id, critical, high, medium, low,
  CAST(greatest(0, least(100, 100 - (20*critical + 10*high + 5*medium + low))) AS BIGINT) AS score,
  CASE WHEN critical > 0 THEN 4 WHEN high > 0 THEN 3 WHEN medium > 0 THEN 2 WHEN low > 0 THEN 1 ELSE 0 END AS worst_rank FROM (
  SELECT user_id, count(*) FILTER (event_type='error' AND value > 95) AS critical, count(*) FILTER (event_type='purchase' AND value > 90) AS high,
  count(*) FILTER (event_type='view' AND value > 80) AS medium, count(*) FILTER (event_type='click') AS low FROM events GROUP BY user_id)""")
def posture_score_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    big = lambda kind, v: F.count_if((F.col("event_type") == kind) & (F.col("value") > v))
    c = e.groupBy("user_id").agg(big("error", 95).alias("critical"), big("purchase", 90).alias("high"), big("view", 80).alias("medium"), _count_if("click").alias("low"))
    worst = F.when(F.col("critical") > 0, 4).when(F.col("high") > 0, 3).when(F.col("medium") > 0, 2).when(F.col("low") > 0, 1).otherwise(0)
    return c.withColumn("score", posture_score(F.col("critical"), F.col("high"), F.col("medium"), F.col("low"))).withColumn("worst_rank", worst)


@query("""SELECT user_id, max(CASE WHEN event_type='click' THEN value END) AS click, max(CASE WHEN event_type='error' THEN value END) AS error,
  max(CASE WHEN event_type='purchase' THEN value END) AS purchase FROM events GROUP BY user_id""")
def conditional_pivot(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "error", "purchase")])


@query("""WITH p AS (SELECT user_id, max(CASE WHEN event_type='click' THEN value ELSE 0 END) AS click, max(CASE WHEN event_type='error' THEN value ELSE 0 END) AS error,
    max(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS purchase FROM events GROUP BY user_id)
  SELECT count(*) AS users, round(sum(click),4) AS click_sum, round(avg(click),4) AS click_avg, max(click) AS click_max, round(sum(error),4) AS error_sum, round(avg(error),4) AS error_avg, max(error) AS error_max,
    round(sum(purchase),4) AS purchase_sum, round(avg(purchase),4) AS purchase_avg, max(purchase) AS purchase_max, count(*) FILTER (error > 0) AS with_errors FROM p""")
def conditional_pivot_whole(spark, d):
    """Global statistics over the pivot, 0 for a kind that a user has not."""
    kinds = ("click", "error", "purchase")
    p = table(spark, d, "events").groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)).alias(k) for k in kinds])
    stats = [x for k in kinds for x in (F.round(F.sum(k), 4).alias(f"{k}_sum"), F.round(F.avg(k), 4).alias(f"{k}_avg"), F.max(k).alias(f"{k}_max"))]
    return p.agg(F.count("*").alias("users"), *stats, F.count_if(F.col("error") > 0).alias("with_errors"))


@query("""SELECT user_id, count(*) FILTER (event_type='click') AS click, count(*) FILTER (event_type='error') AS error,
  count(*) FILTER (event_type='purchase') AS purchase, count(*) FILTER (event_type='signup') AS signup, count(*) FILTER (event_type='view') AS "view" FROM events GROUP BY user_id""")
def eav_to_wide(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.lit(1).cast("long").alias("one"))
    return relational.pivot_sum(e, ["user_id"], "event_type", "one", ["click", "error", "purchase", "signup", "view"])


@query("""SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS metrics FROM
  (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def eav_to_map(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pair = F.concat_ws("=", "event_type", F.col("n").cast("string"))
    return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("metrics"))


@query("""SELECT l_partkey, lines, debt FROM (SELECT l_partkey, count(*) AS lines,
  CAST(greatest(0, floor(2*count(DISTINCT l_suppkey) + 3*(max(l_linenumber)) + 5*count(*) FILTER (l_returnflag='R') - 5*max(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) + 0.5)) AS BIGINT) AS debt
  FROM lineitem GROUP BY l_partkey) ORDER BY debt DESC, l_partkey LIMIT 100 OFFSET 100""")
def debt_score_page(spark, d):
    """A feature: page 2 of 100 rows by debt."""
    li = table(spark, d, "lineitem")
    has = F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0))
    debt = 2 * F.count_distinct("l_suppkey") + 3 * F.max("l_linenumber") + 5 * F.count_if(F.col("l_returnflag") == "R") - 5 * has
    g = li.groupBy("l_partkey").agg(F.count("*").alias("lines"), F.greatest(F.lit(0).cast("long"), round_half_up(debt).cast("long")).alias("debt"))
    return relational.page(g, [F.desc("debt"), F.col("l_partkey")], 100, 2)


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, count(*) OVER () AS total FROM orders
  WHERE o_orderstatus IN ('F','P') AND o_orderpriority LIKE '1-%' ORDER BY o_orderkey LIMIT 50""")
def dynamic_filter_page(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P") & F.col("o_orderpriority").startswith("1-"))
    total = o.agg(F.count("*").alias("total"))  # one row
    return relational.page(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), [F.col("o_orderkey")], 50, 1).join(F.broadcast(total))


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ed%' OR p_brand ILIKE '%ed%' OR p_type ILIKE '%ed%' OR list_contains(string_split(p_name,' '),'bolt')""")
def search_ilike(spark, d):
    """A pattern in one of three columns, or a word among the name's."""
    match = F.col("p_name").ilike("%ed%") | F.col("p_brand").ilike("%ed%") | F.col("p_type").ilike("%ed%") | F.array_contains(F.split("p_name", " "), "bolt")
    return table(spark, d, "part").where(match).select("p_partkey", "p_name")


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'")
def ttl_filter(spark, d):
    return table(spark, d, "events").where("ts > timestamp_ntz'2024-01-29 00:00:00'").select("event_id", "user_id")


@query(r"""SELECT page_id, CASE WHEN url IS NULL THEN 'missing' WHEN url LIKE '%utm_%' THEN 'tracking' WHEN regexp_matches(url, '\.html?($|[?#])') THEN 'html_file'
  WHEN url LIKE '%#%' THEN 'fragment' WHEN url LIKE '%/' THEN 'folder' ELSE 'page' END AS reason,
  url IS NOT NULL AND url NOT LIKE '%utm_%' AS included FROM pages""")
def file_filter_reason(spark, d):
    u = F.col("url")
    reason = F.when(u.isNull(), "missing").when(u.contains("utm_"), "tracking").when(u.rlike(r"\.html?($|[?#])"), "html_file").when(u.contains("#"), "fragment").when(u.endswith("/"), "folder").otherwise("page")
    return table(spark, d, "pages").select("page_id", reason.alias("reason"), (u.isNotNull() & ~u.contains("utm_")).alias("included"))


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
  FROM orders WHERE o_orderstatus='F' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def latest_per_group(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    last = relational.latest_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, d, "customer").select("c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, o_orderkey AS dearest FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def lateral_top1(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("dearest"))
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "dearest")


@query("""SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
  LEFT JOIN nation cn ON c_nationkey=cn.n_nationkey LEFT JOIN nation sn ON s_nationkey=sn.n_nationkey GROUP BY ALL""")
def double_left_join(spark, d):
    n = table(spark, d, "nation")
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # aggregated by keys before the names are joined
    g = j.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    g = g.join(cn, "c_nationkey", "left").join(sn, "s_nationkey", "left")
    return g.groupBy("customer_nation", "supplier_nation").agg(F.sum("n").alias("n"), F.sum("q").cast("long").alias("quantity"))


@query("""SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_orderstatus='O' GROUP BY c_custkey""")
def left_join_on_predicate(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"))


@query("""SELECT r_name, year(o_orderdate) AS y, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey=o_orderkey
  JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL""")
def star_join(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    dims = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    j = li.select("l_orderkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(dims, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("r_name", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderpriority LIKE '1-%') AS urgent,
  min(CAST(substr(o_orderpriority,1,1) AS INTEGER)) AS top_rank FROM orders GROUP BY o_custkey""")
def json_agg_filter(spark, d):
    o = table(spark, d, "orders")
    keys = F.array_sort(F.collect_list(F.when(F.col("o_orderpriority").startswith("1-"), F.col("o_orderkey"))))
    joined = F.array_join(F.transform("k", lambda x: x.cast("string")), ",")
    g = o.groupBy("o_custkey").agg(keys.alias("k"), F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("top_rank"))
    return g.select("o_custkey", F.when(F.size("k") > 0, joined).alias("urgent"), "top_rank")


@query("""SELECT p AS l_partkey, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_first' ELSE 'only_second' END AS side FROM (
  SELECT l_partkey AS p, bool_or(year(l_shipdate)=1996) AS a, bool_or(year(l_shipdate)=1997) AS b FROM lineitem WHERE year(l_shipdate) IN (1996,1997) GROUP BY l_partkey)""")
def semi_anti(spark, d):
    """Parts shipped in one of two years or in both: one aggregate with two flags over a range that the scan takes."""
    li = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01 00:00:00' and l_shipdate < timestamp_ntz'1998-01-01 00:00:00'")
    first = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    g = li.groupBy("l_partkey").agg(F.bool_or(first).alias("a"), F.bool_or(~first).alias("b"))
    return g.select("l_partkey", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_first").otherwise("only_second").alias("side"))


def _weekly(spark, d):
    return table(spark, d, "events").groupBy("user_id", _week().alias("week")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT user_id, {_WEEK} AS week, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT * FROM w WHERE week=1), b AS (SELECT * FROM w WHERE week=2)
  SELECT coalesce(a.user_id,b.user_id) AS user_id, a.n AS old_value, b.n AS new_value, CASE WHEN a.n IS NULL THEN 'ADDED' WHEN b.n IS NULL THEN 'REMOVED'
  WHEN a.n<>b.n THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change FROM a FULL JOIN b ON a.user_id=b.user_id""")
def snapshot_diff(spark, d):
    w = _weekly(spark, d)
    return relational.snapshot_diff(w.where("week = 1").drop("week"), w.where("week = 2").drop("week"), ["user_id"], "n")


@query(f"""WITH w AS (SELECT {_WEEK} AS week, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (ORDER BY week) AS previous FROM w)
  SELECT week, n, previous, n - coalesce(previous,n) AS delta, round(CASE WHEN previous IS NULL THEN 0.0 WHEN previous=0 THEN CASE WHEN n=0 THEN 0.0 ELSE 100.0*sign(n) END
  ELSE (n-previous)*100.0::DOUBLE/abs(previous) END, 2) AS pct, previous IS NULL AS is_baseline FROM l""")
def lag_timeline(spark, d):
    return relational.lag_deltas(table(spark, d, "events").groupBy(_week().alias("week")).agg(F.count("*").alias("n")), "week", "n")


@query(f"""WITH v AS (SELECT *, {_WEEK} AS week FROM events), m AS (SELECT min(week) AS lo, max(week) AS hi FROM v), w AS (SELECT DISTINCT user_id, week FROM v WHERE event_type='error')
  SELECT coalesce(b.week, a.week+1) AS week, count(*) FILTER (a.week IS NULL) AS new_users, count(*) FILTER (a.week IS NOT NULL AND b.week IS NOT NULL) AS persistent, count(*) FILTER (b.week IS NULL) AS resolved
  FROM (SELECT w.* FROM w, m WHERE week<hi) a FULL JOIN (SELECT w.* FROM w, m WHERE week>lo) b ON a.user_id=b.user_id AND b.week=a.week+1 GROUP BY 1""")
def pairwise_trajectory(spark, d):
    """All consecutive pairs from the first to the last week of the events."""
    e = table(spark, d, "events").select("user_id", "event_type", _week().alias("week"))
    ends = F.broadcast(e.agg(F.min("week").alias("lo"), F.max("week").alias("hi")))  # one row
    w = e.where("event_type = 'error'").select("user_id", "week").distinct().join(ends)
    votes = w.where("week > lo").select("user_id", "week", F.lit(1).alias("now"), F.lit(0).alias("before")).union(w.where("week < hi").select("user_id", F.col("week") + 1, F.lit(0), F.lit(1)))
    p = votes.groupBy("user_id", "week").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    return p.groupBy("week").agg(F.count_if(F.col("before") == 0).alias("new_users"), F.count_if((F.col("before") == 1) & (F.col("now") == 1)).alias("persistent"), F.count_if(F.col("now") == 0).alias("resolved"))


@query("""SELECT a.p_partkey, CASE WHEN b.k > a.k THEN 'upgrade' WHEN b.k < a.k THEN 'downgrade' ELSE 'same' END AS transition FROM
  (SELECT p_partkey, [p_size, CAST(floor(p_retailprice) AS BIGINT)] AS k FROM part) a JOIN (SELECT p_partkey-1 AS p, [p_size, CAST(floor(p_retailprice) AS BIGINT)] AS k FROM part) b ON a.p_partkey=b.p""")
def version_transition(spark, d):
    p = table(spark, d, "part").select("p_partkey", version_key(F.concat_ws(".", F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string"))).alias("k"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("k").alias("after"))
    move = F.when(F.col("after") > F.col("k"), "upgrade").when(F.col("after") < F.col("k"), "downgrade").otherwise("same")
    return p.join(nxt, "p_partkey").select("p_partkey", move.alias("transition"))


@query("""SELECT p_partkey, a.id AS advisory FROM part JOIN (VALUES ('A1',1,10),('A2',8,20),('A3',30,31),('A4',45,60)) a(id,lo,hi) ON p_size >= lo AND p_size < hi""")
def semver_range_match(spark, d):
    a = spark.createDataFrame([("A1", "1", "10"), ("A2", "8", "20"), ("A3", "30", "31"), ("A4", "45", "60")], "advisory string, lo string, hi string")
    p = table(spark, d, "part").select("p_partkey", version_key(F.col("p_size").cast("string")).alias("k"))
    a = a.select("advisory", version_key(F.col("lo")).alias("lo"), version_key(F.col("hi")).alias("hi"))  # four rows
    return p.join(F.broadcast(a), (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).select("p_partkey", "advisory")


@query(f"SELECT user_id, event_type, min({_WEEK}) AS first_week FROM events GROUP BY ALL")
def first_seen(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(_week()).alias("first_week"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
  SELECT s_suppkey AS node, 0::BIGINT AS fan_in, count(l_partkey) AS fan_out FROM supplier LEFT JOIN e ON l_suppkey=s_suppkey GROUP BY 1
  UNION ALL SELECT -p_partkey-1, count(l_suppkey), 0 FROM part LEFT JOIN e ON l_partkey=p_partkey GROUP BY 1""")
def degree_metrics(spark, d):
    """Degrees of all suppliers and parts (-key-1) over all lineitem edges."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")).union(table(spark, d, "part").select(-F.col("p_partkey") - 1))
    return graph.degrees(e, nodes)


_SUCC = "SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS dst FROM events"


def _successions(spark, d):
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts")
    return table(spark, d, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null")


@query(f"WITH e AS ({_SUCC}) SELECT DISTINCT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src=y.dst AND x.dst=y.src WHERE x.src < x.dst")
def reciprocal_edges(spark, d):
    return graph.reciprocal(_successions(spark, d))


_SHIP = "SELECT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 20 + o_orderkey % 15 AS e FROM orders"


@query(f"""WITH i AS ({_SHIP}), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
  g AS (SELECT *, sum(CASE WHEN s <= b+1 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS k FROM m),
  u AS (SELECT o_custkey, k, min(s) AS s, max(e) AS e FROM g GROUP BY o_custkey, k) SELECT o_custkey, count(*) AS ranges, CAST(sum(e-s+1) AS BIGINT) AS days FROM u GROUP BY o_custkey""")
def interval_union(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("s"), "o_orderkey")
    i = o.withColumn("e", F.col("s") + 20 + F.col("o_orderkey") % 15).drop("o_orderkey")
    return intervals.merge_intervals(i, ["o_custkey"], "s", "e").groupBy("o_custkey").agg(F.count("*").alias("ranges"), F.sum(F.col("e") - F.col("s") + 1).alias("days"))


@query("""WITH x AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events), y AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM x)
  SELECT user_id, CAST(min(day) AS BIGINT) AS "first", CAST(max(day) AS BIGINT) AS "last", count(*) AS length FROM y GROUP BY user_id, g""")
def range_compress(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_date(F.to_date("ts")) - 19723).cast("long").alias("day"))
    return intervals.compress(e, ["user_id"], "day")


@query(f"""WITH i AS (SELECT o_custkey, s, e FROM ({_SHIP})), p AS (SELECT * FROM (VALUES (1,9200,9230),(2,9500,9600),(3,9590,9700)) t(promo,ps,pe))
  SELECT promo, count(*) AS n, CAST(sum(least(e,pe)-greatest(s,ps)+1) AS BIGINT) AS days FROM i JOIN p ON s<=pe AND ps<=e GROUP BY promo""")
def range_overlap_join(spark, d):
    s = F.unix_date(F.to_date("o_orderdate")).cast("long")
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("a_id"), s.alias("a_start"), (s + 20 + F.col("o_orderkey") % 15).alias("a_end"))
    b = spark.createDataFrame([(1, 9200, 9230), (2, 9500, 9600), (3, 9590, 9700)], "promo int, b_start long, b_end long")
    j = intervals.overlap_join(a, b, 32)
    return j.groupBy("promo").agg(F.count("*").alias("n"), F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1).alias("days"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split(text,' '), lambda x: x<>'') AS w FROM documents), h AS (SELECT doc_id, sha256(array_to_string(w[i:i+7],' ')) AS hash
  FROM (SELECT doc_id, w, unnest(range(1, len(w)-6)) AS i FROM w WHERE len(w)>=8)) SELECT hash, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places FROM h GROUP BY hash HAVING count(DISTINCT doc_id)>=2""")
def shingle_clones(spark, d):
    return text.clone_windows(table(spark, d, "documents"), "doc_id", "text", 8)


@query("SELECT sha256(text) AS digest, count(*) AS members, min(doc_id) AS first_id, count(DISTINCT source)>1 AS across_sources FROM documents GROUP BY 1 HAVING count(*)>=2")
def exact_dup_groups(spark, d):
    return text.equal_texts(table(spark, d, "documents"), "doc_id", "text", "source")


_ORDER_AGG = "SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_discount) AS disc, count(*) FILTER (l_returnflag='R') AS ret, count(DISTINCT l_suppkey) AS sup FROM lineitem GROUP BY l_orderkey"


def _orders_agg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.max("l_discount").alias("disc"), F.count_if(F.col("l_returnflag") == "R").alias("ret"), F.count_distinct("l_suppkey").alias("sup"))


@query(f"""WITH a AS ({_ORDER_AGG}) SELECT l_orderkey, 'TOO_MANY_LINES' AS rule, 'high' AS severity, CAST(n AS DOUBLE) AS measured FROM a WHERE n>=8
  UNION ALL SELECT l_orderkey,'LARGE_QUANTITY','medium',CAST(q AS DOUBLE) FROM a WHERE q>200 UNION ALL SELECT l_orderkey,'RETURNS','low',CAST(ret AS DOUBLE) FROM a WHERE ret>=3
  UNION ALL SELECT l_orderkey,'MANY_SUPPLIERS','medium',CAST(sup AS DOUBLE) FROM a WHERE sup>=7 UNION ALL SELECT l_orderkey,'DEEP_DISCOUNT','low',CAST(disc AS DOUBLE) FROM a WHERE disc>=0.1
  UNION ALL SELECT l_orderkey,'LARGE_LINES',CASE WHEN q>45*n THEN 'high' ELSE 'medium' END,q::DOUBLE/n FROM a WHERE q>40*n""")
def rule_engine(spark, d):
    """Six threshold rules; the last one's severity depends on the measured value."""
    c = F.col
    return relational.rule_rows(_orders_agg(spark, d), ["l_orderkey"], [
        ("TOO_MANY_LINES", "high", c("n") >= 8, c("n")), ("LARGE_QUANTITY", "medium", c("q") > 200, c("q")),
        ("RETURNS", "low", c("ret") >= 3, c("ret")), ("MANY_SUPPLIERS", "medium", c("sup") >= 7, c("sup")),
        ("DEEP_DISCOUNT", "low", c("disc") >= 0.1, c("disc")),
        ("LARGE_LINES", "high", c("q") > 45 * c("n"), c("q") / c("n")), ("LARGE_LINES", "medium", (c("q") > 40 * c("n")) & (c("q") <= 45 * c("n")), c("q") / c("n")),
    ])


@query(f"""WITH a AS ({_ORDER_AGG}), s AS (SELECT *, CAST(greatest(0,least(100, 5 + least(25, floor(25.0*q/300+0.5)) + least(20, floor(1.5*n+0.5)) + least(25, 10*ret) + least(15, floor(3.0*sup+0.5)))) AS BIGINT) AS score FROM a)
  SELECT l_orderkey, score, CASE WHEN score>=80 THEN 'CRITICAL' WHEN score>=60 THEN 'HIGH' WHEN score>=30 THEN 'MEDIUM' ELSE 'LOW' END AS category,
  CASE WHEN score>=85 OR ret>=4 THEN 'BLOCKED' WHEN ret>=3 OR score>=60 THEN 'CHANGES_REQUESTED' WHEN score>=35 OR q>150 THEN 'WARNING' ELSE 'APPROVED' END AS gate FROM s""")
def quality_gate(spark, d):
    c = F.col
    points = F.lit(5) + F.least(F.lit(25), round_half_up(25.0 * c("q") / 300)) + F.least(F.lit(20), round_half_up(1.5 * c("n"))) + F.least(F.lit(25), 10 * c("ret")) + F.least(F.lit(15), round_half_up(3.0 * c("sup")))
    a = _orders_agg(spark, d).withColumn("score", clamp(points, 0, 100).cast("long"))
    cat = F.when(c("score") >= 80, "CRITICAL").when(c("score") >= 60, "HIGH").when(c("score") >= 30, "MEDIUM").otherwise("LOW")
    gate = F.when((c("score") >= 85) | (c("ret") >= 4), "BLOCKED").when((c("ret") >= 3) | (c("score") >= 60), "CHANGES_REQUESTED").when((c("score") >= 35) | (c("q") > 150), "WARNING").otherwise("APPROVED")
    return a.select("l_orderkey", "score", cat.alias("category"), gate.alias("gate"))


@query(f"""WITH w AS (SELECT user_id, {_WEEK} AS week, count(*) FILTER (event_type='error') AS n FROM events GROUP BY ALL HAVING count(*) FILTER (event_type='error')>=4), a AS (SELECT * FROM w WHERE week=1), b AS (SELECT * FROM w WHERE week=2)
  SELECT 'ERR:'||coalesce(b.user_id,a.user_id) AS dedup_key, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'auto_resolved' ELSE 'updated' END AS action, coalesce(b.n,a.n) AS evidence FROM a FULL JOIN b ON a.user_id=b.user_id""")
def alert_upsert(spark, d):
    w = table(spark, d, "events").groupBy("user_id", _week().alias("week")).agg(_count_if("error").alias("n")).where("n >= 4")
    diff = relational.snapshot_diff(w.where("week = 1").drop("week"), w.where("week = 2").drop("week"), ["user_id"], "n")
    action = F.when(F.col("change") == "ADDED", "new").when(F.col("change") == "REMOVED", "auto_resolved").otherwise("updated")
    return diff.select(F.concat(F.lit("ERR:"), F.col("user_id").cast("string")).alias("dedup_key"), action.alias("action"), F.coalesce("new_value", "old_value").alias("evidence"))


@query("""SELECT user_id, CASE arg_max(event_type, ts) WHEN 'error' THEN 'OPEN' WHEN 'view' THEN 'ACKNOWLEDGED' WHEN 'purchase' THEN 'RESOLVED' ELSE 'DISMISSED' END AS state FROM events GROUP BY user_id""")
def alert_state_fold(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("t"))
    return last.select("user_id", F.when(F.col("t") == "error", "OPEN").when(F.col("t") == "view", "ACKNOWLEDGED").when(F.col("t") == "purchase", "RESOLVED").otherwise("DISMISSED").alias("state"))


@query(f"""WITH a AS (SELECT event_id, user_id, {_SEV} AS sev FROM events), r AS (SELECT *, CASE sev WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS k FROM a)
  SELECT event_id, p.who FROM r JOIN (VALUES ('ann',3,0),('bob',4,1),('cy',0,2)) p(who,least_rank,rest) ON k>=least_rank AND user_id%3=rest""")
def notify_filter(spark, d):
    prefs = spark.createDataFrame([("ann", 3, 0), ("bob", 4, 1), ("cy", 0, 2)], "who string, least_rank int, rest long")  # three rows
    sev = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "view", "MEDIUM").when(F.col("event_type") == "click", "LOW").otherwise("INFO")
    a = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("rest"), ranked(sev, SEVERITY_RANK).alias("k"))
    return a.join(F.broadcast(prefs), "rest").where("k >= least_rank").select("event_id", "who")


#: Intercept, Platt slope and shift of the defect model.
_MODEL = (0.8294944851331408, -0.9812037165617706, -0.3323704321727805)


#: Fixed values: (weight, mean, deviation) of all features of the defect model, in its order.
_FEATURES = {
    "lines": (0.957, 998.0886, 1952.563), "function_count": (-0.4329, 37.5443, 91.7371), "class_count": (-0.278, 4.4962, 15.9435), "import_count": (1.3524, 9.9646, 18.7364),
    "export_count": (0.8165, 36.057, 89.5209), "avg_complexity": (-0.0807, 3.3122, 4.4512), "max_complexity": (0.7963, 12.0051, 17.5816), "fan_in": (-0.0875, 43.1646, 114.7328),
    "fan_out": (-0.5085, 212.3266, 405.4502), "smells": (1.1824, 5.8443, 12.8372), "has_test": (0.0, 0.0, 1.0),
}
_DEFECT = """WITH f AS (SELECT l_suppkey, count(*) AS lines, count(DISTINCT date_trunc('month', l_shipdate)) AS function_count, count(DISTINCT l_returnflag) AS class_count,
    count(*) FILTER (l_linestatus='O' AND l_quantity<=2) AS import_count, count(*) FILTER (l_linestatus='F' AND l_quantity<=5) AS export_count, avg(l_linenumber) AS avg_complexity, max(l_linenumber) AS max_complexity,
    count(DISTINCT l_partkey) AS fan_in, count(DISTINCT l_orderkey) AS fan_out, count(*) FILTER (l_returnflag='R' AND l_quantity>=49) AS smells, max(CASE WHEN l_discount=0 THEN 1 ELSE 0 END) AS has_test FROM lineitem GROUP BY l_suppkey),
  g AS (SELECT *, 0.8294944851331408::DOUBLE + 0.957::DOUBLE*(lines-998.0886::DOUBLE)/1952.563::DOUBLE - 0.4329::DOUBLE*(function_count-37.5443::DOUBLE)/91.7371::DOUBLE - 0.278::DOUBLE*(class_count-4.4962::DOUBLE)/15.9435::DOUBLE
    + 1.3524::DOUBLE*(import_count-9.9646::DOUBLE)/18.7364::DOUBLE + 0.8165::DOUBLE*(export_count-36.057::DOUBLE)/89.5209::DOUBLE - 0.0807::DOUBLE*(avg_complexity-3.3122::DOUBLE)/4.4512::DOUBLE
    + 0.7963::DOUBLE*(max_complexity-12.0051::DOUBLE)/17.5816::DOUBLE - 0.0875::DOUBLE*(fan_in-43.1646::DOUBLE)/114.7328::DOUBLE - 0.5085::DOUBLE*(fan_out-212.3266::DOUBLE)/405.4502::DOUBLE
    + 1.1824::DOUBLE*(smells-5.8443::DOUBLE)/12.8372::DOUBLE + 0.0::DOUBLE*has_test AS logit FROM f),
  p AS (SELECT *, 1/(1+exp(-0.9812037165617706::DOUBLE*logit - 0.3323704321727805::DOUBLE)) AS pr FROM g),
  s AS (SELECT l_suppkey, lines, round(pr,4) AS probability, CAST(greatest(5,least(98,floor(100*pr+0.5))) AS BIGINT) AS score FROM p)"""


def _defects(spark, d):
    """Analogs of all features by supplier: lines; ship months, return flags; small open and finished lines; mean and
    largest line number; parts, orders; large returns; whether a line has no discount. Counts lie in the model's scale."""
    f = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("lines"), F.count_distinct(F.trunc("l_shipdate", "month")).alias("function_count"), F.count_distinct("l_returnflag").alias("class_count"),
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") <= 2)).alias("import_count"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") <= 5)).alias("export_count"), F.avg("l_linenumber").alias("avg_complexity"), F.max("l_linenumber").alias("max_complexity"),
        F.count_distinct("l_partkey").alias("fan_in"), F.count_distinct("l_orderkey").alias("fan_out"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).alias("smells"), F.max(F.when(F.col("l_discount") == 0, 1).otherwise(0)).alias("has_test"),
    )
    logit = F.lit(_MODEL[0])
    for name, (w, mu, sd) in _FEATURES.items():
        logit = logit + F.lit(w) * (F.col(name) - mu) / sd
    p = logistic(logit, _MODEL[1], _MODEL[2])
    return f.select("l_suppkey", "lines", F.round(p, 4).alias("probability"), clamp(round_half_up(100 * p), 5, 98).cast("long").alias("score"))


@query(f"{_DEFECT} SELECT l_suppkey, probability, score FROM s")
def defect_scoring(spark, d):
    return _defects(spark, d).select("l_suppkey", "probability", "score")


@query(f"{_DEFECT} SELECT l_suppkey, lines, probability, score FROM s ORDER BY score DESC, lines DESC, l_suppkey LIMIT 10")
def hotspots(spark, d):
    return _defects(spark, d).orderBy(F.desc("score"), F.desc("lines"), "l_suppkey").limit(10)


_CVSS_KEYS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "NLH", "I": "NLH", "A": "NLH"}


@query("""WITH k AS (SELECT p_partkey, p_partkey % 4 AS av, p_partkey // 4 % 2 AS ac, p_partkey // 8 % 3 AS pr, p_partkey // 24 % 2 AS ui, p_partkey // 48 % 2 AS s,
    p_partkey // 96 % 3 AS c, p_partkey // 288 % 3 AS i, p_partkey // 864 % 3 AS a FROM part),
  w AS (SELECT *, 8.22::DOUBLE * [0.85,0.62,0.55,0.2][av+1]::DOUBLE * [0.77,0.44][ac+1]::DOUBLE * (CASE WHEN s=1 THEN [0.85,0.68,0.5][pr+1] ELSE [0.85,0.62,0.27][pr+1] END)::DOUBLE * [0.85,0.62][ui+1]::DOUBLE AS e,
    1 - (1-[0,0.22,0.56][c+1]::DOUBLE) * (1-[0,0.22,0.56][i+1]::DOUBLE) * (1-[0,0.22,0.56][a+1]::DOUBLE) AS iss FROM k),
  b AS (SELECT *, CASE WHEN iss<=0 THEN 0 WHEN s=1 THEN least(10, 1.08*(7.52*(iss-0.029) - 3.25*pow(iss-0.02,15) + e)) ELSE least(10, 6.42*iss + e) END AS raw FROM w)
  SELECT p_partkey, CAST(greatest(0, ceil(round(raw*100000)/10000)/10) AS DOUBLE) AS cvss FROM b""")
def cvss(spark, d):
    """Base scores of a vector for each part, its metric values spelled by the digits of the key."""
    vector, step = F.lit("CVSS:3.1"), 1
    for name, values in _CVSS_KEYS.items():
        digit = (F.floor(F.col("p_partkey") / step) % len(values)).cast("int")
        vector, step = F.concat(vector, F.lit(f"/{name}:"), F.substring(F.lit(values), digit + 1, F.lit(1))), step * len(values)
    return table(spark, d, "part").select("p_partkey", cvss_base(vector).alias("cvss"))


@query("""WITH s AS (SELECT doc_id, quality, 1/(1+exp(-(CAST(n_chars AS DOUBLE)-2000)/2000)) AS p FROM labels JOIN documents USING (doc_id)), b AS (SELECT *, least(4, CAST(floor(p*5) AS INTEGER)) AS bin FROM s)
  SELECT bin, count(*) AS n, round(avg(p),6) AS confidence, round(avg(quality),6) AS accuracy FROM b GROUP BY bin""")
def calibration_ece(spark, d):
    j = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = logistic((F.col("n_chars").cast("double") - 2000) / 2000)
    b = j.withColumn("p", p).withColumn("bin", F.least(F.lit(4), F.floor(F.col("p") * 5).cast("int")))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("quality"), 6).alias("accuracy"))


@query("""WITH s AS (SELECT quality, 1/(1+exp(-(CAST(n_chars AS DOUBLE)-2000)/2000)) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
  b AS (SELECT least(4, CAST(floor(p*5) AS INTEGER)) AS bin, count(*) AS n, avg(p) AS confidence, avg(quality) AS accuracy FROM s GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(accuracy-confidence)*n)/sum(n),6) AS ece FROM b""")
def calibration_ece_whole(spark, d):
    """The expected calibration error over the five bins."""
    j = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null and n_chars is not null")
    b = j.withColumn("p", logistic((F.col("n_chars").cast("double") - 2000) / 2000)).withColumn("bin", F.least(F.lit(4), F.floor(F.col("p") * 5).cast("int")))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("quality").alias("accuracy"))
    return g.agg(F.sum("n").alias("n"), F.round(F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n"), 6).alias("ece"))


@query("""SELECT CASE WHEN l_quantity<=10 THEN '0-10' WHEN l_quantity<=25 THEN '11-25' WHEN l_quantity<=40 THEN '26-40' ELSE '41+' END AS bucket, count(*) AS n,
  round(count(*)*100.0::DOUBLE/(SELECT count(*) FROM lineitem),3) AS pct FROM lineitem GROUP BY 1""")
def histogram_buckets(spark, d):
    q = F.col("l_quantity")
    b = F.when(q <= 10, "0-10").when(q <= 25, "11-25").when(q <= 40, "26-40").otherwise("41+")
    g = table(spark, d, "lineitem").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 3))  # four rows


@query(r"""WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url,'^[a-z]+://',''),'[?#].*$',''),'/'), lambda x: x<>'') AS parts FROM pages WHERE url IS NOT NULL)
  SELECT array_to_string(parts[1:i],'/') AS prefix, count(*) AS n FROM (SELECT parts, unnest(range(1,len(parts)+1)) AS i FROM p) GROUP BY 1""")
def tree_rollup(spark, d):
    """Prefixes of every depth, the page itself as the leaf."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = table(spark, d, "pages").where("url is not null").select(F.filter(F.split(bare, "/"), lambda x: x != "").alias("parts")).where("size(parts) > 0")
    pre = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    return p.select(F.explode(pre).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props,'$.k') AS BIGINT)) AS BIGINT) AS total_k, count(json_extract_string(props,'$.k')) AS n FROM events GROUP BY event_type")
def json_extract(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count(k).alias("n"))


@query("""SELECT doc_id, CASE WHEN lower(text) LIKE '%rights reserved%' THEN 'licence' WHEN lower(text) LIKE '%password%' OR lower(text) LIKE '%token%' THEN 'secret' WHEN lower(text) LIKE '%@%' THEN 'contact' ELSE 'prose' END AS category FROM documents""")
def keyword_category(spark, d):
    t = F.lower("text")
    cat = F.when(t.contains("rights reserved"), "licence").when(t.contains("password") | t.contains("token"), "secret").when(t.contains("@"), "contact").otherwise("prose")
    return table(spark, d, "documents").select("doc_id", cat.alias("category"))


@query("""SELECT source, CASE WHEN CAST('0x'||substr(md5(CAST(doc_id AS VARCHAR)),1,7) AS BIGINT)%10<7 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, round(avg(quality),6) AS positive_rate
  FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def dataset_split_stats(spark, d):
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source", F.when(h % 10 < 7, "train").otherwise("holdout").alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("positive_rate"))


@query(f"""WITH w AS (SELECT user_id, {_WEEK} AS week, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE week=2 UNION ALL SELECT * FROM w WHERE week=1 AND user_id NOT IN (SELECT user_id FROM w WHERE week=2)""")
def scd_merge(spark, d):
    w = _weekly(spark, d)
    return relational.merge_rows(w.where("week = 1"), w.where("week = 2"), ["user_id"])


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, d):
    """Events by day through a file stream that runs all that is available; rows equal the batch aggregate."""
    from .. import streaming

    return _streamed(spark, d, lambda s: streaming.tumbling(s, "ts", "1 day", "0 seconds", "event_type"), True).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 2))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    from .. import streaming

    def first(s):
        keyed = s.withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
        return streaming.dedup(keyed, "key", "ts", "3650 days").select("user_id", "event_type")

    return _streamed(spark, d, first, False)


def _streamed(spark, d, transform, flush):
    """The result of a stream over the events table, read back from its sink. A closing event far in the future, which
    is left out of the result, moves the watermark past the last window."""
    import uuid

    from .. import streaming

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="gritmill-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(f"{root}/in")
    if flush:
        last = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"))
        last.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 100_000).parquet(f"{root}/in")
    streaming.drain(transform(stream), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").where("event_type <> 'closing'")
