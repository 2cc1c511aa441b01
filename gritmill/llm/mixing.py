"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Patterns hold token capacity: their
words once for the first copy, again for each further copy, at convex cost, so repeats are taken only where first copies
run out. Capacity flows from patterns to the quotas of their sources; successive shortest paths give the cheapest
largest flow. Sources that no pattern joins are solved apart, so the work grows with the overlap and not with the number
of sources. A pattern's flow becomes whole copies of all its documents plus one more of a seeded prefix of them; the
prefix is found from a histogram of hashed ids and a running sum over one bin of it, and is applied as a bound on
(hash, id), so texts are never shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, free_name, seeded

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
#: Words are what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_BINS = 4096


def quotas(sizes: dict, weights=WEIGHTS, share: float = SHARE, limit: float = MAX_COPIES) -> dict:
    """Targets by source. Sources by code point, null last, get the weights in turn and share ``share`` of all sizes; a
    target stops at ``limit`` times its source's size and the excess is shared again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not full:
            return out | {s: float(weight[s] * level) for s in free}
        for s in full:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def route(capacity: dict[tuple, int], quota: dict, copies: int = MAX_COPIES) -> dict[tuple, dict]:
    """The words that each pattern sends to each of its sources: a cheapest largest flow.

    ``capacity`` has a pattern's words (of one copy) by its tuple of sources. The c-th copy costs 2c-1 a word."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in capacity:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    parts = defaultdict(list)
    for p in capacity:
        if p:
            parts[find(p[0])].append(p)
    out: dict[tuple, dict] = {p: {} for p in capacity}
    for patterns in parts.values():
        for (p, s), n in _flow({p: capacity[p] for p in patterns}, quota, copies).items():
            out[p][s] = n
    return out


def _flow(capacity: dict[tuple, int], quota: dict, copies: int) -> dict:
    """Successive shortest paths (Dijkstra over reduced costs) from the root by patterns and sources to the sink."""
    to, left, cost, out = [], [], [], defaultdict(list)

    def arc(a, b, room, price):
        for x, y, r, c in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y), left.append(r), cost.append(c)

    route_arcs = {}
    names = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    for s in names:
        arc(("s", s), "sink", int(round(quota[s])), 0)
    for p in sorted(capacity, key=str):
        for c in range(1, copies + 1):
            arc("root", ("p", p), int(capacity[p]), 2 * c - 1)
        for s in p:
            route_arcs[p, s] = len(to)
            arc(("p", p), ("s", s), int(capacity[p]) * copies, 0)
    height = defaultdict(int)
    while True:
        best, via, heap, n = {"root": 0}, {}, [(0, 0, "root")], 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for i in out[x]:
                y, e = to[i], d + cost[i] + height[x] - height[to[i]]
                if left[i] > 0 and e < best.get(y, float("inf")):
                    best[y], via[y], n = e, i, n + 1
                    heapq.heappush(heap, (e, n, y))
        if "sink" not in best:
            return {k: left[i ^ 1] for k, i in route_arcs.items() if left[i ^ 1]}
        for x in best:
            height[x] += min(best[x], best["sink"])
        push, x = float("inf"), "sink"
        while x != "root":
            push, x = min(push, left[via[x]]), to[via[x] ^ 1]
        x = "sink"
        while x != "root":
            left[via[x]] -= push
            left[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    sources_col: str | None = None,
    seed: str = "mix",
    weights=WEIGHTS,
    share: float = SHARE,
    copies: int = MAX_COPIES,
    column: str = "__mix",
) -> DataFrame:
    """All rows of ``docs`` and their columns, with ``column``: a struct of size, source_size, target, copies, taken. An
    existing column of that name is replaced; all others stay as they are, whatever their names.

    A document belongs to the source in ``source_col``, or to all those in the array ``sources_col`` (repeats count
    once; null is a source of its own, an empty array none: nothing is taken of it). ``taken`` is copies x size, at most
    ``copies`` times the size. source_size (words of all members of a source) and target are those of source_col's. Rows of one id are taken together, those
    with a null id too. Null and empty texts have size 0. Runs agree, as only hashes of ids decide. Only one row per
    source and per pattern reaches the driver. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.col(source_col).cast("string")
    member: Column = F.array(own) if sources_col is None else F.coalesce(F.array_sort(F.array_distinct(F.col(sources_col))), F.array(own))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    helper = F.struct(own.alias("__own"), member.alias("__in"), seeded(F.col(id_col), seed).alias("__u"), key.alias("__id"), size.alias("__size"))
    held = free_name(docs, "helper")
    rows = docs.withColumn(held, helper)
    base = ws.cut(rows.select(f"{held}.*"), "sizes")

    capacity = {tuple(r[0]): int(r[1]) for r in base.groupBy("__in").agg(F.sum("__size")).collect()}
    sums: dict = {r[0]: 0 for r in base.select("__own").distinct().collect()}
    for p, words in capacity.items():  # a source's size is that of all documents that belong to it
        for s in p:
            sums[s] = sums.get(s, 0) + words
    target = quotas(sums, weights, share, copies)
    flow = route(capacity, target, copies)
    plan = []
    for p, words in capacity.items():
        total = sum(flow[p].values())
        whole = min(copies, total // words) if words else int(bool(p))
        plan.append((list(p), whole, int(total - whole * words) if words else 0))
    plan_df = ws.cut(spark.createDataFrame(plan, "`__in` array<string>, `__whole` int, `__more` long"), "plan")

    # where the prefix of each pattern ends: first by the histogram, then within one bin
    bins = ws.cut(base.groupBy("__in", F.shiftright("__u", 48).alias("__bin")).agg(F.sum("__size").alias("n")), "bins")
    by_bin = Window.partitionBy("__in").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.withColumn("upto", F.sum("n").over(by_bin)).join(plan_df, "__in").where("upto > __more")
    edge = ends.groupBy("__in").agg(F.min(F.struct("__bin", (F.col("upto") - F.col("n")).alias("before"), "__more")).alias("e"))
    edge = ws.cut(edge.select("__in", "e.*"), "edge")
    by_id = Window.partitionBy("__in").orderBy("__u", "__id")
    inside = base.withColumn("__bin", F.shiftright("__u", 48)).join(edge, ["__in", "__bin"])
    inside = inside.groupBy("__in", "__u", "__id", "before", "__more").agg(F.sum("__size").alias("n"))
    run = F.sum("n").over(by_id.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    near = inside.withColumn("upto", run).withColumn("start", F.col("upto") - F.col("n"))
    taken_in = near.where((F.col("upto") <= F.col("__more")) | ((F.col("start") <= F.col("__more")) & (F.col("upto") - F.col("__more") < F.col("__more") - F.col("start"))))
    last = taken_in.groupBy("__in").agg(F.max(F.struct("__u", "__id")).alias("last"))
    bound = plan_df.join(edge.select("__in", "__bin"), "__in", "left").join(last, "__in", "left")
    bound = ws.cut(
        bound.select(
            F.col("__in").alias("__pattern"), "__whole",
            F.when(F.col("__more") <= 0, F.lit(-1)).when(F.col("__bin").isNull(), F.lit(_BINS)).otherwise(F.col("__bin")).cast("long").alias("__edge"),
            F.coalesce("last.__u", F.lit(-1)).cast("long").alias("__last_u"), F.coalesce("last.__id", F.lit("")).alias("__last_id"),
        ),
        "bound",
    )
    totals = ws.cut(spark.createDataFrame([(s, int(n), float(target[s])) for s, n in sums.items()], "`__source` string, `__source_size` long, `__target` double"), "totals")

    m, ends, sums_ = F.col(held), free_name(rows, "bound"), free_name(rows, "totals")
    whole = lambda df, name: df.select(F.struct("*").alias(name))
    got = rows.join(whole(bound, ends), m["__in"].eqNullSafe(F.col(ends)["__pattern"])).join(whole(totals, sums_), m["__own"].eqNullSafe(F.col(sums_)["__source"]))
    e, t = F.col(ends), F.col(sums_)
    b = F.shiftright(m["__u"], 48)
    at_edge = (b == e["__edge"]) & ((m["__u"] < e["__last_u"]) | ((m["__u"] == e["__last_u"]) & (m["__id"] <= e["__last_id"])))
    n = F.least(e["__whole"] + ((b < e["__edge"]) | at_edge).cast("int"), F.lit(copies))
    struct = F.struct(m["__size"].alias("size"), t["__source_size"].alias("source_size"), t["__target"].alias("target"), n.alias("copies"), (n * m["__size"]).cast("long").alias("taken"))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()], struct.alias(column))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    held = free_name(docs, "mixed")
    out = mix(docs, **options, column=held)
    copy = free_name(out, "copy")
    n = F.col(held)["copies"]
    return out.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).drop(copy, held)
