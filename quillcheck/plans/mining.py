"""Queries on mined rules, series and task graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graph, mine, series
from .registry import Tables, query

_CASES = """
cases AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS held, o_totalprice AS total, net, qty, worst, n_lines FROM orders LEFT JOIN
  (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS net, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS qty, max(l_discount) AS worst, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _cases(t: Tables) -> DataFrame:
    """Orders as labelled cases: held if their status is F."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        money("l_extendedprice").alias("net"), money("l_quantity").alias("qty"), F.max("l_discount").alias("worst"), F.count("*").alias("n_lines")
    )
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("held"), F.col("o_totalprice").alias("total"), "net", "qty", "worst", "n_lines")


GRID = (0.0, 0.01, 0.05, 0.1, 0.5, 1.0)
CANDIDATES = {
    **{f"total_le_net@{t}": f"total > net * {1 + t}" for t in GRID},
    **{f"net_le_total@{t}": f"net > total * {1 + t}" for t in GRID},
    "few_lines": "n_lines > 6",
    "small_discount": "worst > 0.09",
    "quantity_cap": "qty > 200",
}
_TALLY = "WITH " + _CASES + ", t AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (WHERE ({e}) IS NOT NULL) AS n, count(*) FILTER (WHERE ({e}) IS NOT NULL AND held) AS holds, count(*) FILTER (WHERE {e}) AS k,"
    f" count(*) FILTER (WHERE ({e}) AND held) AS k_holds, count(*) FILTER (WHERE ({e}) AND NOT held) AS k_approved FROM cases"
    for name, e in CANDIDATES.items()
) + ")"


def _tallies(t: Tables) -> DataFrame:
    return mine.tally(_cases(t), F.col("held"), {name: F.expr(e) for name, e in CANDIDATES.items()})


@query(_TALLY + " SELECT * FROM t")
def mine_tally(t: Tables) -> DataFrame:
    """How each candidate rule does on the labelled cases."""
    return _tallies(t)


@query(
    _TALLY
    + """ SELECT split_part(rule, '@', 1) AS family, min(split_part(rule, '@', 2)::DOUBLE) FILTER (WHERE k_approved <= floor(0.25 * (n - holds))) AS t,
  min_by(k_holds, split_part(rule, '@', 2)::DOUBLE) FILTER (WHERE k_approved <= floor(0.25 * (n - holds))) AS k_holds FROM t WHERE contains(rule, '@') GROUP BY 1"""
)
def mine_tolerance(t: Tables) -> DataFrame:
    """The smallest consistent tolerance of each family in a grid, all tallied at once."""
    rows = _tallies(t).where(F.col("rule").contains("@"))
    return mine.learned_tolerance(rows, F.split_part("rule", F.lit("@"), F.lit(1)), F.split_part("rule", F.lit("@"), F.lit(2)).cast("double"), 0.25)


@query(
    "WITH " + _CASES + """, v AS (SELECT total AS x, count(*) FILTER (WHERE held) AS h, count(*) FILTER (WHERE NOT held) AS a FROM cases WHERE total IS NOT NULL GROUP BY 1),
c AS (SELECT x, sum(h) OVER w AS bh, sum(a) OVER w AS ba, sum(a) OVER () AS ta, lead(x) OVER (ORDER BY x) AS nx FROM v WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
SELECT (x + nx) / 2 AS cut, (bh + ta - ba)::BIGINT AS errors, (ta - ba)::BIGINT AS approved_above FROM c WHERE nx IS NOT NULL AND ta - ba <= floor(0.3 * ta) ORDER BY bh + ta - ba, ta - ba, x LIMIT 1"""
)
def mine_cut(t: Tables) -> DataFrame:
    """The learned cut on order totals."""
    return mine.learned_cut(_cases(t), "total", F.col("held"), 0.3)


@query(
    _TALLY
    + """ SELECT rule, k, k_holds, CASE WHEN k = 0 THEN 'VOID' WHEN k_holds::DOUBLE / k <= holds::DOUBLE / n THEN 'BASE_RATE' ELSE 'GROUNDED' END AS judgement,
  list_reduce(list_concat([1.0::DOUBLE], list_transform(range(least(k_holds, 5)), lambda i: (holds - i)::DOUBLE / (n - i))), lambda a, b: a * b)::DOUBLE AS chance_first_five FROM t"""
)
def mine_grounding(t: Tables) -> DataFrame:
    """Judgement on each candidate and the chance that five violators (or as many as held) would all be held at random."""
    share = F.col("k_holds") / F.col("k")
    judged = F.when(F.col("k") == 0, "VOID").when(share <= F.col("holds") / F.col("n"), "BASE_RATE").otherwise("GROUNDED")
    chance = stats.all_hold(F.col("n"), F.col("holds"), F.least("k_holds", F.lit(5)))
    return _tallies(t).select("rule", "k", "k_holds", judged.alias("judgement"), chance.alias("chance_first_five"))


@query(
    "WITH " + _CASES + """, r AS (SELECT held, total / nullif(net, 0) AS x, row_number() OVER (PARTITION BY held ORDER BY total / nullif(net, 0) DESC NULLS LAST) AS n, count(total / nullif(net, 0)) OVER (PARTITION BY held) AS c FROM cases),
k AS (SELECT max(x) FILTER (WHERE NOT held AND n = floor(0.25 * c) + 1) AS low FROM r)
SELECT low AS supported_from, (SELECT min(x) FROM r WHERE held AND x > low) AS first_hold FROM k"""
)
def mine_supported_interval(t: Tables) -> DataFrame:
    """The ratio of total to net that at most a quarter of approved cases pass, and the first held case above it."""
    ratio = F.col("total") / F.nullif("net", F.lit(0.0))
    rows = _cases(t).select("held", ratio.alias("x")).where("x is not null")
    low = mine.kth_largest(rows.where("not held"), "x", 0.25)
    above = rows.where("held").where(F.col("x") > F.lit(low))
    return above.agg(F.lit(low).cast("double").alias("supported_from"), F.min("x").alias("first_hold"))


@query()
def mine_cover(t: Tables) -> DataFrame:
    """Grounded rules that explain held cases no stronger rule does; a greedy cover is not SQL's, so tests hold it
    against a plain one. Cases are counted by the set of rules they violate."""
    flags = F.concat(*[F.when(F.expr(e), "1").otherwise("0") for e in CANDIDATES.values()])
    patterns = _cases(t).where("held").groupBy(flags.alias("flags")).agg(F.count("*").alias("cases"))
    found = mine.cover(patterns, [(name, n) for n, name in enumerate(CANDIDATES)])
    return t.spark.createDataFrame(found, "rule string, n_holds long, n_new long")


@query(
    """WITH RECURSIVE p AS (SELECT l_suppkey AS key, l_orderkey AS o, l_linenumber, l_partkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS n FROM lineitem),
f AS (SELECT key, n, v AS s, 1 AS used, false AS stop FROM p WHERE n = 1
  UNION ALL SELECT p.key, p.n, CASE WHEN NOT f.stop AND abs(p.v - f.s / f.used) <= 0.5 * abs(f.s / f.used) THEN f.s + p.v ELSE f.s END, CASE WHEN NOT f.stop AND abs(p.v - f.s / f.used) <= 0.5 * abs(f.s / f.used) THEN f.used + 1 ELSE f.used END,
    f.stop OR abs(p.v - f.s / f.used) > 0.5 * abs(f.s / f.used) FROM f JOIN p ON p.key = f.key AND p.n = f.n + 1)
SELECT key, CASE WHEN used >= 3 THEN s / used END AS flat, used AS n_used FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS z FROM f) WHERE z = 1"""
)
def flat_prices(t: Tables) -> DataFrame:
    """Each supplier's flat price: the mean over its last lines while they stay within half of it."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("p")).alias("o")
    rows = t.lineitem.select(F.col("l_suppkey").alias("key"), order, F.col("l_extendedprice").alias("v"))
    return series.flat_value(rows, ["key"], "o", "v", 0.5)


@query(
    """WITH s AS (SELECT l_suppkey AS key, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, var_pop(l_quantity) AS vx, var_pop(l_extendedprice / 1000) AS vy, covar_pop(l_quantity, l_extendedprice / 1000) AS c FROM lineitem GROUP BY 1),
r AS (SELECT *, sqrt(pow(vy - vx, 2) + 4 * pow(c, 2)) AS root FROM s), f AS (SELECT *, CASE WHEN c <> 0 THEN (vy - vx + root) / (2 * c) END AS slope FROM r)
SELECT key, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(sqrt(greatest((vx + vy - root) / 2, 0)), 6) AS rms, n FROM f"""
)
def orthogonal_fits(t: Tables) -> DataFrame:
    """The orthogonal line of price on quantity for each supplier."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = series.orthogonal_fit(rows, "key", "x", "y")
    return fit.select("key", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "rms")], "n")


@query()
def relation_fits(t: Tables) -> DataFrame:
    """The fitted scale of a saturating relation for each supplier; iterated, so tests fit made points of known scale."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + F.col("l_extendedprice") / 10_000).alias("y"))
    return series.relation_fit(rows, "key", "x", "y")


@query(
    """WITH RECURSIVE p AS (SELECT n_nationkey + 100 AS child, n_regionkey + 1000 AS parent FROM nation UNION ALL SELECT r_regionkey + 1000, 2000 FROM region UNION ALL SELECT c_custkey + 10000, c_nationkey + 100 FROM customer),
u AS (SELECT c_custkey + 10000 AS node, c_custkey AS leaf, (c_acctbal > 0)::INT AS own FROM customer UNION ALL SELECT p.parent, u.leaf, u.own FROM u JOIN p ON p.child = u.node)
SELECT node AS id, sum(own)::BIGINT AS done, count(*) AS total, CASE WHEN sum(own) = count(*) THEN 'DONE' WHEN sum(own) > 0 THEN 'PARTLY' ELSE 'OPEN' END AS state FROM u GROUP BY node"""
)
def task_states(t: Tables) -> DataFrame:
    """States rolled up a tree: customers with a balance are done, under their nations, regions and the world."""
    leaf = (F.col("c_custkey") + 10_000).alias("id")
    nodes = t.customer.select(leaf, (F.col("c_acctbal") > 0).alias("own"))
    long = lambda c: F.col(c).cast("long")
    parents = (
        t.nation.select((long("n_nationkey") + 100).alias("child"), (long("n_regionkey") + 1000).alias("parent"))
        .union(t.region.select(long("r_regionkey") + 1000, F.lit(2000).cast("long")))
        .union(t.customer.select(F.col("c_custkey") + 10_000, long("c_nationkey") + 100))
    )
    return graph.roll_up(nodes, parents)
