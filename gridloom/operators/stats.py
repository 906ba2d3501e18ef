"""Statistics of objects, network edges and paired runs, by distributed aggregates and windows.

Percentiles are linear between order statistics, as numpy's. Windows without a partition would gather
everything in one task; cumulative shares therefore aggregate to distinct values first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cumulative(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """(v, w, upto): each distinct value, its weight and the weight of all values up to it.

    Values are dealt to ranges at approximate quantiles, found in one pass; a running sum within each range starts
    from the totals of the ranges before it, which are one row for each range.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = df.where(F.col(value).isNotNull())
    cuts = sorted(set(known.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), lambda x: x < F.col("v").cast("double")))
    g = known.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w")).withColumn("p", at)
    before = g.groupBy("p").agg(F.sum("w").alias("t")).select("p", (F.sum("t").over(Window.orderBy("p")) - F.col("t")).alias("before"))
    w = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return g.join(F.broadcast(before), "p").select("v", "w", (F.sum("w").over(w) + F.col("before")).alias("upto"))


def ecdf(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """(v, share): share of weight (rows, if not given) at each distinct value or below."""
    c = _cumulative(df, value, F.lit(1) if weight is None else weight)
    return c.crossJoin(F.broadcast(c.agg(F.max("upto").alias("total")))).select("v", (F.col("upto") / F.col("total")).alias("share"))


def ecdf_on(df: DataFrame, value: str, grid: DataFrame) -> DataFrame:
    """(x, share): share of rows at each grid point or below. The grid is a list of points, held in one row.

    A value counts in the bin of the first point not below it; the bins are then added up.
    """
    points = grid.agg(F.sort_array(F.collect_set("x")).alias("xs"))
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).crossJoin(F.broadcast(points))
    bins = known.groupBy(F.size(F.filter("xs", lambda x: x < F.col("v"))).alias("i")).agg(F.count("*").alias("k"))
    up = points.select(F.posexplode("xs").alias("i", "x")).join(bins, "i", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    n = bins.agg(F.sum("k").alias("n"))
    return up.withColumn("k", F.sum("k").over(Window.orderBy("i"))).crossJoin(F.broadcast(n)).select("x", (F.col("k") / F.col("n")).alias("share"))


def weighted_stats(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(n, weight, mean, std, min, max): weighted mean and population deviation."""
    v, w = F.col(value), F.col(weight)
    return df.where(v.isNotNull() & (w > 0)).agg(
        F.count("*").alias("n"), F.sum(w).alias("weight"), (F.sum(v * w) / F.sum(w)).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * w) / F.sum(w) - (F.sum(v * w) / F.sum(w)) * (F.sum(v * w) / F.sum(w)))).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def weighted_percentiles(df: DataFrame, value: str, weight: str, percents: list[float]) -> DataFrame:
    """(p, v): a value stands at the middle of its weight; linear in between, flat beyond the ends.

    Equal values count as one of their joint weight.
    """
    c = _cumulative(df.where(F.col(weight) > 0), value, F.col(weight))
    c = c.crossJoin(F.broadcast(c.agg(F.max("upto").alias("total")))).select("v", ((F.col("upto") - F.col("w") / 2) / F.col("total")).alias("at"))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p")
    j = c.select("v", "at", ps).withColumn("q", F.col("p") / 100)
    low = F.max(F.when(F.col("at") <= F.col("q"), F.struct("at", "v")))
    high = F.min(F.when(F.col("at") >= F.col("q"), F.struct("at", "v")))
    e = j.groupBy("p").agg(low.alias("a"), high.alias("b"), F.first("q").alias("q"))
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.when(F.col("b.at") > F.col("a.at"), (F.col("q") - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))).otherwise(0.0)
    return e.select("p", F.coalesce(between, "b.v", "a.v").alias("v"))


def percentiles(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """(p, v), exact and linear between order statistics, which are found from cumulative counts."""
    c = _cumulative(df, value, F.lit(1))
    n = c.agg(F.max("upto").alias("n"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p")
    j = n.select("n", asked).withColumn("h", (F.col("n") - 1) * F.col("p") / 100).select("p", "h", F.floor("h").alias("i"))
    hits = c.crossJoin(F.broadcast(j)).where("upto > i and upto - w <= i + 1")  # a row for each percent
    lo = F.max(F.when((F.col("upto") - F.col("w") <= F.col("i")) & (F.col("upto") > F.col("i")), F.col("v")))
    hi = F.max(F.when((F.col("upto") - F.col("w") <= F.col("i") + 1) & (F.col("upto") > F.col("i") + 1), F.col("v")))
    e = hits.groupBy("p").agg(lo.alias("a"), hi.alias("b"), F.first("h").alias("h"), F.first("i").alias("i"))
    return e.select("p", (F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("h") - F.col("i"))).alias("v"))


def moments(df: DataFrame, value: str) -> DataFrame:
    """(n, sum, mean, std, skew, kurt): population deviation, bias-corrected skewness and excess kurtosis."""
    v = F.col(value)
    a = df.where(v.isNotNull()).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    n = F.col("n")
    return a.select(
        "n", "sum", "mean", "std", F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurt"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n, density) of fixed-width bins; the last is closed, values outside are left out."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) * bins / (hi - lo)).cast("int"))
    g = df.where(F.col(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    t = g.agg(F.sum("n").alias("total"))
    return every.join(g, "bin", "left").crossJoin(F.broadcast(t)).select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total") / ((hi - lo) / bins)).alias("density"))


def quantile_bins(df: DataFrame, value: str, parts: int) -> DataFrame:
    """df plus `bin`: 0 up to parts - 1 by quantile edges, (a, b] but for the first, equal edges taken as one."""
    edges = percentiles(df, value, [100 * i / parts for i in range(parts + 1)]).agg(F.sort_array(F.collect_set("v")).alias("e"))
    e = df.crossJoin(F.broadcast(edges))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    return e.withColumn("bin", F.size(F.filter(inner, lambda x: x < F.col(value)))).drop("e")


def shares(df: DataFrame, cases: list[tuple[str, Column]]) -> DataFrame:
    """(name, percent) of rows that meet each condition, of those with one known."""
    a = df.agg(*[(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100).alias(n) for n, c in cases])
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("percent")) for n, _ in cases])).alias("z")).select("z.*")


def ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df plus the mean rank of its value, from 1."""
    c = _cumulative(df, value, F.lit(1)).select(F.col("v").alias("__v"), (F.col("upto") - (F.col("w") - 1) / 2).alias(name))
    return df.join(c, F.col(value) == F.col("__v")).drop("__v")


def paired_error(a: DataFrame, b: DataFrame, key: str, weight: str) -> DataFrame:
    """Errors of b against a over keys in both with positive finite values: a (key, v, weight), b (key, v)."""
    j = a.withColumnRenamed("v", "x").join(b.select(key, F.col("v").alias("y")), key)
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) > 0)
    j = j.where(ok("x") & ok("y"))
    d, w = F.col("y") - F.col("x"), F.col(weight)
    return j.agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.sqrt(F.avg(d * d)) / F.avg("x")).alias("nrmse"), (F.avg(d) / F.avg("x") * 100).alias("rel"),
        (F.sum(F.abs(d) * w) / F.sum(w)).alias("wmae"), F.sqrt(F.sum(d * d * w) / F.sum(w)).alias("wrmse"),
        F.corr("x", "y").alias("pearson"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.sum(F.when(d > 0, 1).otherwise(0)).alias("above"), F.sum(F.when(d < 0, 1).otherwise(0)).alias("below"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, spearman), with mean ranks for ties."""
    r = ranks(ranks(df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "rx"), y, "ry")
    return r.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def _two(df: DataFrame, value: str, side: Column) -> DataFrame:
    return df.where(F.col(value).isNotNull() & side.isNotNull()).select(F.col(value).alias("v"), side.cast("boolean").alias("s"))


def ks_statistic(df: DataFrame, value: str, side: Column) -> DataFrame:
    """(n1, n2, d): largest distance of the two sides' empirical distributions."""
    t = _two(df, value, side)
    n = t.agg(F.sum(F.col("s").cast("long")).alias("n1"), F.sum((~F.col("s")).cast("long")).alias("n2"))
    one = lambda c: _cumulative(t, "v", c.cast("long")).select("v", "upto")
    j = one(F.col("s")).withColumnRenamed("upto", "a").join(one(~F.col("s")).withColumnRenamed("upto", "b"), "v").crossJoin(F.broadcast(n))
    return j.agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(F.abs(F.col("a") / F.col("n1") - F.col("b") / F.col("n2"))).alias("d"))


def mann_whitney(df: DataFrame, value: str, side: Column) -> DataFrame:
    """(n1, n2, u) of the side where the condition holds."""
    r = ranks(_two(df, value, side), "v", "rk").groupBy("s").agg(F.count("*").alias("n"), F.sum("rk").alias("t"))
    a = r.agg(*[F.max(F.when(F.col("s") if k == 1 else ~F.col("s"), F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("n", "t")])
    return a.select("n1", "n2", (F.col("t1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def welch(df: DataFrame, value: str, side: Column) -> DataFrame:
    """(t, dof, cohen_d) of the two sides' means."""
    g = _two(df, value, side).groupBy("s").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("q"))
    a = g.agg(*[F.max(F.when(F.col("s") if k == 1 else ~F.col("s"), F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("n", "m", "q")])
    e1, e2 = F.col("q1") / F.col("n1"), F.col("q2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("q1") + (F.col("n2") - 1) * F.col("q2")) / (F.col("n1") + F.col("n2") - 2))
    return a.select(
        ((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("t"),
        ((e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))).alias("dof"), ((F.col("m1") - F.col("m2")) / pooled).alias("cohen_d"))


def by_building(faces: DataFrame) -> DataFrame:
    """(building_id, mean_v, face_count): mean over a building's vertical faces, or over all if it has none.

    faces: (building_id, v, vertical); building 0 and null values are left out.
    """
    f = faces.where("building_id <> 0 and v is not null and not isnan(v)")
    g = f.groupBy("building_id").agg(F.avg(F.when(F.col("vertical"), F.col("v"))).alias("a"), F.avg("v").alias("b"),
                                     F.count(F.when(F.col("vertical"), 1)).alias("n"), F.count("*").alias("m"))
    return g.select("building_id", F.coalesce("a", "b").alias("mean_v"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("m")).alias("face_count"))


def backfill(values: DataFrame, core: DataFrame) -> DataFrame:
    """Values of the ids in core, and 0 for those of them without any: (building_id, mean_v, face_count)."""
    return core.select("building_id").distinct().join(values, "building_id", "left").select(
        "building_id", F.coalesce("mean_v", F.lit(0.0)).alias("mean_v"), F.coalesce("face_count", F.lit(0)).alias("face_count"))


def ends_union(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k largest and the k smallest rows by value, then key; a row may come twice."""
    return df.orderBy(F.desc(value), key).limit(k).unionByName(df.orderBy(F.asc(value), key).limit(k))


def edge_means(edges: DataFrame, grid: DataFrame, samples: int) -> DataFrame:
    """(edge_id, v): mean of grid values (r, c, v) at points along each edge (edge_id, r0, c0, r1, c1 in cells)."""
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / float(max(1, samples - 1))).cast("int")
    p = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("edge_id", at("r0", "r1").alias("r"), at("c0", "c1").alias("c"))
    return p.join(grid, ["r", "c"]).groupBy("edge_id").agg(F.avg("v").alias("v"))


def keep_best(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of rows with equal keys the one of greatest value, of equal ones the first by `order`; nulls come last."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grid_summary(grid: DataFrame, value: str) -> DataFrame:
    """(cells, valid, share, mean, low, high) of a grid; null and NaN cells count as cells only."""
    v = F.when(~F.isnan(value), F.col(value))
    return grid.agg(F.count("*").alias("cells"), F.count(v).alias("valid"), (F.count(v) / F.count("*")).alias("share"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def pooled_bins(df: DataFrame, value: str, run: str, parts: int = 4) -> DataFrame:
    """(run, bin, n): each run's rows by quantile bins of all runs' values together."""
    return quantile_bins(df.select(run, value), value, parts).groupBy(run, "bin").agg(F.count("*").alias("n"))
