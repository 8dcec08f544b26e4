"""Aggregations.

Algebraic statistics (mean, sums, std, var, corr, covar, skewness, counts) are
Spark's partial/final hash aggregates. Order statistics are the part that does
not scale when written naively: Spark's exact ``percentile``/``median`` and
``mode`` keep every distinct value of a group in one task's buffer. Here they
are computed from per-(group, value) counts (a partial aggregate that shrinks
before the shuffle) and a range-partitioned running count (``prefix_sums``), so one hot
group is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscope.functions.scalars import as_num, as_time, col, time_diff
from rowscope.plans.ordering import prefix_sums

# Aggregation names accepted by group_by_aggregate (pandas names
# plus the avg/variance/percentile spellings).
AGG_NAMES = ["mean", "avg", "sum", "count", "min", "max", "std", "var", "variance",
             "median", "nunique", "size", "first", "last", "prod", "sem", "skew",
             "quantile", "percentile"]
_ORDER_STATS = {"median", "quantile", "percentile"}


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    if isinstance(x, str) and "," in x:
        return [s.strip() for s in x.split(",") if s.strip()]
    return [x]


def _algebraic(name: str, c: Column, order_by: Column | None) -> Column:
    if name in ("mean", "avg"):
        return F.avg(c)
    if name == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if name == "count":
        return F.count(c)
    if name == "min":
        return F.min(c)
    if name == "max":
        return F.max(c)
    if name == "std":
        return F.stddev_samp(c)
    if name in ("var", "variance"):
        return F.var_samp(c)
    if name == "nunique":
        return F.count_distinct(c)
    if name == "size":
        return F.count(F.lit(1))
    if name == "prod":
        return F.coalesce(F.product(c), F.lit(1.0))
    if name == "sem":
        return F.stddev_samp(c) / F.sqrt(F.count(c))
    if name == "skew":
        n = F.count(c)
        return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
    if name in ("first", "last"):
        if order_by is None:
            raise ValueError(f"agg '{name}' needs order_by: rows have no implicit order")
        key = F.when(c.isNotNull(), order_by)
        return F.min_by(c, key) if name == "first" else F.max_by(c, key)
    raise ValueError(f"unsupported agg {name!r}; expected one of {AGG_NAMES}")


def percentiles(df: DataFrame, column: str | Column, qs: Sequence[float],
                group: Sequence[str] = (), names: Sequence[str] | None = None,
                partitions: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (numpy/pandas default, DuckDB
    ``quantile_cont``), distributed: value counts → running count → the one or two
    values around rank ``(n-1)q`` per group.

    Returns one row per group with one column per q (``names`` or ``p{q*100}``).
    """
    group = list(group)
    names = list(names or [f"p{round(q * 100, 6):g}" for q in qs])
    c = col(column) if isinstance(column, str) else column
    v = df.select(*[col(g) for g in group], c.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for g in group:
        v = v.where(F.col(g).isNotNull())
    counts = v.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # the one or two distinct values around rank (n-1)q: the value whose running
    # count interval [cum - c, cum - 1] holds the rank
    j = prefix_sums(counts, "_v", ["_c"], group, partitions=partitions, total_prefix="_n")
    n = F.col("_n_c")
    lo_edge = F.col("cum__c") - F.col("_c")
    hi_edge = F.col("cum__c") - 1
    aggs = []
    for i, q in enumerate(qs):
        pos = (n - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((lo_edge <= lo) & (hi_edge >= lo), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when((lo_edge <= hi) & (hi_edge >= hi), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(pos).alias(f"_pos{i}")]
    piv = j.groupBy(*group).agg(*aggs)
    res = piv.select(*group, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (F.col(f"_pos{i}") - F.floor(f"_pos{i}")))
        .alias(nm) for i, nm in enumerate(names)])
    return res


def group_by_aggregate(df: DataFrame, group_column, target, agg="mean",
                       order_by: str | None = None, q: float = 0.5) -> DataFrame:
    """A1-A3: ``groupBy(group).agg``; NULL group keys are dropped (pandas default).

    Output names: one target and one agg → the target name; several targets →
    target names; several aggs on one target → agg names; several of both →
    ``{target}_{agg}``.
    """
    groups = _as_list(group_column)
    targets = _as_list(target)
    aggs = [str(a).lower() for a in _as_list(agg)] or ["mean"]
    if not groups or not targets:
        raise ValueError("group_by_aggregate needs group_column and a target")
    base = df
    for g in groups:
        base = base.where(col(g).isNotNull())
    ob = col(order_by) if order_by else None

    def name(t, a):
        if len(aggs) == 1:
            return t
        if len(targets) == 1:
            return a
        return f"{t}_{a}"

    plain = [(t, a) for t in targets for a in aggs if a not in _ORDER_STATS]
    order = [(t, a) for t in targets for a in aggs if a in _ORDER_STATS]
    out = None
    if plain:
        out = base.groupBy(*[col(g) for g in groups]).agg(
            *[_algebraic(a, col(t), ob).alias(name(t, a)) for t, a in plain])
    for t in dict.fromkeys(t for t, _ in order):
        names = [name(t, a) for tt, a in order if tt == t]
        p = percentiles(base, t, [q] * len(names), groups, names=names)
        out = p if out is None else out.join(p, groups, "full")
    cols = [name(t, a) for t in targets for a in aggs]
    return out.select(*groups, *cols)


def _one(df: DataFrame, c: Column, alias: str) -> DataFrame:
    return df.agg(c.alias(alias))


def calculate_average(df: DataFrame, column: str, unit: str = "seconds") -> DataFrame:
    """A4/A5: mean of a coerced column, or of ``A - B`` time differences."""
    if " - " in column:
        a, b = [s.strip() for s in column.split("-", 1)]
        return _one(df, F.avg(time_diff(as_time(df, a), as_time(df, b), unit)), "mean")
    return _one(df, F.avg(as_num(df, column)), "mean")


def calculate_median(df: DataFrame, column: str) -> DataFrame:
    """Exact median (distributed order statistic)."""
    return percentiles(df, as_num(df, column), [0.5], names=["median"])


def calculate_mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent non-missing value, the smallest among ties; empty → NULL.

    Counts per value shrink map-side; the final pick is an ordered ``min_by``.
    """
    c = col(column)
    counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.agg(F.min_by("_v", F.struct((-F.col("_c")).alias("nc"), F.col("_v").alias("v")))
                      .alias("mode"))


def calculate_sum(df, column):
    """All-missing → 0."""
    return _one(df, F.coalesce(F.sum(as_num(df, column)), F.lit(0.0)), "sum")


def calculate_min(df, column):
    return _one(df, F.min(as_num(df, column)), "min")


def calculate_max(df, column):
    return _one(df, F.max(as_num(df, column)), "max")


def calculate_std(df, column):
    return _one(df, F.stddev_samp(as_num(df, column)), "std")


def calculate_variance(df, column):
    return _one(df, F.var_samp(as_num(df, column)), "variance")


def calculate_percentile(df: DataFrame, column: str, percentile: float = 90,
                         group_by: str | None = None) -> DataFrame:
    """Percentile in percent (0 is honoured), grouped → ``p{q}_{col}``."""
    q = float(percentile)
    name = f"p{int(q)}_{column}"
    if group_by:
        return percentiles(df, col(column), [q / 100], [group_by], names=[name])
    return percentiles(df, as_num(df, column), [q / 100], names=[name])


def calculate_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson over pairwise-complete rows; fewer than 2 rows or a constant
    column → NULL (the reference returns a (nan, message) tuple)."""
    a, b = as_num(df, x), as_num(df, y)
    d = df.select(a.alias("_x"), b.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    ok = (F.count(F.lit(1)) >= 2) & (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    return d.agg(F.when(ok, F.corr("_x", "_y")).alias("correlation"))


def calculate_covariance(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sample covariance over pairwise-complete rows."""
    d = df.select(as_num(df, x).alias("_x"), as_num(df, y).alias("_y"))
    return d.agg(F.covar_samp("_x", "_y").alias("covariance"))


def count_rows(df: DataFrame) -> DataFrame:
    """A16."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def failure_rate(df: DataFrame, group_column: str, status_column: str = "Job_Status",
                 bad_value: str = "Failed") -> DataFrame:
    """failed/total per group in one pass; 0 when a group has no failure."""
    g = col(group_column)
    return (df.where(g.isNotNull()).groupBy(g)
            .agg((F.count_if(col(status_column) == bad_value) / F.count(F.lit(1))).alias("failure_rate")))


def group_mean_desc(df: DataFrame, group_column: str = "Machine_ID",
                    metric: str = "Energy_Consumption") -> DataFrame:
    """Per-group mean sorted descending (the data behind the bar chart)."""
    g = col(group_column)
    return (df.where(g.isNotNull()).groupBy(g).agg(F.avg(col(metric)).alias(f"avg_{metric}"))
            .orderBy(F.desc_nulls_last(f"avg_{metric}"), g))


def grouped_pair_stat(df: DataFrame, group_column: str, x: str, y: str, stat: str = "corr",
                      keep_all: bool = False) -> DataFrame:
    """Per-group Pearson correlation (``corr``) or sample covariance (``cov``) of
    two coerced columns; ``keep_all`` attaches the group value to every row with a
    window aggregate (no join back)."""
    from pyspark.sql import Window
    a, b = as_num(df, x), as_num(df, y)
    ok = a.isNotNull() & b.isNotNull()
    fn = F.corr if stat.startswith("corr") else F.covar_samp
    name = f"{stat[:3]}_{x}"
    g = col(group_column)
    if keep_all:
        return df.withColumn(name, F.when(g.isNotNull(), fn(F.when(ok, a), F.when(ok, b)).over(Window.partitionBy(g))))
    return df.where(g.isNotNull()).groupBy(g).agg(fn(F.when(ok, a), F.when(ok, b)).alias(name))
