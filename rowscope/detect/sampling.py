"""Seeded per-tree samples without any global order (pattern shared by INNE and
the isolation forest), in O(n + T·ψ).

Every row makes one draw of 62 bits. Read against the binomial distribution of T trials
with share ``q = (ψ + 6√ψ + 20) / n`` (at most 1), it gives the number of trees of which
the row is a candidate: none for almost every row when n is large, so a row costs a few
integer operations whatever T is. Only candidates go on to name their trees: an affine
walk over a prime P ≥ T with a start and a stride of the row's own, of which the first
trees below T are taken. Rows are independent of each other; every tree has each row with
share q, two trees independently. A tree has a little over ψ candidates (fewer than ψ
with a chance below 10⁻⁸; then they are its sample), and the ψ of smallest pair hash are
its sample: about T·ψ narrow rows are made, and ``row_number() <= ψ`` lets Spark cut them
before the shuffle (``WindowGroupLimit``; the session allows it for any ψ used here).

All hashes are arithmetic modulo 2³¹ − 1 over both halves of the row id (remainder and
quotient), which SQL computes too; no two row ids share them systematically.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscope.session import shuffle_partitions

#: Fixed value: a prime modulus whose squares fit a 64-bit integer.
MODULUS = 2147483647


def _salt(tag: str | None, use: int) -> int:
    return zlib.crc32(f"{tag or ''}#{use}".encode()) % MODULUS


def _mixed(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows with the mixed value of each expression. Every step is a projection of its own, so that no
    expression is written out several times in the generated code."""
    m, kept, names = F.lit(MODULUS), rows.columns, list(values)
    rows = rows.select(*kept, *[(v % m).alias(k) for k, v in values.items()])
    rows = rows.select(*kept, *names, *[(F.col(k) * F.col(k) % m).alias(f"{k}_2") for k in names])
    rows = rows.select(*kept, *[((F.col(f"{k}_2") * 16807 + F.col(k) * 39373 + 12345) % m).alias(k) for k in names])
    rows = rows.select(*kept, *names, *[(F.col(k) * F.col(k) % m).alias(f"{k}_2") for k in names])
    return rows.select(*kept, *[((F.col(f"{k}_2") * 48271 + F.col(k)) % m).alias(k) for k in names])


def _with_halves(rows: DataFrame) -> DataFrame:
    """row_id, low, high: remainder and quotient of the id by the modulus."""
    return rows.select("row_id", F.pmod(F.col("row_id").cast("long"), F.lit(MODULUS)).alias("low")).withColumn(
        "high", F.expr(f"pmod((cast(row_id as bigint) - low) div {MODULUS}, {MODULUS})"))


def _with_hashes(rows: DataFrame, uses: dict[str, int], tag: str | None, tree: Column) -> DataFrame:
    """Rows with a hash of (row id, tree) in 0..MODULUS-1 for every use."""
    rows = _mixed(rows, {k: F.col("low") * 48271 + F.col("high") * 40692 + F.lit(_salt(tag, use)) for k, use in uses.items()})
    kept = [c for c in rows.columns if c not in uses]
    again = _mixed(rows, {f"{k}_m": F.col(k) + F.col("high") * 39373 + tree.cast("long") * 69621 for k in uses})
    return again.select(*kept, *[F.col(f"{k}_m").alias(k) for k in uses])


def _share(psi: int, n: int) -> float:
    return min(1.0, (psi + 6.0 * math.sqrt(psi) + 20.0) / max(n, 1))


def _prime(at_least: int) -> int:
    p = max(2, at_least)
    while any(p % d == 0 for d in range(2, math.isqrt(p) + 1)):
        p += 1
    return p


def _binomial(trials: int, share: float) -> list[float]:
    """P(at most i of the trials) for i = 0..trials - 1."""
    out, total = [], 0.0
    for i in range(trials):
        total += math.exp(math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1)
                          + i * math.log(share) + (trials - i) * math.log1p(-share))
        out.append(total)
    return out


def tree_samples(fm: DataFrame, n_trees: int, psi: int, n: int | None = None,
                 tag: str | None = None) -> tuple[DataFrame, int]:
    """``(tree, rank, row_id, x)`` — ψ rows per tree (ψ clipped to n). Returns the
    samples and the effective ψ. ``tag`` salts the hash so that two ensembles over
    the same rows draw independent samples."""
    n = n if n is not None else fm.count()
    psi = int(min(psi, n))
    share, prime = _share(psi, n), _prime(n_trees)
    rows = _with_hashes(_with_halves(fm), {"high_bits": 1, "low_bits": 2}, tag, F.lit(0))
    trees = F.lit(n_trees)
    if share < 1.0:
        below = _binomial(n_trees, share)
        draw = (F.col("high_bits").cast("double") + F.col("low_bits").cast("double") / F.lit(float(MODULUS))) / F.lit(float(MODULUS))
        rows = rows.withColumn("u", draw)
        trees = F.when(F.col("u") >= F.lit(below[0]), F.size(F.filter(F.array(*[F.lit(c) for c in below]), lambda c: c <= F.col("u"))))
    walk = _with_hashes(rows.select("row_id", "low", "high", trees.alias("trees")), {"start": 3, "stride": 4}, tag, F.lit(0))
    steps = F.transform(F.sequence(F.lit(0), F.lit(prime - 1)),
                        lambda i: (F.col("start") % prime + i * (F.col("stride") % (prime - 1) + 1)) % prime)
    named = F.slice(F.filter(steps, lambda t: t < n_trees), F.lit(1), F.col("trees"))
    # a row without trees has none to explode; a filter would be pushed under the hashes and write them out again
    pairs = walk.select("row_id", "low", "high", F.explode(F.when(F.col("trees").isNotNull(), named.cast("array<int>"))).alias("tree"))
    pairs = _with_hashes(pairs, {"h": 0}, tag, F.col("tree"))
    w = Window.partitionBy("tree").orderBy("h", "row_id")
    keep = pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= psi).select(
        "tree", (F.col("rn") - 1).alias("rank"), "row_id")
    samples = keep.join(fm.select("row_id", "x"), "row_id").select("tree", "rank", "row_id", "x")
    # growing a tree costs far more than moving its sample: not to be merged into a few tasks for their few bytes
    tasks = max(fm.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(fm.sparkSession))
    return samples.repartition(min(n_trees, tasks), "tree"), psi


def _mixed_sql(a: str) -> str:
    b = f"((({a}) * ({a}) % {MODULUS} * 16807 + ({a}) * 39373 + 12345) % {MODULUS})"
    return f"(({b} * {b} % {MODULUS} * 48271 + {b}) % {MODULUS})"


def _pair_sql(tree: str, tag: str | None, use: int) -> str:
    """SQL of one hash over columns low, high (f<use>: the mixed halves of that use)."""
    return _mixed_sql(f"(f{use} + high * 39373 + {tree} * 69621) % {MODULUS}")


def sample_sql(src: str, n_trees: int, psi: int, tag: str | None = None) -> str:
    """DuckDB subquery producing ``(tree, rank, row_id, x)`` from ``src(row_id, x)``."""
    prime = _prime(n_trees)
    first = ", ".join(f"{_mixed_sql(f'(low * 48271 + high * 40692 + {_salt(tag, use)}) % {MODULUS}')} AS f{use}" for use in range(5))
    return f"""(SELECT tree, rank, row_id, x FROM (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY h, row_id) - 1 AS rank FROM (
    SELECT row_id, x, tree, psi, {_pair_sql("tree", tag, 0)} AS h FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY step) AS nth FROM (
        SELECT *, (first + step * stride) % {prime} AS tree FROM (
          SELECT *, {_pair_sql("0", tag, 3)} % {prime} AS first, {_pair_sql("0", tag, 4)} % {prime - 1} + 1 AS stride,
                 CASE WHEN share >= 1 THEN {n_trees} ELSE len(list_filter(below, lambda c: c <=
                   ({_pair_sql("0", tag, 1)}::DOUBLE + {_pair_sql("0", tag, 2)}::DOUBLE / {MODULUS}::DOUBLE) / {MODULUS}::DOUBLE)) END AS trees
          FROM (SELECT *, {first} FROM (
            SELECT s.row_id, s.x, k.*, (s.row_id % {MODULUS} + {MODULUS}) % {MODULUS} AS low,
                   ((s.row_id - (s.row_id % {MODULUS} + {MODULUS}) % {MODULUS}) // {MODULUS} % {MODULUS} + {MODULUS}) % {MODULUS} AS high
            FROM {src} s, (
              SELECT psi, share, list(below ORDER BY i) AS below FROM (
                SELECT psi, share, i, sum(CASE WHEN share >= 1 THEN 0 ELSE exp(lgamma({n_trees} + 1) - lgamma(i + 1) - lgamma({n_trees} - i + 1)
                         + i * ln(share) + ({n_trees} - i) * ln(1 - share)) END) OVER (ORDER BY i) AS below
                FROM (SELECT psi, least(1.0::DOUBLE, (psi::DOUBLE + 6.0::DOUBLE * sqrt(psi::DOUBLE) + 20.0::DOUBLE) / n::DOUBLE) AS share
                      FROM (SELECT least({psi}, count(*)) AS psi, count(*) AS n FROM {src})), (SELECT range AS i FROM range({n_trees})))
              GROUP BY psi, share) k))),
        (SELECT range AS step FROM range({prime})))
      WHERE tree < {n_trees} QUALIFY nth <= trees)))
 WHERE rank < (SELECT least({psi}, count(*)) FROM {src}))"""
