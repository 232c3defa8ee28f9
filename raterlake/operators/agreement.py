"""Agreement between raters: pairwise rates and two nominal alpha coefficients.

Pairs within a unit are counted in closed form (m votes make m(m-1)/2 pairs, c equal
ones c(c-1)/2), so nothing grows with the square of a unit's votes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlake.operators import quality


def agreement_matrix(df: DataFrame, unit: str, rater: str, dims: Sequence[str]) -> DataFrame:
    """(dim, pair, agree, total, rate) for pairs of raters that both answered; one row a unit and rater is expected.

    The join is on the unit with a theta condition on the rater, so it makes at
    most raters * (raters - 1) / 2 rows a unit.
    """
    values = [F.expr(f"nullif({d}, '')").alias(d) for d in dims]
    a = df.select(unit, F.col(rater).alias("r1"), *(v.alias(f"a_{d}") for v, d in zip(values, dims, strict=True)))
    b = df.select(unit, F.col(rater).alias("r2"), *(v.alias(f"b_{d}") for v, d in zip(values, dims, strict=True)))
    pairs = a.join(b, unit).where("r1 < r2")
    sums = []
    for d in dims:
        both = F.col(f"a_{d}").isNotNull() & F.col(f"b_{d}").isNotNull()
        sums += [F.count_if(both & (F.col(f"a_{d}") == F.col(f"b_{d}"))).alias(f"agree_{d}"), F.count_if(both).alias(f"total_{d}")]
    wide = pairs.groupBy("r1", "r2").agg(*sums)
    stacked = ", ".join(f"'{d}', agree_{d}, total_{d}" for d in dims)
    tall = wide.select("r1", "r2", F.expr(f"stack({len(dims)}, {stacked}) as (dim, agree, total)")).where("total > 0")
    return tall.select("dim", F.concat_ws("_vs_", F.col("r1").cast("string"), F.col("r2").cast("string")).alias("pair"), "agree", "total", (F.col("agree") / F.col("total")).alias("rate"))


def mean_agreement(matrix: DataFrame) -> DataFrame:
    """(dim, mean_rate): unweighted mean of the pairs' rates, each rounded to four digits first."""
    return matrix.groupBy("dim").agg(F.avg(F.round("rate", 4)).alias("mean_rate"))


def alpha(df: DataFrame, unit: str, dims: Sequence[str], variant: str = "pairwise") -> DataFrame:
    """(dim, n_pairs, disagreeing, n_values, alpha).

    pairwise: every pair of votes weighs the same, and the expected disagreement comes
    from all votes, single ones included; prefiltered: from units with two votes
    or more; standard: Krippendorff's alpha, pairs weighed by 1/(m-1). Null without a
    pair, 1 if no disagreement is expected.
    """
    return alpha_by(df.withColumn("_all", F.lit(0)), "_all", unit, dims, variant).drop("_all")


def alpha_by(df: DataFrame, group: str, unit: str, dims: Sequence[str], variant: str = "pairwise") -> DataFrame:
    """alpha() for each ``group`` of rows (a version, a run): (group, dim, n_pairs, disagreeing, n_values, alpha). One pass over the panel, whose units are brought together once."""
    stacked = ", ".join(f"'{d}', nullif({d}, '')" for d in dims)
    long = df.select(group, unit, F.expr(f"stack({len(dims)}, {stacked}) as (dim, label)")).where("label is not null")
    counts = long.groupBy(group, unit, "dim", "label").agg(F.count("*").alias("c"))
    per_unit = counts.groupBy(group, unit, "dim").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"), F.collect_list(F.struct("label", "c")).alias("votes"))  # one entry a label
    votes = per_unit.select(group, "dim", "m", "s", F.posexplode("votes").alias("k", "vote"))
    paired = F.col("m") > 1
    once = paired & (F.col("k") == 0)  # a unit's pairs are counted at its first label
    by_label = votes.groupBy(group, "dim", F.col("vote.label").alias("label")).agg(
        F.sum("vote.c" if variant == "pairwise" else F.when(paired, F.col("vote.c"))).alias("n"),
        F.sum(F.when(once, F.expr("m * (m - 1) div 2"))).alias("n_pairs"),
        F.sum(F.when(once, F.expr("(m * m - s) div 2"))).alias("disagreeing"),
        F.sum(F.when(once, F.expr("cast(m * m - s as double) / (m - 1)"))).alias("weighed"),
    )
    joined = by_label.groupBy(group, "dim").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pairs", "disagreeing")), F.sum("weighed").alias("weighed"), F.sum("n").alias("n_values"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).where("n_values is not null")
    n = F.col("n_values").cast("double")
    expected = F.when(n > 1, (n * n - F.col("squares")) / (n * (n - 1)))
    observed = F.col("weighed") / n if variant == "standard" else F.col("disagreeing") / F.col("n_pairs")
    value = F.when(F.col("n_pairs") == 0, F.lit(None).cast("double")).when(F.coalesce(expected, F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(1 - observed / expected)
    return joined.select(group, "dim", "n_pairs", "disagreeing", "n_values", value.alias("alpha"))


def ab_compare(df: DataFrame, version: str, pair: tuple, unit: str, dims: Sequence[str], schema_ok: Column, cross_ok: Column) -> DataFrame:
    """(measure, a, b, delta) of two versions of a run: schema_valid_rate and cross_dim_valid_rate in per cent, alpha_<dim> of each dimension; delta is b - a."""
    rates = quality.ab_rates(df, version, schema_ok, cross_ok).select(version, F.expr("stack(2, 'schema_valid_rate', schema_valid_rate, 'cross_dim_valid_rate', cross_dim_valid_rate) as (measure, x)"))
    alphas = alpha_by(df, version, unit, dims).select(version, F.concat(F.lit("alpha_"), "dim").alias("measure"), F.col("alpha").alias("x"))
    sides = [F.max(F.when(F.col(version) == v, F.col("x"))).alias(name) for v, name in zip(pair, "ab", strict=True)]
    return rates.unionByName(alphas).groupBy("measure").agg(*sides).withColumn("delta", F.col("b") - F.col("a"))
