"""Completion and release checks: coverage, vocabulary, rates, latency, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlake.operators import ranks


def blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def truthy(c: str) -> Column:
    """True for true and 1 in any case."""
    return F.coalesce(F.lower(F.col(c).cast("string")).isin("true", "1"), F.lit(False))


def coverage(df: DataFrame, key: str, expected: int, good: float = 90.0, fair: float = 50.0) -> DataFrame:
    """(unique_units, total_rows, pct, status) of the units that ``df`` has of those expected."""
    agg = df.agg(F.countDistinct(key).alias("unique_units"), F.count("*").alias("total_rows"))
    pct = F.col("unique_units") * 100.0 / max(expected, 1) if expected else F.lit(0.0)
    return agg.withColumn("pct", pct).withColumn("status", F.when(F.col("pct") >= good, "PASS").when(F.col("pct") >= fair, "WARN").otherwise("INFO"))


def vocabulary_rate(df: DataFrame, vocabularies: Mapping[str, Sequence[str]], good: float = 95.0) -> DataFrame:
    """(checked, violations, rate_pct, status): blanks aren't checked."""
    checked = sum((F.count_if(~blank(c)) for c in vocabularies), F.lit(0))
    wrong = sum((F.count_if(~blank(c) & ~F.col(c).isin(list(v))) for c, v in vocabularies.items()), F.lit(0))
    agg = df.agg(checked.alias("checked"), wrong.alias("violations"))
    rate = (F.col("checked") - F.col("violations")) * 100.0 / F.greatest("checked", F.lit(1))
    return agg.withColumn("rate_pct", rate).withColumn("status", F.when(F.col("rate_pct") >= good, "PASS").otherwise("WARN"))


def latency_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, mean, median, p95) of positive numeric values: the upper median and the value at floor(0.95 n), both picked, not interpolated."""
    v = df.select(*group, F.col(value).try_cast("double").alias("v")).where("v > 0")
    return ranks.values_at(v, group, "v", {"median": (0.5, lambda n: F.floor(n / 2)), "p95": (0.95, lambda n: F.floor(n * F.lit(0.95)))})


def top_labels(df: DataFrame, column: str, order: str, k: int = 5) -> DataFrame:
    """(label, n): the k most frequent values, ties to the first seen."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.orderBy(F.desc("n"), "seen").limit(k).select("label", "n")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_table(measures: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(check, observed, expected, status): one row a rule (name, measure column, least value, status below it), from a one-row table. A null measure is below."""
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(m).cast("double").alias("observed"), F.lit(float(x)).alias("expected"), F.when(F.col(m) >= x, "PASS").otherwise(low).alias("status")) for n, m, x, low in rules))
    return measures.select(F.explode(rows).alias("r")).select("r.*")


def verdict(checks: DataFrame) -> DataFrame:
    """(total, passed, warned, failed, verdict): a warning doesn't fail."""
    agg = checks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "WARN").alias("warned"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    return agg.withColumn("verdict", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def share(condition: Column, scale: float = 100.0) -> Column:
    """Rows that meet a condition, of all (0 without rows); null counts as not met."""
    return F.count_if(F.coalesce(condition, F.lit(False))) * scale / F.greatest(F.count("*"), F.lit(1))


def check_rater(rows: DataFrame, expected: int, vocabularies: Mapping[str, Sequence[str]], key: str = "patch_id", required: Sequence[str] = (), latency: str | None = None) -> DataFrame:
    """(check, observed, expected, status) for one rater's rows.

    Eight checks: coverage (a warning from half on, information below), required
    columns (the one check that can fail), vocabulary, gate, fallback, distinct first
    labels, duplicates, and the mean of positive latencies, which is absent without
    any. Without rows only coverage is reported.
    """
    first, missing = next(iter(vocabularies)), [c for c in required if c not in rows.columns]
    present = [c for c in vocabularies if c in rows.columns]
    checked = sum((F.count_if(~blank(c)) for c in present), F.lit(0))
    wrong = sum((F.count_if(~blank(c) & ~F.col(c).isin(list(vocabularies[c]))) for c in present), F.lit(0))
    has = lambda c, x: x if c in rows.columns else F.lit(0.0)
    value = F.col(latency).try_cast("double") if latency in rows.columns else F.lit(None).cast("double")
    one = rows.agg(
        F.count("*").alias("rows"),
        (F.countDistinct(key) * 100.0 / max(expected, 1)).alias("coverage"),
        F.lit(-float(len(missing))).alias("schema"),
        ((checked - wrong) * 100.0 / F.greatest(checked, F.lit(1))).alias("vocab"),
        has("gate_pass", share(truthy("gate_pass"))).alias("gate"),
        has("fallback_reason", 100.0 - share(~blank("fallback_reason"))).alias("no_fallback"),
        has(first, F.countDistinct(first)).alias("distinct_labels"),
        (F.countDistinct(key) - F.count(key)).alias("no_duplicates"),
        F.avg(F.when(value > 0, value)).alias("latency"),
    )
    rules = [("coverage", "coverage", 90, "WARN"), ("schema", "schema", 0, "FAIL"), ("vocab", "vocab", 95, "WARN"), ("gate_pass", "gate", 95, "WARN"), ("fallback", "no_fallback", 95.0000001, "WARN"), ("d1_dist", "distinct_labels", 3, "WARN"), ("duplicates", "no_duplicates", 0, "WARN"), ("latency", "latency", 0, "WARN")]
    table = check_table(one, rules).join(F.broadcast(one.select("rows")))  # one row
    status = F.when((F.col("check") == "coverage") & (F.col("observed") < 50), "INFO").otherwise(F.col("status"))
    kept = (F.col("check") == "coverage") | ((F.col("rows") > 0) & ~((F.col("check") == "latency") & F.col("observed").isNull()))
    return table.where(kept).withColumn("status", status).drop("rows")


# Least shares of a smoke run.
SMOKE = {"schema": 0.90, "cross_dim": 0.95, "engine": 0.70}


def smoke_checks(semantic: DataFrame, damage: DataFrame, engine: str = "engine") -> DataFrame:
    """(check, observed, expected, status): schema of both tables, cross-dimension rules, and each engine's gate over both tables; PASS or FAIL.

    Both tables have raw_schema_ok, gate_pass, and the first one cross_dim_warnings
    (blank if none is broken). One pass over each table.
    """
    both = semantic.select(engine, F.lit(3).alias("step"), truthy("raw_schema_ok").alias("schema"), truthy("gate_pass").alias("gate"), blank("cross_dim_warnings").alias("cross")).unionByName(
        damage.select(engine, F.lit(4).alias("step"), truthy("raw_schema_ok").alias("schema"), truthy("gate_pass").alias("gate"), F.lit(False).alias("cross"))
    )
    s3, s4 = F.col("step") == 3, F.col("step") == 4
    per = both.groupBy(engine).agg(F.count("*").alias("n"), F.count_if("gate").alias("gate"), F.count_if(s3).alias("n3"), F.count_if(s4).alias("n4"), F.count_if(s3 & F.col("schema")).alias("schema3"), F.count_if(s4 & F.col("schema")).alias("schema4"), F.count_if(F.col("cross")).alias("cross"))
    rate = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    whole = check_table(per.agg(rate("schema3", "n3").alias("s3"), rate("schema4", "n4").alias("s4"), rate("cross", "n3").alias("c")), [("raw_schema_rate_s3", "s3", SMOKE["schema"], "FAIL"), ("raw_schema_rate_s4", "s4", SMOKE["schema"], "FAIL"), ("cross_dim_valid_rate", "c", SMOKE["cross_dim"], "FAIL")])
    success = F.col("gate") / F.col("n")
    each = per.select(F.concat(F.lit("engine_"), F.col(engine).cast("string"), F.lit("_gate_pass")).alias("check"), success.alias("observed"), F.lit(SMOKE["engine"]).alias("expected"), F.when(success >= SMOKE["engine"], "PASS").otherwise("FAIL").alias("status"))
    return whole.unionByName(each)


def go_no_go(checks: DataFrame) -> DataFrame:
    """(total, failed, verdict): GO if no check failed."""
    agg = checks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    return agg.withColumn("verdict", F.when(F.col("failed") == 0, "GO").otherwise("NO-GO"))


def pilot_exit(results: DataFrame, first: str, second: str, least: float = 0.9) -> DataFrame:
    """(total, step3_pass, step4_pass, step3_rate, step4_rate, exit_ok): both rates must reach ``least``."""
    agg = results.agg(F.count("*").alias("total"), F.count_if(first).alias("step3_pass"), F.count_if(second).alias("step4_pass"))
    rates = agg.withColumns({f"{s}_rate": F.col(f"{s}_pass") / F.greatest("total", F.lit(1)) for s in ("step3", "step4")})
    return rates.withColumn("exit_ok", (F.col("step3_rate") >= least) & (F.col("step4_rate") >= least))


def pooled_mean(tables: Sequence[DataFrame], group: str, value: str) -> DataFrame:
    """(group, n, mean): mean over the rows of several tables together; values that are no numbers don't count."""
    rows = None
    for df in tables:
        own = df.select(group, F.col(value).try_cast("double").alias("v"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(group).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def na_compliance(df: DataFrame, applies: Column, complies: Column) -> DataFrame:
    """(background, compliant, rate_pct): of the rows that a rule applies to, those that comply; null without any."""
    agg = df.where(applies).agg(F.count("*").alias("background"), F.count_if(complies).alias("compliant"))
    return agg.withColumn("rate_pct", F.when(F.col("background") > 0, F.col("compliant") * 100.0 / F.col("background")))


def ab_rates(df: DataFrame, version: str, schema_ok: Column, cross_ok: Column) -> DataFrame:
    """(version, total, schema_valid_rate, cross_dim_valid_rate), in per cent."""
    return df.groupBy(version).agg(F.count("*").alias("total"), share(schema_ok).alias("schema_valid_rate"), share(cross_ok).alias("cross_dim_valid_rate"))
