"""Release checks: checksums, split sets, placeholders, secrets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksums(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256, md5, short): hashes of a text or binary column."""
    return df.select(key, F.sha2(F.col(content), 256).alias("sha256"), F.md5(F.col(content)).alias("md5")).withColumn("short", F.substring("sha256", 1, 16))


def verify_checksums(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(status, n): expected and actual sha256 compared; keys that one side lacks are missing or unlisted."""
    e, a = expected.select(key, F.col("sha256").alias("e")), actual.select(key, F.col("sha256").alias("a"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unlisted").when(F.col("a") == F.col("e"), "ok").otherwise("mismatch")
    return e.join(a, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def required_present(found: DataFrame, name: str, required: Sequence[str], kind: str = "required", bad: str = "FAIL") -> DataFrame:
    """(check, status): each required name, FAIL (``bad``) if ``found`` lacks it."""
    wanted = found.sparkSession.createDataFrame([(r,) for r in required], f"{name} string")
    there = wanted.join(found.select(name).distinct().withColumn("_there", F.lit(True)), name, "left")
    return there.select(F.concat(F.lit(f"{kind}: "), name).alias("check"), F.when(F.col("_there"), "PASS").otherwise(bad).alias("status"))


def validate(
    files: DataFrame, required: Sequence[str], expected_sums: DataFrame, splits: Sequence[tuple[str, DataFrame]], total: int, consensus: DataFrame, per_rater: DataFrame, raters: Mapping[str, int | None], texts: DataFrame, documents: DataFrame, taxonomy: DataFrame | None = None, key: str = "patch_id", optional: Sequence[str] = ()
) -> DataFrame:
    """(section, check, status, n): a release's eight sections as one table.

    Required files, and ``optional`` ones (a warning if absent); checksums (files without one, sums that differ); splits (their
    total, ids in two of them); consensus (ids that it and the splits lack of each
    other, unknown levels); rows a rater (None: at least one), rows of no rater
    (a warning), rows that failed the gate (reported); labels of the taxonomy
    (reported); secrets in ``documents`` (name, content) and placeholders in
    ``texts`` (name, content; a warning). A check of ``n`` findings passes with none.
    """
    spark = files.sparkSession

    def one(section: str, check: str, counted: DataFrame, bad: str = "FAIL") -> DataFrame:
        return counted.select(F.lit(section).alias("section"), F.lit(check).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise(bad).alias("status"), F.col("n").cast("long").alias("n"))

    count = lambda df: df.agg(F.count("*").alias("n"))
    rows = [required_present(files, "path", required).select(F.lit("files").alias("section"), "check", "status", F.when(F.col("status") == "PASS", 0).otherwise(1).cast("long").alias("n"))]
    if optional:
        there = required_present(files, "path", optional, "optional", "WARN")
        rows.append(there.select(F.lit("files").alias("section"), "check", "status", F.when(F.col("status") == "PASS", 0).otherwise(1).cast("long").alias("n")))
    rows.append(one("checksums", "files without a checksum", count(files.join(expected_sums, "path", "left_anti"))))
    pair = files.select("path", F.col("sha256").alias("a")).join(expected_sums.select("path", F.col("sha256").alias("e")), "path")
    rows.append(one("checksums", "checksums that differ", count(pair.where("a <> e"))))
    ids = reduce(DataFrame.unionByName, (df.select(key).distinct().withColumn("split", F.lit(name)) for name, df in splits))
    per_id = ids.groupBy(key).agg(F.count("*").alias("splits"))
    rows.append(one("splits", "ids more or fewer than expected", per_id.agg(F.abs(F.coalesce(F.sum("splits"), F.lit(0)) - total).alias("n"))))
    rows.append(one("splits", "ids in two splits", count(per_id.where("splits > 1"))))
    sides = per_id.select(key, F.lit(True).alias("_s")).join(consensus.select(key).distinct().withColumn("_c", F.lit(True)), key, "full_outer")
    rows.append(one("consensus", "ids that consensus and splits lack of each other", count(sides.where("_s is null or _c is null"))))
    rows.append(one("consensus", "unknown levels", count(consensus.where("coalesce(consensus_level, '') not in ('high', 'medium', 'low')"))))
    per = per_rater.groupBy(F.trim(F.coalesce("engine", F.lit(""))).alias("engine")).agg(F.count("*").alias("n"))
    wanted = F.broadcast(spark.createDataFrame([(e, n) for e, n in raters.items()], "engine string, wanted long"))
    by = wanted.join(per, "engine", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fits = F.when(F.col("wanted").isNull(), F.col("n") > 0).otherwise(F.col("n") == F.col("wanted"))
    rows.append(by.select(F.lit("raters").alias("section"), F.concat(F.lit("rows of "), "engine").alias("check"), F.when(fits, "PASS").otherwise("FAIL").alias("status"), "n"))
    rows.append(one("raters", "rows of no rater", per_rater.agg(F.count_if(F.trim(F.coalesce("engine", F.lit(""))) == "").alias("n")), "WARN"))
    rows.append(per_rater.agg(F.count_if(F.lower(F.col("gate_pass").cast("string")) == "false").alias("n")).select(F.lit("raters").alias("section"), F.lit("rows that failed the gate").alias("check"), F.lit("PASS").alias("status"), "n"))
    if taxonomy is not None:
        rows.append(taxonomy.groupBy("dim").agg(F.count("*").alias("n")).select(F.lit("taxonomy").alias("section"), F.concat(F.lit("labels of "), "dim").alias("check"), F.lit("PASS").alias("status"), "n"))
    rows.append(one("secrets", "documents with secret keys", count(documents.where(F.size(secret_keys(F.col("content"))) > 0))))
    rows.append(one("placeholders", "texts with placeholders", count(texts.where(has_placeholder(F.col("content")))), "WARN"))
    return reduce(DataFrame.unionByName, rows)


def release_verdict(report: DataFrame) -> DataFrame:
    """(passed, warned, failed, verdict): NOT READY with a failure, PASS with warnings, or PASS."""
    agg = report.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed"))))
    return agg.withColumn("verdict", F.when(F.col("failed") > 0, "NOT READY").when(F.col("warned") > 0, "PASS with warnings").otherwise("PASS"))


def freeze(prompts: DataFrame, name: str, content: str) -> DataFrame:
    """(name, sha256_16, length) of frozen texts; a null text counts as empty."""
    text = F.coalesce(F.col(content), F.lit(""))
    return prompts.select(F.col(name).alias("name"), F.substring(F.sha2(text, 256), 1, 16).alias("sha256_16"), F.char_length(text).alias("length"))


def sets_equal(parts: Sequence[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """(missing, extra, equal): ids of the whole that no part has, and the other way round."""
    union = reduce(DataFrame.unionByName, (p.select(key) for p in parts)).distinct().withColumn("_p", F.lit(True))
    both = union.join(whole.select(key).distinct().withColumn("_w", F.lit(True)), key, "full_outer")
    return both.agg(F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("extra")).withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def membership(parts: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(mask, n): how many ids are in just the parts whose bits ``mask`` has, bit i being that of the i-th part. One exchange on the id for all parts; rows that repeat an id in a part count once."""
    if len(parts) > 62:
        raise ValueError("62 parts at most, one bit each")
    marked = reduce(DataFrame.unionByName, (df.select(key, F.lit(1 << i).cast("long").alias("bit")) for i, (_, df) in enumerate(parts)))
    masks = marked.groupBy(key).agg(F.bit_or("bit").alias("mask"))
    return masks.groupBy("mask").agg(F.count("*").alias("n"))


def set_report(parts: Sequence[tuple[str, DataFrame]], whole: DataFrame, key: str) -> DataFrame:
    """(measure, n): sizes of the parts, of each two parts' intersection, of their union, and what the union and the whole lack of each other.

    All from the few masks of membership(), so any number of parts takes one pass over the ids.
    """
    names, mask, n = [name for name, _ in parts], F.col("mask"), F.col("n")
    has = lambda bits: mask.bitwiseAND(F.lit(bits)) == bits
    everything, some = 1 << len(names), mask.bitwiseAND(F.lit((1 << len(names)) - 1)) != 0
    rules = [(f"size:{name}", has(1 << i)) for i, name in enumerate(names)]
    rules += [(f"intersect:{a}&{names[j]}", has(1 << i | 1 << j)) for i, a in enumerate(names) for j in range(i + 1, len(names))]
    rules += [("union", some), ("union_only", some & ~has(everything)), ("whole_only", has(everything) & ~some)]
    row = membership([*parts, ("whole", whole)], key).agg(*(F.coalesce(F.sum(F.when(rule, n)), F.lit(0)).alias(str(k)) for k, (_, rule) in enumerate(rules)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(str(k)).alias("n")) for k, (name, _) in enumerate(rules)))).alias("m")).select("m.*")


def has_placeholder(text: Column, marks: Sequence[str] = ("[To be", "10.xxxx", "XXXXXXX")) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.coalesce(text.contains(m), F.lit(False))
    return found


def secret_keys(document: Column, names: Sequence[str] = ("api_key", "key", "secret", "token", "password")) -> Column:
    """Top-level keys of a JSON object that should not be there."""
    return F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")), F.array(*map(F.lit, names))))
