"""Row gates: answer flags and resolution of damage labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from raterlake.functions import typed
from raterlake.functions import vocabulary as V
from raterlake.functions.labels import cross_dim_warnings, lookup, schema_missing, strip, vocabulary_errors, with_labels


def gate_flags(schema_ok: Column, vocab_ok: Column, warnings: Column, fallback: Column) -> list[Column]:
    """gate_pass judges the raw answer; review_required the normalised one."""
    clean = F.size(warnings) == 0
    return [(schema_ok & vocab_ok).alias("gate_pass"), clean.alias("normalized_valid"), (~clean | (F.coalesce(fallback, F.lit("")) != "")).alias("review_required")]


class _Fields:
    """The fields of parsed answers, a VARIANT or a map of strings: what is labelled, checked and shown of each."""

    def __init__(self, answers: DataFrame, kind: str, fields: str, names: Sequence[str]):
        self.typed = isinstance(answers.schema[fields].dataType, VariantType)
        self.all, self.names = F.col(fields), list(names)
        held = {d: typed.field(self.all, d) if self.typed else self.all[d] for d in self.names}
        if self.typed:
            self.values = {d: typed.answered(v) for d, v in held.items()}
            self.shown = {d: typed.shown(v) for d, v in held.items()}
            self.texts = {d: F.when(typed.is_text(v), typed.text_of(v)) for d, v in held.items()}
            self.errors_show = {d: F.coalesce(typed.printed(v), F.lit("''")) for d, v in held.items()}
            self.present = {d: v.isNotNull() for d, v in held.items()}
            self.parsed = (typed.kind(self.all) == "object") & (F.to_json(self.all) != "{}")
            self.passed = {d: F.coalesce(typed.text_of(v), F.lit("")) for d, v in held.items()}
        else:
            self.values = self.texts = held
            self.shown = None
            self.errors_show = {d: typed.quoted(F.coalesce(v, F.lit(""))) for d, v in held.items()}
            self.parsed = (F.col(kind) == "object") & (F.size(fields) > 0)
            self.passed = {d: F.coalesce(v, F.lit("")) for d, v in held.items()}

    def labelled(self, answers: DataFrame, dims: Sequence[str]) -> DataFrame:
        return with_labels(answers, {d: self.values[d] for d in dims}, shown=self.shown)

    def missing(self) -> Column:
        if not self.typed:
            return schema_missing(F.when(self.parsed, self.all), self.names)
        absent = F.array_compact(F.array(*(F.when(~self.present[d], F.lit(d)) for d in self.names)))
        return F.when(F.coalesce(self.parsed, F.lit(False)), absent).otherwise(F.array(F.lit("not_dict")))

    def errors(self, vocabularies: Mapping[str, Sequence[str]]) -> Column:
        found = vocabulary_errors({d: self.texts[d] for d in vocabularies}, vocabularies, shown=self.errors_show)
        return F.when(self.parsed, found).otherwise(F.array(F.lit("no_data")))


def assemble_rows(answers: DataFrame, kind: str = "kind", fields: str = "fields") -> DataFrame:
    """Adds D1..D5, raw_schema_ok, raw_vocab_ok, raw_errors, cross_dim_warnings, fallback_reason, normalized_valid, gate_pass, review_required to parsed answers.

    ``fields`` is the VARIANT of an answer (typed.typed_json; ``kind`` isn't read then), whose lists, numbers
    and nulls keep their kind, or a map of strings.
    """
    dims = ["D1", "D2", "D3", "D4", "D5"]
    held = _Fields(answers, kind, fields, [*dims, "confidence"])
    parsed, df, missing = held.parsed, held.labelled(answers, dims), held.missing()
    errors = held.errors({d: V.LABELS[d] for d in dims})
    warnings = F.when(parsed, cross_dim_warnings(*(F.col(d) for d in dims[:4]))).otherwise(F.array(F.lit("no_data")))
    fallback = F.concat_ws("; ", *(F.when(F.col(f"{d}_reason").startswith("fallback:"), F.col(f"{d}_reason")) for d in dims))
    df = df.withColumns({"raw_missing": missing, "raw_vocab_errors": errors, "cross_dim_warnings": warnings, "fallback_reason": fallback})
    flags = gate_flags(F.size("raw_missing") == 0, F.size("raw_vocab_errors") == 0, F.col("cross_dim_warnings"), F.col("fallback_reason"))
    return df.select(*answers.columns, *dims, (F.size("raw_missing") == 0).alias("raw_schema_ok"), (F.size("raw_vocab_errors") == 0).alias("raw_vocab_ok"), F.concat_ws("; ", "raw_missing", "raw_vocab_errors").alias("raw_errors"), "cross_dim_warnings", "fallback_reason", *flags)


def resolve_damage(label: Column, layer: Column, severity: Column, valid: Sequence[str], aliases: Mapping[str, str], unsafe: Sequence[str], pseudo: Sequence[str], cross_layer: Sequence[str], severities: Sequence[str], unknown: str = "未知") -> Column:
    """struct(normalized_label, resolution, severity_valid, review_required, review_reason).

    In this order: pseudo-labels are rejected, official labels direct, safe aliases
    alias, all others review. A label of several layers without a layer, and an
    unknown severity, are for review too; an empty layer counts as given.
    """
    raw = strip(F.coalesce(label, F.lit("")))
    given = F.coalesce(severity, F.lit("")) != ""
    severity_ok = F.when(given, severity.isin(list(severities)))
    rejected = raw.isin(list(pseudo)) | F.lower(raw).isin(V.PSEUDO)
    direct, alias = raw.isin(list(valid)), lookup(aliases, raw)
    kind = F.when(rejected, "rejected").when(direct, "direct").when(alias.isNotNull(), "alias").otherwise("review")
    target = F.when(rejected, unknown).when(direct, raw).when(alias.isNotNull(), alias).otherwise(F.lit(unknown))
    ambiguous = F.coalesce(target.isin(list(cross_layer)), F.lit(False)) & layer.isNull() & kind.isin("direct", "alias")
    bad_severity = ~F.coalesce(severity_ok, F.lit(True))
    why = F.array_compact(
        F.array(
            F.when(rejected, "pseudo_label"), F.when((kind == "review") & raw.isin(list(unsafe)), "unsafe_label"), F.when((kind == "review") & ~raw.isin(list(unsafe)), "unknown_label"),
            F.when(ambiguous, "layer_missing"), F.when(bad_severity, "severity_invalid"),
        )
    )
    return F.struct(target.alias("normalized_label"), kind.alias("resolution"), severity_ok.alias("severity_valid"), (F.size(why) > 0).alias("review_required"), F.concat_ws("; ", why).alias("review_reason"))


def resolution_stats(df: DataFrame, column: str = "resolution") -> DataFrame:
    """(resolution, n), with the total of all under 'total'."""
    return df.rollup(column).agg(F.count("*").alias("n")).select(F.coalesce(column, F.lit("total")).alias("resolution"), "n")


def export_gate(df: DataFrame, label: str, review: str, valid: Sequence[str], pseudo: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows to export, rows for review); running either fails if it meets a label that is a pseudo-label or unknown. A null label passes."""
    low = F.lower(F.col(label))
    bad = F.col(label).isNotNull() & (F.col(label).isin(list(pseudo)) | low.isin(V.PSEUDO) | ~F.col(label).isin(list(valid)))
    blocked = F.raise_error(F.concat(F.lit("export blocked: "), F.col(label), F.lit(" is no official label"))).cast("boolean")
    checked = df.where(F.when(bad, blocked).otherwise(F.lit(True)))
    needs = F.coalesce(F.col(review), F.lit(False))
    return checked.where(~needs), checked.where(needs)


def assemble_damage_rows(answers: DataFrame, kind: str = "kind", fields: str = "fields") -> DataFrame:
    """Adds P1..P4, severity, area, confidence, raw_schema_ok, raw_vocab_ok, raw_errors, fallback_reason, gate_pass and review_required to parsed damage answers.

    Unlike assemble_rows there are no rules across dimensions, severity is judged
    with the labels, and a row is for review if its raw answer fails or a label fell
    back. Severity, area and confidence pass through as they are. ``fields`` as in assemble_rows.
    """
    dims, rest = ["P1", "P2", "P3", "P4"], ("severity", "area", "confidence")
    held = _Fields(answers, kind, fields, [*dims, *rest])
    passed = {c: held.passed[c].alias(c) for c in rest}
    df, missing = held.labelled(answers, dims), held.missing()
    errors = held.errors({**{d: V.LABELS[d] for d in dims}, "severity": list(V.SEVERITY.values())})
    fallback = F.concat_ws("; ", *(F.when(F.col(f"{d}_reason").startswith("fallback:"), F.col(f"{d}_reason")) for d in dims))
    df = df.withColumns({"_missing": missing, "_errors": errors, "fallback_reason": fallback})
    schema_ok, vocab_ok = F.size("_missing") == 0, F.size("_errors") == 0
    return df.select(
        *answers.columns, *dims, *passed.values(), schema_ok.alias("raw_schema_ok"), vocab_ok.alias("raw_vocab_ok"), F.concat_ws("; ", "_missing", "_errors").alias("raw_errors"), "fallback_reason",
        (schema_ok & vocab_ok).alias("gate_pass"), (~(schema_ok & vocab_ok) | (F.col("fallback_reason") != "")).alias("review_required"),
    )


def both_steps(semantic: DataFrame, damage: DataFrame, keys: Sequence[str], first: str = "D1", second: str = "P1") -> DataFrame:
    """Semantic and damage rows of the same item and rater side by side, with step3_valid and step4_valid: whether the first raw label of each is in its vocabulary."""
    a = semantic.withColumn("step3_valid", F.coalesce(F.col(first).isin(V.LABELS[first]), F.lit(False)))
    b = damage.withColumn("step4_valid", F.coalesce(F.col(second).isin(V.LABELS[second]), F.lit(False)))
    return a.join(b, list(keys))


def review_queue(rows: DataFrame, path: str, review: str = "review_required") -> DataFrame:
    """Writes the rows for review as JSON lines and returns them; without any nothing is written."""
    queue = rows.where(F.coalesce(F.col(review), F.lit(False)))
    if not queue.isEmpty():
        queue.write.mode("overwrite").json(path)
    return queue
