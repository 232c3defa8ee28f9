"""Answers that keep their types: strict JSON as VARIANT values, and the text that Python gives for them.

Lists, numbers, truth values and null stay what they were in the answer. Everything
is a Column expression; nested values are printed by their tokens, so no depth is set.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from raterlake.functions.answers import FENCE, KIND
from raterlake.functions.labels import strip

#: JSON's tokens: a string, a mark, anything else.
_TOKENS = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"\s]+'
#: How Python prints JSON's marks and words.
_PRINTED = {",": ", ", ":": ": ", "true": "True", "false": "False", "null": "None"}
#: Values that count as no answer, as printed.
_FALSE = ("None", "False", "0", "0.0", "-0.0", "[]", "{}")


def last_of_equal_keys(spark: SparkSession) -> None:
    """For this session, of equal keys of an object the last one counts; without it such an object is no JSON."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, or null.

    Spark's parser stops after a value and ignores what follows, so the text is read as the
    first of two list elements, the other one being its own hash: any more text in between
    moves or breaks that.
    """
    mark = F.md5(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == mark, F.try_variant_get(both, "$[0]", "variant"))


def typed_json(text: Column) -> Column:
    """The VARIANT of an answer: of its first fenced block, or else of all of it, or else of what stands from the first brace there to the last; null if none is strict JSON. NaN and infinities are no JSON."""
    fenced = F.regexp_extract(text, f"(?s){FENCE}(?:{KIND})?(.*?){FENCE}", 1)
    body = strip(F.when(text.rlike(f"(?s){FENCE}.*{FENCE}"), fenced).otherwise(text))
    return F.coalesce(strict_json(body), strict_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))


def field(value: Column, name: str) -> Column:
    """A field as VARIANT: null if it is absent, a VARIANT null if it stands there as null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """object, array, scalar or none (absent or null)."""
    first = F.left(F.to_json(value), F.lit(1))
    return F.when(value.isNull() | F.is_variant_null(value), "none").when(first == "{", "object").when(first == "[", "array").otherwise("scalar")


def quoted(text: Column) -> Column:
    """A text as Python prints it in a list: in single quotes, or in double ones if it holds single ones only. Control characters but for line feed, tab and carriage return stand as they are."""
    backslash = "\\"
    out = F.replace(text, F.lit(backslash), F.lit(backslash * 2))
    for char, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(char), F.lit(backslash + letter))
    single, double = text.contains("'"), text.contains('"')
    escaped = F.when(single & double, F.replace(out, F.lit("'"), F.lit("\\'"))).otherwise(out)
    mark = F.when(single & ~double, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, escaped, mark)


def float_text(token: Column) -> Column:
    """A number with a point or exponent as Python prints it: plain from 1e-4 to below 1e16, else with an exponent of two digits or more."""
    value = token.try_cast("double")
    plain = F.regexp_replace(value.cast("string").try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    text = value.cast("string")
    mantissa, exponent = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", ""), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    return F.when(value == 0, text).when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16), plain).otherwise(scientific)


def _printed(token: Column) -> Column:
    out = F.when(token.startswith('"'), quoted(F.try_variant_get(F.try_parse_json(token), "$", "string")))
    for word, text in _PRINTED.items():
        out = out.when(token == word, text)
    return out.when(token.rlike(r"^-?\d.*[.eE]"), float_text(token)).otherwise(token)


def printed(value: Column) -> Column:
    """A VARIANT as Python prints it, strings in quotes; null for SQL null. Objects are printed with their keys in order, and a whole float inside a list without its point."""
    text = F.to_json(value)
    whole_float = text.rlike(r"^-?\d{1,18}$") & F.schema_of_variant(value).startswith("DECIMAL")
    return F.when(text.isNull(), None).when(whole_float, F.concat(text, F.lit(".0"))).otherwise(F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), _printed)))


def is_text(value: Column) -> Column:
    return F.to_json(value).startswith('"')


def text_of(value: Column) -> Column:
    """A VARIANT as text: strings as they are, others printed, absent and null as null."""
    return F.when(value.isNull() | F.is_variant_null(value), None).when(is_text(value), F.try_variant_get(value, "$", "string")).otherwise(printed(value))


def answered(value: Column) -> Column:
    """What a rater answered for a dimension, as text to normalise: of a list its first element; blank for null, an empty list and an absent field."""
    first = F.when(F.to_json(value).startswith("["), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)
    return F.coalesce(text_of(first), F.lit(""))


def shown(value: Column) -> Column:
    """An answer as reasons show it: printed, values that count as none being blank."""
    text = text_of(value)
    return F.coalesce(F.when(is_text(value) | ~text.isin(list(_FALSE)), text), F.lit(""))
