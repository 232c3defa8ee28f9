"""Document fingerprints: one-permutation MinHash as Column expressions, with DataFrame functions only.

Each shingle is hashed once. The upper bits of its hash name a bin, and the least hash
of a bin stays. An empty bin borrows from a full one that a hash of both picks (optimal
densification, Shrivastava 2017: every empty bin looks at bins in a random order of its own
up to the first full one). Of each bin BITS low-order bits are kept, taken from a hash of the minimum and
the bin, so that bins which borrowed the same minimum still err independently.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import ranks

#: Words of a shingle; a text of fewer words is one shingle.
SHINGLE = 5
#: Bins and bits kept of each.
BINS, BITS = 256, 8
#: Rows of a range of ids, in which each row meets its next one: no more than MOST_ROWS, and no fewer than LEAST_ROWS in parts for EACH_TASK ranges a task.
LEAST_ROWS, MOST_ROWS, EACH_TASK = 64, 4_096, 4

_REST = 64 - int(math.log2(BINS))
#: Bins that an empty bin looks at first, in turn; it looks at all of them after that.
TRIES = 8
_rng = random.Random(20)
_FIRST = [[_rng.randrange(BINS) for _ in range(TRIES)] for _ in range(BINS)]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), ``value`` being computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the ``n``-word shingles of a text in lower case, repeats included; words stand between white space. Null and blank texts have none."""
    space = " \t\n\x0b\f\r"
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(space))

    def of(h: Column) -> Column:
        rolled = F.transform(F.slice(h, 1, F.size(h) - (n - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, n))))
        return F.when(F.size(h) < n, F.array(F.xxhash64(F.concat_ws(" ", h.cast("array<string>"))))).otherwise(rolled)

    none = F.array().cast("array<bigint>")
    return _let(bare, lambda b: F.when(b == "", none).otherwise(_let(F.transform(F.split(b, f"[{space}]+"), lambda w: F.xxhash64(w)), of)))


def _bin(h: Column) -> Column:
    """0 to BINS - 1, rising with the hash."""
    return F.shiftright(h, _REST).cast("int") + BINS // 2


def bin_minima(hashes: Column) -> Column:
    """One long a bin, in order: the bin's least hash, or the bin's largest possible value if no hash falls into it.

    The largest value of each bin is added to the hashes and all are sorted, so the
    first of each bin is what is sought.
    """
    ends = F.lit([((b - BINS // 2) << _REST) | ((1 << _REST) - 1) for b in range(BINS)])

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(F.get(s, i - 1)), _REST) > 0, F.lit(True)))

    return _let(F.sort_array(F.concat(hashes, ends)), firsts)


def densified(minima: Column) -> Column:
    """``minima`` with every empty bin's value borrowed from the first full bin of a random sequence that is the bin's own: TRIES drawn bins, then all bins by the order of a hash with it. All empty stays all empty."""
    low = F.lit((1 << _REST) - 1)
    full = lambda x: x.bitwiseAND(low) != low

    def fill(m: Column, held: Column) -> Column:
        tried = lambda b: F.get(F.filter(F.transform(F.get(F.lit(_FIRST), b), lambda c: F.get(m, c)), full), F.lit(0))
        draw = lambda b: F.array_min(F.transform(held, lambda x: F.xxhash64(b, _bin(x)).bitwiseAND(F.lit(~(BINS - 1))).bitwiseOR(_bin(x).cast("long"))))
        donor = lambda b: F.get(m, draw(b).bitwiseAND(F.lit(BINS - 1)).cast("int"))
        return F.when(F.size(held) > 0, F.transform(m, lambda x, b: F.when(full(x), x).otherwise(F.coalesce(tried(b), donor(b))))).otherwise(m)

    return _let(minima, lambda m: _let(F.filter(m, full), lambda held: fill(m, held)))


def packed(values: Column) -> Column:
    """Lowercase hex of BITS low-order bits a bin."""
    digits = F.lit([f"{v:0{BITS // 4}x}" for v in range(1 << BITS)])
    return F.concat_ws("", F.transform(values, lambda x, b: F.get(digits, F.xxhash64(x, b).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))))


#: The fingerprint of a text without words.
NOTHING = "0" * (BINS * BITS // 4)


def fingerprint(text: Column, n: int = SHINGLE) -> Column:
    """The text's fingerprint, BINS x BITS bits in hex; equal texts have equal ones, texts without words NOTHING."""
    return _let(shingle_hashes(text, n), lambda h: F.when(F.size(h) > 0, packed(densified(bin_minima(h)))).otherwise(NOTHING))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprinted texts: the share of equal bins, less what equal low-order bits give by chance; 0 to 1. 1 if the fingerprints are equal, 0 if only one text has words, null if one is null."""
    chance = 1 / (1 << BITS)
    size = BITS // 8
    bins = F.sequence(F.lit(1), F.lit(BINS * size), F.lit(size))
    equal = _let(F.unhex(a), lambda x: _let(F.unhex(b), lambda y: F.size(F.filter(bins, lambda i: F.substring(x, i, F.lit(size)) == F.substring(y, i, F.lit(size))))))
    share = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((a == NOTHING) | (b == NOTHING), 0.0).otherwise(share)


def with_next(df: DataFrame, id_col: str, then_by: str, column: str, name: str, more: Callable[[DataFrame], DataFrame] = lambda df: df, also: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``name``, the value of ``column`` in the next row by id (null first, equal ids by ``then_by``), the first row's after the last; ``more`` is applied to the rows once they are dealt out, and ``also`` names columns of its result whose next value is wanted too.

    Ids are cut in ranges by a quantile sketch; the rows with the least id of a range stand
    once more, as guests, at the end of the range before, so that each range is complete
    by itself. One exchange; a range is one task's, whatever the number of rows.
    """
    spark, order = df.sparkSession, F.col(id_col)
    n = df.count()
    rows = max(LEAST_ROWS, min(MOST_ROWS, n // (EACH_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cuts = ranks.bounds(df.select(id_col), id_col, rows)
    ranged = df.withColumn("_range", ranks.bucket_of(order, cuts))
    heads = sorted((r["_range"], r["id"]) for r in ranged.groupBy("_range").agg(F.min(id_col).alias("id")).collect())  # two numbers a range
    hosts = {i: heads[k - 1][0] for k, (_, i) in enumerate(heads)}  # a head's id -> the range before, the last one for the first
    spots = spark.createDataFrame([(i, host) for i, host in hosts.items()], "_head long, _host int")
    guests = ranged.join(F.broadcast(spots), F.col(id_col).cast("long").eqNullSafe(F.col("_head")))
    dealt = ranged.withColumn("_guest", F.lit(False)).unionByName(guests.withColumns({"_range": F.col("_host"), "_guest": F.lit(True)}).drop("_head", "_host"))
    w = Window.partitionBy("_range").orderBy("_guest", F.asc_nulls_first(id_col), F.asc_nulls_first(then_by))
    out = more(dealt.withColumn(name, F.lead(column).over(w)))
    out = out.withColumns({to: F.lead(c).over(w) for c, to in (also or {}).items()})
    return out.where(~F.col("_guest")).drop("_guest", "_range")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (code points, rounded down) replaced by as many first code points of ``following``, or all."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a row of ``docs``.

    A null text is empty. The next document is the one with the next id (null ids come first, equal
    ids go by their texts, equal rows stand side by side); after the last comes the first, so a
    lone document is its own next one. Other columns are not read. An empty table has no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    both = with_next(rows, "doc_id", "text", "text", "following", lambda df: df.withColumn("fingerprint", fingerprint(F.col("text"), n)), {"fingerprint": "next_fingerprint"})
    made = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited(F.col("text"), F.col("following")).alias("edited"))
    done = made.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), n).alias("edited_fingerprint"), "next_fingerprint")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
