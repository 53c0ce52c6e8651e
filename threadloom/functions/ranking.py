"""Reproducible sampling order and ranks that survive hot groups.

A `row_number` over one group sorts that group in one task. Where a group may
hold a large part of the table, the helpers here count by the leading digits of
an md5, which spread evenly whatever the data look like, or deal rows out to
ranges whose number follows from the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import SEED
from ..session import staged

#: Hexadecimal digits of a hash, how many a step of a selection looks at, and rows of a group at which it ends.
HASH_DIGITS, DIGITS, SMALL = 32, 2, 1000
#: Rows of a range that are numbered in one task, and bytes of their texts.
RANGE_ROWS, RANGE_BYTES = 1_000_000, 64 << 20


def hash_order(key: Column, seed: int = SEED) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """`n` rows in hash order (all, when there are fewer); a top-n, not a full sort."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, salt: Column, salts: int = 64) -> DataFrame:
    """First `n` rows of each group, found in two steps.

    Step one ranks inside (group, salt), step two ranks what is left, at most
    `salts * n` rows per group. The result does not depend on the salt.
    """
    part = F.pmod(F.xxhash64(salt), F.lit(salts))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", part)
        .withColumn("__rn", F.row_number().over(inner))
        .filter(F.col("__rn") <= n)
        .drop("__rn", "__salt")
        .withColumn("rn", F.row_number().over(outer))
        .filter(F.col("rn") <= n)
    )


def hash_cuts(rows: DataFrame, quotas: DataFrame, group: str, hash_col: str, tie: str, small: int = SMALL) -> DataFrame:
    """(group, cut): the (hash, tie) of each group's `quota`-th row in hash order, found without ranking rows.

    Radix selection: a histogram of the leading hash digits of every group tells
    in which of them the wanted row is, and only rows that begin with these are
    looked at again with the next digits, until at most `small` rows of a group
    are left. Every step is one aggregate over ids and hashes; a group of n rows
    takes about log n / log 256 of them. `quotas` has the group column and `quota`,
    1 or more; groups without so many rows get no cut.
    """
    rows = staged(rows.select(F.col(group).alias("__g"), F.col(hash_col).alias("__h"), F.col(tie).alias("__t")), "hashes")
    at = quotas.select(F.col(group).alias("__q"), F.col("quota").cast("bigint").alias("left"), F.lit("").alias("prefix"))
    same = F.col("__g").eqNullSafe(F.col("__q"))
    done = None
    for digits in range(0, HASH_DIGITS, DIGITS):
        inside = rows.join(at, same & F.col("__h").startswith(F.col("prefix")))
        bars = inside.groupBy("__q", "left", F.substring("__h", 1, digits + DIGITS).alias("prefix")).agg(F.count("*").alias("n"))
        # One row for each group and value of the digits.
        up_to = Window.partitionBy("__q").orderBy("prefix")
        held = bars.withColumn("up_to", F.sum("n").over(up_to)).filter((F.col("up_to") >= F.col("left")) & (F.col("up_to") - F.col("n") < F.col("left")))
        found = staged(held.select("__q", (F.col("left") - F.col("up_to") + F.col("n")).alias("left"), "prefix", "n"), "digits")
        ready = found.filter((F.col("n") <= small) | F.lit(digits + DIGITS >= HASH_DIGITS)).drop("n")
        done = ready if done is None else done.unionByName(ready)
        at = found.filter(F.col("n") > small).drop("n")
        if at.isEmpty():
            break
    last = rows.join(done, same & F.col("__h").startswith(F.col("prefix"))).groupBy("__q", "left").agg(F.sort_array(F.collect_list(F.struct(F.col("__h").alias("h"), F.col("__t").alias("t")))).alias("few"))
    return last.select(F.col("__q").alias(group), F.get("few", (F.col("left") - 1).cast("int")).alias("cut"))


def up_to_cut(df: DataFrame, cuts: DataFrame, group: str, hash_col: Column, tie: Column) -> DataFrame:
    """Adds `first`: whether a row is among those up to its group's cut. Rows stay where they are if the cuts are few."""
    named = cuts.select(F.col(group).alias("__q"), "cut")
    first = F.struct(hash_col.alias("h"), tie.alias("t")) <= F.col("cut")
    return df.join(named, F.col(group).eqNullSafe(F.col("__q")), "left").withColumn("first", F.coalesce(first, F.lit(False))).drop("__q", "cut")


def _string_bytes(df: DataFrame) -> Column:
    """Bytes of a row's string and binary columns."""
    kinds = (T.StringType, T.BinaryType)
    return sum((F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("bigint") for f in df.schema.fields if isinstance(f.dataType, kinds)), F.lit(0).cast("bigint"))


def number_rows(df: DataFrame, order_col: str, rows_each: int = RANGE_ROWS, bytes_each: int = RANGE_BYTES) -> DataFrame:
    """Adds `row_no` 1..n in the order of a column with distinct values.

    Rows are dealt to as many ranges as their number and the length of their texts ask for, sorted there and
    written; a row's place in its range and the sizes of the ranges before give
    its number. No range is ranked by a window, and the table of sizes has a row a range.
    """
    rows, size = df.agg(F.count("*"), F.sum(_string_bytes(df))).first()
    ranges = max(1, -(-rows // rows_each), -(-(size or 0) // bytes_each))
    ranged = staged(df.repartitionByRange(ranges, order_col).sortWithinPartitions(order_col).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("row_no", place + F.col("__start") + 1).drop("__part", "__at", "__start")
