"""Exact medians of any number of groups and columns in shared passes.

A first pass keeps a mergeable quantile sketch per group and from it takes a bracket of values that holds the middle. A second
pass counts what lies below the bracket and how often each value inside it stands, so the middle is found by exact ranks; that
the bracket holds it is checked by those counts. A bracket with very many different values is narrowed by the same two passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import field
from tallyloom.session import stored

#: Quantiles read from a sketch, and the accuracy of the sketch, whose error is far below their distance.
GRID, ACCURACY = 200, 10_000
#: Different values of one group that a window ranks.
FEW = 1 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys, null matching null."""
    pairs = [F.col(f"{left}.{quoted(k)}").eqNullSafe(F.col(f"{right}.{quoted(k)}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def matched(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with what ``few`` knows of their keys; null matches null, the keys come once."""
    added = [F.col(f"few.{quoted(c)}") for c in few.columns if c not in keys]
    return rows.alias("rows").join(few.alias("few"), same_keys("rows", "few", keys), how).select("rows.*", *added)


def exact_medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``median`` for rows of keys and ``_x``: one row per group, null where a group has no numbers.

    Without keys one row in all.

    The passes are run at once; their results lie in the shared folder.
    """
    if not keys:
        return exact_medians(rows.withColumn("_group", F.lit(0)), ["_group"]).agg(F.max("median").alias("median"))
    rows = rows.select(*map(field, keys), F.col("_x").cast("double"))
    bracket, margin, last = None, 1, None
    while True:
        narrower, values = _narrowed(rows, keys, bracket, margin)
        held = F.col("_value").isNotNull()
        found = values.groupBy(*map(field, keys)).agg(
            F.sum(F.when(~held, F.col("_n"))).alias("_under"), F.sum(F.when(held, F.col("_n"))).alias("_in"), F.count_if(held).alias("_different")
        )
        counted = matched(narrower, found, keys, "left").na.fill(0, ["_under", "_in", "_different"])
        before = F.col("_before") + F.col("_under")
        missed = (F.col("_all") > 0) & ((before >= F.col("_low")) | (before + F.col("_in") < F.col("_high")))
        misses, most = counted.agg(F.count_if(missed), F.max("_different")).first()
        if misses:
            margin *= 2
        elif (most or 0) <= FEW or (last and most >= last):
            return _ranked(narrower, values, keys)
        else:
            bracket = stored(counted.withColumns({"_before": before, "_inside": F.col("_in")}).drop("_under", "_in", "_different"), "median-brackets")
            margin, last = 1, most


def _narrowed(rows: DataFrame, keys: list[str], bracket: DataFrame | None, margin: int) -> tuple[DataFrame, DataFrame]:
    """A bracket within the one given, from a sketch of the values in that, and the counts of values that it holds.

    ``_before`` counts the values before the given bracket; values that lie in it but under the new one come as one null.
    """
    groups = [field(k) for k in keys]
    names = [*keys, "_all", "_low", "_high", "_lo", "_hi", "_before", "_inside"]
    # nan sorts last, but no sketch knows it: it counts as infinite there, and an infinite end lets it in
    shown = F.when(F.isnan("_x"), F.lit(float("inf"))).otherwise(F.col("_x"))
    sketch = F.percentile_approx(shown, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY).alias("_grid")
    if bracket is None:
        near = rows
        sums = rows.groupBy(*groups).agg(F.count("_x").alias("_all"), sketch)
        sums = sums.withColumns({
            "_low": F.expr("(_all + 1) div 2"), "_high": F.expr("_all div 2 + 1"), "_lo": F.lit(float("-inf")), "_hi": F.lit(float("nan")),
            "_before": F.lit(0).cast("long"), "_inside": F.col("_all"),
        })
    else:
        near = matched(rows, bracket, keys).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).select(*groups, "_x")
        sums = matched(bracket, near.groupBy(*groups).agg(sketch), keys, "left")
    held = F.greatest(F.col("_inside"), F.lit(1))
    first = F.floor((F.col("_low") - F.col("_before")) * GRID / held) - margin
    last = F.ceil((F.col("_high") - F.col("_before")) * GRID / held) + margin
    lo = F.when(first > 0, F.get("_grid", first.cast("int"))).otherwise(F.col("_lo"))
    hi = F.when(last < GRID, F.get("_grid", last.cast("int"))).otherwise(F.col("_hi"))
    ends = {"_lo": lo, "_hi": F.when(hi == float("inf"), F.lit(float("nan"))).otherwise(hi)}
    narrower = stored(sums.withColumns(ends).select(*map(field, names)), "median-brackets")
    inside = matched(near.where(F.col("_x").isNotNull()), narrower.select(*groups, "_lo", "_hi"), keys).where(F.col("_x") <= F.col("_hi"))
    value = F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_value")
    return narrower, stored(inside.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n")), "median-values")


def _ranked(bracket: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    groups = [field(k) for k in keys]
    order = Window.partitionBy(*groups).orderBy(F.asc_nulls_first("_value"))
    upto = matched(values, bracket, keys).withColumn("_upto", F.col("_before") + F.sum("_n").over(order))
    reach = lambda rank: F.min(F.when(F.col("_value").isNotNull() & (F.col("_upto") >= F.col(rank)), F.col("_value")))
    low, high = F.col("_a"), F.col("_b")
    median = F.when(F.abs(low) + F.abs(high) < 1e308, (low + high) / 2).when(low == high, low).otherwise(low / 2 + high / 2)
    middles = upto.groupBy(*groups).agg(reach("_low").alias("_a"), reach("_high").alias("_b")).select(*groups, median.alias("median"))
    return matched(bracket.select(*groups), middles, keys, "left")
