"""Small column helpers shared by the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip_space(text: Column) -> Column:
    """Both ends freed of any white space, not blanks alone."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def text_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def text_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lower_all(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def first_by_case(words: Column) -> Column:
    """The words without those that repeat an earlier one in another case, order kept."""
    def pick(w: Column) -> Column:
        # nothing repeats in most lists, and then no position has to be looked up
        return F.when(F.size(w["kept"]) == F.size(w["words"]), w["words"]).otherwise(
            F.transform(
                w["kept"],
                lambda k: F.element_at(w["words"], F.array_position(w["lowered"], k).cast("int")),
            )
        )

    folded = let(words, lambda ws: F.struct(ws.alias("words"), lower_all(ws).alias("lowered")))
    return let(
        let(folded, lambda f: F.struct(f["words"].alias("words"), f["lowered"].alias("lowered"),
                                       F.array_distinct(f["lowered"]).alias("kept"))),
        pick,
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    Optimiser rules copy an expression to every place that names it; a value bound to a lambda
    variable stays one expression, so long chains of text steps do not grow out of hand. A fold over
    nothing hands the value on as it is, where a transformed array would copy every result.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, lambda bound: body(bound))


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus, to be met by sorting, which can spill.

    The engine estimates what generators yield by the size of the files below them, far too low, and would hold a table
    of all apps in every task.
    """
    return df.hint("merge")
