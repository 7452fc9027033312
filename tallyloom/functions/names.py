"""Names of tables, columns and measures: cleaning, unique names, roles.

A schema is one array of names in one row, so every rule here works inside the row and
needs no shuffle, however many tables the catalogue holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions.columns import any_of, let, lower_all, strip_space


def safe_table_name(name: Column, default: str = fixed.DEFAULT_TABLE_NAME) -> Column:
    """Non-word characters to ``_``, outer ``_`` dropped, ``T_`` before a leading digit."""
    cleaned = F.btrim(
        F.regexp_replace(strip_space(F.coalesce(name, F.lit(""))), "[^A-Za-z0-9_]", "_"), F.lit("_")
    )
    return (
        F.when(cleaned == "", F.lit(default))
        .when(cleaned.rlike("^[0-9]"), F.concat(F.lit("T_"), cleaned))
        .otherwise(cleaned)
    )


def guard_reserved(name: Column) -> Column:
    """A column name that is a reserved word gets a prefix."""
    trimmed = strip_space(name)
    named = F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(fixed.DEFAULT_COLUMN_NAME)).otherwise(trimmed)
    return F.when(
        F.lower(named).isin(*fixed.RESERVED_COLUMN_NAMES), F.concat(F.lit(fixed.RESERVED_PREFIX), named)
    ).otherwise(named)


def _unique(names: Column, taken: Column) -> Column:
    """Names in order, each made unique by the first free ``_2``, ``_3``, … suffix.

    Earlier equal names have used up the suffixes below their count, so a name starts to look
    there and needs one more try for each given name that already ends in a number.
    """

    def fold(all_names: Column) -> Column:
        def step(state: Column, name: Column) -> Column:
            lowered, at = F.lower(name), F.size(state["names"])
            start = F.greatest(F.get(all_names["ranks"], at), F.lit(2))
            stem = F.concat(lowered, F.lit("_"))
            like = let(stem, lambda s: F.size(F.filter(all_names["numbered"], lambda n: n.startswith(s))))
            tries = let(stem, lambda s: F.transform(F.sequence(start, start + like + 1), lambda n: F.concat(s, n.cast("string"))))
            # a hashed difference, so that no try is looked up by itself
            free = F.array_except(tries, state["seen"])[0]
            suffixed = F.concat(name, F.substring(free, F.length(lowered) + 1, F.length(free)))
            chosen = F.when(F.array_contains(state["seen"], lowered), suffixed).otherwise(name)
            return F.struct(
                F.concat(state["seen"], F.array(F.lower(chosen))).alias("seen"),
                F.concat(state["names"], F.array(chosen)).alias("names"),
            )

        start = F.struct(lower_all(taken).alias("seen"), F.array().cast("array<string>").alias("names"))
        return F.aggregate(names, start, step, lambda state: state["names"])

    def suffixed(all_names: Column) -> Column:
        """Where no given name ends in a number, a suffix is how often the name has stood so far."""
        ranks = all_names["ranks"]
        plain = F.transform(names, lambda n, i: F.when(F.get(ranks, i) == 1, n).otherwise(F.concat(n, F.lit("_"), F.get(ranks, i).cast("string"))))
        return F.when((F.size(all_names["numbered"]) == 0) & ~overlap, plain).otherwise(fold(all_names))

    lowered = lower_all(names)
    overlap = F.arrays_overlap(lowered, lower_all(taken))
    numbered = F.filter(F.array_distinct(F.concat(lowered, lower_all(taken))), lambda n: n.rlike("_[0-9]+$"))
    counted = let(lowered, lambda ws: F.struct(numbered.alias("numbered"), _ranks(ws).alias("ranks")))
    clean = (F.size(F.array_distinct(lowered)) == F.size(names)) & ~overlap
    return F.when(clean, names).otherwise(let(counted, suffixed))


def _ranks(words: Column) -> Column:
    """For each word how often it has stood so far, itself included: counted along the sorted words, put back in order."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("rank"), F.array().cast("array<struct<at: int, rank: int>>").alias("ranks"))

    def step(state: Column, w: Column) -> Column:
        rank = F.when(state["word"] == w["word"], state["rank"] + 1).otherwise(F.lit(1))
        return F.struct(
            w["word"].alias("word"), rank.alias("rank"), F.concat(state["ranks"], F.array(F.struct(w["at"].alias("at"), rank.alias("rank")))).alias("ranks")
        )

    return F.aggregate(placed, start, step, lambda state: F.transform(F.array_sort(state["ranks"]), lambda r: r["rank"]))


def unique_columns(names: Column) -> Column:
    """Names unique without regard to case: the first keeps its name, later ones get a suffix."""
    return _unique(names, F.array().cast("array<string>"))


def sanitize_columns(names: Column) -> Column:
    """Reserved words guarded, then made unique."""
    return unique_columns(F.transform(names, guard_reserved))


def measure_names(expressions: Column, columns: Column) -> Column:
    """One name per expression, unique among themselves and against the column names."""

    def title(expression: Column, index: Column) -> Column:
        words = F.trim(F.regexp_replace(expression, "[^a-zA-Z0-9 ]", ""))
        body = F.when(words == "", F.concat(F.lit("Measure_"), (index + 1).cast("string"))).otherwise(words)
        return F.concat(F.lit(fixed.MEASURE_PREFIX), F.regexp_replace(body, r"\s+", "_"))

    return _unique(F.transform(expressions, title), columns)


def name_type(name: Column) -> Column:
    """The opt-in guess of a type from the name alone: ``double`` or ``string``."""
    return F.when(name.rlike("(?i)" + fixed.NUMERIC_NAME), "double").otherwise("string")


def looks_personal(name: Column) -> Column:
    """A field name that hints at personal data."""
    return any_of([F.lower(name).contains(word) for word in fixed.PII_WORDS])


def _first_like(names: Column, pattern: str) -> Column:
    return F.get(F.filter(names, lambda n: n.rlike("(?i)" + pattern)), F.lit(0))


def numeric_role(names: Column) -> Column:
    """The first measure-like name, else the last name."""
    return F.coalesce(_first_like(names, fixed.NUMERIC_ROLE), F.get(names, F.size(names) - 1))


def category_role(names: Column) -> Column:
    """The first category-like name, else the first name."""
    return F.coalesce(_first_like(names, fixed.CATEGORY_ROLE), F.get(names, F.lit(0)))


def identifier_role(names: Column) -> Column:
    """The first key-like name, else the first name."""
    return F.coalesce(_first_like(names, fixed.IDENTIFIER_ROLE), F.get(names, F.lit(0)))


def default_dimension(names: Column) -> Column:
    """The first name that is category-like and not key-like, else the first name."""
    return F.coalesce(
        F.get(
            F.filter(
                names,
                lambda n: ~F.lower(n).rlike("|".join(fixed.DEFAULT_DIM_NOT))
                & F.lower(n).rlike("|".join(fixed.DEFAULT_DIM_LIKE)),
            ),
            F.lit(0),
        ),
        F.get(names, F.lit(0)),
    )


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, everything else kept."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def measure_label(column: Column) -> Column:
    """A field name as a label: kept if it has a capital, else title case."""
    return F.when(column.rlike(r"\p{Lu}"), column).otherwise(title_case(column))
