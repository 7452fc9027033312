"""Chart expressions of many apps: their class, parts and measure name, and the tables they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions.columns import field, let, sorted_side, strip_chars, strip_space, text_map
from tallyloom.functions.names import measure_label

# --- fixed values: patterns of chart expressions
_NAME = r"(?:\[([^\]]+)\]|([A-Za-z_][A-Za-z0-9_]*))"
_COUNT = rf"(?i)^Count\s*\(\s*(DISTINCT\s+)?{_NAME}\s*\)$"
_SIMPLE = rf"(?i)^({'|'.join(fixed.MEASURE_SUFFIXES)})\s*\(\s*{_NAME}\s*\)$"
_PART = rf"({'|'.join(fixed.RATIO_FUNCTIONS)})\s*\(\s*{_NAME}\s*\)"
_RATIO = rf"(?i)^{_PART}\s*/\s*{_PART}$"
_FILTERED = (
    rf"(?i)^({'|'.join(fixed.FILTERED_FUNCTIONS)})\s*\(\s*\{{\s*<\s*{_NAME}\s*=\s*\{{([^}}]*)\}}\s*>\s*\}}\s*{_NAME}\s*\)$"
)
_TOKEN = r"\[[^\]]+\]|[A-Za-z_][A-Za-z0-9_]*"
# --- end of the patterns
_COUNT_SUFFIX = "Count"


def classify(expressions: DataFrame, columns: str | None = None) -> DataFrame:
    """``expressions`` (with ``expression``) and the class, function, fields, filter and measure name.

    The whole text must match a class, otherwise it is ``unresolved``; nothing is guessed from
    a part of it. ``columns`` names an array column of known names: a field takes the spelling
    of the known name that equals it but for case.
    """
    known = field(columns) if columns else F.array().cast("array<string>")
    # built as arrays and exploded, so that a filter on the class does not repeat the matching; the class comes first and
    # alone, so that only what passes such a filter is taken apart
    told = let(
        strip_space(F.coalesce("expression", F.lit(""))),
        lambda text: let(_kind(text), lambda kind: F.struct(text.alias("_text"), _class(text, kind).alias("class"))),
    )
    each = expressions.select("*", F.inline(F.array(told)))
    read = let(_parts(F.col("_text"), F.col("class")), lambda parts: _named(F.col("_text"), parts, known))
    kept = [field(c) for c in expressions.columns]
    return each.select(*kept, "class", F.inline(F.array(read)))


def _kind(text: Column) -> Column:
    return (
        F.when(text == "", "rows")
        .when(text.rlike(_COUNT), F.when(F.regexp_extract(text, _COUNT, 1) != "", "count_distinct").otherwise("count"))
        .when(text.rlike(_SIMPLE), "simple")
        .when(text.rlike(_RATIO), "ratio")
        .when(text.rlike(_FILTERED), "filtered")
        .otherwise("unresolved")
    )


def _class(text: Column, kind: Column) -> Column:
    one = F.size(_values(text)) == 1
    return F.when(kind == "filtered", F.when(one, "filtered_eq").otherwise("filtered_in")).otherwise(kind)


def _group(text: Column, pattern: str, *numbers: int) -> Column:
    return F.concat(*[F.regexp_extract(text, pattern, n) for n in numbers])


def _values(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(_group(text, _FILTERED, 4), ","), lambda v: strip_chars(strip_space(v), "'\"")),
        lambda v: v != "",
    )


def _parts(text: Column, kind: Column) -> Column:
    """What an expression of a class (``filtered`` for both kinds of filters) names."""

    def group(pattern: str, *numbers: int) -> Column:
        return _group(text, pattern, *numbers)

    def pick(k: Column) -> Column:
        def by_class(**values: Column) -> Column:
            out = F.lit("")
            for name, value in values.items():
                out = F.when(k == name, value).otherwise(out)
            return out

        return F.struct(
            k.alias("class"),
            F.lower(
                by_class(
                    count=F.lit("count"), count_distinct=F.lit("count"), simple=group(_SIMPLE, 1),
                    ratio=group(_RATIO, 1), filtered=group(_FILTERED, 1),
                )
            ).alias("function"),
            by_class(
                count=group(_COUNT, 2, 3), count_distinct=group(_COUNT, 2, 3), simple=group(_SIMPLE, 2, 3),
                ratio=group(_RATIO, 2, 3), filtered=group(_FILTERED, 5, 6),
            ).alias("field"),
            F.lower(by_class(ratio=group(_RATIO, 4))).alias("function2"),
            by_class(ratio=group(_RATIO, 5, 6)).alias("field2"),
            by_class(filtered=group(_FILTERED, 2, 3)).alias("filter_field"),
            F.when(k == "filtered", _values(text)).otherwise(F.array().cast("array<string>")).alias("values"),
        )

    return let(F.when(kind.startswith("filtered"), "filtered").otherwise(kind), pick)


def _named(text: Column, parts: Column, known: Column) -> Column:
    def spelled(name: Column) -> Column:
        same = F.filter(known, lambda c: F.lower(c) == F.lower(name))
        return F.coalesce(F.get(same, F.lit(0)), name)

    fields = F.struct(
        *[spelled(parts[n]).alias(n) for n in ("field", "field2", "filter_field")],
    )

    def result(f: Column) -> Column:
        kind, values = parts["class"], parts["values"]
        suffix = F.coalesce(
            F.try_element_at(text_map(fixed.MEASURE_SUFFIXES), parts["function"]), F.lit(_COUNT_SUFFIX)
        )
        one = F.size(values) == 1
        review = F.substring(
            F.trim(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9 ]+", " "), r"\s+", " ")), 1, 40
        )
        label = measure_label(f["field"])
        name = (
            F.when(kind == "rows", "Total Count")
            .when(kind == "count", F.concat(label, F.lit(" Count")))
            .when(kind == "count_distinct", F.concat(F.lit("Unique "), label))
            .when(kind == "simple", F.concat_ws(" ", label, suffix))
            .when(kind == "ratio", F.concat(label, F.lit(" per "), measure_label(f["field2"])))
            .when(
                kind == "filtered",
                F.concat(label, F.lit(" "), suffix, F.lit(" ("), F.when(one, values[0]).otherwise("Filtered"), F.lit(")")),
            )
            .otherwise(F.concat(F.lit("[Needs Review] "), F.when(review == "", "Expression").otherwise(review)))
        )
        return F.struct(
            parts["function"].alias("function"),
            f["field"].alias("field"),
            parts["function2"].alias("function2"),
            f["field2"].alias("field2"),
            f["filter_field"].alias("filter_field"),
            values.alias("values"),
            name.alias("measure"),
        )

    return let(fields, result)


def tokens(expression: Column) -> Column:
    """The distinct names in an expression, brackets dropped, in lower case."""
    found = F.regexp_extract_all(expression, F.lit(_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(strip_chars(t, "[]"))))


def measure_targets(expressions: DataFrame, fields: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(app, expression, table): a measure belongs to every table that owns a name in its text.

    ``expressions`` has (app, expression), ``fields`` has (app, table, field). Both sides are
    made distinct before they meet, so a popular field costs one row per table. Columns of
    ``expressions`` named by ``keep`` come along.
    """
    wanted = expressions.select("app", "expression", *keep).distinct().select(
        "app", "expression", *keep, F.explode(tokens(F.col("expression"))).alias("token")
    )
    owned = fields.select("app", "table", F.lower("field").alias("token")).distinct()
    met = wanted.join(sorted_side(owned), ["app", "token"])
    return met.select("app", "expression", "table", *keep).distinct()
