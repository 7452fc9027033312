"""Checks over data and catalogue tables, and the audit of a corpus of apps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions.columns import any_of, field, sorted_side

_REFERENCE = r"'([^']+)'\[([^\]]+)\]"
DETAIL_LENGTH = 90


def fabricated(df: DataFrame, words: tuple[str, ...] = fixed.FABRICATED_TOKENS) -> DataFrame:
    """(column, token, n): in how many cells of each text column each demo token stands.

    One pass of partial sums; only the counters are shuffled. Tokens that stand nowhere have 0.
    """
    texts = [c.name for c in df.schema if isinstance(c.dataType, T.StringType)]
    cells = [(c, w) for c in texts for w in words]
    counts = df.agg(*[F.count_if(field(c).contains(w)).alias(f"n{i}") for i, (c, w) in enumerate(cells)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(w).alias("token"), F.col(f"n{i}").alias("n"))
        for i, (c, w) in enumerate(cells)
    ]
    return counts.select(F.inline(F.array(*rows)))


def has_fabricated(df: DataFrame, words: tuple[str, ...] = fixed.FABRICATED_TOKENS) -> Column:
    """The condition that a row holds a demo token in any text column."""
    texts = [field(c.name) for c in df.schema if isinstance(c.dataType, T.StringType)]
    # each column is named once, so that a computed one is not computed once per token
    return F.exists(F.array(*texts), lambda text: F.coalesce(any_of([text.contains(w) for w in words]), F.lit(False)))


def schema_diff(declared: DataFrame, emitted: DataFrame) -> DataFrame:
    """(app, table, column, problem): columns that only one side has.

    Both sides have (app, table, column); ``emitted`` also has ``status``, and of a schema-only
    table only the missing columns count. One shuffle, of flags, serves both directions.
    """
    no = F.lit(False)
    counts = (F.col("status") != "schema-only").alias("counts")
    sides = declared.select("app", "table", "column", F.lit(True).alias("declared"), no.alias("emitted"), no.alias("counts"))
    others = emitted.select("app", "table", "column", no.alias("declared"), F.lit(True).alias("emitted"), counts)
    met = sides.unionByName(others).groupBy("app", "table", "column").agg(
        *[F.bool_or(flag).alias(flag) for flag in ("declared", "emitted", "counts")]
    )
    missing = F.col("declared") & ~F.col("emitted")
    return met.where(missing | (~F.col("declared") & F.col("counts"))).select(
        "app", "table", "column",
        F.when(missing, "declared but not emitted").otherwise("emitted but not declared").alias("problem"),
    )


def measure_references(measures: DataFrame) -> DataFrame:
    """(app, table, measure, ref_table, ref_column) for every ``'table'[column]`` of an expression."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("expression", F.lit(_REFERENCE), F.lit(1)).alias("t"),
        F.regexp_extract_all("expression", F.lit(_REFERENCE), F.lit(2)).alias("c"),
    )
    each = measures.select("app", "table", "measure", F.explode(F.array_distinct(pairs)).alias("r"))
    return each.select("app", "table", "measure", F.col("r.t").alias("ref_table"), F.col("r.c").alias("ref_column"))


def check_measure_refs(measures: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(app, table, measure, ref_table, ref_column, problem) of references that lead nowhere.

    ``columns`` has (app, table, column), ``tables`` (app, table). An unknown table is reported
    before an unknown column.
    """
    refs = measure_references(measures)
    have = columns.select("app", F.col("table").alias("ref_table"), F.col("column").alias("ref_column"))
    missing = refs.join(sorted_side(have), ["app", "ref_table", "ref_column"], "left_anti")
    named = tables.select("app", F.col("table").alias("ref_table"))
    return _with_problem(missing, named, ["app", "ref_table"], F.lit("unknown column")).select(
        "app", "table", "measure", "ref_table", "ref_column", "problem"
    )


def _with_problem(missing: DataFrame, tables: DataFrame, keys: list[str], otherwise: Column) -> DataFrame:
    """Dangling references with their reason.

    One left join with the distinct tables, so that references are sought once for both reasons; a reference that most
    rows share can be split.
    """
    known = tables.select(*keys, F.lit(True).alias("_known")).distinct()
    problem = F.when(F.col("_known"), otherwise).otherwise("unknown table")
    return missing.join(sorted_side(known), keys, "left").withColumn("problem", problem).drop("_known")


def check_visual_refs(visuals: DataFrame, columns: DataFrame, measures: DataFrame, tables: DataFrame) -> DataFrame:
    """(app, visual, kind, entity, property, problem) of projections that lead nowhere.

    ``visuals`` has (app, visual, kind, entity, property); ``Column`` and ``Measure`` are
    looked up in pools of their own.
    """
    entity = F.col("table").alias("entity")
    pool = columns.select("app", F.lit("Column").alias("kind"), entity, F.col("column").alias("property")).unionByName(
        measures.select("app", F.lit("Measure").alias("kind"), entity, F.col("measure").alias("property"))
    )
    missing = visuals.join(sorted_side(pool), ["app", "kind", "entity", "property"], "left_anti")
    named = tables.select("app", entity)
    absent = F.concat(F.lit("no such "), F.lower("kind"))
    return _with_problem(missing, named, ["app", "entity"], absent).select(
        "app", "visual", "kind", "entity", "property", "problem"
    )


def check_empty_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(app, table) of tables without a column."""
    have = columns.select("app", "table").distinct()
    return tables.select("app", "table").distinct().join(have, ["app", "table"], "left_anti")


ITEMS = (
    "tables", "connected", "schema_only", "columns", "typed_columns", "catalogue_fields", "sheets", "charts",
    "unresolved", "dropped", "no_type_evidence",
)


def audit_summary(
    tables: DataFrame, fields: DataFrame, sheets: DataFrame, charts: DataFrame, unresolved: DataFrame
) -> DataFrame:
    """(app, item, n): what was counted for every app, zeros included.

    ``tables`` is the result of ``scripts.audit_tables``; the others count one row each. All
    inputs are counted in one aggregate, so there is one shuffle, of partial counts.
    """
    counted = tables.select(
        "app",
        F.lit(1).alias("tables"),
        (F.col("status") == "connected").cast("int").alias("connected"),
        (F.col("status") == "schema-only").cast("int").alias("schema_only"),
        F.col("n_columns").alias("columns"),
        F.col("n_typed").alias("typed_columns"),
        F.col("n_dropped").alias("dropped"),
    )
    for name, df in (("catalogue_fields", fields), ("sheets", sheets), ("charts", charts), ("unresolved", unresolved)):
        counted = counted.unionByName(df.select("app", F.lit(1).alias(name)), allowMissingColumns=True)
    sums = counted.groupBy("app").agg(
        *[F.coalesce(F.sum(item), F.lit(0)).alias(item) for item in ITEMS if item != "no_type_evidence"]
    )
    # the note that an app has fields but no evidence of their types
    noted = sums.withColumn(
        "no_type_evidence", ((F.col("catalogue_fields") > 0) & (F.col("typed_columns") == 0)).cast("bigint")
    )
    return noted.unpivot(["app"], list(ITEMS), "item", "n")


def detail_text(text: Column) -> Column:
    """An expression fit for one cell of a report: one line, bars escaped, cut to 90 characters."""
    one_line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.substring(F.replace(one_line, F.lit("|"), F.lit("\\|")), 1, DETAIL_LENGTH)


def audit_details(dropped: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(app, section, table, field, detail): dropped fields and unresolved expressions."""
    fields = dropped.select(
        "app", F.lit("dropped field").alias("section"), "table", "field", detail_text(F.col("expression")).alias("detail")
    )
    texts = unresolved.select(
        "app", F.lit("unresolved expression").alias("section"), "table", F.lit("").alias("field"),
        detail_text(F.col("expression")).alias("detail"),
    )
    return fields.unionByName(texts)
