"""Load scripts of many apps as tables: statements, variables, loads, fields, sources.

Input is a DataFrame with ``app`` and ``script``. Everything up to one row per load stays in
the row of its script, so apps of any number are read without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions import script_text as S
from tallyloom.functions.columns import first_by_case, let, sorted_side, strip_space, text_map
from tallyloom.functions.types import STRING, resolve_type
from tallyloom.sources.load import CONNECTED, REASONS, SCHEMA_ONLY, inline_rows

# --- fixed values: patterns of the script language
_LABEL = r'^(?!(?i:LOAD)\s)(\[[^\]]+\]|"[^"]+"|[A-Za-z_][A-Za-z0-9_ .]*)\s*:(?!//)\s*'
_LOAD = r"(?is)^((?:(?:MAPPING|ADD|REPLACE|BUFFER|CONCATENATE(?:\s*\([^)]*\))?)\s+)*)LOAD\b(.*)$"
_INLINE = r"(?is)^INLINE\s*\[(.*)\]\s*(?:\(([^)]*)\))?$"
_FORMAT = r"(?s)\(([^()]*)\)$"
_TARGET = r"(?i)^[^;]*?CONCATENATE\s*\(([^)]*)\)\s+(?:\w+\s+)*?LOAD\b"
_CONNECTION = r"(?i)^lib://([^/\\]+)[/\\](.*)$"
_OPTION = r"(?is)^(.+?)\s+is\s+(.+)$"
_TAGGED = r"(?i)\bTagged\s*\(([^)]*)\)$"
_ALIAS = r"""(?is)^(.+)\bAS\b\s*(\[[^\]]*\]|"[^"]*"|'[^']*'|[^()\[\]'",]+)$"""
_BARE = r"^[A-Za-z_][A-Za-z0-9_ .]*$"
_WORD = r"^[A-Za-z_][A-Za-z0-9_]*\z"
_SHAPE = r"(?i)^(?:INLINE|RESIDENT(?=\s)|FROM(?=\s)|(?:SQL\s+)?SELECT\b)"
_NO_LOAD = r"(?i)^(?:" + "|".join(w.replace(" ", r"\s+") for w in fixed.NON_LOAD_KEYWORDS) + r")\b"
# --- end of the patterns
SUMMARY_LINES = 30
# a query in a script runs against a connection that the app does not hold
READABLE_KINDS = ("delimited", "excel", "resident", "inline", "parquet", "json", "xml")


def clean_scripts(scripts: DataFrame) -> DataFrame:
    """(app, script) with Unix line ends and without comments."""
    return scripts.select("app", S.strip_comments(S.unix_lines(F.col("script"))).alias("script"))


def script_statements(scripts: DataFrame) -> DataFrame:
    """(app, pos, statement), positions from 0."""
    return clean_scripts(scripts).select(
        "app", F.posexplode(S.statements(F.col("script"))).alias("pos", "statement")
    )


def script_variables(scripts: DataFrame) -> DataFrame:
    """(app, name, value) of every variable, last assignment only, values expanded as far as known."""
    def each(known: Column) -> Column:
        return F.transform(
            known,
            lambda v: F.struct(v["name"].alias("name"), v["value"].alias("value"), S.expand(v["value"], known).alias("expanded")),
        )

    # the array goes into the generator unnamed: of a named one the optimiser takes a condition, which it computes
    # once more, before the rows are dealt
    return clean_scripts(scripts).select("app", F.inline(let(S.variables(F.col("script")), each)))


def _loads_of(script: Column, load=None) -> Column:
    """The loads of a script, in order, as an array; ``load`` reads one of its statements."""
    load = load or _load

    def read(clean: Column) -> Column:
        return let(
            S.variables(clean),
            lambda known: F.transform(S.statements(clean), lambda text, pos: load(text, pos, known)),
        )

    return F.filter(let(S.strip_comments(S.unix_lines(script)), read), lambda x: x.isNotNull())


def parse_loads(scripts: DataFrame) -> DataFrame:
    """One row per load statement: its table, flags, fields and source.

    The loads of a script are built as one array inside its row and then exploded, so each
    statement is read once whatever is asked of the result.
    """
    return scripts.select("app", F.inline(_loads_of(F.col("script"))))


def parse_tables(scripts: DataFrame) -> DataFrame:
    """One row per table meant for the model, repeated loads merged: its source and its fields.

    Mapping and helper tables are left out. A field counts once, as it stands in the first load
    that has it; the first source that is known counts. All loads of an app stand in the row of
    its script, so merging them needs no shuffle.
    """
    return scripts.select("app", F.inline(let(_loads_of(F.col("script"), _table_load), _merged)))


def _merged(loads: Column) -> Column:
    shown = F.filter(loads, lambda x: ~x["is_mapping"] & ~x["is_hidden"] & (F.size(x["fields"]) > 0))

    def tables(kept: Column) -> Column:
        names = F.array_distinct(F.transform(kept, lambda x: F.lower(x["table"])))
        return F.transform(
            names, lambda name: let(F.filter(kept, lambda x: F.lower(x["table"]) == name), _one_table)
        )

    return let(shown, tables)


def _one_table(own: Column) -> Column:
    def described(source: Column) -> Column:
        return F.struct(
            own[0]["pos"].alias("pos"),
            own[0]["table"].alias("table"),
            F.size(own).alias("n_loads"),
            source["kind"].alias("kind"),
            F.when(source["path"] != "", source["path"]).otherwise(source["resident"]).alias("path"),
            let(F.flatten(F.transform(own, _placed_fields)), _first_of_each).alias("fields"),
        )

    known = F.get(F.filter(own, lambda x: x["kind"] != "unknown"), F.lit(0))
    return let(F.coalesce(known, own[0]), described)


def _placed_fields(load: Column) -> Column:
    return F.transform(
        load["fields"],
        lambda f, i: F.struct(
            load["pos"].alias("load_pos"), i.alias("pos"),
            *[f[n].alias(n) for n in ("field", "expression", "is_derived", "tags")],
        ),
    )


def _first_of_each(fields: Column) -> Column:
    def pick(names: Column) -> Column:
        return F.when(F.size(names) == F.size(fields), fields).otherwise(
            F.transform(names, lambda n: F.filter(fields, lambda f: F.lower(f["field"]) == n)[0])
        )

    return let(F.array_distinct(F.transform(fields, lambda f: F.lower(f["field"]))), pick)


def _load(text: Column, pos: Column, known: Column) -> Column:
    """The load that a statement describes, or null."""
    return _parsed(text, lambda h, b: _sourced(text, pos, h, b, known))


def _table_load(text: Column, pos: Column, known: Column) -> Column:
    """What a table takes from the load that a statement describes, or null: no format options but those of an inline
    block, no filter and no text."""

    def named(h: Column, b: Column, s: Column) -> Column:
        own = _own_name(h["label"], s, pos, lambda: let(_connected(s["path"]), lambda c: c["relative_path"]))
        return let(own, lambda o: _table_row(pos, b, s, o))

    return _parsed(text, lambda h, b: let(_table_source(b["parts"]["tail"], known), lambda s: named(h, b, s)))


def _table_row(pos: Column, body: Column, source: Column, own: Column) -> Column:
    return F.struct(
        pos.alias("pos"),
        F.when(body["target"] != "", body["target"]).otherwise(own).alias("table"),
        body["prefix"].contains("MAPPING").alias("is_mapping"),
        own.startswith("__").alias("is_hidden"),
        *[source[n].alias(n) for n in ("kind", "path", "resident")],
        _fields(body["parts"]["fields"], source["kind"], source["inline_text"], source["options"]).alias("fields"),
    )


def _table_source(tail: Column, known: Column) -> Column:
    """The kind, path, table or block from FROM, RESIDENT, INLINE or SELECT on."""
    names = ("path", "resident", "inline_text", "options")
    named = F.regexp_replace(tail, r"(?i)^(FROM|RESIDENT)\s+", "")

    def read(file: Column) -> Column:
        return _described(_file_kind(file["path"], file["format"]), names, path=file["path"])

    def told(shape: Column) -> Column:
        before = let(S.split_filter(named), lambda c: c["before"])
        return (
            F.when(shape == "file", let(let(before, lambda b: _located(b, known)), read))
            .when(shape == "resident", _described(shape, names, resident=S.unquote(before)))
            .when(shape == "inline", _described(shape, names, inline_text=F.regexp_extract(tail, _INLINE, 1), options=_inline_options(tail)))
            .otherwise(_described(shape, names))
        )

    return let(_shape(tail), told)


def _parsed(text: Column, finish) -> Column:
    """``finish(head, body)`` of a statement that is a load, or null."""
    labelled = text.contains(":")
    head = F.struct(
        F.when(labelled, S.unquote(F.regexp_extract(text, _LABEL, 1))).otherwise("").alias("label"),
        F.when(labelled, F.regexp_replace(text, _LABEL, "")).otherwise(text).alias("rest"),
    )

    def read(h: Column) -> Column:
        is_load = (
            ((h["label"] != "") | ~text.rlike(_NO_LOAD))
            & h["rest"].rlike(_LOAD)
            & ~text.rlike(r"(?i)\bDECLARE\s+FIELD\s+DEFINITION\b")
        )
        return F.when(is_load, let(_body(h["rest"]), lambda b: finish(h, b)))

    # a plain search first: many statements are no loads
    return F.when(text.rlike(r"(?i)LOAD\b"), let(head, read))


def _body(rest: Column) -> Column:
    distinct = r"(?i)^DISTINCT\b"
    bare = F.upper(F.left(rest, F.lit(4))) == "LOAD"
    return let(
        F.struct(
            F.when(bare, "").otherwise(F.upper(F.regexp_extract(rest, _LOAD, 1))).alias("prefix"),
            strip_space(F.when(bare, F.substring(rest, F.lit(5), F.length(rest))).otherwise(F.regexp_extract(rest, _LOAD, 2))).alias("body"),
        ),
        lambda b: F.struct(
            b["prefix"].alias("prefix"),
            F.when(b["prefix"].contains("CONCATENATE"), S.unquote(F.regexp_extract(rest, _TARGET, 1)))
            .otherwise("")
            .alias("target"),
            b["body"].rlike(distinct).alias("is_distinct"),
            let(F.regexp_replace(b["body"], distinct, ""), S.split_load).alias("parts"),
        ),
    )


def _sourced(text: Column, pos: Column, head: Column, body: Column, known: Column) -> Column:
    return let(
        _source(body["parts"]["tail"], known),
        lambda s: let(_own_name(head["label"], s, pos), lambda own: _row(text, pos, head, body, s, own)),
    )


def _shape(tail: Column) -> Column:
    """What the text from FROM, RESIDENT, INLINE or SELECT on names: a file, a table, a block or a query."""
    return let(
        F.upper(F.regexp_extract(tail, _SHAPE, 0)),
        lambda word: F.when(word == "FROM", "file")
        .when(word == "RESIDENT", "resident")
        .when((word == "INLINE") & tail.rlike(_INLINE), "inline")
        .when(word.endswith("SELECT"), "sql")
        .otherwise("unknown"),
    )


def _source(tail: Column, known: Column) -> Column:
    """The kind, path, format options and filter of the text from FROM, RESIDENT, INLINE or SELECT on."""
    named = F.regexp_replace(tail, r"(?i)^(FROM|RESIDENT)\s+", "")

    def told(shape: Column) -> Column:
        resident = let(
            S.split_filter(named),
            lambda c: _described(shape, filter=c["filter"], resident=S.unquote(c["before"])),
        )
        return (
            F.when(shape == "file", let(S.split_filter(named), lambda c: _file(c, known)))
            .when(shape == "resident", resident)
            .when(shape == "inline", _described(shape, inline_text=F.regexp_extract(tail, _INLINE, 1), options=_inline_options(tail)))
            .otherwise(_described(shape))
        )

    return let(_shape(tail), told)


_DESCRIBED = ("path", "filter", "resident", "inline_text", "options", "connection", "relative_path")


def _described(kind: Column, names: tuple[str, ...] = _DESCRIBED, **known: Column) -> Column:
    """A source with what is ``known`` of it; the rest of its ``names`` is empty."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(
        kind.alias("kind"), *[known.get(n, none if n == "options" else F.lit("")).alias(n) for n in names]
    )


def _inline_options(tail: Column) -> Column:
    return _options(F.regexp_extract(tail, _INLINE, 2))


def _options(given: Column) -> Column:
    return F.transform(S.split_commas(given), _option)


def _file(clauses: Column, known: Column) -> Column:
    """The source that a file's path and format, parted from its filter, describe."""

    def described(f: Column, connected: Column) -> Column:
        return _described(
            _file_kind(f["path"], f["format"]), path=f["path"], filter=clauses["filter"], options=_options(f["format"]),
            connection=connected["connection"], relative_path=connected["relative_path"],
        )

    return let(_located(clauses["before"], known), lambda f: let(_connected(f["path"]), lambda c: described(f, c)))


def _located(named: Column, known: Column) -> Column:
    """The ``format`` in parentheses behind a file's name, empty if there is none, and its ``path``."""

    def formatted(given: Column) -> Column:
        is_format = _first_word(given).isin(*fixed.FORMAT_KINDS)
        plain = F.struct(F.lit("").alias("format"), named.alias("named"))
        return F.when(
            is_format,
            F.struct(given.alias("format"), strip_space(F.regexp_replace(named, _FORMAT, "")).alias("named")),
        ).otherwise(plain)

    def located(f: Column) -> Column:
        path = strip_space(let(S.unquote(f["named"]), lambda p: S.expand(p, known)))
        return F.struct(f["format"].alias("format"), path.alias("path"))

    return let(let(F.regexp_extract(named, _FORMAT, 1), formatted), located)


def _connected(path: Column) -> Column:
    named = F.struct(
        strip_space(F.regexp_extract(path, _CONNECTION, 1)).alias("connection"),
        strip_space(F.regexp_extract(path, _CONNECTION, 2)).alias("relative_path"),
    )
    plain = F.struct(F.lit("").alias("connection"), path.alias("relative_path"))
    return F.when(path.rlike(_CONNECTION), named).otherwise(plain)


def _first_word(spec: Column) -> Column:
    return F.lower(strip_space(F.split_part(spec, F.lit(","), F.lit(1))))


def _file_kind(path: Column, spec: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_format = F.try_element_at(text_map(fixed.FORMAT_KINDS), _first_word(spec))
    by_suffix = F.try_element_at(text_map(fixed.EXTENSION_KINDS), suffix)
    return F.coalesce(F.when(spec != "", by_format).otherwise(by_suffix), F.lit("unknown"))


def _option(text: Column) -> Column:
    pair = text.rlike(_OPTION)
    key = F.when(pair, strip_space(F.regexp_extract(text, _OPTION, 1))).otherwise(text)
    return F.struct(
        F.replace(F.lower(key), F.lit(" "), F.lit("_")).alias("key"),
        F.when(pair, S.unquote(F.regexp_extract(text, _OPTION, 2))).otherwise("true").alias("value"),
    )


def _own_name(label: Column, source: Column, pos: Column, relative_path=None) -> Column:
    path = relative_path() if relative_path else source["relative_path"]
    stem = strip_space(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]+$", ""))
    return (
        F.when(label != "", label)
        .when(source["kind"].isin(*fixed.FILE_KINDS) & (stem != ""), stem)
        .when(source["resident"] != "", source["resident"])
        .otherwise(F.concat(F.lit("Table_"), pos.cast("string")))
    )


def _row(text: Column, pos: Column, head: Column, body: Column, source: Column, own: Column) -> Column:
    return F.struct(
        pos.alias("pos"),
        F.when(body["target"] != "", body["target"]).otherwise(own).alias("table"),
        head["label"].alias("label"),
        body["prefix"].contains("MAPPING").alias("is_mapping"),
        own.startswith("__").alias("is_hidden"),
        body["is_distinct"].alias("is_distinct"),
        body["target"].alias("target"),
        *[
            source[n].alias(n)
            for n in ("kind", "path", "connection", "relative_path", "resident", "filter", "inline_text", "options")
        ],
        _fields(body["parts"]["fields"], source["kind"], source["inline_text"], source["options"]).alias("fields"),
        text.alias("statement"),
    )


def _fields(listed: Column, kind: Column, inline_text: Column, options: Column) -> Column:
    """The fields of a load; the columns of an inline block are known, so a star can be spelled out."""
    none = F.array().cast("array<string>")
    header = F.get(inline_rows(inline_text, _inline_delimiter(options)), F.lit(0))
    star = (kind == "inline") & F.array_contains(listed, "*")
    spelled = F.when(
        star, F.concat(F.filter(listed, lambda f: f != "*"), F.coalesce(header, none))
    ).otherwise(listed)
    return F.filter(F.transform(spelled, lambda f: _field_of(f, kind)), lambda f: f["field"] != "")


def _load_fields(text: Column) -> Column:
    """The fields of the load that a statement describes, or null; where they come from is not read."""

    def read(body: Column) -> Column:
        tail = body["parts"]["tail"]
        return let(
            _shape(tail), lambda s: _fields(body["parts"]["fields"], s, F.regexp_extract(tail, _INLINE, 1), _inline_options(tail))
        )

    return _parsed(text, lambda head, body: read(body))


def _field_of(text: Column, kind: Column) -> Column:
    """A field text as its name, expression, tags and whether it is computed.

    A bare or bracketed name is a column; the labels of an inline block are columns too.
    """
    none = F.array().cast("array<string>")
    # a cheap search first: most fields have neither tags nor an alias
    tagged = F.lower(text).contains("tagged") & text.rlike(_TAGGED)
    plain = F.when(tagged, strip_space(F.regexp_replace(text, _TAGGED, ""))).otherwise(text)

    def aliased(p: Column) -> Column:
        has_alias = F.lower(p).contains("as") & p.rlike(_ALIAS)
        return F.struct(
            F.when(has_alias, strip_space(F.regexp_extract(p, _ALIAS, 1))).otherwise(p).alias("expression"),
            F.when(has_alias, S.unquote(F.regexp_extract(p, _ALIAS, 2))).alias("alias"),
        )

    def described(a: Column) -> Column:
        return let(S.unquote(a["expression"]), lambda bare: with_bare(a["expression"], a["alias"], bare))

    def with_bare(expression: Column, alias: Column, bare: Column) -> Column:
        is_bare = bare.rlike(_BARE)
        quoted = expression.rlike(r'(?s)^(\[[^\]]*\]|"[^"]*")$')
        column = quoted | ((expression == bare) & is_bare) | (expression == "*") | (kind == "inline")
        tags = F.transform(S.split_commas(F.regexp_extract(text, _TAGGED, 1)), S.unquote)
        return F.struct(
            F.coalesce(alias, bare).alias("field"),
            expression.alias("expression"),
            F.when(alias.isNotNull(), ~is_bare).otherwise(~column).alias("is_derived"),
            F.when(tagged, tags).otherwise(none).alias("tags"),
        )

    # one word is a column with nothing to be told apart
    word = F.struct(text.alias("field"), text.alias("expression"), F.lit(False).alias("is_derived"), none.alias("tags"))
    return F.when(text.rlike(_WORD), word).otherwise(let(let(plain, aliased), described))


def option_value(options: Column, key: str, default: str) -> Column:
    """The value of a format option; the last one counts if it is given twice."""
    given = F.filter(options, lambda o: o["key"] == key)
    return F.coalesce(F.try_element_at(given, F.lit(-1))["value"], F.lit(default))


def _inline_delimiter(options: Column) -> Column:
    given = option_value(options, "delimiter", ",")
    return F.when(F.lower(given).isin("\\t", "tab"), "\t").otherwise(given)


def options_text(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit("="), o["value"])), "; ")


def script_loads(loads: DataFrame) -> DataFrame:
    """(app, pos, table, flags, kind, filter, number of fields) of every load."""
    return loads.select(
        "app", "pos", "table", "kind", "is_mapping", "is_hidden", "is_distinct", "filter",
        F.size("fields").alias("n_fields"),
    )


def script_sources(loads: DataFrame) -> DataFrame:
    """(app, pos, table, kind, path, connection, relative_path, resident, options)."""
    return loads.select(
        "app", "pos", "table", "kind", "path", "connection", "relative_path", "resident",
        options_text(F.col("options")).alias("options"),
    )


def script_fields(loads: DataFrame) -> DataFrame:
    """(app, load_pos, table, pos, field, expression, is_derived, tags) of every field of every load."""
    return loads.select(
        "app", F.col("pos").alias("load_pos"), "table", "kind", "is_mapping", "is_hidden",
        F.posexplode("fields").alias("pos", "f"),
    ).select("app", "load_pos", "table", "kind", "is_mapping", "is_hidden", "pos", "f.*")


def visible_tables(tables: DataFrame) -> DataFrame:
    """(app, table, first_pos, n_loads) of the tables meant for the model."""
    return tables.select("app", "table", F.col("pos").alias("first_pos"), "n_loads")


def table_fields(tables: DataFrame) -> DataFrame:
    """(app, table, kind, load_pos, pos, field, expression, is_derived, tags), repeated loads merged."""
    return tables.select("app", "table", "kind", F.explode("fields").alias("f")).select("app", "table", "kind", "f.*")


def _evidenced(loads: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Loads whose fields carry the tags and the numeric flag of the data model beside their own tags.

    ``metadata`` has (app, field, tags, is_numeric); the fields of one app come to its rows as one map.
    """
    none = F.array().cast("array<string>")
    if metadata is None:
        return loads.withColumn("fields", F.transform("fields", lambda f: f.withField("is_numeric", F.lit(False))))
    entry = F.struct(
        F.lower("field").alias("key"),
        F.struct(F.coalesce("tags", none).alias("tags"), F.coalesce("is_numeric", F.lit(False)).alias("is_numeric")).alias("value"),
    )
    # one shuffle: the fields of an app are gathered at once, those of one name meet inside its row
    known = metadata.groupBy("app").agg(F.collect_list(F.when(F.col("field").isNotNull(), entry)).alias("_entries")).select(
        "app", let(F.col("_entries"), _by_name).alias("_known")
    )

    def with_model(f: Column) -> Column:
        model = F.try_element_at(F.col("_known"), F.lower(f["field"]))
        tags = F.concat(F.coalesce(f["tags"], none), F.coalesce(model["tags"], none))
        return f.withField("tags", tags).withField("is_numeric", F.coalesce(model["is_numeric"], F.lit(False)))

    return loads.join(sorted_side(known), "app", "left").withColumn("fields", F.transform("fields", with_model)).drop("_known")


def _by_name(entries: Column) -> Column:
    """A map of the evidence by field name; most names come once."""

    def merged(name: Column) -> Column:
        same = F.filter(entries, lambda e: e["key"] == name)
        value = F.struct(
            F.array_distinct(F.flatten(F.transform(same, lambda e: e["value"]["tags"]))).alias("tags"),
            F.exists(same, lambda e: e["value"]["is_numeric"]).alias("is_numeric"),
        )
        return F.struct(name.alias("key"), value.alias("value"))

    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    unique = lambda given: F.when(F.size(given) == F.size(entries), entries).otherwise(F.transform(given, merged))
    return F.map_from_entries(let(names, unique))


def load_status(loads: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(app, pos, table, kind, path, status, reason, n_columns, n_typed, n_dropped, unapplied_filter) of every load."""
    return _evidenced(loads, metadata).select(
        "app", "pos", "table", "kind",
        F.when(F.col("path") != "", F.col("path")).otherwise(F.col("resident")).alias("path"),
        _status().alias("status"),
        F.when(F.col("kind").isin(*READABLE_KINDS), "").otherwise(_reason()).alias("reason"),
        *_column_counts(), "filter",
    ).withColumnRenamed("filter", "unapplied_filter")


def _reason() -> Column:
    return F.coalesce(F.try_element_at(text_map(REASONS), F.col("kind")), F.lit(REASONS["unknown"]))


def audit_tables(tables: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(app, table, kind, path, status, n_columns, n_typed, n_dropped) of every table of the model.

    Types count by the tags of script and data model together.
    """
    return _evidenced(tables, metadata).select(
        "app", "table", "kind", "path", _status().alias("status"), *_column_counts(),
    )


def _status() -> Column:
    return F.when(F.col("kind").isin(*READABLE_KINDS), CONNECTED).otherwise(SCHEMA_ONLY)


def _column_counts() -> list[Column]:
    """Columns that are emitted, typed and dropped.

    A readable source gives the fields it holds, or all of them if every one is computed; an
    unreadable one gives its whole schema. Computed fields count as dropped for files only.
    """
    def counted(held: Column) -> Column:
        some = F.size(held) > 0
        emitted = F.when(F.col("kind").isin(*READABLE_KINDS) & some, held).otherwise(F.col("fields"))
        dropped = F.when(F.col("kind").isin(*fixed.FILE_KINDS) & some, F.size("fields") - F.size(held)).otherwise(0)
        return let(emitted, lambda e: F.struct(F.size(e).alias("n_columns"), F.size(F.filter(e, _is_typed)).alias("n_typed"), dropped.alias("n_dropped")))

    counts = let(F.filter("fields", lambda f: ~f["is_derived"]), counted)
    return [F.inline(F.array(counts))]


def _is_typed(f: Column) -> Column:
    # most fields have no tags, and then the flag alone speaks
    return F.when(F.size(f["tags"]) == 0, F.coalesce(f["is_numeric"], F.lit(False))).otherwise(resolve_type(f["tags"], f["is_numeric"]) != STRING)


def dropped_fields(loads: DataFrame) -> DataFrame:
    """(app, table, field, expression) that a file load leaves to the user: they are computed."""
    files = loads.where(F.col("kind").isin(*fixed.FILE_KINDS) & ~F.col("is_mapping") & ~F.col("is_hidden"))
    some = F.exists("fields", lambda f: ~f["is_derived"])
    return files.where(some).select(
        "app", "table", F.inline(F.filter("fields", lambda f: f["is_derived"]))
    ).select("app", "table", "field", "expression")


def schema_only_columns(loads: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(app, table, pos, field, type, reason): the schema of every load that cannot be read."""
    unread = _evidenced(loads, metadata).where(~F.col("kind").isin(*READABLE_KINDS))
    return unread.select("app", "table", _reason().alias("reason"), F.posexplode("fields").alias("pos", "f")).select(
        "app", "table", "pos", F.col("f.field").alias("field"),
        resolve_type(F.col("f.tags"), F.col("f.is_numeric")).alias("type"), "reason",
    )


def default_roots(loads: DataFrame, base: str) -> DataFrame:
    """(app, root): the folder below ``base`` named like the connection of an app's first file."""
    files = loads.where(F.col("kind").isin(*fixed.FILE_KINDS) & (F.col("connection") != ""))
    first = files.groupBy("app").agg(F.min_by("connection", "pos").alias("connection"))
    return first.select("app", F.concat(F.lit(base.rstrip("/") + "/"), "connection").alias("root"))


def script_field_names(scripts: DataFrame, known: Column | None = None, longest: int = 60) -> DataFrame:
    """(app, pos, field): names that the loads of a script give, for apps without field metadata.

    Comments are no names, nor are computed values without one or names longer than ``longest``.
    ``known`` is the array of names that the metadata of a row's app gives; an app with four
    or more names, all longer than two letters, needs no reading.
    """
    read = lambda clean: F.transform(S.statements(clean), _load_fields)
    fields = F.flatten(F.filter(let(S.strip_comments(S.unix_lines(F.col("script"))), read), lambda x: x.isNotNull()))
    named = F.filter(fields, lambda f: ~(f["is_derived"] & (f["field"] == f["expression"])) & (f["field"] != "*"))
    names = F.filter(
        F.transform(named, lambda f: f["field"]),
        lambda n: (F.length(n) <= longest)
        & ~F.exists(F.array(*[F.lit(w) for w in fixed.NOT_A_FIELD_NAME]), lambda w: F.lower(n).contains(w)),
    )
    wanted = scripts
    if known is not None:
        wanted = scripts.where(
            ~((F.size(known) >= 4) & F.forall(known, lambda n: F.length(n) > 2))
        )
    return wanted.select("app", F.posexplode(first_by_case(names)).alias("pos", "field"))


def script_head(scripts: DataFrame, lines: int = SUMMARY_LINES) -> DataFrame:
    """(app, pos, line): the first lines of every script."""
    head = F.slice(F.split(S.unix_lines(F.col("script")), "\n"), 1, lines)
    return scripts.select("app", F.posexplode(F.transform(head, lambda x: F.rtrim(x))).alias("pos", "line"))
