"""Load-script text inside a row: comments, statements, variables, field lists.

All of it is column expressions over the row that holds the script, so a corpus of scripts is
read without a shuffle. Quoted text and bracketed names are never looked into. The patterns
use possessive repeats: Java then works through long texts in a loop rather than recursively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import any_of, let, strip_space

# --- fixed values: patterns of the script language
SINGLE = r"'[^']*+(?:'|\z)"
DOUBLE = r'"[^"]*+(?:"|\z)'
BRACKET = r"\[[^\]]*+\]"
OPEN_BRACKET = r"\[[^\]]*+(?:\]|\z)"

# plain text up to the next letter that may begin any of the others goes by in one step
_COMMENTS = (
    rf"""(?s)([^'"\[/Rr]++|{SINGLE}|{DOUBLE}|{BRACKET})"""
    r"|/\*.*?(?:\*/|\z)"
    r"|//[^\n]*+"
    r"|(?<![^\n\r;])(?:REM|rem) [^;]*+;?"
)
_STATEMENT = rf"""(?:[^;'"\[]++|{SINGLE}|{DOUBLE}|{OPEN_BRACKET})++"""
_ASSIGNMENT = r"(?im)^\s*(SET|LET)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([^;]*);"
_REFERENCE = r"\$\([^()]*\)"
_SOURCE = r"(?:FROM|RESIDENT|INLINE|SQL\s+SELECT|SELECT)\b"
# quoted or bracketed text, one of the marks, a source word, or all text up to the next of these
_WORDS = (
    rf"""(?i){SINGLE}|{DOUBLE}|{OPEN_BRACKET}|[(),]|{_SOURCE}"""
    rf"""|(?:[^'"\[(),A-Za-z_0-9]++|(?!{_SOURCE})[A-Za-z_0-9]++)++"""
)
_SOURCE_WORD = rf"(?i)^{_SOURCE}$"
_QUOTED = rf"{SINGLE}|{DOUBLE}|{OPEN_BRACKET}"
# parentheses closed within four levels, which are those of nearly all texts
_CLOSED = rf"""\((?:[^'"\[()]++|{_QUOTED})*+\)"""
for _ in range(3):
    _CLOSED = rf"""\((?:[^'"\[()]++|{_QUOTED}|{_CLOSED})*+\)"""
# one field of a list, and the list up to the first source word
_FIELD = rf"""(?i)(?:[^'"\[(),A-Za-z_0-9]++|(?!{_SOURCE})[A-Za-z_0-9]++|{_QUOTED}|{_CLOSED})++"""
_LIST = rf"""(?i)^(?:[^'"\[()A-Za-z_0-9]++|(?!{_SOURCE})[A-Za-z_0-9]++|{_QUOTED}|{_CLOSED})*+"""
_FILTER = r"(?:WHERE|GROUP\s+BY|ORDER\s+BY|WHILE)\b"
_BEFORE_FILTER = (
    rf"""(?is)^(?:{SINGLE}|{DOUBLE}|{BRACKET}|(?!{_FILTER})[A-Za-z_0-9]++|[^A-Za-z_0-9])*+"""
)
# --- end of the patterns
EXPANSION_PASSES = 6


def unix_lines(script: Column) -> Column:
    return F.replace(script, F.lit("\r\n"), F.lit("\n"))


def strip_comments(script: Column) -> Column:
    """The script without ``//``, ``/* */`` and ``REM`` comments; quotes and brackets kept whole."""
    return F.regexp_replace(script, _COMMENTS, "$1")


def statements(clean: Column) -> Column:
    """The statements of a script without comments, in order."""
    parts = F.regexp_extract_all(clean, F.lit(_STATEMENT), F.lit(0))
    return F.filter(F.transform(parts, strip_space), lambda s: s != "")


def unquote(text: Column) -> Column:
    """A name without its brackets or quotes."""
    def inner(t: Column) -> Column:
        wrapped = any_of([t.startswith(a) & t.endswith(b) for a, b in ("[]", "''", '""')])
        return F.when(
            wrapped & (F.length(t) > 1), strip_space(F.substring(t, F.lit(2), F.length(t) - 2))
        ).otherwise(t)

    return let(strip_space(text), inner)


def variables(clean: Column) -> Column:
    """Variables of a script: an array of (name in lower case, value), the last assignment only.

    ``SET`` takes any value. ``LET`` computes its value, so it counts only if the text is
    plainly a literal.
    """
    def value_of(raw: Column) -> Column:
        quoted = raw.rlike(r"(?s)^('.*'|\".*\")$")
        return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    def read(text: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(text, _ASSIGNMENT, 1)).alias("keyword"),
            F.lower(F.regexp_extract(text, _ASSIGNMENT, 2)).alias("name"),
            let(strip_space(F.regexp_extract(text, _ASSIGNMENT, 3)), value_of).alias("value"),
        )

    def last_ones(found: Column) -> Column:
        return F.filter(
            found,
            lambda v, i: ~F.exists(
                F.slice(found, i + 2, F.size(found)), lambda later: later["name"] == v["name"]
            ),
        )

    found = F.transform(F.regexp_extract_all(clean, F.lit(_ASSIGNMENT), F.lit(0)), read)
    literal = F.filter(found, lambda v: (v["keyword"] == "set") | ~v["value"].rlike(r"[()$]"))
    return F.transform(
        let(literal, last_ones), lambda v: F.struct(v["name"].alias("name"), v["value"].alias("value"))
    )


def expand(text: Column, known: Column) -> Column:
    """``text`` with its ``$(name)`` references replaced; unknown ones stay."""

    def passes(lookup: Column) -> Column:
        def value_of(piece: Column) -> Column:
            name = F.lower(strip_space(F.regexp_extract(piece, r"^\$\(([^()]*)\)$", 1)))
            known_value = F.coalesce(F.try_element_at(lookup, name), piece)
            return F.when(piece.rlike(r"^\$\("), known_value).otherwise(piece)

        out = text
        for _ in range(EXPANSION_PASSES):
            pieces = F.regexp_extract_all(out, F.lit(_REFERENCE + r"|[^$]++|\$"), F.lit(0))
            out = F.array_join(F.transform(pieces, value_of), "")
        return out

    return F.when(text.contains("$("), let(F.map_from_entries(known), passes)).otherwise(text)


def split_load(body: Column) -> Column:
    """A load body as ``(fields array, tail)``.

    The field list ends at the first source word outside parentheses and is split at the commas
    outside parentheses. Patterns do so where parentheses close within four levels; elsewhere a
    fold over the words counts the depth.
    """

    def cut(listed: Column) -> Column:
        rest = F.substring(body, F.length(listed) + 1, F.length(body))
        pieces = F.transform(F.regexp_extract_all(listed, F.lit(_FIELD), F.lit(0)), strip_space)
        by_pattern = lambda tail: F.struct(F.filter(pieces, lambda p: p != "").alias("fields"), strip_space(tail).alias("tail"))
        return let(rest, lambda tail: F.when((tail == "") | tail.rlike(rf"(?i)^{_SOURCE}"), by_pattern(tail)).otherwise(_fold_load(body)))

    return let(F.regexp_extract(body, _LIST, 0), cut)


def _fold_load(body: Column) -> Column:
    """What ``split_load`` gives, for any depth of parentheses and for those that never close or open."""

    def step(state: Column, word: Column) -> Column:
        outside = (state["depth"] == 0) & (state["cut"] < 0)
        depth = F.when(word == "(", state["depth"] + 1).when(word == ")", F.greatest(state["depth"] - 1, F.lit(0)))
        commas = F.when(outside & (word == ","), F.concat(state["commas"], F.array(state["at"])))
        return F.struct(
            (state["at"] + 1).alias("at"),
            depth.otherwise(state["depth"]).alias("depth"),
            F.when(outside & word.rlike(_SOURCE_WORD), state["at"]).otherwise(state["cut"]).alias("cut"),
            commas.otherwise(state["commas"]).alias("commas"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("depth"),
        F.lit(-1).alias("cut"),
        F.array().cast("array<int>").alias("commas"),
    )

    def cut_up(words: Column, place: Column) -> Column:
        end = F.when(place["cut"] >= 0, place["cut"]).otherwise(place["at"])
        pieces = F.zip_with(
            F.concat(F.array(F.lit(-1)), place["commas"]),
            F.concat(place["commas"], F.array(end)),
            lambda a, b: strip_space(F.array_join(F.slice(words, a + 2, b - a - 1), "")),
        )
        tail = F.when(
            place["cut"] >= 0, F.array_join(F.slice(words, place["cut"] + 1, F.size(words)), "")
        ).otherwise("")
        return F.struct(F.filter(pieces, lambda p: p != "").alias("fields"), strip_space(tail).alias("tail"))

    return let(
        F.regexp_extract_all(body, F.lit(_WORDS), F.lit(0)),
        lambda words: let(F.aggregate(words, start, step), lambda place: cut_up(words, place)),
    )


def split_filter(text: Column) -> Column:
    """The text ``before`` the first WHERE, GROUP BY, ORDER BY or WHILE, and the ``filter`` from there on."""
    cut = let(
        F.regexp_extract(text, _BEFORE_FILTER, 0),
        lambda before: F.struct(
            strip_space(before).alias("before"),
            strip_space(F.substring(text, F.length(before) + 1, F.length(text))).alias("filter"),
        ),
    )
    # a plain search first: most texts hold none of the words
    whole = F.struct(strip_space(text).alias("before"), F.lit("").alias("filter"))
    return F.when(text.rlike(rf"(?i){_FILTER}"), cut).otherwise(whole)


def split_commas(text: Column) -> Column:
    """Parts between commas that are not inside quotes or brackets."""
    pattern = rf"""(?:[^,'"\[]++|{SINGLE}|{DOUBLE}|{OPEN_BRACKET})++"""
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(parts, strip_space), lambda p: p != "")
