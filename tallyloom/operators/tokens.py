"""Candidate column names scanned from whole texts and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions.columns import field, first_by_case, let, lower_all, text_array

# fixed value: a token
_RUN = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]{3,29}(?![A-Za-z0-9_])"


def name_tokens(text: Column) -> Column:
    """Distinct runs of 4 to 30 word characters that start with a letter, first seen first."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)))


def token_scan(texts: DataFrame, app: str, text: str) -> DataFrame:
    """(app, pos, token): the distinct tokens of every text in the order they first appear."""
    return texts.select(field(app).alias("app"), F.posexplode(name_tokens(field(text))).alias("pos", "token"))


def _not_reserved(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*fixed.RESERVED_TOKENS))


def file_candidates(file_name: Column) -> Column:
    """Names made from the words of a file name: the word itself and its id, category and rating."""
    words = F.filter(F.split(file_name, "[^a-zA-Z0-9]"), lambda w: F.length(w) >= 3)
    titled = F.transform(_not_reserved(words), lambda w: F.initcap(w))
    expanded = F.flatten(
        F.transform(titled, lambda w: F.array(w, *[F.concat(w, F.lit(s)) for s in fixed.CANDIDATE_SUFFIXES]))
    )
    return first_by_case(expanded)


def candidates(file_name: Column, text: Column | None = None) -> Column:
    """Candidate columns of a file: those of its name, then its tokens until there are 16.

    A file that yields none gets the default names.
    """
    named = file_candidates(file_name)
    found = named if text is None else let(named, lambda n: _with_tokens(n, text))
    return let(found, lambda c: F.when(F.size(c) == 0, text_array(fixed.DEFAULT_CANDIDATES)).otherwise(c))


def _with_tokens(named: Column, text: Column) -> Column:
    def fill(tokens: Column) -> Column:
        # as many tokens as there is room for, found in lower case, shown as first written
        def chosen(lowered: Column) -> Column:
            room = F.greatest(F.lit(fixed.MAX_CANDIDATES) - F.size(named), F.lit(0))
            fresh = F.array_except(lowered, lower_all(named))
            picked = F.slice(fresh, F.lit(1), room)
            return F.transform(picked, lambda w: F.element_at(tokens, F.array_position(lowered, w).cast("int")))

        return F.concat(named, let(lower_all(tokens), chosen))

    return let(_not_reserved(name_tokens(text)), fill)
