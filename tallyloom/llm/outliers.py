"""Quality rules: robust multivariate outliers among the statistics of texts, per language and source.

A text that passes the plain rules is a vector of five transformed statistics. For every language and source the regularised
minimum covariance determinant of its vectors is searched by concentration steps from deterministic starts, then reweighted; a
text far from the centre by its Mahalanobis distance is rejected. Each step is two aggregations over all vectors, which
Spark splits and combines, so a hot source costs no task more than its share; estimates are rows of a table.

Vectors are whole numbers of 1/256, so that sums are exact and reruns agree, and equal vectors are one weighted point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.words import mix, slices, word_hashes
from tallyloom.session import stored

P = 5
GRID = 256
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Distances are ranked in steps of 1/32 of their logarithm.
RANKS = 32
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_STARTS_LETTER = np.ones(256, bool)
_STARTS_LETTER[0x80:0xC0] = False  # later bytes of a character
_STARTS_LETTER[[ord(c) for c in BLANKS]] = False
_TURN = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@dataclass(frozen=True)
class Rules:
    """The plain rules and the test for outliers.

    ``tolerance`` is what each statistic may vary by in any source, as a standard deviation: logarithm of the words,
    logarithm of the mean word length, and roots of the shares of symbols, repeated lines and repeated words. A source of fewer
    than ``least`` texts is judged with the other small ones of its language, and those with all other small ones.
    ``level`` is the share of normal vectors that the test would reject.
    """

    least_words: int = 50
    most_repeated: int = 50
    least: int = 100
    tolerance: tuple = (1.5, 0.15, 0.1, 0.15, 0.15)
    level: float = 0.0001
    starts_kept: int = 2
    most_steps: int = 20


def chi2_cdf(x: float, k: float) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, k + 40 * math.sqrt(k) + 8 * NormalDist().inv_cdf(max(q, 0.5)) ** 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the ``share`` of normal vectors nearest to the centre is multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _repeated(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words stand in a window of three that its text holds twice or more."""
    marked = np.zeros(len(words), bool)
    if len(words) < 3:
        return marked
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[2:] == text[:-2])
    windows = sum((words[i : len(words) - 2 + i] * _TURN[i] for i in range(1, 3)), words[:-2] * _TURN[0])[inside]
    windows = mix(windows) + text[inside].astype(np.uint64) * _TURN[0]
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    found = inside[order[np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))]] if len(order) else inside
    for i in range(3):
        marked[found + i] = True
    return marked


def _counts(texts: pa.Array) -> list[np.ndarray]:
    """``COUNTS`` for each text of a column; null counts as empty."""
    words, bounds = word_hashes(texts, fold=False)
    repeated = np.concatenate(([0], np.cumsum(_repeated(words, bounds))))
    letters, symbols, lines, again = [], [], [], []
    for text in texts.to_pylist():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        letters.append(np.count_nonzero(_STARTS_LETTER[raw]))
        symbols.append(np.count_nonzero(_IS_SYMBOL[raw]))
        kept = [line for line in (text or "").split("\n") if line.strip(BLANKS)]
        lines.append(len(kept))
        again.append(len(kept) - len(set(kept)))
    return [np.diff(bounds), letters, symbols, again, repeated[bounds[1:]] - repeated[bounds[:-1]], lines]


def statistics(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row: doc_id, ``COUNTS``, base_failed, the vector ``X`` and ``place``, the language and source as one text.

    The vector is null where the text has failed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                counts = [pa.array(c, pa.int64()) for c in _counts(piece.column(2))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *counts], ["doc_id", "place", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.to_json(F.array(F.col("lang").cast("string"), F.col("source").cast("string")))
    counted = docs.select("doc_id", place.alias("place"), "text").mapInArrow(
        run, f"doc_id {kind}, place string, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    n, chars = F.col("n_words"), F.col("word_chars")
    vector = [F.ln(n), F.ln(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.col("n_lines")), F.sqrt(F.col("n_repeat_words") / n)]
    return counted.withColumn("base_failed", failed).withColumns(
        {x: F.when(~failed & (n > 0), F.round(v * GRID)).cast("long") for x, v in zip(X, vector)}
    )


def _pools(points: DataFrame, rules: Rules) -> DataFrame:
    """(place, pool): where the vectors of a language and source are judged."""
    level = [F.from_json("place", "array<string>").alias("parts")]
    places = points.groupBy("place").agg(F.sum("w").alias("n")).select("place", "n", *level)
    places = places.withColumn("lang", F.to_json(F.slice("parts", 1, 1)))
    rest = places.where(F.col("n") < rules.least).groupBy("lang").agg(F.sum("n").alias("rest"))
    pool = F.when(F.col("n") >= rules.least, F.col("place")).when(F.col("rest") >= rules.least, F.col("lang")).otherwise(F.lit("[]"))
    return places.join(rest, "lang", "left").select("place", pool.alias("pool"))


def _moments(columns: list[Column]) -> list[Column]:
    """Weighted count, sums and sums of products, all in whole numbers."""
    w = F.col("w")
    products = [F.sum(w * columns[i] * columns[j]).alias(f"s{i}{j}") for i, j in PAIRS]
    return [F.sum(w).alias("n"), *(F.sum(w * c).alias(f"s{i}") for i, c in enumerate(columns)), *products]


def _covariance(row: dict, unit: float) -> tuple[np.ndarray, np.ndarray]:
    n = row["n"]
    centre = np.array([row[f"s{i}"] / n for i in range(P)]) / unit
    cov = np.empty((P, P))
    for i, j in PAIRS:  # exact in integers until the last division
        cov[i, j] = cov[j, i] = (n * row[f"s{i}{j}"] - row[f"s{i}"] * row[f"s{j}"]) / (n * n) / unit**2
    return centre, cov


MODEL = "pool string, start int, centre array<double>, inverse array<double>, logdet double"


def _models(sums: DataFrame, rules: Rules, factor: float) -> DataFrame:
    """Centre and inverse covariance from moments, the covariance times ``factor`` and widened by the tolerance."""
    wide = np.diag(np.square(rules.tolerance))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                centre, cov = _covariance(row, GRID)
                rows.append(_model(row["pool"], row["start"], centre, factor * cov + wide))
            yield _model_batch(rows)

    return sums.mapInArrow(fit, MODEL)


def _model(pool: str, start: int, centre: np.ndarray, cov: np.ndarray) -> tuple:
    return pool, start, centre.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _model_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["pool", "start", "centre", "inverse", "logdet"])


def _starts(points: DataFrame, rules: Rules) -> DataFrame:
    """Three first estimates per pool, all about the medians: by quartiles alone, by bounded values and by directions."""
    values = points.select("pool", "w", F.posexplode(F.array(*X)).alias("at", "x")).groupBy("pool", "at", "x").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("pool", "at").orderBy("x")
    upto = values.withColumn("upto", F.sum("w").over(order)).withColumn("n", F.sum("w").over(Window.partitionBy("pool", "at")))
    cut = [F.min(F.when(F.col("upto") * 4 >= q * F.col("n"), F.col("x"))).alias(f"q{q}") for q in (1, 2, 3)]
    quarters = upto.groupBy("pool", "at").agg(*cut)
    width = F.sqrt(F.pow((F.col("q3") - F.col("q1")) / (1.349 * GRID), F.lit(2)) + F.pow(F.get(F.array(*map(F.lit, rules.tolerance)), "at"), F.lit(2)))
    robust = quarters.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("at", "q2", width.alias("width")))).alias("axes"))
    robust = stored(robust.select("pool", F.col("axes.q2").alias("middle"), F.col("axes.width").alias("width")), "outlier-axes")
    z = [(F.col(x) - F.get("middle", i)) / GRID / F.get("width", i) for i, x in enumerate(X)]
    norm = F.sqrt(sum((c * c for c in z), F.lit(0.0)))
    kinds = [[F.lit(0.0)] * P, [F.tanh(c) for c in z], [F.when(norm > 0, c / norm).otherwise(F.lit(0.0)) for c in z]]
    bounded = F.array(*[F.struct(F.lit(i).alias("start"), *(F.round(c * 1024).cast("long").alias(f"y{k}") for k, c in enumerate(kind))) for i, kind in enumerate(kinds)])
    rows = points.join(robust, "pool").select("pool", "w", F.inline(bounded))
    sums = rows.groupBy("pool", "start").agg(*_moments([F.col(f"y{i}") for i in range(P)])).join(robust, "pool")
    tolerance = np.array(rules.tolerance)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                _, cov = _covariance(row, 1024)
                own = np.sqrt(np.diag(cov))
                alike = np.where(np.outer(own, own) > 0, cov / np.where(np.outer(own, own) > 0, np.outer(own, own), 1), 0)
                np.fill_diagonal(alike, 1)
                cov = alike * np.outer(row["width"], row["width"]) + np.diag(tolerance**2)
                rows.append(_model(row["pool"], row["start"], np.array(row["middle"]) / GRID, cov))
            yield _model_batch(rows)

    return stored(sums.mapInArrow(fit, MODEL), "outlier-starts")


def _distance() -> Column:
    """The squared Mahalanobis distance of a vector beside its model."""
    z = [F.col(x) / GRID - F.get("centre", i) for i, x in enumerate(X)]
    return sum(((1 if i == j else 2) * z[i] * z[j] * F.get("inverse", i * P + j) for i, j in PAIRS), F.lit(0.0))


def _concentrated(points: DataFrame, models: DataFrame, sizes: DataFrame, rules: Rules) -> DataFrame:
    """One concentration step: models of the half of each pool that lies nearest by the models given."""
    rows = points.join(models, "pool").withColumn("rank", F.floor(F.ln(1 + F.greatest(_distance(), F.lit(0.0))) * RANKS).cast("int"))
    ranks = rows.groupBy("pool", "start", "rank").agg(F.sum("w").alias("w"))
    upto = ranks.withColumn("upto", F.sum("w").over(Window.partitionBy("pool", "start").orderBy("rank"))).join(sizes, "pool")
    limits = upto.where(F.col("upto") >= F.col("half")).groupBy("pool", "start").agg(F.min("rank").alias("limit"))
    near = rows.join(limits, ["pool", "start"]).where(F.col("rank") <= F.col("limit"))
    sums = near.groupBy("pool", "start").agg(*_moments([F.col(x) for x in X]))
    return stored(_models(sums, rules, consistency(0.5)), "outlier-step")


def estimates(points: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``MODEL`` per pool of (pool, ``X``, w): the reweighted regularised minimum covariance determinant.

    Pools of fewer than ``least`` vectors have none. The half is all vectors up to the rank of the distance where the half is
    reached. Of the starts the one of least determinant after ``starts_kept`` steps goes on until its determinant stays.
    """
    half = F.expr(f"(sum(w) + {P + 1}) div 2").alias("half")
    sizes = stored(points.groupBy("pool").agg(F.sum("w").alias("n"), half).where(F.col("n") >= rules.least).select("pool", "half"), "outlier-sizes")
    models = _starts(points.join(sizes, "pool", "left_semi"), rules)
    for _ in range(rules.starts_kept):
        models = _concentrated(points, models, sizes, rules)
    best = F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("m")
    models = models.groupBy("pool").agg(best).select("pool", "m.*")
    for _ in range(rules.most_steps):
        following = _concentrated(points, models, sizes, rules)
        gain = models.join(following.select("pool", F.col("logdet").alias("next")), "pool").agg(F.max(F.col("logdet") - F.col("next"))).first()[0]
        models = following
        if gain is None or gain < 1e-3:
            break
    share = 0.975
    near = points.join(models, "pool").where(_distance() <= chi2_quantile(share, P))
    return stored(_models(near.groupBy("pool", "start").agg(*_moments([F.col(x) for x in X])), rules, consistency(share)), "outlier-models")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row: doc_id, ``COUNTS``, base_failed, distance, kept.

    ``distance`` is the Mahalanobis distance from the centre of the row's language and source; null, and no ground to
    reject, where the plain rules fail the text or fewer than ``least`` texts are left to judge it by. Null texts are
    empty, null languages and sources are ones of their own, repeated rows count each, other columns are ignored.
    """
    rows = stored(statistics(docs, rules), "outlier-statistics")
    vectors = stored(rows.where(F.col(X[0]).isNotNull()).groupBy("place", *X).agg(F.count(F.lit(1)).alias("w")), "outlier-vectors")
    pools = stored(_pools(vectors, rules), "outlier-pools")
    points = stored(vectors.join(pools, "place").drop("place"), "outlier-points")
    models = pools.join(estimates(points, rules), "pool").select("place", "centre", "inverse")
    squared = F.when(F.col(X[0]).isNotNull(), F.greatest(_distance(), F.lit(0.0)))
    far = F.coalesce(F.col("squared") > chi2_quantile(1 - rules.level, P), F.lit(False))
    return rows.join(models, "place", "left").withColumn("squared", squared).select(
        "doc_id", *COUNTS, "base_failed", F.sqrt("squared").alias("distance"), (~F.col("base_failed") & ~far).alias("kept")
    )
