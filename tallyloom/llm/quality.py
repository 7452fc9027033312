"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The weight of a document is the ratio of its probability under a model of target text to that under a model of all
text. Adding Gumbel noise to the log weights and keeping the largest sums samples without replacement, in proportion
to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import mix, slices, word_hashes
from tallyloom.session import stored


@dataclass(frozen=True)
class Resampling:
    """``buckets``: hashed n-grams told apart (a power of 2). ``keep``: share of all documents sampled."""

    buckets: int = 1 << 16
    keep: float = 0.8
    seed: int = 17


def _grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, a word and its pair together, and the bounds of the words."""
    words, bounds = word_hashes(texts)
    out = np.empty((len(words), 2), np.int64)
    out[:, 0] = mix(words) & np.uint64(buckets - 1)
    after = np.concatenate((words[1:], words[:1]))
    out[:, 1] = mix(words * np.uint64(0x9E3779B97F4A7C15) + after) & np.uint64(buckets - 1)
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    out[last, 1] = out[last, 0]  # no pair: the last word counts again
    return out, bounds


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                grams, bounds = _grams(part.column(0), buckets)
                wanted = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                totals[0] += np.bincount(grams.ravel(), minlength=buckets)
                totals[1] += np.bincount(grams[wanted].ravel(), minlength=buckets)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(totals[0, used]), pa.array(totals[1, used])], ["bucket", "raw", "target"]
        )

    return run


def ratios(docs: DataFrame, target_ids: DataFrame, rule: Resampling = Resampling()) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket, counted over all documents.

    Each task adds up its own buckets before anything is shuffled, and the driver gets one number per bucket.
    """
    targets = target_ids.where("doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("wanted")).distinct()
    # as many ids as there may be documents: joined by shuffle at any size
    marked = docs.select("doc_id", F.col("text").cast("string")).hint("merge").join(targets, "doc_id", "left")
    sums = (
        marked.select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
        .mapInArrow(_counts(rule.buckets), "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    found = np.zeros((2, rule.buckets))
    for row in sums.collect():
        found[:, row["bucket"]] = row["raw"], row["target"]
    share = (found + 1) / (found + 1).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Per row of ``docs``: doc_id, log_weight (the sum of ``ratio`` over all n-grams), n_words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                grams, bounds = _grams(part.column(1), len(ratio_of := shared.value))
                sums = np.concatenate(([0.0], np.cumsum(ratio_of[grams].sum(axis=1))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(np.diff(bounds))],
                    ["doc_id", "log_weight", "n_words"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, log_weight double, n_words long")


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise drawn from a hash of ``key``, the same in every run."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by histograms of ever smaller ranges; no sort, no more than ``bins`` counts at once."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    while low < high:
        step = (high - low) / bins
        inside = rows.where(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)) if step > 0 else F.lit(0)
        counts = inside.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).collect()
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if (row["low"], row["high"]) == (low, high):
            break
        low, high = row["low"], row["high"]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, rule: Resampling = Resampling()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, log_weight, gumbel_key, kept.

    ``kept`` marks the ``keep`` share of all rows with the largest keys, ties with the last included. Rows that are equal
    in id draw the same noise. Null and empty texts have weight 1 (log 0). Without target documents all
    weights follow the smoothing alone. An empty table gives an empty result. Other columns are ignored.
    """
    weights = weigh(docs, ratios(docs, target_ids, rule))
    keyed = stored(weights.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), rule.seed)), "quality-keys")
    bar = largest(keyed, "gumbel_key", int(round(rule.keep * keyed.count())))
    return keyed.select("doc_id", "n_words", "log_weight", "gumbel_key", (F.col("gumbel_key") >= bar).alias("kept"))
