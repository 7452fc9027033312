"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Labels are known per document only. A token of a toxic training document counts as toxic if one of its
features (the lower-cased word, a beginning of it) stands out in toxic documents by a likelihood-ratio test; all
other tokens count as clean. A two-state chain is fitted to these labelled tokens, and a logistic
curve over its forward-backward marginals gives the score of a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.units import runs
from tallyloom.session import stored

TOKEN = re.compile(r"[^\W\d_]+")
#: Tokens whose chain steps are vectorised together.
CHUNK = 64
#: Characters of documents scored together.
TOGETHER = 1 << 20
REMEMBERED = 100_000


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents of either label, and the longest text among them.

    The documents whose hashed ids are least are taken, whole.
    """

    toxic: int = 1000
    clean: int = 2000
    longest: int = 20_000
    epochs: int = 25


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))


def features(token: str) -> list[str]:
    word = token.lower()
    return [word, *("^" + word[:n] for n in (4, 5, 6, 7) if len(word) > n)]


def _standing_out(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Likelihood ratio of a in n against b in m documents, signed."""
    share = (a + b) / (n + m)

    def term(x, size):
        p = x / size
        with np.errstate(divide="ignore", invalid="ignore"):
            yes = np.where(x > 0, x * np.log(p / share), 0)
            no = np.where(x < size, (size - x) * np.log((1 - p) / (1 - share)), 0)
        return yes + no

    return np.sign(a / n - b / m) * 2 * (term(a, n) + term(b, m))


class Chain:
    """Forward-backward over many documents at once.

    Documents are cut into chunks; the product of a chunk's step matrices carries the chain over it, so that all chunks
    advance together and only the carry runs from chunk to chunk.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.per_doc = -(-lengths // CHUNK)
        self.first = np.cumsum(self.per_doc) - self.per_doc
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.cell = (self.first[doc] + place // CHUNK) * CHUNK + place % CHUNK
        self.chunks = int(self.per_doc.sum())
        real = np.zeros(self.chunks * CHUNK, bool)
        real[self.cell] = True
        self.real = real.reshape(-1, CHUNK).T.copy()
        self.order = np.argsort(-self.per_doc, kind="stable")

    def _carry(self, product: np.ndarray, backward: bool) -> np.ndarray:
        """The state vector at the open end of every chunk."""
        out = np.ones((self.chunks, 2)) if backward else np.tile([1.0, 0.0], (self.chunks, 1))
        sizes = self.per_doc[self.order]
        for step in range(1, int(sizes[0]) if len(sizes) else 0):
            docs = self.order[: int(np.searchsorted(-sizes, -step, side="left"))]
            if backward:
                to = self.first[docs] + self.per_doc[docs] - 1 - step
                moved = np.einsum("nij,nj->ni", product[to + 1], out[to + 1])
            else:
                to = self.first[docs] + step
                moved = np.einsum("ni,nij->nj", out[to - 1], product[to - 1])
            out[to] = moved / moved.sum(axis=1, keepdims=True)
        return out

    def run(self, scores: np.ndarray, steps: np.ndarray, pairs: bool = False):
        """Marginals of the toxic state per token; with ``pairs`` the expected counts of steps too."""
        grid = np.zeros(self.chunks * CHUNK)
        grid[self.cell] = np.clip(scores, -30, 30)
        gain = np.exp(grid.reshape(-1, CHUNK).T)
        t = np.exp(steps)
        product = np.tile(np.eye(2), (self.chunks, 1, 1))
        for i in range(CHUNK):
            new = product @ t
            new[:, :, 1] *= gain[i][:, None]
            new /= new.sum(axis=(1, 2), keepdims=True)
            product = np.where(self.real[i][:, None, None], new, product)
        back = np.empty((CHUNK, self.chunks, 2))
        b = self._carry(product, backward=True)
        for i in range(CHUNK - 1, -1, -1):
            back[i] = b
            weighted = b * np.stack((np.ones(self.chunks), gain[i]), axis=1)
            new = weighted @ t.T
            b = np.where(self.real[i][:, None], new / new.sum(axis=1, keepdims=True), b)
        a = self._carry(product, backward=False)
        toxic = np.empty((CHUNK, self.chunks))
        counts = np.zeros((2, 2))
        for i in range(CHUNK):
            after = back[i] * np.stack((np.ones(self.chunks), gain[i]), axis=1)
            if pairs:
                joint = a[:, :, None] * t[None] * after[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                counts += joint[self.real[i]].sum(axis=0)
            new = a @ t
            new[:, 1] *= gain[i]
            a = np.where(self.real[i][:, None], new / new.sum(axis=1, keepdims=True), a)
            both = a * back[i]
            toxic[i] = both[:, 1] / both.sum(axis=1)
        found = toxic.T.ravel()[self.cell]
        return (found, counts) if pairs else found


def _summaries(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log of 1 + the expected toxic tokens, the largest marginal."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    full = np.flatnonzero(lengths)
    if len(full):
        begins = (np.cumsum(lengths) - lengths)[full]
        out[full, 1] = np.log1p(np.add.reduceat(marginals, begins))
        out[full, 2] = np.maximum.reduceat(marginals, begins)
    return out


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.01 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def _unknowing(clean: int) -> Model:
    """A model that tells no texts apart, and so calls none toxic: one score for all, a quarter or, by the clean labels, less."""
    model = Model()
    model.curve[0] = -np.log(3 + clean)
    return model


def train(texts: list[str], toxic: list[int], shares: tuple[float, float], epochs: int = 25) -> Model:
    """Fit to whole labelled texts. ``shares``: how many documents one clean and one toxic text stand for."""
    y = np.array(toxic, np.int64)
    model = Model()
    if not len(y) or y.min() == y.max():
        return _unknowing(int((1 - y).sum()))
    tokens = [TOKEN.findall(t) for t in texts]
    seen: dict[str, list[str]] = {}
    counts = (Counter(), Counter())
    for words, label, text in {t: (w, i, t) for w, i, t in zip(tokens, toxic, texts)}.values():  # copies count once
        found = set()
        for word in words:
            if word not in seen:
                seen[word] = features(word)
            found.update(seen[word])
        counts[label].update(found)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    names = [f for f, n in counts[1].items() if n + counts[0][f] >= 4]
    stands = _standing_out(np.array([counts[1][f] for f in names], float), np.array([counts[0][f] for f in names], float), n1, n0)
    telling = {f for f, s in zip(names, stands) if s >= 20}
    used = {f: i for i, f in enumerate(f for f, s in zip(names, stands) if abs(s) >= 8)}
    kinds = {w: i for i, w in enumerate(seen)}
    marked = np.array([any(f in telling for f in fs) for fs in seen.values()])
    links = [(kinds[w], used[f]) for w, fs in seen.items() for f in fs if f in used]
    rows, columns = (np.array(v, np.int64) for v in zip(*links)) if links else (np.empty(0, np.int64),) * 2
    lengths = np.array([len(w) for w in tokens])
    at = np.array([kinds[w] for ws in tokens for w in ws], np.int64)
    label = marked[at] & (np.repeat(y, lengths) == 1)
    chain = Chain(lengths)
    before = np.concatenate(([False], label[:-1]))
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    real_steps = np.array([[np.sum(~before & ~label), np.sum(~before & label)], [np.sum(before & ~label), np.sum(before & label)]], float)
    known = np.bincount(at, weights=label, minlength=len(kinds))
    params = np.concatenate((np.zeros(len(used)), [model.bias], np.zeros(4)))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for epoch in range(1, epochs + 1):
        weights, bias, steps = params[: len(used)], params[len(used)], params[len(used) + 1 :].reshape(2, 2)
        kind_scores = bias + np.bincount(rows, weights=weights[columns], minlength=len(kinds))
        marginals, expected = chain.run(kind_scores[at], steps, pairs=True)
        off = np.bincount(at, weights=marginals, minlength=len(kinds)) - known
        gradient = np.concatenate((np.bincount(columns, weights=off[rows], minlength=len(used)), [off.sum()], (expected - real_steps).ravel()))
        gradient += 0.05 * np.concatenate((weights, np.zeros(5)))
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.95 * square + 0.05 * gradient**2
        params = params - 0.5 * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.95**epoch)) + 1e-8)
    model.weights = {f: float(params[i]) for f, i in used.items() if abs(params[i]) > 0.02}
    if not model.weights:
        return _unknowing(n0)
    model.bias, model.steps = float(params[len(used)]), params[len(used) + 1 :].reshape(2, 2)
    scores = model.bias + np.bincount(rows, weights=params[: len(used)][columns], minlength=len(kinds))
    summaries = _summaries(chain.run(scores[at], model.steps), lengths)
    model.curve = _curve(summaries, y, np.where(y == 1, shares[1], shares[0]))
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """A model of labels.toxic (0 or 1), learnt from at most ``sample`` documents outside the held-out fold.

    The sample is taken of labelled documents that are there, by the hash of their ids, so labels of other documents change
    nothing. Rows with a null id, text or label are no training rows; of several labels for an id the largest
    counts. Without rows of both labels, or words that tell them apart, the model calls nothing toxic.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    texts = docs.where((F.col("text").isNotNull()) & (F.length("text") <= sample.longest)).select("doc_id", "text")
    # ids alone meet the labels; texts are fetched for the bounded sample only
    there = stored(texts.select("doc_id").distinct().join(known, "doc_id"), "toxicity-labelled")
    bounds = {1: sample.toxic, 0: sample.clean}
    totals = {r["toxic"]: r["n"] for r in there.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    least = [there.where(F.col("toxic") == label).orderBy(*order).limit(bound) for label, bound in bounds.items()]
    chosen = stored(least[0].unionByName(least[1]), "toxicity-chosen")
    fetched = stored(texts.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    rows = []
    for label, bound in bounds.items():
        rows += fetched.where(F.col("toxic") == label).orderBy(*order, "text").limit(bound).select("text", "toxic").collect()
    taken = Counter(r["toxic"] for r in rows)
    shares = tuple(totals.get(i, 0) / max(1, taken[i]) for i in (0, 1))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], shares, sample.epochs)


class Judge:
    """Scores of texts under a model; keeps the emission scores of words that it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts, marginals of all their tokens in order, and token counts."""
        m, known, values, lengths = self.model, self.known, [], []
        for text in texts:
            words = TOKEN.findall(text)
            for word in set(words).difference(known):
                known[word] = m.bias + sum(m.weights.get(f, 0.0) for f in features(word))
            values += map(known.__getitem__, words)
            lengths.append(len(words))
        if len(known) > REMEMBERED:
            known.clear()
        counts = np.array(lengths, np.int64)
        marginals = Chain(counts).run(np.array(values), m.steps) if values else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(_summaries(marginals, counts) @ m.curve, -30, 30))), marginals, counts


def _spans(text: str, marginals: np.ndarray) -> list[dict]:
    if not len(marginals) or marginals.max() <= 0.5:
        return []
    return [
        {"start": w.start(), "end": w.end(), "marginal": float(p)} for w, p in zip(TOKEN.finditer(text), marginals) if p > 0.5
    ]


def _handfuls(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Texts of about ``TOGETHER`` characters, with their first place and the one after; nulls are empty texts."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    for lo, hi in runs(sizes, TOGETHER):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, predicted, spans (start, end, marginal).

    Spans are the tokens whose marginal is above a half, in characters of the whole text. Null and empty
    texts, and texts without letters, get the score of no evidence. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            for lo, hi, texts in _handfuls(batch.column(1)):
                scores, marginals, counts = judge(texts)
                ends = np.cumsum(counts)
                spans = [_spans(t, marginals[e - n : e]) for t, e, n in zip(texts, ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                        pa.array(spans, span),
                    ],
                    ["doc_id", "score", "predicted", "spans"],
                )
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for later stages

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, spans array<struct<start: long, end: long, marginal: double>>"
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            for lo, hi, texts in _handfuls(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(judge(texts)[0] < threshold))
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for later stages

    return docs.mapInArrow(run, docs.schema)
