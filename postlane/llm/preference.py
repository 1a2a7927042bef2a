"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlane.llm.common import blocks, mix, pick_rows, settle, texts_of, uniform
from postlane.llm.words import ALNUM, Hasher, lower, spans

#: Labelled rows that the model is fitted on, rows of either kind at any rate, preferred documents that each other one
#: is paired with, and documents of the sample that a word must occur in to be a feature.
SAMPLE, LEAST, PAIRS, LEAST_DOCS = 4000, 400, 8, 4
#: Bytes of the prefixes that are features beside whole words: inflected and compound words share them.
PREFIXES = (5, 7)
#: The share of preferred labelled documents that may fall under the threshold.
LOSS = 0.005

_MASKS = np.zeros((256, 6), np.int64)
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), (10,), (9, 32), (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))):
    _MASKS[list(_set), _k] = 1
SHAPES = ("capitals", "digits", "lines", "marks", "word length", "repeated words", "same as before", "few words", "marks a word")


def features(text: pa.Array, hasher: Hasher | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first row, row after the last, shapes of each row, row of each word and each prefix, its hash)."""
    hasher = hasher or Hasher()
    for first, last, raw, offsets in blocks(text):
        n = last - first
        size = np.maximum(np.diff(offsets), 1)
        count = np.zeros((n, 6))
        full = np.flatnonzero(np.diff(offsets))
        for k in range(6):
            if len(full):
                count[full, k] = np.add.reduceat(_MASKS[raw, k], offsets[full])
        low = lower(raw)
        starts, ends, of = spans(low, offsets, ALNUM)
        rows, hashes = [of], [hasher(low, starts, ends)]
        for k in PREFIXES:
            longer = np.flatnonzero(ends - starts > k)
            rows.append(of[longer])
            hashes.append(mix(hasher.again(starts[longer], starts[longer] + k) + np.uint64(k)))
        h = hashes[0]
        words = np.bincount(of, minlength=n)
        some = np.maximum(words, 1)
        _, at = np.unique(h ^ mix(of), return_index=True)
        distinct = np.bincount(of[at], minlength=n)
        same = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
        letters = np.maximum(count[:, 0] + count[:, 1], 1)
        shape = np.stack(
            [count[:, 0] / letters, count[:, 2] / size, count[:, 3] / some, count[:, 5] / size, np.bincount(of, ends - starts, minlength=n) / some, 1 - distinct / some, same / some, 1 / (1 + words), np.minimum(count[:, 5] / some, 1)],
            axis=1,
        )
        yield first, last, shape, first + np.concatenate(rows), np.concatenate(hashes)


def _once(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, at = np.unique(h ^ mix(row), return_index=True)
    return row[at], h[at]


class Ranker:
    """score = shapes, standardised, and the presence of words and prefixes, each with its weight; higher is better."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, words: np.ndarray, word_weights: np.ndarray) -> None:
        order = np.argsort(words)
        self.mean, self.spread, self.weights, self.words, self.word_weights = mean, spread, weights, words[order], word_weights[order]

    def scores(self, text: pa.Array, hasher: Hasher | None = None) -> np.ndarray:
        out = np.zeros(len(text))
        for first, last, shape, row, h in features(text, hasher):
            out[first:last] = np.clip((shape - self.mean) / self.spread, -6, 6) @ self.weights
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                hit = self.words[at] == h
                row, h = _once(row[hit], h[hit])
                np.add.at(out, row, self.word_weights[np.searchsorted(self.words, h)])
        return out


class _Sparse:
    """Dense columns and, after them, columns of zeros and ones given by the places of the ones."""

    def __init__(self, dense: np.ndarray, row: np.ndarray, column: np.ndarray, columns: int) -> None:
        self.dense, self.row, self.column, self.shape = dense, row.astype(np.int32), column.astype(np.int32), (len(dense), dense.shape[1] + columns)

    def times(self, w: np.ndarray) -> np.ndarray:
        d = self.dense.shape[1]
        return self.dense @ w[:d] + np.bincount(self.row, w[d:][self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([self.dense.T @ g, np.bincount(self.column, g[self.row], self.shape[1] - self.dense.shape[1])])


def bradley_terry(x: _Sparse, better: np.ndarray, worse: np.ndarray, *, l1: float = 3e-5, l2: float = 1e-4, rounds: int = 250) -> np.ndarray:
    """Weights that minimise the mean of ln(1 + exp(-(x[better] - x[worse]) w)) with elastic-net penalties, by accelerated proximal steps."""
    w = v = np.zeros(x.shape[1])
    rate, momentum = 0.5, 1.0
    loss_at = lambda s: np.logaddexp(0, -(s[better] - s[worse])).mean()
    for _ in range(rounds):
        s = x.times(v)
        p = -1 / (1 + np.exp(s[better] - s[worse])) / len(better)
        g = x.back(np.bincount(better, p, x.shape[0]) - np.bincount(worse, p, x.shape[0])) + l2 * v
        here = loss_at(s) + l2 / 2 * v @ v
        while True:
            new = v - rate * g
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            d = new - v
            if loss_at(x.times(new)) + l2 / 2 * new @ new <= here + g @ d + d @ d / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        step = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v = new + (momentum - 1) / step * (new - w)
        w, momentum = new, step
        rate *= 1.2
    return w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shapes and the different words of each text in place of the text."""
    hasher = Hasher()
    for b in batches:
        shapes, words = np.zeros((b.num_rows, len(SHAPES))), [b""] * b.num_rows
        for first, last, shape, row, h in features(b.column(2), hasher):
            shapes[first:last] = shape
            row, h = _once(row, h)
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
            for k, (a, z) in enumerate(zip(*(np.searchsorted(row, np.arange(first, last), s) for s in ("left", "right"))), first):
                words[k] = np.sort(h[a:z]).tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in shapes], pa.binary()), pa.array(words, pa.binary())], ["doc_id", "label", "shape", "words"])


def fit(shapes: np.ndarray, words_of: list[np.ndarray], preferred: np.ndarray, pairs: int = PAIRS, least_docs: int = LEAST_DOCS) -> Ranker | None:
    """Pair each document that isn't preferred with `pairs` that are, and learn; None where one kind is missing."""
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    if not len(good) or not len(bad):
        return None
    row, h = np.repeat(np.arange(len(words_of), dtype=np.int32), [len(x) for x in words_of]), np.concatenate(words_of)
    words, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    common = n >= least_docs
    column = np.cumsum(common) - 1
    use = common[inverse]
    mean, spread = shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 1e-6)
    x = _Sparse(np.clip((shapes - mean) / spread, -6, 6), row[use], column[inverse[use]], int(common.sum()))
    worse = np.repeat(bad, pairs)
    better = good[(uniform(worse, np.arange(len(worse))) * len(good)).astype(int)]
    w = bradley_terry(x, better, worse)
    ww = w[len(SHAPES) :]
    return Ranker(mean, spread, w[: len(SHAPES)], words[common][ww != 0], ww[ww != 0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Ranker | None:
    """Fit on labelled documents, see pick_rows(); those of quality 1 that aren't toxic are preferred to the others. The driver gets the sample's features, 8 bytes for each different word or prefix of a document."""
    both = _labelled(docs.select("doc_id", "text"), labels)
    picked = pick_rows(both, sample, "preferred", least).mapInArrow(_featured, "doc_id bigint, label string, shape binary, words binary")
    rows = sorted(picked.collect(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    shapes = np.stack([np.frombuffer(r["shape"]) for r in rows])
    return fit(shapes, [np.frombuffer(r["words"], np.uint64) for r in rows], np.array([r["label"] == "true" for r in rows], bool))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `preferred`; several labels of a document must all prefer it; labels with a null don't count."""
    sound = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    one = sound.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("preferred"))
    return docs.join(one, "doc_id")


def _score(ranker: Ranker | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            s = ranker.scores(b.column(1), hasher) if ranker else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """(doc_id, score), a row for each of docs. A null text scores as an empty one; without a ranker all score 0."""
    return texts_of(docs).mapInArrow(_score(ranker), "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, loss: float = LOSS) -> DataFrame:
    """(doc_id, score, keep), a row for each of docs; keep where the score reaches the threshold.

    The threshold is the `loss` quantile of the scores of all labelled documents that are preferred, so that at most
    that share of them is lost, at any size. Ties at the threshold are kept. Where labels have no pair of a preferred
    document and another, all score 0 and are kept. Repeated rows and null doc_ids keep their rows; null and empty
    texts are scored as texts without words. Texts are used whole; other columns are left out.
    """
    found = settle(score(docs, train(docs, labels, sample)), "scores")
    good = _labelled(found, labels).where("preferred")
    least = good.agg(F.percentile_approx("score", loss, 100_000)).first()[0]
    return found.withColumn("keep", F.col("score") >= F.lit(float("-inf") if least is None else float(least)))


def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).where("keep")
