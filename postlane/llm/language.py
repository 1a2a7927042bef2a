"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlane.llm.common import blocks, mix, pick_rows, texts_of

#: Buckets that n-grams are hashed to, characters in the longest n-gram, labelled rows that the model is fitted on,
#: and rows of each language at any rate: SAMPLE + LEAST for each language at most.
BUCKETS, LONGEST, SAMPLE, LEAST = 1 << 15, 3, 2400, 150
#: A text whose best language has less than this probability is rejected.
MIN_CONFIDENCE = 0.5
#: Bytes of texts, and characters of a long one, that are cut into n-grams at a time: what is made of them takes over a hundred times the room.
_PIECE = 1 << 18

_CODES = 1 << 16
_IDEOGRAPHS = 0x20000  #: what of the characters beyond _CODES counts as letters begins here
_LETTER = np.array([chr(c).isalpha() for c in range(_CODES)])
_LOWER = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_CODES)], np.uint32)


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of UTF-8 bytes, the texts' offsets among them)."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = raw[at].astype(np.uint32)
    padded = np.r_[raw, np.zeros(3, np.uint8)]
    code = first.copy()
    for low, high, n, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        some = np.flatnonzero((first >= low) & (first < high))
        if len(some):
            c = first[some] & mask
            for j in range(1, n + 1):
                c = c << 6 | (padded[at[some] + j] & 0x3F)
            code[some] = c
    return code, np.searchsorted(at, offsets)


def _buckets(low: np.ndarray, letter: np.ndarray, text: np.ndarray, starts: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram that begins at the first `starts` characters, lies in one text and has a letter."""
    texts, found = [], []
    code = np.zeros(len(low), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            m = len(low) - n + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(1)
            some = letter[:m].copy()
            for j in range(1, n):
                some |= letter[j : j + m]
            some &= text[:m] == text[n - 1 :]
            some[starts:] = False
            at = np.flatnonzero(some)
            h = code[at] * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            texts.append(text[at])
            found.append(h & np.uint32(buckets - 1))
    return np.concatenate(texts), np.concatenate(found)


def ngram_counts(text: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first row, row after the last, row, bucket, count): the n-grams of 1 to LONGEST characters of each text, by row and bucket.

    Case is folded and all that isn't a letter reads as a space; an n-gram of spaces alone doesn't count. One long
    text is cut into pieces whose counts are summed.
    """
    for first, last, raw, offsets in blocks(text, _PIECE):
        code, at = characters(raw, offsets)
        known = np.minimum(code, _CODES - 1)
        letter = _LETTER[known] | (code >= _IDEOGRAPHS)
        low = np.where(letter, np.where(code < _CODES, _LOWER[known], code), np.uint32(32))
        of = np.repeat(np.arange(last - first, dtype=np.uint32), np.diff(at))
        if last - first == 1:
            n = np.zeros(buckets, np.int64)
            for a in range(0, len(low), _PIECE):
                part = slice(a, a + _PIECE + LONGEST - 1)
                n += np.bincount(_buckets(low[part], letter[part], of[part], _PIECE, buckets)[1], minlength=buckets)
            bucket = np.flatnonzero(n)
            row, count = np.zeros(len(bucket), np.int64), n[bucket]
        elif len(low):
            row, bucket = _buckets(low, letter, of, len(low), buckets)
            wide = np.uint32 if (last - first) * buckets <= 1 << 32 else np.uint64
            key = row.astype(wide) * wide(buckets) + bucket.astype(wide)
            key.sort()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            count = np.diff(np.r_[cut, len(key)])
            row, bucket = (x.astype(np.int64) for x in np.divmod(key[cut], wide(buckets)))
        else:
            continue
        yield first, last, first + row, bucket, count


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for _, _, row, bucket, _ in ngram_counts(b.column(0)):
            df += np.bincount(bucket, minlength=BUCKETS)
            n += int((np.diff(row) > 0).sum()) + (len(row) > 0)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], ["bucket", "n"])


def inverse_document_frequency(docs: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the bucket)) + 1, over all documents that have letters."""
    rows = texts_of(docs).select("text").where("text IS NOT NULL").mapInArrow(_document_frequency, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    n = next((r["n"] for r in rows if r["bucket"] < 0), 0)
    for r in rows:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    return np.log((1 + n) / (1 + df)) + 1


def vectors(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each row begins, values of length 1 for each row)."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    x = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.add.reduceat(x * x, start)) if len(start) else x
    return start, x / np.repeat(norm, np.diff(np.r_[start, len(row)]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Weights, a bucket and class each, most of them zero; idf; the temperature that makes probabilities honest."""

    def __init__(self, classes: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float) -> None:
        self.classes, self.weights, self.idf, self.temperature = classes, weights, idf, temperature

    def probabilities(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have letters, their probabilities)."""
        rows, logits = [np.zeros(0, np.int64)], [np.zeros((0, len(self.classes)))]
        for _, _, row, bucket, count in ngram_counts(text, len(self.idf)):
            start, x = vectors(row, bucket, count, self.idf)
            rows.append(row[start])
            if len(start):
                logits.append(np.stack([np.add.reduceat(x * w[bucket], start) for w in self.weights.T], axis=1))
        return np.concatenate(rows), softmax(np.concatenate(logits) / self.temperature)


def follow_the_regularised_leader(data: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal with elastic-net penalties on (buckets, values, class)."""
    z, n, w = np.zeros((buckets, classes)), np.zeros((buckets, classes)), np.zeros((buckets, classes))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, y = data[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(x @ wi)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g * g
    big = np.abs(z) > l1
    w[big] = (-(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))[big]
    return w


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, between 0.02 and 50, with the least log loss on rows that the weights weren't fitted on."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi = np.log(0.02), np.log(50.0)
    for _ in range(60):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each text in place of the text: at most BUCKETS numbers, however long it is."""
    for b in batches:
        found = [(np.zeros(0, np.uint16), np.zeros(0, np.float32))] * b.num_rows
        for _, _, row, bucket, count in ngram_counts(b.column(2)):
            cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            for a, z in zip(cut, np.r_[cut[1:], len(row)]):
                found[row[a]] = bucket[a:z].astype(np.uint16), count[a:z].astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], ["doc_id", "label", "bucket", "count"])


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> Model | None:
    """Fit on labelled rows, see pick_rows(); every fourth row of a label is kept for the temperature.

    Every label that a row with a doc_id and a text has is a class. The idf counts all documents. None where no row
    can be used.
    """
    picked = pick_rows(docs, sample, label, least).mapInArrow(_counted, "doc_id bigint, label string, bucket binary, count binary")
    rows = sorted(picked.collect(), key=lambda r: (r["label"], int(mix(np.array([r["doc_id"]]))[0]), r["doc_id"]))
    classes = sorted({r["label"] for r in rows})
    if not classes:
        return None
    idf = inverse_document_frequency(docs)
    fit, held = [], []
    for k, r in enumerate(rows):
        bucket, count = np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["count"], np.float32)
        if len(bucket):
            (held if k % 4 == 0 else fit).append((bucket, vectors(np.zeros(len(bucket), np.int64), bucket, count, idf)[1], classes.index(r["label"])))
    weights = follow_the_regularised_leader(fit or held, len(classes), len(idf))
    logits = np.array([x @ weights[at] for at, x, _ in held]).reshape(len(held), len(classes))
    return Model(classes, weights.astype(np.float32), idf.astype(np.float32), temperature(logits, np.array([y for *_, y in held], int)))


def _labels(model: Model | None, min_confidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.full(b.num_rows, None, object)
            confidence = np.zeros(b.num_rows)
            if model is not None:
                rows, p = model.probabilities(b.column(1))
                if len(rows):
                    best = p.argmax(axis=1)
                    lang[rows] = np.array(model.classes, object)[best]
                    confidence[rows] = p[np.arange(len(rows)), best]
            keep = confidence >= min_confidence
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(confidence), pa.array(keep)], ["doc_id", "language", "confidence", "keep"])

    return run


def identify(docs: DataFrame, model: Model | None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, language, confidence, keep), a row for each of docs; keep where confidence reaches min_confidence.

    Texts that are null, empty or without a letter have no language, confidence 0, and are rejected, as are all texts
    where there was nothing to learn from. Equal probabilities go to the language that comes first by name. Repeated rows and null doc_ids
    keep their rows. Texts are used whole; columns other than doc_id and text are left out.
    """
    return texts_of(docs).mapInArrow(_labels(model, min_confidence), "doc_id bigint, language string, confidence double, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified. See identify()."""

    names = docs.columns
    at = names.index("text")
    run = _labels(model, min_confidence)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(at)], ["doc_id", "text"])
            for out in run(iter([two])):
                yield b.filter(out.column(3))

    return docs.mapInArrow(some, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
