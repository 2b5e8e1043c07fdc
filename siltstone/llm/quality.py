"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, texts

#: Weights of a model: their number is fixed, so a model is 1 MB whatever the corpus.
BUCKETS = 1 << 18
#: Labelled documents that a model is fitted on at most; those with the smallest hashes of their ids.
SAMPLE = 3000
#: Bytes of a text that a model is fitted on; longer ones are left out of the sample, which so is bounded on the driver.
LONGEST = 1 << 18
#: Words that a worker remembers; then it forgets them and starts again.
REMEMBERED = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


RUNS = re.compile(r"(.)\1+")
OUTLINE = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "0")})
ENDS = "!\"#$%&'()*+,-./:;<=>?@[]^_|~"


def shape(word: str) -> str:
    """A word's outline: runs of upper case, lower case, digits and other marks, each run once."""
    core = word.rstrip(ENDS)
    end = word[len(core) :]
    if len(end) > 1:
        end = RUNS.sub(r"\1", end)
    if core.islower() and core.isalpha():
        return "a" + end
    if core.isalpha() and core.isupper():
        return "A" + end
    if core.isalpha() and core.istitle():
        return "Aa" + end
    if not core.isascii():
        core = "".join("a" if c.islower() else "A" if c.isupper() else "u" if c.isalpha() else "0" if c.isdigit() else c if c < "\x80" else "*" for c in core)
    return RUNS.sub(r"\1", core.translate(OUTLINE)) + end


class Words(dict):
    """Word -> (its hash, its outline's hash) packed in one number, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = zlib.crc32(word.encode("utf-8", "replace")) << 32 | _outlines[shape(word)]
        if len(word) <= 64:
            self[word] = got
        return got


class Outlines(dict):
    def __missing__(self, outline: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = zlib.crc32(outline.encode("utf-8", "replace"), 7)
        if len(outline) <= 64:
            self[outline] = got
        return got


_words, _outlines = Words(), Outlines()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and value of each n-gram occurrence of a whole text.

    The n-grams are words, pairs of words, and runs of one, two and three outlines of words, in which a
    word that repeats the one before has an outline of its own. Each kind sums to 1.
    """
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return np.zeros(1, np.int64), np.ones(1, np.float64)
    packed = np.fromiter(map(_words.__getitem__, tokens), np.uint64, n)
    word, outline = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    again = np.concatenate(([False], packed[1:] == packed[:-1]))
    outline = np.where(again, np.uint64(1), outline)
    kinds = [word, word[:-1] * np.uint64(31) + word[1:], outline + np.uint64(1 << 40)]
    kinds += [outline[:-1] * np.uint64(37) + outline[1:] + np.uint64(1 << 41)]
    kinds += [(outline[:-2] * np.uint64(37) + outline[1:-1]) * np.uint64(37) + outline[2:] + np.uint64(1 << 42)]
    at = [((k * MIX) >> np.uint64(46)).astype(np.int64) for k in kinds]
    return np.concatenate(at), np.concatenate([np.full(len(k), 1.0 / max(len(k), 1)) for k in at])


def summed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    at, v = features(text)
    at, where = np.unique(at, return_inverse=True)
    return at, np.bincount(where, v)


class Leader:
    """Follow-the-regularised-leader for logistic loss, each weight with its own rate."""

    def __init__(self, alpha: float = 0.8, beta: float = 0.05, l1: float = 0.002, l2: float = 0.002):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, v: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip((w * v).sum() + self.bias, -35, 35)))
        g = (p - y) * v * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias -= 0.02 * (p - y) * weight


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        at, v = features(text)
        return float(1 / (1 + np.exp(-np.clip((self.weights[at] * v).sum() + self.bias, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6) -> Model:
    """A model of (buckets, values, label) rows, in the order given; each label weighs as much in all."""
    ones = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * max(ones, 1)), 0: len(rows) / (2 * max(len(rows) - ones, 1))}
    leader = Leader()
    for _ in range(epochs):
        for at, v, y in rows:
            leader.learn(at, v, y, weight[y])
    return Model(leader.weights(slice(None)).astype(np.float32), leader.bias)


def train(docs: DataFrame, labels: DataFrame, learn_on: Column, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits a model on at most ``sample`` labelled documents of those that ``learn_on`` (on doc_id) admits.

    The sample is that of the smallest hashes of the ids; its n-grams are taken from whole texts on the
    executors, and only they reach the driver; texts of over LONGEST bytes are left out. Null labels and ids are left out; of several labels of one
    document the smallest counts. Without labelled rows every score is 0.5.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(learn_on).groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [summed(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([a for a, _ in got], pa.list_(pa.int64())), pa.array([v for _, v in got], pa.list_(pa.float64()))],
                names=["doc_id", "y", "at", "v"],
            )

    rows = whole.join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, at array<long>, v array<double>").toArrow()
    order = np.argsort([zlib.crc32(str(i).encode()) for i in rows.column("doc_id").to_pylist()], kind="stable")
    at, v, y = rows.column("at"), rows.column("v"), rows.column("y")
    return fit([(at[i].values.to_numpy(), v[i].values.to_numpy(), y[i].as_py()) for i in order.tolist()])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, score, predicted) for each document, scored on its whole text alone.

    Null and empty texts have the score of a text without n-grams. Repeated rows are scored each; other
    columns are left out.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = [sent.value.score(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that the model does not reject, with the columns they came with.

    Scores travel with their rows, so nothing is joined or shuffled.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array([sent.value.score(t) >= threshold for t in texts(b.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
