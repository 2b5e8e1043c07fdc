"""Language identification of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, texts

#: Rows of feature weights; with one column for each language this is the size of a model.
BUCKETS = 1 << 15
#: Documents that a model is fitted on at most, as many of each language (but LEAST even of the rarest): those with the smallest hashes of their ids.
SAMPLE, LEAST = 600, 20
#: Bytes of a text that a model is fitted on; longer ones are left out of the sample, which so is bounded on the driver.
LONGEST = 1 << 18
#: Words whose emissions a worker remembers; then it forgets them and starts again.
REMEMBERED = 200_000
#: Letters of the words and features that are remembered; longer ones count as well but are looked at anew.
LONG = 64
#: Words of a block, within which a chain is followed; blocks go side by side.
BLOCK = 128


class Grams(dict):
    """Feature -> its bucket, made when first asked for."""

    def __missing__(self, feature: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS
        if len(feature) <= LONG + 1:
            self[feature] = got
        return got


_grams = Grams()


def letters_of(word: str) -> str:
    """A lower-cased word's letters, all of them: where a script has no spaces a word may be a whole text."""
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def word_features(letters: str) -> list[int]:
    """Buckets of a word's letters: lexicon (the word itself), affixes of two and three letters, and letter triples."""
    padded = f"<{letters}>"
    return [_grams[f] for f in ("w" + letters, "p" + letters[:2], "p" + letters[:3], "s" + letters[-2:], "s" + letters[-3:], *[padded[i : i + 3] for i in range(len(padded) - 2)])]


def marginals(emit: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end.

    ``emit`` (N, K) has positive scores; ``first`` marks where a chain begins. All chains are cut into
    blocks of BLOCK words that are followed side by side: the product of each block's matrices carries
    exact messages across blocks. Gives each word's label probabilities (N, K) and, if ``count``, the
    expected number of moves between labels (K, K).
    """
    n, k = emit.shape
    rows = -(-n // BLOCK)
    e = np.ones((rows * BLOCK, k))
    e[:n] = emit
    f = np.zeros(rows * BLOCK, bool)
    f[:n] = first
    f[n:] = True
    e, f = e.reshape(rows, BLOCK, k).transpose(1, 0, 2), f.reshape(rows, BLOCK).T
    e, ends = np.ascontiguousarray(e), [np.flatnonzero(x) for x in f]
    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(BLOCK):
        go = (product.reshape(-1, k) @ move).reshape(rows, k, k)
        if len(r := ends[t]):
            go[r] = product[r].sum(2, keepdims=True) * start
        go *= e[t][:, None, :]
        product = go if t & 3 else go / go.reshape(rows, -1).sum(1)[:, None, None]
    enter, leave = np.empty((rows, k)), np.empty((rows, k))
    a, b = np.full(k, 1.0 / k), np.full(k, 1.0 / k)
    for r in range(rows):
        enter[r] = a
        a = a @ product[r]
        a /= a.sum()
        q = rows - 1 - r
        leave[q] = b
        b = product[q] @ b
        b /= b.sum()
    forward = np.empty((BLOCK, rows, k))
    before = np.empty((BLOCK, rows, k))
    a = enter
    for t in range(BLOCK):
        before[t] = a
        go = a @ move
        if len(r := ends[t]):
            go[r] = start
        a = go * e[t]
        a /= a.sum(1, keepdims=True)
        forward[t] = a
    moves = np.zeros((k, k))
    post = np.empty((BLOCK, rows, k))
    b = leave
    for t in range(BLOCK - 1, -1, -1):
        post[t] = forward[t] * b
        eb = e[t] * b
        if count:
            inside = ~f[t]
            pair = before[t][inside][:, :, None] * move * eb[inside][:, None, :]
            moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = eb @ move.T
        if len(r := ends[t]):
            b[r] = 1.0
        b /= b.sum(1, keepdims=True)
    post /= post.sum(2, keepdims=True)
    return post.transpose(1, 0, 2).reshape(-1, k)[:n], moves


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """A fitted field: ``weights`` (BUCKETS, K) of word features, ``move`` (K, K) and ``start`` (K,)."""

    def __init__(self, langs: list[str], weights: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.langs, self.weights, self.move, self.start = langs, weights, move, start
        self.forget()

    def __getstate__(self):
        return self.langs, self.weights, self.move, self.start

    def __setstate__(self, s):
        self.__init__(*s)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.size = 0
        self.table = np.empty((0, len(self.langs)), np.float32)

    def row(self, word: str, new: list[list[int]]) -> int:
        """Row of the table that has a word's emissions, made after the batch; -1 for a word without letters."""
        letters = letters_of(word)
        if not letters:
            at = -1
        elif (at := self.rows.get(letters, -1)) < 0:
            at = self.size
            self.size += 1
            new.append(word_features(letters))
            if len(letters) <= LONG:
                self.rows[letters] = at
        if len(word) <= 2 * LONG:
            self.known[word] = at
        return at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language with the most expected words, and its share of them."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if max(len(self.known), self.size) > REMEMBERED:
            self.forget()
        ids, lengths = [], []
        new: list[list[int]] = []
        known, row = self.known, self.row
        for t in texts:
            words = (t or "").lower().split()
            got = np.fromiter([known[w] if w in known else row(w, new) for w in words], np.int64, len(words))
            got = got[got >= 0]
            ids.append(got)
            lengths.append(len(got))
        if new:
            sums = np.add.reduceat(self.weights[np.concatenate(new)], np.cumsum([0, *map(len, new[:-1])]), axis=0)
            self.table = np.concatenate((self.table, np.exp(np.maximum(sums - sums.max(1, keepdims=True), -30))))
        n = np.array(lengths)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not n.sum():
            return out
        full = np.flatnonzero(n)
        begin = np.cumsum(n[full]) - n[full]
        first = np.zeros(n.sum(), bool)
        first[begin] = True
        post, _ = marginals(self.table[np.concatenate(ids)].astype(np.float64), first, self.move, self.start)
        share = np.add.reduceat(post, begin, axis=0) / n[full][:, None]
        for i, s in zip(full.tolist(), share, strict=True):
            best = int(s.argmax())
            out[i] = (self.langs[best], float(min(1.0, s[best])))
        return out


def fit(rows: list[tuple[str, str]], epochs: int = 12, rate: float = 0.5) -> Model:
    """A field fitted on (text, lang) rows by gradient ascent of the words' conditional likelihood (AdaGrad).

    Every word of a text starts with the text's label; as texts switch languages, the words whose label
    the field doubts after a third of the epochs get the label that it finds most probable.
    """
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    ids: dict[str, int] = {}
    vocab: list[list[int]] = []
    chains, labels = [], []
    for text, lang in rows:
        got = []
        for w in text.lower().split():
            if w not in ids:
                letters = letters_of(w)
                ids[w] = len(vocab) if letters else -1
                if letters:
                    vocab.append(word_features(letters))
            if ids[w] >= 0:
                got.append(ids[w])
        if got:
            chains.append(np.array(got))
            labels.append(np.full(len(got), langs.index(lang)))
    weights, logmove, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.full(k, 1.0 / max(k, 1))
    if not chains:
        return Model(langs, weights.astype(np.float32), np.full((k, k), 1.0 / max(k, 1)), start)
    seq, gold = np.concatenate(chains), np.concatenate(labels)
    first = np.zeros(len(seq), bool)
    first[np.cumsum([len(c) for c in chains]) - [len(c) for c in chains]] = True
    feature = np.concatenate([np.array(v) for v in vocab])
    owner = np.repeat(np.arange(len(vocab)), [len(v) for v in vocab])
    begin = np.cumsum([len(v) for v in vocab]) - [len(v) for v in vocab]
    sum_w, sum_m = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    inside = np.flatnonzero(~first)
    for epoch in range(epochs):
        emit = np.add.reduceat(weights[feature], begin, axis=0)
        emit = np.exp(np.maximum(emit - emit.max(1, keepdims=True), -30))
        move = softmax(logmove)
        post, moves = marginals(emit[seq], first, move, start, count=True)
        if epoch == epochs // 3:
            best = post.argmax(1)
            gold = np.where(post[np.arange(len(seq)), gold] < 0.2, best, gold)
        diff = -post
        diff[np.arange(len(seq)), gold] += 1
        by_word = np.stack([np.bincount(seq, diff[:, j], len(vocab)) for j in range(k)], 1)
        g = np.stack([np.bincount(feature, by_word[owner, j], BUCKETS) for j in range(k)], 1) - 1e-3 * weights
        sum_w += g * g
        weights += rate * g / np.sqrt(sum_w)
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[inside - 1], gold[inside]), 1)
        g = seen - moves - 1e-3 * logmove
        sum_m += g * g
        logmove += rate * g / np.sqrt(sum_m)
    return Model(langs, weights.astype(np.float32), softmax(logmove), start)


def train(docs: DataFrame, learn_on: Column, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits a model on about ``sample`` documents with a language, of those that ``learn_on`` admits.

    The sample has as many documents of each language, or all there are, but at least LEAST: those with the smallest
    hashes of their ids, found before any text is read. Whole texts of only these documents reach the
    driver; texts of over LONGEST bytes are left out. Of several rows of one id the smallest counts.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang")).where(learn_on & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    many = ids.agg(F.count_distinct("lang")).first()[0]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= max(LEAST, sample // max(many, 1))).select("doc_id").distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    met = rows.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= LONGEST)
    got = met.groupBy("doc_id").agg(F.min(F.struct("lang", F.make_valid_utf8("text").alias("text"))).alias("r")).collect()
    return fit([(r["r"]["text"], r["r"]["lang"]) for r in sorted(got, key=lambda r: r["doc_id"])])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, lang_pred, score) for each document, from its whole text alone.

    ``score`` is the expected share of the text's words that are in ``lang_pred``. Texts that are null or
    have no letter give ``und`` with score 0, as does every text under a model without languages. Of
    languages with equal shares the first by name is given.
    Repeated rows are predicted each; other columns are left out.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            got = sent.value.predict(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
