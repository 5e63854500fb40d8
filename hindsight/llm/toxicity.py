"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings and ends,
so that unseen forms of a known stem still say something. Filters of several widths slide over
the whole text; each keeps its maximum, and a logistic layer reads the maxima. Embeddings start
near zero: a word that training never met adds nearly nothing, however long the text.

The language whose threshold holds for a text is told from the text's own function words. A
text's score is the logistic of its distance from that threshold, so 0.5 is the threshold in
every language.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, empty_as, slices, texts_of

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKETS = 1 << 18
PARTS = 8
EPOCHS = 12
BATCH = 32
#: Fewer labelled rows are passed over more often, for about this many steps.
LEAST_STEPS = 800
#: Labelled rows of each class that are fitted, rows that are kept for the thresholds, and bytes of text of both.
FIT_ROWS = 1500
CALIBRATION_ROWS = 1500
SAMPLE_BYTES = 48_000_000

FUNCTION_WORDS = {
    "en": frozenset("the of and to in is that for it with as on was be at by this are from or have an they which not but".split()),
    "de": frozenset("der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach".split()),
    "fr": frozenset("le les et des est dans qui pour une que sur pas par du au ce il avec sont plus mais ne se la un de en".split()),
    "es": frozenset("el los las y del con por para una que su al lo como más pero sus se le ya o este la un de en es".split()),
}
LANGUAGES = tuple(FUNCTION_WORDS)
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(word: str) -> list[int]:
    """Rows of the embedding table for a word; row 0 is the blank."""
    names = {"=" + word, *("<" + word[:n] for n in (3, 4, 5, 6) if len(word) >= n), *(">" + word[-n:] for n in (3, 4, 5) if len(word) >= n)}
    found = [zlib.crc32(n.encode()) % (BUCKETS - 1) + 1 for n in sorted(names)]
    return found + [0] * (PARTS - len(found))


_VOTES = {w: tuple(1.0 if w in FUNCTION_WORDS[code] else 0.0 for code in LANGUAGES) for w in frozenset().union(*FUNCTION_WORDS.values())}


@dataclass
class Model:
    """Filters as one matrix: a word's vector times it gives the word's share in every filter at every position of the filter."""

    embed: np.ndarray
    filters: np.ndarray  # DIM x sum(WIDTHS) * FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def _maxima(shares: np.ndarray, starts: np.ndarray, bias: np.ndarray, where: bool = False):
    """For each text and filter the greatest sum of shares over the text's positions; with ``where`` also its position.

    Each text is followed by blanks, which have no share, so no window reaches into the next one.
    """
    best, at, slot = [], [], 0
    for w in WIDTHS:
        x = shares[:, slot * FILTERS : (slot + 1) * FILTERS].copy()
        for k in range(1, w):
            x[:-k] += shares[k:, (slot + k) * FILTERS : (slot + k + 1) * FILTERS]
        slot += w
        m = np.maximum.reduceat(x, starts, axis=0)
        best.append(m)
        if where:
            ends = np.append(starts[1:], len(x))
            at.append(np.stack([a + x[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)]))
    z = np.concatenate(best, axis=1) + bias
    return (z, np.concatenate(at, axis=1)) if where else z


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Adagrad on the logistic loss, the classes weighted alike. The same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    slots = sum(WIDTHS) * FILTERS
    model = Model(
        (rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32), (rng.standard_normal((DIM, slots)) / np.sqrt(DIM)).astype(np.float32),
        np.zeros(n, np.float32), (rng.standard_normal(n) * 0.3).astype(np.float32), 0.0,
    )
    model.embed[0] = 0
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        model.out[:] = 0
        model.out_bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)] + [0] * max(WIDTHS), dtype=np.int32) for t in texts]
    rows = np.array([[0] * PARTS] + [parts(w) for w in vocabulary], dtype=np.int32)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("embed", model.embed), ("filters", model.filters), ("bias", model.bias), ("out", model.out))}
    seen_bias = 1e-3
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(docs)))
    width_of = np.repeat(WIDTHS, FILTERS)
    first_slot = np.repeat(np.cumsum((0, *WIDTHS[:-1])), FILTERS)
    which = np.tile(np.arange(FILTERS), len(WIDTHS))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = 0.15 if epoch < epochs * 2 // 3 else 0.05
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            flat = np.concatenate([docs[i] for i in batch])
            starts = np.cumsum([0] + [len(docs[i]) for i in batch[:-1]])
            unique, inverse = np.unique(flat, return_inverse=True)
            vectors = model.embed[rows[unique]].sum(axis=1)
            z, at = _maxima((vectors @ model.filters)[inverse], starts, model.bias, where=True)
            h = np.tanh(z)
            p = 1 / (1 + np.exp(-(h @ model.out + model.out_bias)))
            g = (p - y[batch]) * weight[batch] / len(batch)
            gz = np.outer(g, model.out) * (1 - h * h)
            grad_out = h.T @ g + 1e-4 * model.out
            # only the words in the best windows move
            grad_filters = np.zeros_like(model.filters)
            grad_vectors = np.zeros_like(vectors)
            for j in range(n):
                for k in range(width_of[j]):
                    u = inverse[np.minimum(at[:, j] + k, len(flat) - 1)]
                    column = (first_slot[j] + k) * FILTERS + which[j]
                    grad_filters[:, column] += vectors[u].T @ gz[:, j]
                    np.add.at(grad_vectors, u, gz[:, j : j + 1] * model.filters[:, column])
            moved = np.flatnonzero(np.abs(grad_vectors).sum(axis=1) * (unique > 0))
            target = rows[unique[moved]].ravel()
            ids, back = np.unique(target, return_inverse=True)
            grad = np.zeros((len(ids), DIM), np.float32)
            np.add.at(grad, back, np.repeat(grad_vectors[moved], PARTS, axis=0))
            grad[ids == 0] = 0
            seen["embed"][ids] += grad * grad
            model.embed[ids] -= rate * grad / np.sqrt(seen["embed"][ids])
            for name, d in (("filters", grad_filters), ("bias", gz.sum(axis=0)), ("out", grad_out)):
                seen[name] += d * d
                getattr(model, name)[...] -= rate * 0.5 * d / np.sqrt(seen[name])
            d = float(g.sum())
            seen_bias += d * d
            model.out_bias -= rate * 0.5 * d / seen_bias**0.5
    return model


class Scorer:
    """Logits and languages of texts. What is known of each word is kept for the next texts, for a bounded number of words."""

    def __init__(self, model: Model, most_words: int = 60_000):
        self.model, self.most = model, most_words
        self._reset()

    def _reset(self) -> None:
        slots = self.model.filters.shape[1]
        self.ids: dict[str, int] = {}
        self.shares = np.zeros((self.most + 1, slots), np.float32)
        self.votes = np.zeros((self.most + 1, len(LANGUAGES)), np.float32)

    def _learn(self, new: list[str]) -> None:
        first = len(self.ids) + 1
        self.ids.update(zip(new, range(first, first + len(new)), strict=True))
        rows = np.array([parts(w) for w in new], dtype=np.int32)
        self.shares[first : first + len(new)] = self.model.embed[rows].sum(axis=1) @ self.model.filters
        for i, w in enumerate(new, first):
            if w in _VOTES:
                self.votes[i] = _VOTES[w]

    def _one(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and votes of one text, read in runs of a bounded number of words that overlap by a window."""
        run, lap = self.most // 2, max(WIDTHS) - 1
        best, votes = None, np.zeros(len(LANGUAGES), np.float32)
        for at in range(0, max(1, len(tokens)), run):
            piece = tokens[at : at + run + lap]
            new = [w for w in dict.fromkeys(piece) if w not in self.ids]
            if len(self.ids) + len(new) > self.most:
                self._reset()
                new = list(dict.fromkeys(piece))
            if new:
                self._learn(new)
            known = self.ids
            flat = np.array([known[w] for w in piece] + [0] * max(WIDTHS), dtype=np.int32)
            z = _maxima(self.shares[flat], np.zeros(1, np.int64), self.model.bias)[0]
            best = z if best is None else np.maximum(best, z)
            votes += self.votes[flat[:run]].sum(axis=0)
        return best, votes

    def logits(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        found = [self._one(words(t)) for t in texts]
        z = np.stack([x for x, _ in found])
        return np.tanh(z) @ self.model.out + self.model.out_bias, [LANGUAGES[int(v.argmax())] if v.any() else "" for _, v in found]

    def scores(self, texts: list[str]) -> np.ndarray:
        raw, codes = self.logits(texts)
        cut = np.array([self.model.thresholds.get(c, self.model.thresholds.get("", 0.0)) for c in codes])
        return 1 / (1 + np.exp(-np.clip((raw - cut).astype(np.float64), -60, 60)))


def threshold(raw: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap above the negatives below it."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + labels.sum())
    s = raw[order]
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut between equal values
    k = int(f1.argmax())
    return float(s[k] - 1.0) if k + 1 == len(s) else float((s[k] + s[k + 1]) / 2)


def calibrate(model: Model, texts: list[str], labels: list[int], least: int = 5) -> Model:
    """Thresholds by language; a language with fewer than ``least`` rows of either class takes the one over all."""
    if not texts:
        return model
    raw, codes = Scorer(model).logits(texts)
    y, codes = np.array(labels), np.array(codes)
    for code in ("", *LANGUAGES):
        rows = np.ones(len(y), bool) if code == "" else codes == code
        if min(y[rows].sum(), (1 - y[rows]).sum()) >= (1 if code == "" else least):
            model.thresholds[code] = threshold(raw[rows], y[rows])
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; of the empty text for a null id."""
    return (F.crc32(F.encode(empty_as(doc_id.cast("string")), "UTF-8")) % 5).cast("int")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled rows outside fold 0: folds 1 to 3 are fitted, fold 4 sets the thresholds.

    The sample is bounded by ``fit_rows`` of each class, ``calibration_rows`` of each class and
    ``sample_bytes`` of text, and is taken in the order of a hash of the id. Labels that are
    neither 0 nor 1, and ids that documents lack, are left out; of repeated ids, the smallest text
    and the greatest label count.
    """
    wanted = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = wanted.withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    rows = []
    for where, most in (("fold < 4", fit_rows), ("fold = 4", calibration_rows)):
        for toxic in (1, 0):
            rows += wanted.where(where).where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    spark = docs.sparkSession
    if not rows:
        return train([], [])
    ids = spark.createDataFrame([(r["id"], i) for i, r in enumerate(rows)], "id long, place int")
    near = docs.select(docs["doc_id"].cast("long").alias("id"), empty_as(docs["text"]).alias("text")).join(F.broadcast(ids), "id")
    sizes = sorted(near.groupBy("place").agg(F.max(F.octet_length("text"))).collect())
    used = {1: 0, 0: 0}
    kept = []
    for place, size in sizes:  # each class has half of the bytes
        toxic = rows[place]["toxic"]
        if used[toxic] + size <= sample_bytes // 2:
            used[toxic] += size
            kept.append((rows[place]["id"], place))
    found = near.join(F.broadcast(spark.createDataFrame(kept, "id long, place int").select("place")), "place").groupBy("place").agg(F.min("text").alias("text")).collect() if kept else []
    part = {True: ([], []), False: ([], [])}
    for place, text in sorted((r["place"], r["text"]) for r in found):
        texts, marks = part[rows[place]["fold"] < 4]
        texts.append(text)
        marks.append(rows[place]["toxic"])
    return calibrate(train(*part[True]), *part[False])


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row (the id alone, or all), its text's score, and ``predicted`` (1 from 0.5 on).

    Only the text is an input of the score. A null text scores as the empty one. Null and repeated
    ids pass through. A column called ``score`` or ``predicted`` is replaced.
    """
    kept = [c for c in columns if c not in ("score", "predicted")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        def step(batch):
            for part in slices(batch, 512) if batch is not None else ():
                texts = texts_of(part, "_text")
                yield {c: part.column(i) for i, c in enumerate(kept)} | {"score": scorer.scores(texts)}

        return step

    rows = docs.select(*(docs[c] for c in kept), docs["text"].alias("_text"))
    return arrow_map(rows, make, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (fold 0, never learned from), score and predicted of every document."""
    found = score(docs.withColumn("doc_id", docs["doc_id"].cast("long")), fit(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
