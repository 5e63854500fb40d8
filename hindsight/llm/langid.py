"""Language of a text from bit-sliced Bloom filters over character n-grams.

One table of slots serves all languages. A slot holds a byte for each language, and bit j of that
byte is a Bloom filter of the n-grams whose share of the language's n-grams is at least
``FLOOR * 4 ** j``. The bytes of an n-gram's slots, and-ed, therefore say for all languages at once
whether they use it and about how often: their popcount is the logarithm of the share, to the base 4.

A text's n-grams are looked up, the popcounts added up by language, and what false positives would
have given (from the fill of each bit's filter) taken off. The largest sum decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, empty_as, sized, slices

SIZES = (1, 2, 3, 4, 5)
LEVELS = 8
FLOOR = 2.0**-20
HASHES = 2
#: Slots for each n-gram of the language that has most of them, and the least number of slots.
SLOTS_FOR_EACH = 12
LEAST_SLOTS = 1 << 12
#: Learned for each language: so many distinct texts, and texts until so many bytes are reached.
FIT_ROWS = 1000
FIT_BYTES = 4_000_000
#: Where a language has this many texts, an n-gram must stand in two of them.
ENOUGH_TEXTS = 20
#: Code points that are looked up at a time, so that a long text needs no more memory than a short one.
CHUNK = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    """The text's letters in lower case; whatever stands between letters is one blank, and so are both ends. Empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep]
    return np.concatenate([[np.uint32(32)], c] + ([[np.uint32(32)]] if c[-1] != 32 else []))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(c: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the places from ``begin`` to ``end`` at which an n-gram stands, and the n-grams' 64-bit hashes.

    An n-gram has no blank inside and is not blank; it may begin or end with one.
    """
    h = np.zeros(end - begin, np.uint64)
    clean = np.ones(end - begin, bool)
    blank = c == 32
    for size in range(1, max(SIZES) + 1):
        n = min(end, len(c) - size + 1) - begin
        if n <= 0:
            return
        if size > 2:
            clean[:n] &= ~blank[begin + size - 2 : begin + size - 2 + n]
        h = h[:n] * np.uint64(0x100000001B3) + c[begin + size - 1 : begin + size - 1 + n]
        fit = clean[:n] & ~(blank[begin : begin + n] & blank[begin + size - 1 : begin + size - 1 + n]) if size < 3 else clean[:n]
        if size in SIZES:
            at = np.flatnonzero(fit)
            yield at + begin, _mixed(h[at] + np.uint64(size << 56))


@dataclass
class Model:
    languages: list[str]
    filters: np.ndarray  # slots x languages, bytes
    false: np.ndarray  # for each language the mean popcount of an n-gram that it does not have

    def masks(self, h: np.ndarray) -> np.ndarray:
        m = np.uint64(len(self.filters) - 1)
        found = self.filters[(h & m).astype(np.int64)]
        for j in range(1, HASHES):
            found &= self.filters[((h >> np.uint64(32 // (HASHES - 1) * j)) & m).astype(np.int64)]
        return found

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the corrected sum of popcounts, and for each text whether it has a letter."""
        parts = [code_points(t) for t in texts]
        has = np.array([len(p) > 0 for p in parts])
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        c = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for begin in range(0, len(c), CHUNK):
            for at, h in grams(c, begin, min(begin + CHUNK, len(c))):
                if not len(at):
                    continue
                first, last = np.searchsorted(ends, (at[0], at[-1]), side="right")
                bounds = np.searchsorted(at, ends[first : last + 1] - 1, side="right")
                pop = np.zeros((len(at) + 1, len(self.languages)))
                np.cumsum(np.bitwise_count(self.masks(h)), axis=0, out=pop[1:], dtype=float)
                upto = np.concatenate([[0], bounds])
                total[first : last + 1] += np.diff(pop[upto], axis=0)
                count[first : last + 1] += np.diff(upto)
        return (total - count[:, None] * self.false) / (1 - self.false / LEVELS), has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the score is the winner's share if a popcount is a factor of 4, the sizes of n-grams counted as one."""
        e, has = self.evidence(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = e.argmax(axis=1)
        share = 1 / np.exp((e - e.max(axis=1, keepdims=True)) * (np.log(4) / len(SIZES))).sum(axis=1)
        return [self.languages[b] if x else "und" for b, x in zip(best, has, strict=True)], np.where(has, share, 0.0)


def sample(docs: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> DataFrame:
    """lang and text of the distinct texts to learn from: the first of each language in the order of their hashes."""
    d = docs.where(F.col("lang").isNotNull() & (F.length(empty_as(F.col("text"))) > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = cut(d.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("bytes")))
    # hashes are spread evenly: the first rows of a language lie below this, with room to spare, so few of a large one are sorted
    limits = sizes.groupBy("lang").agg((F.lit(float(-(2**63))) + F.least(F.lit(2.0) * (rows + 100) / F.count("*"), F.lit(1.1)) * 2.0**64).alias("limit"))
    w = Window.partitionBy("lang").orderBy("h")
    # by broadcast where they are few, so that rows beyond the limit are gone before rows are dealt by language
    first = sizes.join(sized(cut(limits), 100_000), "lang").where(F.col("h") < F.col("limit")).drop("limit").withColumn("i", F.row_number().over(w)).where(F.col("i") <= rows)
    first = first.withColumn("past", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("past") < most_bytes)
    chosen = sized(cut(first.select("lang", "h")), 100_000)
    return d.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")


def counted(texts: DataFrame) -> DataFrame:
    """lang, size, h, n and docs: occurrences of each n-gram by language, and the texts that have it."""

    def make():
        def step(batch):
            if batch is None:
                return
            for part in slices(batch, 256):
                langs, bodies = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    parts = [code_points(t) for t, x in zip(bodies, langs, strict=True) if x == lang]
                    c = np.concatenate(parts)
                    ends = np.cumsum([len(p) for p in parts])
                    for size, (at, h) in zip(range(1, max(SIZES) + 1), grams(c, 0, len(c)), strict=False):
                        doc = np.searchsorted(ends, at, side="right")
                        order = np.lexsort((doc, h))
                        h, doc = h[order], doc[order]
                        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                        other = new | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(h) else new
                        begin = np.flatnonzero(new)
                        if len(begin):
                            yield {"lang": [lang] * len(begin), "size": np.full(len(begin), size, np.int32), "h": h[begin].view(np.int64), "n": np.diff(np.append(begin, len(h))), "docs": np.add.reduceat(other.astype(np.int64), begin)}

        return step

    parts = arrow_map(texts.select("lang", "text"), make, "lang string, size int, h long, n long, docs long")
    return parts.groupBy("lang", "size", "h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def fit(docs: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """Filters of the languages of ``docs`` (lang, text), from a sample of at most ``rows`` texts and about ``most_bytes`` of each.

    The slots are filled by Spark; the driver sees one row for each slot and language that is not empty, which
    the sample bounds.
    """
    texts = cut(sample(docs, rows, most_bytes))
    have = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Model([], np.zeros((1, 0), np.uint8), np.zeros(0))
    g = counted(texts)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang", "size"))
    few = F.col("lang").isin([x for x in languages if have[x] < ENOUGH_TEXTS])
    level = F.floor(F.log(share / FLOOR) / F.log(F.lit(4.0))).cast("int")
    kept = cut(g.withColumn("level", level).where((F.col("level") >= 0) & (few | (F.col("docs") > 1))).select("lang", "h", F.least(F.col("level"), F.lit(LEVELS - 1)).alias("level")))
    most = kept.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slots = max(LEAST_SLOTS, 1 << (SLOTS_FOR_EACH * most - 1).bit_length())
    places = F.array(*(F.shiftrightunsigned("h", 32 // (HASHES - 1) * j if j else 0).bitwiseAND(F.lit(slots - 1)) for j in range(HASHES)))
    byte = (F.pow(F.lit(2.0), F.col("level") + 1) - 1).cast("int")  # all bits up to the level
    filled = kept.select("lang", F.explode(places).alias("slot"), byte.alias("byte")).groupBy("slot", "lang").agg(F.bit_or("byte").alias("byte")).toPandas()
    filters = np.zeros((slots, len(languages)), np.uint8)
    filters[filled["slot"].to_numpy(), np.searchsorted(languages, filled["lang"].to_numpy().astype(str))] = filled["byte"].to_numpy()
    fill = np.stack([((filters >> j) & 1).mean(axis=0) for j in range(LEVELS)])
    return Model(languages, filters, (fill**HASHES).sum(axis=0))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score of every whole text; ``und`` and 0 for a text that is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double"

    def make():
        def step(batch):
            if batch is None:
                return
            for part in slices(batch, 64):
                text = part.column(part.num_columns - 1).to_pylist()
                said, score = shared.value.predict(["" if t is None else t for t in text])
                yield {k: part.column(i) for i, k in enumerate(keep)} | {"lang_pred": pa.array(said, pa.string()), "score": score}

        return step

    return arrow_map(docs.select(*keep, docs["text"].alias("_text")), make, schema)


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; what is held out by crc32 of the id is not learned from.

    A null id counts as the empty text there. Null texts and texts without a letter are ``und`` with a
    score of 0. A null lang is not learned; without anything to learn from, all are ``und``. Equal texts
    have equal results; of languages with equal sums the first in order is taken. Repeated rows
    each have a row, an empty table has none. Columns other than doc_id, text and lang are not read.
    """
    fold = F.pmod(F.crc32(F.encode(empty_as(docs["doc_id"].cast("string")), "UTF-8")), F.lit(folds)) == held_out
    d = docs.select(docs["doc_id"], fold.alias("held_out"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    model = fit(d.where("not held_out"))
    return identify(d, model, ("doc_id", "held_out"))
