"""Spelling variants among the words of a corpus: exact pairs at one edit, by PartEnum signatures.

A word is taken as the multiset of its letters, a binary vector with one dimension for each letter
and its first, second, ... occurrence. One inserted or deleted code point changes one dimension, a replaced
one changes two, so near words have vectors at a Hamming distance of at most two.

PartEnum: the dimensions are dealt into ``PARTS`` parts. Vectors at a distance of at most two agree
on all parts but two at the most, so they share at least one of the signatures that leave out two
parts. Words that share a signature are joined, with lengths at most one apart, and each pair is verified.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, empty_as

#: A maximal run of these is a word's occurrence.
RUN = "[A-Za-zÀ-ÿ]+"
PARTS = 9
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is this many times as frequent as its variant.
RATIO = 5
#: One run in so many, told by a hash of document and run, loses a code point.
EVERY = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, every: int | None = EVERY) -> DataFrame:
    """run of each occurrence: lower-cased in A-Z only; with ``every``, some of them with one code point deleted."""
    found = docs.select(empty_as(docs["doc_id"].cast("string")).alias("id"), F.explode(F.regexp_extract_all(F.translate(docs["text"], UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    if every is None:
        return found.select("run")
    found = found.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    return found.select(F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")).alias("run"))


def counted(occurrences: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of the runs of at least ``length`` code points that occur at least ``least`` times; counts are added up before they are shuffled."""
    return occurrences.where(F.length("run") >= length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where a function inside reads it for each element."""
    return F.transform(F.array(value), use)[0]


def signatures(word: Column, parts: int = PARTS) -> Column:
    """64-bit hashes of the word's letters without those of any two parts, one for each pair of parts."""
    # in order, a letter's occurrences stand together: the place among them counts them
    dimensions = _let(F.array_sort(F.split(word, "")), lambda letters: F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string"))))
    dealt = F.transform(dimensions, lambda x: F.struct(x.alias("x"), F.pmod(F.xxhash64(x), F.lit(parts)).alias("p")))
    each = F.array(*(F.lit(i) for i in range(parts)))
    own = _let(dealt, lambda found: F.transform(each, lambda i: F.array_join(F.transform(F.filter(found, lambda d: d["p"] == i), lambda d: d["x"]), ",")))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in itertools.combinations(range(parts), 2)))
    return _let(own, lambda o: F.transform(pairs, lambda ij: F.xxhash64(ij, F.array_join(F.transform(o, lambda x, k: F.when((k == ij["i"]) | (k == ij["j"]), "").otherwise(x)), ";"))))


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """a and b (a < b) of the distinct ``words`` (word) that differ by one inserted, deleted or replaced code point."""
    signed = cut(words.select("word", F.length("word").alias("len"), F.explode(F.array_distinct(signatures(F.col("word"), parts))).alias("s")))
    # a pair of one length meets at that length, a longer partner at the length of the shorter one
    b = signed.select(F.col("word").alias("b"), "s", F.col("len").alias("len_b"), F.explode(F.array("len", F.col("len") - 1)).alias("len"))
    met = signed.withColumnRenamed("word", "a").join(b, ["s", "len"]).where((F.col("len_b") > F.col("len")) | (F.col("a") < F.col("b")))
    near = met.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form): the last of the words that following the forms leads to.

    Each round doubles the steps that a row has gone; a form is more frequent than its word, so no way is a circle.
    """
    gone = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = gone.join(gone.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        gone = step.select("word", "root")
        if step.where("moved").isEmpty():
            return gone


def grouped(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``words`` (word, n), each word once."""
    words = cut(words)
    pairs = cut(near_pairs(words, parts))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with_n = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    # largest n first, of equals the smallest word
    best = with_n.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best"))
    found = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    fit = -F.col("best.m") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("best.b")).alias("form"), F.when(fit, -F.col("best.m")).alias("form_n")))
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Each word of the documents with its form, root, n, n_near and form_n.

    Null texts hold no words; a null id counts as the empty text where occurrences are hashed; repeated rows count each. Of
    near words with equal n the smallest in code-point order is the form. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    return grouped(counted(runs(docs)))


#: The database's edit distance counts bytes: for it, the 64 letters beyond ASCII stand as printable characters that no word holds.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(c for c in map(chr, range(0x20, 0x7F)) if not c.islower() and c != "'")[:64]

#: crc32 byte by byte over a table that SQL computes from the polynomial; pairs by all words of lengths at most one apart that share either half.
SQL = f"""WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS c FROM r GROUP BY ALL),
b AS (SELECT id, run, c, list_transform(regexp_extract_all(hex(encode(coalesce(id, '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM g),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, tab[CAST(xor(s & 255, x) + 1 AS BIGINT)]))) AS h FROM b, t),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n, length(word) AS len FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
half AS (SELECT word, n, len, 0 AS side, substr(word, 1, 3) AS part FROM w UNION ALL SELECT word, n, len, 1, substr(word, len - 1, 2) FROM w),
p AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n_b FROM half a JOIN half b ON a.side = b.side AND a.part = b.part AND abs(a.len - b.len) <= 1 AND a.word <> b.word WHERE levenshtein(translate(a.word, '{_WIDE}', '{_NARROW}'), translate(b.word, '{_WIDE}', '{_NARROW}')) = 1),
m AS (SELECT a, count(*) AS n_near, min((-n_b, b)) AS best FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM w LEFT JOIN m ON a = word),
z AS (WITH RECURSIVE z(word, root) AS (SELECT word, word FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, n) AS root FROM z JOIN (SELECT word AS root, n FROM w) USING (root) GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)"""
