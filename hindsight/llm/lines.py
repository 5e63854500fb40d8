"""Line deduplication over a corpus: exact, and within one edit by a deletion-neighbourhood join.

Every step is a built-in expression, join or aggregate. A line is compared without the blanks
around it and known by 128 bits of hash; blank lines are never touched. The place of a line is
(doc_id, hash of the text, number of the line), nulls last. A line goes if it has stood at an
earlier place, or if a line within one edit has first stood earlier than it. An edit inserts,
deletes or replaces one word (what stands between two blanks), and counts only between lines of
at least ``min_words`` words; where ``min_chars`` is given, an edit of one character counts too,
between all lines of at least so many characters.

Two lines within one edit share the half before or the half behind the edit, so only lines that
share a half with another line emit variants. A variant is the line without its i-th word, as a
sum of hashes of words and places, which costs a line no more than its length. Lines that share a
variant *and* i differ in that one word; a line that equals another's variant lacks one word. The
same holds for characters; there a line emits only variants of the half that it does not share, and a
line of up to ``DIRECT_CHARS`` characters, where this is cheaper than sums, the hash of what is left.
Hence every member of such a group is within one edit of the group's earliest, one comparison
for each member is enough, and no group is expanded into pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, empty_as, sized, stored

MIN_WORDS = 10
#: Length from which a line is compared by characters too, where that is asked for.
MIN_CHARS = 20
#: Length up to which a line's variants by characters are hashed as texts; lines of this length and one more have sums too, as they meet longer ones.
DIRECT_CHARS = 400
#: Rows of a checked frame up to which it is broadcast (some tens of bytes each).
BROADCAST_ROWS = 250_000
#: Occurrences from which a line is joined by broadcast, when the other lines are shuffled.
FREQUENT = 100_000
_BITS = 1 << 40
_LAST = (1 << 63) - 1


def _row_hash(text: Column) -> Column:
    return F.xxhash64(empty_as(text))


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("row_hash"), F.col("line_no"))


def _halves(words: Column) -> Column:
    """Hashes of the half lines that a line may share with one of its own length or one word more or less."""
    n = F.size(words)
    hashes = lambda m: [F.xxhash64(F.lit("first"), m, F.slice(words, 1, m)), F.xxhash64(F.lit("last"), m, F.slice(words, n - m + 1, m))]
    return F.array(*_both_halves(n, hashes))


def _both_halves(n: Column, hashes) -> list[Column]:
    """The hashes for half the length and for half of one less; null where, for an odd length, the latter are the same again."""
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return hashes(half) + [F.when(n % 2 == 0, x) for x in hashes(less)]


def _char_halves(line: Column) -> Column:
    """The same by characters, in the order first, last, first, last."""
    n = F.char_length(line)
    hashes = lambda m: [F.xxhash64(F.lit("first"), m, F.substring(line, F.lit(1), m)), F.xxhash64(F.lit("last"), m, F.substring(line, n - m + 1, m))]
    return F.array(*_both_halves(n, hashes))


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """Each line that is not blank: doc_id, row_hash, line_no, 128 bits of hash and, of long lines, the hashes of its halves, by words and, with ``min_chars``, by characters."""
    rows = docs.select("doc_id", _row_hash(F.col("text")).alias("row_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "row_hash", "line_no", F.trim("raw").alias("line")).where("line <> ''").withColumn("words", F.split("line", " "))
    return rows.select(
        "doc_id", "row_hash", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"),
        F.when(F.size("words") >= min_words, _halves(F.col("words"))).alias("halves"),
        *([] if min_chars is None else [F.when(F.char_length("line") >= min_chars, _char_halves(F.col("line"))).alias("char_halves")]),
    )


def near_lines(docs: DataFrame, found: DataFrame, by_chars: bool = False) -> DataFrame:
    """Lines (h1, h2) of ``found``, the occurrences in ``docs``, of which another, within one edit of a word or of a character, has first stood earlier."""
    halves = "char_halves" if by_chars else "halves"
    units = lambda line: F.split(line, "" if by_chars else " ")
    keyed = found.where(f"{halves} is not null").select("doc_id", "row_hash", "line_no", "h1", "h2", F.posexplode(halves).alias("side", "half")).where("half is not null")
    shared = cut(keyed.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half"))
    first = cut(keyed.join(sized(shared, BROADCAST_ROWS), "half", "left_semi").groupBy("h1", "h2").agg(F.min(_place()).alias("place"), *_sides(by_chars)))
    sides = first.columns[3:]
    at = first.select("h1", "h2", *sides, F.col("place.id").alias("id"), F.col("place.row_hash").alias("hash"), F.col("place.line_no").alias("no"))
    if first.count() <= BROADCAST_ROWS:
        at = F.broadcast(at)
    held = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), _row_hash(F.col("text")).alias("hash"), "text")
    texts = held.join(at, ["id", "hash"]).select("h1", "h2", *sides, "id", "no", F.trim(F.get(F.split("text", "\n"), F.col("no"))).alias("line"))
    texts = cut(texts.dropDuplicates(["h1", "h2"]))

    # sums over the words' hashes: before the i-th in their places, after it one place to the left
    direct, summed = (_direct(texts), texts.where(F.char_length("line") >= DIRECT_CHARS)) if by_chars else (None, texts)
    one = Window.partitionBy("h1", "h2")
    run = one.orderBy("i")
    term = lambda at, salt: F.pmod(F.xxhash64("word", at, F.lit(salt)), F.lit(_BITS))
    sums = summed.repartition("h1", "h2").select("h1", "h2", *sides, *([F.char_length("line").alias("n")] if by_chars else []), "id", "no", F.posexplode(units("line")).alias("i", "word"))
    for salt in (1, 2):
        stay, move = term(F.col("i"), salt), term(F.col("i") - 1, salt)
        sums = sums.withColumn(f"v{salt}", F.sum(stay).over(run) - stay + F.sum(move).over(one) - F.sum(move).over(run)).withColumn(f"s{salt}", F.sum(stay).over(one))
    variant = F.struct(F.xxhash64("v1", "v2").alias("key"), F.col("i"))
    itself = F.struct(F.xxhash64("s1", "s2").alias("key"), F.lit(-1).alias("i"))
    if by_chars:
        # behind a shared first half, or before a shared last half
        sums = sums.where((F.col("i") == 0) | _unshared())
    rows = sums.select("h1", "id", "no", F.explode(F.when(F.col("i") == 0, F.array(variant, itself)).otherwise(F.array(variant))).alias("k")).select("h1", "id", "no", "k.key", "k.i")
    if by_chars:
        rows = rows.unionAll(direct)

    group = Window.partitionBy("key")
    linked = (
        rows.repartition("key")
        .withColumn("me", F.struct("id", "no", "h1"))
        .withColumn("peer", F.min("me").over(Window.partitionBy("key", "i")))
        .withColumn("whole", F.min(F.when(F.col("i") < 0, F.col("me"))).over(group))
        .withColumn("longer", F.min(F.when(F.col("i") >= 0, F.col("me"))).over(group))
    )
    earlier = F.when(F.col("i") < 0, F.array("longer")).otherwise(F.array("peer", "whole"))
    pairs = linked.select("me", F.explode(F.filter(earlier, lambda e: e < F.col("me"))).alias("other")).select(F.col("me.h1").alias("h1"), F.col("other.h1").alias("o1")).distinct()
    # equal hashes are not yet equal words
    mine = texts.select("h1", "h2", (F.col("line") if by_chars else units("line")).alias("a"))
    theirs = texts.select(F.col("h1").alias("o1"), (F.col("line") if by_chars else units("line")).alias("b"))
    return pairs.join(mine, "h1").join(theirs, "o1").where(F.levenshtein("a", "b", 1) >= 0 if by_chars else within_one("a", "b")).select("h1", "h2").distinct()


def _sides(by_chars: bool) -> list[Column]:
    """Whether a line shares a first and a last half."""
    return [F.max(F.col("side") % 2 == k).alias(name) for k, name in enumerate(("first", "last"))] if by_chars else []


def _unshared() -> Column:
    """Whether the i-th of n characters stands behind a shared first half, or before a shared last half."""
    half = F.floor((F.col("n") - 1) / 2)
    return (F.col("first") & (F.col("i") >= half)) | (F.col("last") & (F.col("i") < F.col("n") - half))


def _direct(texts: DataFrame) -> DataFrame:
    """h1, id, no, key and i of the variants by characters, and of the lines themselves (i = -1), of lines that are not too long for it: hashes of their texts."""
    n = F.char_length("line")
    short = texts.where(n <= DIRECT_CHARS + 1).repartition("h1", "h2").select("h1", "id", "no", "first", "last", "line", n.alias("n"), F.explode(F.sequence(F.lit(-1), n - 1)).alias("i"))
    rest = F.concat(F.substring("line", F.lit(1), F.col("i")), F.substring("line", F.col("i") + 2, F.col("n")))
    key = F.xxhash64(F.when(F.col("i") < 0, F.col("line")).otherwise(rest))
    return short.where((F.col("i") < 0) | _unshared()).select("h1", "id", "no", key.alias("key"), "i")


def within_one(a: str, b: str) -> Column:
    """Whether two arrays of words are at most one insertion, deletion or replacement apart: what they share from both ends leaves at most one word of each."""
    x, y = F.col(a), F.col(b)
    short = F.least(F.size(x), F.size(y))
    agree = lambda p, q: F.array_position(F.transform(F.arrays_zip(F.slice(p, 1, short).alias("p"), F.slice(q, 1, short).alias("q")), lambda z: z["p"] == z["q"]), False)
    before = lambda p, q: F.when(agree(p, q) == 0, short).otherwise(agree(p, q) - 1)
    both = before(x, y) + before(F.reverse(x), F.reverse(y))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (both >= F.greatest(F.size(x), F.size(y)) - 1)


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """The lines that go: doc_id, row_hash and ``gone``, their numbers in the text; one row for each document that loses any."""
    docs = docs.select("doc_id", "text")
    found = stored(occurrences(docs, min_words, min_chars), "lines")
    again = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    near = near_lines(docs, found)
    if min_chars is not None:
        near = near.unionAll(near_lines(docs, found, by_chars=True)).distinct()
    near = near.withColumn("near", F.lit(True))
    marked = again.join(near, ["h1", "h2"], "full_outer").select("h1", "h2", "first", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = _at_lines(found.select("doc_id", "row_hash", "line_no", "h1", "h2"), cut(marked)).where(F.col("near") | (_place() != F.col("first")))
    return cut(gone.groupBy("doc_id", "row_hash").agg(F.collect_set("line_no").alias("gone")))


def _at_lines(found: DataFrame, marked: DataFrame) -> DataFrame:
    """The occurrences of the lines in ``marked``, with its columns. Too many lines to broadcast are shuffled, but for the frequent ones, of which there are few."""
    keys = ["h1", "h2"]
    if marked.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(marked), keys)
    frequent = F.col("n") > max(FREQUENT, found.count() // BROADCAST_ROWS)  # so there are at most BROADCAST_ROWS of them
    few = marked.where(frequent)
    rest = found.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(marked.where(~frequent), keys)
    return found.join(F.broadcast(few), keys).unionByName(rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, and columns ``n_lines`` and ``n_removed``.

    Every row stays. A null text stays null and has no lines; an empty text has one, blank line.
    Rows that agree in id and text are one document and are treated alike; rows with the same
    or a null id and different texts are ordered by the hash of the text. Further columns are
    passed on untouched under their own names (``n_lines`` and ``n_removed`` replace columns
    so called).
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), min_words, min_chars)
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = gone.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_id"), F.col("row_hash").alias("_hash"), F.col("gone").alias("_gone"))
    gone = F.broadcast(gone) if rows <= BROADCAST_ROWS and numbers <= 10 * BROADCAST_ROWS else gone.hint("shuffle_hash")
    text = docs[text_col]
    joined = docs.select(*(docs[c] for c in kept)).join(gone, (F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)) == F.col("_id")) & (_row_hash(text) == F.col("_hash")), "left")
    lines = F.split(text, "\n")
    rest = F.array_join(F.array_except(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), F.transform("_gone", lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("x")))).getField("x"), "\n")
    return joined.select(
        *((F.when(F.col("_gone").isNull(), text).otherwise(rest).alias(c) if c == text_col else docs[c]) for c in kept),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )


SQL = """
WITH occ AS (
  SELECT doc_id, i AS line_no, trim(x) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(x) <> ''
), lines AS (
  SELECT line, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n, min({'d': doc_id, 'l': line_no}) AS place FROM occ GROUP BY line
), halves AS (
  SELECT DISTINCT line, w, n, place, m, side, CASE side WHEN 0 THEN w[1:m] ELSE w[n - m + 1:n] END AS half
  FROM (SELECT *, unnest([n // 2, (n - 1) // 2]) AS m FROM lines WHERE n >= 10), (VALUES (0), (1)) AS s(side)
), pairs AS (
  SELECT DISTINCT a.line, a.w, a.n, b.w AS v, b.n AS o FROM halves a JOIN halves b USING (m, side, half)
  WHERE a.line <> b.line AND abs(a.n - b.n) <= 1 AND b.place < a.place
), near AS (
  SELECT DISTINCT line FROM pairs WHERE
    CASE WHEN n = o THEN len(list_filter(range(1, n + 1), lambda i: w[i] <> v[i])) = 1
         WHEN n > o THEN len(list_filter(range(1, n + 1), lambda i: list_concat(w[1:i - 1], w[i + 1:n]) = v)) > 0
         ELSE len(list_filter(range(1, o + 1), lambda i: list_concat(v[1:i - 1], v[i + 1:o]) = w)) > 0 END
), chars AS (
  SELECT DISTINCT line, c, place, m, side, CASE side WHEN 0 THEN left(line, m) ELSE right(line, m) END AS half
  FROM (SELECT line, length(line) AS c, place, unnest([length(line) // 2, (length(line) - 1) // 2]) AS m FROM lines WHERE length(line) >= 20), (VALUES (0), (1)) AS s(side)
), char_pairs AS (
  SELECT DISTINCT a.line, b.line AS v, a.c, b.c AS o FROM chars a JOIN chars b USING (m, side, half)
  WHERE a.line <> b.line AND abs(a.c - b.c) <= 1 AND b.place < a.place
), near_chars AS (
  SELECT DISTINCT line FROM char_pairs WHERE
    CASE WHEN c = o THEN len(list_filter(range(1, c + 1), lambda i: substr(line, i, 1) <> substr(v, i, 1))) = 1
         WHEN c > o THEN len(list_filter(range(1, c + 1), lambda i: left(line, i - 1) || substr(line, i + 1) = v)) > 0
         ELSE len(list_filter(range(1, o + 1), lambda i: left(v, i - 1) || substr(v, i + 1) = line)) > 0 END
), gone AS (
  SELECT o.doc_id, list(o.line_no) AS nos FROM occ o JOIN lines l USING (line)
  WHERE {'d': o.doc_id, 'l': o.line_no} <> l.place OR o.line IN (SELECT line FROM near UNION ALL SELECT line FROM near_chars) GROUP BY o.doc_id
)
SELECT d.doc_id, CASE WHEN nos IS NULL THEN text ELSE
         coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(nos, i)), lambda i: string_split(text, chr(10))[i]), chr(10)), '') END AS text,
       CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(nos), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN gone g USING (doc_id)
"""
