"""The training-data operators against brute force, exact round trips and held-out labels; awkward inputs."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from hindsight.llm import html, jaccard, lines, media, neighbours, packing, passages, pieces, queries, sharding, shingles, toxicity
from hindsight.llm.common import components, table
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, extra=""):
    """Documents by text, or by (id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def vocabulary(seed, n=4000):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(seed, words, vocab):
    r = random.Random(seed)
    return " ".join(r.choice(vocab) for _ in range(words))


AWKWARD = [(1, None), (2, ""), (3, "   "), (None, "a null id"), (4, "same"), (4, "same"), (5, "same"), (None, None), (6, "é" * 50 + "\n\n" + "word " * 3000)]


@pytest.mark.parametrize(
    "run",
    [
        lambda d: media.media_digest(d), lambda d: media.media_column(d), lambda d: packing.pack(d), lambda d: sharding.shard(d), lambda d: lines.dedup_lines(d),
        lambda d: jaccard.classes(d), lambda d: jaccard.one_of_each(d), lambda d: passages.repeats(d), lambda d: passages.drop_repeats(d), lambda d: pieces.encode(d),
    ],
    ids="digest media pack shard lines classes one repeats drop pieces".split(),
)
def test_awkward_and_empty_tables(spark, run):
    from pyspark.sql import functions as F

    d = docs_of(spark, AWKWARD).withColumns({"n_lines": F.lit("clash"), "score": F.lit(1), "rid": F.lit(2), "key": F.lit(3)})
    run(d).collect()
    assert run(d.limit(0)).collect() == []


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(-50, 50) * 10**17, r.randint(-50, 50) * 10**17) for _ in range(70)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {n: c for n, c in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if find(n) != n or any(n == find(m) and m != n for m in parent)}


# media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 12 * 192, 64 * 192, 64 * 192 + 1, 200_000])
def test_media_round_trip(n):
    raw = random.Random(n).randbytes(n)
    stored = media.write(media.pad(raw))
    assert media.payload(stored) == media.pad(raw) and media.pad(raw)[:n] == raw and len(media.pad(raw)) % 192 == 0
    d = media.describe(stored)
    assert d["samples"] == d["duration"] == len(media.pad(raw)) // 192 and d["codec"] == "raw "
    for k, (a, b) in enumerate(d["keyframes"]):
        assert stored[a:b] == media.pad(raw)[k * media.KEYFRAME_EVERY * 192 :][:192]
    scrambled = stored[: stored.index(b"mdat") + 4] + bytes(len(media.pad(raw)))
    assert media.describe(scrambled) == d  # the payload is not looked at


def test_media_walk_rejects_a_box_beyond_its_parent():
    with pytest.raises(ValueError):
        list(media.walk(media.box(b"moov", b"\x00\x00\x10\x00trak")))


# packing


def test_packing_covers_every_id_once(spark):
    d = table(spark, DATA, "documents")
    rows = packing.pack(d, with_ids=True).collect()
    encoder = packing.Encoder()
    want = {r["doc_id"]: encoder.ids(r["text"] or "") + [0] for r in d.collect()}
    got, windows = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    for i, ids in want.items():
        assert [x for _, p in sorted(got[i]) for x in p] == ids
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(map(len, want.values())) / (1024 * len(windows)) > 0.97


def test_fast_ids_are_the_library_s():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing._file("byte_bpe_50k.json")), packing.Encoder()
    for t in ["", "  a\n\nb ", "é ñ ß ³ ½", "don't 12 x_y", "日本語 \U0001f600", "a<|endoftext|>b", "\xa0x\x85y"]:
        assert fast.ids(t) == slow.encode(t, add_special_tokens=False).ids


def test_differencing_is_near_equal():
    r = random.Random(1)
    sizes = [r.randint(1, 256) for _ in range(200)]
    sums = [sum(sizes[i] for i in g) for g in packing.differencing(sizes, 26)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 16


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_shards(spark):
    rows = sharding.shard(table(spark, DATA, "documents"), 7).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(table(spark, DATA, "documents").repartition(5), 7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


# lines


def test_lines_against_brute_force(spark):
    v = vocabulary(1, 60)
    r = random.Random(2)
    base = [prose(i, 12, v).split(" ") for i in range(12)]
    texts = []
    for _ in range(40):
        out = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                i, kind = r.randrange(len(w)), r.randrange(3)
                w[i : i + (kind != 0)] = [] if kind == 1 else [r.choice(v)]
            out.append(r.choice(["", " "]) + " ".join(w))
        texts.append("\n".join([*out, ""]))
    first = {}
    for d, t in enumerate(texts):
        for k, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(x.strip(" "), (d, k))

    def within(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    near = {x for x, y in itertools.permutations(first, 2) if first[y] < first[x] and len(x.split(" ")) >= 10 and len(y.split(" ")) >= 10 and within(x.split(" "), y.split(" "))}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (first[x.strip(" ")] == (d, k) and x.strip(" ") not in near)) for d, t in enumerate(texts)}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == want and near


def test_lines_by_characters_against_brute_force(spark):
    import corpus_pipeline

    v = vocabulary(1, 60)
    r = random.Random(5)
    long_words = ["".join(r.choice("語文字書読見聞\U0001f600") for _ in range(n)) for n in (19, 20, 24, 40)]
    base = [prose(i, n, v) for i, n in enumerate((1, 3, 4, 5, 6, 8, 12, 14))] + long_words + ["a" * 21, "ab" * 11]
    texts = []
    for _ in range(50):
        out = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                i, kind = r.randrange(len(x)), r.randrange(3)
                x = x[:i] + ("" if kind == 1 else r.choice("ab 語")) + x[i + (kind != 0) :]
            out.append(x)
        texts.append("\n".join([*out, ""]))
    first = {}
    for d, t in enumerate(texts):
        for k, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(x.strip(" "), (d, k))

    def within(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    def close(x, y):
        return min(len(x), len(y)) >= 20 and within(x, y) or min(x.count(" "), y.count(" ")) >= 9 and within(x.split(" "), y.split(" "))

    near = {x for x, y in itertools.permutations(first, 2) if first[y] < first[x] and close(x, y)}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (first[x.strip(" ")] == (d, k) and x.strip(" ") not in near)) for d, t in enumerate(texts)}
    got = {d["doc_id"]: d["text"] for d in corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, texts), "").collect()}
    assert got == want
    assert sum(x.count(" ") < 9 for x in near) > 10


def test_frequent_lines_apart_from_shuffled_ones(spark, monkeypatch):
    texts = [f"common line\nline {d // 3}\nonce {d}" for d in range(30)]
    want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(lines, "FREQUENT", 10)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == want and got[0] == texts[0] and got[1] == "once 1" and got[3] == "line 1\nonce 3"


# jaccard


def test_word_hashes_cut_and_fold_like_the_pattern():
    texts = ["", " ", "A b\tC\x0bd", "É é", "x" * 5000, "a b"]
    h, begins = shingles.word_hashes(texts)
    found = [WORDS.findall(t.translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert np.diff(begins).tolist() == [len(w) for w in found]
    known = {}
    for w, x in zip([w for f in found for w in f], h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_classes_against_brute_force(spark, k, percent):
    v = vocabulary(5)
    r = random.Random(6)
    texts = []
    for i in range(40):
        words = prose(i, r.choice([1, 2, 4, 9, 12, 15, 21, 60, 200]), v).split(" ")
        for _ in range(r.choice([1, 1, 2, 9])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                j, kind = r.randrange(len(w)), r.randrange(3)
                w[j : j + (kind != 0)] = [] if kind == 1 and len(w) > 1 else [r.choice(v)]
            texts.append(" ".join(w))
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for w in (t.split(" ") for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        o = len(sets[a] & sets[b])
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs_of(spark, texts), k, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert {r["doc_id"] for r in jaccard.one_of_each(docs_of(spark, texts), k, percent).collect()} == {find(i) for i in range(len(texts))}


# passages


def test_one_of_each_tells_rows_by_id_and_text(spark):
    a, b, c = (prose(i, 30, vocabulary(4)) for i in (1, 2, 3))
    d, e, f = (prose(i, 30, vocabulary(4)) for i in (4, 5, 6))
    rows = [(None, a), (None, b), (None, c), (1, c), (1, c), (7, d), (7, e), (8, d), (3, e), (None, f), (None, f), (None, ""), (None, ""), (9, None), (9, "  ")]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (7, d), (3, e), (None, f), (None, ""), (None, ""), (9, None), (9, "  ")], key=str)


def test_compact_windows_against_brute_force():
    r = np.random.default_rng(1)
    for m, w in itertools.product((4, 30, 120), (5, 20)):
        v = r.integers(0, 40, m).astype(np.uint64)
        want = []
        for c in range(m):
            a = b = c
            while a > 0 and v[a - 1] > v[c]:
                a -= 1
            while b < m - 1 and v[b + 1] >= v[c]:
                b += 1
            if b - a + 1 >= w:
                want.append((a, c, b))
        assert passages.compact_windows(v, w) == want


def test_planted_passages(spark):
    v = vocabulary(7)
    planted = [prose(1000 + i, 60, v) for i in range(3)]
    near = planted[0].split(" ")
    near[30] = "changedword"
    texts = [prose(i, 120, v) for i in range(30)]
    for i, p in [(2, planted[0]), (9, planted[0]), (11, " ".join(near)), (4, planted[1]), (20, planted[1]), (7, planted[2]), (8, planted[2])]:
        texts[i] += " " + p + " " + prose(500 + i, 40, v)
    got = {(r["doc_id"], r["source_id"]): r["spans"] for r in passages.repeats(docs_of(spark, texts)).collect()}
    assert set(got) == {(9, 2), (11, 2), (20, 4), (8, 7)}
    for s in got.values():
        assert [(x["start"], x["stop"]) for x in s] == [(120, 180)]
    cut = {r["doc_id"]: r["text"] for r in passages.drop_repeats(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split(" ")
        assert cut[i].split() == (w[:120] + w[180:] if i in (9, 11, 20, 8) else w)


def edited_passages(count):
    """Documents in pairs (i, count + i) that share a passage: 100 words with the middle 4 replaced, or 90 with 4 more in the middle."""
    v = vocabulary(8)
    texts, spans = {}, {}
    for i in range(count):
        old = prose(2000 + i, 100 if i % 2 else 90, v).split(" ")
        half = len(old) // 2
        new = old[: half - 2 * (i % 2)] + [f"new{i}x{k}" for k in range(4)] + old[half + 2 * (i % 2) :]
        for at, w in ((i, old), (count + i, new)):
            texts[at] = " ".join([prose(3000 + at, 80, v), *w, prose(4000 + at, 80, v)])
        spans[count + i, i] = [(80, 80 + len(new))]
    return [texts[i] for i in range(2 * count)], spans


def test_passages_with_edits_of_four_words(spark):
    texts, spans = edited_passages(60)
    got = {(r["doc_id"], r["source_id"]): [(x["start"], x["stop"]) for x in r["spans"]] for r in passages.repeats(docs_of(spark, texts)).collect()}
    assert set(got) <= set(spans) and all(got[k] == spans[k] for k in got)
    assert len(got) >= 0.9 * len(spans)


def masked_passages(count, holders=4):
    """Pairs of documents that share a passage of 60 words, after documents that hold eight words of it each, so that every shingle stands elsewhere first."""
    v = vocabulary(10)
    phrases, first, second, spans = [], [], [], set()
    for i in range(count):
        words = prose(5000 + i, 60, v).split(" ")
        for at in range(0, 56, 4):
            for k in range(holders):
                seed = 100_000 + (i * 100 + at) * 10 + k
                phrases.append(" ".join([prose(seed, 70, v), *words[at : at + 8], prose(-seed, 70, v)]))
        first.append(" ".join([prose(6000 + i, 80, v), *words, prose(7000 + i, 80, v)]))
        second.append(" ".join([prose(8000 + i, 80, v), *words, prose(9000 + i, 80, v)]))
    texts = phrases + first + second
    for i in range(count):
        spans.add((len(phrases) + count + i, len(phrases) + i))
    return texts, spans


def test_passages_whose_shingles_all_stand_elsewhere_first(spark):
    texts, spans = masked_passages(40)
    got = {(r["doc_id"], r["source_id"]): [(x["start"], x["stop"]) for x in r["spans"]] for r in passages.repeats(docs_of(spark, texts)).collect()}
    assert set(got) == spans
    assert all(s == [(80, 140)] for s in got.values())


def test_gaps_that_the_similarity_has_room_for():
    rng = np.random.default_rng(1)
    for words, left, more in ((100, 4, 4), (150, 6, 6), (150, 0, 12), (150, 12, 0), (50, 2, 3), (100, 9, 9), (60, 0, 4), (60, 0, 3)):
        x = rng.integers(0, 1 << 32, words, dtype=np.uint32)
        half = words // 2
        y = np.concatenate([x[: half - left // 2], rng.integers(0, 1 << 32, more, dtype=np.uint32), x[half - left // 2 + left :]])
        shared = words - left - 2 * (passages.SHINGLE - 1)
        whole = 100 * shared >= 80 * (len(x) + len(y) - 2 * (passages.SHINGLE - 1) - shared) and min(len(x), len(y)) >= 50
        found = passages.verify(passages.Block(x), passages.Block(y), 3, 3)
        assert (found == (0, len(x), 0, len(y))) == whole, (words, left, more)


# search


def test_recall_and_order(spark):
    from pyspark.sql import functions as F

    e = table(spark, DATA, "embeddings")
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in neighbours.nearest(e, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(sc - float(x[ids == i][0] @ x[q])) < 1e-12 for _, i, sc in mine)
        hits += len(set(best) & {m[1] for m in mine})
    assert hits / 20 / len(got) >= 0.9


def test_equal_and_unusable_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (105, [1.0, 2.0, 3.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    first = [r["vec_id"] for r in got if r["query_id"] == 0]
    assert first == list(range(1, 21)) and {r["query_id"] for r in got} == {0, 20, 100}
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == [*range(20)]
    one = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(one, F.col("vec_id") % 20 == 0).collect() == [] and neighbours.nearest(one.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# toxicity


def test_toxicity_on_held_out_rows(spark):
    d, labels = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 4000"), table(spark, "/root/testdata/sf0.1", "labels")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in got}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in marks.items() if got[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.85
    assert toxicity.toxicity(docs_of(spark, AWKWARD), labels.limit(0)).count() == len(AWKWARD)


# pieces


def test_pieces_round_trip_and_seeds(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces._path(None))
    plain, a, b = pieces.Codec(dropout=0.0), pieces.Codec(seed=1), pieces.Codec(seed=2)
    texts = ["", " ", "  a  b ", "\n\na", "日本語 ▁ x▁y", "\U0001f600 <0x0A> </s>", "The quick brown foxes were jumping " * 20]
    for t in texts:
        for c in (plain, a, b):
            assert c.text(c.ids(t, "k")) == t
        if "▁" not in t:
            assert plain.ids(t).tolist() == library.encode(t)
    assert a.ids(texts[-1], "k").tolist() == pieces.Codec(seed=1).ids(texts[-1], "k").tolist() != b.ids(texts[-1], "k").tolist()
    rows = pieces.encode(docs_of(spark, texts))
    assert {r["doc_id"]: r["text"] for r in pieces.decode(rows).collect()} == dict(enumerate(texts))


def test_each_occurrence_draws_its_own_segmentation(spark):
    """Of 20,000 occurrences of a word, as many have each segmentation as an agenda with random skips gives."""
    from collections import Counter

    codec, r = pieces.Codec(seed=3, dropout=0.3), random.Random(4)

    def brute(symbols):
        symbols, banned = list(symbols), set()
        while True:
            starts = list(itertools.accumulate(map(len, symbols), initial=0))
            open_ = [(codec.rank[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in codec.rank and (starts[i], starts[i + 1], starts[i + 2]) not in banned]
            if not open_:
                return tuple(symbols)
            i = min(open_)[1]
            if r.random() < 0.3:
                banned.add((starts[i], starts[i + 1], starts[i + 2]))
            else:
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    n = 20_000
    want = Counter(brute("▁windows") for _ in range(n))
    ids = codec.ids(("windows " * n)[:-1], "k").tolist()
    names = {i: p for p, i in codec.piece_id.items()}
    got, word = Counter(), []
    for p in [*(names[i] for i in ids), "▁"]:
        if p.startswith("▁") and word:
            got[tuple(word)] += 1
            word = []
        word.append(p)
    assert sum(got.values()) == n and len(got) > 10
    for w in set(got) | set(want):
        assert abs(got[w] - want[w]) < 6 * (got[w] + want[w]) ** 0.5 + 6, w
    long_text = "語文" * 300 + "a" * 500
    assert codec.text(codec.ids(long_text, "k")) == long_text and pieces.Codec(dropout=1.0).ids("windows").size == 8
    # the same text under another id, and another text under the same id, draw differently
    text = "the windows were standing open " * 40
    rows = pieces.encode(docs_of(spark, [(None, text), (None, text + "."), (1, text), (1, text)])).collect()
    a, b, c, d = (x["ids"] for x in rows)
    assert a != b[: len(a)] and a != c and c == d and all(x["lossless"] for x in rows)


# html


def test_main_text():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>'
        '<article><h1>Title &amp; more</h1><p>One   <b>two</b>\nthree<!-- no --><div class="ad">Buy now</div><p>four&nbsp;five</p><form>name <input></form><aside>side</aside>'
        '<script>var t="</p>";</script><p>end</p><section id="comments"><article class="comment"><p>first!</p></article></section></article><footer>&copy; us</footer></body></html>'
    )
    assert html.main_text(page) == "Title & more\nOne two three\nfour five\nend"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("just text") == "just text"


def test_pages(spark):
    got = {r["page_id"]: r for r in queries.op7_html(spark, DATA).collect()}
    for r in table(spark, DATA, "pages").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        import html as h

        want = "\n".join(b for b in (" ".join(h.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", inner)) if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = table(spark, DATA, "documents")
    for name, f in p.STAGES[:-1]:
        out = f(spark, d, DATA)
        assert out.columns == d.columns, name
        assert out.count() <= d.count()
        d = spark.createDataFrame(out.collect(), out.schema)
    assert p.STAGES[-1][1](spark, d, DATA).agg({"length": "sum"}).first()[0] > 0
    assert p.run(spark, DATA).count() > 0


# search by partitions


@pytest.mark.parametrize("n", [2, 12, 60, 300])
def test_every_query_is_answered_with_more_partitions_than_rows(spark, n):
    from pyspark.sql import functions as F

    x = np.random.default_rng(n).standard_normal((n, 8))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours.nearest(rows, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hits = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.argsort(-s)[: min(20, n - 1)].tolist()
        assert [r for r, _ in sorted(got[q])] == list(range(1, len(want) + 1))
        hits += len(set(want) & {i for _, i in got[q]}) / len(want)
    assert hits / len(got) >= 0.95


def test_a_vector_of_far_larger_norm_does_not_blur_the_others(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1000
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(rows, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, mine in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(mine & set(np.argsort(-s)[:20].tolist())) / 20
    assert len(got) == 6 and hits / 6 >= 0.9


# pages that names or unclosed elements would mislead


_WORDS = "The river rose by two metres on Monday and the town closed both of its bridges until the water fell again."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="layout no-sidebar"><article><p>{_WORDS}</p></article></div></body>',
        f'<body><div id="comments-open"><article><p>{_WORDS}</p></article></div></body>',
        f'<body><main><section class="job-search"><p>{_WORDS}</p></section></main></body>',
        f"<body><aside>Most read<article><p>{_WORDS}</p></article></body>",
        f"<body><div><button>Like</div><article><p>{_WORDS}</p></article></body>",
        f"<body><form><h1>{_WORDS}</h1></form></body>",
        f"<body><form><div><p>{_WORDS}</p></div></form></body>",
    ],
)
def test_names_and_unclosed_elements_do_not_empty_a_page(page):
    assert html.main_text(page) == _WORDS


def test_links_between_articles_do_not_win():
    links = "".join(f"<li><a href={i}>topic{i}</a></li>" for i in range(60))
    got = html.main_text(f"<body><article><p>{_WORDS}</p></article><ul>{links}</ul><article><p>{_WORDS}</p></article></body>")
    assert _WORDS in got and "topic7" not in got


def test_open_elements_take_linear_time():
    import time

    began = time.time()
    html.main_text("<div><font>a" * 50_000)
    assert time.time() - began < 20


# long lists


@pytest.mark.parametrize("held", [5, 20, 1000])
@pytest.mark.parametrize("size", [1, 7, 10])
def test_a_list_longer_than_what_is_held_keeps_all_sets_and_one_leader(spark, monkeypatch, held, size):
    import pyarrow as pa

    class Ordered:
        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "arrow_map", lambda _, make, __: make())
    step = jaccard._listed(Ordered(), 90)
    rows = [(1, s, 100, s // 30) for s in range(100)] + [(2, 7, 100, 0), (2, 8, 100, 1), (2, 9, 300, 2)] + [(3, 5, 100, 0)] + [(4, s, 100, 0) for s in range(50) for _ in range(2)] + [(5, 1, 19, -18), (5, 2, 19, -18)]
    got = {}
    for a in [*range(0, len(rows), size), None]:
        batch = None if a is None else pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + size]), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "sid", "n", "pos"])
        for out in step(batch):
            for key, sid, leader, m, light in zip(*(out[c].to_pylist() for c in ("key", "sid", "l_sid", "m", "light")), strict=True):
                got.setdefault(key, []).append((sid, leader, m, light))
    assert {s for s, *_ in got[1]} == set(range(100)) and {x for _, x, *_ in got[1]} == {0}
    assert {s for s, *_ in got[4]} == set(range(50)) and {x for _, x, *_ in got[4]} == {0}
    assert [(s, x, m) for s, x, m, _ in got[2]] == [(7, 7, 2), (8, 7, 2)] and 3 not in got
    assert [(s, x, light) for s, x, _, light in got[5]] == [(1, 1, True), (2, 1, True)]
    assert all(m > 2 for k in (1, 4) for _, _, m, _ in got[k])


def test_pieces_merged_at_once_are_those_merged_one_by_one(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "▁ a▁b", "naïve 漢字 ☃ straße  two   blanks\n\ttab", "x" * 90 + " y" * 50]
    texts += [" ".join("".join(rng.choice("abcdefghilmnoprstuéè.") for _ in range(rng.randrange(1, 60 if i % 7 == 0 else 12))) for _ in range(40)) for i in range(30)]
    for dropout in (0.1, 0.6, 0.97):
        codec, plain = pieces.Codec(seed=5, dropout=dropout), pieces.Codec(seed=5, dropout=dropout)
        ids, lengths = codec.many(texts, [str(i) for i in range(len(texts))])
        for i, (text, got) in enumerate(zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True)):
            own, want = pieces.xxhash.xxh64_intdigest(text, pieces.xxhash.xxh64_intdigest(str(i), 5)), []
            for place, segment in enumerate(plain._segments.findall(" " + text) if text else []):
                key, stop, skips = own + place * 0x9E3779B97F4A7C15 & (1 << 64) - 1, 3 * len(segment), set()
                at, level = plain._next(key, 0, 0, stop)
                while at < stop:
                    skips.add(at)
                    at, level = plain._next(key, at + 1, level, stop)
                want += np.frombuffer(plain._encode(segment, skips)[1], np.int32).tolist()
            assert got.tolist() == want and codec.text(got) == text
    one_by_one = []
    monkeypatch.setattr(codec, "_encode", lambda segment, skips: one_by_one.append(segment))
    codec.many(["some other words of everyday length, none of them met before"], ["7"])
    assert not one_by_one


def test_lines_about_the_length_of_direct_variants(spark):
    rng = random.Random(8)
    texts, repeated = [], []
    for n in (20, 21, 30, *range(lines.DIRECT_CHARS - 2, lines.DIRECT_CHARS + 4)):
        for at in (0, n // 2 - 1, n // 2, n - 1):
            line = "".join(rng.choice("abcdefghé") for _ in range(n))
            for other in (line[:at] + line[at + 1 :], line[:at] + "z" + line[at + 1 :], line[:at] + "z" + line[at:]):
                if len(other) >= lines.MIN_CHARS:
                    texts += [line, other] if not texts or texts[-2] != line else [other]
                    repeated.append(len(texts) - 1)
    found = {r["doc_id"] for r in lines.dedup_lines(docs_of(spark, texts), min_chars=lines.MIN_CHARS).where("n_removed > 0").collect()}
    assert set(repeated) - found == set() and {i for i, t in enumerate(texts) if t in texts[:i]} | set(repeated) >= found
    frame = spark.createDataFrame([(1, 2, 3, 4, True, True, "some line of text")], "h1 long, h2 long, id long, no int, first boolean, last boolean, line string")
    rows = lines._direct(frame)
    assert rows.count() == 18 and "Window" not in rows._jdf.queryExecution().toString()


def test_heap_is_given_back_between_jobs(spark, monkeypatch):
    from hindsight.llm import common

    collected = []
    monkeypatch.setattr(common, "_collect", lambda s: collected.append(s))
    for share, times in ((1.1, 0), (0.0, 2)):
        monkeypatch.setattr(common, "HEAP_SHARE", share)
        assert common.cut(spark.range(3)).count() == common.stored(spark.range(3), "rows").count() == 3
        assert len(collected) == times


def test_collected_heap_keeps_little_that_is_free(spark):
    from hindsight.llm import common

    jvm = spark.sparkContext._jvm
    common._collect(spark)
    options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    assert {name: int(options.getVMOption(name).getValue()) for name in common.HEAP_FREE} == common.HEAP_FREE
    assert "rim native heap" in common._trim_native(spark)


def test_windows_of_texts_end_to_end_are_those_of_each_text():
    rng = np.random.default_rng(5)
    width = 7
    texts = [rng.integers(0, most, n).astype(np.uint64) for n, most in ((7, 5), (60, 9), (8, 2), (200, 1 << 40), (30, 1), (7, 1 << 40))]
    number, keys, packed, around = passages.windows_of(texts, 3, width)
    left, node, right, f = passages._unpack(packed)
    found = sorted(zip(number.tolist(), f.tolist(), left.tolist(), node.tolist(), right.tolist(), keys.tolist(), around.tolist(), strict=True))
    want = []
    for i, tokens in enumerate(texts):
        for h, values in enumerate(passages.hash_values(tokens, 3)):
            for a, c, b in passages.compact_windows(values, width):
                want.append((i, h, a, c, b, int(values[c : c + 1].view(np.int64)[0]), int(passages.surroundings(tokens, np.array([c]))[0])))
    assert found == sorted(want)


def test_windows_are_made_from_one_reading_of_the_texts(spark, monkeypatch):
    rows = [(1, " ".join(f"w{i}" for i in range(80))), (2, " ".join(f"w{i}" for i in range(10, 90))), (3, " ".join(f"v{i}" for i in range(90)))]
    schemas, plain = [], passages.arrow_map
    monkeypatch.setattr(passages, "arrow_map", lambda df, make, schema: schemas.append(schema) or plain(df, make, schema))
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source_id"], [tuple(s) for s in r["spans"]]) for r in found] == [(2, 1, [(0, 70)])]
    assert sum(schema.startswith("key long, rid long") for schema in schemas) == 1


def test_blocks_give_most_links_before_any_round(spark):
    """Rounds send millions of vectors: 5,000 vectors without structure need none to know most of their nearest."""
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).standard_normal((5000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.usable(e, "vec_id", "embedding").withColumn("node", F.xxhash64("v"))
    nodes = neighbours.stored(neighbours._nodes(found.select("v")), "nodes")
    id_of = {r["node"]: r["vec_id"] for r in found.collect()}
    links = {id_of[r["u"]]: [id_of[w] for w in r["w"]] for r in neighbours.build(nodes, 25, 5000, rounds=0).collect()}
    assert links.keys() == set(range(5000)) and all(len(set(w)) == 32 and u not in w for u, w in links.items())
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -2
    near = np.argsort(-s, axis=1)[:, :32]
    assert np.mean([len(set(links[u]) & set(near[u].tolist())) / 32 for u in range(200)]) > 0.9


def test_a_state_is_one_value_and_comes_back_whole():
    rng = np.random.default_rng(0)
    for d, n in ((3, 1), (64, 160), (5, 7)):
        a, ids, sims, done = rng.standard_normal(d).astype(np.float32), rng.integers(-(2**62), 2**62, n), rng.standard_normal(n).astype(np.float32), rng.random(n) < 0.5
        for want, got in zip((a, ids, sims, done), neighbours._unpack(neighbours._pack(a, ids, sims, done)), strict=True):
            assert np.array_equal(want, got)
