"""Language identification, whitening and spelling variants against plain Python; awkward inputs with what they should give."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hindsight.llm import langid, queries, variants, whitening
from hindsight.llm.common import table
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# language


def spelled(seed, letters, words, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)]
    return [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n)]


def plain_grams(text):
    """Every n-gram without an inner blank, over words with a blank at both ends."""
    out = []
    t = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for n in langid.SIZES:
        out += [t[i : i + n] for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1] and t[i : i + n].strip()]
    return Counter(out)


@pytest.mark.parametrize("text", ["Zwei-Wörter, 3 mal!", "a", "  x  ", "éà É\nß_ñ 中文 ab"])
def test_grams_are_those_of_plain_python(text):
    c = langid.code_points(text)
    found = Counter()
    for size, (at, h) in zip(langid.SIZES, langid.grams(c, 0, len(c)), strict=False):
        found.update("".join(map(chr, c[i : i + size])) for i in at)
        assert len(set(h.tolist())) == len({tuple(c[i : i + size]) for i in at})
    assert found == plain_grams(text)


def test_evidence_is_the_corrected_popcount_and_chunks_do_not_matter(monkeypatch):
    r = np.random.default_rng(1)
    filters = (r.integers(0, 256, (64, 3)) & r.integers(0, 256, (64, 3))).astype(np.uint8)
    model = langid.Model(["a", "b", "c"], filters, np.array([0.5, 0.1, 0.0]))
    texts = ["one two", "", "12", "three " * 50, "vier"]
    whole, has = model.evidence(texts)
    assert has.tolist() == [True, False, False, True, True]
    for text, row in zip(texts, whole, strict=True):
        c, want, n = langid.code_points(text), np.zeros(3), 0
        for _, h in langid.grams(c, 0, len(c)):
            n += len(h)
            want += np.array([[bin(x).count("1") for x in filters[int(k) % 64] & filters[(int(k) >> 32) % 64]] for k in h]).reshape(-1, 3).sum(axis=0)
        assert np.allclose(row, (want - n * model.false) / (1 - model.false / langid.LEVELS))
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert np.allclose(model.evidence(texts)[0], whole)


def test_filters_hold_every_frequent_gram(spark):
    texts = [(i, t, lang, "s", 0) for lang, letters in (("x", "abcde"), ("y", "cdefg")) for i, t in enumerate(spelled(letters, letters, 30, 40))]
    model = langid.fit(spark.createDataFrame(texts, SCHEMA))
    for k, lang in enumerate(("x", "y")):
        docs = [plain_grams(t[1]) for t in texts if t[2] == lang]
        total = Counter(g for d in docs for g in d.elements())
        by_size = Counter({n: sum(c for g, c in total.items() if len(g) == n) for n in langid.SIZES})
        for g, c in total.items():
            if sum(g in d for d in docs) > 1:
                point = np.array([ord(x) for x in g], np.uint32)
                h = langid._mixed(np.array([sum(int(p) * pow(0x100000001B3, len(g) - 1 - i, 1 << 64) for i, p in enumerate(point)) + (len(g) << 56) & (1 << 64) - 1], np.uint64))
                level = int(np.floor(np.log(c / by_size[len(g)] / langid.FLOOR) / np.log(4) + 1e-9))
                if level >= 0:
                    want = (2 << min(level, langid.LEVELS - 1)) - 1
                    assert model.masks(h)[0, k] & (want >> 1) == want >> 1


def test_language_of_held_out_documents(spark):
    d = table(spark, DATA, "documents")
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    got = langid.language_id(d).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == len(truth) and {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    en, de = spelled(1, "aeiotn", 20, 30), spelled(2, "uöschrk", 20, 30)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(en)] + [(100 + i, t, "de", "s", 0) for i, t in enumerate(de)]
    rows += [(200, None, "en", "s", 0), (201, "", "de", "s", 0), (202, " 12 ... ", None, "s", 0), (None, en[0], None, "s", 0), (203, "中文", None, "s", 0), (204, en[1] * 3000, None, "s", 0), (204, en[1] * 3000, None, "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as held_out", "'x' as lang_pred", "2 as score")
    got = langid.language_id(d).collect()
    said = {}
    for r in got:
        said.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert [said[i] for i in (200, 201, 202)] == [[("und", 0.0)]] * 3
    assert said[None][0][0] == "en" and said[203][0][0] in ("de", "en") and len(said[204]) == 2 and said[204][0] == said[204][1] and said[204][0][0] == "en"
    assert all(said[i][0][0] == "en" for i in range(30)) and all(said[100 + i][0][0] == "de" for i in range(30))
    assert langid.language_id(d.limit(0)).collect() == []
    nothing = langid.language_id(d.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)


# whitening


def direct(c, k=8):
    x = np.floor(1024 * c.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    m = x - s / n
    e, v = np.linalg.eigh(m.T @ m / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), m @ v / np.sqrt(e), e / np.trace(m.T @ m / n)


def compare(got, ids, c, k=8, tolerance=1e-7):
    deviation, whitened, explained = direct(c, k)
    rows = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    assert len(rows) == len(c) * k and [r["vec_id"] for r in rows] == [i for i in sorted(ids) for _ in range(k)]
    order = np.argsort(ids)
    z = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    assert [r["deviation"] for r in rows[::k]] == deviation[order].tolist() and {r["n"] for r in rows} == {len(c)}
    assert np.allclose(z * np.sign((z * whitened[order]).sum(axis=0)), whitened[order], atol=tolerance)
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    t = table(spark, DATA, "embeddings").collect()
    compare(queries.op12_whitening(spark, DATA).collect(), [r["vec_id"] for r in t], np.array([r["embedding"] for r in t], np.float32))


@pytest.mark.parametrize("scale", [np.ones(12), 2.0 ** -np.arange(12), np.repeat([4.0, 1.0], 6)], ids="flat steep two".split())
def test_whitening_by_spectrum(spark, scale):
    c = (np.random.default_rng(3).standard_normal((500, 12)) * scale * 8).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<float>")
    compare(whitening.whiten(df).collect(), list(range(500)), c)


def test_one_component_many_times_over(spark):
    """Deviations that are equal: a start from one vector sees each of them once only, the fresh ones see the rest."""
    c = np.concatenate([np.eye(20), -np.eye(20)]) * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 40 * 8 and {round(r["explained"], 9) for r in got} == {0.05} and got[0]["identity_error"] < 1e-9


def test_an_early_end_finds_what_the_whole_process_finds(spark):
    r = np.random.default_rng(5)
    c = r.standard_normal((300, 8)) @ r.standard_normal((8, 60)) * 50 + r.standard_normal((300, 60)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<double>")
    compare(whitening.whiten(df).collect(), list(range(300)), c)


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 2.0]), (2, [0.0, 1.0, 2.0]), (None, [3.0, 5.0, 2.0]), (2, [0.0, 1.0, 2.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, []), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as x", "3 as whitened")
    got = whitening.whiten(df).collect()
    # the third dimension is constant: two components
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((i, k) for i in ("1", "2", "2", "None") for k in (1, 2)) and {r["n"] for r in got} == {4}
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 1")).collect() == [] and whitening.whiten(df.where("vec_id = 3")).collect() == []


# variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w in n:
        near = [v for v in n if one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, n[w], len(near)]
    rows = []
    for w, (form, c, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, c, near, n[form] if form else None))
    return sorted(rows)


def test_variants_against_brute_force(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefghéß") for _ in range(r.randint(5, 11))) for _ in range(25)]

    def edit(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abéÿ") + w[i + 1 :], w[:i] + r.choice("abÉ×") + w[i:]])

    words = [w for b in base for w in [b] * 150 + [edit(b)] * 27 + [edit(edit(b))] * 6]
    words += ["abcdefgh"] * 200 + ["abcdefgx"] * 35 + ["abcdexgx"] * 6  # a form that has a form itself
    texts = [(k, " ".join(x.upper() if r.random() < 0.1 else x for x in words[k::40]) + r.choice(["", ", 12-x_y", "\n"])) for k in range(40)]
    texts += [(7, texts[7][1]), (None, texts[3][1]), (50, None), (51, ""), (52, "x"), (53, "ab" * 5000 + " " + "÷×" * 4)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).selectExpr("*", "1 as word", "'c' as n", "0 as id")
    want = brute(texts)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)
    assert sorted(map(tuple, variants.variants(d).collect())) == want
    assert variants.variants(d.limit(0)).collect() == []


def test_each_near_pair_shares_a_signature(spark):
    r = random.Random(4)
    words = ["".join(r.choice("aabcdeé") for _ in range(r.randint(6, 12))) for _ in range(300)]
    edited = [w[:i] + x + w[i + k :] for w in words for i, x, k in ((r.randrange(len(w)), "", 1), (r.randrange(len(w)), "z", 1), (r.randrange(len(w) + 1), "a", 0))]
    pairs = [(w, v) for w, v in zip([w for w in words for _ in range(3)], edited, strict=True)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a string, b string")
    for parts in (3, 5, variants.PARTS):
        assert df.where(~F.arrays_overlap(variants.signatures(F.col("a"), parts), variants.signatures(F.col("b"), parts))).count() == 0


def test_variants_equal_their_sql(spark, duck):
    want = duck.execute(queries.oracle_sql()["op13_variants"]).fetchall()
    assert sorted(map(tuple, queries.op13_variants(spark, DATA).collect())) == sorted(want) and want
