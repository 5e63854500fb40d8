"""Pages whose names, nesting or neighbours would mislead the extraction; the scan against all runs; awkward tables."""

import random

import pytest

from hindsight.llm import html
from tests.conftest import DATA


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


A, B = words(21, "a"), words(60, "b")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><article><p>{A}</p></article><div id="feedback"><p>{B}</p></div></body>', A),
        (f"<body><article><p>{A}</p></article><div><p>{B}</p></div></body>", A),
        (f"<body><div><p>{B}</p></div><article><p>{A}</p></article></body>", A),
        (f'<article><p>{A}</p><div class="ad-free story"><p>{B}</p></div></article>', f"{A}\n{B}"),
        (f'<article><p>{A}</p><section id="search"><p>{B}</p></section></article>', f"{A}\n{B}"),
        (f'<article><p>{A}</p><section id="search"><input><p>{B}</p></section></article>', A),
        (f'<article><p>{A}</p><div class="share"><a href=x>{B}</a></div></article>', A),
        (f'<article><p>{A}</p><div class="notice"><p>{B}</p></div></article>', A),
        (f'<article><h1>T</h1><p class="byline">By A</p><p>{A}</p></article>', f"T\nBy A\n{A}"),
        (f"<body><main><p>{B}</p><article><p>{A}</p></article></main></body>", f"{B}\n{A}"),
        (f"<body><main><article><p>{A}</p></article><article><p>{B}</p></article></main></body>", f"{A}\n{B}"),
        (f"<body><p>{words(200)}</p><article>Read on</article></body>", words(200)),
        (f'<body><div class="no-sidebar with-comments"><p>{A}</p></div></body>', A),
    ],
)
def test_names_nesting_and_neighbours(page, want):
    assert html.main_text(page) == want


def test_prose_is_found_by_what_an_element_holds():
    page = f'<div><p>{A}</p></div><section><input>{A}</section><ul><li><a href=x>{A}</a></ul><p>{words(19)}</p><div>{A}'
    assert html._prose(page) == {page.index("<div>"), page.index("<p>"), page.rindex("<div>")}
    assert html._prose("") == frozenset() and html._prose("</div></p>") == frozenset()


def test_the_scan_finds_the_best_of_all_runs():
    r = random.Random(4)
    for _ in range(300):
        v = [r.choice([-3.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(r.randrange(12))]
        sums = [(sum(v[i:j]), i, j) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]
        a, b = html.best_run(v)
        assert sum(v[a:b]) == max([0.0, *(s for s, _, _ in sums)])
        assert (a, b) == (0, 0) or v[a] > 0


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    html.main_text("<article>" + f'<div class="search"><p>{A}</p>' * 20_000)
    html.main_text("<article>" + '<div class="search">a' * 50_000)
    assert time.time() - began < 20


def test_awkward_tables(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", f"<article>{A}</article>", "x"), (3, "w", f"<p>{A}", "x"), (3, "w", f"<p>{A}", "x"), (4, "z", "<p>" + "word " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")  # text: a name that the result has too
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract(pages).collect()), key=str)
    long = " ".join(["word"] * 200_000)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", A, len(A)), (3, "w", A, len(A)), (3, "w", A, len(A)), (4, "z", long, len(long))], key=str)
    assert html.extract(pages.limit(0)).collect() == []


def test_every_page_keeps_a_row(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = html.extract(pages)
    assert got.count() == pages.count() and got.select("page_id").exceptAll(pages.select("page_id")).count() == 0
