"""Jaccard join, phrase mining and whitening against brute force, on edge cases and on the test tables."""

import random
import re
import time
from collections import Counter, defaultdict
from dataclasses import replace
from fractions import Fraction

import brute
import numpy as np
import pytest
from compare import database, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from weekwise.llm import html_extraction, jaccard_join, phrases, whitening
from weekwise.llm.oracle import ORACLE
from weekwise.llm.registry import QUERIES

# -- 1 pages of few blocks, and hostile ones -----------------------------------------


@pytest.fixture(scope="module")
def page_model():
    return html_extraction.train()


PAGES = [
    ("<nav><a href=/>Home</a></nav><article><p>One sentence here. Another one follows it.</p></article>", "One sentence here. Another one follows it."),
    ("<p>Only one paragraph of text on this page.</p>", "Only one paragraph of text on this page."),
    ("<div>Only one block of text on this page.</div>", "Only one block of text on this page."),
    ("<div>First block of text on this page.</div><div>Second block of text on it.</div>", "First block of text on this page.\nSecond block of text on it."),
    ("<article><p>Intro to the terms.</p><dl><dt>Term</dt><dd>What the term means.</dd></dl></article>", "Intro to the terms.\nTerm\nWhat the term means."),
    ("<article><p>Press <button>Share</button> and read on.</p><p>More text follows here.</p></article>", "Press and read on.\nMore text follows here."),
    ("<article><p>One one one one.</p><p>Two <svg viewBox='0 0 1 1'/> two two.</p><p>Three three three.</p><svg></svg><p>Four four.</p></article>", "One one one one.\nTwo two two.\nThree three three.\nFour four."),
    ("<article><p>Text of the article goes here.</p><form><textarea>draft text of a reader</textarea></form></article>", "Text of the article goes here."),
    ("<main><h1>Title</h1><figure><img src=x><figcaption>A caption of the picture.</figcaption></figure><p>Text of the page here.</p></main>", "Title\nA caption of the picture.\nText of the page here."),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_small_pages(page_model, page, text):
    assert html_extraction.main_text(page, page_model) == text


def test_unseen_plain_pages(page_model):
    right = total = 0
    for page, labels in html_extraction.labelled_pages(0, seed=77, plain=150):
        got = page_model.decode(html_extraction.features(html_extraction.blocks(page)))
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.97


@pytest.mark.parametrize(
    "page",
    ["<" + "a" * 1_000_000, "<b>" * 60_000 + "<p>x" * 60_000, "<div>" * 50_000 + "</i>x" * 50_000, '<a b="x>y ' * 60_000, "<button>x " * 50_000, "<svg>" * 100_000],
    ids=["letters", "open inline", "stray ends", "quotes", "buttons", "svg"],
)
def test_hostile_pages_take_linear_time(page_model, page):
    start = time.process_time()
    html_extraction.main_text(page, page_model)
    assert time.process_time() - start < 10


# -- 11 Jaccard join --------------------------------------------------------------


def near_copies(seed, m):
    """Families of copies with a few edits, so that many pairs lie close to the threshold on either side."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [[r.choice(words) for _ in range(r.choice([5, 12, 40, 90, 130]))] for _ in range(12)]
    rows = []
    for i in range(m):
        b = list(r.choice(bases[: r.choice([1, 12])]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            k, what = r.randrange(len(b)), r.random()
            if what < 0.5:
                b[k] = r.choice(words)
            elif what < 0.8:
                b.insert(k, r.choice(words))
            elif len(b) > 1:
                del b[k]
        rows.append((i, " ".join(b)))
    return rows


def components_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(
    "seed, changes",
    [(1, {}), (2, dict(group_members=7, block_queries=5)), (3, dict(group_tokens=300, block_tokens=500, max_cells=1 << 16, id_bits=1 << 10))],
)
def test_join_finds_every_link(spark, seed, changes):
    rows = near_copies(seed, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = components_of(jaccard_join.similar(docs, replace(jaccard_join.JoinParams(), **changes)))
    assert got == brute.near_groups(rows, 3, 90)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_prefixes_of_linked_sets_meet(a, b, both, seed):
    """Any order of the tokens: the indexed prefix of the smaller set meets the probed one of the larger."""
    p = jaccard_join.JoinParams()
    both = min(both, a, b)
    if not both or 100 * both < p.percent * (a + b - both):
        return
    order = list(range(a + b - both))
    random.Random(seed).shuffle(order)
    x, y = sorted(order[:a]), sorted(order[a - both : a - both + b])
    small, large = sorted([x, y], key=len)
    assert set(small[: p.indexed(len(small))]) & set(large[: p.probed(len(large))])


def test_join_on_the_edge_table(spark, edge, empty):
    got = Counter(tuple(r) for r in jaccard_join.similar(edge).select("doc_id", "n_shingles", "component_id").collect())
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    named = {i: t for i, t in rows if i is not None}
    want = brute.near_groups(list(named.items()), 3, 90)
    expected = Counter((i, *want[i]) for i, _ in rows if i is not None)
    expected += Counter((None, len(brute.shingles(t, 3)), None) for i, t in rows if i is None)
    assert got == expected
    assert jaccard_join.similar(empty).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    a, b = near_copies(9, 2)[0][1], "other words " * 9
    docs = spark.createDataFrame([(5, a), (5, b), (7, a), (3, b), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.similar(docs).collect())
    assert got == [(0, 5), (3, 3), (5, 3), (5, 5), (7, 5)]


def test_op11_on_a_test_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert components_of(QUERIES["op11_ngram_jaccard_join"](spark, sf_dir)) == brute.near_groups(docs, 3, 90)


# -- 12 phrases ---------------------------------------------------------------------


def best_phrases(rows, least, top, longest=5):
    """rows: (lang, text) -> list of (lang, rank, phrase, a, l, r, n, score)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    out = []
    for lang, counts in f.items():
        often = {p: n for p, n in counts.items() if n >= least}
        inside = Counter()
        for p, n in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], n)
        found = []
        for p, a in often.items():
            if len(p) < 2 or inside[p] >= a:
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def chatter(seed, m):
    r = random.Random(seed)
    words = ["the", "of", "cat", "sat", "é", "漢", "x1", "New", "york", "a-b", "\xa0", "so"]
    body = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".\n", " ? "]) for _ in range(r.randint(0, 40)))
    rows = [(r.choice(["en", "fr", None, "und"]), body()) for _ in range(m)]
    return rows + [("en", "new york is so so so so so big. ") for _ in range(m)] + [("en", None), (None, "")]


@pytest.mark.parametrize("changes", [{}, dict(run=20), dict(cells=4), dict(longest=3, top=7)])
def test_phrases(spark, monkeypatch, changes):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    p = replace(phrases.PhraseParams(least=12), **changes)
    rows = chatter(1, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(docs, p).collect())
    assert got == best_phrases(rows, 12, p.top, p.longest) and got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(0, 3), min_size=3, max_size=5), st.integers(1, 4)), max_size=120), st.integers(1, 12), st.booleans())
def test_quicksort_counts_prefixes(rows, least, partial):
    columns = [np.array([lang for lang, _, _ in rows], np.int64)]
    columns += [np.array([w[k] if k < len(w) else -1 for _, w, _ in rows], np.int64) for k in range(5)]
    want = Counter()
    for lang, w, n in rows:
        for k in range(3, len(w) + 1):
            want[(lang, *w[:k])] += n
    got = Counter()
    for row, words, n in phrases.quicksort(columns, np.array([n for _, _, n in rows], np.int64), least, partial):
        got[(rows[row][0], *rows[row][1][:words])] += n
    assert got == Counter({k: n for k, n in want.items() if n >= least or (partial and len(k) < 6)})


def test_phrases_of_nothing(empty, edge):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(edge, phrases.PhraseParams(least=10)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Products of three large counts: the score is a floor of exact integers."""
    big = 9_007_199_254_740_993
    rows = [("en", "", 0, 4 * big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big)]
    table = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: table)
    r = phrases.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert (r.phrase, r.score) == ("a b", 1000 * big * 4 * big // ((big + 7) * (big + 1)))


def test_op12_matches_its_sql(spark, sf_dir):
    assert difference(QUERIES["op12_phrase_collocations"](spark, sf_dir), database(sf_dir), ORACLE["op12_phrase_collocations"]) is None


# -- 13 whitening -----------------------------------------------------------------------


def polynomial(m):
    """Characteristic polynomial by the trace recurrence, constant term first."""
    d = len(m)
    a, b, c = [[Fraction(x) for x in row] for row in m], [[Fraction(i == j) for j in range(d)] for i in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        ab = [[sum(a[i][x] * b[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(x) for x in reversed(c)]


@pytest.mark.parametrize("seed", range(3))
def test_polynomial_modulo_primes(seed):
    r = np.random.default_rng(seed)
    a = r.integers(-50, 50, (6, 6))
    if seed == 1:
        a[:, 2] = a[2] = 0
    p = whitening.primes(40)[-1]
    assert [x % p for x in polynomial(a.tolist())] == whitening.characteristic_mod(a % p, p).tolist()


def test_roots_with_multiplicity():
    values = [9, 9, 4, 4, 4, 1, 0, 0]
    found = whitening.largest_roots(polynomial(np.diag(values).tolist()), 5)
    assert [(round(float(x), 20), n) for x, n in found] == [(9.0, 2), (4.0, 3)]
    assert whitening.largest_roots([0, 0, 1], 3) == []


def test_products_of_large_integers():
    z = np.array([[2**62, -3], [-(2**61) - 5, 2**40 + 1], [7, 0]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]
    assert whitening.exact_products(z).tolist() == want


def whitened(rows, components=32):
    got = sorted(tuple(r) for r in whitening.whiten(rows, components).collect())
    return got, {r[1] for r in got}


def check(got, y):
    """Rows (id, component, n, deviation, whitened, ..) of ids 0.. against numpy's eigenvectors of integer rows y."""
    n, size = len(y), max(r[1] for r in got)
    c = y - y.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:size], v[:, ::-1][:, :size]
    mine = np.array([r[4] for r in got]).reshape(n, size)
    theirs = c @ v / np.sqrt(e)
    assert np.abs(np.abs(mine) - np.abs(theirs)).max() < 1e-8
    exact = [(sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, y.sum(0)))) for row in y]
    assert [int(r[3]) for r in got[::size]] == exact and all(r[2] == n for r in got)
    assert max(r[6] for r in got) < 1e-6
    assert np.allclose([r[5] for r in got[:size]], e / np.trace(c.T @ c / n), rtol=1e-9)


def test_whitening_drops_bad_vectors(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(0, 1, (60, 5))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    bad = [(100, None, "x"), (101, [1.0, None, 0.0, 0.0, 0.0], "x"), (102, [float("nan")] * 5, "x"), (103, [1.0], "x"), (104, [], "x"), (105, [float("inf")] * 5, "x")]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n string").repartition(3)
    got, components = whitened(docs)
    assert components == set(range(1, 6)) and len(got) == 300
    check(got, np.floor(64 * vectors))


def test_whitening_of_few_vectors_and_of_none(spark):
    r = np.random.default_rng(5)
    vectors = np.c_[r.normal(0, 1, (4, 6)), np.ones((4, 2))]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got, components = whitened(docs)
    assert components == {1, 2, 3}
    check(got, np.floor(64 * vectors.astype(np.float32).astype(float)))
    assert whitening.whiten(docs.limit(0)).count() == whitening.whiten(docs.limit(1)).count() == 0


def test_whitening_of_a_repeated_eigenvalue(spark):
    corners = np.array([[a, b, 0.5 * c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], float)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corners)], "vec_id long, embedding array<double>")
    got, _ = whitened(docs)
    w = np.array([r[4] for r in got]).reshape(8, 3)
    assert np.allclose(w.T @ w / 8, np.eye(3), atol=1e-12)
    assert [round(r[5], 12) for r in got[:3]] == [round(4 / 9, 12)] * 2 + [round(1 / 9, 12)]


def test_op13_on_a_test_table(spark, sf_dir):
    got = QUERIES["op13_embedding_whitening"](spark, sf_dir)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    check(sorted(tuple(r) for r in got.collect()), np.floor(64 * np.array(table.embedding.tolist(), float)))
