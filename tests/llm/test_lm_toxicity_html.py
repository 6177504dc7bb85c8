import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refinery.llm import html_extract as H
from refinery.llm import lm_score as M
from refinery.llm import common
from refinery.llm import toxicity as T
from refinery.llm.common import held_out

SF = "/root/testdata/sf0.1"


# language-model scoring


def plain_losses(texts, marks, which, text):
    """The same two models from plain dictionaries: tokens of ``text`` and the sum of its losses."""
    import math
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    every = Counter(w for t in texts for w in split(t))
    all_tokens = sum(every.values())
    common = {w for w, n in every.items() if n >= all_tokens * M.LEAST_SHARE}
    event = lambda w: w if w in common else None
    words, pairs, begun = Counter(), Counter(), 0
    for t, m in zip(texts, marks):
        w = split(t)
        if w and (which == 0 or m):
            begun += 1
            words.update(w)
            pairs.update(zip(["<", *map(event, w)], map(event, w)))
    n, kinds = sum(words.values()), len(every) - len(common)
    rare = sum(c for w, c in words.items() if w not in common)
    seen = lambda e: begun if e == "<" else rare if e is None else words[e]
    even = 1 / (len(common) + 2)
    alone = lambda e: (1 - M.EVEN) * seen(e) / (n + begun) + M.EVEN * even if n else even
    out = 0.0
    for a, w in zip(["<", *map(event, split(text))], split(text)):
        out -= math.log((pairs[a, event(w)] + M.PRIOR * alone(event(w))) / (seen(a) + M.PRIOR))
        if event(w) is None:
            out -= math.log((1 - M.EVEN) * words[w] / rare + M.EVEN / (kinds + 1) if rare else 1 / (kinds + 1))
    return len(split(text)), out


def check_against_plain(spark, rows, chosen):
    """rows: (doc_id, text); every score against the plain models'."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    target = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    got = {r.doc_id: r for r in M.score(docs, target).collect()}
    texts, marks = [t for _, t in rows], [i is not None and i in chosen for i, _ in rows]
    assert len(got) == len(rows)
    for i, t in rows:
        n, background = plain_losses(texts, marks, 0, t)
        _, wanted = plain_losses(texts, marks, 1, t)
        assert got[i].n_tokens == n
        if not n:
            assert (got[i].score, got[i].loss_target, got[i].loss_background) == (None, None, None)
            continue
        assert got[i].loss_background == pytest.approx(background / n, abs=1e-5)
        assert got[i].loss_target == pytest.approx(wanted / n, abs=1e-5)
        assert got[i].score == pytest.approx((wanted - background) / n, abs=2e-5)
    return got


def test_losses_against_plain_models(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a dog on a log", "cat cat cat", "", None]
    got = check_against_plain(spark, list(enumerate(texts)), [0, 3, 3, 99, None])
    assert got[3].score < got[1].score


@pytest.mark.parametrize("top, share, sent", [(1022, 2.0**-22, 100), (20, 2.0**-11, 100), (0, 1.0, 0), (5, 2.0**-9, 0)])
def test_dealt_bigrams_and_rare_words(spark, monkeypatch, top, share, sent):
    """Over a thousand words; few in the square table, many rare, target marks sent or joined: one result."""
    monkeypatch.setattr(M, "TOP", top)
    monkeypatch.setattr(M, "LEAST_SHARE", share)
    monkeypatch.setattr(common, "MOST_SENT", sent)
    monkeypatch.setattr(M, "MOST_HELD", 500)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.2, rng.integers(0, 120)), 3000))) for i in range(150)]
    assert len({w for _, t in rows for w in t.split()}) > 1024
    check_against_plain(spark, rows, list(range(0, 150, 4)))


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    n = 40
    counts = rng.integers(1, 9, (2, n))
    v = M.Vocabulary(rng.integers(2, 1 << 60, n).astype(np.uint64), counts, np.array([6, 0]), 5, np.array([7, 3]))
    assert np.allclose(v.alone.sum(axis=1), 1)
    split = rng.multinomial(counts[0, 3], np.full(n + 2, 1 / (n + 2)))  # what followed word 3
    p = np.exp(-v.loss(0, np.full(n + 2, 3), np.arange(n + 2), split) / M.UNIT)
    assert p.sum() == pytest.approx(1, abs=1e-4)
    for which, some in ((0, [3, 1, 1, 1, 0, 0]), (1, [0, 0, 0, 0, 0, 0])):
        assert np.exp(-v.rare_loss(which, np.array(some)) / M.UNIT).sum() == pytest.approx(1, abs=1e-4)


def test_texts_that_occur_twice_score_apart(spark):
    """The background model counts the whole corpus, so a second copy of a text lowers its background loss."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 80))) for i in range(60)]
    twice = [(100 + i, rows[i][1]) for i in range(5)]
    docs = spark.createDataFrame(rows + twice, "doc_id long, text string")
    got = {r.doc_id: r.score for r in M.score(docs, spark.createDataFrame([(59,)], "doc_id long")).collect()}
    assert min(got[i] for i in range(5)) > max(got[i] for i in range(5, 59))


def test_lm_edges(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], "doc_id long")
    assert M.score(spark.createDataFrame([], schema), none).collect() == []
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a"), (None, "c"), (None, None), (2, "w " * 50000)], schema)
    got = M.score(rows, none).collect()
    assert len(got) == 6 and sum(r.score is None for r in got) == 1 and all(np.isfinite(r.score) for r in got if r.n_tokens)
    assert len({r.score for r in got if r.doc_id == 1 and r.n_tokens == 2}) == 1
    named = M.score(spark.createDataFrame([("x", "a b"), ("y", "b")], "doc_id string, text string"), spark.createDataFrame([("x",)], "doc_id string"))
    assert {r.doc_id: r.n_tokens for r in named.collect()} == {"x": 2, "y": 1}


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = T.score(docs, T.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r.toxic for r in found]), np.array([r.predicted for r in found])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert y[p == 1].mean() > 0.95 and p[y == 1].mean() > 0.8


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in T.score(docs, T.train(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def simulated(seed, n=6000):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    hit, false = [0.8, 0.6, 0.7, 0.5], [0.05, 0.02, 0.1, 0.05]
    return y, np.stack([rng.random(n) < np.where(y, a, b) for a, b in zip(hit, false)], axis=1), hit, false


def fitted(spark, v):
    """The label model of rows of votes, and that it is the same however they are spread."""
    rows = spark.createDataFrame([(int(x), 1) for x in T.packed(v)], "pattern long, n long")
    m = T.fit_label_model(rows, v.shape[1])
    again = T.fit_label_model(rows.groupBy("pattern").agg(F.sum("n").alias("n")).repartition(3), v.shape[1])
    assert np.array_equal(m.log, again.log) and m.prior == again.prior
    return m


def test_label_model_finds_accuracies_without_labels(spark):
    y, v, hit, false = simulated(1)
    m = fitted(spark, v)
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.95 and abs(m.prior - 0.2) < 0.03
    assert np.allclose(m.fire[1], hit, atol=0.1) and np.allclose(m.fire[0], false, atol=0.05)


def test_label_model_knows_correlated_voters(spark):
    """A voter that comes three times over weighs about as much as one."""
    y, v, *_ = simulated(2)
    one, three = fitted(spark, v), fitted(spark, np.concatenate([v, v[:, :1], v[:, :1]], axis=1))
    assert ((three.posterior(np.concatenate([v, v[:, :1], v[:, :1]], axis=1)) > 0.5) == y).mean() > 0.95
    tied = {frozenset((j, p)) for j, p in enumerate(three.parent) if p >= 0}
    assert len(tied & {frozenset(x) for x in ((0, 4), (0, 5), (4, 5))}) == 2  # the copies hang together
    for first in (False, True):
        for rest in ([False, False, False], [True, False, False], [False, True, True]):
            alone, again = one.posterior(np.array([[first, *rest]])), three.posterior(np.array([[first, *rest, first, first]]))
            odds = lambda p: float(np.log(p / (1 - p))[0])
            # two more voters of their own would add 5.5, or take 3.1 away: copies come nearer to none than to that
            assert abs(odds(alone) - odds(again)) < (5.5 if first else 3.1) / 2


def test_toxicity_edges(spark, monkeypatch):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(i, f"calm text {i}" if i % 2 else f"scum and trash {i}", "x") for i in range(200)] + [(200, None, None), (201, "", ""), (201, "", ""), (None, "scum", "x"), (202, "word " * 30000 + "scum trash", "x")], schema)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)] + [(3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score(docs, T.train(docs, labels)).collect()}
    assert len(got) == 204 and got[0].predicted == 1 and got[1].predicted == 0 and got[202].predicted == 1 and got[None].predicted == 1
    assert got[200].score == got[201].score < 0.5 and got[None].held_out is False
    monkeypatch.setattr(common, "MOST_SENT", 0)  # labels are joined: the same scores
    assert {r.doc_id: r.score for r in T.score(docs, T.train(docs, labels)).collect()} == {k: r.score for k, r in got.items()}
    nothing = T.score(docs, T.train(docs, labels.limit(0))).collect()
    assert {r.score for r in nothing} == {0.0}
    assert T.score(docs.limit(0), T.train(docs.limit(0), labels)).collect() == []


# extraction


LONG = "Water had risen over the fields in the night, and nobody could cross the bridge before the evening of the next day."


@pytest.fixture(scope="module")
def tree():
    return H.train()


def test_tree_fits_its_table():
    x, y = H.labelled_table()
    assert x.shape[1] == len(H.FEATURES) and (H.train().predict(x) == y).mean() > 0.97


def test_tree_sees_neighbours_and_holds_on_unseen_pages():
    right = n = 0
    for i, page in enumerate(H.LABELLED):
        x, y = H.labelled_table([page])
        right += (H.train([p for j, p in enumerate(H.LABELLED) if j != i]).predict(x) == y).sum()
        n += len(y)
    assert right / n > 0.95
    used, todo = set(), [H.train()]
    while todo:
        t = todo.pop()
        if t.cut is not None:
            used.add(H.FEATURES[t.cut[0]])
            todo += [t.low, t.high]
    assert {"words", "links", "words_before", "words_after", "links_before", "links_after"} <= used


def test_pages_against_their_articles(spark, tree):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, tree).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{LONG}</p><form><p>{LONG}</p><input name=x></form><p>a &amp; b &lt;c&gt; &#233;&nbsp; x</p></article>", f"{LONG}\na & b <c> é x"),
        (f"<nav><p>{LONG}</p></nav><article><p>One.</p><script>var a = '<p>x</p>';</script><style>p {{}}</style><p>Two</p></article>", "One.\nTwo"),
        (f"<main><h1>T</h1><p>{LONG}</p></main><aside><p>{LONG}</p></aside><div class='comment-list'><article><p>{LONG}</p></article></div>", f"T\n{LONG}"),
        (f"<article><p>a<b>b</b><i>c</i> d<br>e</p><!-- <p>no</p> --><p title='x>y'>f</p><div class=\"ad-box\">{LONG}</div></article>", "abc d e\nf"),
        (f"<header><p>{LONG}</p></header><div id='content'><header><h1>T</h1></header><p>{LONG}</p></div><footer><p>{LONG}</p></footer>", f"T\n{LONG}"),
        (f"<div class='cookie-banner'>{LONG}</div><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"{LONG}\n{LONG}\nShort.\n{LONG}"),
        (f"<div class='discussion-paper'><h1>T</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div class='notice'><p>{LONG}</p></div>", f"T\n{LONG}\nYes.\n{LONG}"),
        (f"<form id='page'><nav><a href=x>Home</a></nav><article><p>{LONG}</p><form><p>Your name</p></form></article></form>", LONG),
        (f"<form id='page'><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n{LONG}"),
        (f"<body class='has-sidebar'><div class='wrap sidebar'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        (f"<div class='no-ads has-comments'><article><p>{LONG}</p></article></div><div class='post-comments'><p>{LONG}</p></div>", LONG),
        (f"<div><a href=a>One</a></div><div><a href=b>Two</a></div><div>{LONG}</div><div>{LONG}</div><div><a href=c>Three</a></div><div>Imprint</div><div><a href=d>Four</a></div>", f"{LONG}\n{LONG}"),
        ("<form><p>Name</p><input name=a><p>Password</p></form>", ""),
        ("", ""),
        (None, ""),
        ("<article></article>", ""),
        ("<article><p>x < y and z > 1</p></article>", "x < y and z > 1"),
        (f"<body><article><p>{LONG}<form><p>f</p></article><p>x</p></body>", LONG),
    ],
)
def test_structures(tree, page, want):
    assert H.main_text(page, tree) == want


def test_html_edges(spark, tree):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert H.extract(spark.createDataFrame([], schema), tree).collect() == []
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 1), (None, "u", "<article><p>" + "word " * 200000 + "</p></article>", None, None), (2, "u", "<" * 5000 + "<p" * 1000, "", 0), (3, "u", "<article><p>a<p" + " x='" * 50, "", 0)]
    got = H.extract(spark.createDataFrame(rows, schema), tree).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in got if r.page_id not in (2, 3)) == [(-1, 999999), (1, 0), (1, 0)]
    assert all(r.text == H.main_text(dict((k, h) for k, _, h, *_ in rows)[r.page_id], tree) for r in got if r.page_id in (2, 3))
