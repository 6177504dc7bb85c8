import random
from collections import defaultdict

import pyarrow as pa

import corpus_pipeline as P
from refinery.llm import simhash
from refinery.llm.mix import mix, take
from test_decontam import brute, words
from test_shard_mix import check_shards

SF = "/root/testdata/sf0.001"


def plain_groups(rows, least=0.8):
    """Smallest id of each group of texts that links of an exact shingle similarity connect; all pairs are tried."""
    bags, ids = {}, {}
    for d, t in rows:
        w = tuple(words(t))
        bags[d] = frozenset(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([w])
        for g in bags[d]:
            ids.setdefault(g, []).append(d)
    up = {d: d for d in bags}

    def find(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for d, bag in bags.items():
        for o in {o for g in bag for o in ids[g] if o < d}:
            both = len(bag & bags[o])
            if both / (len(bag) + len(bags[o]) - both) >= least:
                a, b = sorted((find(d), find(o)))
                up[b] = a
    return {find(d) for d in bags}


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in simhash.keep_first(docs).collect()}
    want = plain_groups(rows)
    assert want <= got  # nothing goes that is alike to nothing
    assert len(got - want) <= 0.02 * (len(rows) - len(want))  # and of what should go, next to all goes


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    known = P.identify(spark, docs, SF)
    assert known.columns == names and known.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in known.collect()]
    unique = P.deduplicate(spark, known, SF)
    assert unique.columns == names
    left = sorted(plain_groups(rows))
    assert sorted(r.doc_id for r in unique.collect()) == left
    text = dict(rows)
    clean = P.decontaminate(spark, unique, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = sorted(set(left) - {d for d, _ in brute([(d, text[d]) for d in left], items)})
    assert clean.columns == names and sorted(r.doc_id for r in clean.collect()) == left
    mixed = P.mix_sources(spark, clean, SF)
    want = {r.doc_id: r.taken // r["size"] for r in mix(clean).collect() if r["size"]}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
        assert r.text == text[r.doc_id]
    assert mixed.columns == names and dict(got) == {d: n for d, n in want.items() if n}
    out = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(d for d, n in got.items() for _ in range(n))
    check_shards(out, [(r.doc_id, r.text) for r in mixed.collect()], 24)


def test_empty_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
    rows = [(1, "der und die", "de", None, 3), (2, None, None, None, None), (1, "der und die", "de", None, 3), (None, "the of", None, "s", 1), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} <= {1, None}


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text, "x"), (4, text.upper(), "y"), (4, text.upper(), "y"), (7, text + " more", "z"), (5, "other " * 9, "a"), (None, "none of it", "b"), (6, " ".join(text.split()[::-1]), "c"), (8, None, "d"), (10, "", "e")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, own string"))
    assert got.columns == ["doc_id", "text", "own"] and sorted((r.doc_id or -1, r.own) for r in got.collect()) == [(-1, "b"), (4, "y"), (5, "a"), (6, "c"), (8, "d")]


def test_take_repeats_rows(spark):
    rows = [(i, "a b c d", "s") for i in range(4)] + [(100 + i, "a b c d", "t") for i in range(40)]
    got = take(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    n = defaultdict(int)
    for r in got.collect():
        n[r.source] += 1
    assert n["t"] + n["s"] <= 44 and max(n["s"], 1) <= 12


def test_texts_beside_an_unlike_hub_are_compared(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):  # the same words in other orders: one word set, unlike shingles, but each order has two near copies
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(5):
            rng.shuffle(base)
            for k in (0, 1, 2):
                w = list(base)
                w[10 * k + 3], w[10 * k + 4] = w[10 * k + 4], w[10 * k + 3]
                rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows) and len(got) == 30


def test_groups_below_the_hub_are_settled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7, raising=False)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for _ in range(60):  # a large loose group: many pairs are under 0.8, many over
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(2, 6)):
            w[at] = f"x{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(w)))
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def block_edits(n=240, seed=6):
    """Pairs of similarity 0.8 or a little more that differ in one block, or by text added or left out."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = rng.randrange(100, 300)
        w, x = ([f"{c}{k}_{i}" for i in range(size)] for c in "wx")
        most = {0: 0.1, 1: 0.2, 2: 0.2}[k % 3]
        m = int(most * size) - 3
        v = {0: w[:40] + x[:m] + w[40 + m :], 1: w + x[:m], 2: w[:40] + w[40 + m :]}[k % 3]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    return rows


def test_block_edits_and_added_text_meet(spark):
    rows = block_edits()
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert got == want and len(want) < 1.2 * len(rows) / 2


def test_column_names_that_are_used_on_the_way(spark):
    """Extra columns keep their names and cells, whatever the operators call theirs."""
    names = ["_id", "_own", "own", "_size", "_h", "_copy", "_source", "_last0", "_r_own", "_R__size", "node", "label", "key"]
    rows = [(i, f"alpha beta gamma delta epsilon zeta eta theta {'x' if i % 2 else i}", f"s{i % 2}", "en", 5, *[777 + i] * len(names)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for out in (simhash.keep_first(docs), take(docs)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r) == rows[r[0]] for r in got)


def near_copies(n=40, seed=9):
    """Texts of 400 words, each with a copy that differs in one word."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        w = [f"w{k}_{rng.randrange(10**6)}" for _ in range(400)]
        v = list(w)
        v[rng.randrange(400)] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    return rows


def test_simhash_finds_near_copies_by_itself(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == plain_groups(rows)
    monkeypatch.setattr(simhash, "bands_for", lambda least: 0)
    got = {r.doc_id for r in simhash.keep_first(docs).collect()}
    want = plain_groups(rows)
    assert want <= got and len(got - want) <= 0.1 * len(want)  # a word's change turns four bits or fewer, but for a few


def test_fingerprints_of_shingles_bit_by_bit():
    rng = random.Random(10)
    texts = pa.array(["", "one two", None, "a b c d e", *(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 300))) for _ in range(30))])
    g, first = simhash.shingle_hashes(texts, 5)
    want = [sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in g[a:b]) > b - a) for a, b in zip(first, first[1:], strict=False)]
    assert simhash.shingle_prints(texts, 5).tolist() == want
    assert simhash.shingle_prints(texts.slice(0, 0), 5).tolist() == []
