import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from refinery.llm import decontam as D

BENCH = "/root/testdata/sf0.01/benchmark.parquet"
DOCS = "/root/testdata/sf0.01/documents.parquet"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items, least=0.8):
    """All pairs whose best window, of any length that could be, is similar enough."""
    out = {}
    bags = {i: grams(words(t)) for i, t in items}
    for d, t in docs:
        w = words(t)
        for i, text in items:
            n, bag = len(words(text)), bags[i]
            if not n or (n >= 5 and not set(bag) & set(grams(w))):
                continue
            best = 0.0
            # a window of other than 0.8 to 1.25 times the item's shingles can't reach 0.8
            for m in [n] if n < 5 else range(4 + int(least * (n - 4)), 5 + math.ceil((n - 4) / least)):
                for s in range(len(w) - m + 1):
                    other = grams(w[s : s + m])
                    both = sum((bag & other).values())
                    best = max(best, both / (sum(bag.values()) + sum(other.values()) - both))
            if best >= least:
                out[d, i] = best
    return out


def test_documents_against_brute_force(spark):
    docs, bench = spark.read.parquet(DOCS), spark.read.parquet(BENCH)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(docs, bench).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert set(got) == set(want) and len(got) >= 15
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edited_passages_are_found(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(BENCH).collect()]
    other = " ".join(r.text for r in spark.read.parquet(DOCS).limit(40).collect()).split()
    docs = []
    for k in range(150):
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [rng.choice(other)] if kind != 2 else []
        a = rng.randrange(len(other) - 200)
        docs.append((k, " ".join(other[a : a + 60] + w + other[a + 60 : a + 90]).upper()))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and got == set(want)


def test_punctuation_beyond_ascii_parts_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = ["“" + item + "”", item.replace("alpha beta", "alpha—beta"), "«" + item.replace(" ", "\u00a0") + "»…", item.replace(" ", "、"), "x" + item.replace("alpha", "älpha")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = D.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.similarity for r in found if r.similarity == 1.0} == dict.fromkeys(range(4), 1.0)


def test_multi_index_guarantee():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, n))) for i, n in enumerate(rng.integers(3, 70, 60))]
    index = D.Index(items, 11)
    for size, which, prints, blocks in index.classes:
        for p_at, p in enumerate(prints):
            for _ in range(20):
                flip = np.uint64(sum(1 << int(b) for b in rng.choice(64, 11, replace=False)))
                w = p ^ flip
                hits = set()
                for b, (there, starts, owners) in enumerate(blocks):
                    key = int(w >> np.uint64(16 * b)) & 0xFFFF
                    assert bool(there[key]) == (starts[key + 1] > starts[key])
                    hits.update(owners[starts[key] : starts[key + 1]].tolist())
                assert p_at in hits


def test_window_prints():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 700, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    old, D.CHUNK = D.CHUNK, 100
    try:
        made = {}
        for at, out in D.window_prints(h, [1, 5, 255, 300]):
            for size, w in zip([1, 5, 255, 300], out):
                made.setdefault(size, []).extend(w.tolist())
    finally:
        D.CHUNK = old
    for size, got in made.items():
        want = [np.packbits(bits[s : s + size].sum(0) > size // 2).view(np.uint64)[0] for s in range(len(h) - size + 1)]
        assert got == want


def test_edges_and_parts(spark, monkeypatch):
    schema = "doc_id long, text string, item_id string"
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "!!!"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = [(1, "zero One, two THREE four", "x"), (2, None, None), (3, "", "x"), (4, "one two four three", "x"), (5, "q " * 60000 + "a b c d e f g h i j k l", "x"), (5, "a b c d e f g h i j k l", "x"), (None, "one two three", "x")]
    docs = spark.createDataFrame(rows, schema)
    for most in (20_000, 1):
        monkeypatch.setattr(D, "MOST_ITEMS", most)
        got = sorted((r.doc_id or -1, r.item_id, r.start_word) for r in D.contaminated(docs, items).collect())
        assert got == [(-1, 1, 0), (1, 1, 1), (5, 5, 0), (5, 5, 60000)]
    assert D.contaminated(docs.limit(0), items).collect() == [] and D.contaminated(docs, items.limit(0)).collect() == []
    assert D.clean(docs, items.limit(0)).count() == 7
    assert len(D.word_hashes(pa.array([], pa.string()))[0]) == 0


def best_of_all(w, item):
    """Similarity of the best window of any length."""
    bag, best = grams(item), 0.0
    made, size = [tuple(w[i : i + 5]) for i in range(len(w) - 4)], sum(bag.values())
    for a in range(len(made)):
        other, both = Counter(), 0
        for n, g in enumerate(made[a:], 1):
            other[g] += 1
            both += other[g] <= bag[g]
            best = max(best, both / (size + n - both))
    return best


def test_words_put_in_or_left_out(spark):
    rng = random.Random(8)
    items, docs, want = [], [], set()
    for k, size in enumerate([59, 15, 22, 41, 120, 59, 33, 80]):
        w = [f"i{k}x{j}" for j in range(size)]
        items.append((k, " ".join(w)))
        for n, cut in ((0, 1), (size // 12, 0), (size // 10, 0), (0, size // 12), (0, size // 6), (size // 3, 0)):
            at = size - 1 if cut == 1 else size // 2
            v = w[:at] + [f"n{rng.randrange(10**9)}" for _ in range(n)] + w[at + cut :]
            for pad in (0, 6):  # alone, and in other text
                d = [f"p{j}" for j in range(pad)] + v + [f"q{j}" for j in range(pad)]
                docs.append((len(docs), " ".join(d)))
                if best_of_all(d, w) >= 0.8:
                    want.add((docs[-1][0], k))
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and 30 < len(want) < len(docs)
    for r in found[::5]:
        d, w = docs[r.doc_id][1].split(), items[r.item_id][1].split()
        assert abs(r.similarity - best_of_all(d, w)) < 1e-9 and d[r.start_word : r.start_word + r.n_words][0] in w


def test_edits_in_other_text_at_all_lengths(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(BENCH).collect()]
    other = " ".join(r.text for r in spark.read.parquet(DOCS).limit(40).collect()).split()
    docs = []
    for k in range(150):
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice([1, 2, 2, 3])):
            at, kind, n = rng.randrange(len(w)), rng.randrange(3), rng.randrange(1, 6)
            w[at : at + (n if kind != 1 else 0)] = rng.choices(other, k=n) if kind != 2 else []
        a = rng.randrange(len(other) - 200)
        docs.append((k, " ".join(other[a : a + 60] + w + other[a + 60 : a + 90]).upper()))
    long = [(i, words(t)) for i, t in items if len(words(t)) >= 5]
    want = {(d, i) for d, t in docs for i, w in long if best_of_all(words(t), w) >= 0.8}
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    short = {i for i, t in items if len(words(t)) < 5}
    assert len(want) > 15 and {(r.doc_id, r.item_id) for r in found.collect() if r.item_id not in short} == want
