import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from refinery.llm import simhash as S
from refinery.llm.components import components


def plain_fingerprint(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, radius=4):
    label = {i: i for i in range(len(rows))}
    fps = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = label[i], label[int(j)]
            if a != b:
                for k, v in label.items():
                    if v == max(a, b):
                        label[k] = min(a, b)
    groups = {}
    for i, v in label.items():
        groups.setdefault(v, []).append(rows[i][0])
    return {d: min(x for x in g) for g in groups.values() for d in g}


def test_fingerprint_matches_definition():
    texts = ["", None, " \t\n", "One", "a b c", "a b c d", "A a a a a a a a", "Éa\x0bb\x1cc É d e f g " * 7, "x y z w v " * 50000]
    for t in texts[:-1]:
        assert S.fingerprint(t) == plain_fingerprint(t)
    assert S.fingerprint(texts[-1]) == plain_fingerprint(texts[-1])


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()}
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert {d: f for d, f in rows} == {d: f for d, (f, _) in got.items()}
    assert plain_components(rows) == {d: c for d, (_, c) in got.items()}


def classes(label):
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_every_pair_within_radius_is_linked(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        for n in (1, 2, 3, 4, 5, 6):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    centre = rng.getrandbits(64)  # a dense group
    fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)}
    rows = sorted((f - (f >> 63 << 64),) for f in fps)
    for blocks in (4, 12):
        labels = components(S.fingerprint_links(spark.createDataFrame(rows, "fp long"), 4, blocks))
        got = {r.node: r.label for r in labels.collect()}
        want = plain_components([(f[0], f[0] % 2**64) for f in rows])
        assert classes({f[0]: got.get(f[0], f[0]) for f in rows}) == classes(want)


def test_links_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 50, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(5), fps ^ np.uint64(1 << 40)]))
    names, masks = S._masks_by_word(4, 2)
    by_word = dict(zip(names.tolist(), masks))
    whole = S.links_in_word(fps, 1, 4, 2, by_word)
    monkeypatch.setattr(S, "VARIANTS", 1 << 10)
    sliced = S.links_in_word(fps, 1, 4, 2, by_word)

    def groups(links):
        up = {int(f): int(f) for f in fps}
        for a, b in links:
            up = {k: up[a] if v == up[b] else v for k, v in up.items()}
        return {frozenset(k for k, v in up.items() if v == r) for r in up.values()}

    variants = [{int(v) for v in f ^ S.ball(2) if S.parity(np.array([v]), 2)[0] == 1} for f in fps]
    plain = [(int(a), int(b)) for (a, x), (b, y) in __import__("itertools").combinations(zip(fps, variants), 2) if x & y]
    assert groups(whole) == groups(sliced) == groups(plain) and len(whole) == len(sliced) == len(fps) - len(groups(plain))


def test_edges(spark):
    schema = "doc_id long, text string, fp string, node long"
    assert S.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, None, "x", 1), (3, "", "x", 1), (9, "  ", None, 2), (7, "one two", "x", 1), (7, "one two", "x", 1), (None, "one two", "x", 1), (8, "long " * 40000, "", 3)]
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 7), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 3)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1000, 1300)]
    star = [(7, i) for i in range(2000, 2400)]
    ring = [(3000 + i, 3000 + (i + 1) % 50) for i in range(50)]
    edges = spark.createDataFrame(chain + star + ring + [(5, 5), (7, 2000)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert classes(got) == {frozenset(range(1000, 1301)), frozenset([7, *range(2000, 2400)]), frozenset(range(3000, 3050))}
    assert components(edges.limit(0)).collect() == []


def test_few_edges_are_joined_at_once(spark, monkeypatch):
    """Contraction down to any number of edges gives the same groups; few edges cost the driver few jobs."""
    import refinery.llm.components as C

    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(299)] + [(1000, 1001 + i) for i in range(50)] + [(-5, 2**62)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(70)]
    edges = spark.createDataFrame(pairs, "a long, b long")

    def groups():
        out = {}
        for r in components(edges).collect():
            out.setdefault(r.label, set()).add(r.node)
        assert all(k in v for k, v in out.items())
        return sorted(map(sorted, out.values()))

    spark.sparkContext.setJobGroup("few-edges", "")
    want = groups()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) < 15
    spark.sparkContext.setJobGroup("", "")
    for few in (0, 40):
        monkeypatch.setattr(C, "FEW", few, raising=False)
        assert groups() == want
