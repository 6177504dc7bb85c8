import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from refinery.llm import mix as M
from refinery.llm import shard as H


def test_difference_known_and_near_optimal():
    bins, sums = H.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sums) == [14, 16]  # the classic example
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(8)]
        bins, sums = H.difference(sizes, 3)
        again = Counter()
        for b, s in zip(bins, sizes):
            again[b] += s
        assert [again[b] for b in range(3)] == sums
        best = min(max(sum(s for s, b in zip(sizes, p) if b == k) for k in range(3)) for p in itertools.product(range(3), repeat=8))
        assert max(sums) <= best * 4 / 3
    assert H.difference([], 3) == ([], [0, 0, 0])


def check_shards(rows, docs, shards):
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    text = {d[0]: d[1] for d in docs}
    home, slots, sums = {}, defaultdict(list), Counter()
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(slots) <= set(range(shards))
    return sums


def test_shards_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = check_shards(H.shard_by_bytes(docs, 24).collect(), [tuple(r) for r in docs.collect()], 24)
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) < 0.002 * max(sums.values())


def test_hot_group_and_edges(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUPS_A_BUCKET", 50)
    rng = random.Random(4)
    rows = [(i, "same " * 20, 1) for i in range(300)] + [(1000 + i, "x" * rng.randint(0, 400), 2) for i in range(500)] + [(5000, None, 3), (5001, None, None), (5002, "", 3), (5003, "y" * 200000, 3)]
    got = H.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, size int"), 8).collect()
    sums = check_shards(got, rows, 8)
    rest = sorted(sums.values())[:-1]
    assert max(rest[:-1]) - min(rest) <= 0.02 * max(rest)
    monkeypatch.setattr(H, "MOST_PARTIALS", 2)  # buckets' results are combined in tasks, in several levels
    monkeypatch.setattr(H, "ROWS_A_SLICE", 1)
    sums = check_shards(H.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, size int"), 8).collect(), rows, 8)
    rest = sorted(sums.values())[:-1]
    assert max(rest[:-1]) - min(rest) <= 0.05 * max(rest)
    assert H.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 8).collect() == []


def test_targets():
    assert M.targets([("a", 10), ("b", 10)], [1, 3]) == [5, 15]
    assert M.targets([("a", 90), ("b", 10)], [1, 2]) == [70, 30]
    assert M.targets([("a", 0), ("b", 0)], [1, 2]) == [0, 0]
    rng = random.Random(5)
    for _ in range(50):
        s = [("x", rng.randint(0, 100)) for _ in range(9)]
        w = M.weights_123(range(9))
        t = M.targets(s, w)
        total = sum(z for _, z in s)
        assert abs(sum(t) - total) < 1e-3 and all(x <= 3 * z + 1e-6 for x, (_, z) in zip(t, s))
        share, left = [0.0] * 9, total  # reshare step by step
        free = [i for i in range(9)]
        while left > 1e-9 and free:
            unit = left / sum(w[i] for i in free)
            for i in free:
                share[i] += unit * w[i]
            left = sum(max(0, share[i] - 3 * s[i][1]) for i in free)
            share = [min(x, 3 * z) for x, (_, z) in zip(share, s)]
            free = [i for i in free if share[i] < 3 * s[i][1]]
        assert all(abs(a - b) < 1e-3 for a, b in zip(share, t))


def plain_mix(docs):
    """docs: (doc_id, source, text); the same queueing in one list."""
    import hashlib

    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in docs}
    by = defaultdict(list)
    for d, s, _ in docs:
        by[s].append((int(hashlib.md5(f"mix-{d}".encode()).hexdigest()[:15], 16), d))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    t = M.targets([(s, sum(size[d] for _, d in by[s])) for s in names], M.weights_123(names))
    copies = []
    for rank, s in enumerate(names):
        total, upto = sum(size[d] for _, d in by[s]), 0
        for _, d in sorted(by[s]):
            upto += size[d]
            if size[d]:
                copies += [((e * total + upto) / t[rank], rank, upto, d) for e in range(3)]
    left, taken = sum(size.values()), Counter()
    for *_, d in sorted(copies):
        if size[d] > left:
            break
        left -= size[d]
        taken[d] += size[d]
    return {d: (size[d], taken[d]) for d, _, _ in docs}


@pytest.mark.parametrize("cells, most", [(4096, 20000), (8, 3)])
def test_mix_of_documents(spark, monkeypatch, cells, most):
    monkeypatch.setattr(M, "CELLS", cells)
    monkeypatch.setattr(M, "MOST_LAST", most)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = M.mix(docs).collect()
    want = plain_mix([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert {r.doc_id: (r["size"], r.taken) for r in got} == want
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * max(r["size"] for r in got)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string, size int, target int"
    assert M.mix(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c", "s", 1, 1), (2, None, None, 1, 1), (3, "", "t", 1, 1), (None, "a b", "s", 1, 1), (1, "a b c", "s", 1, 1), (4, "w " * 50000, "u", 1, 1)]
    got = M.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    none = M.mix(spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
