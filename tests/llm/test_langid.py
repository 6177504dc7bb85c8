import itertools

import numpy as np
import pyarrow as pa

from refinery.llm import langid as L
from refinery.llm.common import held_out


def plain_viterbi(scores, penalty):
    n, k = scores.shape
    best, back = scores[0].copy(), []
    for t in range(1, n):
        stay, top = best, best.max() - penalty
        back.append([l if stay[l] >= top else int(best.argmax()) for l in range(k)])
        best = np.maximum(stay, top) + scores[t]
    total = best.max()
    return total


def worth(scores, path, penalty):
    return sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))


def test_viterbi_is_optimal(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 7)
    rng = np.random.default_rng(1)
    for k in (2, 3, 5):
        sizes = [1, 2, 7, 8, 30, 71, 1, 14]
        scores = rng.normal(0, 3, (sum(sizes), k)).astype(np.float32)
        row = np.repeat([0, 1, 2, 5, 6, 7, 8, 9], sizes)
        for cells in (1 << 22, 50):
            monkeypatch.setattr(L, "CELLS", cells)
            path = L.viterbi(scores, row, 2.0)
            for r in set(row.tolist()):
                own = row == r
                assert abs(worth(scores[own].astype(float), path[own].tolist(), 2.0) - plain_viterbi(scores[own].astype(float), 2.0)) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.filter(~held_out()))
    got = L.identify(docs.filter(held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_mixed_spans_and_scripts(spark):
    de, en = "der und nicht die das ist ein wort mit sich für den " * 6, "the of and this is with that from are was for by " * 6
    ru, el = "и это не что он на с как по но они " * 6, "και το να με για από που δεν είναι " * 6
    train = [(1, de, "de"), (2, en, "en"), (3, ru, "ru"), (4, el, "el"), (5, None, "en"), (6, "was", None)]
    model = L.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "el", "en", "ru"]
    text = de.strip() + ". " + en.strip() + ". " + ru.strip()
    spans = model.spans(text)
    assert [s[0] for s in spans] == ["de", "en", "ru"]
    raw = text.lower().encode()
    assert raw[spans[1][1] : spans[1][2]].decode() == en.strip()
    assert model.predict(pa.array(["совсем новое", "νέα λέξη", "the", None, "", " 123 -- ", "漢字", "x" * 100000 + " the of and"]))[0][:6] == ["ru", "el", "en", "und", "und", "und"]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score int"
    empty = spark.createDataFrame([], schema)
    none = L.train(empty)
    rows = spark.createDataFrame([(1, "the", None, "x", 1), (None, None, None, None, None), (1, "the", None, "x", 1), (2, "", "en", "x", 0)], schema)
    assert {(r.lang_pred, r.score) for r in L.identify(rows, none).collect()} == {("und", 0.0)}
    one = L.train(spark.createDataFrame([(1, "the of and", "en", "", 0)], schema))
    got = sorted((r.doc_id or -1, r.lang_pred, r.score) for r in L.identify(rows, one).collect())
    assert got == [(-1, "und", 0.0), (1, "en", 1.0), (1, "en", 1.0), (2, "und", 0.0)]
    kept = L.keep_identified(rows, one)
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert L.identify(empty, one).collect() == []
