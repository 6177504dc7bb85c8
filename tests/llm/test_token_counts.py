from collections import Counter

import pytest

from refinery.llm import token_counts as T
from refinery.llm.queries import BPE_PATTERN, TOKENIZERS, op10_token_rollup

SCHEMA = "doc_id long, source string, lang string, text string, tokens string"


@pytest.fixture(scope="module")
def counter():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return T.bpe(f.read(), BPE_PATTERN)


def total(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.bytes) for r in df.collect()}


def test_pieces_do_not_change_counts(counter, monkeypatch):
    count = counter()
    texts = ["the quick's brown fox 12 jumps\n\n over  it " * 40, "ab" * 300, "é ü a b c, d e" * 50, "   "]
    whole = [count(t) for t in texts]
    monkeypatch.setattr(T, "PIECE", 20)
    assert all("".join(T.pieces(t)) == t for t in texts) and len(list(T.pieces(texts[0]))) > 20
    assert [sum(count(p) for p in T.pieces(t)) for t in texts] == whole


def test_ledger(spark, counter, tmp_path):
    one = spark.createDataFrame([(1, "s", "en", "the of and", "x"), (2, "s", "en", None, "x"), (3, None, None, "", None), (1, "s", "en", "the of and", "x")], SCHEMA)
    two = spark.createDataFrame([(1, "t", "en", "the of", "x"), (4, "s", "de", "und " * 50000, "x")], SCHEMA)
    a, b = T.count_tokens(one, counter, "v1"), T.count_tokens(two, counter, "v1")
    ledger = T.Rollup(spark, str(tmp_path / "ledger"))
    assert total(ledger.totals()) == {}
    assert ledger.commit("a", T.inserted(a)) and not ledger.commit("a", T.inserted(a))
    n = counter()("the of and")
    assert total(ledger.totals()) == {("s", "en", "v1"): (3, 2 * n, 20), (None, None, "v1"): (1, 0, 0)}
    ledger.commit("b", T.revised(a.filter("doc_id = 1").limit(1), b.filter("doc_id = 1")))
    ledger.commit("c", T.inserted(b.filter("doc_id = 4")))
    ledger.commit("none", T.inserted(b.limit(0)))
    before = total(ledger.totals())
    assert before["t", "en", "v1"][0] == 1 and before["s", "en", "v1"] == (2, n, 10)
    assert before["s", "de", "v1"] == (1, counter()("und " * 50000), 200000)
    again = T.Rollup(spark, str(tmp_path / "ledger"))
    assert again.compact("packed") and not again.compact("packed") and again.batches() == ["packed"]
    assert total(again.totals()) == before
    assert not again.commit("b", T.inserted(b)) and total(again.totals()) == before
    again.commit("d", T.deleted(b.filter("doc_id = 4")))
    again.compact("packed2")
    assert ("s", "de", "v1") not in total(again.totals()) and not again.commit("c", T.inserted(b))
    with pytest.raises(ValueError):
        again.commit("../x", T.inserted(b))


def test_crash_between_write_and_rename(spark, counter, tmp_path):
    ledger = T.Rollup(spark, str(tmp_path / "ledger"))
    rows = T.inserted(T.count_tokens(spark.createDataFrame([(1, "s", "en", "a b", "x")], SCHEMA), counter, "v1"))
    rows.write.parquet(f"{ledger.folder}/attempts/a-dead")  # what an attempt that was lost leaves
    assert total(ledger.totals()) == {} and ledger.commit("a", rows)
    assert total(ledger.totals()) == {("s", "en", "v1"): (1, counter()("a b"), 3)}


def test_crash_between_rename_and_delete(spark, counter, tmp_path, monkeypatch):
    ledger = T.Rollup(spark, str(tmp_path / "ledger"))
    rows = T.inserted(T.count_tokens(spark.createDataFrame([(1, "s", "en", "a b", "x")], SCHEMA), counter, "v1"))
    ledger.commit("a", rows)
    ledger.commit("b", rows)
    before = total(ledger.totals())
    covered = ledger._covered
    monkeypatch.setattr(ledger, "_covered", lambda: set())  # the old batches are not deleted
    assert ledger.compact("packed")
    monkeypatch.setattr(ledger, "_covered", covered)
    assert ledger._listed() == ["a", "b", "packed"] and ledger.batches() == ["packed"]
    assert total(ledger.totals()) == before and not ledger.commit("a", rows)
    assert ledger.compact("again") and ledger._listed() == ["again"]  # what was left goes with the next one
    assert total(ledger.totals()) == before and not ledger.commit("b", rows) and not ledger.commit("packed", rows)


def test_query_against_plain_counts(spark, counter):
    got = total(op10_token_rollup(spark, "/root/testdata/sf0.001"))
    count, want = counter(), {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        for name, n in (("words-1", len(r.text.split())), ("byte_bpe_50k-1", count(r.text))):
            have = want.setdefault((r.source, r.lang, name), Counter())
            have.update(docs=1, tokens=n, bytes=len(r.text.encode()))
    assert got == {k: (v["docs"], v["tokens"], v["bytes"]) for k, v in want.items()}
