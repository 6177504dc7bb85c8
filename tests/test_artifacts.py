import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import refinery
from refinery.functions import quantiles as QT
from refinery.operators import companions, duplicates, features, format, intake, steps
from refinery.operators.profile import profile
from refinery.plans import pipeline as P
from refinery.plans import wording
from refinery.plans.cards import Card, Stage
from refinery.plans.hooks import Hooks
from refinery.plans.interactive import Session
from refinery.plans.pdf import lines_of, pdf
from refinery.plans.plan import replay, verify
from refinery.sources import readers, writers
from refinery.sources.sample import sample


def test_exports():
    assert all(getattr(refinery, n) is not None for n in refinery.__all__)
    assert refinery.detect_missing.__module__ == "refinery.operators.missing"
    with pytest.raises(AttributeError):
        refinery.nothing


def test_words_of_actions():
    assert wording.label("drop_rows") != wording.label("drop_rows", Stage.OUTLIER) and wording.label("some_new_action") == "Some new action"
    card = Card("x", Stage.OUTLIER, "v", "", "", default_action="inspect", alternatives=["winsorize", "inspect"])
    found = card.options()
    assert [o["action"] for o in found] == ["inspect", "winsorize"] and [o["recommended"] for o in found] == [True, False]
    assert all(o["description"] and o["description"] != o["label"] for o in found)


def test_all_artifacts_of_the_sample(spark, tmp_path):
    out = str(tmp_path / "run")
    state = P.run_pipeline(spark, sample(spark), "Outcome", out=out)
    names = {n.split(".")[0] + "." + n.split(".")[-1] for n in os.listdir(out)}
    assert {"raw_intake.parquet", "raw_intake.csv", "clean.parquet", "report.md", "report.pdf", "flow.svg", "context.json", "decisions.json", "plan.json"} <= names
    report = open(f"{out}/report.md").read()
    for part in ("## What changed", "### Format", "### Missingness", "## Columns one by one", "## Methods", "were read"):
        assert part in report
    assert spark.read.parquet(f"{out}/raw_intake.parquet").count() == 402 and state.rows[0].rows_in == 402
    carried = json.loads(open(f"{out}/context.json").read())
    assert carried["rows"] == state.df.count() and len(carried["decisions"]) == len(state.log)
    raw = open(f"{out}/report.pdf", "rb").read()
    assert raw.startswith(b"%PDF-") and raw.rstrip().endswith(b"%%EOF") and raw.count(b"/Type /Page ") == -(-len(lines_of(report)) // 61)
    places = [int(x[:10]) for x in raw[raw.index(b"xref") :].split(b"\n")[3:] if x.endswith(b" n ")]
    assert all(raw[p:].startswith(b"%d 0 obj" % i) for i, p in enumerate(places, 1))
    assert os.path.getsize(writers.zip_folder(out)) > 1000
    assert pdf("").startswith(b"%PDF-")


def test_replay_is_the_same_without_the_session(spark):
    source = sample(spark)
    state = P.run_pipeline(spark, source, "Outcome")
    assert verify(state.df, replay(spark, state.plan, source))["equal"]


def test_profiles_of_unchanged_columns_are_kept(spark, monkeypatch):
    state = P.open_state(spark, sample(spark))
    asked = []
    real = P.profile
    monkeypatch.setattr(P, "profile", lambda df, t, known=None: asked.append([c for c in df.columns if c not in (known or {}) and c != "_rid"]) or real(df, t, known))
    state.refresh()
    state.run({"op": "strip", "column": "Region"})
    state.run({"op": "fill", "column": "Income", "value": "0"})
    state.refresh()
    state.refresh()
    state.run({"op": "indicator", "column": "Joined", "new": "j"})
    state.refresh()
    state.run({"op": "drop_null_rows", "column": "Income"})
    state.refresh()
    assert asked[1:4] == [["Region", "Income"], [], ["Joined", "j"]] and len(asked[0]) == 7 and len(asked[4]) == 8
    fresh = profile(state.df)
    assert {c: p.to_dict() for c, p in fresh.items()} == {c: p.to_dict() for c, p in state.profiles.items()}


@pytest.mark.parametrize("few", [32, 0])
def test_quantiles_of_several_large_columns(spark, monkeypatch, few):
    monkeypatch.setattr(QT, "CELLS", 5)
    monkeypatch.setattr(QT, "LAST", 4)
    monkeypatch.setattr(QT, "FEW_RANKS", few)
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(0, 1, 300), "b": np.round(rng.exponential(3, 300)), "c": np.concatenate([[np.inf] * 5, [-np.inf] * 3, rng.normal(0, 1e300, 292)])}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())] + [(None, float("nan"), None)], "a double, b double, c double")
    probs = [0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.97]
    got = QT.quantiles_of(df, {c: probs for c in data}, one_buffer=0)
    for c, v in data.items():
        v = np.sort(v)
        for p, x in zip(probs, got[c]):
            low, high = v[int(np.floor(p * 299))], v[int(np.ceil(p * 299))]
            want = low if low == high else low + (high - low) * (p * 299 - np.floor(p * 299))
            assert x == pytest.approx(want, rel=1e-12)


def test_encoding_is_told_by_every_line(spark, tmp_path):
    far = tmp_path / "far.csv"
    far.write_bytes(b"a,b\n" + b"x,plain\n" * 20000 + "y,café\n".encode("latin-1"))
    assert readers.load(spark, str(far)).filter("a = 'y'").first().b == "café"
    win = tmp_path / "win.csv"
    win.write_bytes("a,b\n1,“quoted” €\n".encode("cp1252"))
    assert readers.load(spark, str(win)).first().b == "“quoted” €"
    wide = tmp_path / "wide.csv"
    wide.write_bytes("a,b\n1,grün\n".encode("utf-16"))
    assert readers.load(spark, str(wide)).first().b == "grün"
    good = tmp_path / "good.csv"
    good.write_text('a,b\n1,"two\nlines"\n2,größe\n', encoding="utf-8")
    assert [r.b for r in readers.load(spark, str(good)).orderBy("a").collect()] == ["two\nlines", "größe"]
    assert readers.sniff(spark, str(good)) == ("UTF-8", True) and readers.sniff(spark, str(far))[1] is False


def test_json_forms(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    forms = {"records": json.dumps(rows), "lines": "\n".join(map(json.dumps, rows)), "columns": json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}), "lists": json.dumps({"a": [1, 2], "b": ["x", None]})}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = sorted((int(r.a), r.b) for r in readers.load(spark, str(tmp_path / f"{name}.json")).collect())
        assert got == [(1, "x"), (2, None)], name


def test_table_of_an_archive(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/other.csv", "k\n1\n")
        z.writestr("b/data.csv", "k\n2\n3\n")
        z.writestr("b/train_labels.txt", "x")
        z.writestr("../out.csv", "k\n9\n")
    assert readers.load(spark, str(tmp_path / "z.zip")).count() == 2
    assert readers.load(spark, str(tmp_path / "z.zip"), "other.csv").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.table_in(["a.txt"])


def test_large_maps_and_shares_lie_beside_the_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(format, "MOST_SPELLINGS", 1)
    df = steps.with_row_ids(spark.createDataFrame([("A",), ("A",), ("a",), ("B",), ("b",), ("B",), ("c",)], "x string"))
    out, cards, done = format.resolve_formats(df, folder=str(tmp_path))
    assert sorted(r.x for r in out.collect()) == ["A", "A", "A", "B", "B", "B", "c"]
    assert "path" in done[-1] and cards[-1].metadata["n_values_changed"] == 2
    many = features.frequency_step(df, "x", most=2)
    assert "path" in many and steps.run(df, many).filter("x = 'A'").first().x_freq == pytest.approx(2 / 7)


def test_differing_columns_of_every_key(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (3, "d", "z"), (None, "e", "q"), (None, "f", "q")], "k int, u string, v string")
    got = {r.key: (r.n, r.differ) for r in duplicates.differing_columns(df, "k", ["u", "v"]).collect()}
    assert got == {1: (2, ["v"]), 3: (2, ["u"])}


def test_dataset_export_and_plumbing(spark, tmp_path):
    df = spark.createDataFrame([("p1", "1.5", "cat", True, "x"), ("p2", "2", None, True, "y"), ("p3", None, "ant", False, "z")], "image_path string, size string, kind string, has_image boolean, name string")
    out = writers.export_dataset(df, str(tmp_path / "d"), "kind", "image_path")
    assert set(out.columns) == {"image", "size", "name", "label"} and dict(out.dtypes)["size"] == "double"
    assert {r.image: r.label for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {"p1": 1, "p2": -1, "p3": 0}
    card = Card("companion_matching", Stage.COMPANION, None, "", "", default_action="exclude_path", alternatives=["include_path"])
    assert companions.plumbing(card.resolve("include_path"), df.columns) == ["has_image"]
    assert companions.plumbing(card.resolve("exclude_path"), df.columns) == ["image_path", "has_image"]


def test_staged_intake(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, 2.0)], "id int, y double")
    one = intake.staged({"a": a})
    assert not one.needs_confirmation and one.confirmed.table.count() == 1
    two = intake.staged({"a": a, "b": b})
    assert two.needs_confirmation and two.confirmed is None
    assert two.confirm({"b": "target"}).table.columns == ["id", "v", "y"] and not two.needs_confirmation
    with pytest.raises(KeyError):
        two.confirm({"c": "target"})


def test_hooks_that_fail_or_are_slow(spark):
    def describe(column, facts):
        if column.startswith("Age"):
            raise RuntimeError
        if column == "Income":
            time.sleep(3)
        return f"about {column}"

    assert Hooks().ask("chat", "x", {}) is None
    got = Hooks(describe=describe).ask_all("describe", [("Age", {}), ("Income", {}), ("Region", {})], seconds=0.5)
    assert got == [None, None, "about Region"]
    s = Session(spark, sample(spark), hooks=Hooks(describe=lambda c, f: f"about {c}", chat=lambda q, c: f"{q} {c['rows']}"))
    s.documents = {"notes": "the region of a person"}
    s.run_profiling()
    found = s.descriptions()
    assert found["Region"] == "the region of a person" and found["Member"] == "about Member" and s.chat("how many?") == "how many? 402"
