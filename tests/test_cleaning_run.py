import json
import zipfile

import pytest
from pyspark.sql import functions as F

from refinery import cli
from refinery.plans import pipeline as P
from refinery.plans.cards import Stage, Status
from refinery.plans.interactive import Session, Store, describe
from refinery.plans.plan import Plan, replay, verify, verify_by_key
from refinery.sources import readers
from refinery.streaming.monitor import clean_stream, quality


@pytest.fixture(scope="module")
def dirty_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "people.csv"
    lines = ["Person Name,Age (y),Group,Income,Joined"]
    for i in range(120):
        lines.append(f"p{i}, {20 + i % 50} ,{'a' if i % 9 == 0 else 'A' if i % 2 else 'B'},{'' if i % 15 == 0 else 1000 + (i * 37) % 400 if i != 60 else 99999},2024-01-{1 + i % 28:02d}")
    lines += [lines[5], lines[6], "px,?,A,1100,oops"]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_run_replay_and_artifacts(spark, dirty_csv, tmp_path):
    events = []
    state = P.run_pipeline(spark, dirty_csv, "Group", on_event=lambda n, c: events.append(n), out=str(tmp_path / "out"))
    assert events == ["pipeline_start", *["stage_done"] * 9, "pipeline_done"]
    assert state.target == "group" and state.df.filter(F.col("age_y").isNull()).count() == 0
    kinds = dict(state.df.dtypes)
    assert kinds["age_y"] == "bigint" and kinds["joined"] == "timestamp_ntz" and set(r.group for r in state.df.select("group").distinct().collect()) == {"A", "B"}
    counts = state.log.counts()
    assert counts["total"] == counts["automated"] + counts["judged"] and not state.log.pending()
    out = tmp_path / "out"
    assert json.loads((out / "decisions.json").read_text())["n_entries"] == counts["total"]
    assert (out / "report.md").read_text().startswith("# Cleaning report") and "<svg" in (out / "flow.svg").read_text()
    plan = Plan.from_json((out / "plan.json").read_text())
    again = replay(spark, plan, dirty_csv)
    assert verify(state.df, again)["equal"]
    assert spark.read.parquet(str(out / "clean.parquet")).count() == state.df.count()
    compile((out / "clean_script.py").read_text(), "clean_script.py", "exec")


def test_decisions_override(spark, dirty_csv):
    def decide(card):
        if card.stage == Stage.DUPLICATE and "keep_all_duplicates" in card.alternatives:
            card.resolve("keep_all_duplicates", note="panel")

    state = P.run_pipeline(spark, dirty_csv, decide=decide)
    assert state.log.by_id("duplicates_exact") is None or state.log.by_id("duplicates_exact").status == Status.OVERRIDDEN


def test_session(spark, dirty_csv, tmp_path):
    s = Session(spark, dirty_csv)
    s.run_profiling()
    s.run_companions()
    s.run_format()
    cards = s.detect(Stage.MISSINGNESS)
    income = next(c for c in cards if c.variable == "income")
    s.resolve(Stage.MISSINGNESS, {income.card_id: "mean_impute"})
    assert s.state.df.filter("income is null").count() == 0
    s.transform("joined", "datetime_decompose")
    s.transform("income", "standard_scale")
    assert "joined_year" in s.state.df.columns and "income_scaled" in s.state.df.columns and s.status()["pending"] == 0
    assert s.variable("income")["histogram"] and s.variable("group")["top_values"]
    s.documents = {"notes.md": "income per year\nin euros"}
    assert describe(s.documents, "income") == "income per year in euros" and describe({}, "x") is None
    done = s.finalize(str(tmp_path / "s"))
    assert done["errors"] == {} and done["verified"]["equal"]
    store = Store()
    key = store.add(s)
    assert store.get(key) is s
    s.reset()
    assert len(s.state.log) == 0


def test_plan_on_other_rows(spark):
    train = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(50)], "_rid long, x double, g string")
    from refinery.operators import features, steps

    plan = Plan()
    for one in (features.scale_step(train, "x", "standard", "x_scaled"), features.frequency_step(train, "g"), {"op": "keep_first", "keys": ["g"]}):
        plan.add(one)
    other = spark.createDataFrame([(0, 24.5, "a"), (1, 1e6, "z")], "_rid long, x double, g string")
    got = Plan.from_json(plan.to_json()).apply(other, rows=False).orderBy("_rid").collect()
    assert (got[0].x_scaled, got[0].g_freq, got[1].g_freq) == (0.0, 0.5, 0.0)
    assert steps.run(other, {"op": "strip", "column": "not there"}).columns == other.columns


def test_verify(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (1, 1.0, "x"), (2, None, None)], "k long, v double, s string")
    assert verify(a, a)["equal"] and not verify(a, a.distinct())["equal"]
    b = spark.createDataFrame([(1, 1.01, "x"), (2, None, None)], "k long, v double, s string")
    assert verify_by_key(a.distinct(), b, "k") and not verify_by_key(a.distinct(), b, "k", rtol=1e-4)
    assert not verify_by_key(b, b.limit(1), "k")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y"""\nNA,\n NA,None\n')
    got = [tuple(r) for r in readers.load(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("1", 'x, "y"'), (None, None), (" NA", None)]
    (tmp_path / "l.tsv").write_bytes("a\tb\ncafé\t1\n".encode("latin-1"))
    assert readers.load(spark, str(tmp_path / "l.tsv")).first().a == "café"
    (tmp_path / "d.csv").write_text("x,X,x\n1,2,3\n")
    assert len(set(map(str.lower, readers.load(spark, str(tmp_path / "d.csv")).columns))) >= 2
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.load(spark, str(tmp_path / "r.json")).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.load(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.bin").write_bytes(b"")
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "x.bin"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok/a.csv", "a\n1\n")
        z.writestr("../evil.csv", "a\n1\n")
    assert [p.endswith("ok/a.csv") for p in readers.expand_zip(str(tmp_path / "z.zip"), str(tmp_path / "zip"))] == [True]
    assert readers.classify_files(["a.csv", "b.md", "c.png"]) == {"tabular": ["a.csv"], "documentation": ["b.md"], "companion": ["c.png"]}
    (tmp_path / "n.md").write_text("hello")
    assert readers.document_text(spark, str(tmp_path / "n.md")) == "hello" and readers.document_text(spark, str(tmp_path / "gone.md")).startswith("[gone.md")


def test_cli(spark, dirty_csv, tmp_path, capsys):
    assert cli.main(["profile", dirty_csv]) == 0 and "Age (y)" in capsys.readouterr().out
    assert cli.main(["profile", str(tmp_path / "no.csv")]) == 1


def test_stream(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    plan = Plan([{"op": "clip", "column": "value", "low": 0.0, "high": 50.0}, {"op": "keep_first", "keys": ["event_type"]}])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    cleaned = clean_stream(stream, plan, ["event_id"], "ts")
    counted = quality(cleaned, "ts", ["event_type"], late=None)
    q = counted.writeStream.outputMode("append").format("memory").queryName("quality").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.start: r.rows for r in quality(df, "ts", ["event_type"]).collect()}
    got = {r.start: r.rows for r in spark.table("quality").collect()}
    assert got and all(want[k] == v for k, v in got.items())
