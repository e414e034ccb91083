import json

from pyspark.sql import functions as F

from loomtext.sources import readers, sinks
from loomtext.streaming import sketches as S


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,title,text,label,extra\n8,"A ""q"" title","two\nlines",FAKE,1\n9,,,real,2\n')
    got = sorted(map(tuple, readers.primary_csv(spark, str(tmp_path / "p.csv")).collect()))
    assert got == [("8", 'A "q" title', "two\nlines", 1), ("9", "", "", 0)]
    (tmp_path / "s.csv").write_text("URLs,Headline,Body,Label\nu,h,b,0\nu,h2,b2,1\n")
    assert [tuple(r) for r in readers.secondary_csv(spark, str(tmp_path / "s.csv")).orderBy("id").collect()] == [("0", "h", "b", 1), ("1", "h2", "b2", 0)]


def test_lines(spark, tmp_path):
    path = tmp_path / "search"
    path.mkdir()
    (path / "a.jsonl").write_text('{"mention": "Foo", "record": {"qid": "Q1"}}\nbroken\n{"mention": "foo", "record": {"qid": "Q2"}}\n{"mention": "old", "record": {}}\n')
    assert readers.search_lines(spark, str(path)).count() == 3
    assert sinks.purge_lines(spark, str(path)) == 1
    assert [r["record"]["qid"] for r in readers.search_lines(spark, str(path)).collect()] == ["Q2"]
    sinks.append_lines(readers.search_lines(spark, str(path)), str(tmp_path / "more"))
    assert readers.search_lines(spark, str(tmp_path / "more")).count() == 1
    (tmp_path / "claims.jsonl").write_text('{"qid": "Q1", "claims": {"P31": ["a"]}}\n{"qid": "Q1", "claims": {"P31": ["b"]}}\n')
    assert readers.claim_lines(spark, str(tmp_path / "claims.jsonl")).first()["claims"] == {"P31": ["b"]}


def test_vectors_reports_histories(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb 1\na 3 4\nc x y\n")
    assert [(r["word"], r["vec"]) for r in readers.word_vectors(spark, str(tmp_path / "v.txt"), 2).collect()] == [("a", [3.0, 4.0])]
    (tmp_path / "m1_report.json").write_text(json.dumps({"f1": 0.5, "confusion_matrix": [1, 2, 3, 4]}))
    (tmp_path / "m2_report.json").write_text("{broken")
    assert [(r["model"], r["f1"]) for r in readers.reports(spark, str(tmp_path / "*_report.json")).collect()] == [("m1", 0.5)]
    (tmp_path / "m1_history.json").write_text('[{"epoch": 1, "train_loss": 0.5, "val_loss": 0.6}]')
    (tmp_path / "m2_history.json").write_text('{"history": [{"epoch": 1, "train_loss": 0.7, "val_loss": 0.8}]}')
    assert sorted((r["model"], r["train_loss"]) for r in readers.histories(spark, str(tmp_path / "*_history.json")).collect()) == [("m1", 0.5), ("m2", 0.7)]
    (tmp_path / "x.json").write_text('{"Q1": "A.B", "Q2": "A.C"}')
    got = readers.crossview_json(spark, str(tmp_path / "x.json"))
    assert sorted(map(tuple, got.collect())) == [("Q1", "A.B"), ("Q2", "A.C")]
    assert json.loads(sinks.crossview_object(got).first()[0]) == {"Q1": "A.B", "Q2": "A.C"}
    (tmp_path / "o.json").write_text('{"attributes": [], "children": {"D": {"attributes": ["P1"], "children": {"c": {"attributes": ["P2"], "children": {}}}}}}')
    assert [(r["path"], r["level"], r["attributes"]) for r in readers.ontology_file(spark, str(tmp_path / "o.json")).orderBy("level").collect()] == [("D", 1, ["P1"]), ("D.c", 2, ["P2"])]


def test_keyed_tables(spark, tmp_path):
    store = sinks.KeyedTables(spark, f"file://{tmp_path}/cache")
    rows, settings = spark.range(3), {"a": 1, "b": {"c": 2}}
    assert store.load("t", settings) is None
    store.save("t", rows, settings)
    assert store.load("t", settings).count() == 3 and store.load("t", {"a": 2}) is None
    assert store.difference("t", {"a": 1, "b": {"c": 3}, "d": 0}) == ["b.c", "d"]
    assert store.clear("t") and not store.clear("t")
    assert sinks.fingerprint({"a": 1, "b": 2}) == sinks.fingerprint({"b": 2, "a": 1}) and len(sinks.fingerprint({})) == 12


def test_labelled_lines_and_markdown(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n b", 1), (2, None, 0), (3, "x", None)], "id bigint, text string, label int")
    sinks.labelled_lines(docs, str(tmp_path / "ft"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ft")).collect()) == ["__label__fake a b", "__label__real "]
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")) == "| x | y | z |\n|---|---|---|\n| a\\|b | 0.5000 |  |\n"


def test_stream_restart_counts_once(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "a b a")], "id bigint, text string").coalesce(1).write.parquet(f"{src}/p1")
    places = (str(tmp_path / "store"), str(tmp_path / "check"))
    run = lambda: {r["token"]: r["n"] for r in S.token_counts(spark, S.stream_table(spark, str(src)), *places).collect()}
    assert run() == {"a": 2, "b": 1} and run() == {"a": 2, "b": 1}
    spark.createDataFrame([(2, "b c")], "id bigint, text string").coalesce(1).write.parquet(f"{src}/p2")
    assert run() == {"a": 2, "b": 2, "c": 1}


def test_command_line(spark, data, tmp_path, capsys):
    from loomtext import cli
    from loomtext.report import corpus_report

    assert cli.main(["list"]) == 0 and "corpus_stats" in capsys.readouterr().out
    assert cli.main(["run", "label_stats", "--data", data, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    assert "## Duplicates" in corpus_report(spark, data)
    last = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    out = str(tmp_path / "m")
    cli.main(["ontology", "--data", data, "--out", out])
    assert last()["classes"] == readers.ontology_file(spark, f"{out}/ontology").count()
    cli.main(["warm", "--data", data, "--out", f"{out}/wanted", "--max-articles", "40", "--max-mentions", "5"])
    assert last()["wanted"] == 5
    cli.main(["stats", "--data", data, "--max-articles", "30"])
    assert last()["n_docs"] == 30
    cli.main(["cache", "fill", "--root", f"file://{out}/cache", "--data", data])
    assert len(last()["tables"]) == 5
    cli.main(["cache", "clear", "--root", f"file://{out}/cache"])
    assert last()["cleared"] == 5


def test_training_output(spark, data, tmp_path, capsys, monkeypatch):
    from loomtext import cli
    from loomtext.operators import classify

    real = classify.pipeline
    monkeypatch.setattr(classify, "pipeline", lambda *a: real(1 << 10, 3))
    last = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    cli.main(["models", "--out", str(tmp_path / "t")])
    assert not any(last().values())
    cli.main(["train", "--data", data, "--out", str(tmp_path / "t")])
    assert last()["n"] > 0
    cli.main(["models", "--out", str(tmp_path / "t")])
    assert all(last().values())
    cli.main(["score", "some words", "--model", str(tmp_path / "t" / "model")])
    assert 0 <= last()["probability"] <= 1
    assert F is not None


def test_link_caption(spark, data):
    from loomtext.plans import registry
    from loomtext.report import link_caption

    row = registry.QUERIES["offline_link_counters"](spark, data).first()
    assert link_caption(row) == f"{row['hits'] + row['misses']} mentions: {row['hits']} in the cache, {row['misses']} not, {row['resolved']} resolved"


def test_settings(tmp_path):
    import pytest

    from loomtext import config

    (tmp_path / "c.json").write_text(json.dumps({"text": {"shingle": 7}, "graph": {"relations": ["P1"]}}))
    got = config.load(str(tmp_path / "c.json"), "fast", split={"seed": "3"})
    assert (got.text.shingle, got.graph.relations, got.graph.epochs, got.split.seed) == (7, ("P1",), 10, 3)
    with pytest.raises(KeyError):
        config.load(text={"nothing": 1})
    config.make_dirs(str(tmp_path / "a" / "b"), str(tmp_path / "f.txt"))
    assert (tmp_path / "a" / "b").is_dir() and not (tmp_path / "f.txt").exists()
    assert config.as_dict(got)["text"]["shingle"] == 7


def test_file_signatures(spark, tmp_path):
    (tmp_path / "x.bin").write_text("abc")
    found, none = readers.file_signatures(spark, str(tmp_path / "x.bin"), str(tmp_path / "none.bin")).orderBy("size", ascending=False).collect()
    assert found["exists"] and found["size"] == 3 and found["modified"] is not None and not none["exists"] and none["size"] is None


def test_ontology_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("A", 1, None, "P1,P2"), ("A.x", 2, "A", ""), ("B", 1, None, "")], "path string, level int, parent string, attributes string")
    sinks.ontology_file(nodes, str(tmp_path / "o"))
    got = {r["path"]: (r["level"], r["attributes"]) for r in readers.ontology_file(spark, str(tmp_path / "o")).collect()}
    assert got == {"A": (1, ["P1", "P2"]), "A.x": (2, []), "B": (1, [])}


def test_late_events_are_dropped(spark, tmp_path):
    """Rows further behind the newest seen than the watermark allows no longer count."""
    src = tmp_path / "events"
    day = lambda n, value: spark.sql(f"select timestamp '2024-01-{n:02} 12:00:00' as ts, 'view' as event_type, {value}.0D as value").coalesce(1).write.parquet(f"{src}/{n:02}-{value}")

    def run():
        windows = S.event_windows(S.stream_table(spark, str(src)), late="1 day")
        query = windows.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for n, value in ((1, 1), (10, 2), (2, 4)):
        day(n, value)
        run()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy(F.to_date("start").cast("string").alias("d")).agg(F.max("total").alias("t")).collect()
    assert {r["d"]: r["t"] for r in got} == {"2024-01-01": 1.0, "2024-01-10": 2.0}


def test_scratch_tables_end_with_their_block(spark):
    from pathlib import Path

    from loomtext import scratch

    with scratch.tables():
        scratch.keep(spark.range(3), "short")
        path = Path(scratch.path_of().removeprefix("file://"))
        assert path.exists()
    assert not path.exists()
