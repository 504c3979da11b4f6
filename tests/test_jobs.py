import json

import pytest

from tagloom.config import VocabConfig
from tagloom.__main__ import run
from tagloom.operators.sample import sample_positions
from tagloom.plans.jobs import in_corpus_order, run_extract, run_label
from tagloom.operators.stats import corpus_stats, token_stats
from tagloom.operators.vocab import bundle, classify, document_lines
from tagloom.sources.jsonl import read_points, read_vocabulary, save_vocabulary, vocabulary_terms, write_document
from tagloom.streaming.labels import label_stream, read_point_stream


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_jobs_chain(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    for b in ("3_yard", "4_quay"):
        (raw / f"{b}.csv").write_text("".join(f"TRANE/CRAC-{i:02}:OAT.BV alarm\n" for i in range(7)))
    (raw / "bad.csv").write_text("KWM1\nKWM2,x\n")
    at = {x: str(tmp_path / x) for x in ("points", "vocab", "labelled", "sample")}
    report = run(spark, ["extract", "--input", str(raw), "--points", at["points"], "--sample", at["sample"]])
    assert report.rows == 14 and report.counts == {"files": 2, "buildings": 2, "rejected files": 1} and report.details.count() == 1
    points = lines(tmp_path / "points")
    assert points[0] == {"building_id": "yard", "source_file": "3_yard.csv", "point_label": "TRANE/CRAC-00:OAT.BV alarm", "point_label_col": "col_0"}
    place = sample_positions(7, 1)[0]
    assert "".join(f.read_text() for f in (tmp_path / "sample").glob("part-*")) == f"TRANE/CRAC-{place:02}:OAT.BV alarm\n" * 2
    assert run(spark, ["vocab", "--points", at["points"], "--vocabulary", at["vocab"]]).counts == {"tokens": 12, "buildings": 2}
    vocabulary = read_vocabulary(spark, at["vocab"])
    assert (vocabulary.equip, vocabulary.io_type, vocabulary.vendor_tag) == ({"CRAC"}, {"BV"}, {"TRANE"})
    assert run(spark, ["label", "--points", at["points"], "--vocabulary", at["vocab"], "--labelled", at["labelled"]]).rows == 14
    assert "rows: 14, tokens: 84, without tokens: 0" in capsys.readouterr().out
    joined = run_label(spark, at["points"], at["vocab"], str(tmp_path / "joined"), literal_terms=0)
    assert joined.counts == {"tokens": 84, "without tokens": 0} and lines(tmp_path / "joined") == lines(tmp_path / "labelled")
    document = json.loads("".join(f.read_text() for f in sorted((tmp_path / "vocab").glob("part-*"))))
    assert list(document)[0] == "frequency" and document["frequency"]["TRANE"] == 14 and document["stats"] == {"num_tokens": 12, "num_buildings": 2}
    record = lines(tmp_path / "labelled")[0]
    assert record["token_labels"] == ["VENDOR_TAG", "EQUIP", "EQUIP_ID", "SUBCOMP", "IO_TYPE", "POINT_FUNC"]
    assert record["structured"]["zone"] is None and list(record)[0] == "point_label"
    query = label_stream(read_point_stream(spark, at["points"]), vocabulary, str(tmp_path / "stream"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert sorted(map(json.dumps, lines(tmp_path / "stream"))) == sorted(map(json.dumps, lines(tmp_path / "labelled")))


def test_no_points(spark, tmp_path):
    (tmp_path / "words.csv").write_text("some\nplain\nwords\n")
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.json").write_text("kept")
    with pytest.raises(RuntimeError):
        run_extract(spark, str(tmp_path), str(out))
    assert (out / "old.json").read_text() == "kept"


def test_corpus_order_is_the_written_order(spark, tmp_path):
    for k, n in enumerate((40, 4000, 7)):  # files of differing size, which Spark splits and packs as it likes
        text = "".join(json.dumps({"building_id": "b", "source_file": "f.csv", "point_label": f"{k}-{i}", "point_label_col": "c"}) + "\n" for i in range(n))
        (tmp_path / f"part-{k}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = [r.point_label for r in in_corpus_order(spark, str(tmp_path)).orderBy("point_ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{k}-{i}" for k, n in enumerate((40, 4000, 7)) for i in range(n)]


def test_lines_and_vocabulary_files(spark, tmp_path):
    good = tmp_path / "p.json"
    good.write_text('{"point_label": "MAU 1", "building_id": "B"}\n\n{"point_label": "x"}\n{"point_label": "y", "building_id": null}\n')
    rows = read_points(spark, str(good))
    assert sorted((r.point_label, r.building_id) for r in rows.collect()) == [("MAU 1", "B"), ("x", "unknown"), ("y", None)]
    bad = tmp_path / "bad.json"
    bad.write_text('{"point_label": \n')
    with pytest.raises(Exception):
        read_points(spark, str(bad)).collect()
    save_vocabulary(bundle(classify(token_stats(rows), VocabConfig()), corpus_stats(rows)), str(tmp_path / "v.json"))
    assert read_vocabulary(spark, str(tmp_path / "v.json")).equip == {"MAU"}
    (tmp_path / "w.json").write_text('{"equip_vocab": ["A", "A"]}')
    part = read_vocabulary(spark, str(tmp_path / "w.json"))
    assert part.equip == {"A"} and part.vendor_tag == frozenset()


def test_document_is_the_bundle(spark, tmp_path):
    labels = ['say "AI" \\ BV', "PUMP 3 {x} é", "]", "SAT", "PUMP"]
    rows = spark.createDataFrame([(i, t, "b") for i, t in enumerate(labels)], "point_ord long, point_label string, building_id string")
    for name, kept in (("full", rows), ("none", rows.limit(0))):
        classified, corpus = classify(token_stats(kept), VocabConfig()), corpus_stats(kept)
        write_document(document_lines(classified, corpus), str(tmp_path / name))
        text = "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
        found = json.loads(text)
        if name == "full":
            save_vocabulary(bundle(classified, corpus), str(tmp_path / "one.json"))
            one = json.loads((tmp_path / "one.json").read_text())
            assert found == one and list(found["frequency"])[:3] == list(one["frequency"])[:3] == ["SAY", '"', "AI"]
            assert sorted(vocabulary_terms(spark, str(tmp_path / "one.json")).collect()) == sorted(vocabulary_terms(spark, str(tmp_path / name)).collect())
        else:
            assert found["frequency"] == {} and found["equip_vocab"] == [] and vocabulary_terms(spark, str(tmp_path / name)).count() == 0
