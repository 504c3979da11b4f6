import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.config import ExtractConfig
from tagloom.functions.text import is_point_like
from tagloom.operators.extract import choose_columns, column_scores, detect_headers, load_points, points_from_cells
from tagloom.operators import sample
from tagloom.operators.extract import column_words
from tagloom.operators.sample import ordered_samples, sample_one_per_building, sample_positions
from tagloom.sources import cells as cell_source
from tagloom.sources.cells import _decoded_name, read_records


def cells(spark, **files):
    rows = [(f, i, j, c) for f, table in files.items() for i, row in enumerate(table) for j, c in enumerate(row)]
    return spark.createDataFrame(rows, "source_file string, row_no int, col_no int, cell string")


HEADERS = {
    "top": ([["Meter", "unit"], ["KWM_1.ENRG", "kWh"], ["KWM_2.ENRG", "kWh"]], True),
    "bare": ([["CT1_GPM", "P-1"], ["CT2_GPM", "P-2"], ["CT3_GPM", "P-3"]], False),
    "late": ([["u", None, "w"], ["x", "u", "9:CT-1 (GPM)"], ["y", None, "8:CT-2 (GPM)"], ["z", "w", "plain"]], True),  # the last column decides
    "two": ([["Meter"], ["KWM_1"]], True),
    "both": ([["KWM_1"], ["KWM_2"]], False),
    "one": ([["Meter"]], False),
    "third": ([["what"], ["KWM_1"], ["words"]], True),  # three rows that fall through to the rule for two
    "mixed": ([["KWM_1", None], ["words", "KWM_1"], ["words", "u"]], False),
}


def test_headers(spark):
    got = {r.source_file: r.has_header for r in detect_headers(cells(spark, **{k: t for k, (t, _) in HEADERS.items()})).collect()}
    assert got == {k: h for k, (_, h) in HEADERS.items()}


def chosen(spark, config=ExtractConfig(), **files):
    return {r.source_file: r.col_name for r in choose_columns(cells(spark, **files), config).collect()}


@pytest.mark.parametrize("exact", [True, False])
def test_choice(spark, exact):
    point = [f"KWM{i}_GPM" for i in range(5)]
    assert chosen(
        spark,
        ExtractConfig(exact_sample=exact),
        pref=[["BAS_Raw", "More"], *[["words", p] for p in point]],
        order=[["bas_raw", "label"], *[["words", p] for p in point]],
        score=[["u", "v"], *[["words", p] for p in point]],
        ties=[[p, p] for p in point],
        low=[["x", p if i == 0 else "words"] for i, p in enumerate(point)],
        empty=[["words", None] for _ in point],
        null=[[None, p] for p in point],
        twice=[["label", "label", "z"], *[[p, p, p] for p in point]],
        same=[["q", "q", "z"], *[[p, p, p] for p in point]],
    ) == {"pref": "BAS_Raw", "order": "label", "score": "v", "ties": "col_0", "null": "col_1", "same": "z"}


def test_sampled_score(spark):
    values = [f"KWM{i}_GPM" if i % 3 else None if i % 2 else "words" for i in range(500)]
    table = cells(spark, f=[[v] for v in values])
    data = [v for v in values[int(detect_headers(table).first().has_header) :] if v]
    like = [r[0] for r in spark.createDataFrame([(v,) for v in data], "v string").select(is_point_like(F.col("v"))).collect()]
    picked = sample_positions(len(data), 200)
    assert column_scores(table).first().score == pytest.approx(sum(like[i] for i in picked) / 200)
    assert column_scores(table, ExtractConfig(exact_sample=False)).first().score == pytest.approx(sum(like) / len(like))


@pytest.mark.parametrize("size", [199, 201, 5000])
def test_sampled_score_over_words(spark, size, monkeypatch):
    monkeypatch.setattr("tagloom.operators.extract._WORDS", 4)
    values = [None if i % 5 == 2 else f"KWM{i}_GPM" if i % 7 < 3 else "words" for i in range(size)]
    table = cells(spark, head=[["name"], *[[v] for v in values]], bare=[["KWM_1"], ["KWM_2"], *[[v] for v in values]])
    scores = {r.source_file: r.score for r in column_scores(table.repartition(5)).collect()}
    for file, data in (("head", values), ("bare", ["KWM_1", "KWM_2", *values])):
        filled = [v for v in data if v]
        picked = [filled[i] for i in sample_positions(len(filled), 200)]
        assert scores[file] == pytest.approx(sum(v != "words" for v in picked) / len(picked))


@pytest.mark.parametrize("exact", [True, False])
def test_cells_are_read_twice(spark, tmp_path, exact):
    """Once for the words of the columns, which are written, and once for the points; the sample reads the words."""
    cells(spark, a=[["KWM_1"], ["KWM_2"]]).write.parquet(str(tmp_path / "cells"))
    read = spark.read.parquet(str(tmp_path / "cells"))
    assert column_words(read)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    df = points_from_cells(read, ExtractConfig(exact_sample=exact))
    assert df.count() == 2
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert physical.count(str(tmp_path / "cells")) == 1 and physical.count("Exchange") <= 1  # the broadcast of the files


@pytest.mark.parametrize("n, place", [(1, 0), (20, 0), (48, 27), (139, 135), (300, 203), (1048, 352)])
def test_positions(n, place):
    assert sample_positions(n, 1) == [place]


def test_one_per_building(spark):
    rows = [(i, f"P{i}", "A" if i < 48 else "B" if i < 187 else None) for i in range(200)]
    picked = sample_one_per_building(spark.createDataFrame(rows, "point_ord long, point_label string, building_id string"))
    assert {r.building_id: r.point_label for r in picked.collect()} == {"A": "P27", "B": "P183"}
    assert [r.point_label for r in ordered_samples(picked).collect()] == ["P27", "P183"]


def test_one_per_building_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(sample, "_STRETCH", 8)
    rows = [(i * 3 + 1, f"P{i}", "AB"[i % 3 > 0]) for i in range(500)]
    picked = sample_one_per_building(spark.createDataFrame(rows, "point_ord long, point_label string, building_id string").repartition(3))
    own = {b: [p for _, p, x in rows if x == b] for b in "AB"}
    assert {r.building_id: r.point_label for r in picked.collect()} == {b: p[sample_positions(len(p), 1)[0]] for b, p in own.items()}


def test_positions_are_found_once_for_each_size(spark):
    """Not for each stretch of a building, which made a run over n points cost n times n / 65,536."""
    rows = spark.range(10).selectExpr("id as point_ord", "'P' as point_label", "'A' as building_id")
    plan = sample_one_per_building(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("positions(") == 1


def test_names_from_addresses(spark):
    paths = ["file:/a%20b/c/x.csv", "file:/a/1%20+%25.csv", "s3a://b/a+b.csv"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in rows.select(_decoded_name(F.col("path"))).collect()] == ["x.csv", "1 +%.csv", "a+b.csv"]


@pytest.mark.parametrize("n", [5000, 8192, 8193, 65537, 300_001, 1_000_003])
def test_traced_positions(n):
    for k, seed in ((1, 42), (200, 42), (3, 7)):
        want = np.random.RandomState(seed).permutation(n)[:k].tolist()
        assert sample._traced(n, k, seed) == want == sample_positions(n, k, seed)


def test_directory(spark, tmp_path):
    files = {
        "31_mill-lane.csv": 'Label,Other\nKWM_1.ENRG,"x, y"\n"CT ""old"" 4",z\n',
        "bare.csv": "KWM_7\n\n   \nKWM_8\r\nKWM_9\n",
        "narrow.csv": "bas_raw,other\nKWM_1,x\nNA\nKWM_2,q\n",
        "lines.csv": 'KWM_4,"two\nlines"\nKWM_5,x\nKWM_6,y\n',
        "wide.csv": "KWM_1\nKWM_2,x\n",
        "open.csv": 'KWM_1\n"KWM_2\n',
        "empty.csv": "\n \n",
        "words.csv": "some\nplain\nwords\n",
        "other.txt": "KWM_1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.csv").write_bytes(b"KWM_1\n\xffA\n")
    (tmp_path / "quotes.csv").write_text('KWM_1\n"' + '""' * 100_000 + '"\nKWM_2\nKWM_3\n')
    found = load_points(spark, str(tmp_path))
    got = {}
    for r in found.points.orderBy("source_file", "row_no").collect():
        got.setdefault(r.source_file, []).append(r.point_label)
    assert got.pop("quotes.csv")[1] == '"' * 100_000
    assert got == {
        "31_mill-lane.csv": ["KWM_1.ENRG", 'CT "old" 4'],
        "bare.csv": ["KWM_7", "KWM_8", "KWM_9"],
        "narrow.csv": ["KWM_1", "nan", "KWM_2"],
        "lines.csv": ["KWM_4", "KWM_5", "KWM_6"],
    }
    row = found.points.where("source_file = '31_mill-lane.csv'").first()
    assert (row.building_id, row.point_label_col) == ("mill-lane", "Label")
    assert {r.source_file: r.reason for r in found.rejects.collect()} == {
        "wide.csv": "a row wider than the first", "open.csv": "open quote", "empty.csv": "empty", "words.csv": "no label column", "bad.csv": "not UTF-8",
    }


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    rows = [f'KWM_{i}.GPM,"x, {i}"' for i in range(30_000)]
    (tmp_path / "1 large+%file.csv").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(rows).encode())
    (tmp_path / "lines [x] {y}*.csv").write_text('KWM_4,"two\nlines"\nKWM_5,x\nKWM_6,y\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = load_points(spark, str(tmp_path))
        got = [(r.source_file, r.row_no, r.point_label) for r in found.points.orderBy("source_file", "row_no").collect()]
        records = read_records(spark, str(tmp_path))
        assert records.staged[1].where("source_file = '1 large+%file.csv'").count() > 5  # splits
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("1 large+%file.csv", i, f"KWM_{i}.GPM") for i in range(30_000)] + [("lines [x] {y}*.csv", i, f"KWM_{i + 4}") for i in range(3)]


def test_too_long_for_quotes_over_lines(spark, tmp_path):
    (tmp_path / "lines.csv").write_text('KWM_4,"two\nlines"\nKWM_5,x\nKWM_6,y\n')
    (tmp_path / "good.csv").write_text("KWM_4\nKWM_5\n" * 50)
    found = read_records(spark, str(tmp_path), whole_bytes=20)
    assert [tuple(r) for r in found.rejects.collect()] == [("lines.csv", "quotes over lines in too long a file")]
    assert found.rows.count() == 100


def test_lines_give_the_records_of_whole_files(spark, tmp_path):
    draw = random.Random(4)
    for i in range(60):
        fields = ["a", "b c", '"q"', '"q, r"', '"d ""e"" f"', 'x"y', "", " ", '"t" u', "NA", 'z""'] + (['"two\nlines"', '"open'] if i % 4 == 0 else [])
        rows = [",".join(draw.choices(fields, k=3 if draw.random() < 0.9 else 2)) for _ in range(draw.randrange(1, 12))]
        (tmp_path / f"f{i}.csv").write_text(draw.choice(["\n", "\r\n", "\r"]).join([*rows, draw.choice(["", "  ", "end,x,y"])]))
    found = read_records(spark, str(tmp_path))
    whole = cell_source._checked(cell_source.read_files(spark, str(tmp_path)))
    want = {(r.source_file, i): list(f) for r in whole.where("reason is null").collect() for i, f in enumerate(r.records)}
    assert {(r.source_file, r.row_no): list(r.fields) for r in found.rows.collect()} == want
    assert {tuple(r) for r in found.rejects.collect()} == {(r.source_file, r.reason) for r in whole.where("reason is not null").collect()}
