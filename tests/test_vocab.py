from pyspark.sql import functions as F

from tagloom.config import VocabConfig
from tagloom.operators.stats import corpus_stats, numbered_buildings, token_counts_by_building, token_stats
from tagloom.operators.vocab import bottom_equipment, bundle, classify, is_io_type, is_vendor, top_equipment, trim


def stats(spark, rows):
    return spark.createDataFrame([(t, f, b, n, i) for i, (t, f, b, n) in enumerate(rows)], "token string, freq long, buildings long, numid_bigrams long, first_ord long")


def kinds(spark, rows, config=VocabConfig()):
    return {r.token: r.category for r in classify(stats(spark, rows), config).collect()}


def points(spark, rows):
    return spark.createDataFrame([(i, label, b) for i, (label, b) in enumerate(rows)], "point_ord long, point_label string, building_id string")


def test_token_stats(spark):
    p = points(spark, [("CT 01 ct", "yard"), ("CT-2", "quay"), ("CT", None), ("._", "mill"), (None, "dock"), ("end 7", "yard"), ("ct", "unknown")])
    got = {r.token: (r.freq, r.buildings, r.numid_bigrams, r.first_ord) for r in token_stats(p).collect()}
    assert got["CT"] == (5, 4, 2, 0)  # a null building counts, and is not the one called unknown
    assert got["7"] == (1, 1, 0, (5 << 31) + 1)
    assert (got["END"][2], got["01"][2]) == (1, 0)
    assert corpus_stats(p).first().asDict() == {"num_tokens": 5, "num_buildings": 4}
    assert token_counts_by_building(p).where("token = 'CT'").count() == 4
    assert token_stats(p.limit(0)).count() == 0


def test_supports_over_many_buildings(spark):
    rows = [(f"AHU {i % 7}" if i % 3 else "vav x", None if i % 150 == 149 else f"b{i % 150}") for i in range(900)]
    p = points(spark, rows).repartition(5)
    numbers = sorted(r.building for r in numbered_buildings(p).collect())
    assert numbers == list(range(150))
    want = {}
    for label, b in rows:
        for t in label.upper().split():
            want.setdefault(t, set()).add(b)
    assert {r.token: r.buildings for r in token_stats(p).collect()} == {t: len(b) for t, b in want.items()}
    assert {r.token: r.n for r in token_counts_by_building(p).groupBy("token").agg(F.count("*").alias("n")).collect()} == {t: len(b) for t, b in want.items()}
    assert corpus_stats(p).first().asDict() == {"num_tokens": len(want), "num_buildings": 150}
    assert corpus_stats(p.limit(0)).first().asDict() == {"num_tokens": 0, "num_buildings": 0}


def test_io_and_vendor(spark):
    rows = spark.createDataFrame([(x,) for x in "UO BV IO TRANE N2 LONNET PLANETNET CARINET GRANITE".split()], "t string")
    got = {r.t: (r.io, r.v) for r in rows.select("t", is_io_type(F.col("t")).alias("io"), is_vendor(F.col("t")).alias("v")).collect()}
    assert [x for x, (io, _) in got.items() if io] == ["UO", "BV"]
    assert [x for x, (_, v) in got.items() if v] == ["TRANE", "N2", "LONNET", "CARINET"]


def test_classes(spark):
    assert kinds(
        spark,
        [("HHW", 1, 1, 0), ("HUMID", 12, 2, 0), ("ENBLD", 10, 2, 0), ("STATS", 10, 2, 0), ("boil", 40, 4, 0), ("LEVELS", 30, 2, 0), ("KLM", 10, 2, 0),
         ("NOP", 9, 2, 0), ("OPQ", 90, 1, 0), ("SUPPLY", 60, 8, 0), ("GENERAL", 60, 8, 0), ("DUCT", 60, 8, 0), ("VENT", 60, 8, 0), ("DUCTNET", 1, 1, 0)],
    ) == {
        "HHW": "EQUIP", "HUMID": "SUBCOMP", "ENBLD": "POINT_FUNC", "STATS": "POINT_FUNC", "boil": None, "LEVELS": "SUBCOMP", "KLM": "EQUIP", "NOP": None,
        "OPQ": None, "SUPPLY": None, "GENERAL": None, "DUCT": "SUBCOMP", "VENT": "SUBCOMP", "DUCTNET": "VENDOR_TAG",
    }
    assert kinds(spark, [("STATIC", 40, 5, 0)]) == {"STATIC": "POINT_FUNC"}
    assert kinds(spark, [("STATIC", 2, 1, 0)]) == {"STATIC": "SUBCOMP"}
    assert kinds(spark, [("MAU", 1, 1, 0)], VocabConfig(equip_blacklist=("MAU",))) == {"MAU": None}


def test_scores_and_trim(spark):
    rows = [("FLT", 10, 2, 0), ("SLOT", 11, 2, 0), ("DAY", 3, 1, 0), ("RUN", 4, 1, 0), *((f"{a}{b}X", 20, 5, 1) for a in "ABCDEFGHIJ" for b in "ABCDEFGHIJKLMNOP")]
    classified = classify(stats(spark, rows))
    scores = {r.token: r.score for r in classified.collect()}
    assert (scores["FLT"], scores["SLOT"], scores["DAY"], scores["RUN"], scores["AAX"]) == (14, 15, 4, 5, 33)
    kept = {r.token for r in trim(classified).collect()}
    assert "SLOT" in kept and "RUN" in kept and not {"FLT", "DAY"} & kept
    top = [r.token for r in top_equipment(classified).collect()]
    assert len(top) == 150 and top[0] == "AAX" and top[-1] == rows[4 + 149][0]  # ties: first occurrence
    assert [r.token for r in bottom_equipment(classified).collect()] == [r[0] for r in rows[-30:]]


def test_bundle_orders_and_trims(spark):
    """Frequencies in order of first occurrence, terms in order of name, and scored terms only from their least score on."""
    labels = [("zeta", "north"), ("DI PUMP", "north"), ("PUMP 7 zeta", "south"), *[("SPEED", b) for b in ("north", "south", None) * 4], ("DAT", "south"), ("AI", None)]
    row = bundle(classify(token_stats(points(spark, labels))), corpus_stats(points(spark, labels))).withColumn("order", F.map_keys("frequency")).first()
    assert row.order == ["ZETA", "DI", "PUMP", "7", "SPEED", "DAT", "AI"]
    assert (row.frequency["SPEED"], row.frequency["ZETA"], row.stats.num_tokens, row.stats.num_buildings) == (12, 2, 7, 3)
    assert (row.io_type_vocab, row.equip_vocab, row.vendor_vocab, row.point_func_vocab) == (["AI", "DI"], ["PUMP"], [], [])
    assert row.subcomp_vocab == ["SPEED"]  # 12 + 2 * 3; DAT has 1 + 2 * 1 and goes


def test_plan_has_hash_aggregates_only(spark):
    p = points(spark, [("AHU 1", "B")])
    plan = token_stats(p)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BatchEval" not in plan
