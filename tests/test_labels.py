import random

from pyspark.sql import functions as F
import pytest

from tagloom.config import Vocabulary
from tagloom.functions.labels import bio_tags, label_token, label_tokens, structured
from tagloom.operators.labelling import annotate, annotate_by_lookup, label_by_lookup, label_counts, lookup_table

SMALL = Vocabulary(
    equip=frozenset({"CHILLER", "LIFT"}), subcomp=frozenset({"GPM", "VALVE"}), point_func=frozenset({"TRIP"}), io_type=frozenset({"BI"}), vendor_tag=frozenset({"ACME"})
)


@pytest.mark.parametrize(
    "token, expected",
    [
        ("Acme", "VENDOR_TAG"), ("bi", "IO_TYPE"), ("LIFT", "EQUIP"), ("lift", "EQUIP"), ("Trip", "POINT_FUNC"), ("fl8", "FLOOR"), ("F11", "FLOOR"),
        ("fLOOr", "FLOOR"), ("rm5", "ZONE"), ("Rm44k", "ZONE"), ("904", "ZONE"), ("8612c", "ZONE"), ("7b6", "ZONE"), ("4xyz123", "ZONE"), ("9", "EQUIP_ID"),
        ("77", "EQUIP_ID"), ("60412", "EQUIP_ID"), ("K55", "EQUIP_ID"), ("k55", "MISC"), ("55K", "EQUIP_ID"), ("bLdG20", "BLDG"), ("bldg", "MISC"),
        ("noise", "MISC"), ("floors", "MISC"), ("4wxyz1", "MISC"), ("fl8\n", "FLOOR"), ("", "MISC"), ("3\u212a4", "ZONE"),
    ],
)
def test_label_token(spark, token, expected):
    rows = spark.createDataFrame([([token],)], "t array<string>")
    assert rows.select(label_token(F.col("t")[0], SMALL), label_tokens(F.col("t"), SMALL)[0]).first()[:] == (expected, expected)


def test_lookup_order_and_join(spark):
    both = Vocabulary(equip=frozenset({"X"}), vendor_tag=frozenset({"X"}), point_func=frozenset({"X", "Y"}), subcomp=frozenset({"Y"}))
    rows = spark.createDataFrame([("x",), ("Y",), ("12",)], "token string")
    assert [r[0] for r in rows.select(label_token(F.col("token"), both)).collect()] == ["VENDOR_TAG", "SUBCOMP", "EQUIP_ID"]
    terms = spark.createDataFrame([(c, t) for c, ts in both.in_lookup_order() for t in ts], "category string, token string")
    got = {r.token: r.label for r in label_by_lookup(rows, lookup_table(terms)).collect()}
    assert got == {"x": "VENDOR_TAG", "Y": "SUBCOMP", "12": "EQUIP_ID"}


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_bio(spark):
    cases = [
        (["ZONE", "ZONE", "ZONE", "MISC", "ZONE", "FLOOR"], ["B-ZONE", "I-ZONE", "I-ZONE", "O", "B-ZONE", "B-FLOOR"]),
        ([None, "IO_TYPE", None, "IO_TYPE", "IO_TYPE"], ["O", "B-IO_TYPE", "O", "B-IO_TYPE", "I-IO_TYPE"]),
        ([], []),
    ]
    for given, expected in cases:
        assert one(spark, "c array<string>", (given,), bio_tags(F.col("c"))) == expected


def view(spark, tokens, categories):
    return one(spark, "t array<string>, c array<string>", (tokens, categories), structured(F.col("t"), F.col("c"))).asDict()


def test_structured(spark):
    got = view(
        spark, ["LIFT", "ACME", "7b6", "VALVE", "fl8", "9", "bldg3", "TRIP", "BI"],
        ["EQUIP", "VENDOR_TAG", "ZONE", "SUBCOMP", "FLOOR", "EQUIP_ID", "BLDG", "POINT_FUNC", "IO_TYPE"],
    )
    assert got == dict(bldg="bldg3", floor="fl8", zone="7b6", equip="LIFT", equip_id="9", subcomp="VALVE", point_func="TRIP", io_type="BI", vendor="ACME")
    got = view(spark, ["P", "Q", "m", "n", "5", "6", "more"], ["EQUIP", "EQUIP", "SUBCOMP", "SUBCOMP", "ZONE", "ZONE"])
    assert (got["equip"], got["subcomp"], got["zone"], got["vendor"]) == ("P", "n", "5 6", None)
    assert set(view(spark, [], []).values()) == {None}


def test_structured_reads_a_label_once(spark):
    """A filter for zones alone; there was one for each field, each over all tokens zipped anew. Nulls and unequal lengths too."""
    rows = spark.createDataFrame([(["a", "b"], ["EQUIP"])], "t array<string>, c array<string>")
    plan = rows.select(structured(F.col("t"), F.col("c")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 1 and "arrays_zip" not in plan
    names = dict(zip(("bldg", "floor", "equip", "equip_id"), ("BLDG", "FLOOR", "EQUIP", "EQUIP_ID"))) | {"subcomp": "SUBCOMP", "point_func": "POINT_FUNC", "io_type": "IO_TYPE", "vendor": "VENDOR_TAG"}
    draw = random.Random(5)
    kinds = ["ZONE", None, "MISC", *names.values()]
    for _ in range(25):
        tokens, found = ([f"t{i}" for i in range(draw.randrange(9))], [draw.choice(kinds[: draw.choice((3, 6, 11))]) for _ in range(draw.randrange(9))])
        of = lambda kind: [t for t, c in zip(tokens, found) if c == kind]
        want = {n: (of(k) or [None])[0 if n in ("bldg", "floor", "equip", "equip_id") else -1] for n, k in names.items()} | {"zone": " ".join(of("ZONE")) or None}
        assert view(spark, tokens, found) == want
    assert set(view(spark, None, ["EQUIP"]).values()) == set(view(spark, ["a"], None).values()) == {None}


def test_annotate(spark):
    rows = spark.createDataFrame([("Lift 9/GPM:bi", "yard"), ("_", "quay"), (None, None)], "point_label string, building_id string")
    first, second, third = annotate(rows, SMALL).collect()
    assert first.tokens == ["Lift", "9", "GPM", "bi"] and first.token_labels == ["EQUIP", "EQUIP_ID", "SUBCOMP", "IO_TYPE"]
    assert first.bio_tags == ["B-" + x for x in first.token_labels]
    assert (first.building_id, first.source_file, first.label_source, first.structured.equip_id) == ("yard", None, "rule", "9")
    assert second.tokens == [] and second.bio_tags == [] and third.tokens == []
    with pytest.raises(ValueError):
        annotate(rows.drop("point_label"), SMALL)
    assert "Exchange" not in annotate(rows, SMALL)._jdf.queryExecution().executedPlan().toString()
    counts = {r.label: r.n for r in label_counts(rows.union(rows), SMALL).collect()}
    assert counts == {"EQUIP": 2, "EQUIP_ID": 2, "SUBCOMP": 2, "IO_TYPE": 2}


def test_annotate_by_lookup_is_annotate(spark):
    labels = ["CHILLER-3.VALVE bi", "acme LIFT lift fl Floor", None, "", "._-", "904b x Trip GPM GPM", "CHILLER-3.VALVE bi"]
    rows = spark.createDataFrame([(i, t, "b", None) for i, t in enumerate(labels)], "point_ord long, point_label string, building_id string, x string").repartition(3)
    terms = lookup_table(spark.createDataFrame([(c, t) for c, ts in SMALL.in_lookup_order() for t in ts], "category string, token string"))
    want = sorted(map(str, annotate(rows, SMALL).collect()))
    for most in (1, 3, 1000):
        got = annotate_by_lookup(rows, terms, frequent_rows=most)
        assert got.columns[-1] == "point_ord" and sorted(map(str, got.drop("point_ord").collect())) == want
    plan = annotate_by_lookup(rows, terms)._jdf.queryExecution().toString()
    assert "CHILLER" not in plan and "INSET" not in plan.upper()
    assert annotate_by_lookup(rows.limit(0), terms).count() == 0


def test_a_million_terms(spark):
    terms = spark.range(1_000_000).selectExpr("'VENDOR_TAG' as category", "cast(id * 3 as string) as token").unionByName(spark.range(1).selectExpr("'EQUIP'", "'UNIT'").toDF("category", "token"))
    rows = spark.range(500).selectExpr("id as point_ord", "concat('unit ', id * 5000, ' x') as point_label", "'b' as building_id")
    found = {r.point_ord: r.token_labels for r in annotate_by_lookup(rows, lookup_table(terms), frequent_rows=10).collect()}
    other = {1: "EQUIP_ID", 2: "EQUIP_ID", 3: "ZONE", 4: "ZONE"}
    assert found == {i: ["EQUIP", "VENDOR_TAG" if i * 5000 % 3 == 0 else other.get(len(str(i * 5000)), "EQUIP_ID"), "MISC"] for i in range(500)}
