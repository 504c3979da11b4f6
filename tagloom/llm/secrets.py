"""Secret scans: fixed patterns, and a battery of randomness tests on long strings. DataFrame functions only.

Patterns give spans of the kinds assign, access and hex. Every other run of 20 and more letters, digits and ``+/_-`` is
held to be a string in the smallest encoding that has all its symbols; one that has signs both of ``+/`` and of ``_-`` is
cut into its longest runs without the ones and without the others. Four tests ask whether it can be a uniform draw
from that alphabet: chi-squared over the classes of symbols and over equal cells of the alphabet, the number of runs
above and below the middle, and serial correlation. The smallest p counts four times (Bonferroni).

Which strings are no draw is decided for all documents at once, by Benjamini and Hochberg in each stratum of encoding
and length (powers of two), since a short string's tests can show less. A string that is not rejected is a span of kind
random. P-values are kept in bins of a twentieth of a power of ten, each at its upper edge, so what the decision needs
of the corpus is one bounded table of counts. As a random draw is the null hypothesis, the rate that is controlled is
that of keys among the strings set aside: at most ``RATE`` of what is rejected as text is expected to be a key. How many
strings that are no keys pass for one depends on their length, and is measured in the tests.

A span is the whole match, in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns, and the least length of a match (assign: of its second group).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
RATE = 0.1
_RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: Runs inside one that no encoding has, as it mixes the signs of two.
_PARTS = tuple(rf"(?<![{x}])[{x}]{{{LEAST},}}={{0,2}}" for x in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: symbols in classes.
ENCODINGS: tuple[tuple[str, ...], ...] = (
    (_DIGITS, "abcdef"),
    (_DIGITS, "ABCDEF"),
    (_UPPER, "234567"),
    (_DIGITS, _LOWER),
    (_DIGITS, _UPPER),
    (_DIGITS, _UPPER, _LOWER),
    (_DIGITS, _UPPER, _LOWER, "+/"),
    (_DIGITS, _UPPER, _LOWER, "-_"),
)
_BINS, _PER_TEN = 240, 20
_LENGTHS = 24


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal law (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _chi_tail(x2: Column, df: Column) -> Column:
    """P(chi-squared > x2), by Wilson and Hilferty."""
    c = 2.0 / (9.0 * df)
    return _tail((F.pow(x2 / df, 1 / 3) - (1 - c)) / F.sqrt(c))


def _encoding(body: Column) -> Column:
    """Number of the first encoding that has all symbols; null if none has, and for numbers, which are no keys."""
    out = F.when(body.rlike("^[0-9]+$"), F.lit(None).cast("int"))
    for i, classes in enumerate(ENCODINGS):
        out = out.when(body.rlike("^[" + "".join(classes).replace("-", r"\-") + "]+$"), F.lit(i))
    return out


def _battery(body: Column, encoding: Column) -> Column:
    """P-value of a uniform draw from the encoding's alphabet; one expression for all encodings."""
    alphabet = F.element_at(F.array(*(F.lit("".join(c)) for c in ENCODINGS)), encoding + 1)
    bounds = F.element_at(F.array(*(F.array(*(F.lit(sum(map(len, c[:i]))) for i in range(len(c) + 1))) for c in ENCODINGS)), encoding + 1)
    places = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)

    def tests(d: Column) -> Column:
        x, bound, size = d["x"], d["bounds"], d["size"]
        n = F.size(x)

        def squares(starts: Column) -> Column:
            """Chi-squared of the cells between neighbouring starts."""
            cell = lambda a, b: F.pow(F.size(F.filter(x, lambda v: (v >= a) & (v < b))), 2) / (n * (b - a) / size)
            cells = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), cell)
            return F.greatest(F.aggregate(cells, F.lit(0.0), lambda s, v: s + v) - n, F.lit(0.0))

        cells = F.least(size, F.greatest(F.lit(2), F.floor(n / 5).cast("int")))
        even = F.transform(F.sequence(F.lit(0), cells), lambda i: F.floor(i * size / cells).cast("int"))
        pairs = F.zip_with(F.slice(x, 1, n - 1), F.slice(x, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        changes = F.size(F.filter(pairs, lambda p: (p["a"] >= size / 2) != (p["b"] >= size / 2)))
        runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle, spread = (size - 1) / 2, (size * size - 1) / 12
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle)) / spread / F.sqrt(n - 1)
        return 4 * F.least(
            _chi_tail(squares(bound), F.size(bound) - 2), _chi_tail(squares(even), cells - 1), 2 * _tail(F.abs(runs)), 2 * _tail(F.abs(serial))
        )

    given = F.struct(places.alias("x"), bounds.alias("bounds"), F.length(alphabet).alias("size"))
    return F.element_at(F.transform(F.array(given), tests), 1)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _root(n: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")


def _folded(items: Column, start: Column, total, step, joined) -> Column:
    """All that ``step`` puts out over the items, in time n to the power 1.5: in chunks, as appending copies an array.

    A state is what came before (``at``) and what a chunk has put out. ``total``: the state after a chunk from that before.
    """

    def whole(d: Column) -> Column:
        chunk = lambda s: F.slice(d["items"], s + 1, d["c"])
        starts = F.sequence(F.lit(0), F.greatest(F.size(d["items"]) - 1, F.lit(0)), d["c"])
        before = F.aggregate(
            starts,
            F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda st, s: F.struct(total(st["at"], chunk(s)).alias("at"), F.array_append(st["out"], st["at"]).alias("out")),
            lambda st: st["out"],
        )
        return F.flatten(F.zip_with(starts, before, lambda s, at: F.aggregate(chunk(s), joined(at), step, lambda st: st["out"])))

    return _with(F.struct(items.alias("items"), _root(F.size(items)).alias("c")), whole)


def _spans(text: Column, pattern: str, keep, value) -> Column:
    """Spans of the pattern's matches: ``value(start, end, match, groups)`` where ``keep``; none without a match."""
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), bodies.alias("body"))
    empty = F.array().cast("array<struct<s:int,e:int,body:string>>")

    def step(state: Column, x: Column) -> Column:
        s, body = state["at"] + F.length(x["gap"]), x["body"]
        span = F.struct(s.alias("s"), (s + F.length(body)).alias("e"), body.alias("body"))
        return F.struct(
            (s + F.coalesce(F.length(body), F.lit(0))).alias("at"),
            F.when(body.isNull() | ~keep(body), state["out"]).otherwise(F.array_append(state["out"], span)).alias("out"),
        )

    def total(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, at, lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["body"]), F.lit(0)))

    found = _folded(pairs, F.lit(0), total, step, lambda at: F.struct(at.alias("at"), empty.alias("out")))
    return F.when(text.rlike(pattern), F.transform(found, value)).otherwise(F.array())


def _plain(kind: int):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans of the three fixed kinds, in order."""
    group = F.regexp_extract
    sure = {
        "assign": (ASSIGN, lambda m: F.length(group(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        "access": (rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", lambda m: F.lit(True)),
        "hex": (rf"[0-9a-f]{{{HEX_LEAST},}}", lambda m: F.lit(True)),
    }  # a run of hex or access symbols that is too short has no longer match inside it
    return {k: _spans(text, p, keep, _plain(i)) for i, (k, (p, keep)) in enumerate(sure.items())}


def candidates(text: Column) -> Column:
    """Long runs with their stratum (encoding and length) and the bin of their p-value."""

    def parted(x: Column) -> Column:
        shifted = lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["body"].alias("body"))
        parts = F.concat(*(_spans(x["body"], p, lambda m: F.lit(True), shifted) for p in _PARTS))
        return F.when(x["body"].rlike("[+/]") & x["body"].rlike("[_-]"), parts).otherwise(F.array(x))

    def tested(x: Column) -> Column:
        body = F.regexp_replace(x["body"], "=+$", "")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), body.alias("body"), _encoding(body).alias("encoding"))

    def placed(x: Column) -> Column:
        length = F.least(F.floor(F.log2(F.length(x["body"]))), F.lit(_LENGTHS - 1)).cast("int")
        p = F.greatest(F.least(_battery(x["body"], x["encoding"]), F.lit(1.0)), F.lit(1e-12))
        bin_ = F.least(F.floor(-F.log10(p) * _PER_TEN), F.lit(_BINS)).cast("int")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), (x["encoding"] * _LENGTHS + length).alias("stratum"), bin_.alias("bin"))

    runs = F.flatten(F.transform(_spans(text, _RUN, lambda m: F.lit(True), lambda x: x), parted))
    known = F.filter(F.transform(runs, tested), lambda x: x["encoding"].isNotNull())
    return F.transform(known, placed)


def rejection_bins(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """For each stratum the first bin of p-values that is rejected, over all documents; at most one for each stratum."""
    counts = (
        docs.select(F.explode(candidates(F.col(text).cast("string"))).alias("c"))
        .groupBy("c.stratum", "c.bin")
        .agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("stratum")
    smaller = own.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.pow(F.lit(10.0), -F.col("bin") / _PER_TEN)
    found = (
        counts.withColumn("all", F.sum("n").over(own))
        .withColumn("up_to", F.sum("n").over(smaller))
        .where(edge * F.col("all") / F.col("up_to") <= rate)
        .groupBy("stratum")
        .agg(F.min("bin").alias("bin"))
    )
    return {r.stratum: r.bin for r in found.collect()}


def secret_spans(text: Column, rejected: dict[int, int]) -> dict[str, Column]:
    """Arrays of spans by kind; ``rejected`` comes from :func:`rejection_bins`."""
    first = F.create_map(*(F.lit(x) for pair in rejected.items() for x in pair)) if rejected else None

    def draw(x: Column) -> Column:
        return F.lit(True) if first is None else x["bin"] < F.coalesce(F.try_element_at(first, x["stratum"]), F.lit(_BINS + 1))

    random = F.transform(F.filter(candidates(text), draw), _plain(KINDS.index("random")))
    return base_spans(text) | {"random": random}


def _ordered(*spans: Column) -> Column:
    return F.array_sort(F.transform(F.concat(*spans), lambda x: F.struct(x["s"], x["k"], x["e"])))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: counts by kind, the digest of the fixed kinds' spans, and all spans.

    Null and empty texts have no spans. Repeated rows give repeated rows. Extra columns are ignored. An empty table
    gives no rows. The corpus is read twice: for the strata's counts, then for the spans.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    spans = rows.select("doc_id", F.struct(*(v.alias(k) for k, v in secret_spans(F.col("t"), rejection_bins(rows, "t", rate)).items())).alias("x"))
    base = _written(_ordered(*(F.col(f"x.{k}") for k in KINDS[:3])))
    return spans.select(
        "doc_id",
        *(F.size(f"x.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(base, 256).alias("base_sha256"),
        _written(_ordered(*(F.col(f"x.{k}") for k in KINDS))).alias("spans"),
        F.size("x.random").cast("long").alias("n_random"),
    )


def redacted(docs: DataFrame, *, text: str = "text", rate: float = RATE, mask: str = "[secret]") -> DataFrame:
    """All rows and columns, each stretch of secrets in the text replaced by ``mask``; ``n_chars``, if there, follows.

    Overlapping spans make one stretch. A null text stays null, an empty one empty. Repeated rows stay repeated and equal
    texts are masked alike. An empty table gives no rows.
    """
    given = F.col(text).cast("string")
    rejected = rejection_bins(docs, text, rate)
    rows = docs.select(F.struct("*").alias("row"), given.alias("body"), _ordered(*secret_spans(given, rejected).values()).alias("spans"))
    body, spans = F.col("body"), F.col("spans")

    # Stretches of overlapping spans: a span that begins before the end of an earlier one belongs to its stretch. Chunks
    # take their own part of the text first, as finding a place in a text means reading up to it.
    empty = F.array().cast("array<struct<gap:int,s:int,e:int>>")

    def step(state: Column, x: Column) -> Column:
        own = F.struct(state["at"].alias("gap"), x["s"].alias("s"), x["e"].alias("e"))
        return F.struct(
            F.greatest(state["at"], x["e"]).alias("at"),
            F.when(x["s"] >= state["at"], F.array_append(state["out"], own)).otherwise(state["out"]).alias("out"),
        )

    latest = lambda at, chunk: F.greatest(at, F.array_max(F.transform(chunk, lambda x: x["e"])))
    stretches = _folded(spans, F.lit(0), latest, step, lambda at: F.struct(at.alias("at"), empty.alias("out")))

    def written(d: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(d["x"]) - 1, d["c"])

        def part(k: Column) -> Column:
            own = F.slice(d["x"], k + 1, d["c"])
            first, last = F.get(own, F.lit(0))["gap"], F.element_at(own, -1)["s"]
            given = F.struct(own.alias("own"), F.substring(d["body"], first + 1, last - first).alias("text"), first.alias("first"))
            gap = lambda g: lambda x: F.concat(F.substring(g["text"], x["gap"] - g["first"] + 1, x["s"] - x["gap"]), F.lit(mask))
            return F.array_join(_with(given, lambda g: F.transform(g["own"], gap(g))), "")

        end = d["end"]
        return F.concat(F.array_join(F.transform(starts, part), ""), F.substring(d["body"], end + 1, F.length(d["body"])))

    end = F.array_max(F.transform(spans, lambda x: x["e"]))
    bound = F.struct(body.alias("body"), F.col("stretches").alias("x"), _root(F.size("stretches")).alias("c"), end.alias("end"))
    rows = rows.withColumn("stretches", F.when(F.size(spans) > 0, stretches))
    clean = _with(bound, written)
    rows = rows.select("row", F.when(F.size(spans) > 0, clean).otherwise(body).alias("clean"))
    changed = {text: F.col("clean"), "n_chars": F.length("clean")}
    return rows.select(
        *(changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("row")[f.name].alias(f.name) for f in docs.schema)
    )
