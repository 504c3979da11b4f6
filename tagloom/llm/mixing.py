"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Targets: every source has a weight and at most ``MOST`` times its own words; the level at which weights fill up to the
wanted total is found over the table of sources. Schedule: the van der Corput point of slot ``k`` (its bits reversed)
falls into one source's share of the cumulative targets, so any stretch of slots holds the sources near their weights.
Slots are ranked in each source, and the source's documents, shuffled by hash and laid end to end, are cut into as many
blocks of equal words as it has slots; block ``r`` goes to the slot of rank ``r``. A source that is taken more than once
starts again from its first block's words.

Ranks and running sums go through ``GROUPS`` hash groups of each source: sums by group first, then within each group, so
a source that holds a third of all rows is spread over as many tasks as any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.storage import staged

#: A run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
GROUP_BITS = 10
SEED = 17
#: Points are made so many at a time.
_POINTS = 4096


@dataclass(frozen=True)
class Mix:
    """``sources``: targets. ``schedule``: slot, source and block. ``pieces``: which words of which row a slot takes.

    ``taken``: each row of the documents with the words taken from it, the first slot that takes some, and for each pass
    over its source the first slot and the words.
    """

    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    taken: DataFrame


def source_key(source: Column) -> Column:
    """Sorts by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def row_hash(seed: int, doc_id: Column, text: Column, source: Column) -> Column:
    """Shuffles documents; rows that agree in all three are alike."""
    return F.xxhash64(F.lit(seed), doc_id, text, source_key(source))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Over the table of sources alone: one row each, so its windows need no key."""
    by_name = Window.partitionBy(F.lit(1)).orderBy("source_key")
    everything = Window.partitionBy(F.lit(1))
    by_ratio = everything.orderBy("ratio", "source_key")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    return (
        sizes.withColumn("weight", pick)
        .withColumn("most", F.col("source_size") * most)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("level.level") * F.col("weight")))
        .withColumn("take", F.least(F.round("target").cast("long"), F.col("most")))
        .select("source_key", "source_size", "target", "take", "wanted")
    )


def _shares(targets: DataFrame, block_words: int) -> DataFrame:
    """Each source's points ``[lo, hi)`` of ``2**bits``; one too small to hold a point shares the one it falls on."""
    everything = Window.partitionBy(F.lit(1))
    before = everything.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    bits = F.ceil(F.log2(F.greatest(F.col("wanted") / block_words, F.lit(1.0)))).cast("int")
    return (
        targets.withColumn("bits", F.greatest(bits, F.lit(GROUP_BITS)))
        .withColumn("grid", F.expr("shiftleft(1L, bits)"))
        .withColumn("all", F.greatest(F.sum("target").over(everything), F.lit(1.0)))
        .withColumn("end", F.sum("target").over(before))
        .withColumn("lo", F.least(F.ceil((F.col("end") - F.col("target")) / F.col("all") * F.col("grid")), F.col("grid") - 1))
        .withColumn("hi", F.least(F.ceil(F.col("end") / F.col("all") * F.col("grid")), F.col("grid")))
        .withColumn("hi", F.when(F.col("take") > 0, F.greatest("hi", F.col("lo") + 1)).otherwise(F.col("lo")))
        .withColumn("slots", F.col("hi") - F.col("lo"))
        .withColumn("block", F.when(F.col("take") > 0, F.expr("(take + slots - 1) div slots")).otherwise(F.lit(1)))
        .select("source_key", "source_size", "target", "take", "bits", "lo", "hi", "block")
    )


def _running(rows: DataFrame, group: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over the rows of a source that come before, through groups that sort as the rows do.

    Adds ``out`` and ``nr``, the row's number in its group.
    """
    keys = ["source_key", group]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    up_to = Window.partitionBy("source_key").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.join(base.hint("merge"), keys)
        .withColumn("nr", F.row_number().over(inside))
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_base")
    )


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> Mix:
    """Mix ``share`` times all words from the sources, weighed in the order of their names.

    Null texts have no words, rows without words are never taken, a null source is a source of its own and comes last.
    Repeated rows are rows of their own. Extra columns are ignored. An empty table gives empty tables. Runs agree: the
    shuffle is a hash of id, text and source. The sizes are staged, so texts are read once. Documents and slots, which
    grow, are joined by shuffle.
    """
    sized = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            source_key(F.col(source)).alias("source_key"),
            word_count(F.col(text)).alias("size"),
            row_hash(seed, F.col(doc_id), F.col(text), F.col(source)).alias("h"),
        ).withColumn("group", F.shiftright("h", 64 - GROUP_BITS)),
        "mix-sizes",
    )
    sizes = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    shares = staged(_shares(_targets(sizes, weights, share, most), block_words), "mix-sources")

    cells = (
        shares.where("hi > lo")
        .withColumn("cell", F.expr(f"shiftleft(1L, bits - {GROUP_BITS})"))
        .withColumn("c", F.explode(F.expr("sequence(lo div cell, (hi - 1) div cell)")))
        .select("source_key", "bits", F.greatest("lo", F.expr("c * cell")).alias("a"), F.least("hi", F.expr("(c + 1) * cell")).alias("b"))
        .repartition("source_key", "a")
    )
    some = cells.withColumn("a", F.explode(F.expr(f"sequence(a, b - 1, {_POINTS})"))).withColumn("b", F.least("b", F.col("a") + _POINTS))
    slots = some.withColumn("point", F.explode(F.expr("sequence(a, b - 1)"))).select(
        "source_key",
        F.expr("cast(conv(reverse(lpad(bin(point), bits, '0')), 2, 10) as bigint)").alias("slot"),
        F.expr(f"shiftright(cast(conv(reverse(lpad(bin(point), bits, '0')), 2, 10) as bigint), bits - {GROUP_BITS})").alias("part"),
    )
    schedule = _running(slots, "part", ["slot"], F.lit(1), "r").select("slot", "source_key", "r")

    placed = (
        _running(sized, "group", ["h", "doc_id", "size"], F.col("size"), "start")
        .join(_spread(sized, shares).hint("merge"), ["source_key", "group"])
        .withColumn("passes", F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(most, 1) - 1)), _span), lambda x: x["b"] > x["a"]))
    )
    blocks = (
        placed.withColumn("p", F.explode_outer("passes"))
        .withColumn("r", F.explode_outer(F.when(F.col("p").isNotNull(), F.expr("sequence(p.a div block, (p.b - 1) div block)"))))
        .withColumn("a", F.greatest(F.col("p.a"), F.expr("r * block")))
        .withColumn("b", F.least(F.col("p.b"), F.expr("(r + 1) * block")))
        .withColumn("r", F.coalesce("r", -1 - F.pmod("h", F.lit(1 << 40))))  # rows that are not taken meet no slot
    )
    joined = blocks.join(schedule.hint("merge"), ["source_key", "r"], "left")
    row = ["source_key", "group", "nr", "doc_id", "h", "size", "source_size", "target"]
    pieces = joined.where("slot is not null").select(
        "slot", "source_key", "doc_id", "h", "p.turn", (F.col("a") - F.col("p.start")).alias("first_word"), (F.col("b") - F.col("a")).alias("words")
    )
    used = F.when(F.col("slot").isNotNull(), F.col("b") - F.col("a"))
    by_pass = joined.groupBy(*row, F.col("p.turn").alias("turn")).agg(F.sum(used).alias("words"), F.min(F.when(used > 0, F.col("slot"))).alias("slot"))
    passes = F.collect_list(F.when(F.col("words") > 0, F.struct("turn", "slot", "words")))  # at most ``most``
    taken = (
        by_pass.groupBy(*row)
        .agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"), F.array_sort(passes).alias("passes"))
        .select("doc_id", "source_key", "h", "size", "source_size", "target", "taken", "first_slot", "passes")
    )
    return Mix(shares, schedule, pieces, taken)


def _span(turn: Column) -> Column:
    """The row's words in the stream of its source's ``turn``-th pass, as far as the source is taken."""
    start = F.col("start") + turn * F.col("source_size")
    return F.struct(turn.alias("turn"), start.alias("start"), start.alias("a"), F.least(start + F.col("size"), F.col("take")).alias("b"))


def _spread(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """The sources' figures for each of their groups, so that documents join them by group and no source is one key."""
    groups = sized.groupBy("source_key", "group").agg(F.count("*").alias("_rows")).drop("_rows")
    return groups.join(shares.select("source_key", "source_size", "target", "take", "block"), "source_key")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them; one that it cuts off ends after the words taken (blanks as spaces).

    Each partition is in the order of the schedule's slots, so any stretch of it holds the sources near their weights.
    ``n_chars``, if there, follows the text. Null and empty texts have no words and are not taken. Rows alike in id, text
    and source are told apart by a running number in the order of a hash of the whole row. An empty table gives no rows.
    """
    names = {x: options.get(x, x) for x in ("doc_id", "text", "source")}
    text = F.col(names["text"])
    mark = row_hash(options.get("seed", SEED), F.col(names["doc_id"]), text, F.col(names["source"]))
    twin = lambda order: F.row_number().over(Window.partitionBy("h").orderBy(order))
    taken = mix_sources(docs, **options).taken.select("h", "passes", "size", "first_slot").withColumn("twin", twin(F.struct("first_slot", "passes")))
    taken = taken.where("first_slot is not null").drop("first_slot")
    rows = docs.select(F.struct("*").alias("row"), mark.alias("h")).withColumn("same", twin(F.xxhash64("row")))
    text = F.col("row")[names["text"]]
    words = F.col("pass.words")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, words.cast("int")), " ")
    out = (
        rows.join(taken.hint("merge"), "h")
        .where("same = twin")
        .withColumn("pass", F.explode("passes"))
        .withColumn("body", F.when(words >= F.col("size"), text).otherwise(cut))
        .sortWithinPartitions("pass.slot", "h", "pass.turn")
    )
    changed = {names["text"]: F.col("body"), "n_chars": F.length("body")}
    return out.select(
        *(changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("row")[f.name].alias(f.name) for f in docs.schema)
    )
