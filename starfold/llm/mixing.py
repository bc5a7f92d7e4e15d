"""Mixing of sources to target weights by a splitting tree over block quotas.

Documents are dealt by hash into blocks of their source, about ``BLOCK_WORDS`` words or ``BLOCK_DOCS`` documents each.
Passes over a source's blocks are laid on one line, every pass in a permutation of its own; the source
gives the blocks that begin before its target, so its quota is a number of blocks and the last of them is cut where
the target lies. The quotas of all sources are then split among the output shards: a node of the tree holds a run of
shards and what each source gives to them, and its first half gets a multivariate hypergeometric share, drawn source
by source. Every shard has as many blocks as any other (at most one apart), every source's quota is spent to the
last block, and a shard takes the next blocks of each permutation, so no draw goes to two shards. Rows are shuffled
inside their shard by hash.

All randomness is hashed from ids, texts and the seed: the partitioning does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.operators.indexing import dense_index

from .common import id_and_text, same, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
SHARDS = 32
BLOCK_WORDS = 16_384
BLOCK_DOCS = 4_096
#: Equal rows that are told apart by number in one task, blocks whose places are summed in one task, members of a tree row.
COPIES, RUN_BLOCKS, MEMBERS = 4_096, 1_024, 1_024

_ROW = ["doc_id", "source", "size", "text_hash"]


def unit(*parts: Column | str) -> Column:
    """A number from 0 to 1 (never 1) that follows from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(2.0 ** 53)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---------------------------------------------------------------- rows and sources

def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Distinct rows with their number of words, a hash of the text and how many ``copies`` of the row there are."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"))
    return rows.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("copies"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """``source, s, source_size, n, weight, target`` of every source, numbered by code point, null last.

    Targets are in proportion to the weights up to ``most`` times the source's size; what a full source cannot take
    goes to the others by weight. One row of sums a round reaches the driver.
    """
    spark = rows.sparkSession
    sums = written(spark, rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n")), "sources")
    named = sums.where(F.col("source").isNotNull())
    numbers = dense_index(named, "source", "s")
    place = F.coalesce(F.col("s"), F.lit(named.count())).cast("long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    table = written(spark, sums.join(numbers, "source", "left").withColumn("s", place).withColumn("weight", weight), "weights")
    limit = F.col("source_size") * most
    total, weight_sum = table.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = share * (total or 0)
    level, full = whole / (weight_sum or 1), 0
    while True:
        over = limit < level * F.col("weight")
        spent, left, count = table.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if count == full or not left:
            break
        level, full = (whole - spent) / left, count
    return table.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def placed(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Every row of the table, equal rows told apart by ``copy``, with its source's number and its ``block``."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n") / block_docs)).cast("long")
    known = sources.select(F.col("source").alias("_source"), "s", blocks.alias("_blocks"))
    some = (rows.withColumn("_some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
            .repartition("doc_id", "text_hash", "_some"))
    last = F.least(F.col("copies"), (F.col("_some") + 1) * COPIES) - 1
    each = some.withColumn("copy", F.explode(F.sequence(F.col("_some") * COPIES, last)))
    return (each.join(known, same(F.col("source"), F.col("_source")))
            .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.col("_blocks")))
            .select("s", "block", *[c for c in _ROW if c != "source"], "copy"))


# ---------------------------------------------------------------- draws

def line(blocks: DataFrame, sources: DataFrame, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """``s, block, turn, words, rank, before``: all passes over each source's blocks in permuted order, with places and words summed up.

    Places are summed within short runs of the line first and then over the runs, so no task sorts a whole source.
    """
    count = blocks.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / RUN_BLOCKS).alias("_runs"))
    laid = (blocks.join(count, "s").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
            .withColumn("_key", unit(F.lit(seed), "s", "turn", "block")).withColumn("_run", F.floor(F.col("_key") * F.col("_runs"))))
    run = ["s", "turn", "_run"]
    inside = Window.partitionBy(*run).orderBy("_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("turn", "_run").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = laid.groupBy(*run).agg(F.sum("words").alias("_words"), F.count(F.lit(1)).alias("_n"))
    starts = sums.select(*run, F.coalesce(F.sum("_words").over(earlier), none).alias("_words"), F.coalesce(F.sum("_n").over(earlier), none).alias("_n"))
    return (laid.join(starts, run)
            .select("s", "block", "turn", "words", (F.col("_n") + F.count(F.lit(1)).over(inside)).alias("rank"),
                    (F.col("_words") + F.coalesce(F.sum("words").over(inside), none)).alias("before")))


def drawn(table: DataFrame, sources: DataFrame, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """The draws of every source: blocks of its line that begin before the target, with the words ``given`` by each."""
    goal = sources.select("s", F.round("target").cast("long").alias("_goal"))
    blocks = table.groupBy("s", "block").agg(F.sum("size").alias("words"))
    return (line(blocks, sources, most, seed).join(goal, "s").where(F.col("before") < F.col("_goal"))
            .select("s", "block", "turn", "words", "rank", F.least("words", F.col("_goal") - F.col("before")).alias("given")))


# ---------------------------------------------------------------- splitting tree

def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``marked``, by inverting the distribution at ``u``.

    The distribution is followed through its recurrence from twelve deviations below the mean to as many above; what
    lies beyond is less than a double's rounding. So the steps grow with the deviation, not with the counts.
    """
    count = F.greatest(total, F.lit(1)).cast("double")
    mean = draws * (marked / count)
    spread = F.sqrt(F.greatest(mean * (1 - marked / count) * (total - draws) / F.greatest(count - 1, F.lit(1.0)), F.lit(0.0)))
    first = F.greatest(F.lit(0).cast("long"), draws - (total - marked), F.floor(mean - 12 * spread - 12))
    last = F.least(marked, draws, F.ceil(mean + 12 * spread + 12))

    def next_weight(w: Column, x: Column) -> Column:
        up = (marked - x).cast("double") * (draws - x).cast("double")
        down = (x + 1).cast("double") * (total - marked - draws + x + 1).cast("double")
        return w * up / F.greatest(down, F.lit(1.0))

    def pick(steps: Column) -> Column:
        whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
                            lambda a, x: F.struct(next_weight(a["w"], x).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
        return let(whole * u, lambda aim: F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.element_at(steps, 1).alias("x")),
            lambda a, x: F.struct(next_weight(a["w"], x).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when(a["sum"] < aim, x).otherwise(a["x"]).alias("x")),
            lambda a: a["x"]))

    return let(F.sequence(first, last), pick)


def split(nodes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``parent, ids, quotas, capacity`` rows -> ``id, shard, n``: the quotas of a row's members dealt to the shards.

    ``capacity`` says how many blocks of the row each shard takes. Each level halves the runs of shards.
    """
    none = F.lit(0).cast("long")

    def total(values: Column) -> Column:
        return F.aggregate(values, none, lambda a, x: a + x)

    now = nodes.withColumn("low", F.lit(0)).withColumn("width", F.lit(shards))
    for _ in range(math.ceil(math.log2(shards))):
        half = F.floor(F.col("width") / 2).cast("int")
        start = F.struct(total(F.col("quotas")).alias("rest"), total(F.slice("capacity", F.col("low") + 1, half)).alias("left"),
                         F.array().cast("array<bigint>").alias("got"))

        def take(a: Column, i: Column) -> Column:
            quota = F.get(F.col("quotas"), i)
            x = hypergeometric(a["rest"], quota, a["left"], unit(F.lit(seed), "parent", "low", "width", i))
            return let(x, lambda x: F.struct((a["rest"] - quota).alias("rest"), (a["left"] - x).alias("left"), F.concat(a["got"], F.array(x)).alias("got")))

        members = F.sequence(F.lit(0), F.size("quotas") - 1)
        sides = F.when(F.col("width") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2)))
        now = (now.withColumn("half", half).withColumn("got", F.when(F.col("width") > 1, F.aggregate(members, start, take, lambda a: a["got"])))
               .withColumn("side", F.explode(sides))
               .select("parent", "ids", "capacity",
                       F.when(F.col("side") == 0, F.col("got")).when(F.col("side") == 1, F.zip_with("quotas", "got", lambda q, x: q - x)).otherwise(F.col("quotas")).alias("quotas"),
                       F.when(F.col("side") == 1, F.col("low") + F.col("half")).otherwise(F.col("low")).alias("low"),
                       F.when(F.col("side") == 0, F.col("half")).when(F.col("side") == 1, F.col("width") - F.col("half")).otherwise(F.col("width")).alias("width")))
    each = now.select("low", F.explode(F.arrays_zip("ids", "quotas")).alias("m"))
    return each.select(F.col("m.ids").alias("id"), F.col("low").alias("shard"), F.col("m.quotas").alias("n"))


def allotted(draws: DataFrame, shards: int, seed: int = 0, members: int = MEMBERS) -> DataFrame:
    """``s, stops``: up to which rank of its line a source's draws go to shards 0, 1, 2, …

    Quotas are split among groups of sources first, then among the sources of each group, so a row of the tree never
    holds more than ``members`` of them.
    """
    spark = draws.sparkSession
    quotas = written(spark, draws.groupBy("s").agg(F.count(F.lit(1)).alias("quota")), "quotas")
    total, highest = quotas.agg(F.sum("quota"), F.max("s")).first()
    total, depth = total or 0, 1
    while (highest or 0) >= members ** depth:
        depth += 1
    each = [total // shards + (r < total % shards) for r in range(shards)]
    capacity = None
    for level in range(depth - 1, -1, -1):
        inside = quotas.groupBy(F.floor(F.col("s") / members ** level).alias("id")).agg(F.sum("quota").alias("quota"))
        rows = (inside.groupBy(F.floor(F.col("id") / members).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("id", "quota"))).alias("list"))
                .select("parent", F.col("list.id").alias("ids"), F.col("list.quota").alias("quotas")))
        rows = rows.withColumn("capacity", F.lit(each).cast("array<bigint>")) if capacity is None else rows.join(capacity, "parent")
        dealt = written(spark, split(rows, shards, seed + level), "quotas-split")
        capacity = (dealt.groupBy(F.col("id").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("list"))
                    .select("parent", F.col("list.n").alias("capacity")))
    stops = F.transform("capacity", lambda _, i: F.aggregate(F.slice("capacity", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return capacity.select(F.col("parent").alias("s"), stops.alias("stops"))


# ---------------------------------------------------------------- the mix

def dealt(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES,
          block_words: int = BLOCK_WORDS, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: its source's sums and ``draws``, an array of ``turn, shard, words`` taken from it."""
    spark = docs.sparkSession
    rows = written(spark, sized(docs, id_column, text_column, source_column), "sized")
    sources = written(spark, targets(rows, weights, share, most), "targets")
    table = written(spark, placed(rows, sources, block_words), "placed")
    draws = written(spark, drawn(table, sources, most, seed), "draws")
    stops = allotted(draws, shards, seed)
    shard = F.size(F.filter("stops", lambda x: x <= F.col("rank")))
    given = (draws.join(stops, "s").select("s", "block", F.struct("turn", shard.alias("shard"), "words", "given").alias("draw"))
             .groupBy("s", "block").agg(F.sort_array(F.collect_list("draw")).alias("_given")))
    inside = Window.partitionBy("s", "block").orderBy(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy"), "doc_id", "text_hash", "copy")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    def cut(d: Column) -> Column:
        part = F.when(d["given"] == d["words"], F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least("size", d["given"] - F.col("_before"))))
        return F.struct(d["turn"].alias("turn"), d["shard"].alias("shard"), part.alias("words"))

    nothing = F.array().cast("array<struct<turn:int,shard:int,words:bigint>>")
    return (table.join(given, ["s", "block"], "left").withColumn("_before", before)
            .withColumn("draws", F.coalesce(F.transform("_given", cut), nothing))
            .join(sources.select("s", "source", "source_size", "target"), "s")
            .select("doc_id", "source", "size", "source_size", "target", "text_hash", "copy", "draws"))


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES,
        block_words: int = BLOCK_WORDS, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: its words, its source's words and target, the words the mix takes, and the shards they go to.

    A source's taken words add up to its rounded target; for that at most one document of each source
    gives only its first words in one pass, all others are taken whole, ``most`` times at most. Null and empty texts have
    no words and are taken with none. A null source is a source, the last one. Repeated rows, and repeated or null ids, are
    documents of their own. No rows, no result.
    """
    rows = dealt(docs, shards, weights, share, most, block_words, seed, id_column, text_column, source_column)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    some = F.filter("draws", lambda d: (d["words"] > 0) | (F.col("size") == 0))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.sort_array(some["shard"]).alias("shards"))


def mixed_texts(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES,
                block_words: int = BLOCK_WORDS, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix itself: ``shard, place, doc_id, source, turn, words, text`` of every draw with words, to be written sorted by shard and place.

    ``place`` is a hash, and sorting by it is the shuffle inside the shard. A cut document's words are joined by one blank.
    """
    rows = dealt(docs, shards, weights, share, most, block_words, seed, id_column, text_column, source_column)
    each = rows.withColumn("d", F.explode("draws")).where(F.col("d.words") > 0)
    texts = (id_and_text(docs, id_column, text_column).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["doc_id", "text_hash"])
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "text"))
    whole = F.col("d.words") == F.col("size")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("d.words").cast("int"))
    place = F.xxhash64(F.lit(seed), "d.shard", "d.turn", "doc_id", "text_hash", "copy")
    return (each.join(texts, same(F.col("doc_id"), F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
            .select("d.shard", place.alias("place"), "doc_id", "source", "d.turn", "d.words", F.when(whole, F.col("text")).otherwise(F.array_join(words, " ")).alias("text")))


def write_mix(mixed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in shuffled order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "place").drop("place").write.partitionBy("shard").parquet(path)
