"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.plans.storage import materialize

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Kronecker sequence on a ring of 2^31 points: multiplier 2^31 / golden ratio, odd.
RING, GOLDEN = 1 << 31, 1_327_217_885
#: Shares of a source's shuffled order; its hot rows are summed share by share.
HEX = 3
#: Slots in one ranking task.
CHUNK = 8192


def measure(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, size): the words of each whole text; null text has 0."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: (src, source, source_size, target, words).

    Sources by code point, null last, get the weights in turn. A source whose part
    would be above ``most`` times its size is held there and the excess goes to the
    others by weight. In ascending order of capacity by weight the held ones come
    first, so that one pass of running sums finds the level.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    rows = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("src", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("w", weight)
        .withColumn("room", most * F.col("source_size"))
    )
    order = W.orderBy(F.col("room") / F.col("w"), "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("w").over(after)
    held = F.col("level") >= F.col("room") / F.col("w")
    rows = rows.withColumn("level", level).withColumn("held", held)
    common = F.min(F.when(~F.col("held"), F.struct((F.col("room") / F.col("w")).alias("r"), "src", "level"))).over(everything)["level"]
    target = F.when(F.col("held"), F.col("room")).otherwise(F.col("w") * common)
    return rows.select("src", "source", "source_size", F.least(target, "room").alias("target")).withColumn(
        "words", F.floor("target").cast("long")
    )


def positions(sized: DataFrame, sources: DataFrame, seed: int = 17) -> DataFrame:
    """sized with src and ``start``, the words before it in its source's shuffled order.

    The order is by md5 of the id. A source is summed in 16^HEX shares of its order,
    then the shares, so that no task holds a whole source.
    """
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))))
    rows = rows.withColumn("part", F.substring("key", 1, HEX))
    total = rows.groupBy("src", "part").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("src", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    own = W.partitionBy("src", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("nth", F.row_number().over(own)).withColumn(
        "start", F.coalesce(F.sum("size").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    return rows.join(total, ["src", "part"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def schedule(sources: DataFrame, block: int, total: int, cells: int = 1024) -> DataFrame:
    """(src, block, slot): in which slot each block of ``block`` words of a source comes.

    Point n of the golden-ratio sequence falls into one source's part of the
    cumulative weights; the slots of a source, ranked, take its blocks in turn until
    its words are reached. Sources short of their last few blocks (the sequence
    comes within O(log n) of each share) get them at the end.
    """
    spark = sources.sparkSession
    quota = F.ceil(F.col("words") / F.lit(block)).cast("long")
    parts = sources.where("words > 0").select("src", quota.alias("quota"))
    running = W.orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("hi", F.sum("quota").over(running)).withColumn("lo", F.col("hi") - F.col("quota"))
    # Each part goes to the cells of [0, 1) that it meets: a slot meets one cell's parts only.
    cell_of = lambda c: F.floor(c * cells / F.lit(max(1, total))).cast("long")
    parts = parts.withColumn("cell", F.explode(F.sequence(cell_of(F.col("lo")), cell_of(F.col("hi") - 1))))
    slots = spark.range(total).withColumn("at", F.floor((F.col("id") % RING) * GOLDEN % RING * total / F.lit(RING)).cast("long"))
    slots = slots.withColumn("cell", cell_of(F.col("at")))
    met = slots.join(parts, "cell").where("at >= lo and at < hi")
    met = met.select("src", "quota", "id", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = met.groupBy("src", "quota", "chunk").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    ranked = met.withColumn("nth", F.row_number().over(W.partitionBy("src", "chunk").orderBy("id")))
    ranked = ranked.join(counts.select("src", "chunk", "base"), ["src", "chunk"])
    ranked = ranked.select("src", (F.col("base") + F.col("nth") - 1).alias("block"), F.col("id").alias("slot"), "quota")
    got = counts.groupBy("src").agg(F.sum("n").alias("n"))
    late = sources.where("words > 0").select("src", quota.alias("quota")).join(got, "src", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = late.where("n < quota").select("src", F.explode(F.sequence("n", F.col("quota") - 1)).alias("block"))
    late = late.select("src", "block", (F.lit(total) + F.col("block")).alias("slot"))
    return ranked.where("block < quota").select("src", "block", "slot").unionByName(late)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, slots: int = 1 << 16, largest_block: int = 4096, **columns) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, slots): the words the mix takes of each row.

    Each source's shuffled words, gone through twice at most, are cut into equal
    blocks; the blocks that the schedule names are joined to the rows they cut. A row
    comes first in ``first_slot`` of the schedule, and in ``slots`` in each pass that
    takes some of it; both null if none does.
    Null texts and texts without words have size 0 and taken 0; a null source is a
    source, the last. Equal rows each take their own part; an empty table gives no
    rows; other columns of ``docs`` are ignored. Reruns agree.
    """
    sized = materialize(measure(docs, **columns), "mix-sizes")
    sources = materialize(targets(sized, weights, share, most), "mix-sources")
    words = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    block = max(1, min(largest_block, -(-words[0] // slots)))
    total = sources.agg(F.coalesce(F.sum(F.ceil(F.col("words") / F.lit(block))), F.lit(0))).first()[0]
    rows = positions(sized, sources, seed)
    passes = F.transform(F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1))), lambda p: F.struct(
        p.alias("pass"), (F.col("start") + p * F.col("source_size")).alias("a"),
        F.least(F.col("start") + F.col("size") + p * F.col("source_size"), F.col("words")).alias("b"),
    ))
    cut = F.flatten(F.transform(F.filter(passes, lambda x: x["a"] < x["b"]), lambda x: F.transform(
        F.sequence(F.floor(x["a"] / block), F.floor((x["b"] - 1) / block)),
        lambda k: F.struct(x["pass"].alias("pass"), k.alias("block"), (F.least(x["b"], (k + 1) * block) - F.greatest(x["a"], k * block)).alias("words")),
    )))
    keys = ["src", "part", "nth", "doc_id", "size", "source_size", "target"]
    pieces = rows.select(*keys, F.explode_outer(cut).alias("x")).select(*keys, "x.pass", "x.block", "x.words")
    taken = pieces.join(schedule(sources, block, total), ["src", "block"], "left")
    amount = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
    per_pass = F.array_compact(F.array(*[F.min(F.when(F.col("pass") == p, F.col("slot"))) for p in range(math.ceil(most))]))
    return taken.groupBy(*keys).agg(amount.alias("taken"), F.min("slot").alias("first_slot"), per_pass.alias("slots")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", F.when(F.size("slots") > 0, F.col("slots")).alias("slots")
    )


def blend(docs: DataFrame, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its taken words are to its own, rounded, in the order of the schedule.

    The copies are dealt by their slots and sorted by them, so that partition after
    partition the sources come in their shares. Only ids and slots are joined to the
    rows, up to ``broadcast_rows`` of them by a broadcast. Rows of one id share what the
    id takes; null texts and rows without words are not taken; a null id is an id. An
    empty table gives no rows; other columns stay, whatever their names.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, **options).groupBy(F.col("doc_id").alias("__id")).agg(
        F.try_divide(F.sum("taken"), F.sum("size")).alias("__times"), F.array_sort(F.flatten(F.collect_list("slots"))).alias("__slots")
    )
    taken = taken.where("__times >= 0.5").select("__id", F.slice("__slots", F.lit(1), F.floor(F.col("__times") + 0.5).cast("int")).alias("__slots"), F.floor(F.col("__times") + 0.5).cast("int").alias("__times"))
    taken = materialize(taken, "mix-taken")
    known = taken.agg(F.count("*"), F.coalesce(F.max(F.array_max("__slots")), F.lit(0))).first()
    if known[0] <= broadcast_rows:
        taken = F.broadcast(taken)
    words = F.coalesce(F.regexp_like(F.col(text_col), F.lit(WORD)), F.lit(False))
    rows = docs.where(words).join(taken, F.col(id_col).eqNullSafe(F.col("__id")))
    # A row that is taken twice in one pass (of an id of several rows) comes twice in its last slot.
    slot = F.explode(F.transform(F.sequence(F.lit(1), F.col("__times")), lambda c: F.get("__slots", F.least(c, F.size("__slots")) - 1)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__slot", slot).repartitionById(n, F.floor(F.col("__slot") * n / (known[1] + 1)).cast("int"))
    return rows.sortWithinPartitions("__slot", F.col(id_col).asc_nulls_last()).select(*[F.col(f"`{c}`") for c in docs.columns])
