"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source queues its documents in a shuffled order, ``most`` times over. A document's virtual finish time is the
number of words of its source up to and with it, divided by the source's target. All sources together are sorted by
finish time: each is served at its own constant rate, so every stretch of the mix has the target proportions. The
targets add up to the budget, which is therefore spent at time 1; documents that are in service then are cut to the
words served so far, and what would begin later is not taken.

Nothing is gathered by source. The shuffled order is the order of a hash, so a source's queue is cut into ranges of
that hash with about ``RANGE_ROWS`` documents each; sums of the ranges give every range its start. The same is done
with virtual time: as all sources flow at constant rates, equal steps of time hold equal numbers of words, so the
global sort needs no sampled bounds. Rows that are equal in source, id and size are counted before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalytics.llm.common import materialize, prepare

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60                  # of the hash that shuffles a queue
RANGE_ROWS = 10_000           # documents in a range of a queue or of virtual time, on the average
CHUNK = 4096                   # equal rows that are written out together


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: Column, size: Column, seed: int) -> Column:
    """The place of a document in its queue: ``KEY_BITS`` bits of an md5 digest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(queue: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(src, place, source_size, budget, target, n_entries): one row per source.

    ``share`` of all words is dealt out by weight; a source stops at ``most`` times its size and what it leaves is
    dealt out again. With the sources in the order in which a rising level fills them (limit over weight), a source
    is full if the level that the rest would share, were it not full, is not below its limit.
    """
    own = queue.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                   F.count(F.lit(1)).alias("n_entries"))
    by_name = Window.orderBy(F.col("src") == "", "src")              # the key of a null source is empty
    listed = (
        own.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()).cast("double") * share[0] / share[1])
        .withColumn("limit", (F.col("source_size") * most).cast("double")))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    return (
        listed.withColumn("left", left).withColumn("rest", F.sum("weight").over(rest).cast("double"))
        .withColumn("level", F.when(F.col("limit") * F.col("rest") > F.col("left") * F.col("weight"), F.col("left") / F.col("rest")))
        .withColumn("common", F.first("level", ignorenulls=True).over(whole))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.col("weight") * F.col("common")))
        .select("src", "place", "source_size", "budget", "target", "n_entries"))


def _started(rows: DataFrame, group: list[str], order: list[str], words: str) -> DataFrame:
    """Adds ``start``: the words before a row of its range, given the ranges in the columns ``group`` (the last one
    counts up within the others)."""
    sums = rows.groupBy(*group).agg(F.sum(words).alias("_sum"))
    upto = Window.partitionBy(*group[:-1]).orderBy(group[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(starts, group)
            .withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside"))


def fair_queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2,
               seed: int = 0) -> DataFrame:
    """(id, source, size, copies, source_size, target, turn, finish, position, words): what the mix takes, by turn.

    A row stands for ``copies`` equal rows of ``docs``; ``turn`` 0 .. most - 1 is the pass over the source, ``finish``
    the virtual finish time (at most 1), ``position`` the number of words of the mix before it and ``words`` the words
    taken of all copies in this turn. Sorted by position it is the mix. A document of which nothing is taken has one
    row, with turn 0, words 0 and no finish or position.
    """
    spark = prepare(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
                        word_count(F.col(text_col)).alias("size"))
    queue = materialize(
        sized.withColumn("key", shuffle_key(F.col("id"), F.col("size"), seed))
        .groupBy("src", "source", "id", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "mix-queue")
    sources = materialize(source_targets(queue, weights, share, most), "mix-sources")

    ranges = F.greatest(F.ceil(F.log2(F.col("n_entries") / F.lit(RANGE_ROWS))), F.lit(0)).cast("int")
    queued = (
        queue.join(sources, "src").withColumn("all", F.col("size") * F.col("copies"))
        .withColumn("part", F.floor(F.col("key") / F.pow(F.lit(2.0), F.lit(KEY_BITS) - ranges)).cast("long")))
    placed = _started(queued, ["src", "part"], ["key", "id", "size"], "all").withColumnRenamed("start", "queued")
    at = F.col("queued") + F.col("turn") * F.col("source_size")
    served = F.greatest(F.lit(0), F.least(F.col("all"), F.floor("target").cast("long") - at))
    turns = (
        placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("words", served).where((F.col("words") > 0) | (F.col("turn") == 0))
        .withColumn("finish", F.when(F.col("words") > 0, F.least(F.lit(1.0), (at + F.col("all")) / F.col("target")))
                    .otherwise(F.lit(1.0))))
    turns = materialize(turns.select("id", "source", "place", "key", "size", "copies", "source_size", "budget", "target",
                                     "turn", "finish", "words"), "mix-turns")
    steps = max(1, -(-queue.count() * most // RANGE_ROWS))
    mixed = F.col("words") > 0                             # what is not taken adds no words: it is only spread out
    timed = turns.withColumn("all_time", F.lit(0)).withColumn("step", F.when(
        mixed, F.least(F.floor(F.col("finish") * steps), F.lit(steps - 1))).otherwise(F.col("key") % steps).cast("long"))
    found = _started(timed, ["all_time", "step"], ["finish", "place", "key", "id", "size", "turn"], "words")
    kept = F.greatest(F.lit(0), F.least(F.col("words"), F.floor("budget").cast("long") - F.col("start")))
    return found.select("id", "source", "size", "copies", "source_size", "target", "turn", F.when(mixed, F.col("finish")).alias("finish"),
                        F.when(mixed, F.col("start")).alias("position"), kept.alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, taken, finishes): one row per row of ``docs``.

    ``size`` is the number of words, ``target`` the words that the mix is to take of the source, ``taken`` those that
    it takes of this document over all turns (at most ``most`` times its size), ``finishes`` its virtual finish times.

    * A null or empty text has size 0 and nothing taken of it. A null source is a source of its own, the last.
    * A null id is an id. Rows equal in source, id and size share alike: what is served of them is divided by their
      number, rounded down. Ties of the shuffled order go to the smaller id, then the smaller size.
    * Very long texts count with all their words; a document is cut only where the budget ends. A source's taken words
      are its target, rounded down, less what that division leaves. The table of sources has one row per source and
      is ordered in one task. Other columns are not read. An empty table gives an empty result.
    * The result depends on the rows and ``seed`` only, not on partitions: reruns agree.
    """
    turns = fair_queue(docs, id_col, text_col, source_col, weights, share, most, seed)
    whole = turns.groupBy("source", "id", "size", "copies", "source_size", "target").agg(
        F.sum(F.expr("words div copies")).alias("taken"),
        F.array_sort(F.collect_list(F.when(F.col("words") > 0, F.col("finish")))).alias("finishes"))     # at most ``most``
    chunks = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK))))
    many = F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).cast("int")
    return (
        chunks.repartition("source", "id", "size", "chunk")             # many equal rows are written by many tasks
        .withColumn("copy", F.explode(F.sequence(F.lit(1), many)))
        .select("id", "source", "size", "source_size", "target", "taken", "finishes"))
