"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by its quality weight; a source's budget is filled with complete epochs
first, and what is left with the documents of smallest keys, up to the budget in a prefix sum. Prefix sums are taken
over coarse buckets of keys first and over the fine ones of a single coarse bucket then, so that a task never meets more than
their number, and only the one fine bucket where a source's budget ends is ever sorted. Sources are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweft.llm.common import materialize, split_by
from lumenweft.llm.native import let, words

WEIGHTS = (5, 2, 1)
#: All targets together, and the largest target of a source, in sizes.
SHARE, MOST = 1.5, 2.0
#: Buckets of keys, and how many make up a coarse one.
BUCKETS, FINE = 1 << 16, 1 << 8
#: Sources up to this count are broadcast; more are joined by a shuffle, with the same result.
BROADCAST_SOURCES = 10_000


def unit(seed: int) -> Column:
    """A number in (0, 1) fixed by seed and doc_id, or the text where there is none."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), own))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def richness(found: Column) -> Column:
    """Variety of a text's words: distinct ones over the root of twice their number, at most 4; none for no words."""
    n = F.size(found)
    return F.when(n > 0, F.least(F.size(F.array_distinct(found)) / F.sqrt(2.0 * n), F.lit(4.0))).otherwise(0.0)


def quality_weight() -> Column:
    """Texts that vary their words count for more, up to five times; the weight only orders documents within a source."""
    return 1.0 + F.col("richness")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds ``number``, the place of each source by code point, null last, from 0. Sorted in ranges, each by a task."""
    ranged = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    before, at = [], 0
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        before.append((r.range, at))
        at += r.n
    starts = ranged.sparkSession.createDataFrame(before or [(0, 0)], "range int, start long")
    place = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    return ranged.join(F.broadcast(starts), "range").withColumn("number", F.col("start") + F.row_number().over(place) - 1).drop("range", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to a table (source, source_size) of a row for each source.

    Weights repeat over the sources by code point, null last. Targets stop at ``most`` times the size; the excess goes
    to the others by weight until none is above: target = min(cap, level * weight). The level rises step by step, each step
    sharing what the sources at their cap leave over; steps are aggregates, and end when no more sources reach their cap.
    """
    table = _numbered(sizes)
    table = table.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int")))
    table = materialize(table.withColumn("cap", most * F.col("source_size")), "weights")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while True:
        at_cap = F.col("cap") < level * F.col("weight")
        n, caps, rest = table.agg(F.count_if(at_cap), F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == full or not rest:
            break
        level, full = (total - caps) / rest, n
    target = F.least("cap", F.lit(level) * F.col("weight")) if full is not None and rest else F.col("cap")
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 0, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, extra) for each row of ``docs`` (doc_id, source, text); if
    ``whole``, with the row itself as ``row``. Rows are not moved for that, but for those of the one bucket of a source where
    its budget ends.

    ``epochs`` is how often every document of the source is taken, ``extra`` whether this one is taken once more.
    ``weight`` is the quality weight over size, source and ``richness``. Null texts have size 0; null is a source of its own; ties
    in keys are broken by doc_id; rows with one doc_id draw the same key, rows without one by their text. An empty table gives
    an empty result.
    """
    weight = quality_weight() if weight is None else weight
    measured = let(words(F.col("text").cast("string")), lambda w: F.struct(F.size(w).cast("long").alias("size"), richness(w).alias("richness")))

    def draw(rows: DataFrame, *more: Column) -> DataFrame:
        read = rows.select("doc_id", F.col("source").cast("string").alias("source"), measured.alias("m"), unit(seed).alias("unit"), *more).select("*", "m.*").drop("m")
        read = read.withColumn("key", -F.log("unit") / weight).withColumn("bucket", F.floor(BUCKETS * (1.0 - F.exp(-F.col("key")))).cast("int"))
        return read.drop("unit").withColumn("at", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    drawn = materialize(draw(docs), "drawn")
    buckets = materialize(drawn.groupBy("at", "source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    table = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    table = table.withColumn("at", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    table = table.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    table = materialize(table.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).drop("source"), "targets")
    small = F.broadcast if table.count() <= BROADCAST_SOURCES else (lambda df: df)
    rests = small(table.select("at", "rest"))

    def reached(parts: DataFrame, by: str) -> DataFrame:
        """The first part, by ``by``, whose sum is over the rest, with the sum before it. Parts have at, rest, before, n."""
        sums = Window.partitionBy("at").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        over = parts.withColumn("sum", F.col("before") + F.sum("n").over(sums)).where("sum > rest")
        first = over.groupBy("at").agg(F.min(F.struct(by, (F.col("sum") - F.col("n")).alias("sum"))).alias("first"))
        return first.select("at", F.col(f"first.{by}").alias(by), F.col("first.sum").alias("before"))

    coarse = buckets.groupBy("at", F.floor(F.col("bucket") / FINE).cast("int").alias("coarse")).agg(F.sum("n").alias("n"))
    coarse = reached(coarse.join(rests, "at").withColumn("before", F.lit(0).cast("long")), "coarse")
    fine = buckets.withColumn("coarse", F.floor(F.col("bucket") / FINE).cast("int")).join(small(coarse), ["at", "coarse"]).join(rests, "at")
    # All buckets before the one that is reached are taken, within it documents up to the rest.
    ends = reached(fine, "bucket").withColumnRenamed("bucket", "end")
    table = table.join(ends, "at", "left")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(small(table), "at").withColumn("doubtful", F.coalesce(F.col("bucket") == F.col("end"), F.lit(False)))

    names = ["doc_id", "source", "size", "source_size", "target", "epochs", "extra"]
    by_bucket = (F.col("rest") > 0) & (F.col("end").isNull() | (F.col("bucket") < F.col("end")))
    order = Window.partitionBy("at").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = placed(drawn)
    edge = out.where("doubtful").withColumn("sum", F.sum("size").over(order)).withColumn("extra", (F.col("rest") > 0) & (F.col("before") + F.col("sum") - F.col("size") / 2.0 <= F.col("rest"))).drop("sum")
    if not whole:
        return out.where("not doubtful").withColumn("extra", by_bucket).unionByName(edge).select(*names)
    # Rows of one doc_id, source and key are taken alike. Only those that may be in such a bucket, by their doc_id, are moved.
    taken = edge.groupBy("at", "key", "doc_id").agg(F.max("extra").alias("extra"))
    taken = materialize(taken.select(F.col("at").alias("at_"), F.col("key").alias("key_"), F.col("doc_id").alias("doc_id_"), "doc_id", "extra"), "taken")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    clear, rest = (placed(draw(rows, row)) for rows in split_by(docs, taken.select("doc_id"), "doc_id"))
    same = (F.col("at") == F.col("at_")) & (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    rest = rest.join(taken.drop("doc_id"), same, "left").withColumn("extra", F.coalesce("extra", by_bucket))
    return clear.withColumn("extra", by_bucket).select(*names, "row").unionByName(rest.select(*names, "row"))


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of each document; see ``mix``."""
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))).alias("taken"), "source")
