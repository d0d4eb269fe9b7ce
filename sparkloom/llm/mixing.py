"""Mixing sources to target weights by a curriculum whose weights vary with training time.

Each source gets a share of the training words (water-filling below a cap of `most_repeats` times its size) and a weight
schedule over training time 0..1, linear between two ends. The schedule's integral is the cumulative demand for the
source's words; a document's offset in its source's fixed pseudo-random order is inverted through it and gives the
training position at which the document is read, once for each pass over the source. The mix is the documents ordered by
position, dealt out by ranges of it.

Offsets are running sums over a whole source. They are taken in two steps, within one of `buckets` hash ranges of a
source and over the ranges' totals, so a source that holds a third of all rows is summed by thousands of tasks.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are taken
for 0 words; repeated rows are separate documents of the mix; no documents give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, lookup, n_words, text_or_empty

#: Weights by rank of the source, repeating, and the slope of each one's schedule: -1 fades out, 1 fades in.
WEIGHTS = (3, 1, 2)
SLOPES = (0.5, -0.5, 0.0)


#: What `curriculum` returns beside the identifier and what it carries.
COLUMNS = ("source", "size", "source_size", "target", "positions", "key", "name", "bucket")


def ranked(sizes: DataFrame) -> DataFrame:
    """A row a source with its rank by name, from 0. Names are dealt out by ranges and numbered within these; only the ranges'
    totals, one row a partition, meet in one task."""
    dealt = cut(sizes.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "ranges")
    begun = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("begin", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return dealt.withColumn("rank", within).join(F.broadcast(begun), "part").withColumn("rank", F.col("begin") + F.col("rank")).drop("part", "n", "begin")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """Targets in words: name, source_size, rank, target. sizes: a row a source (name, source_size).

    A source's target is weight times one level, or its cap if that is less; the level spends the whole share. It is raised
    until no further source is above its cap: each round is one aggregate over the sources, of which one row returns.
    """
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    s = cut(ranked(sizes).withColumns({"weight": weight, "cap": F.col("source_size") * most_repeats}), "sources")
    level, full = 0.0, -1
    while True:
        above = F.lit(full >= 0) & (F.col("cap") <= F.lit(level) * F.col("weight"))
        n, spent, open_, total = s.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if not open_ or n == full:
            break
        level, full = (total * share - spent) / open_, n
    return s.select("name", "source_size", "rank", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target") if open_ else F.col("cap").cast("double").alias("target"))


def position_of(offset: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source has been read up to offset: the inverse of target * (t + slope * (t * t - t)).

    The weight at time t is target * (1 + slope * (2 t - 1)). Null beyond the target, where the source isn't read.
    """
    x = offset / target
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + F.lit(4.0) * slope * x)
    # 2 x / (b + root) is the stable form of the quadratic's root, and right for slope 0.
    return F.when((target > 0) & (offset <= target), F.lit(2.0) * x / (b + root))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, share: float = 1.5, most_repeats: int = 2, buckets: int = 4096, seed: int = 17, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row a document: id_col, source, size, source_size, target, positions (one for each time it is read, ascending), key,
    and narrow columns to carry along.

    A pass reads a document whole if the middle of its words lies within the target, so a source's words differ from its
    target by at most half a document.
    """
    text = text_or_empty(text_col)
    key = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text), F.lit(seed))
    # Never null, and in order of code points with null last.
    name = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"), name.alias("name"), n_words(text).alias("size"), key.alias("key"), *[c.alias(k) for k, c in (carry or {}).items()])
    # The upper bits of the key, so that a bucket is a range of keys.
    rows = cut(rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - (buckets - 1).bit_length()).cast("int")), "sizes")
    filled = cut(rows.groupBy("name", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sizes = filled.groupBy("name").agg(F.sum("bucket_size").alias("source_size"))
    slope = F.get(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") % len(slopes)).cast("int"))
    targets = source_targets(sizes, weights=weights, share=share, most_repeats=most_repeats).withColumn("slope", slope)
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = filled.withColumn("begin", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    begun = lookup(begun, targets, ["name"]).drop("bucket_size", "rank")
    placed = rows.join(begun, ["name", "bucket"])
    within = Window.partitionBy("name", "bucket").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("begin") + F.sum("size").over(within) - F.col("size") / 2
    placed = placed.withColumn("middle", middle)
    each = F.array(*[position_of(F.col("middle") + k * F.col("source_size"), F.col("target"), F.col("slope")) for k in range(most_repeats)])
    return placed.select(id_col, "source", "size", "source_size", "target", F.filter(each, lambda p: p.isNotNull()).alias("positions"), "key", *(carry or {}))


def by_position(mix: DataFrame) -> DataFrame:
    """The documents by the first position at which each is read, dealt out by ranges of it; those that aren't read come last."""
    return mix.withColumn("first_position", F.get("positions", F.lit(0))).orderBy(F.col("first_position").asc_nulls_last(), "key")


def in_order(mix: DataFrame) -> DataFrame:
    """The mix: a row for each time a document is read, by training position, dealt out by ranges of it."""
    return mix.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "key")
