"""Exact dedup by content sort.

Sampled splitters (Spark's range exchange) deal the normalised texts out in order, an external sort places equal texts
side by side, and each text is compared in full with its neighbour. The sort key starts with the first characters and
the SHA-256 of the text and ends with the identifier, so splitters stay short whatever the texts' length and a text that
a third of all rows repeat spans as many partitions as it needs. Runs that meet at a partition's edge are joined by
comparing the edges of neighbouring partitions: two rows a partition, whatever the number of rows, by hash first, and in
full where hashes are equal.

Defined results: a null text counts as empty; rows equal in identifier and text are copies, of which exactly one stays;
a null identifier is smaller than any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import batches_of, cut, text_or_empty

PREFIX = 24
RUNS = "pid int, run long, id long, n long, keep long, stays boolean, sha string, first_text string, last_text string"


def _scan(smallest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of equal neighbours in a sorted partition; a run's identifiers are held until it ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, run, schema = TaskContext.get().partitionId(), 0, None
        held: list[pa.Array] = []
        held_sha, held_text = None, None
        schema = pa.schema([("pid", pa.int32()), ("run", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("keep", pa.int64()), ("stays", pa.bool_()), ("sha", pa.string()), ("first_text", pa.string()), ("last_text", pa.string())])

        def flush(ids: pa.Array, cuts: np.ndarray, shas: pa.Array, first: str | None, last: str | None) -> pa.RecordBatch:
            """Runs of ids that start at cuts; first, last: texts for the first and last row, if they lie at an edge."""
            nonlocal run
            total, sizes = len(ids), np.diff(np.append(cuts, len(ids)))
            nulls = np.add.reduceat(np.asarray(ids.is_null()).astype(np.int64), cuts)
            at = cuts + np.where(nulls < sizes, nulls, 0) if smallest else cuts + sizes - 1
            stays = np.zeros(total, bool)
            stays[at] = True
            texts = [pa.array([t if k == i else None for k in range(total)], pa.string()) if t is not None else pa.nulls(total, pa.string()) for t, i in ((first, 0), (last, total - 1))]
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(total, pid, np.int32)), pa.array(np.repeat(run + np.arange(len(cuts)), sizes)), ids, pa.array(np.repeat(sizes, sizes)), ids.take(pa.array(np.repeat(at, sizes))), pa.array(stays), shas.take(pa.array(np.repeat(np.arange(len(cuts)), sizes))), *texts],
                schema=schema,
            )
            run += len(cuts)
            return out

        first_text = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, shas = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "sha"))
            same = np.zeros(len(ids), bool)
            same[1:] = np.asarray(pc.equal(texts[1:], texts[:-1])) if len(ids) > 1 else []
            same[0] = bool(held) and texts[0].as_py() == held_text
            starts = np.flatnonzero(~same)
            if not len(starts):
                held.append(ids)
                continue
            if held:
                done = pa.concat_arrays([*held, ids[: starts[0]]])
                yield flush(done, np.array([0]), pa.array([held_sha], pa.string()), first_text, None)
                first_text = None
            else:
                first_text = texts[0].as_py()
            if len(starts) > 1:
                done, cuts = ids[starts[0] : starts[-1]], starts[:-1] - starts[0]
                yield flush(done, cuts, shas.take(pa.array(starts[:-1])), first_text, None)
                first_text = None
            held, held_sha, held_text = [ids[starts[-1] :]], shas[starts[-1]].as_py(), texts[starts[-1]].as_py()
        if held:
            yield flush(pa.concat_arrays(held), np.array([0]), pa.array([held_sha], pa.string()), first_text, held_text)

    return scan


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text).

    keep: "smallest" or "largest" identifier of equal texts stays. normalise: a Column function, identity if None.
    """
    text = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("sha", F.sha2("text", 256)).withColumn("head", F.substring("text", 1, PREFIX))
    ordered = rows.repartitionByRange("head", "sha", "id").sortWithinPartitions("head", "sha", "text", "id").select("id", "text", "sha")
    with batches_of(docs.sparkSession):
        runs = cut(ordered.mapInArrow(_scan(keep == "smallest"), RUNS), "runs")

    # Two rows a partition: its first and its last run. Neighbours are told by their hashes; texts are compared where these are equal.
    first = runs.where(F.col("first_text").isNotNull()).select("pid", F.col("sha").alias("first_sha"), F.col("n").alias("first_n"), F.col("keep").alias("first_keep"))
    last = runs.where(F.col("last_text").isNotNull()).select(F.col("pid").alias("last_pid"), F.col("sha").alias("last_sha"), F.col("run").alias("last_run"), F.col("n").alias("last_n"), F.col("keep").alias("last_keep"))
    edges = first.join(last, F.col("pid") == F.col("last_pid")).drop("last_pid")
    order = Window.orderBy("pid")
    edges = edges.withColumns({"before": F.lag("last_sha").over(order), "before_pid": F.lag("pid").over(order), "before_run": F.lag("last_run").over(order)})
    edges = cut(edges, "neighbours")
    alike = edges.where(F.col("first_sha") == F.col("before")).select("pid", "before_pid")
    ours = runs.where(F.col("first_text").isNotNull()).select("pid", "first_text")
    theirs = runs.where(F.col("last_text").isNotNull()).select(F.col("pid").alias("before_pid"), "last_text")
    same = cut(alike.join(ours, "pid").join(theirs, "before_pid").where("first_text = last_text").select("pid", F.lit(True).alias("linked")), "same")
    edges = edges.join(same, "pid", "left").withColumn("linked", F.coalesce("linked", F.lit(False))).drop("first_sha", "last_sha", "before")
    head = F.when(~F.col("linked"), F.struct(F.col("pid").alias("p"), F.lit(0).cast("long").alias("r"))).when(F.col("before_run") > 0, F.struct(F.col("before_pid").alias("p"), F.col("before_run").alias("r")))
    edges = edges.withColumn("head", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = cut(edges, "edges")
    members = edges.where("linked").select("head", F.col("pid").alias("m_pid"), F.lit(0).cast("long").alias("m_run"), F.col("first_n").alias("m_n"), F.col("first_keep").alias("m_keep"))
    heads = members.select("head").distinct().join(edges.select("pid", "last_run", "last_n", "last_keep"), F.col("head.p") == F.col("pid"))
    heads = heads.select("head", F.col("head.p").alias("m_pid"), F.col("head.r").alias("m_run"), F.col("last_n").alias("m_n"), F.col("last_keep").alias("m_keep"))
    chain = members.unionByName(heads)
    whole = Window.partitionBy("head")
    best = F.when(F.col("m_keep").isNotNull(), F.col("m_keep"))
    chain = chain.withColumns({"all_n": F.sum("m_n").over(whole), "all_keep": (F.min(best) if keep == "smallest" else F.max(best)).over(whole)})
    holder = Window.partitionBy("head").orderBy(F.col("m_keep").eqNullSafe(F.col("all_keep")).desc(), F.col("m_pid"), F.col("m_run"))
    chain = chain.withColumn("holds", F.row_number().over(holder) == 1).drop("head", "m_n", "m_keep")

    # At most two rows a partition: bounded by the number of partitions, so broadcast.
    joined = runs.join(F.broadcast(chain), (F.col("pid") == F.col("m_pid")) & (F.col("run") == F.col("m_run")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("m_pid").isNotNull(), F.col("all_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("stays") & F.coalesce("holds", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
