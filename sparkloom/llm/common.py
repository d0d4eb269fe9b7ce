"""What the operators of this subpackage share: reading, cutting lineage, bounded lookups, small column helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, and the pattern of a run of them.
SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"

#: Bytes of a lookup table, as JSON, up to which it is broadcast: a proven bound, as the table is measured first.
BROADCAST_BYTES = 24 << 20

_roots: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (local sessions, as in tests) one of our own."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = base or "file:///tmp/checkpoints"
        _roots[app] = f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, *, compressed: bool = True) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and losing an executor loses nothing.

    Tables of hashes don't get smaller by compression, and its buffers lie outside the heap until this is collected.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    (df.write if compressed else df.write.option("compression", "uncompressed")).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: texts are long, and a batch takes room in the executor and in its Python worker.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH rows, for plans that are executed later; they are never raised, and no operator
    asks for another size but within `batches_of`."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Arrow batches of so many rows for what is executed within; the session's own setting holds again behind it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def inner(taken: list[str], *names: str) -> list[str]:
    """Column names of our own, beside which no column that is taken can stand, whatever its case."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, an empty array if it has none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body names it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column], steps: int = 24) -> Column:
    """Inclusive running folds of an array (of an associative fold), by doubling: n log n, for up to 2 ** steps values."""

    def step(k: int, xs: Column) -> Column:
        if k == steps:
            return xs
        shifted = F.transform(xs, lambda x, i: F.when(i >= 1 << k, fold(F.get(xs, i - (1 << k)), x)).otherwise(x))
        return F.when(F.size(xs) <= 1 << k, xs).otherwise(let(shifted, lambda ys: step(k + 1, ys)))

    return let(values, lambda xs: step(0, xs))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def n_bytes(table: DataFrame) -> int:
    """The bytes of a table's rows as JSON."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], salts: int = 32, how: str = "left") -> DataFrame:
    """rows joined (left or inner) to a table with one row a key (nulls match nulls).

    The table is written and measured first. Up to BROADCAST_BYTES it is broadcast; a larger one is joined by a shuffle in
    which a key of rows is dealt over `salts` tasks by a hash of the whole row, so that a hot key doesn't meet in one; rows
    are to have a column that tells them apart. The hash is of the row alone, so a task that runs again deals alike.
    """
    table = cut(table, "lookup")
    own = inner([*rows.columns, *table.columns], *[f"_k{i}" for i in range(len(keys))], "_salt", "_salt_t")
    named = table.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=False)], *[c for c in table.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, own, strict=False)]
    if n_bytes(table) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(named), on, how)
    else:
        salt, salt_t = own[-2:]
        salted = named.withColumn(salt_t, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
        joined = dealt.join(salted, [*on, F.col(salt) == F.col(salt_t)], how).drop(salt, salt_t)
    return joined.drop(*own[: len(keys)])
