"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


PIECE_BYTES = 4 << 20
#: Bits of the fixed-size map (8 MB) that tells rows apart before they are shuffled.
FILTER_BITS = 1 << 26
#: Session setting that deletes an execution's shuffle files when it ends.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and the master is local, as in tests, a local folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            folder = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; this cuts its lineage. The table goes when the session's JVM ends.

    Nothing reads the shuffles behind the table again, so their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables (and of frames that name one in ``written_at``) once everything made from them is written itself."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def col(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as the empty string."""
    return F.coalesce(col(name), F.lit(""))


def row_mark() -> Column:
    """MD5 of a row's text; with the doc_id it names the row."""
    return F.md5(text_of().cast("binary"))


def row_rank(mark: Column) -> Column:
    """Rank of a row in its group: null ids last, then by id and mark."""
    return F.struct(col("doc_id").isNull().alias("no_id"), col("doc_id").alias("id"), mark.alias("mark"))


def may_meet(df: DataFrame, key: Column, names: DataFrame) -> DataFrame:
    """``df`` with ``_may boolean``: false only where the bigint ``key`` is none of ``names`` (one bigint column).

    The names are a bit map of fixed size, sent to all tasks in pieces of 4 KB; so most rows that meet nothing in a join stay out of its
    shuffle, at any size of the two tables. What passes by chance is left to the join.
    """
    slot = F.pmod(F.col(names.columns[0]), F.lit(FILTER_BITS)) + 1
    # Names are shuffled, not the maps that each task would make of its own.
    placed = names.select(F.bitmap_bucket_number(slot).alias("_map"), F.bitmap_bit_position(slot).alias("_place")).repartition("_map")
    maps = placed.groupBy("_map").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    own = F.pmod(key, F.lit(FILTER_BITS)) + 1
    found = df.withColumn("_own", own).join(F.broadcast(maps), F.bitmap_bucket_number("_own") == F.col("_map"), "left")
    at = F.bitmap_bit_position("_own").cast("int")
    # One byte of the map as a number; Spark has no test of a single bit of a binary.
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn("_may", F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))).drop("_own", "_map", "_bits")


def keep_ranked(documents: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """``documents`` that the ranks in ``first`` (one for each group) name, each row once; of repeated ids one row, of null ids all.

    ``rows`` are the documents' ``doc_id`` and ``mark``. What goes is found among these, and only texts that may go are shuffled to meet it.
    """
    repeated = F.when(F.col("first")["no_id"], F.col("first")["mark"])
    chosen = first.groupBy(F.col("first")["id"].alias("_first"), repeated.alias("_repeated")).agg(F.min(F.col("first")["mark"]).alias("_chosen"))
    same = F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("mark") == F.col("_chosen"))
    counted = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("_n"))
    rest = write_shared(counted.join(chosen, same, "left").where("_chosen is null or _n > 1").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_of"), F.col("_chosen").isNull().alias("_goes")), "rest")
    marked = documents.withColumn("_mark", row_mark())
    marked = may_meet(marked, F.xxhash64(col("doc_id"), F.col("_mark")), rest.select(F.xxhash64("_id", "_of").alias("_name")))
    met = marked.where("_may")
    named = col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    kept = marked.where("not _may").union(met.join(rest, named, "left_anti"))
    again = rest.where("not _goes")
    if again.take(1):
        kept = kept.union(met.join(again, named, "left_semi").dropDuplicates(["doc_id", "_mark"]))
    return kept.drop("_mark", "_may")


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def bounded_sample(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` distinct keys, chosen by a hash of the key (all rows when fewer).

    ``df`` must hold one row for each key. The bound is what lets the result be broadcast.
    """
    total = df.count()
    if total <= max_rows:
        return df
    keep = int(max_rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(col(key)), F.lit(1 << 30)) < keep)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few megabytes, which bounds what a worker holds in Python objects; a longer row comes alone."""
    for batch in batches:
        step = max(1, int(batch.num_rows * PIECE_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def text_batches(batches: Iterator[pa.RecordBatch], name: str | None = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each piece of the Arrow batches with its texts as Python strings (none without a name); null counts as empty."""
    for batch in pieces(batches):
        yield batch, [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()] if name else []


def add_columns(df: DataFrame, added: str, make: Callable[[pa.RecordBatch, list[str]], list[pa.Array]], text: str | None = "text") -> DataFrame:
    """``df`` with computed columns appended by one Arrow pass; a column of the same name is replaced."""
    fields = StructType.fromDDL(added)
    names = fields.names
    own = [c for c in df.columns if c not in names]
    # Numbered names on the way through: mapInArrow reads a dot in a name as a field of a struct.
    numbered = [f"_{i}" for i in range(len(own))]
    kept = df.select(*[col(c).alias(n) for c, n in zip(own, numbered)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(named(batches), text):
            out = [*batch.columns, *make(batch, texts)]
            yield pa.RecordBatch.from_arrays(out, names=[*numbered, *names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *fields.fields])).toDF(*own, *names)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last column of ``x`` is the unpenalised constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
