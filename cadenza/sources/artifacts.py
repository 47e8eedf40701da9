"""Readers and writers of artifacts: JSON documents, JSON lines, CSV, word tables, matrices and media lists."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import text as T


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document under a declared schema; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, committed at once."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, valid: Column | None = None) -> DataFrame:
    """JSON lines; those that do not parse, or break ``valid``, are dropped."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where(F.col("_corrupt").isNull()).drop("_corrupt")
    return rows if valid is None else rows.where(valid)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_rows(df: DataFrame, exported_at: str) -> DataFrame:
    """Rows as JSON lines with the export time and the number of rows in each; the number is one aggregate joined back."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("entry"), F.lit(1).alias("_k"))
    # Counting entries, not rows, names every column: a JSON reader refuses to count by its corrupt-record column alone.
    count = rows.agg(F.count("entry").alias("count"))
    return rows.join(count.withColumn("_k", F.lit(1)), "_k").select(F.lit(exported_at).alias("exportedAt"), "count", "entry")


def read_features(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A folder of JSON files keyed by ``key`` or, where it is missing, by the file's name without extension."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return rows.withColumn(key, F.coalesce(F.col(key), stem))


def list_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder with size and lower-case name tokens; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.col("length").alias("size"), F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")).alias("tokens"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted cells, doubled quotes and line breaks inside cells."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _npy_rows(content: bytes) -> np.ndarray:
    """A two-dimensional float matrix of the npy format, versions 1 to 3."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("no npy header")
    size, at = (struct.unpack_from("<H", content, 8)[0], 10) if content[6] == 1 else (struct.unpack_from("<I", content, 8)[0], 12)
    head = ast.literal_eval(content[at : at + size].decode("latin1"))
    data = np.frombuffer(content, np.dtype(head["descr"]), int(np.prod(head["shape"])), at + size)
    return data.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Matrices of a folder as rows: path, frame, embedding array<float>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                m = _npy_rows(content).astype(np.float32)
                yield pd.DataFrame({"path": name, "frame": np.arange(len(m)), "embedding": list(m)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame bigint, embedding array<float>")


def parse_probe_log(lines: DataFrame) -> DataFrame:
    """Scene changes, silences and volumes in a media tool's log lines ``(log_id, line_no, line)``: log_id, kind, value, until.

    A silence's end closes the start before it in the same log.
    """
    number = lambda p: F.regexp_extract("line", p, 1).try_cast("double")
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"start": number(r"silence_start: *(-?[0-9.]+)"), "stop": number(r"silence_end: *(-?[0-9.]+)"), "pts": number(r"pts_time:([0-9.]+)"),
                              "mean": number(r"mean_volume: *(-?[0-9.]+) dB"), "peak": number(r"max_volume: *(-?[0-9.]+) dB")})
    rows = rows.withColumn("opened", F.last("start", ignorenulls=True).over(w))
    entry = lambda kind, value, until=None: F.when(F.col(value).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(value if until is None else "opened").alias("value"), (F.col(until) if until else F.lit(None).cast("double")).alias("until")))
    found = F.array_compact(F.array(entry("scene", "pts"), entry("silence", "stop", "stop"), entry("mean_db", "mean"), entry("peak_db", "peak")))
    return rows.select("log_id", F.inline(found))


def parse_ocr_table(spark: SparkSession, path: str) -> DataFrame:
    """Words (level 5) of a tab-separated text-recognition table and their boxes."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    rows = spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return rows.where((F.col("level") == 5) & (F.trim("text") != "")).select("page_num", "block_num", "line_num", "word_num", "text", (F.col("conf") / 100).alias("confidence"),
                                                                            F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))


def union_boxes(words: DataFrame, keys: list[str], least: float = 0.5, least_words: int = 2, pad: float = 4) -> DataFrame:
    """Box around the confident words of each group, padded; null below ``least_words``."""
    sure = F.col("confidence") >= least
    enough = F.count_if(sure) >= least_words
    box = F.struct((F.min(F.when(sure, F.col("x0"))) - pad).alias("x0"), (F.min(F.when(sure, F.col("y0"))) - pad).alias("y0"), (F.max(F.when(sure, F.col("x1"))) + pad).alias("x1"), (F.max(F.when(sure, F.col("y1"))) + pad).alias("y1"))
    return words.groupBy(*keys).agg(F.when(enough, box).alias("box"))


def heard_tokens(segments: DataFrame, least: float = 0.15) -> DataFrame:
    """Recogniser segments ``(video_id, tokens array<struct<text, start, end, p>>)`` as words, without special and doubtful tokens."""
    t = segments.select("video_id", F.posexplode("tokens").alias("pos", "t")).select("video_id", "pos", "t.*")
    return t.where(~F.col("text").rlike(r"^\s*(\[.*\]|<\|.*\|>)\s*$") & (F.trim("text") != "") & (F.coalesce("p", F.lit(1.0)) >= least))


def srt(captions: DataFrame) -> DataFrame:
    """Subtitle blocks of each video, in order, as one text: video_id, srt.

    Input: video_id, start_ms, end_ms, text; a group's size is bounded by a video's captions.
    """
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "end_ms"))
    block = F.concat(n.cast("string"), F.lit("\n"), T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    blocks = captions.select("video_id", F.struct(n.alias("n"), block.alias("b")).alias("x"))
    return blocks.groupBy("video_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"])).alias("srt"))


def markdown_table(df: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table (one column, ``line``), the cells' bars escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def collect_references(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Strings found anywhere in JSON texts, in objects and lists of any depth, under the given key names: all columns but the text, then ``key`` and ``value``, each once a text.

    The texts are parsed once, as variants; every round opens the objects and lists that the one before has left, so there are as many rounds as the deepest text has levels. Texts that do not
    parse and null texts have none, and values that are no strings do not count.
    """
    own = [c for c in documents.columns if c != text]
    numbered = {f"_{i}": c for i, c in enumerate(own)}
    spark = documents.sparkSession
    level = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in numbered.items()], F.try_parse_json(F.col(f"`{text}`")).alias("_v")).where("_v is not null")
    out = None
    while True:
        opened = level.alias("t").lateralJoin(spark.tvf.variant_explode(F.col("t._v").outer())).select(*[F.col(f"t.{n}") for n in numbered], F.col("key"), F.col("value").alias("_v"))
        opened = opened.withColumn("_kind", F.schema_of_variant("_v"))
        found = opened.where(F.col("key").isin(keys) & (F.col("_kind") == "STRING")).select(*numbered, "key", F.try_variant_get("_v", "$", "string").alias("value"))
        out = found if out is None else out.unionByName(found)
        level = opened.where("_kind like 'OBJECT<%' or _kind like 'ARRAY<%'").select(*numbered, "_v")
        if not level.take(1):
            return out.distinct().toDF(*own, "key", "value")
