"""JSON lines with file, line number and byte offset."""

from __future__ import annotations

import json

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import line_source

# The process that plans a source need not find this package.
cloudpickle.register_pickle_by_value(line_source)


#: Stores that the line source opens by itself; files in others are read whole, a task each.
SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfss")


def _source(spark: SparkSession, paths: list[str]) -> dict[str, str] | None:
    """Options of the line source for these paths, or None if it can't open them."""
    whole = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.globStatus(at) or []] if any(c in p for c in "*?[{") else [at]
        if not found:
            raise FileNotFoundError(p)
        for x in found:
            uri = fs.makeQualified(x).toUri()
            if uri.getScheme() not in SCHEMES:
                return None
            whole.append(f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}")
    spark.dataSource.register(line_source.LineSource)
    return {"paths": json.dumps(whole)}


def scan(spark: SparkSession, path: str | list[str], split: int | None = None, since: dict[str, int] | None = None) -> DataFrame:
    """file, split, nth, offset, ended, line of text files, by ranges of `split` bytes, from the byte in `since` on where it names the file. Blank lines are rows too."""
    options = _source(spark, [path] if isinstance(path, str) else path)
    if options is None:
        if since:
            raise ValueError(f"{path} can only be read whole")
        return _whole(spark, path)
    if split:
        options["split"] = str(split)
    return spark.read.format("recall_lines").options(**options, since=json.dumps(since or {})).load()


def follow(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """The same as a stream, of whole lines; each micro-batch has what the files have grown by."""
    options = _source(spark, [path])
    if options is None:
        raise ValueError(f"{path} can't be followed")
    return spark.readStream.format("recall_lines").options(**options, **({"split": str(split)} if split else {})).load()


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    each = whole.select("file", F.endswith("value", F.lit("\n")).alias("closed"), F.size(F.split("value", "\n")).alias("n"), F.posexplode(F.split("value", "\n")).alias("nth", "line"))
    size = F.octet_length("line").cast("long") + 1
    before = F.coalesce(F.sum(size).over(Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("nth") == F.col("n") - 1
    return each.withColumn("offset", before).where(~last | (F.length("line") > 0)).select("file", F.lit(0).cast("long").alias("split"), F.col("nth").cast("long").alias("nth"), "offset", (~last).alias("ended"), "line")


def read_lines(spark: SparkSession, path: str | list[str], split: int | None = None, numbers: bool = False) -> DataFrame:
    """file, split, line_no, offset, line of text files in ranges, which split has the starts of. Blank lines go; a last line without newline stays.

    line_no puts the lines of a file in order: it is the offset, or with numbers the line's number from 0, for which the lines of each range are counted first.
    """
    found = scan(spark, path, split)
    if not numbers:
        return found.where(F.trim("line") != "").select("file", "split", F.col("offset").alias("line_no"), "offset", "line")
    counts = found.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    first = counts.select("file", "split", before.alias("first"))
    return found.join(first, ["file", "split"]).where(F.trim("line") != "").select("file", "split", (F.col("first") + F.col("nth")).alias("line_no"), "offset", "line")


def parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """lines with the fields of the schema and `problem`: invalid JSON, not an object, unknown record version/type, or null."""
    kind = F.trim("line").startswith("{")
    valid = F.expr("try_parse_json(line)").isNotNull()
    d = lines.withColumn("r", F.when(valid & kind, F.from_json("line", schema)))
    known = ((F.col("r.v") == 1) & (F.col("r.type") == "chunk")) | ((F.col("r.v") == 2) & F.col("r.type").isin("tx_begin", "tx_commit", "session_reset", "turn_checkpoint"))
    problem = F.when(~valid, "invalid JSON").when(~kind, "record is not an object").when(~F.coalesce(known, F.lit(False)), "unknown record version/type")
    return d.select(*[c for c in ("file", "split", "line_no", "offset", "ended", "line") if c in lines.columns], "r.*", problem.alias("problem"))


def list_files(spark: SparkSession, path: str, from_month: str | None = None) -> DataFrame:
    """Sorted files below path that end in .jsonl or are parts of a log; with a month, those whose path has it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.jsonl,part-*.txt}").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    if from_month is not None:
        files = files.where(F.contains("path", F.lit(from_month)))
    return files.orderBy("path")
