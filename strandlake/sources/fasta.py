"""FASTA text as a Spark source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import drop_path, is_empty


def read_fasta(spark: SparkSession, path: str, glob: str = "*.{fasta,fa,txt}", stream: bool = False) -> DataFrame:
    """``(dataset_id, seq_index, header, sequence)`` of all files under ``path``, any number at once.

    Records begin at a line that begins with >; body lines are stripped and joined, blank ones
    skipped, records without a body dropped; body text before the first header counts as a
    record. A chunk between record starts is a row, so a file is split like any text. The dataset
    is ``file_<stem>``. As a stream, rows have no seq_index.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.option("lineSep", "\n>").option("pathGlobFilter", glob).text(path)
    chunk = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    text = F.regexp_replace("value", "\r", "")
    # only a file's very first chunk can still have its >, or no header at all
    first = (F.col("start") == 0) & F.col("value").startswith(">")
    bare = F.when(first, F.substring(text, F.lit(2), F.char_length(text))).otherwise(text)
    block = Window.partitionBy("file", "start")
    headed = first | (F.col("start") > 0) | (F.col("k") > 1) if not stream else F.lit(True)
    if not stream:
        chunk = chunk.withColumn("k", F.row_number().over(block.orderBy("at")))
    lines = F.split(bare, "\n")
    body = F.when(headed, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
    seq = F.array_join(F.transform(F.when(F.size(lines) > 1, body).otherwise(F.when(headed, F.array().cast("array<string>")).otherwise(lines)), lambda x: F.trim(x)), "")
    rows = chunk.withColumn("header", F.when(headed, F.element_at(lines, 1))).withColumn("sequence", seq).where("sequence <> ''")
    stem = F.concat(F.lit("file_"), F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1))
    if stream:
        return rows.select(stem.alias("dataset_id"), "header", "sequence")
    # numbered inside each split of a file, and shifted by the rows of the splits before it
    sizes = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = rows.withColumn("own", F.row_number().over(block.orderBy("k")) - 1).join(bases, ["file", "start"])
    return own.select(stem.alias("dataset_id"), (F.col("own") + F.col("base")).cast("int").alias("seq_index"), "header", "sequence")


def load(spark: SparkSession, name: str, base: str) -> DataFrame:
    """One dataset by absolute path, file name or stem; no sequence in it is an error."""
    path = name if "/" in name else f"{base.rstrip('/')}/{name if name.endswith('.fasta') else name + '.fasta'}"
    rows = read_fasta(spark, path, glob="*")
    if is_empty(rows):
        raise ValueError(f"no sequences in {path}")
    return rows


def write_fasta(seqs: DataFrame, path: str) -> None:
    """``>seq_<i>`` and the sequence, a folder for each dataset, rows in order inside a file."""
    text = seqs.select("dataset_id", "seq_index", F.format_string(">seq_%d\n%s", "seq_index", "sequence").alias("value"))
    text.repartition("dataset_id").sortWithinPartitions("dataset_id", "seq_index").select("dataset_id", "value").write.partitionBy("dataset_id").text(path)


def exists(spark: SparkSession, name: str, base: str) -> bool:
    """Whether there is a FASTA file of this stem (or name) under a folder; contents aren't read."""
    return not is_empty(listing(spark, base).where(F.col("name") == name.removesuffix(".fasta")))


def delete(spark: SparkSession, name: str, base: str) -> bool:
    """Delete the folder's FASTA files of this stem; says whether there was one."""
    found = [r["path"] for r in listing(spark, base, with_path=True).where(F.col("name") == name.removesuffix(".fasta")).collect()]  # files of one name
    for path in found:
        drop_path(spark, path)
    return bool(found)


def listing(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """The FASTA files under a folder: name, bytes, time; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{fasta,fa,txt}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "length", "modificationTime", *(["path"] if with_path else []))
