"""Readers and writers of the file formats in use."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.sources import contracts
from loamwork.sources.schemas import LABELLED_ITEM, PATH_RECORD

BYTE_ORDER_MARK = "\ufeff"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped, a line that is no object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and possibly a byte order mark; all strings without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_shape(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of rows and names of the fields, without a byte order mark."""
    df = read_csv(spark, path)
    return df.count(), [c.removeprefix(BYTE_ORDER_MARK) for c in df.columns]


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, bytes) of the members of all archives at a path; an archive is read whole."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                members = zipfile.ZipFile(io.BytesIO(content)).infolist()
                yield pa.record_batch([pa.array([name] * len(members), pa.string()), pa.array([m.filename for m in members], pa.string()), pa.array([m.file_size for m in members], pa.int64())], names=["path", "member", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(listed, "path string, member string, bytes long")


def structures(spark: SparkSession, path: str) -> DataFrame:
    """(path, records, damaged) of all ``.jsonl`` and ``.json`` files below a folder.

    A record is a line that is not blank, or a whole ``.json`` file; it is damaged if it is no JSON, or a line no object.
    """
    read = lambda glob, whole: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    sound = F.try_parse_json("value").isNotNull()
    lines = read("*.jsonl", False).where("value <> ''").select("path", (sound & F.col("value").startswith("{")).alias("sound"))
    return lines.unionByName(read("*.json", True).select("path", sound.alias("sound"))).groupBy("path").agg(F.count("*").alias("records"), F.count_if(~F.col("sound")).alias("damaged"))


def run_manifest(spark: SparkSession, tables: Mapping[str, DataFrame], hashes: DataFrame, seeds: Mapping[str, int]) -> DataFrame:
    """One row: rows of each named table, SHA-256 by path of the files of a ``manifest``, and seeds by name."""
    counts = {name: df.count() for name, df in sorted(tables.items())}
    fixed = spark.createDataFrame([(counts, dict(sorted(seeds.items())))], "rows map<string,long>, seeds map<string,long>")
    by_path = hashes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "sha256")))).alias("sha256"))
    return fixed.join(F.broadcast(by_path), F.lit(True))


def read_labelled_items(spark: SparkSession, path: str, split: str) -> DataFrame:
    contracts.labelled_split(split)
    return contracts.holds(read_jsonl(spark, path, LABELLED_ITEM), F.col("label").isNotNull(), "label is required")


def read_path_records(spark: SparkSession, path: str) -> DataFrame:
    return contracts.label_free(read_jsonl(spark, path, PATH_RECORD))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every text file below a folder."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """(characters, tags) of blank-line separated records of ``character<TAB>tag`` lines."""
    rows = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    return rows.select(F.transform(lines, lambda x: F.split(x, "\t")[0]).alias("characters"), F.transform(lines, lambda x: F.split(x, "\t")[1]).alias("tags"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, sha256_text) of all files below a folder; the last is of the text with LF line ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    unix = F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n"))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha2(unix, 256).alias("sha256_text"))


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files whose hash is missing or differs: (path, expected, actual)."""
    e, a = expected.select("path", F.col("sha256").alias("expected")), actual.select("path", F.col("sha256").alias("actual"))
    return e.join(a, "path", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of lines ``hash  path``."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 1).alias("sha256"), F.regexp_extract("value", r"^(\S+)\s+(.*)$", 2).alias("path"))


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("error").option("compression", compression).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], mark: bool = False) -> None:
    """Only ``fields``, in their order, with a header, before which ``mark`` puts a byte order mark."""
    out = df.select(*fields)
    if mark:
        out = out.withColumnRenamed(fields[0], BYTE_ORDER_MARK + fields[0])
    out.write.mode("error").option("header", True).option("escape", '"').csv(path)


def write_bio(tags: DataFrame, path: str, text_col: str = "text") -> None:
    """A ``character<TAB>tag`` line a character, line breaks as spaces, and a blank line after each record."""
    chars = F.transform(F.array_remove(F.split(text_col, ""), ""), lambda c: F.when(c.isin("\n", "\r"), " ").otherwise(c))
    lines = F.array_join(F.zip_with(chars, "tags", lambda c, t: F.concat_ws("\t", c, t)), "\n")
    tags.select(F.concat(lines, F.lit("\n")).alias("value")).write.mode("error").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A markdown table of a small result; a larger one is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
