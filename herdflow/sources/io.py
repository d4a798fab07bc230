"""Scans and sinks: BOM-aware CSV, column-pruned typed scans, folder scans
with the source file name, JSON records with struct flattening, observation
text, Parquet/CSV sinks, sink dispatch, read-back checks and run metadata.

Paths are whatever the caller passes (on a cluster: shared storage). Spark's
CSV reader already drops a UTF-8 BOM from the first header.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from herdflow.operators.quality import ContractError
from herdflow.operators.joins import with_scalars


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             columns: Sequence[str] | None = None, raw_strings: bool = False) -> DataFrame:
    """Header CSV with an explicit schema (no inference).

    ``raw_strings`` keeps every field as text and an empty field as ``""``
    (no NULL inference), like ``keep_default_na=False``.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", False)
    if raw_strings:
        reader = reader.option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if raw_strings:
        df = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    if columns:
        missing = sorted(set(columns) - set(df.columns))
        if missing:
            raise ContractError(f"{path} is missing columns {missing}")
        df = df.select(*columns)
    return df


def scan_files(spark: SparkSession, pattern: str, schema: StructType | str, fmt: str = "csv",
               name: Column | None = None) -> DataFrame:
    """A9 + F14: rows of every file matching a glob with ``source_file`` (its
    name, or ``name``, an expression over ``_metadata``) and ``row_index``, the
    row's 0-based place in its file.

    A file may be read by many tasks: rows are numbered densely in the order of
    file, split and place in the split, and each file's first number is taken off."""
    from herdflow.operators.joins import materialize
    from herdflow.operators.rows import dense_row_id

    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.format(fmt).load(pattern)
    held = materialize(rows.select("*", (F.col("_metadata.file_name") if name is None else name).alias("source_file"),
                                   F.col("_metadata.file_path").alias("__path"),
                                   F.col("_metadata.file_block_start").alias("__block"),
                                   F.monotonically_increasing_id().alias("__place")), "files")
    numbered = dense_row_id(held, ["source_file", "__path", "__block", "__place"], "__n")
    first = numbered.groupBy(F.col("source_file").alias("__file")).agg(F.min("__n").alias("__first"))
    out = numbered.join(first, F.col("source_file").eqNullSafe(F.col("__file")))
    return out.withColumn("row_index", F.col("__n") - F.col("__first")).drop(
        "__path", "__block", "__place", "__n", "__file", "__first")


def sink_per_input(df: DataFrame, path: str, save_type: str, source: str = "source_file", mode: str = "overwrite") -> None:
    """One output per input file, in folders ``source=<name>``. Meant for
    results bounded per input, such as samples: the rows of one input are written
    by one task."""
    sink(df.repartition(source), path, save_type, mode=mode, partition_by=[source])


def scan_json_records(spark: SparkSession, path: str, schema: StructType | str | None = None,
                      multiline: bool = False) -> DataFrame:
    """JSON records (one object per line, or a whole document with
    ``multiline``), nested structs flattened to dotted column names."""
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return flatten_structs(reader.json(path))


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Recursive struct flatten: ``a.b.c`` columns (like ``json_normalize``)."""
    def walk(dtype, prefix):
        out = []
        for f in dtype.fields:
            name = f"{prefix}{sep}{f.name}" if prefix else f.name
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, name)
            else:
                out.append(name)
        return out

    names = walk(df.schema, "")
    return df.select(*[F.col("`" + n.replace(sep, "`.`") + "`" if sep == "." else n).alias(n) for n in names])


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """A10: zstd Parquet."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Header CSV (UTF-8, no BOM)."""
    w = df.write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


SINKS = {"parquet": sink_parquet, "csv": sink_csv}


def sink(df: DataFrame, path: str, save_type: str, **kw) -> None:
    """Validated format dispatch."""
    if save_type not in SINKS:
        raise ValueError(f"save_type must be one of {sorted(SINKS)}, got {save_type!r}")
    SINKS[save_type](df, path, **kw)


def read_back(spark: SparkSession, path: str, save_type: str, schema: StructType | str | None = None) -> DataFrame:
    if save_type == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_back_check(written: DataFrame, reread: DataFrame) -> DataFrame:
    """One row: row counts and rows present on one side only.

    Runs one aggregate per side first (count and sum of row hashes); only if
    they differ does the two-way ``exceptAll`` on the common columns follow."""
    cols = [c for c in written.columns if c in reread.columns]
    a = written.select(*cols)
    b = reread.select(*[F.col(c).cast(written.schema[c].dataType).alias(c) for c in cols])
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)"))]
    n, hashed = a.agg(*digest).first()
    if (n, hashed) == tuple(b.agg(*digest).first()):
        return written.sparkSession.range(1).select(
            F.lit(n).alias("written_rows"), F.lit(n).alias("reread_rows"),
            F.lit(0).cast("bigint").alias("missing_after_write"), F.lit(0).cast("bigint").alias("extra_after_write"))
    counts = with_scalars(a.agg(F.count(F.lit(1)).alias("written_rows")),
                          b.agg(F.count(F.lit(1)).alias("reread_rows")))
    only_a = a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing_after_write"))
    only_b = b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra_after_write"))
    return with_scalars(counts, only_a, only_b)


def file_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """Per file path, size, modification time and SHA-256 (binaryFile
    source; hashing runs on executors)."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("length").alias("size"), "modificationTime",
                        F.sha2(F.col("content"), 256).alias("sha256"))


PART_BYTES = 64 * 1024 * 1024


def file_digests(spark: SparkSession, pattern: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per file path, size, modification time and a digest that is the same
    for every way of reading: the SHA-256 of the hexadecimal SHA-256 of each
    ``part_bytes`` of the file, in order.

    Files of one part are read by Spark; larger ones are cut into ranges that
    tasks read on their own (``pyarrow.fs``), so no file enters one row or task.
    Spark's file scan lists no empty files; they have no row."""
    import hashlib

    import pyarrow as pa

    files = spark.read.format("binaryFile").load(pattern)
    facts = ["path", F.col("length").alias("size"), "modificationTime"]
    small = files.filter(F.col("length") <= part_bytes).select(
        *facts, F.sha2(F.sha2("content", 256).cast("binary"), 256).alias("digest"))
    large = files.filter(F.col("length") > part_bytes).select(*facts)
    parts = large.select(*facts[:1], "size", "modificationTime", F.explode(F.sequence(
        F.lit(0).cast("long"), ((F.col("size") - 1) / part_bytes).cast("long"))).alias("part"))

    def hashed(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
                uri = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]
                store, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_file(name) as f:
                    for at in range(part * part_bytes, min((part + 1) * part_bytes, f.size()), 1 << 23):
                        digest.update(f.read_at(min(1 << 23, (part + 1) * part_bytes - at), at))
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "hash"])

    ranges = parts.repartition("path", "part").mapInArrow(
        hashed, "path string, size long, modificationTime timestamp, part long, hash string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), "")
    large = ranges.groupBy("path", "size", "modificationTime").agg(F.sha2(whole.cast("binary"), 256).alias("digest"))
    return small.unionByName(large)


def write_run_metadata(spark: SparkSession, path: str, record: Mapping) -> None:
    """One JSON object with a run's paths, counts, rules and source files."""
    text = json.dumps(record, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_run_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def land_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Raw JSON landing (one object per line)."""
    df.write.mode(mode).json(path)
