"""Writers: exclusive shards, rolling archives, upserts, snapshots."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.operators.checks import require_positive, signature_differences
from pagesift.plans.names import fresh
from pagesift.plans.stages import stage
from pagesift.sources.files import file_system


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; blanks at the ends of values are kept."""
    df.write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Further gzip JSON lines beside those already there."""
    df.write.mode("append").option("compression", "gzip").json(path)


def write_shards(df: DataFrame, path: str, size: int = 250) -> None:
    """Gzip JSON lines, at most ``size`` rows a file; fails where something is already written. Files appear when the job has ended."""
    require_positive(size=size)
    df.write.mode("errorifexists").option("maxRecordsPerFile", size).option("compression", "gzip").json(path)


#: Versions a collection's buckets may be spread over before a load rewrites them all.
MOST_VERSIONS = 16


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, value: dict, path: str, overwrite: bool = True) -> None:
    """One small JSON object, written aside and moved into place."""
    jvm, target, fs = _fs(spark, path)
    if not overwrite and fs.exists(target):
        raise FileExistsError(path)
    aside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE  # one step: readers see the old object or the new one
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, how)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What ``write_json`` wrote; None if nothing."""
    _, target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    rows = spark.read.text(path, wholetext=True).first()
    return json.loads(rows[0])


def write_zip_parts(pages: DataFrame, folder: str, most_bytes: int = 400 << 20) -> DataFrame:
    """ZIP files of pages (filename, html) in a shared folder, a new one when ``most_bytes`` are reached: (archive, pages, bytes).

    Each task writes its own parts, named by partition, aside and then moved into place;
    a repeated task writes the same names again, so a lost executor leaves no doubles.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = file_system(folder)
        fs.create_dir(place, recursive=True)
        pid, part, open_ = TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            name, raw, archive, count = open_
            archive.close()
            size = raw.tell()
            raw.close()
            fs.move(f"{name}.tmp", name)
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name.rpartition('/')[2]}", "pages": count, "bytes": size}])

        for batch in batches:
            for filename, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if open_ is None:
                    name = f"{place}/part-{pid:05d}-{part:04d}.zip"
                    raw = fs.open_output_stream(f"{name}.tmp")
                    open_ = [name, raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED), 0]
                open_[2].writestr(filename, (html or "").encode())
                open_[3] += 1
                if open_[1].tell() >= most_bytes:
                    yield close()
                    open_, part = None, part + 1
        if open_ is not None:
            yield close()

    return stage(pages.select("filename", "html").mapInArrow(write, "archive string, pages long, bytes long"), "archives")


def write_matrix(df: DataFrame, folder: str, dim: int, block: int = 65_536) -> DataFrame:
    """(block, rows) of .npy files of float32 rows in index order, named by their first row; ``df`` has row (dense from 0) and vector."""

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, place = file_system(folder)
        fs.create_dir(place, recursive=True)
        pdf = pdf.sort_values("row")
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
        if x.shape[1] != dim:
            raise ValueError(f"rows of {x.shape[1]} numbers, not {dim}")
        name, content = f"{place}/block-{key[0] * block:012d}.npy", io.BytesIO()
        np.save(content, x)
        with fs.open_output_stream(f"{name}.tmp") as out:
            out.write(content.getbuffer())
        fs.move(f"{name}.tmp", name)
        return pd.DataFrame({"block": [key[0]], "rows": [len(x)]})

    require_positive(dim=dim, block=block)
    rows = df.withColumn("_b", F.floor(F.col("row") / block))
    return stage(rows.groupBy("_b").applyInPandas(save, "block long, rows long"), "blocks")


def resume_or_build(spark: SparkSession, folder: str, signature: dict, build: Callable[[], DataFrame], restart: bool = False) -> DataFrame:
    """The result in ``folder`` if it was made by a job of this ``signature``; else ``build`` makes it.

    The signature is stored before the result, so a job that broke off is taken up as its
    own. A result of another signature is an error that names what differs, or with
    ``restart`` is made anew.
    """
    stored = read_json(spark, f"{folder}/signature.json")
    if stored is not None:
        differ = signature_differences(json.dumps(stored), signature)
        if differ and not restart:
            raise ValueError(f"{folder} holds a result of another job: {', '.join(differ)}")
        if not differ:
            jvm, done, fs = _fs(spark, f"{folder}/result/_SUCCESS")
            if fs.exists(done):
                return spark.read.parquet(f"{folder}/result")
    write_json(spark, signature, f"{folder}/signature.json")
    build().write.mode("overwrite").parquet(f"{folder}/result")
    return spark.read.parquet(f"{folder}/result")


def upsert(spark: SparkSession, folder: str, rows: DataFrame, key: str, order: str, partition: str, *, buckets: int = 64) -> str:
    """Merge ``rows`` into the table of ``folder``: the last row of each key by ``order`` stays. Returns the new version's path.

    The table is cut into ``buckets`` by a hash of the key (chosen by the first load);
    a load rewrites only those it touches, and a pointer file names the version of each,
    so readers never see half a load and older versions stay whole. Of rows equal in
    key and order the later load's counts, within a load the one of larger hash.
    """
    pointer = f"{folder}/CURRENT.json"
    current = read_json(spark, pointer) or {"version": 0, "buckets": buckets, "parts": {}, "schema": json.loads(rows.schema.json())}
    bucket, load, rank = fresh(rows.columns, "_bucket", "_load", "_r")
    fresh_rows = rows.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(current["buckets"])).cast("int")).withColumn(load, F.lit(1))
    touched = [str(r[0]) for r in fresh_rows.select(bucket).distinct().collect()]
    if len(set(current["parts"].values())) >= MOST_VERSIONS:  # else readers would open ever more versions
        touched = sorted({*touched, *current["parts"]})
    known = {b: v for b, v in current["parts"].items() if b in touched}
    both = fresh_rows
    if known:
        old = _parts(spark, folder, known, current).select(*rows.columns)
        both = old.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(current["buckets"])).cast("int")).withColumn(load, F.lit(0)).unionByName(fresh_rows)
    last = Window.partitionBy(bucket, key).orderBy(F.col(order).desc_nulls_last(), F.desc(load), F.xxhash64(*rows.columns))
    kept = both.repartition(F.col(bucket)).withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1).drop(rank, load)
    version = current["version"] + 1
    path = f"{folder}/v{version}"
    kept.withColumnRenamed(bucket, "_bucket").write.mode("overwrite").partitionBy("_bucket", partition).parquet(path)
    write_json(spark, {**current, "version": version, "parts": {**current["parts"], **dict.fromkeys(touched, version)}}, pointer)
    return path


def _parts(spark: SparkSession, folder: str, parts: dict[str, int], current: dict) -> DataFrame:
    schema = T.StructType.fromJson(current["schema"])
    out = None
    for version in sorted(set(parts.values())):
        base = f"{folder}/v{version}"
        paths = [f"{base}/_bucket={b}" for b, v in sorted(parts.items()) if v == version]
        rows = spark.read.option("basePath", base).schema(schema).parquet(*paths).select(*schema.names)
        out = rows if out is None else out.unionByName(rows)
    return out


def open_collection(spark: SparkSession, folder: str, label: int | None = None, refresh: Callable[[], None] | None = None) -> DataFrame:
    """The current version of an upserted table; ``label`` prunes its partitions.

    If there is none, ``refresh`` (say, a copy from elsewhere) is called once; if there
    is still none, or no such label, that is an error.
    """
    current = read_json(spark, f"{folder}/CURRENT.json")
    if current is None and refresh is not None:
        refresh()
        current = read_json(spark, f"{folder}/CURRENT.json")
    if current is None:
        raise FileNotFoundError(f"no collection in {folder}")
    if not current["parts"]:
        return spark.createDataFrame([], T.StructType.fromJson(current["schema"]))
    rows = _parts(spark, folder, current["parts"], current)
    return rows if label is None else rows.where(F.col("label") == label)
