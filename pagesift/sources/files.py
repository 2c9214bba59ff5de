"""Readers of the file formats that pages, chunks and vectors come in."""

from __future__ import annotations

import http.client
import io
import re
import socket
import ssl
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAGE = re.compile(r"(?:^|.*/)(?!\._)\d+\.(?:html|htm|txt)$", re.I)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; a byte order mark before the first name doesn't matter."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=False, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """One JSON object a line, plain or gzip. A gzip file can't be split, so few large ones should be spread with ``partitions``."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions) if partitions else rows


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON object each: metrics and manifests."""
    return spark.read.json(path, multiLine=True)


def flat_metrics(df: DataFrame) -> DataFrame:
    """Nested metrics with the fields of ``valid_only`` and its confusion matrix as columns."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
    out = df.select(*[c for c in df.columns if c not in nested], *[f"{n}.*" for n in nested])
    return flat_metrics(out) if any(isinstance(f.dataType, T.StructType) for f in out.schema.fields) else out


def file_system(path: str):
    """(file system, path in it) of a path or uri, in driver or task; local folders, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_zip_pages(spark: SparkSession, path: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """(archive, filename, html) of the pages in ZIP files; undecodable bytes are dropped.

    An archive is read by one task, member by member from the shared folder, so only
    about ``batch_bytes`` of its pages are held at once.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, place = file_system(name)
                names, texts, size = [], [], 0
                with fs.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
                    for info in archive.infolist():
                        if info.is_dir() or "__MACOSX" in info.filename.split("/") or not _PAGE.match(info.filename):
                            continue
                        names.append(info.filename)
                        texts.append(archive.read(info).decode("utf-8", "ignore"))
                        size += len(texts[-1])
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(names)), pa.array(names), pa.array(texts)], schema)
                            names, texts, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string())], schema)

    schema = ["archive", "filename", "html"]
    # the content column isn't read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    return files.mapInArrow(entries, "archive string, filename string, html string")


def _matrix_rows(x: np.ndarray, first: int) -> pa.RecordBatch:
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + first), vectors], ["row", "vector"])


def read_matrix(spark: SparkSession, path: str, block: int = 65_536) -> DataFrame:
    """(row, vector) of float32 rows: a .npy file in a folder all executors share, of which tasks map their blocks of rows only, or a folder of blocks that ``write_matrix`` wrote."""
    if not path.endswith(".npy"):
        return _read_blocks(spark, path)
    path = path.removeprefix("file://")
    shape = np.load(path, mmap_mode="r").shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            for b in batch.column(0).to_pylist():
                yield _matrix_rows(matrix[b * block : (b + 1) * block], b * block)

    blocks = -(-shape[0] // block)
    return spark.range(0, blocks, 1, max(blocks, 1)).mapInArrow(rows, "row long, vector array<float>")


def _read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The name of a block file tells its first row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, place = file_system(name)
                with fs.open_input_file(place) as raw:
                    yield _matrix_rows(np.load(io.BytesIO(raw.read())), int(re.search(r"(\d+)\.npy$", name)[1]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path")
    return files.mapInArrow(rows, "row long, vector array<float>")


def join_by_row(rows: DataFrame, matrix: DataFrame, row: str = "row") -> DataFrame:
    """Rows with their vector, row i with row i of the matrix; a row without a vector, or a vector without a row, is an error of the input and kept with nulls."""
    return rows.join(matrix, row, "full")


def from_row(df: DataFrame, index: str, start: int) -> DataFrame:
    """The rows from index ``start`` on; the index is a column, so the filter reaches the scan."""
    return df.where(F.col(index) >= start)


class HttpSession:
    """GET over kept connections, one per host, with a timeout for connecting and one for reading.

    Gives (code, body, error, message); redirects aren't followed, their code is the answer.
    """

    def __init__(self, connect: float = 3.0, read: float = 5.0, headers: dict[str, str] | None = None):
        self.connect, self.read, self.headers = connect, read, headers or {"User-Agent": "pagesift"}
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def __call__(self, url: str) -> tuple[int | None, bytes, str | None, str | None]:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return None, b"", "InvalidURL", url
        at = parts.scheme, parts.netloc.rpartition("@")[2]
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        kept, stage_ = at in self.open, "ReadTimeout"
        try:
            link = self.open.get(at)
            if link is None:
                stage_ = "ConnectTimeout"
                kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                link = kind(at[1], timeout=self.connect)
                link.connect()
                self.open[at], stage_ = link, "ReadTimeout"
            link.sock.settimeout(self.read)
            link.request("GET", target, headers=self.headers)
            answer = link.getresponse()
            body = answer.read()
            if answer.will_close:
                self._drop(at)
            return answer.status, body, None, None
        except Exception as e:  # what went wrong is a result
            self._drop(at)
            if kept and isinstance(e, (http.client.RemoteDisconnected, BrokenPipeError, ConnectionResetError)):
                return self(url)  # the host had closed a kept connection: once more on a new one
            if isinstance(e, TimeoutError):
                return None, b"", stage_, str(e)
            if isinstance(e, ssl.SSLError):
                return None, b"", "SSLError", str(e)
            if isinstance(e, (http.client.InvalidURL, UnicodeError, ValueError)):
                return None, b"", "InvalidURL", str(e)
            name = "NewConnectionError: Name or service not known" if isinstance(e, socket.gaierror) else type(e).__name__
            return None, b"", "ConnectionError", f"{name}: {e}"

    def _drop(self, at: tuple[str, str]) -> None:
        link = self.open.pop(at, None)
        if link is not None:
            link.close()


def fetch_pages(
    urls: DataFrame, fetch: Callable[[str], tuple[int | None, bytes, str | None, str | None]] | None = None, session: Callable[[], Callable] = HttpSession
) -> DataFrame:
    """(row, code, error, message, body) of urls (row, url); ``fetch`` gives (code, body, error, message).

    Without ``fetch`` every task makes a ``session`` of its own and keeps its
    connections for all its rows. The body is kept for code 200 only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = fetch or session()
        for pdf in batches:
            out = [get(u) for u in pdf["url"]]
            yield pd.DataFrame({
                "row": pdf["row"],
                "code": pd.array([o[0] for o in out], dtype="Int32"),
                "error": [o[2] for o in out],
                "message": [o[3] for o in out],
                "body": [o[1] if o[0] == 200 else None for o in out],
            })

    return urls.select("row", "url").mapInPandas(run, "row long, code int, error string, message string, body binary")
