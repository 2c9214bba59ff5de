"""Round trips through file formats, and streams."""

import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.sources import files, sinks
from pagesift.streaming.incremental import incremental_best, run_available, stream_of


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿filename,label\nx.txt,1\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "filename string, label int")
    assert rows.first()[:] == ("x.txt", 1)


def test_jsonl_and_shards(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as out:
        out.write('{"a": 1}\n{"a": 2, "b": "x"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "a int, b string", 2).count() == 2
    rows = spark.range(0, 501, 1, 1)
    sinks.write_shards(rows, str(tmp_path / "shards"), 250)
    sizes = sorted(sum(1 for _ in gzip.open(p)) for p in (tmp_path / "shards").glob("part-*"))
    assert sizes == [1, 250, 250]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_shards(rows, str(tmp_path / "shards"))


def test_zip_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for name in ("html/000001.txt", "__MACOSX/000002.txt", "html/._000003.txt", "html/x.txt", "000004.HTML", "5.pdf"):
            z.writestr(name, b"ok\xff")
    got = {r["filename"]: r["html"] for r in files.read_zip_pages(spark, str(tmp_path)).collect()}
    assert got == {"html/000001.txt": "ok", "000004.HTML": "ok"}


def test_zip_parts_roll(spark, tmp_path):
    pages = spark.range(0, 20, 1, 1).select(F.format_string("%06d.txt", "id").alias("filename"), F.lit("x" * 1000).alias("html"))
    parts = sinks.write_zip_parts(pages, str(tmp_path / "z"), most_bytes=500)
    assert parts.count() > 1 and parts.agg(F.sum("pages")).first()[0] == 20
    assert files.read_zip_pages(spark, str(tmp_path / "z")).count() == 20


def test_matrix(spark, tmp_path):
    x = np.arange(70, dtype=np.float32).reshape(10, 7)
    np.save(tmp_path / "m.npy", x)
    rows = files.read_matrix(spark, str(tmp_path / "m.npy"), block=4)
    assert [r["vector"] for r in rows.orderBy("row").collect()] == x.tolist()
    assert files.from_row(rows, "row", 7).count() == 3
    blocks = sinks.write_matrix(rows, str(tmp_path / "out"), 7, block=4)
    assert sorted(r["rows"] for r in blocks.collect()) == [2, 4, 4]
    assert np.array_equal(np.concatenate([np.load(p) for p in sorted((tmp_path / "out").glob("*.npy"))]), x)


def test_matrix_blocks_are_read_back_and_joined(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("row"), F.array(*[(F.col("id") + i).cast("float") for i in range(3)]).alias("vector"))
    sinks.write_matrix(rows, f"file://{tmp_path}/m", 3, block=4)
    back = files.join_by_row(rows.select("row", (F.col("row") * 2).alias("x")), files.read_matrix(spark, f"file://{tmp_path}/m"))
    assert {r["row"]: (r["x"], r["vector"]) for r in back.collect()} == {i: (2 * i, [i, i + 1.0, i + 2.0]) for i in range(10)}
    with pytest.raises(ValueError):
        sinks.write_matrix(rows, f"file://{tmp_path}/n", 0)


def test_jobs_resume_by_signature(spark, tmp_path):
    folder, made = f"file://{tmp_path}/job", []

    def build():
        made.append(1)
        return spark.range(len(made))

    assert sinks.resume_or_build(spark, folder, {"k": 1}, build).count() == 1
    assert sinks.resume_or_build(spark, folder, {"k": 1}, build).count() == 1 and len(made) == 1
    with pytest.raises(ValueError, match="another job: k"):
        sinks.resume_or_build(spark, folder, {"k": 2}, build)
    assert sinks.resume_or_build(spark, folder, {"k": 2}, build, restart=True).count() == 2
    # a job that broke off before its result was whole is made again
    (tmp_path / "job" / "result" / "_SUCCESS").unlink()
    assert sinks.resume_or_build(spark, folder, {"k": 2}, build).count() == 3


def test_json_and_flat_metrics(spark, tmp_path):
    path = f"file://{tmp_path}/m/metrics.json"
    sinks.write_json(spark, {"num_pages": 3, "valid_only": {"precision": 0.5, "confusion_matrix": {"tn": 1}}}, path)
    assert sinks.read_json(spark, path)["num_pages"] == 3
    with pytest.raises(FileExistsError):
        sinks.write_json(spark, {}, path, overwrite=False)
    row = files.flat_metrics(files.read_json_object(spark, path)).first()
    assert (row["num_pages"], row["precision"], row["tn"]) == (3, 0.5, 1)
    assert sinks.read_json(spark, f"file://{tmp_path}/none.json") is None


def test_upsert_keeps_last(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    with pytest.raises(FileNotFoundError):
        sinks.open_collection(spark, folder)
    schema = "id string, label int, v int, t int"
    sinks.upsert(spark, folder, spark.createDataFrame([("a", 0, 1, 1), ("b", 1, 1, 1), ("a", 0, 2, 2)], schema), "id", "t", "label")
    sinks.upsert(spark, folder, spark.createDataFrame([("b", 1, 9, 3), ("c", 1, 5, 3)], schema), "id", "t", "label")
    got = {r["id"]: r["v"] for r in sinks.open_collection(spark, folder).collect()}
    assert got == {"a": 2, "b": 9, "c": 5}
    assert sinks.open_collection(spark, folder, 0).count() == 1


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/c", "id long, label int, v int, t int"
    sinks.upsert(spark, folder, spark.createDataFrame([(i, i % 2, i, 1) for i in range(50)], schema), "id", "t", "label", buckets=8)
    sinks.upsert(spark, folder, spark.createDataFrame([(7, 1, -7, 1), (7, 0, -8, 2), (7, 0, -9, None)], schema), "id", "t", "label")
    parts = sinks.read_json(spark, f"{folder}/CURRENT.json")["parts"]
    assert sorted(parts.values()) == [1] * 7 + [2]
    assert {r["id"]: r["v"] for r in sinks.open_collection(spark, folder).collect()} == {i: i if i != 7 else -8 for i in range(50)}
    assert sinks.open_collection(spark, folder, 1).count() == 24
    for i in range(20):
        sinks.upsert(spark, folder, spark.createDataFrame([(i, 0, 100 + i, 9)], schema), "id", "t", "label")
    assert len(set(sinks.read_json(spark, f"{folder}/CURRENT.json")["parts"].values())) <= sinks.MOST_VERSIONS
    assert sinks.open_collection(spark, folder).where("v >= 100").count() == 20


def test_missing_collection_is_refreshed_once(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/c", []

    def refresh():
        calls.append(1)
        if len(calls) == 2:
            sinks.upsert(spark, folder, spark.createDataFrame([(1, 0, 1)], "id long, label int, t int"), "id", "t", "label")

    with pytest.raises(FileNotFoundError):
        sinks.open_collection(spark, folder, refresh=refresh)
    assert sinks.open_collection(spark, folder, refresh=refresh).count() == 1 and len(calls) == 2


def test_fetch_with_injected_client(spark):
    def fetch(url):
        return (200, b"x", None, None) if url == "a" else (404, b"y", None, None) if url == "b" else (None, b"", "ConnectTimeout", "slow")

    urls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row long, url string")
    got = {r["row"]: r for r in files.fetch_pages(urls, fetch).collect()}
    assert (bytes(got[1]["body"]), got[2]["body"], got[3]["error"]) == (b"x", None, "ConnectTimeout")


def test_sessions_keep_connections_and_name_failures(spark):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    opened = []

    class Pages(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            opened.append(1)
            super().setup()

        def do_GET(self):
            if self.path == "/slow":
                time.sleep(1.5)
            body = self.path.encode()
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        session = files.HttpSession(connect=1, read=0.5)
        assert [session(f"{base}/{i}?q=1")[:2] for i in range(5)] == [(200, f"/{i}?q=1".encode()) for i in range(5)] and len(opened) == 1
        assert session(f"{base}/slow")[2] == "ReadTimeout" and session(f"{base}/none")[0] == 404
        assert session("http://127.0.0.1:9/")[2] == "ConnectionError" and session("ftp://x/")[2] == session("")[2] == "InvalidURL"
        rows = spark.createDataFrame([(1, f"{base}/a"), (2, f"{base}/none"), (3, "nonsense")], "row long, url string")
        got = {r["row"]: (r["code"], r["error"], r["body"] and bytes(r["body"])) for r in files.fetch_pages(rows).collect()}
        assert got == {1: (200, None, b"/a"), 2: (404, None, None), 3: (None, "InvalidURL", None)}
    finally:
        server.shutdown()


def test_stages_of_a_job_are_deleted(spark):
    from pagesift.plans import stages

    before = set(stages._written)
    with stages.stages_of_a_job():
        out = stages.stage(spark.range(3), "gone", {"rows": F.count(F.lit(1)), "largest": F.max("id")})
        assert stages.metrics_of(out) == {"rows": 3, "largest": 2}
        empty = stages.stage(spark.range(3).where("false"), "gone", {"rows": F.count(F.lit(1))})
        assert stages.metrics_of(empty) == {"rows": 0} and empty.count() == 0
    assert set(stages._written) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        out.count()


def test_training_needs_its_framework():
    from pagesift.operators.batching import train_distributed

    with pytest.raises(ValueError):
        train_distributed(print, processes=0)
    try:
        import torch  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="torch"):
            train_distributed(print)


def test_append_and_csv_sink(spark, tmp_path):
    rows = spark.range(3)
    sinks.append_jsonl(rows, str(tmp_path / "j"))
    sinks.append_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "id long").count() == 3


def test_second_run_takes_only_new_files(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = spark.range(1).schema
    spark.range(5).write.parquet(source)
    run_available(stream_of(spark, source, schema), out, check)
    spark.range(5, 8).write.mode("append").parquet(source)
    run_available(stream_of(spark, source, schema), out, check)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_incremental_best_over_batches(spark, tmp_path):
    schema = "page string, label int, similarity double"
    for i in range(3):
        spark.createDataFrame([("p", 1, 0.1 * i), ("q", 0, 0.5)], schema).write.mode("append").parquet(str(tmp_path / "h"))
    stream = stream_of(spark, str(tmp_path / "h"), spark.read.parquet(str(tmp_path / "h")).schema, files_per_batch=1)
    got = {r["page"]: (round(r["best"], 3), r["hits"]) for r in incremental_best(spark, stream, f"file://{tmp_path}/s").collect()}
    assert got == {"p": (0.2, 3), "q": (0.5, 3)}


def test_metrics_file(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"a": 1}))
    assert files.read_json_object(spark, str(tmp_path / "x.json")).first()["a"] == 1
