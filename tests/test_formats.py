"""The data sources: pages by parts of files and pushed filters, files that appear together, the log by its ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.sources import formats

LOG = "id long, ts double, level string, message string, book_id long, page_no int"


def decoder(mark):
    """A file is a page a line; each decoding leaves a mark."""

    def page_count(data):
        if data.startswith(b"broken"):
            raise ValueError("no pages in it")
        return data.count(b"\n")

    def render(data, page, scale):
        import uuid

        open(f"{mark}/{page}-{uuid.uuid4().hex}", "w").close()
        if page == 13:
            raise RuntimeError("unlucky page")
        return data.split(b"\n")[page - 1] + f" x{scale:g}".encode()

    return page_count, render


def test_only_asked_pages_are_decoded_by_several_tasks(spark, tmp_path):
    src, mark = tmp_path / "in", tmp_path / "marks"
    (src / "a").mkdir(parents=True)
    mark.mkdir()
    (src / "a" / "big.PDF").write_bytes(b"".join(b"page %03d\n" % n for n in range(1, 101)))
    (src / "small.pdf").write_bytes(b"one\ntwo\n")
    (src / "bad.pdf").write_bytes(b"broken")
    (src / "not.txt").write_bytes(b"x\n")
    formats.register(spark, *decoder(str(mark)))
    load = lambda **o: spark.read.format("page_rasters").options(dpi="144", taskBytes="300", **o).load(f"file://{src}")
    pages, big = load(), f"{src}/a/big.PDF"
    assert pages.rdd.getNumPartitions() == 3 + 1 + 1
    got = load(files=big, firstPage="12", lastPage="15").collect()
    assert {r.page_no: bytes(r.image or b"") for r in got} == {12: b"page 012 x2", 13: b"", 14: b"page 014 x2", 15: b"page 015 x2"}
    assert [r.error for r in got if r.error] == ["unlucky page"]
    assert sorted(int(f.name.split("-")[0]) for f in mark.iterdir()) == [12, 13, 14, 15]
    every = pages.select("path", "page_no", "error").collect()
    assert len(every) == 103 and [r.error for r in every if r.page_no == 0] == ["no pages in it"]
    assert sorted(r.page_no for r in every if r.path == big) == list(range(1, 101))
    assert {r.page_no for r in pages.filter(F.col("page_no") == 5).collect()} == {5} and pages.count() == 103  # a query leaves no trace
    listed = load(images="false", pages="2,700")
    before = len(list(mark.iterdir()))
    assert sorted(r.page_no for r in listed.collect()) == [0, 2, 2] and len(list(mark.iterdir())) == before
    assert spark.read.format("page_rasters").load(f"file://{tmp_path}/none").count() == 0


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"{n % 7}/f.txt", n, f"line {n}") for n in range(500)], "file string, place long, value string").repartition(5)
    out = tmp_path / "out"
    formats.write_files(rows, f"file://{out}", 3)
    for k in range(7):
        assert (out / f"{k}" / "f.txt").read_text().splitlines() == [f"line {n}" for n in range(500) if n % 7 == k]
    assert sorted(f.name for f in out.iterdir()) == [str(k) for k in range(7)]

    def fails(n):
        if n == 490:
            raise RuntimeError("a task dies late")
        return f"new {n}"

    bad = rows.withColumn("value", F.udf(fails, "string")("place"))
    with pytest.raises(Exception, match="dies late"):
        formats.write_files(bad, f"file://{out}", 3)
    assert (out / "3" / "f.txt").read_text().startswith("line 3")  # as they were
    assert sorted(f.name for f in out.iterdir()) == [str(k) for k in range(7)]


def test_the_log_is_read_by_its_ids(spark, tmp_path):
    log, out = f"{tmp_path}/log", tmp_path / "out"

    def add(ids):
        spark.createDataFrame([(i, float(i), "info", f"m{i}", None, None) for i in ids], LOG).coalesce(1).write.mode("append").parquet(log)

    def tail():
        def keep(df, n):
            df.write.mode("overwrite").parquet(f"{out}/batch={n}")

        stream = spark.readStream.format("event_log").option("path", f"file://{log}").option("afterId", "5").option("maxRows", "7").option("rowsATask", "3").load()
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.id for r in spark.read.parquet(str(out)).select("id").collect())

    formats.register(spark)
    add(range(1, 16))
    assert tail() == list(range(6, 16))
    add(range(10, 16))  # appended again
    add(range(16, 40))
    assert tail() == list(range(6, 40))
    sizes = [len(list(spark.read.parquet(str(p)).collect())) for p in out.iterdir() if p.is_dir()]
    assert max(sizes) <= 7
    batch = spark.read.parquet(log).filter("id > 5").dropDuplicates(["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(out)).select("id", "ts", "message").collect()) == sorted(tuple(r) for r in batch.select("id", "ts", "message").collect())
