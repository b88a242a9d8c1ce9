import os
import time

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from corvane.sources import document_source as D


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "deep").mkdir(parents=True)
    for i in range(12):
        p = root / ("deep" if i % 3 == 0 else ".") / f"f{i}.{['md', 'txt', 'PDF', 'xyz'][i % 4]}"
        p.write_bytes(b"x" * (10 * i))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    (root / "_hidden").write_text("no")
    (root / "noending").write_text("yes")
    os.utime(root / "noending", (1_600_000_000, 1_600_000_000))
    return root


def load(spark, folder, **options):
    D.register(spark)
    return spark.read.format(D.FORMAT).options(**options).load(str(folder))


def test_rows(spark, folder):
    rows = {os.path.basename(r.path): r for r in load(spark, folder).collect()}
    assert len(rows) == 13 and "_hidden" not in rows
    r = rows["f6.PDF"]
    assert (r.length, r.extension, r.folder, r.category, bytes(r.content)) == (60, "pdf", "pdf", "document", b"x" * 60) and r.modificationTime.timestamp() == 1_700_000_006
    assert rows["noending"].extension == "" and rows["f7.xyz"].category == "unknown"
    assert len(load(spark, folder, recursive="false").collect()) == 9 and load(spark, folder, content="false").filter("content is not null").count() == 0
    assert load(spark, folder / "nowhere").count() == 0


def test_filters_keep_files_closed(spark, folder):
    """Files that the filters leave out are removed between the listing and the reading: opening one would fail."""
    reader = D.DocumentSource({"path": str(folder)}).reader(None)
    left = list(reader.pushFilters([EqualTo(("extension",), "md"), GreaterThan(("length",), 30), EqualTo(("content",), b"x"), In(("folder",), ("text", "pdf"))]))
    assert [f.attribute for f in left] == [("content",)]
    files = [f for p in reader.partitions() for f in p.files]
    assert {os.path.basename(f.path) for f in files} == {"f4.md", "f8.md"}
    for p in folder.rglob("f*"):
        if p.name not in ("f4.md", "f8.md"):
            p.unlink()
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 2


def test_filters_from_a_query(spark, folder):
    df = load(spark, folder).filter("extension in ('md', 'txt') and length >= 50 and length < 100 and content is not null")
    assert {os.path.basename(r.path) for r in df.collect()} == {"f5.txt", "f8.md", "f9.txt"}
    assert load(spark, folder).filter("extension = 'md' or length = 70").count() == 4 and load(spark, folder).filter("extension is null").count() == 0


def test_splits(spark, folder):
    assert load(spark, folder, splitFiles="5").rdd.getNumPartitions() == 3
    assert load(spark, folder, splitBytes="100").rdd.getNumPartitions() > 5
    reader = D.DocumentSource({"path": str(folder)}).reader(None)
    list(reader.pushFilters([LessThan(("length",), 0)]))
    assert reader.partitions() == []


def test_stream_gives_the_rows_of_the_batch_once(spark, folder, tmp_path):
    D.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        s = spark.readStream.format(D.FORMAT).load(str(folder))
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    key = lambda df: sorted((r.path, bytes(r.content), r.length) for r in df.collect())
    run()
    assert key(spark.read.parquet(out)) == key(load(spark, folder))
    (folder / "later.md").write_text("new")
    os.utime(folder / "later.md", (time.time(), time.time()))
    run()  # a new query over the same checkpoint goes on after the last offset
    assert key(spark.read.parquet(out)) == key(load(spark, folder))
