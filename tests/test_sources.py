"""Small files packed into few and read back one by one."""

import glob

from pyspark.sql import functions as F

from placewise.sources import readers, writers


def test_packed_documents_come_back_whole(spark, tmp_path):
    texts = ["", "one\n", "two\nlines\r\n", "é " * 400, "\\x \x1e\x00", "same", "same"] * 30
    docs = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in enumerate(texts)], "id int, kind string, text string").coalesce(2)
    path = str(tmp_path / "docs")
    writers.write_packed(docs, path, F.col("text"), "kind", per_file=50)
    assert len(glob.glob(f"{path}/*/*.txt")) <= 8  # a file for every document would be 210
    got = readers.read_documents(spark, path, packed=True).collect()
    assert sorted(r.text for r in got) == sorted(texts)
    assert len({r.file_path for r in got}) == len({r.source for r in got} | {r.file_path for r in got}) - len({r.source for r in got}) == len(texts)


def test_packed_images_come_back_byte_for_byte(spark, tmp_path):
    contents = [bytes(range(i, i + 90)) for i in range(160)] + [b""]
    rows = [(["rat", "burrow", "other"][i % 3], bytearray(c)) for i, c in enumerate(contents)]
    path = str(tmp_path / "images")
    writers.write_packed(spark.createDataFrame(rows, "kind string, content binary").coalesce(1), path, F.col("content"), "kind", per_file=40)
    assert len(glob.glob(f"{path}/*/*.txt")) <= 6
    got = readers.read_images(spark, path, ["rat", "burrow"], "*.txt", "kind=", packed=True).collect()
    want = sorted((k, bytes(c), len(c)) for k, c in rows if k != "other")
    assert sorted((r.class_name, bytes(r.content), r.length) for r in got) == want
    assert len({r.path for r in got}) == len(want) and {r.label for r in got} == {0, 1}


def test_queries_make_few_files(spark, small, monkeypatch):
    import catalog

    paths = []
    write = writers.write_packed
    monkeypatch.setattr(writers, "write_packed", lambda df, path, *a, **b: (paths.append(path), write(df, path, *a, **b)))
    documents = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("scan_wholetext", "image_evidence"):
        assert catalog.QUERIES[name](spark, small).count() > 0
        assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths[-1]).count() < documents / 5
