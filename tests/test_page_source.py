"""The page data source: batch and stream give the same pages at every split."""

import os

import pytest

from pagewright.sources import page_source as PS
from pagewright.streaming import streams as ST

TEXTS = {"a.txt": "one\ftwo äöü\f\fthree", "b.txt": "", "c.txt": "no break at all " * 50, "d.txt": "\f", "sub/e.txt": "\f".join(f"page {i} " + "x" * (i % 13) for i in range(400)),
         "f.txt": "ends with a break\f", "skipped.log": "other"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    for name, text in TEXTS.items():
        (d / name).parent.mkdir(exist_ok=True)
        (d / name).write_bytes(text.encode())
    spark.dataSource.register(PS.PageSource)
    return str(d)


def want(names=None):
    return sorted((n, i + 1, p) for n, t in TEXTS.items() if n.endswith(".txt") and (names is None or n in names) for i, p in enumerate(t.split("\f")))


def got(df, folder):
    return sorted((os.path.relpath(r["path"], folder), r["page_number"], r["text"]) for r in PS.numbered(df).collect())


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_of_any_size_give_the_same_pages(folder, size):
    out = []
    parts = PS._ranges(PS._files(folder, ".txt"), size)
    for p in parts:
        rows = list(PS.pages_in(folder, p))
        assert rows == list(PS.pages_in(folder, p))  # a lost task's range read again
        assert all((p.first < r[3] <= p.last) or (r[3] == 0 == p.first) for r in rows)
        out += rows
    pages = {}
    for path, split, place, start, text in sorted(out, key=lambda r: (r[0], r[3])):
        pages.setdefault(os.path.relpath(path, folder), []).append(text)
    assert pages == {n: t.split("\f") for n, t in TEXTS.items() if n.endswith(".txt")}


def test_batch_reader_plans_ranges_and_numbers_pages(spark, folder):
    df = spark.read.format("text_pages").option("suffix", ".txt").option("split_bytes", "100").load(folder)
    assert df.rdd.getNumPartitions() > 30
    assert got(df, folder) == want()


def test_stream_reader_gives_the_same_pages_file_by_file(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    spark.dataSource.register(PS.PageSource)

    def run():
        stream = spark.readStream.format("text_pages").option("suffix", ".txt").option("split_bytes", "50").load(str(src))
        q = ST.start(stream, mode="append", sink="parquet", path=out, checkpoint=ckpt)
        q.awaitTermination(120)
        assert q.exception() is None

    for i, name in enumerate(("a.txt", "c.txt", "f.txt")):
        (src / name).write_bytes(TEXTS[name].encode())
        os.utime(src / name, (1.7e9 + i, 1.7e9 + i))
        run()
    run()  # nothing new
    assert got(spark.read.parquet(out), str(src)) == want({"a.txt", "c.txt", "f.txt"})
