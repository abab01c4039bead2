import hashlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from costloom.llm import warc
from costloom.session import scratch_path


def pages():
    long = "<html>" + "é漢\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(i, f"http://h/{i}\n100%0A", f"{long}{i % 7}") for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", ""), (53, "u", "x" * 99), (54, "u", "x" * 99), (55, "u", "x" * 100), (56, "u", "x" * 100)]
    rows += [(57, "u", "é" * 50), (58, "v", "é" * 50), (None, "u", long + "0"), (60, "u", "y" * 3_000_000), (0, "again", long + "0")]
    return rows


def expected(rows):
    """(id, bytes, digest, kind, first) of each row."""
    first, out = {}, []
    for i, _, html in rows:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    for i, _, html in rows:
        data = (html or "").encode()
        revisits = i is not None and len(data) >= 100 and i > first[html]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisits else "response", first[html] if revisits else None))
    return sorted(out, key=str)


@pytest.fixture
def written(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 4096)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 500)
    docs = spark.createDataFrame([(*r, 1) for r in pages()], "page_id long, url string, html string, digest int").repartition(3)
    return warc.write_bundles(docs, scratch_path(spark, "warc"))


def test_round_trip(spark, written):
    found = warc.read_bundles(written).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str)
    assert got == expected(pages())
    html = {i: h for i, _, h in pages() if i is not None}
    url = {i: u for i, u, _ in pages() if i}
    for row in found:
        if row["record_type"] == "response" and row["page_id"] is not None:
            assert row["payload"].decode() == (html[row["page_id"]] or "")
        if row["page_id"]:
            assert row["url"] == url[row["page_id"]]


def test_digests_too_many_to_broadcast_are_joined(spark, monkeypatch):
    """The other route to the revisits, with one digest that counts as hot."""
    lookup = warc.joins.lookup
    monkeypatch.setattr(warc.joins, "lookup", lambda *given, **named: lookup(*given, **named, max_rows=0, hot_rows=3))
    docs = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    found = warc.read_bundles(warc.write_bundles(docs, scratch_path(spark, "warc"))).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=str) == expected(pages())


def test_tasks_of_a_read_follow_the_bytes(spark, written, monkeypatch):
    packed = written.select("bundle", "frame_at", "frame_size").distinct().agg(F.sum("frame_size")).first()[0]
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    assert warc.read_bundles(written).rdd.getNumPartitions() == -(-packed // 1000) > 3
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 30)
    assert warc.read_bundles(written).rdd.getNumPartitions() == 1


def test_bundles_are_seekable_zstandard(spark, written):
    import zstandard

    assert written.select("bundle").distinct().count() > 3
    place = written.orderBy(F.desc("frame")).first()["bundle"]
    files, path = pafs.FileSystem.from_uri(place)
    with files.open_input_stream(path, compression=None) as file:
        data = file.read()
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    whole, frames = reader.read(), written.where(F.col("bundle") == place).select("frame").distinct().count()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID") == written.where(F.col("bundle") == place).count()
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little") and int.from_bytes(data[-9:-5], "little") == frames


def test_records_by_offset(spark, written):
    some = written.where("page_id in (3, 38, 60)")
    assert sorted(r["page_id"] for r in warc.fetch_records(some).collect()) == [3, 38, 60]


def test_damage_is_noticed(spark, written):
    place = written.where("page_id = 60").first()["bundle"]
    files, path = pafs.FileSystem.from_uri(place)
    with files.open_input_stream(path, compression=None) as file:
        data = bytearray(file.read())
    data[40] ^= 0xFF
    with files.open_output_stream(path, compression=None) as file:
        file.write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017  the task's error
        warc.read_bundles(written).collect()


def test_empty_table(spark):
    index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "warc"))
    assert index.count() == 0 and warc.read_bundles(index).count() == 0
