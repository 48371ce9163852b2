"""Round trips through archives, revisits, pushdown and skipped payloads."""

import gzip
import hashlib

from pyspark.sql import datasource as DS

from tidewatch.llm import warc

BODIES = [
    None, "", "short", "x" * 1000, "x" * 1000, "é" * 500, "é" * 500, "WARC/1.1\r\n\r\n" * 200, "a\r\n\r\nWARC/1.1 b" * 99,
    "y" * 999, "y" * 999, "漢字 \x00 end" * 40_000,
]


def frame(spark, ids=None):
    rows = [(i, f"http://h/{i} \r\nX: y", b, "k", "t") for i, b in zip(ids or range(len(BODIES)), BODIES, strict=True)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size string")


def written(spark, tmp_path, pages, **options):
    place = f"file://{tmp_path}/w"
    warc.write(pages, place, **options)
    return place


def test_round_trip_and_revisits(spark, tmp_path):
    place = written(spark, tmp_path, frame(spark), per_file=2)
    found = {r.page_id: r for r in warc.restored(warc.read(spark, place)).collect()}
    assert len(found) == len(BODIES)
    for i, body in enumerate(BODIES):
        data = (body or "").encode()
        same = [j for j, other in enumerate(BODIES) if (other or "").encode() == data]
        refers = max(same) if len(data) >= 1000 and i != max(same) else None
        kind = "response" if refers is None else "revisit"
        assert tuple(found[i]) == (i, len(data), hashlib.sha1(data).hexdigest(), kind, refers)
    texts = {r.record_id: r.payload for r in warc.read(spark, place).collect()}
    assert texts["<urn:page:11>"] == BODIES[11].encode() and texts["<urn:page:3>"] is None


def test_null_and_repeated_keys(spark, tmp_path):
    ids = [None, None, 2, None, 4, 5, 5, None, None, 9, 9, 11]
    place = written(spark, tmp_path, frame(spark, ids))
    rows = warc.restored(warc.read(spark, place)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in rows if r.refers_to or r.page_id == 5) == [
        (-1, "revisit", 4), (5, "response", None), (5, "response", None),
    ]
    assert len(rows) == len(ids)


def test_empty_table(spark, tmp_path):
    place = written(spark, tmp_path, frame(spark).limit(0))
    assert warc.read(spark, place).count() == 0


def test_predicates_are_decided_by_the_reader(spark, tmp_path):
    place = written(spark, tmp_path, frame(spark))
    records = warc.read(spark, place)
    chosen = records.where("record_type = 'revisit' AND refers_to IN ('<urn:page:4>', '<urn:page:6>')")
    assert sorted(r.record_id for r in chosen.collect()) == ["<urn:page:3>", "<urn:page:5>"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan
    bare = warc.read(spark, place, payload=False).where("content_length > 1000 AND target_uri LIKE 'http://h/1%'")
    assert {r.payload for r in bare.collect()} == {None}


class Counting:
    """A file that notes how many bytes were read."""

    def __init__(self, data):
        self.data, self.at, self.count = data, 0, 0

    def read(self, n):
        found = self.data[self.at:self.at + n]
        self.at += len(found)
        self.count += len(found)
        return found

    def seek(self, n, whence):
        self.at += n


def record(kind, block, extra=""):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <a>\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_unwanted_payloads_are_not_read():
    data = record("resource", b"z" * 5_000_000) + record("response", b"plain") + record("metadata", b"q" * 3_000_000)
    reader = warc.WarcReader("unused", True, 1)
    assert list(reader.pushFilters([DS.EqualTo(("record_type",), "response"), DS.IsNotNull(("record_type",))])) == []
    assert len(list(reader.pushFilters([DS.EqualTo(("payload",), b"")]))) == 1
    file = Counting(data)
    assert [r["payload"] for r in reader.records(file)] == [b"plain"]
    assert file.count < 300_000


def test_reads_compressed_members_and_plans_files(spark, tmp_path):
    for i in range(3):
        parts = [record("response", b"one"), record("response", b"HTTP/1.1 200 OK\r\n\r\ntwo",
                 "Content-Type: application/http\r\n")]
        (tmp_path / f"f{i}.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert sorted(r.payload for r in warc.read(spark, str(tmp_path)).collect()) == [b"one"] * 3 + [b"two"] * 3
    size = (tmp_path / "f0.warc.gz").stat().st_size
    plan = [len(p.paths) for p in warc.WarcReader(str(tmp_path), True, 2 * size).partitions()]
    assert plan == [2, 1]
