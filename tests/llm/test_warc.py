import gzip
import hashlib
from collections import Counter

from plazaworks.llm import warc
from plazaworks.llm.shared import filesystem, shared_dir

LONG = "<p>" + "é word " * 300


def plain(rows):
    payloads = [(r[2] or "").encode() for r in rows]
    out = []
    for row, payload in zip(rows, payloads, strict=True):
        twins = [r[0] for r, p in zip(rows, payloads, strict=True) if p == payload and r[0] is not None]
        top = max(twins, default=None) if len(payload) >= 1000 and payloads.count(payload) > 1 else None
        revisit = top is not None and row[0] != top
        out.append((row[0], len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


ROWS = [(k, f"http://a/{k}?x=é b\r\nc", t, "d") for k, t in enumerate([LONG, LONG, LONG + "!", "short", "short", None, "", "WARC/1.1\r\n\r\n\r\n", "x" * 1000, "x" * 1000, "x" * 999, "x" * 999])]
ROWS += [(None, None, LONG, None), (None, None, "y" * 2000, None), (None, None, "y" * 2000, None), (40, "u", "z" * 5000, "d"), (40, "u", "z" * 5000, "d"), (39, "u", "z" * 5000, "d")]


def test_round_trip_equals_brute_force(spark):
    df = frame(spark, ROWS)
    assert Counter(map(tuple, warc.archive_round_trip(df).collect())) == plain(ROWS)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_many_copies_are_met_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "SENT_COPIES", 0)
    assert Counter(map(tuple, warc.archive_round_trip(frame(spark, ROWS)).collect())) == plain(ROWS)


def test_archives_and_selected_reads(spark):
    df = frame(spark, ROWS)
    folder = shared_dir(spark, "test-warc")
    index = warc.write_archives(df, folder, file_bytes=900)
    rows = index.collect()
    assert len({r.file for r in rows}) > 3  # files roll over
    for r in rows:
        system, path = filesystem(r.file)
        data = system.open_input_file(path).read()
        fields, payload = warc.parsed(gzip.decompress(data[r.offset : r.offset + r.length]))
        assert fields["warc-type"] == r.record_type and (payload is None) == (r.refers_to is not None)
    for name in {r.file for r in rows}:  # members follow one another without a gap
        system, path = filesystem(name)
        whole = gzip.decompress(system.open_input_file(path).read())
        assert whole.count(b"\r\nWARC-Type: ") == sum(r.file == name for r in rows)
    html = {r[0]: r[2] or "" for r in ROWS}
    some = warc.read_archives(index.filter("page_id % 3 = 2")).collect()
    assert {r.page_id: r.payload for r in some if r.record_type == "response"} == {k: html[k] for k in (2, 5, 8, 11) if k not in (8,)}
    full = warc.with_payloads(warc.read_archives(index)).filter("page_id IS NOT NULL").collect()
    assert all(r.payload == html[r.page_id] for r in full) and len(full) == len([r for r in ROWS if r[0] is not None])


def test_ranges_are_joined_and_bounded():
    rows = [{"file": "f", "offset": k * 1000, "length": 1000} for k in range(50)] + [{"file": "f", "offset": 10**7, "length": 10}, {"file": "g", "offset": 0, "length": 5}]
    assert [len(run) for run in warc._ranges(iter(rows))] == [50, 1, 1]
    long = [{"file": "f", "offset": k * warc.READ, "length": warc.READ} for k in range(3)]
    assert [len(run) for run in warc._ranges(iter(long))] == [1, 1, 1]


def test_empty_indexes_and_pages_without_ids(spark, tmp_path):
    schema = "page_id long, url string, html string"
    empty = warc.write_archives(spark.createDataFrame([], schema), f"file://{tmp_path}/empty")
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0 and warc.with_payloads(warc.read_archives(empty)).count() == 0
    pages = spark.createDataFrame([(None, "u", "x" * 2000), (5, None, "x" * 2000), (None, None, None), (None, "v", "y" * 2000)], schema)
    index = warc.write_archives(pages, f"file://{tmp_path}/pages")
    read = {(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, len(r.payload)) for r in warc.with_payloads(warc.read_archives(index)).collect()}
    assert read == {(None, "u", "revisit", 5, 2000, 2000), (5, None, "response", None, 2000, 2000), (None, None, "response", None, 0, 0), (None, "v", "response", None, 2000, 2000)}
