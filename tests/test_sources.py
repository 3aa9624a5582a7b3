import hashlib
import io
import json
import zipfile
from pathlib import Path

import pytest

from plazaworks.sources import archives, downloads
from plazaworks.sources.embed import vectors_in_order
from plazaworks.sources.pages import fetched, geocoded, page_source, places_found, rejected_private
from plazaworks.sources.pins import read_pins


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:document>")
    return out.getvalue()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("docs/one.docx", docx("First &amp; best", "Second"))
        z.writestr("two.txt", "Załączniki".encode() + b"\xff")
        z.writestr("broken.docx", b"no archive")
        z.writestr("empty.odt", docx("x"))
        z.writestr("three.rtf", r"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'f3r\u322?d}")
        z.writestr("four.pdf", b"%PDF")
        for skipped in ("dir/", "__MACOSX/x.txt", ".hidden", "../up.txt", "/root.txt"):
            z.writestr(skipped, b"")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    found = {r.path: r for r in archives.read_archives(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {"docs/one.docx", "two.txt", "three.rtf", "four.pdf", "broken.docx", "empty.odt", None}
    assert found["broken.docx"].note.startswith("unreadable: BadZipFile") and found["empty.odt"].note.startswith("unreadable: KeyError") and found["empty.odt"].sha256
    assert found["docs/one.docx"].text == "First & best\nSecond" and found["docs/one.docx"].kind == "docx"
    assert found["two.txt"].text == "Załączniki�" and found["three.rtf"].text == "Hello\nWórłd"
    assert found["four.pdf"].text is None and found["four.pdf"].note and found[None].note.startswith("unreadable")


def test_members_with_faults_are_rows_with_notes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "fine")
        z.writestr("damaged.txt", "text " * 500)
        z.writestr("locked.txt", "secret")
        z.writestr("strange.txt", "packed by an unknown method")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    # A member's own header ends with its name, and so does its entry in the archive's directory.
    own, entry = (lambda x: raw.index(x.encode()) - 30), (lambda x: raw.rindex(x.encode()) - 46)
    raw[own("damaged.txt") + 45 : own("damaged.txt") + 55] = b"\xff" * 10
    raw[own("locked.txt") + 6] |= 1
    raw[entry("locked.txt") + 8] |= 1
    raw[own("strange.txt") + 8] = raw[entry("strange.txt") + 10] = 99
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    listed = archives.listed_archives(spark, f"file://{tmp_path}")
    assert sorted((r.ordinal, r.path, r.byte_len) for r in listed.collect()) == [(0, "good.txt", 4), (1, "damaged.txt", 2500), (2, "locked.txt", 6), (3, "strange.txt", 27)]
    found = {r.path: r for r in archives.read_members(listed).collect()}
    assert found["good.txt"].text == "fine" and found["good.txt"].note is None
    assert all(found[f"{x}.txt"].note.startswith("unreadable: ") and found[f"{x}.txt"].text is None for x in ("damaged", "locked", "strange"))
    assert [r.text for r in archives.read_members(listed.filter("path = 'good.txt'")).collect()] == ["fine"]


def test_downloads(spark, tmp_path):
    def fetch(url, etag):
        if url == "same":
            assert etag == "v1"
            return downloads.Answer(304)
        if url == "claims":
            return downloads.Answer(200, (b"x",), "e", None, 10**12)
        if url == "flaky":
            raise OSError("no route")
        bodies = {"good": (b"abc", b"def"), "large": (b"x" * 60,) * 3, "empty": ()}
        return downloads.Answer(200, iter(bodies[url]), f"of {url}", "then") if url in bodies else downloads.Answer({"gone": 404, "busy": 503}[url])

    urls = spark.createDataFrame([(x, "v1" if x == "same" else None, k) for k, x in enumerate(["same", "claims", "flaky", "good", "large", "empty", "gone", "busy"])], "url string, etag string, n int")
    folder = f"file://{tmp_path}/archives"
    found = {r.url: r for r in downloads.downloaded(urls, fetch, folder, cap=100, wait_s=0).collect()}
    assert [found[x].n for x in ("same", "busy")] == [0, 7] and found["same"].status == 304 and found["same"].etag == "v1" and found["same"].file is None
    assert found["good"].sha256 == hashlib.sha256(b"abcdef").hexdigest() and found["good"].byte_len == 6 and found["good"].etag == "of good" and found["good"].last_modified == "then"
    assert Path(found["good"].file.removeprefix("file://")).read_bytes() == b"abcdef" and found["empty"].byte_len == 0
    assert all(found[x].too_large and found[x].file is None for x in ("claims", "large")) and not found["good"].too_large
    assert found["gone"].status == 404 and found["busy"].status is None and "503" in found["busy"].note and "no route" in found["flaky"].note
    assert len(list((tmp_path / "archives").iterdir())) == 2  # nothing is left of the others


def test_pins(spark, tmp_path):
    (tmp_path / "events.json").write_text(json.dumps([{"id": "a", "emoji": "☕", "title": "Tea", "signedCount": 2, "capacity": None, "latitude": 50.1, "longitude": 20, "hostName": "Z"}, {"id": "b"}], indent=1))
    rows = {r.id: r for r in read_pins(spark, f"file://{tmp_path}/events.json").collect()}
    assert (rows["a"].signed_count, rows["a"].capacity, rows["a"].longitude, rows["a"].host_name, rows["a"].starts_at) == (2, None, 20.0, "Z", None) and rows["b"].title is None


def test_geocoding(spark):
    class Map:
        def search(self, fields):
            if fields["q"] == "down":
                raise OSError("down")
            return json.dumps([fields])

    df = spark.createDataFrame([(1, " Long Street 7 "), (2, "x" * 400), (3, " "), (4, None), (5, "down")], "k int, query string")
    rows = {r.k: r for r in geocoded(df, Map()).collect()}
    sent = json.loads(rows[1].answer)[0]
    assert sent["q"] == "Long Street 7" and sent["limit"] == "5" and sent["countrycodes"] == "pl" and sent["viewbox"] == "19.05,50.52,21.5,49.15" and len(json.loads(rows[2].answer)[0]["q"]) == 180
    assert rows[3].error == rows[4].error == "empty query" and rows[5].error == "OSError: down" and rows[1].error is None


def test_private_places_alone_are_rejected(spark):
    home, cafe = {"category": "building", "type": "house", "name": "H", "lat": "50", "lon": "20"}, {"category": "amenity", "type": "cafe", "name": "C", "lat": "50", "lon": "20"}
    df = spark.createDataFrame([(1, json.dumps([home])), (2, json.dumps([home, cafe])), (3, json.dumps([{**cafe, "lat": "1"}])), (4, "[]"), (5, None), (6, json.dumps([home, {**cafe, "name": ""}]))], "k int, a string")
    assert {r.k: r.rejected_private for r in rejected_private(df, "k", "a").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_answers_of_an_embedding_service_are_put_in_order():
    assert vectors_in_order([(1, [3.0, 4.0]), (0, [1.0, 2.0])], 2, 2) == [[1.0, 2.0], [3.0, 4.0]] and vectors_in_order([], 0, 2) == []
    for items, expected in (([(0, [1.0, 2.0])], 2), ([(0, [1.0, 2.0]), (2, [1.0, 2.0])], 2), ([(0, [1.0])], 1), ([(0, [1.0, 2.0]), (0, [1.0, 2.0])], 2)):
        with pytest.raises(ValueError):
            vectors_in_order(items, expected, 2)


def test_names_of_old_archives():
    # A name that an old program wrote in its own code page, which the archive's reader takes for another.
    for name in ("gęśl i pąk.txt", "żółw/ćma.odt"):
        info = zipfile.ZipInfo("x")
        info.orig_filename = name.encode("cp852").decode("cp437")
        assert archives.entry_name(info) == name
    assert archives.decoded("żuraw".encode("iso-8859-2"), "text/plain; charset=ISO-8859-2") == "żuraw" and archives.decoded(b"\xfe") == "�" and archives.decoded(b"plain", "charset=unheard-of") == "plain"


def test_members_of_archives_that_are_gone_are_rows(spark, tmp_path):
    for name in ("kept.zip", "gone.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.txt", name)
            z.writestr("b.txt", name)
    listed = spark.createDataFrame(archives.listed_archives(spark, f"file://{tmp_path}").collect(), archives._MEMBER)
    (tmp_path / "gone.zip").unlink()
    rows = [(r.archive.rsplit("/", 1)[1], r.path, r.text, (r.note or "").split(":")[0]) for r in archives.read_members(listed).collect()]
    assert sorted(rows, key=str) == [("gone.zip", "a.txt", None, "unreadable"), ("gone.zip", "b.txt", None, "unreadable"), ("kept.zip", "a.txt", "kept.zip", ""), ("kept.zip", "b.txt", "kept.zip", "")]


def test_fetching_asks_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def fetch(url):
        calls.add(1)
        return {"ok": (200, "page"), "gone": (404, None), "busy": (503, None)}[url]

    df = spark.createDataFrame([("ok",), ("gone",), ("busy",)], "url string").coalesce(1)
    assert {(r.url, r.status, r.html) for r in fetched(df, fetch, wait_s=0).collect()} == {("ok", 200, "page"), ("gone", 404, None), ("busy", 503, None)}
    assert calls.value == 5


def test_pages_as_a_data_source(spark):
    spark.dataSource.register(page_source(lambda url: (200, f"<p>{url}") if "ok" in url else (404, None), wait_s=0))
    read = spark.read.format("pages").option("urls", "http://ok/1\n\n http://ok/2 \nhttp://gone\n").option("together", "2").load()
    assert read.rdd.getNumPartitions() == 2 and {tuple(r) for r in read.collect()} == {("http://ok/1", 200, "<p>http://ok/1"), ("http://ok/2", 200, "<p>http://ok/2"), ("http://gone", 404, None)}
    assert spark.read.format("pages").load().count() == 0


def test_places(spark):
    def mapped(category, kind, lat="49.9", lon="20.4", **more):
        return {"category": category, "type": kind, "display_name": "Reading room, Upper Village, Poland", "lat": lat, "lon": lon, "name": None, "address": {}} | more

    answer = [
        mapped("place", "farm", name="Old mill"), mapped("amenity", "library", name="Reading room", address={"road": "Elm Lane", "city": "Upper Village"}), mapped("highway", "bus_stop", name="Stop"),
        mapped("leisure", "park", name=" ", address={"leisure": "Beech garden", "house_number": "3"}), mapped("leisure", "park", lat="north"), mapped("leisure", "garden", lon="2.4", name="Paris"),
        mapped("tourism", "museum", name="Museum"), mapped("leisure", "park", name="A fourth"),
    ]
    df = spark.createDataFrame([(7, json.dumps(answer)), (8, "{}"), (9, None), (10, "[1"), (11, json.dumps(answer[:1]))], "k int, a string")
    rows = [(r.k, r.name, r.address, r.kind) for r in places_found(df, "k", "a").orderBy("k", "n").collect()]
    shown = "Reading room, Upper Village, Poland"
    assert rows == [(7, "Reading room", "Elm Lane, Upper Village", "hall"), (7, "Beech garden", shown, "park"), (7, "Museum", shown, "other_public")]
