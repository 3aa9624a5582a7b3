"""Builds that skip what hasn't changed, tables changed by buckets, and histories laid out for paging."""

import io
import os
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plazaworks.operators import buckets, library, mutations, paging, rebuild, timeline
from plazaworks.sources import archives, downloads

STATE = "k int, page_sha256 string, digested boolean, agent_version string, zip_sha256 string, zip_etag string"
PAGES = "k int, page_sha256 string, zip_url string"
ANSWERS = "k int, status int, sha256 string, etag string, too_large boolean, opened boolean"


def by_key(df, *columns):
    return {r.k: tuple(r[c] for c in columns) for r in df.collect()}


def files(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def test_fingerprint_of_a_page(spark):
    rows = spark.createDataFrame([("T", "I", [("h", "b"), (None, "c")]), ("T", None, []), (None, None, None)], "t string, i string, s array<struct<heading:string,body:string>>")
    found = rows.select(rebuild.page_fingerprint(F.col("t"), F.col("i"), F.col("s")).alias("f")).collect()
    want = spark.range(1).select(F.sha2(F.lit("T\nI\nh\nb\n\nc"), 256).alias("a"), F.sha2(F.lit("T\n"), 256).alias("b")).first()
    assert [r.f for r in found[:2]] == [want.a, want.b]


@pytest.fixture
def build(spark):
    state = spark.createDataFrame([
        (1, "same", True, "v2", None, None),
        (2, "same", True, "v2", "z", "e"),
        (3, "same", True, "v2", "z", "e"),
        (4, "other", True, "v2", "z", "e"),
        (5, "same", True, "v1", None, None),
        (6, "same", False, None, None, None),
        (7, "same", True, "v2", "z", "e"),
        (8, "same", True, "v2", "z", "e"),
        (9, "same", True, "v2", "z", None),
        (10, "same", True, "v2", "z", "e"),
        (12, "same", None, "v2", None, None),
        (13, "gone", True, "v1", "q", "r"),
    ], STATE)
    pages = spark.createDataFrame([(k, None if k == 10 else "same", "a" if k in (2, 3, 4, 8, 9, 14, 15) else None) for k in (*range(1, 13), 14, 15)], PAGES)
    return pages, state


def test_plan_of_a_build(spark, build):
    pages, state = build
    found = by_key(rebuild.planned(pages, state, "k", "v2"), "work", "etag")
    assert found == {
        1: ("skip", None), 2: ("download", "e"), 3: ("download", "e"), 4: ("download", None), 5: ("page", None), 6: ("page", None), 7: ("page", "e"), 8: ("download", "e"),
        9: ("download", None), 10: ("failed", None), 11: ("page", None), 12: ("page", None), 14: ("download", None), 15: ("download", None)}
    forced = by_key(rebuild.planned(pages, state, "k", "v2", force=True), "work", "etag")
    assert forced[1] == ("page", None) and forced[2] == ("download", None)


def test_answers_and_the_state_after_a_build(spark, build):
    pages, state = build
    answers = spark.createDataFrame([
        (2, 304, None, "e", False, None),
        (3, 200, "z", "e2", False, False),
        (4, 200, "z", "e2", False, True),
        (8, 200, None, None, True, None),
        (9, 404, None, None, False, None),
        (14, 200, "w", "e3", False, False),
    ], ANSWERS)
    done = rebuild.settled(rebuild.planned(pages, state, "k", "v2"), answers, "k").cache()
    found = by_key(done, "work", "note", "zip_sha256", "zip_etag")
    none = (None, None, None)
    assert found == {
        1: ("skip", *none), 2: ("skip", *none), 3: ("skip", *none), 4: ("archive", None, "z", "e2"), 5: ("page", *none), 6: ("page", *none), 7: ("page", *none),
        8: ("page", "too large", None, None), 9: ("page", "status 404", None, None), 10: ("failed", *none), 11: ("page", *none), 12: ("page", *none),
        14: ("page", "not opened", "w", None), 15: ("failed", *none)}
    failures = spark.createDataFrame([(5,), (6,), (1,), (5,)], "k int")
    said = {k: v for k, (v,) in by_key(rebuild.outcomes(done, failures, "k"), "outcome").items()}
    assert {k for k in said if said[k] == "failed"} == {5, 6, 10, 15} and {k for k in said if said[k] == "skipped"} == {1, 2, 3}
    assert tuple(library.outcome_counts(rebuild.outcomes(done, failures, "k")).first()) == (7, 3, 4)
    after = by_key(rebuild.state_after(state, done, failures, "k", "v2"), *rebuild.STATE)
    assert after[4] == ("same", True, "v2", "z", "e2") and after[2] == ("same", True, "v2", "z", "e")
    assert after[5] == ("same", True, "v1", None, None) and after[6] == ("same", False, None, None, None)
    assert after[7] == ("same", True, "v2", None, None) and after[14] == ("same", True, "v2", "w", None)
    assert after[10] == ("same", True, "v2", "z", "e") and after[13] == ("gone", True, "v1", "q", "r") and after[15] == ("same", False, None, None, None)
    assert {r.k for r in rebuild.to_read(pages, done, "k").collect()} == {4, 5, 6, 7, 8, 9, 11, 12, 14}
    again = rebuild.planned(pages.filter("k in (4, 7, 11)"), rebuild.state_after(state, done, failures, "k", "v2"), "k", "v2")
    assert by_key(again, "work", "etag") == {4: ("download", "e2"), 7: ("skip", None), 11: ("skip", None)}
    done.unpersist()


def site_page(n, intro):
    zipped = f'<a href="/files/{n}.zip">all files</a>' if n != 1 else ""
    return f'<h2 class="page-title">Garden {n}</h2><div class="text-content"><p>{intro}</p><h4>Who</h4><p>Neighbours {n}.</p>{zipped}<h2'


def test_builds_from_pages_and_archives(spark, tmp_path):
    """Three builds one after the other, from the pages' HTML and a server's answers to what a later step reads."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("a.txt", "words")
    bodies = {"2": packed.getvalue(), "3": packed.getvalue() + b" ", "4": b"no archive"}

    def fetch(url, etag):
        n = url.rpartition("/")[2][0]
        return downloads.Answer(304) if n == "2" and etag == "tag 2" else downloads.Answer(200, iter((bodies[n],)), None if n == "3" else f"tag {n}")

    def build(pages, state, number):
        read = spark.createDataFrame([(k, f"https://x.test/{k}", html) for k, html in pages.items()], "k int, url string, html string")
        details = read.join(library.detail_pages(read, "https://x.test"), "url")
        now = details.select("k", rebuild.page_fingerprint(F.col("title"), F.col("intro"), F.col("sections")).alias("page_sha256"), "zip_url")
        plan = rebuild.planned(now, state, "k", "v1")
        folder = f"file://{tmp_path}/{number}"
        (tmp_path / str(number)).mkdir()
        urls = plan.filter("work = 'download'").select("k", F.col("zip_url").alias("url"), "etag")
        downloads.downloaded(urls, fetch, folder, wait_s=0).write.parquet(f"{folder}-answers")
        answers = spark.read.parquet(f"{folder}-answers")
        kept = [r.file for r in answers.filter("file IS NOT NULL").collect()]
        listed = archives.listed_archives(spark, folder) if kept else spark.createDataFrame([], archives._MEMBER)
        done = rebuild.settled(plan, rebuild.with_opened(answers, listed), "k")
        none = spark.createDataFrame([], "k int")
        work = {r.k: r.work for r in done.collect()}
        assert {r.k for r in rebuild.to_read(read, done, "k").collect()} == {k for k in work if work[k] in ("page", "archive")}
        rows = rebuild.state_after(state, done, none, "k", "v1").collect()
        return work, spark.createDataFrame(rows, STATE)

    pages = {n: site_page(n, f"About {n}") for n in (1, 2, 3, 4)}
    work, state = build(pages, spark.createDataFrame([], STATE), 1)
    assert work == {1: "page", 2: "archive", 3: "archive", 4: "page"}
    # The same again: one is the same by its page, one by its ETag, two by their digests, be they archives or not.
    work, state = build(pages, state, 2)
    assert set(work.values()) == {"skip"}
    # A changed page is digested, and its archive asked for without an ETag.
    work, state = build(pages | {2: site_page(2, "Other words")}, state, 3)
    assert work == {1: "skip", 2: "archive", 3: "skip", 4: "skip"}


def test_a_build_of_nothing(spark):
    pages, state = spark.createDataFrame([], PAGES), spark.createDataFrame([], STATE)
    done = rebuild.settled(rebuild.planned(pages, state, "k", "v"), spark.createDataFrame([], ANSWERS), "k")
    assert rebuild.state_after(state, done, spark.createDataFrame([], "k int"), "k", "v").count() == 0


def upserted(old, new):
    return mutations.upsert(old, new, ["k"], ["b"])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select("id", F.col("id").alias("k"), F.lit("old").alias("a"), F.lit("kept").alias("b")).drop("id")
    buckets.create(rows, path, ["k"], 16)
    before = files(path)
    batch = spark.createDataFrame([(7, "new", None), (5000, "new", "x")], "k int, a string, b string")
    touched = buckets.change(spark, path, ["k"], batch, 1, upserted)
    assert 1 <= len(touched) <= 2
    after = files(path)
    outside = lambda found: {f: v for f, v in found.items() if not any(f"_bucket={b}{os.sep}" in f for b in touched)}
    assert outside(after) == outside(before) and len(outside(after)) >= 14 and after != before
    found = {r.k: (r.a, r.b) for r in buckets.snapshot(spark, path).collect()}
    assert len(found) == 1001 and found[7] == ("new", "kept") and found[5000] == ("new", "x") and found[8] == ("old", "kept")
    # The same batch again, and an older one, change no file; nor does an empty one.
    assert buckets.change(spark, path, ["k"], batch, 1, upserted) == [] and files(path) == after
    assert buckets.change(spark, path, ["k"], batch.limit(0), 2, upserted) == [] and files(path) == after


def test_a_batch_that_ended_in_the_middle_is_completed(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(spark.range(100).withColumnRenamed("id", "k").withColumn("n", F.lit(0)), path, ["k"], 4)
    one_more = lambda old, new: old.join(new, "k", "left").select("k", (F.col("n") + F.coalesce("m", F.lit(0))).cast("int").alias("n"))
    batch = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("m"))
    half = batch.filter(buckets.bucket_of(["k"], 4) < 2)
    assert buckets.change(spark, path, ["k"], half, 1, one_more) == [0, 1]
    assert buckets.change(spark, path, ["k"], batch, 1, one_more) == [2, 3]
    assert [tuple(r) for r in buckets.snapshot(spark, path).groupBy("n").count().collect()] == [(1, 100)]


def test_an_empty_bucket_keeps_its_mark_and_a_lost_one_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(spark.createDataFrame([(1, None), (None, "x")], "k int, v string"), path, ["k"], 4)
    forget = lambda old, new: old.join(new, "k", "left_anti")
    touched = buckets.change(spark, path, ["k"], spark.createDataFrame([(1,)], "k int"), 3, forget)
    assert [tuple(r) for r in buckets.snapshot(spark, path).collect()] == [(None, "x")]
    assert buckets.marks(spark, path)[touched[0]] == 3 and sum(buckets.marks(spark, path).values()) == 3
    (tmp_path / "t" / "_bucket=2").rename(tmp_path / "lost")
    with pytest.raises(ValueError, match=r"\[2\]"):
        buckets.marks(spark, path)
    with pytest.raises(ValueError, match="_mark"):
        buckets.create(spark.range(1).withColumn("_MARK", F.lit(1)), str(tmp_path / "u"), ["id"])


def log_of(spark, seed, first, n, users=7, days=200):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdefg"[:users]), f"m{first + i:06d}", rng.randrange(days * 86400), rng.choice(["user", "assistant", "tool"])) for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, id string, s long, role string").withColumn("created", F.timestamp_seconds(F.col("s") + 1700000000)).drop("s")


def test_pages_of_a_stored_history(spark, tmp_path):
    path, log = str(tmp_path / "h"), log_of(spark, 1, 0, 600)
    timeline.append(log.filter("id < 'm000300'"), path, 1, buckets=4)
    for _ in range(2):
        timeline.append(log.filter("id >= 'm000300'"), path, 2, buckets=4)
    whole = sorted((r.created, r.id) for r in log.filter("user_id = 'c'").collect())
    seen, before = [], None
    while True:
        rows = timeline.page(spark, path, "c", before, 17, buckets=4).collect()
        assert rows and set(rows[0].asDict()) == {"user_id", "id", "created", "role"} or not rows
        if not rows:
            break
        seen, before = [(r.created, r.id) for r in rows] + seen, (rows[0].created, rows[0].id)
    assert seen == whole
    assert timeline.position_of(spark, path, "c", whole[5][1], 4) == whole[5]
    assert timeline.position_of(spark, path, "d", whole[5][1], 4) is None
    assert timeline.page(spark, path, "nobody", None, 5, buckets=4).count() == 0


def scanned(spark, df):
    """Files that the scans of a query have opened."""
    df.collect()
    nodes, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numFiles"):
            nodes += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return nodes


def test_a_page_opens_as_many_files_of_a_table_ten_times_as_long(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        opened = []
        for days in (100, 1000):
            path = str(tmp_path / str(days))
            log = spark.range(days * 20).select(F.concat(F.lit("u"), F.col("id") % 10).alias("user_id"), "id", F.timestamp_seconds(F.lit(1700000000) - F.col("id") * 4320).alias("created"))
            timeline.append(log, path, 1, buckets=2)
            found = timeline.page(spark, path, "u3", None, 10, buckets=2)
            opened.append(scanned(spark, found))
            assert [r.id for r in found.collect()] == list(range(93, 0, -10))
        # A period's rows of a bucket are in one file, or in two where the writers' ranges part.
        assert 1 <= min(opened) and max(opened) <= 4 and len(files(tmp_path / "1000" / "messages")) > 60
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("turns", [0, 1, 2, 5, 400])
def test_recent_turns_and_what_is_older(spark, turns):
    log = log_of(spark, 4, 0, 300, users=5, days=1).unionByName(log_of(spark, 5, 900, 1, users=1, days=1).withColumn("user_id", F.lit("z")).withColumn("role", F.lit("tool")))
    recent, older, through = set(), {}, {}
    by_user = {}
    for r in log.collect():
        by_user.setdefault(r.user_id, []).append((r.created, r.id, r.role))
    for user, rows in by_user.items():
        rows.sort()
        said = sum(r[2] == "user" for r in rows)
        for i, r in enumerate(rows):
            if sum(x[2] == "user" for x in rows[i + 1:]) < turns:
                recent.add(r[1])
            elif said > turns:
                older[user], through[user] = older.get(user, 0) + 1, r[1]
    assert {r.id for r in paging.recent_turns(log, turns).collect()} == recent
    assert {r.user_id: (r.n, r.through) for r in paging.older_than_recent(log, turns).collect()} == {u: (older[u], through[u]) for u in older}
