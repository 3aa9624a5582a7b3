"""Queries of builds that skip what hasn't changed, and of tables that are changed by buckets or laid out for paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazaworks.operators import buckets, library, mutations, rebuild, timeline
from plazaworks.plans.registry import ORACLES, query, table
from plazaworks.session import shared_folder

C = F.col
VERSION = 2

_BUILD = """WITH pages0 AS (SELECT page_id AS k, CASE WHEN page_id % 17 <> 0 THEN sha256(url || chr(10) || coalesce(html, '')) END AS page, CASE WHEN page_id % 4 <> 0 THEN url || '.zip' END AS zip_url FROM pages),
state AS (SELECT page_id AS k, CASE WHEN page_id % 5 <> 0 THEN sha256(url || chr(10) || coalesce(html, '')) ELSE sha256(url || chr(10) || 'old') END AS page, page_id % 11 <> 0 AS digested, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN page_id % 3 <> 0 THEN 'z' || page_id END AS zip, CASE WHEN page_id % 3 <> 0 THEN 'e' || page_id END AS etag FROM pages WHERE page_id % 13 <> 0),
plan AS (SELECT p.k, p.page, p.zip_url, coalesce(s.digested AND s.page = p.page AND s.version = 2, false) AS fresh, s.zip AS zip_before, s.etag AS old_etag FROM pages0 p LEFT JOIN state s USING (k)),
asked AS (SELECT *, CASE WHEN fresh THEN old_etag END AS etag, CASE WHEN page IS NULL THEN 'failed' WHEN zip_url IS NOT NULL THEN 'download' WHEN fresh AND zip_before IS NULL THEN 'skip' ELSE 'page' END AS work FROM plan),
answers AS (SELECT k, CASE WHEN etag IS NOT NULL AND k % 6 = 1 THEN 304 WHEN k % 10 = 1 THEN 404 ELSE 200 END AS status, CASE WHEN k % 8 = 1 THEN 'y' ELSE 'z' END || k AS sha256, k % 9 = 2 AS large, k % 14 <> 3 AS opened FROM asked WHERE work = 'download' AND k % 23 <> 0),
met AS (SELECT a.*, b.status, b.sha256, coalesce(b.large, false) AS large, b.opened, a.fresh AND a.zip_before IS NOT NULL AND a.zip_before = b.sha256 AS same FROM asked a LEFT JOIN answers b USING (k)),
done AS (SELECT k, page, CASE WHEN work <> 'download' THEN work WHEN status IS NULL THEN 'failed' WHEN status = 304 THEN 'skip' WHEN large OR status >= 300 THEN 'page' WHEN same THEN 'skip' WHEN NOT opened THEN 'page' ELSE 'archive' END AS work, CASE WHEN work = 'download' AND status <> 304 THEN CASE WHEN large THEN 'too large' WHEN status >= 300 THEN 'status ' || status WHEN NOT same AND NOT opened THEN 'not opened' END END AS note, sha256 FROM met),
kept AS (SELECT k, page, work, note, CASE WHEN work = 'archive' OR note = 'not opened' THEN sha256 END AS zip, CASE WHEN work = 'archive' THEN 'n' || k END AS etag, CASE WHEN work = 'failed' OR (k % 19 = 0 AND work <> 'skip') THEN 'failed' WHEN work = 'skip' THEN 'skipped' ELSE 'digested' END AS outcome FROM done)
"""


def _build(spark, d):
    """(state of the last build, what this one does, whose digest failed), of two states of the pages."""
    read, k = table(spark, d, "pages"), C("page_id")
    sha = library.fingerprint(C("url"), F.coalesce("html", F.lit("")))
    now = read.select("page_id", F.when(k % 17 != 0, sha).alias("page_sha256"), F.when(k % 4 != 0, F.concat("url", F.lit(".zip"))).alias("zip_url"))
    named = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    state = read.filter(k % 13 != 0).select(
        "page_id",
        F.when(k % 5 != 0, sha).otherwise(library.fingerprint(C("url"), F.lit("old"))).alias("page_sha256"),
        (k % 11 != 0).alias("digested"),
        F.when(k % 7 == 0, 1).otherwise(VERSION).alias("agent_version"),
        F.when(k % 3 != 0, named("z")).alias("zip_sha256"),
        F.when(k % 3 != 0, named("e")).alias("zip_etag"),
    )
    plan = rebuild.planned(now, state, "page_id", VERSION)
    answers = plan.filter((C("work") == "download") & (k % 23 != 0)).select(
        "page_id",
        F.when(C("etag").isNotNull() & (k % 6 == 1), 304).when(k % 10 == 1, 404).otherwise(200).alias("status"),
        F.when(k % 8 == 1, named("y")).otherwise(named("z")).alias("sha256"),
        named("n").alias("etag"),
        (k % 9 == 2).alias("too_large"),
        (k % 14 != 3).alias("opened"),
    )
    return state, rebuild.settled(plan, answers, "page_id"), read.filter(k % 19 == 0).select("page_id")


@query("rebuild_work", f"{_BUILD} SELECT k AS page_id, work, note, outcome FROM kept")
def rebuild_work(spark, d):
    """What a build does about each page, and what comes of it."""
    _, done, failures = _build(spark, d)
    return done.join(rebuild.outcomes(done, failures, "page_id"), "page_id").select("page_id", "work", "note", "outcome")


@query("rebuild_counts", f"{_BUILD} SELECT count(*) FILTER (outcome = 'digested') AS digested, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM kept")
def rebuild_counts(spark, d):
    _, done, failures = _build(spark, d)
    return library.outcome_counts(rebuild.outcomes(done, failures, "page_id"))


@query(
    "rebuild_state",
    f"""{_BUILD} SELECT k AS page_id, coalesce(n.page, s.page) AS page_sha256, coalesce(n.outcome = 'digested', false) OR coalesce(s.digested, false) AS digested, CASE WHEN n.outcome = 'digested' THEN 2 ELSE s.version END AS agent_version,
CASE WHEN n.outcome = 'digested' THEN n.zip ELSE s.zip END AS zip_sha256, CASE WHEN n.outcome = 'digested' THEN n.etag ELSE s.etag END AS zip_etag FROM kept n FULL JOIN state s USING (k)""",
)
def rebuild_state(spark, d):
    state, done, failures = _build(spark, d)
    return rebuild.state_after(state, done, failures, "page_id", VERSION)


@query("rebuild_reads", f"{_BUILD} SELECT page_id, length(html) AS n_chars FROM pages WHERE page_id IN (SELECT k FROM kept WHERE work IN ('page', 'archive'))")
def rebuild_reads(spark, d):
    """The pages that the steps after it read."""
    _, done, _ = _build(spark, d)
    return rebuild.to_read(table(spark, d, "pages"), done, "page_id").select("page_id", F.length("html").cast("long").alias("n_chars"))


@query("bucket_upsert", ORACLES["upsert_coalesce"])
def bucket_upsert(spark, d):
    """The upsert's rows from a table of buckets that is changed in place; the batch is run twice."""
    part, where = table(spark, d, "part"), shared_folder(spark, "parts")
    old = part.filter("p_partkey % 3 <> 0").select(C("p_partkey").alias("k"), C("p_name").alias("name"), C("p_type").alias("zip"))
    new = part.filter("p_partkey % 2 = 0").select(C("p_partkey").alias("k"), C("p_brand").alias("name"), F.when(C("p_partkey") % 4 == 0, C("p_brand")).alias("zip"))
    buckets.create(old, where, ["k"], 16)
    for _ in range(2):
        buckets.change(spark, where, ["k"], new, 1, lambda before, batch: mutations.upsert(before, batch, ["k"], ["zip"]))
    return buckets.snapshot(spark, where)


@query("bucket_children", ORACLES["replace_children"])
def bucket_children(spark, d):
    """Children replaced in a table whose buckets go by parent."""
    where = shared_folder(spark, "children")
    old = table(spark, d, "lineitem").select(C("l_orderkey").alias("parent"), C("l_linenumber").alias("child"), F.lit("old").alias("origin"))
    new = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(C("o_orderkey").alias("parent"), F.lit(0).alias("child"), F.lit("new").alias("origin"))
    buckets.create(old, where, ["parent"], 16)
    buckets.change(spark, where, ["parent"], new, 1, lambda before, batch: mutations.replace_children(before, batch, "parent"))
    return buckets.snapshot(spark, where)


_LOG = "SELECT user_id, event_id AS id, ts AS created FROM events"
_MOST = "(SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("history_page", f"SELECT user_id, id, created FROM ({_LOG}) WHERE user_id = {_MOST} ORDER BY created DESC, id DESC LIMIT 20 OFFSET 10")
def history_page(spark, d):
    """The second page of the user with most rows, of a history laid out for paging."""
    log, where = table(spark, d, "events").select("user_id", C("event_id").alias("id"), C("ts").alias("created")), shared_folder(spark, "history")
    timeline.append(log, where, 1, timeline.days(1), 8)
    user = log.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first().user_id  # one row
    oldest = timeline.page(spark, where, user, None, 10, timeline.days(1), 8).first()
    return timeline.page(spark, where, user, (oldest.created, oldest.id), 20, timeline.days(1), 8).select("user_id", "id", "created")
