"""A library built again: what has changed since the last build decides what is done, and the rest isn't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a build's state, of which there is a row for each document.
STATE = ("page_sha256", "digested", "agent_version", "zip_sha256", "zip_etag")


def page_fingerprint(title: Column, intro: Column, sections: Column) -> Column:
    """A digest of what a page says: title, intro, and the heading and body of each section (an array of structs), a line each. Nulls are empty."""
    said = lambda c: F.coalesce(c, F.lit(""))
    lines = F.flatten(F.transform(sections, lambda x: F.array(said(x["heading"]), said(x["body"]))))
    return F.sha2(F.concat_ws("\n", said(title), said(intro), lines), 256)


def planned(pages: DataFrame, state: DataFrame, key: str, version: str | int, force: bool = False) -> DataFrame:
    """(key, page_sha256, zip_url, fresh, etag, zip_before, work) for each page, against the state of the last build.

    pages have key, page_sha256 (null: the page couldn't be read) and zip_url
    (null: no archive); state has key and STATE. A document is fresh if it was
    digested, its page's fingerprint is the same and so is the version of what
    digests it, unless force is set. work is

        failed    the page couldn't be read
        skip      fresh, without an archive now and before
        page      to be digested from its page alone
        download  its archive is asked for, with the ETag of the last one only if the document is fresh

    Documents that are in the state only aren't asked about and give no row.
    """
    before = state.select(key, *[F.col(f"`{c}`").alias(f"_{c}") for c in STATE])
    same = F.coalesce(F.col("_digested") & (F.col("_page_sha256") == F.col("page_sha256")) & (F.col("_agent_version") == F.lit(version)), F.lit(False))
    fresh = F.lit(False) if force else same
    work = (
        F.when(F.col("page_sha256").isNull(), "failed")
        .when(F.col("zip_url").isNotNull(), "download")
        .when(F.col("fresh") & F.col("zip_before").isNull(), "skip")
        .otherwise("page")
    )
    met = pages.select(key, "page_sha256", "zip_url").join(before, key, "left")
    met = met.select(key, "page_sha256", "zip_url", fresh.alias("fresh"), F.when(fresh, F.col("_zip_etag")).alias("etag"), F.col("_zip_sha256").alias("zip_before"))
    return met.withColumn("work", work)


def with_opened(answers: DataFrame, listed: DataFrame) -> DataFrame:
    """Answers of sources.downloads with opened: false for those whose file sources.archives.listed_archives() couldn't open. Files have names of their own in any folder."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    broken = listed.filter("path IS NULL AND note IS NOT NULL").select(name(F.col("archive")).alias("_file"), F.lit(False).alias("opened")).distinct()
    return answers.withColumn("_file", name(F.col("file"))).join(broken, "_file", "left").drop("_file")


def settled(plan: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """planned() rows with the answers for the archives: (key, page_sha256, work, zip_sha256, zip_etag, note).

    answers have key, status, sha256, etag and too_large as sources.downloads
    gives them, and opened: false if the archive couldn't be opened, null if
    that is as it should be. work is then skip, page, archive or failed:

        an archive that hasn't changed, by its ETag (304) or, for a fresh document, by its digest, is skipped;
        one that is too large, refused or can't be opened leaves the page, and note says which of these;
        where no answer came, or none was asked for, the document failed.

    zip_sha256 and zip_etag are what is to be kept if the digest succeeds.
    """
    read = answers.select(key, "status", "sha256", F.col("etag").alias("_etag"), F.col("too_large").alias("_large"), F.coalesce("opened", F.lit(True)).alias("_opened"))
    met = plan.join(read, key, "left")
    asked, status = F.col("work") == "download", F.col("status")
    large = F.coalesce(F.col("_large"), F.lit(False))
    refused = ~status.between(200, 299)
    same = F.coalesce(F.col("fresh") & (F.col("zip_before") == F.col("sha256")), F.lit(False))
    note = F.when(asked & (status != 304), F.when(large, "too large").when(refused, F.concat(F.lit("status "), status.cast("string"))).when(~same & ~F.col("_opened"), "not opened"))
    work = (
        F.when(~asked, F.col("work"))
        .when(status.isNull(), "failed")
        .when(status == 304, "skip")
        .when(large | refused, "page")
        .when(same, "skip")
        .when(~F.col("_opened"), "page")
        .otherwise("archive")
    )
    found = met.withColumns({"note": note, "work": work})
    kept = (F.col("work") == "archive") | F.coalesce(F.col("note") == "not opened", F.lit(False))
    return found.select(key, "page_sha256", "work", F.when(kept, F.col("sha256")).alias("zip_sha256"), F.when(F.col("work") == "archive", F.col("_etag")).alias("zip_etag"), "note")


def to_read(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows of the documents that are to be digested: all that the steps after this read."""
    return rows.join(done.filter(F.col("work").isin("page", "archive")).select(key), key, "left_semi")


def outcomes(done: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """(key, outcome): digested, skipped or failed; failures are the keys of those whose digest failed. See library.outcome_counts()."""
    bad = failures.select(key).distinct().withColumn("_bad", F.lit(True))
    outcome = F.when((F.col("work") == "failed") | (F.col("_bad") & (F.col("work") != "skip")), "failed").when(F.col("work") == "skip", "skipped").otherwise("digested")
    return done.join(bad, key, "left").select(key, outcome.alias("outcome"))


def state_after(state: DataFrame, done: DataFrame, failures: DataFrame, key: str, version: str | int) -> DataFrame:
    """The state (key and STATE) after a build.

    What was digested has its page, version and archive of now. A page that was
    read is kept by its fingerprint whatever came of it, so a document that was
    digested before, whose digest failed now, counts as fresh next time if it
    has the version; one that couldn't be read, or wasn't among the pages, stays
    as it was.
    """
    of = done.join(outcomes(done, failures, key), key).select(key, F.col("page_sha256").alias("_page"), F.col("zip_sha256").alias("_zip"), F.col("zip_etag").alias("_etag"), (F.col("outcome") == "digested").alias("_now"))
    now = F.coalesce("_now", F.lit(False))
    kinds = dict(state.dtypes)
    return state.select(key, *STATE).join(of, key, "full").select(
        key,
        F.coalesce("_page", "page_sha256").alias("page_sha256"),
        (now | F.coalesce("digested", F.lit(False))).alias("digested"),
        F.when(now, F.lit(version).cast(kinds["agent_version"])).otherwise(F.col("agent_version")).alias("agent_version"),
        F.when(now, F.col("_zip")).otherwise(F.col("zip_sha256")).alias("zip_sha256"),
        F.when(now, F.col("_etag")).otherwise(F.col("zip_etag")).alias("zip_etag"),
    )
