"""Line dedup: lines seen in an earlier document go.

The keys of all lines seen so far lie in sorted runs on levels. A run is a
table bucketed and sorted by the hash of the line, all with one number of
buckets: the keys of a batch of documents are aggregated into the same buckets
once, and meet every run in merge joins that neither shuffle nor sort it. Keys
that no run holds are the batch's new run. When a level has FANOUT runs, they
are merged, by a merge join as well, into one run on the next level, so that a
batch meets a logarithmic number of runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaworks.llm.shared import LOWER, SPACES, UPPER, fresh, kept_at, release, shared_dir, stored

#: Shorter keys (code points) are never duplicates.
MIN_CHARS = 10
#: Batches a whole table is dealt into, and runs a level holds before they merge.
BATCHES, FANOUT = 4, 2
#: Lines a bucket of a run is made for, and places of dropped lines up to which they are sent to all executors (about 20 bytes each, so 20 MB).
BUCKET_LINES, SENT_PLACES = 4_000_000, 1 << 20


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    """128 bits in two columns: lines of a large corpus don't meet by chance."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, pos, h1, h2) for each line whose key is long enough."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), _row(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.filter(F.length("line") >= min_chars).select("doc", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select("doc", "row", "pos", *_hashes(F.col("key")))


def _row(text: Column) -> Column:
    """Tells apart rows that share an id but not the text."""
    return F.xxhash64(text)


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for what is run within."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _own_session(spark: SparkSession) -> SparkSession:
    """Another session of the application with the same settings, which may be changed without others noticing."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.get(k, None) != v:
            own.conf.set(k, v)
    return own


@dataclass
class LineRuns:
    """Levels of runs (h1, h2, doc): each key once, with the first document that has it.

    buckets: of all runs; with the session's number of shuffle partitions the
    keys of a batch fall into them without a second shuffle. Tables are made in
    the session's catalogue, their files in the shared folder; close() drops both.
    Some settings of the session are changed while a batch is added, so it had
    better be one of its own; batches must be of that session.
    """

    spark: SparkSession
    buckets: int
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)
    _tables: list[tuple[str, DataFrame]] = field(default_factory=list)

    def _planned(self):
        """Runs' order counts (each bucket is one file), and aggregates of what is sorted keep it."""
        return _settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__shuffle__partitions=str(self.buckets), spark__sql__sources__bucketing__autoBucketedScan__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")

    def _write(self, df: DataFrame, tag: str) -> DataFrame:
        where, name = shared_dir(self.spark, tag), f"line_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", where).saveAsTable(name)
        table = kept_at(self.spark.table(name), where)
        self._tables.append((name, table))
        return table

    def first_seen(self, keys: DataFrame) -> DataFrame:
        """keys with column seen: the document in a run that holds the key, else null. A key is in one run at most."""
        runs = [run for level in self.levels for run in level]
        for k, run in enumerate(runs):
            keys = keys.join(run.withColumnRenamed("doc", f"seen{k}").hint("merge"), ["h1", "h2"], "left")
        found = F.coalesce(*[F.col(f"seen{k}") for k in range(len(runs))], F.lit(None).cast("long"))
        return keys.withColumn("seen", found).drop(*[f"seen{k}" for k in range(len(runs))])

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of all: merge joins whose keys never match."""
        whole = runs[0]
        for run in runs[1:]:
            both = whole.join(run.withColumnRenamed("doc", "_doc").hint("merge"), ["h1", "h2"], "full")
            whole = both.select("h1", "h2", F.coalesce("doc", "_doc").alias("doc"))
        return whole

    def add(self, run: DataFrame) -> None:
        """Add a run, a table of this many buckets, of keys that no other run holds; merge full levels upward."""
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._write(self._merged(self.levels[level]), f"lines-level{level + 1}")
            self.levels[level] = []
            level += 1

    def add_batch(self, lines: DataFrame, last: bool = False) -> DataFrame:
        """(h1, h2, first) of the keys of a batch's lines (doc, h1, h2) that repeat; its new keys join the runs.

        A key repeats if a run holds it, or more than one document of this
        batch; first is the document with the smallest id then. Documents of
        later batches have larger ids. last: no batch follows, nothing is added.
        Lines without a document hold no key; an empty batch adds an empty run.
        """
        with self._planned():
            keys = self.first_seen(lines.filter(F.col("doc").isNotNull()).groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.max("doc").alias("to")))
            keys = self._write(keys, "lines-keys")
            if not last:
                self.add(keys.filter(F.col("seen").isNull()).select("h1", "h2", "doc"))
        return keys.filter(F.col("seen").isNotNull() | (F.col("doc") < F.col("to"))).select("h1", "h2", F.coalesce("seen", "doc").alias("first"))

    def close(self) -> None:
        for name, table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            release(table)
        self._tables, self.levels = [], []


def _batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ascending ids that cut docs into batches of about the same size."""
    at = [k / batches for k in range(1, batches)]
    found = docs.select(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), at, 1000).alias("at")).first()["at"] if at else None
    return sorted(set(found or []))


def _dropped(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """(doc, row, gone): the places of the lines to drop."""
    spark = docs.sparkSession
    bounds = _batch_bounds(docs, id_col, batches)
    lines = keyed_lines(docs, id_col, text_col, min_chars).filter("doc IS NOT NULL")
    batch = sum(((F.col("doc") > bound).cast("int") for bound in bounds), F.lit(0))
    where = shared_dir(spark, "lines")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(where)
    own = _own_session(spark)
    lines = kept_at(own.read.schema("doc long, row long, pos int, h1 long, h2 long, batch int").parquet(where), where)
    buckets = max(own.sparkContext.defaultParallelism, -(-lines.count() // BUCKET_LINES))
    with _settings(own, spark__sql__shuffle__partitions=str(buckets)):
        # The number that holds, if it may not be changed.
        runs = LineRuns(own, int(own.conf.get("spark.sql.shuffle.partitions")), fanout)
    try:
        parts = []
        for k in range(len(bounds) + 1):
            repeated = runs.add_batch(lines.filter(F.col("batch") == k), last=k == len(bounds))
            parts.append(repeated.withColumn("batch", F.lit(k)))
        # A line that very many documents hold makes one key heavy: here its rows may be split, as no bucket holds them together.
        with _settings(own, spark__sql__sources__bucketing__enabled="false"):
            gone = lines.join(reduce(DataFrame.unionByName, parts), ["batch", "h1", "h2"]).filter(F.col("doc") > F.col("first"))
            found = stored(gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    finally:
        runs.close()
        release(lines)
    return kept_at(spark.read.schema(found.schema).parquet(found._stored_at), found._stored_at)


def with_line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with a struct column line_dedup: n_lines, n_dropped (long) and text, the lines that stay joined by \\n.

    Keys of at least min_chars code points that at least two documents (ids)
    hold lose all their lines but those of the smallest id. A null or empty
    text is one empty line and stays ''. Rows that share an id count as one
    document and are treated alike: none drops a line for the other's sake. A
    null id keeps all its lines and holds no key. Other columns stay, whatever
    their names (the struct's name gets underscores until it is new); an empty
    table gives an empty table.
    """
    name, key, row, gone, lines = fresh(docs, "line_dedup", "_doc", "_row", "_gone", "_lines")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    ids = F.col(f"`{id_col}`").cast("long")
    found = _dropped(docs, id_col, text_col, min_chars, batches, fanout)
    places = found.agg(F.sum(F.size("gone") + 4).alias("n")).first()["n"] or 0
    dropped = found.select(F.col("doc").alias(key), F.col("row").alias(row), F.col("gone").alias(gone))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Few enough places are sent to the texts; otherwise texts and places are shuffled together.
    joined = docs.select(*keep, ids.alias(key), _row(text).alias(row)).join(F.broadcast(dropped) if places <= SENT_PLACES else dropped, [key, row], "left")
    joined = joined.select(*keep, gone, F.split(text, "\n", -1).alias(lines))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col(lines), i)), "\n"))
    result = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))
    return joined.select(*keep, result.alias(name))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """docs with the repeated lines taken out of their texts; chars_col, if there, holds the new length.

    Rows, other columns and null texts stay as they are; a text that loses all its lines is ''.
    """
    read = with_line_dedup(docs, id_col, text_col, **how)
    (made,) = [c for c in read.columns if c not in docs.columns]
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.col(f"`{made}`.text"))
    kinds = dict(docs.dtypes)
    new = {text_col: text} | ({chars_col: F.length(text).cast(kinds[chars_col])} if chars_col in kinds else {})
    return read.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, first IS NOT NULL AND doc_id > first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
