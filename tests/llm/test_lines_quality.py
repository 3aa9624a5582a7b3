import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plazaworks.llm import linededup
from plazaworks.llm.linededup import LineRuns, keyed_lines, line_dedup, with_line_dedup
from plazaworks.llm.quality import RULES, STOP_WORDS, Rule, quality_filter, with_quality

SPACE = " \t\n\x0b\f\r"


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def plain_lines(rows):
    """{id: (n_lines, n_dropped, text)}; ids are unique."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key := lowered(line.strip(SPACE))) >= 10:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(lowered(x.strip(SPACE)), ())) >= 2 and min(holders[lowered(x.strip(SPACE))]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})
    stop = {y for v in STOP_WORDS.values() for x in v.split() for y in (x, x.capitalize(), x.upper())}
    n = len(words)
    part = lambda a, b: a / b if b else 0.0
    measures = {
        "mean_word_chars": part(sum(map(len, words)), n),
        "symbols_per_word": part(len(re.findall(r"[#*$%&|<>]", text)), n),
        "stop_word_ratio": part(sum(w in stop for w in words), n),
        "dup_line_ratio": part(len(lines) - len(set(lines)), len(lines)),
        "bullet_line_ratio": part(sum(x.strip(SPACE)[:2] in ("- ", "* ", "• ") for x in lines), len(lines)),
        "ellipsis_line_ratio": part(sum(x.strip(SPACE).endswith(("...", "…")) for x in lines), len(lines)),
    }
    base_failed = n < 50 or 100 * repeated > 50 * n
    passed = all((r.low is None or measures[r.measure] >= r.low) and (r.high is None or measures[r.measure] <= r.high) for r in RULES)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, base_failed, not base_failed and passed


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    lines = [f"Line number {k} of many" for k in range(60)] + ["  short ", "", "\t", "Ünïcode LINE of some length", "ünïcode line of some length", "Ünïcode line of some length\r", "- a bullet here", "and so on..."]
    out = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for k in range(300)]
    out += [(300, None), (301, ""), (302, "\n\n"), (303, "the of " * 40), (304, "a b c " * 30 + " ".join(f"the w{k}" for k in range(200))), (305, "\n".join(lines * 30)), (306, "x" * 200_000)]
    out += [(400 + k, " ".join(rng.choice("the of and word $$$ |cell| é ... w1 w2 w3".split()) for _ in range(rng.choice([2, 49, 50, 51, 400])))) for k in range(150)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (7, 3)])
def test_lines_equal_brute_force(spark, rows, batches, fanout):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: tuple(r.line_dedup) for r in with_line_dedup(df, batches=batches, fanout=fanout).collect()}
    assert found == plain_lines(rows)


def test_runs_are_levelled_and_stay_sorted(spark):
    runs = LineRuns(spark, 5, fanout=2)
    docs = spark.createDataFrame([(k, f"common line of all\nonly line of {k} here") for k in range(7)], "doc_id long, text string")
    for k in range(7):
        repeated = runs.add_batch(keyed_lines(docs.filter(f"doc_id = {k}")))
        assert [r["first"] for r in repeated.collect()] == [0] * (k > 0)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    keys = [r for level in runs.levels for run in level for r in run.collect()]
    assert len(keys) == 8 and len({(r.h1, r.h2) for r in keys}) == 8
    with runs._planned():
        # The batch's keys are shuffled and sorted once, the runs not at all.
        plan = runs.first_seen(keyed_lines(docs).groupBy("h1", "h2").agg(F.min("doc").alias("doc")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan
        merge = runs._merged([run for level in runs.levels for run in level][:2])._jdf.queryExecution().executedPlan().toString()
        assert merge.count("SortMergeJoin") == 1 and "Exchange" not in merge and "Sort [" not in merge, merge
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_many_places_are_shuffled(spark, rows, monkeypatch):
    monkeypatch.setattr(linededup, "SENT_PLACES", 0)
    found = with_line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: tuple(r.line_dedup) for r in found.collect()} == plain_lines(rows)


def test_line_dedup_of_odd_rows(spark):
    line = "the very same line"
    rows = [(None, line, 1, 5), (2, line, 1, 5), (2, line + "\nother", 2, 5), (3, f"x\n{line}", 3, 5), (4, None, 4, None), (5, line, 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_dedup int, n_chars long")
    out = line_dedup(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(((r.doc_id or -1), r.text, r.n_chars) for r in out.collect() if r.text is not None) == [(-1, line, 18), (2, line, 18), (2, line + "\nother", 24), (3, "x", 1), (5, "", 0)]
    assert with_line_dedup(df.limit(0)).count() == 0


def test_quality_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "own") for r in rows] + [(0, None, None)], "doc_id long, text string, quality string").repartition(3)
    out = with_quality(df, name="q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    kept = 0
    for r in out.collect():
        wanted = plain_quality(r.text)
        assert tuple(r.q[n] for n in names) == wanted
        kept += wanted[-1]
    left = quality_filter(df)
    assert left.columns == df.columns and left.count() == kept > 0
    assert with_quality(df.limit(0), name="q").count() == 0


def test_own_rules(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)))], "doc_id long, text string")
    none = with_quality(df, rules=(Rule("long", "mean_word_chars", 10, None),)).first().quality
    assert none.failed == ["long"] and not none.kept
    assert with_quality(df, rules=()).first().quality.kept


def test_queries_on_the_small_table(spark):
    from plazaworks.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op3_line_dedup"](spark, folder).collect()}
    assert found == {k: (a, b, hashlib.sha256(t.encode()).hexdigest()) for k, (a, b, t) in plain_lines(docs).items()}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_quality_rules"](spark, folder).collect()} == {k: plain_quality(t) for k, t in docs}


def test_a_failing_job_leaves_no_table_and_no_setting_behind(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a line of some length"), (2, "a line of some length\nand another")], "doc_id long, text string")
    seen = []

    def broken(df, tag):
        seen.append(spark.conf.getAll)
        raise RuntimeError("lost")

    before = spark.conf.getAll
    monkeypatch.setattr(linededup, "stored", broken)
    with pytest.raises(RuntimeError, match="lost"):
        with_line_dedup(docs, batches=2)
    assert seen == [before] and spark.conf.getAll == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_settings_of_the_session_hold_for_the_work_on_lines(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7654321")
    try:
        own = linededup._own_session(spark)
        assert own.conf.get("spark.sql.files.maxPartitionBytes") == "7654321"
        own.conf.set("spark.sql.files.maxPartitionBytes", "1234567")
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "7654321"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
