"""Every query with SQL gives what DuckDB makes of it."""

import math
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from plazaworks.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
#: At the smallest size nothing need be found by these.
MAY_BE_EMPTY = {"compaction_cut", "compaction_due", "page_of_one", "rank_people", "people_text_filter", "hybrid_threshold"}


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


def test_each_query_has_sql():
    assert len(catalogue.QUERIES) >= 120 and catalogue.QUERIES.keys() - catalogue.ORACLES.keys() == {"chat_search"}


@pytest.mark.parametrize("missing", ["public_tokenizers", "tokenizers", "corpus_pipeline", "plazaworks.llm"])
def test_the_entry_stands_without_what_only_the_corpus_operators_need(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", str(len(catalogue.ORACLES))], said.stderr[-500:]


def test_chat_search_equals_brute_force(spark):
    """All stretches that begin and end with a trigram of the word; others are less alike than those within them."""
    def trigrams(text):
        return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)]

    def likeness(body):
        ordered, wanted = trigrams(body), set(trigrams("thing"))
        best = 0.0
        for start in (i for i, t in enumerate(ordered) if t in wanted):
            seen, shared = set(), set()
            for t in ordered[start:]:
                seen.add(t)
                if t in wanted:
                    shared.add(t)
                    best = max(best, len(shared) / len(seen | wanted))
        return round(best, 6)

    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").filter("role <> 'system'").collect()
    wanted = {r.conv_id * 1000 + r.turn: (r.conv_id, likeness(r.text)) for r in rows if "thing" in r.text.lower()}
    found = catalogue.QUERIES["chat_search"](spark, FOLDER).collect()
    assert len(wanted) > 10 and {r.id: (r.user_id, r.score) for r in found} == wanted
    assert [(r.user_id, -r.score) for r in found] == sorted((r.user_id, -r.score) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    wanted = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in wanted.fetchall())
    assert rows or name in MAY_BE_EMPTY
