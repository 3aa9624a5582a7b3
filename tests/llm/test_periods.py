import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plazaworks.llm.periods import RunDetector, numbered, with_runs, without_repeats
from plazaworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period): every stretch of each period, the smallest period of equal ones."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        start = p
        for at in range(p, len(words) + 1):
            if at == len(words) or words[at] != words[at - p]:
                if at - start + p >= max(6, 4 * p):
                    found.setdefault((start - p, at), p)
                start = at + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, size, p in runs for i in range(a + p, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return len(runs), *top, sha("".join(f"{a},{size},{p}\n" for a, size, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def texts(rng):
    kind, n = rng.randrange(4), rng.randrange(400)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        return y[rng.randrange(3) :]
    out = []
    while len(out) < n:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.5:
            unit = unit * rng.randrange(1, 6) + [rng.randrange(5)] * rng.randrange(20)
        out += unit * rng.randrange(1, 7)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_stretches_give_the_runs_of_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = np.array(texts(rng), np.int64)
        wanted = plain_runs(words.tolist())
        for step in (len(words) or 1, rng.choice([1, 2, 7, 50])):
            detector = RunDetector()
            for at in range(0, len(words), step):
                detector.append(words[at : at + step])
                assert step > 1 or rng.random() < 0.9 or detector.runs() == plain_runs(words[: at + 1].tolist())
            assert detector.runs() == wanted


def test_state_is_bounded_by_the_text_and_longer_texts_take_no_longer_a_word():
    words = np.tile(np.r_[np.zeros(100, np.int64), 1], 2000)
    detector = RunDetector()
    for at in range(0, len(words), 5000):
        detector.append(words[at : at + 5000])
    assert detector.runs()[:2] == [(0, 100, 1), (0, 202_000, 101)] and len(detector.runs()) == 2001
    assert sum(len(x.hashes) for x in detector._levels) < 12 * len(words) and len(detector.open) < 60


def test_words_that_stay():
    assert without_repeats(9, [(1, 6, 1)]).tolist() == [True, True, False, False, False, False, False, True, True]
    assert without_repeats(3, []).all() and numbered([b"a", b"b", b"a"]).tolist() == [0, 1, 0]
    with pytest.raises(ValueError, match="aren't all found"):
        RunDetector(min_times=3)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a " * 8, "x"), (3, "a\tb\n" * 5 + "a c", "x"), (3, "a\tb\n" * 5 + "a c", "x"), (4, "w x " * 6, "x"), (5, " ".join(f"w{k}" for k in range(200_000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, periods string").repartition(2)
    out = with_runs(df)
    assert out.columns == ["doc_id", "text", "periods", "periods_"]
    found = sorted(((r.doc_id or 0), [tuple(x) for x in r.periods_.runs], r.periods_.collapsed) for r in out.collect() if r.doc_id != 5)
    assert found == [(0, [(0, 8, 1)], "a"), (1, [], ""), (2, [], ""), (3, [(0, 11, 2)], "a b c"), (3, [(0, 11, 2)], "a b c"), (4, [(0, 6, 1)], "w x")]
    assert [len(r.periods_.collapsed) for r in out.filter("doc_id = 5").collect()] == [len(rows[-1][1])]
    assert with_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = {r.doc_id: tuple(r[c] for c in names) for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert found == {r.doc_id: plain_row(r.doc_id, r.text) for r in docs}
    assert sum(r[0] > 0 for r in found.values()) > 5


def test_query_on_made_documents(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{w}" for w in texts(rng))) for k in range(300)] + [(None, "a a a a a a a"), (7, None), (7, "b b b b b b b b b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = sorted(repr((r.doc_id, *(r[c] for c in names))) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect())
    # A row without id is never planted, as one whose id has another last digit isn't.
    assert found == sorted(repr((k, *plain_row(1 if k is None else k, t))) for k, t in rows)
