import base64
import random
import re
import string

import duckdb
import pytest
from pyspark.sql import functions as F

from plazaworks.llm import secrets
from plazaworks.llm.queries import ORACLES, QUERIES
from plazaworks.llm.secrets import likelihood_ratio, model_of, random_strings, train, with_secrets

FOLDER = "/root/testdata/sf0.01"
BASE = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return model_of(docs)


def plain_spans(text, model):
    """(base, all) spans, (start, rank, end), by the patterns as they are told and one character pair at a time."""
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, m.end()))
    extra = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text or ""):
        score = sum(model.weights[(ord(a) - secrets.FIRST) * secrets.CODES + ord(b) - secrets.FIRST] for a, b in zip(m[0], m[0][1:]))
        if len(m[0]) >= 16 and score > secrets.MARGIN:
            extra.append((m.start(), 3, m.end()))
    return sorted(found), sorted(found + extra)


def ranked(spans):
    return [(x.start, secrets.KINDS.index(x.kind), x.end) for x in spans]


def test_odd_texts_equal_brute_force(spark, model):
    rng = random.Random(8)
    drawn = lambda n, signs=string.ascii_letters + string.digits + "+/": "".join(rng.choice(signs) for _ in range(n))
    texts = [
        None, "", "ü token=abc123", "password: secret: abcdefgh", "password: token: abcdefgh", "PassWord = 'abc.de'", "api_key=\"x\" APIKEY:yyyyyy apikey  =  a-b_c/d",
        "tokenſ toKen=éabcdef passwd=12345", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xxAKIAAKIA" + "B7" * 8 + "é", "f" * 23, "f" * 24 + "g", "a" * 24 + "-" + "b" * 40, "tokentoken=tokentoken=abcdef",
        "émile " * 50 + drawn(40) + " " + drawn(32, "0123456789ABCDEF") + " d-" + drawn(20, string.ascii_lowercase), "4" * 16 + " someVeryLongIdentifierName another_long_identifier_name path/to/some/other/file",
        "key " + drawn(100_000), ("token=abcdef1 " + drawn(24) + "\n") * 3000, "secret\n=abcdef", "token= =abcdef",
    ]
    for _ in range(200):
        texts.append("".join(rng.choice(["token", "=", ":", " ", "'", '"', "abc", "123456", "AKIA", "A7" * 8, "0af9" * 6, "é", "\n", drawn(5), drawn(18)]) for _ in range(rng.randrange(30))))
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[2], 1), (1, "", 1)], "doc_id long, text string, secrets int").repartition(3)
    out = with_secrets(df, model)
    assert out.columns == ["doc_id", "text", "secrets", "secrets_"] and out.count() == df.count()
    for r in out.collect():
        base, spans = plain_spans(r.text, model)
        assert (ranked(r.secrets_.base), ranked(r.secrets_.spans)) == (base, spans), r.text[:80]
        assert (r.secrets_.n_assign, r.secrets_.n_access, r.secrets_.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
    assert with_secrets(df.limit(0), model).count() == 0


def test_held_out_strings_are_told_apart(spark, docs, model):
    rng = random.Random(2)
    fresh = [base64.b64encode(rng.randbytes(n)).decode().rstrip("=") for n in (12, 16, 20, 30) for _ in range(200)]
    fresh += ["".join(rng.choice(signs) for _ in range(n)) for signs in ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits) for n in (20, 32) for _ in range(150)]
    scores = [r.s for r in spark.createDataFrame([(t,) for t in fresh], "t string").select(likelihood_ratio(F.col("t"), model).alias("s")).collect()]
    assert sum(s > secrets.MARGIN for s in scores) > 0.97 * len(scores)
    # Words of documents that the sample can't hold: those of the larger table with other ids.
    words = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 1000").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z/_-]{16,}"), F.lit(0))).alias("t"))
    plain = words.filter(~F.col("t").rlike("[0-9a-f]{20,}")).distinct().select(likelihood_ratio(F.col("t"), model).alias("s")).collect()
    assert len(plain) > 500 and not [r.s for r in plain if r.s > secrets.MARGIN]


def test_training(spark):
    none = train(spark.createDataFrame([(None, True), ("ab", None), ("", False)], "text string, random boolean"))
    assert set(none.weights) == {0} and len(none.weights) == secrets.CODES**2
    some = train(spark.createDataFrame([("ab,ab", True), ("aé", False)], "text string, random boolean"))
    at = lambda a, b: some.weights[(ord(a) - secrets.FIRST) * secrets.CODES + ord(b) - secrets.FIRST]
    assert at("a", "b") > 0 > at("a", "c") and at("b", "a") == 0
    assert random_strings(spark, 3).count() == 12


def test_no_python_and_no_shuffle(docs, model):
    plan = with_secrets(docs.select("doc_id", "text"), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "from_json" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    wanted = con.execute(ORACLES["op12_secret_scan"]).fetchall()
    found = QUERIES["op12_secret_scan"](spark, FOLDER)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
