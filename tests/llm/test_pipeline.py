import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_lines_quality import plain_lines, plain_quality
from tests.llm.test_minhash import plain_components
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


def test_equals_brute_force(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    # Near copies of which no line is the same.
    docs += [(10_000 + k, "\n".join(f"{line} xq" for line in t.split("\n"))) for k, t in docs[:40]]
    added = spark.createDataFrame(docs[len(docs) - 40 :], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars")
    table.unionByName(added).write.parquet(f"{tmp_path}/documents.parquet")
    good = [(k, t) for k, t in docs if plain_quality(t)[-1]]
    lines = [(k, t) for k, (_, _, t) in plain_lines(good).items()]
    kept = {k for k, (_, c) in plain_components(lines).items() if k == c}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in lines if k in kept}
    assert len(docs) > len(good) > len(kept) + 10 > 10
    assert check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), wanted) <= 3 * 1024


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    text = " ".join(f"the word{k} of" for k in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, text + " more", "en", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS quality", "1 AS doc", "2 AS uid", "3 AS kept")
    for table in (docs, docs.limit(0)):
        step = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, FOLDER)
            assert step.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, step, FOLDER)
        assert {r.doc_id for r in packed.collect()} == ({1, None} if table is docs else set())
