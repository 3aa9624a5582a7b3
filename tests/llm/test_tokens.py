import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plazaworks.llm import bpe, packing, tokenfile
from plazaworks.llm.pretokens import library_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    parts = [*"ab's tT1٣²½Ⅷé\n\t\r    '''lvremd!?。漢字ªº_-̀🙂", "<|endoftext|>", "'ll", "'re", " '", "'s"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    wild = ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(128)])) for _ in range(rng.randrange(30))) for _ in range(2000)]
    return [*odd, *wild, "", "a" * 3000, "ab" * 700 + "é" * 500, "-" * 1025, "x", " ", "\n\n"]


def test_library_ids(texts, tokenizer):
    assert [x.tolist() for x in library_ids(PATH)([None, *texts])] == [[], *(x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False))]


def test_segment_tree_ids_and_decoding(texts, tokenizer):
    ids = list(bpe.merge_ids(PATH)(texts))
    assert [x.tolist() for x in ids] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    pieces = bpe.Pieces(PATH)
    assert [pieces(x) for x in ids] == texts
    rng = random.Random(2)
    for _ in range(300):  # ids whose bytes need not be UTF-8
        some = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert pieces(np.array(some, dtype=np.int64)) == tokenizer.decode(some, skip_special_tokens=False)


def test_long_pre_tokens_take_equal_merges_at_once(tokenizer):
    rng = random.Random(7)
    words = [rng.choice(["a", "aa", "the", "ing", "é", "漢", "ab", "zq"]) for _ in range(9000)]
    long = ["".join(words), "a" * 8191, "ab" * 5000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "=" * 6000 + "-" * 5000, "".join(rng.choice("ACGT") for _ in range(9000))]
    assert [x.tolist() for x in bpe.merge_ids(PATH)(long)] == [x.ids for x in tokenizer.encode_batch(long, add_special_tokens=False)]


def test_merges_that_bring_about_lower_ranks_stay_one_by_one(tmp_path):
    """In this vocabulary a merge of rank 1 makes a token that goes into one of rank 0."""
    from tokenizers import models, pre_tokenizers

    merges = [("ab", "c"), ("a", "b"), ("b", "c"), ("c", "a"), ("abc", "ab")]
    vocab = {letter: k for k, letter in enumerate(bpe.byte_letters())}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "vocabulary.json")
    made.save(path)
    ours = bpe.Merges(path)
    assert not ours._together[1] and ours._together[2]
    rng = random.Random(8)
    for n in (4097, 6000):
        word = "".join(rng.choice("abc") for _ in range(n))
        assert ours([word])[0].tolist() == made.encode(word).ids


def test_ids_of_large_vocabularies_take_four_bytes(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    vocab = {letter: k for k, letter in enumerate(bpe.byte_letters())} | {"ab": 70_000}
    made = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "b")]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "vocabulary.json")
    made.save(path)
    assert tokenfile.id_width(path) == 4 and tokenfile.id_width(PATH) == 2 and tokenfile.id_width(PATH, end=1 << 16) == 4
    (row,) = tokenfile.token_file_round_trip(spark.createDataFrame([(1, "abab")], "doc_id long, text string"), path).collect()
    assert tuple(row) == (1, 0, 3, zlib.crc32(np.array([70_000, 70_000, 2], dtype="<u4")))
    with pytest.raises(ValueError, match="doesn't fit"):
        tokenfile.write_shard(f"file://{tmp_path}/x.tok", iter([(1, np.array([1 << 16]))]), 2)


def test_whole_shards_are_read_in_stretches(tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    docs = [(k, rng.integers(0, 60_000, n)) for k, n in enumerate([0, 5, 3000, 1, 0, 0, 700, 700, 20_000, 2, 0])]
    uri = f"file://{tmp_path}/x.tok"
    tokenfile.write_shard(uri, iter(docs), 2)
    for size in (2, 1000, 1 << 20):
        monkeypatch.setattr(tokenfile, "READ", size)
        shard, reads = tokenfile.Shard(uri), []
        of = shard._ids
        monkeypatch.setattr(shard, "_ids", lambda a, b: reads.append((a, b)) or of(a, b))  # noqa: B023
        assert [(k, ids.tolist()) for k, _, ids in shard.docs()] == [(k, ids.tolist()) for k, ids in docs]
        assert len(reads) == {2: 7, 1000: 7, 1 << 20: 1}[size] and all(b - a <= max(size // 2, 20_000) for a, b in reads)
        shard.close()


def test_cache_starts_anew(texts):
    few = library_ids(PATH)
    few._most = 50
    assert [x.tolist() for t in texts[:300] for x in few([t])] == [x.tolist() for x in library_ids(PATH)(texts[:300])]


def _docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, ids string, uid int").repartition(4)


def test_encode_and_decode_frames(spark, texts, tokenizer):
    rows = [(k, t) for k, t in enumerate(texts[:200])] + [(None, "abc"), (7, None)]
    docs = _docs(spark, rows)
    frame = bpe.decode(bpe.encode(docs, PATH, name="ids"), PATH, "ids_")
    assert frame.columns == ["doc_id", "text", "ids", "uid", "ids_", "decoded"]
    found = frame.collect()
    assert sorted(map(str, ((r.doc_id, r.ids_, r.decoded) for r in found))) == sorted(map(str, ((k, tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in rows)))
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH, "ids_").count() == 0


def check_packing(rows, wanted, capacity=1024):
    """rows of pack() against {doc: ids}: each id in one piece, sequences without gap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == wanted.keys()
    for doc, pieces in by_doc.items():
        ids, at = np.array(wanted[doc], dtype="<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at if at & at - 1 else 0
    return padding


def test_packing(spark, tokenizer):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in small] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b " * 5000)]
    docs = _docs(spark, rows)
    wanted = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows}
    found = packing.pack(docs, PATH, group=300).collect()
    assert check_packing(found, wanted) <= 2 * 3 * 1024  # a few sequences in each of two groups
    again = packing.pack(docs, PATH, group=300).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), PATH).count() == 3


def test_first_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        used = []
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            k = next((k for k, u in enumerate(used) if u + sizes[i] <= 100), len(used))
            used += [0] * (k == len(used))
            assert (bins[i], offsets[i]) == (k, used[k])
            used[k] += sizes[i]


def test_elias_fano():
    rng = np.random.default_rng(6)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (5, 1), (1000, 3), (1000, 10**9), (40_000, 10**6), (300, 2**40)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        coded = tokenfile.EliasFano.of(values)
        raw = coded.to_bytes()
        back = tokenfile.EliasFano.from_bytes(raw)
        assert list(back) == values.tolist()
        assert [back[i] for i in range(0, n, 7)] == values.tolist()[::7]
        if n >= 1000:
            assert len(raw) < n * (np.log2(top / n + 1) + 3.6) / 8 + 64


def test_token_files(spark, tokenizer):
    rows = [(-5, "first"), (3, "same id"), (3, "again"), (None, "no id"), (8, None), (10**12, "<|endoftext|> far"), (9, "x " * 3000)]
    rows += [(k, f"text {k}") for k in range(20, 90)]
    docs = _docs(spark, rows)
    found = sorted(tokenfile.token_file_round_trip(docs, PATH).collect(), key=lambda r: r.start)
    at, left = 0, [(k, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in rows]
    assert [r.doc_id for r in found] == [None, *sorted(k for k, _ in rows if k is not None)]
    for r in found:
        assert r.start == at
        at += r.n_tokens
        match = [x for x in left if x[0] == r.doc_id and zlib.crc32(np.array(x[1], dtype="<u4")) == r.ids_crc32 and len(x[1]) == r.n_tokens]
        left.remove(match[0])
    assert not left
    assert tokenfile.token_file_round_trip(docs.limit(0), PATH).count() == 0


def test_queries_on_the_small_table(spark, tokenizer):
    from plazaworks.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in docs}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe"](spark, folder).collect()}
    assert coded == {r.doc_id: (len(ids[r.doc_id]), sha(",".join(map(str, ids[r.doc_id]))), sha(r.text or "")) for r in docs}
    files = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, folder).collect()}
    at, wanted = 0, {}
    for doc in sorted(ids):
        whole = np.array([*ids[doc], 2], dtype="<u4")
        wanted[doc] = (at, len(whole), zlib.crc32(whole))
        at += len(whole)
    assert files == wanted
    assert check_packing(QUERIES["op6_packing"](spark, folder).collect(), {k: [*v, 0] for k, v in ids.items()}) < 0.02 * at
