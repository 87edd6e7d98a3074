import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import budget, encode
from granary.llm.pretokens import pretokens, row_slices
from granary.llm.vocab import load_ranks, vocab_path

ODD = [" ", "  ", "\n", "\t", "\r\n", "'s", "'", "'ll", "'re", "'ve", "x", "é", "ữ", "1", "²", "，", "　", "\xa0", "́", "🙂", "<|endoftext|>", "''", "r", "'d ", "\x00", "\u200b", "Ⅲ", "\u2028"]


@pytest.fixture(scope="module")
def reference(ranks_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.lists(st.sampled_from(ODD) | st.text(max_size=3), max_size=20).map("".join), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_match_the_tokenizer(reference, ranks_path, texts):
    assert encode.Encoder(ranks_path).encode(pa.array(texts, pa.string())).to_pylist() == reference(texts)


def test_edges(ranks_path, reference):
    e = encode.Encoder(ranks_path)
    assert e.encode(pa.array([None, "", None], pa.string())).to_pylist() == [[], [], []]
    assert e.encode(pa.array([], pa.string())).to_pylist() == []
    long = ["a" * 20_000, "ữ" * 5000, " " * 3000 + "x"]
    assert e.encode(pa.array(long)).to_pylist() == reference(long)
    sliced = pa.array(["zz", "một hai", None, "ba"]).slice(1, 3)
    assert e.encode(sliced).to_pylist() == [reference(["một hai"])[0], [], reference(["ba"])[0]]
    assert e.counts(sliced).tolist() == [len(x) for x in e.encode(sliced).to_pylist()]


def test_round_trip(ranks_path):
    back = {v: k for k, v in load_ranks(ranks_path).items()}
    texts = ["".join(random.Random(i).choices(ODD, k=30)) for i in range(50)]
    for t, ids in zip(texts, encode.Encoder(ranks_path).encode(pa.array(texts)).to_pylist()):
        assert b"".join(back[i] for i in ids).decode() == t


def test_pretokens_tile_the_rows():
    arr = pa.array(["a b", "", None, " c  d"])
    t, rows = pretokens(arr)
    assert [b"".join(t.to_pylist()[a:b]) for a, b in zip(rows, rows[1:])] == [b"a b", b"", b"", b" c  d"]
    assert sum(len(p) for p in row_slices(arr)) == 4


VOCAB = [b"a", b"b", b"c", b"d", b"ab", b"abcd", b"bc", b"cdab", b"dd"]


@given(st.lists(st.sampled_from(b"abcdx"), max_size=30).map(bytes))
@settings(max_examples=400, deadline=None)
def test_longest_match_is_greedy(piece):
    want, i = 0, 0
    while i < len(piece):
        i += max((len(v) for v in VOCAB if piece.startswith(v, i)), default=1)
        want += 1
    assert budget.LongestMatch(VOCAB).count(piece) == want


def test_longest_match_real_vocabulary(ranks_path):
    ranks = load_ranks(ranks_path)
    m = budget.LongestMatch(ranks)
    for s in (" Điều", "Nghị định", "x" * 500, "🙂🙂", " "):
        b, want = s.encode(), 0
        while b:
            k = next(k for k in range(min(len(b), 80), 0, -1) if b[:k] in ranks)
            b, want = b[k:], want + 1
        assert m.count(s.encode()) == want


def test_token_frames(spark, ranks_path, reference):
    df = spark.createDataFrame([(1, "một", "k"), (1, "một", "k"), (2, None, None), (3, "", "k")], "doc_id bigint, text string, ids string")
    got = encode.token_ids(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, reference(["một"])[0])] * 2 + [(2, []), (3, [])]
    assert encode.token_ids(df.limit(0), "doc_id", "text").count() == 0
    n = encode.token_counts(df, "text").collect()
    assert n[0].__fields__ == ["doc_id", "ids", "n_tokens"] and sorted(r.n_tokens for r in n)[:2] == [0, 0]


def test_token_budget(spark, ranks_path):
    t0, t1 = "2020-01-01 00:00:00", "2021-01-01 00:00:00"
    rows = [("c1", 1, t0, "Luật", "một"), ("c1", 1, t1, "Luật", "một hai"), ("c2", 1, t0, " luật ", None), ("c3", 9, t0, None, "ba")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id bigint, created_at string, legal_type string, text string")
    acts = spark.createDataFrame([(1, t0, "s", "vi"), (1, t1, "s", "vi")], "id bigint, crawled_at string, source_site string, lang string")
    sectors = spark.createDataFrame([("c1", "a"), ("c1", "b")], "chunk_id string, sector string")
    got = {(r.slice, r.key1, r.key2): (r.n_chunks, r.n_tokens) for r in budget.token_budget(chunks, acts, sectors).collect()}
    n = {t: budget.estimated_tokens(spark.createDataFrame([(t,)], "text string").withColumn("k", F.lit(1)), "text").first().n_tokens for t in ("một hai", "ba")}
    assert got[("site_lang", "s", "vi")] == (2, n["một hai"]) and got[("site_lang", None, None)] == (1, n["ba"])
    assert got[("legal_type", "luật", None)] == (2, n["một hai"]) and got[("legal_type", None, None)] == (1, n["ba"])
    assert got[("sector", "a", None)] == got[("sector", "b", None)] == (1, n["một hai"]) and got[("sector", None, None)] == (2, n["ba"])


def test_offsets_and_decoding(spark, ranks_path):
    texts = ["".join(random.Random(i).choices(ODD, k=20)) for i in range(20)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    coded = encode.token_ids(df, "doc_id", "text", offsets=True)
    back = {v: k for k, v in load_ranks(ranks_path).items()}
    for r in coded.collect():
        data, at = (texts[r.doc_id] or "").encode(), [0, *r.ends]
        assert [data[a:b] for a, b in zip(at, at[1:])] == [back[i] for i in r.ids] and at[-1] == len(data)
    assert {r.doc_id: r.text for r in encode.decode(coded, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), "doc_id", "ids").first().text == ""


def test_exact_counts_beside_the_estimate(spark, ranks_path, reference):
    df = spark.createDataFrame([(1, "Điều khoản thi hành"), (2, None)], "k bigint, text string")
    got = {r.k: r for r in budget.estimated_tokens(df, "text", exact="n_exact").collect()}
    assert got[1].n_exact == len(reference(["Điều khoản thi hành"])[0]) and got[2].n_exact == got[2].n_tokens == 0
