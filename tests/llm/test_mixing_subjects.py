import random

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import mixing, subjects


def test_fill_to():
    assert mixing.fill_to(100, np.array([0.5, 0.5]), np.array([10.0, 200.0])).tolist() == [10, 90]
    assert mixing.fill_to(500, np.array([0.5, 0.5]), np.array([10.0, 200.0])).tolist() == [10, 200]


def test_rake_reaches_marginals():
    tok = np.array([100.0, 200, 300, 400])
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    w = mixing.rake(tok, [a, b], [np.array([150.0, 350]), np.array([200.0, 300])], np.full(4, 3.0))
    assert np.allclose(np.bincount(a, w * tok), [150, 350]) and np.allclose(np.bincount(b, w * tok), [200, 300], rtol=1e-4)
    capped = mixing.rake(tok, [a, b], [np.array([150.0, 350]), np.array([200.0, 300])], np.full(4, 0.9))
    assert capped.max() <= 0.9 + 1e-12 and np.allclose(np.bincount(a, capped * tok), [150, 350])


def test_plan_without_documents():
    assert mixing.plan_mix([], {"a": (1.0, 2)}) == ([], 0.0)
    w, total = mixing.plan_mix([("a", None, None, 10), ("z", None, None, 5)], {"a": (0.5, 2), "none": (0.5, 1)})
    assert w == [2.0, 0.0] and total == 20


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 10 else "small", rng.choice(["vi", "en", None]), rng.choice(["luật", None]), rng.randint(1, 100)) for i in range(4000)]
    rows += [(9999, "other", "vi", None, 50), (9998, "big", None, None, 0)]
    rows = [(*r, str(r[0])) for r in rows] + [(20_000 + i, "small", "en", None, 7, "same text") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, n_tokens bigint, text_key string").repartition(5)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(df, targets)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].actual_share - 2 / 3) < 0.005 and abs(s["small"].actual_share - 1 / 3) < 0.005 and s["absent"].tokens == 0
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= {"big": 1, "small": 3}[r.source] for r in got)
    assert not {r.doc_id for r in got} & set(range(20_001, 20_050))
    assert sum(r.n_tokens * r.copies for r in got if r.source == "small") == s["small"].tokens
    again = {(r.doc_id, r.copies) for r in mixing.mix_sources(df.repartition(3), targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, topic string, n_tokens bigint, text_key string")
    chosen, shares = mixing.mix_sources(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert chosen.count() == 0 and shares.first().actual_share == 0.0


TERMS = {"tax": ["thuế suất", "hoàn thuế", "mã số thuế"], "sport": ["trọng tài", "huy chương", "sân vận động"], "land": ["thửa đất", "mốc giới", "sổ địa bạ"]}
OFFICE = ["Ban kiểm tra lập {} theo mẫu số {}.", "Khi kinh phí chưa được cấp, tổ hòa giải xem xét {} trong {} giờ.", "Việc niêm yết {} do chủ đầu tư thực hiện {} lần."]


def text_of(rng, parts):
    """A text whose sentences deal with the given subjects (None: nothing)."""
    return " ".join(rng.choice(OFFICE).format(rng.choice(TERMS[p]) if p else rng.choice(["nội dung này", "thủ tục này"]), rng.randint(1, 99)) for p in parts)


def test_held_out_accuracy():
    rng = random.Random(9)
    names = sorted(TERMS)
    texts, labels = [], []
    for _ in range(400):
        two = rng.sample(names, 2)
        texts.append(text_of(rng, rng.choices([two[0]] * 3 + [two[1], None], k=10)))
        labels.append(set(two))
    held = [(text_of(rng, [n] * 6 + [None] * 3), {n}) for n in names * 12]
    model = subjects.train(texts, labels, [True] * 400, ["vi"] * 400, ([t for t, _ in held], [s for _, s in held]), names)
    right = total = 0
    for _ in range(150):
        a, b = rng.sample(names, 2)
        parts = [a] * 5 + [b] * 4 + [None] * 2
        share, _ = model.sentence_hits(pa.array([text_of(rng, parts)]))
        right += {names[i] for i in np.flatnonzero(share[0] >= subjects.SHARE)} == {a, b}
        total += 1
    assert right / total > 0.9
    share, n = model.sentence_hits(pa.array(["", None, "Ngắn.", text_of(rng, [None] * 10), "123 456 ©® ---- 33"]))
    assert (share < subjects.SHARE).all()


def test_untrained_finds_nothing(spark):
    model = subjects.train([], [], [], [], ([], []), ["a", "b"])
    df = spark.createDataFrame([(1, "một hai ba bốn năm."), (2, None), (3, "")], "doc_id bigint, text string")
    assert subjects.subject_areas(df, model).count() == 0


@pytest.mark.parametrize("rows", [0, 3])
def test_makeup(spark, rows):
    docs = spark.createDataFrame([(1, "vi", "abc"), (2, None, None), (3, "vi", "d")][:rows], "doc_id bigint, lang string, text string")
    found = spark.createDataFrame([(1, "tax"), (1, "land")][: rows and 2], "doc_id bigint, subject string")
    got = {(r.subject, r.lang): (r.n_docs, r.n_chars) for r in subjects.corpus_makeup(found, docs).collect()}
    assert got == ({} if not rows else {("tax", "vi"): (1, 3), ("land", "vi"): (1, 3), (None, "vi"): (1, 1), (None, None): (1, 0)})


def test_short_runs_belong_to_a_sentence():
    arr = pa.array(["Hỏi: Một hai ba bốn. Ngắn. Năm sáu bảy tám chín. Hết.", "Chỉ ba từ", "", None, "a. b. một hai ba bốn"])
    col, at, row = subjects.sentence_features(arr)
    assert row.tolist() == [0, 0, 1, 4] and len(at) == 5 and at[-1] == len(col)
    words = [2 * (3 * n - 3) for n in (5, 7, 3, 6)]
    assert np.diff(at).tolist() == words


def test_marginals(spark):
    rows = [(i, "s" if i % 2 else "t", "vi" if i % 3 else "en", "x", 10, str(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, n_tokens bigint, text_key string")
    targets = spark.createDataFrame([("s", 0.75, 2), ("t", 0.25, 1), ("u", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {(r.dimension, r.value): r for r in mixing.marginals(df, mixing.mix_sources(df, targets)[0], targets).collect()}
    assert abs(got["source", "s"].wanted - 0.75) < 1e-9 and all(abs(r.wanted - r.reached) < 0.02 for r in got.values()) and len(got) == 5


def test_fit_sample_is_bounded_in_characters(spark):
    sample = spark.createDataFrame([(i, "vi") for i in range(6)], "id bigint, lang string")
    texts = spark.createDataFrame([(i, "x" * (10 if i else 500)) for i in range(6)], "id bigint, text string")
    got = subjects._within(sample, texts, "id", "text", pytest.importorskip("pyspark.sql.functions").col("lang"), [pytest.importorskip("pyspark.sql.functions").col("id").desc()], 4, 35).collect()
    assert {r.id for r in got} == {5, 4, 3}
