import random

import numpy as np
import pyarrow as pa

from granary import session
from granary.llm import neardup as N
from granary.llm import queries
from granary.llm.sitelines import Frequent, line_keys, site_keys, site_lines, with_drops
from granary.llm.words import Words

SCHEMA = "id bigint, source_site string, content string"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def sets(texts, n=3):
    e, at = N.shingle_sets(Words(pa.array(texts)), n)
    return [set(e[a:b].tolist()) for a, b in zip(at, at[1:])]


def test_signatures_estimate_jaccard():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    for want in (0.2, 0.55, 0.8):
        pairs = []
        for _ in range(30):
            a = rng.sample(words, 300)
            b = a[: int(300 * 2 * want / (1 + want))] + rng.sample(words, 300 - int(300 * 2 * want / (1 + want)))
            pairs += [" ".join(a), " ".join(b)]
        e, at = N.shingle_sets(Words(pa.array(pairs)), 1)
        sig = N.dart_minhash(e, at)
        real = np.mean([jaccard(x, y) for x, y in zip(*[iter([set(e[a:b].tolist()) for a, b in zip(at, at[1:])])] * 2)])
        assert abs((sig[::2] == sig[1::2]).mean() - real) < 0.03


def test_weighted_signatures():
    e = np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both, w1, w2 = np.concatenate([e, e]), np.full(200, 0.9), np.full(200, 0.45)
    agree = [(s := N.dart_minhash(np.concatenate([e + np.uint64(k), e + np.uint64(k)]), np.array([0, 200, 400]), weights=np.concatenate([w1, w2])))[0].__eq__(s[1]).mean() for k in range(20)]
    assert len(both) == 400 and abs(np.mean(agree) - 0.5) < 0.04


def test_short_rows_and_ties():
    s = sets(["một hai", "hai một", "một hai", "", "một"])
    assert s[0] == s[2] != s[1] and s[3] == set() and len(s[4]) == 1


def build(rng, n_groups=12):
    vocab = [f"từ{i}" for i in range(4000)]
    rows, i = [], 0
    for g in range(n_groups):
        base = rng.choices(vocab, k=rng.randint(40, 400))
        for v in range(rng.randint(1, 5)):
            x = list(base)
            for _ in range(rng.randint(0, len(x) // 25)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append((i, rng.choice("ab"), " ".join(x)))
            i += 1
        rows.append((i, "a", " ".join(base).upper()))
        i += 1
    return rows


def test_pairs_match_brute_force(spark):
    rows = build(random.Random(7))
    extra = [(900, "a", None), (901, "a", "  "), (902, "a", "ngắn"), (903, "b", "NGẮN"), (904, "a", ", .")]
    df = spark.createDataFrame(rows + extra + rows[:4], SCHEMA).repartition(4)
    none = spark.createDataFrame([], "site string, key bigint")
    classes, pairs = N.near_pairs(df, none)
    got = {tuple(r) for r in N.id_pairs(classes, pairs).collect()}
    ids = [r[0] for r in rows + extra if r[2] and r[2].strip()]
    s = dict(zip(ids, sets([r[2] for r in rows + extra if r[2] and r[2].strip()])))
    want = {(a, b) for a in ids for b in ids if a < b and s[a] and s[b] and jaccard(s[a], s[b]) >= 0.55}
    assert (902, 903) in got
    assert got <= want and len(got) >= 0.99 * len(want)
    groups = {r.id: r for r in N.near_groups(classes, pairs).collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in got)
    assert set(groups) == {i for i in s if s[i]}


def test_bands_meet_at_the_threshold():
    agree = np.random.default_rng(1).random((50_000, N.K)) < 0.55
    met = np.zeros(len(agree), bool)
    for band in N._order:
        met |= agree[:, band].all(axis=1)
    assert met.mean() > 0.998


def test_copies_are_one_class(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(i, "a", text) for i in range(300)], SCHEMA)
    classes, pairs = N.near_pairs(df, spark.createDataFrame([], "site string, key bigint"))
    assert classes.select("rep").distinct().count() == 1 and pairs.count() == 0
    assert N.id_pairs(classes, pairs).count() == 300 * 299 // 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 102)} == {100}


def test_long_chains_converge(spark):
    got = {r.id: r.component for r in N.components(spark.createDataFrame([(i, i + 1) for i in range(1, 300)], "a bigint, b bigint")).collect()}
    assert len(got) == 300 and set(got.values()) == {1}


def test_many_frequent_lines_give_the_same(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, r[1], r[2].translate(letters) + "\nDòng chung của trang\n" + f"Người nhập: {'abc'[i % 3]}") for i, r in enumerate(build(random.Random(3)))]
    df = spark.createDataFrame(rows, SCHEMA)
    _, frequent = site_lines(df)
    assert frequent.count() > 0
    one, two = ({tuple(r) for r in N.id_pairs(*N.near_pairs(df, frequent, most=m)).collect()} for m in (0, 1000))
    assert one == two and one


def test_empty(spark):
    classes, pairs = N.near_pairs(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "site string, key bigint"))
    assert classes.count() == pairs.count() == 0


def test_blank_texts_are_known_by_their_first_sign(spark):
    blank, filled = ["", " ", "\r\n\t ", "\n" * 5000], ["x", " \t\r\nx", "x" + " " * 5000, "\xa0", "\u3000", "\x0b", "\ufeff", "\\r\\n", "r", "n", "t", "\r ế \n"]
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate([*blank, *filled, None])] + [(None, "a", "x")], SCHEMA)
    old = {r.id for r in df.filter("id is not null and trim(translate(content, '\\r\\n\\t', '   ')) <> ''").collect()}
    content, keys = with_drops(df, spark.createDataFrame([], "site string, key bigint"))
    assert {r.id for r in N._nonblank(content).collect()} == old == set(range(len(blank), len(blank) + len(filled)))
    for made in (line_keys(df), N.signatures(content, keys), N.element_sets(content, Frequent([]))):
        assert "translate(" not in made._jdf.queryExecution().toString()


def test_lines_are_not_stored_for_pairs(spark, tables, monkeypatch):
    stored, path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: stored.append(name) or path(s, name))
    pairs = queries.p3_found(spark, tables)
    assert pairs.count() > 0 and "site-keys" in stored and "line-keys" not in stored
    own = queries._act_fields(spark, tables)
    content = queries._content(spark, tables)
    assert {tuple(r) for r in site_keys(content, fields=own).collect()} == {tuple(r) for r in site_lines(content, fields=own)[1].collect()}


def test_many_copies_and_candidates_give_the_same(spark, monkeypatch):
    rows = build(random.Random(5))
    df = spark.createDataFrame(rows + [(1000 + i, s, t) for i, s, t in rows[::3]], SCHEMA)
    none = spark.createDataFrame([], "site string, key bigint")
    got = []
    for most in (N.CANDIDATE_ROWS, 0):
        monkeypatch.setattr(N, "CANDIDATE_ROWS", most)
        classes, pairs = N.near_pairs(df, none)
        got.append(({tuple(r) for r in classes.collect()}, {tuple(r) for r in pairs.collect()}))
    assert got[0] == got[1] and got[0][1]
    reps = {r for _, r in got[0][0]}
    assert len(reps) < len(got[0][0]) and all(a in reps and b in reps for a, b, _ in got[0][1])
