"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

Sentences are classified and a document deals with the subjects that a quarter
of its sentences deal with. The labels to learn from are weak: acts carry the
sectors they are filed under (section metadata; a path of their address, where
it names a subject, counts as well) and some documents have hand labels. A
label of a document says only that some of its sentences deal with it, so the
labels are first brought down to sentences, each to one of its document's labels
or to general language; the classifiers are fitted on these. Thresholds per
subject come from held-out hand labels.

The fit uses a bounded sample of acts of each language and of labelled documents
(the lowest hashes of their ids); everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.pretokens import row_slices
from granary.llm.words import PRIME, Words, mix
from granary.session import written

DIMENSIONS = 1 << 20
LEAST_COUNT = 3
#: A stop after fewer words of its own ends no sentence (abbreviations, numbering, labels).
LEAST_WORDS = 4
LEAST_SENTENCES = 100
SHARE = 0.25
MAX_ACTS, MAX_DOCUMENTS = 400, 2400
#: The sample of a language, and that of the labelled documents, end where their texts exceed so many characters.
MAX_FIT_CHARS = 1 << 23
#: More classes make the weights too large for a task; such a list is an error.
MAX_SUBJECTS = 1000
THREADS, BLOCK = 4, 1 << 18


def sentence_features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets by sentence, row of each sentence): hashed 1- to 3-grams, with and without accents.

    Words with a digit are one word. A run of fewer than LEAST_WORDS words goes
    with the sentence after it, at a text's end with the one before, so every
    word is in a sentence; a text of fewer words is one sentence.
    """
    w = Words(arr, plain=True, sentences=True)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
    number = np.uint64(0x23)
    new = np.append(True, (w.sentence[1:] != w.sentence[:-1]) | (w.row[1:] != w.row[:-1]))
    begin = np.flatnonzero(new)
    row = w.row[begin]
    long = np.diff(np.append(begin, n)) >= LEAST_WORDS
    # a sentence ends with a long run or with its text
    last = np.append(row[1:] != row[:-1], True)
    ends = long | last
    has_long = np.bincount(row, long, w.rows)[row] > 0
    ends &= ~(last & ~long & has_long)
    place = np.cumsum(ends) - ends
    # what a text's end leaves open belongs to the sentence before
    open_ = (np.cumsum(long[::-1])[::-1] - np.concatenate([np.cumsum(np.bincount(row, long, w.rows)[::-1])[::-1], [0]])[row + 1]) == 0
    place = np.where(open_ & has_long, place - 1, place)
    sentence = np.repeat(place, np.diff(np.append(begin, n)))
    row = row[np.flatnonzero(np.append(True, place[1:] != place[:-1]))]
    cols, owners = [], []
    for salt, h in ((1, w.hash), (2, w.plain)):
        h = np.where(w.digit, number, h)
        g = np.full(len(h), salt, np.uint64)
        for k in range(3):
            g = g[: len(h) - k] * np.uint64(PRIME) + h[k:] if len(h) > k else g[:0]
            same = sentence[: len(g)] == sentence[k:] if k else np.ones(len(g), bool)
            cols.append((mix(g[same]) % np.uint64(DIMENSIONS)).astype(np.int32))
            owners.append(sentence[: len(g)][same])
    col, own = np.concatenate(cols), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    col, own = col[order], own[order]
    return col, np.searchsorted(own, np.arange(len(row) + 1)), row


def _all_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols, ats, rows, base, done = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for part in row_slices(pa.array(texts, pa.string())):
        col, at, row = sentence_features(part)
        cols.append(col)
        ats.append(at[1:] + base)
        rows.append(row + done)
        base += len(col)
        done += len(part)
    return np.concatenate(cols), np.concatenate(ats), np.concatenate(rows)


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows between consecutive offsets; zero where there are none."""
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _thin(col: np.ndarray, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams with a slot, as slots, and their offsets."""
    got = slot[col]
    some = got >= 0
    return got[some], np.concatenate([[0], np.cumsum(some)])[at]


def _scores(col: np.ndarray, at: np.ndarray, slot: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    if len(at) < 2:
        return np.zeros((0, w.shape[1]))
    few, begin = _thin(col, at, slot)
    return _sums(w[few], begin) / np.sqrt(np.maximum(np.diff(begin), 1))[:, None] + bias


def _cuts(at: np.ndarray) -> np.ndarray:
    """Numbers of the sentences between which about BLOCK n-grams stand."""
    n = len(at) - 1
    return np.unique(np.concatenate([[0], np.minimum(np.searchsorted(at, np.arange(BLOCK, max(int(at[-1]), 1), BLOCK)), n), [n]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_labels(col: np.ndarray, at: np.ndarray, allowed: np.ndarray, rounds: int = 8, temper: float = 0.25, alpha: float = 0.02) -> np.ndarray:
    """Responsibilities (sentences x (subjects + 1)) of weakly labelled sentences; the last column is general language.

    Expectation-maximisation of a mixture of n-gram models: a sentence may
    belong to a subject only as far as `allowed` (weights of 0 and up) of its
    document lets it, or to general language.
    """
    n, k = allowed.shape[0], allowed.shape[1] + 1
    count = np.bincount(col) if len(col) else np.zeros(1, np.int64)
    col, at = _thin(col, at, np.where(count >= LEAST_COUNT, np.cumsum(count >= LEAST_COUNT) - 1, -1))
    m = int(col.max()) + 1 if len(col) else 1
    prior = np.concatenate([allowed, np.ones((n, 1))], axis=1)
    resp = prior / prior.sum(axis=1, keepdims=True)
    size = np.diff(at)
    with np.errstate(divide="ignore"):
        logged = np.log(prior)
    cuts = _cuts(at)
    runs = list(zip(cuts[:-1], cuts[1:]))
    blocks = [(i, min(i + 512, n)) for i in range(0, n, 512)]
    with ThreadPoolExecutor(THREADS) as pool:
        for _ in range(rounds):
            table, score = np.empty((m, k), np.float32), np.empty((n, k))

            def count_class(c: int) -> None:
                count = np.full(m, alpha)
                for i, j in runs:
                    count += np.bincount(col[at[i] : at[j]], np.repeat(resp[i:j, c], size[i:j]), minlength=m)
                table[:, c] = np.log(count / count.sum())

            def score_block(span: tuple[int, int]) -> None:
                i, j = span
                score[i:j] = _sums(table[col[at[i] : at[j]]], at[i : j + 1] - at[i])

            list(pool.map(count_class, range(k)))
            table -= table.mean(axis=1, keepdims=True)
            list(pool.map(score_block, blocks))
            score = temper * score + logged
            score -= score.max(axis=1, keepdims=True)
            resp = np.exp(score)
            resp /= resp.sum(axis=1, keepdims=True)
    return resp


def fit_linear(col: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 60, rate: float = 0.5, l2: float = 1e-6, telling: float = 1.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot by n-gram, weights by slot, bias) of one-versus-rest logistic regressions.

    Full-batch gradients with per-weight rates. Only telling n-grams get a slot:
    those whose rate under some subject is e^telling times their overall rate.
    """
    n, classes = y.shape
    m = int(col.max()) + 1 if len(col) else 1
    size = np.diff(at)
    total = np.bincount(col, minlength=m)
    lift = np.zeros(m)
    for c in range(classes):
        per = np.bincount(col, np.repeat(y[:, c], size), minlength=m)
        lift = np.maximum(lift, (per + 0.3) / (per.sum() + 0.3 * m) / ((total + 1) / (total.sum() + m)))
    use = (total >= LEAST_COUNT) & (lift > np.exp(telling))
    slot = np.where(use, np.cumsum(use) - 1, -1).astype(np.int32)
    few, begin = _thin(col, at, slot)
    m = int(use.sum())
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(begin))
    scale = (1 / np.sqrt(np.maximum(np.diff(begin), 1))).astype(np.float32)
    cuts = _cuts(begin)
    w, bias = np.zeros((m, classes)), np.full(classes, -3.0)

    def fit_class(c: int) -> None:
        v, b, acc, acc_b = np.zeros(m), -3.0, np.full(m, 1e-8), 1e-8
        for _ in range(steps):
            g, gb = np.zeros(m), 0.0
            for i, j in zip(cuts[:-1], cuts[1:]):
                f, o = few[begin[i] : begin[j]], owner[begin[i] : begin[j]] - i
                z = np.bincount(o, v[f], j - i) * scale[i:j] + b
                err = _sigmoid(z) - y[i:j, c]
                g += np.bincount(f, (err * scale[i:j])[o], m)
                gb += err.sum()
            g = g / n + l2 * v
            acc += g * g
            v -= rate * g / np.sqrt(acc)
            gb /= n
            acc_b += gb * gb
            b -= 0.2 * rate * gb / np.sqrt(acc_b)
        w[:, c], bias[c] = v, b

    if m:  # the classes are fitted apart from each other
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(fit_class, range(classes)))
    return slot, w.astype(np.float32), bias


@dataclass
class SubjectModel:
    subjects: list[str]
    slot: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def sentence_hits(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x subjects shares of sentences, sentences per row)."""
        col, at, row = sentence_features(arr)
        p = _sigmoid(_scores(col, at, self.slot, self.weights, self.bias))
        return _shares(p, row, len(arr), self.thresholds)


def _shares(p: np.ndarray, row: np.ndarray, rows: int, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hit = p >= thresholds
    total = np.bincount(row, minlength=rows)
    out = np.stack([np.bincount(row, hit[:, c], rows) for c in range(p.shape[1])], axis=1)
    return out / np.maximum(total, 1)[:, None], total


def train(texts: list[str], labels: list[set[str]], complete: list[bool], langs: list[str], checks: tuple[list[str], list[set[str]]], subjects: list[str]) -> SubjectModel:
    """A model from weakly labelled texts; `checks` are held-out texts and labels for the thresholds.

    `complete` says whether a text's labels are all of its subjects; `langs` is
    the language of each, since general language differs by it. Without
    labels or checks the thresholds are 0.5; the model then finds nothing new.
    `texts` is emptied once it is read.
    """
    index = {s: i for i, s in enumerate(subjects)}
    col, at, row = _all_features(texts)
    texts.clear()  # the features are all that is needed of them
    slot, w, bias = np.full(DIMENSIONS, -1, np.int32), np.zeros((1, len(subjects)), np.float32), np.full(len(subjects), -3.0)
    thresholds = np.full(len(subjects), 0.5)
    if len(row):
        # a subject that an incompletely labelled text doesn't name is unlikely, but may be there
        allowed = np.where(np.array(complete)[:, None], 0.0, 0.02) * np.ones((1, len(subjects)))
        for i, ls in enumerate(labels):
            for s in ls:
                if s in index:
                    allowed[i, index[s]] = 1.0
        known = np.bincount(col, minlength=DIMENSIONS) >= LEAST_COUNT
        number = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
        few, begin = _thin(col, at, number)
        # texts of a language that has few sentences share a group
        lang = np.array(langs)[row]
        counted = {x: int((lang == x).sum()) for x in set(langs)}
        lang = np.array([x if counted[x] >= LEAST_SENTENCES else "" for x in lang])
        y = np.zeros((len(row), len(subjects)))
        for x in np.unique(lang):
            mine = np.flatnonzero(lang == x)
            n = np.diff(begin)[mine]
            inner = np.concatenate([[0], np.cumsum(n)])
            cols = few[np.repeat(begin[mine] - inner[:-1], n) + np.arange(inner[-1])]
            y[mine] = sentence_labels(cols, inner, allowed[row[mine]])[:, :-1]
        own, w, bias = fit_linear(few, begin, y)
        if len(w):
            slot[known] = own[number[known]]
        else:
            w = np.zeros((1, len(subjects)), np.float32)
    model = SubjectModel(subjects, slot, w, bias, thresholds)
    held, truth = checks
    if held:
        col, at, row = _all_features(held)
        p = _sigmoid(_scores(col, at, slot, w, bias))
        want = np.zeros((len(held), len(subjects)), bool)
        for i, ls in enumerate(truth):
            for s in ls:
                if s in index:
                    want[i, index[s]] = True
        grid = np.linspace(0.2, 0.8, 13)
        best = np.full(len(subjects), -1.0)
        for t in grid[np.argsort(abs(grid - 0.5))]:
            share, _ = _shares(p, row, len(held), np.full(len(subjects), t))
            got = share >= SHARE
            tp, fp, fn = (got & want).sum(0), (got & ~want).sum(0), (~got & want).sum(0)
            # one false call of each kind is added, so that few labels move a threshold little
            f1 = 2 * tp / np.maximum(2 * tp + fp + fn + 2, 1)
            better = f1 > best + 0.01
            thresholds[better], best = t, np.where(better, f1, best)
    return model


def _tongue(lang: str | None) -> str:
    return (lang or "").strip().lower()[:2]


def _within(sample: DataFrame, texts: DataFrame, key: str, text: str, by: Column, order: list[Column], most: int, chars: int) -> DataFrame:
    """Rows of a small sample whose texts stay within a number and a sum of characters of their group, by order; lengths alone are shuffled."""
    size = texts.filter(F.length(text) > 0).groupBy(key).agg(F.max(F.length(text)).alias("size_"))
    w = Window.partitionBy(by).orderBy(*order)
    j = sample.join(size, key).withColumn("n_", F.row_number().over(w)).withColumn("sum_", F.sum("size_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return j.filter((F.col("n_") <= most) & (F.col("sum_") <= chars)).drop("n_", "sum_", "size_")


def fit_subjects(content: DataFrame, acts: DataFrame, act_sectors: DataFrame, sector_subjects: DataFrame, documents: DataFrame, labels: DataFrame, subjects: list[str], max_acts: int = MAX_ACTS, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_FIT_CHARS) -> SubjectModel:
    """A SubjectModel from filed acts and hand-labelled documents.

    `act_sectors` has (id, val): the single sector names of each act;
    `sector_subjects` (sector_name, subject): what each name is filed under. The
    sample is bounded: the acts of each language and the labelled documents, by
    hash of their ids, up to a number and to `max_chars` characters of text (a
    longer text is in no sample). Half of the labelled documents are held out
    for thresholds.
    """
    names = sector_subjects.select(F.lower("sector_name").alias("name"), "subject").distinct()
    # an address path such as /tax/123 names a subject as well
    path = acts.select("id", F.explode(F.split(F.lower("url"), "/")).alias("subject")).filter(F.col("subject").isin(subjects))
    filed = act_sectors.select("id", F.lower("val").alias("name")).join(names, "name").select("id", "subject").union(path)
    filed = filed.filter(F.col("subject").isin(subjects)).groupBy("id").agg(F.collect_set("subject").alias("subjects"))
    spoken = acts.groupBy("id").agg(F.max("lang").alias("lang"))
    tongue = F.substring(F.lower(F.trim(F.coalesce("lang", F.lit("")))), 1, 2)
    order = [F.xxhash64("id"), F.col("id")]
    # the number bounds what meets the texts' lengths; the characters bound what is sent to the driver
    filed = filed.join(spoken, "id").withColumn("n", F.row_number().over(Window.partitionBy(tongue).orderBy(*order))).filter(F.col("n") <= max_acts).drop("n")
    filed = written(filed, "filed")
    if filed.count() > 40 * max_acts:
        raise ValueError("too many languages to fit on: lower max_acts or map the languages")
    filed = written(_within(filed, content.join(F.broadcast(filed.select("id")), "id", "left_semi"), "id", "content", tongue, order, max_acts, max_chars), "sample")
    texts = content.select("id", "content").filter(F.length("content") > 0).join(F.broadcast(filed), "id").dropDuplicates(["id"]).orderBy("id")
    rows = [(r.content, set(r.subjects), True, _tongue(r.lang)) for r in texts.collect()]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    hand = labels.filter(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(*order).limit(max_documents)
    hand = written(hand, "labelled")
    hand = _within(hand, documents.join(F.broadcast(hand.select("doc_id")), "doc_id", "left_semi"), "doc_id", "text", F.lit(0), order, max_documents, max_chars)
    some = documents.select("doc_id", "text", "lang").filter(F.length("text") > 0).join(F.broadcast(hand), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id")
    held: tuple[list[str], list[set[str]]] = ([], [])
    for r in some.collect():
        if int(mix(np.array([r.doc_id * PRIME & ((1 << 64) - 1)], np.uint64))[0]) & 1:
            held[0].append(r.text)
            held[1].append(set(r.subjects))
        else:
            rows.append((r.text, set(r.subjects), False, _tongue(r.lang)))
    texts, *rest = ([r[i] for r in rows] for i in range(4))
    rows.clear()
    return train(texts, *rest, held, subjects)


def subject_areas(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, subject, share) for every subject that a quarter of a document's sentences deal with.

    Null, empty and blank texts and texts without a sentence have none.
    Repeated rows give repeated rows.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    # the size is fixed by DIMENSIONS and the number of subjects
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array(m.subjects, pa.string())
        for b in batches:
            at = 0
            for part in row_slices(b.column(1)):
                ids = b.column(0).slice(at, len(part))
                at += len(part)
                share, _ = m.sentence_hits(part)
                i, c = np.nonzero(share >= SHARE)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), names.take(pa.array(c)), pa.array(share[i, c])], ["doc_id", "subject", "share"])

    return documents.select("doc_id", F.col("text").cast("string")).filter("text is not null").mapInArrow(run, f"doc_id {kind}, subject string, share double")


def corpus_makeup(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, lang, n_docs, n_chars, doc_share): makeup by subject and stated language; documents without a subject count under null."""
    size = documents.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    total = size.agg(F.count(F.lit(1)).alias("all"))
    each = size.join(found.select("doc_id", "subject"), "doc_id", "left").groupBy("subject", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_chars"))
    return each.join(F.broadcast(total)).select("subject", "lang", "n_docs", "n_chars", (F.col("n_docs") / F.col("all")).alias("doc_share"))
