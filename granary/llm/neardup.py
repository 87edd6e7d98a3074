"""Near-duplicate documents through DartMinHash signatures and banded joining.

Every element of a document's set owns a region of unit weight in which darts
arrive as a Poisson process in rank order, all drawn by hashing the element,
so equal elements of two documents get equal darts. A document keeps the darts
up to the rank at which about k (ln k + 2) of them have come, and of each of k
coordinates the earliest dart. Two documents agree on a coordinate with the
probability of their Jaccard similarity; bands of coordinates are joined.
Candidate pairs pass a comparison of two-bit sketches and then an exact one.

Documents with equal sets form a class and only one of them is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.pretokens import row_slices
from granary.llm.sitelines import BROADCAST_ROWS, WITH_TEXT, Frequent, with_drops
from granary.llm.words import MASK, PRIME, Words, bare_array, mix
from granary.operators.corpus import latest_of_few
from granary.session import written

K, BANDS, ROWS = 256, 160, 5
#: A sketch has the lowest two bits of every coordinate, 32 coordinates to a long.
SKETCH = [f"s{i}" for i in range(K // 32)]
CANDIDATE_ROWS = 2_000_000


def shingle_sets(w: Words, n: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets by row): the distinct n-word shingles of each row, sorted.

    A row of fewer than n words has one element, made of all of them; a row
    without words has none.
    """
    g, r = w.ngrams(n, keep)
    h, hr = (w.hash, w.row) if keep is None else (w.hash[keep], w.row[keep])
    size = np.bincount(hr, minlength=w.rows)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        begin = np.searchsorted(hr, short)
        extra = np.array([mix(np.array([np.bitwise_xor.reduce(h[b : b + size[i]] * np.uint64(PRIME) + np.arange(size[i], dtype=np.uint64)) & np.uint64((1 << 64) - 1)], np.uint64))[0] for b, i in zip(begin, short)], np.uint64)
        g, r = np.concatenate([g, extra]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    at = np.searchsorted(r, np.arange(w.rows + 1))
    for i in range(w.rows):
        g[at[i] : at[i + 1]].sort()
    first = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))[: len(g)]
    return g[first], np.concatenate([[0], np.cumsum(first)])[at]


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(elements: np.ndarray, at: np.ndarray, k: int = K, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (rows x k, uint64; 0 in rows without elements).

    With `weights` (in (0, 1]) a dart lands at a height of its element's unit
    region and counts only below the element's weight, so that coordinates
    agree with the weighted Jaccard similarity.
    """
    rows = len(at) - 1
    sig = np.zeros((rows, k), np.uint64)
    size = np.diff(at)
    todo, reach = np.flatnonzero(size > 0), k * (math.log(k) + 2)
    total = size.astype(np.float64) if weights is None else np.add.reduceat(np.append(weights, 0.0), np.minimum(at[:-1], len(weights)))
    while len(todo):
        ranks = np.full(rows * k, np.inf)
        ids = np.zeros(rows * k, np.uint64)
        limit = reach / np.maximum(total[todo], 1e-9)
        n = size[todo]
        idx = np.repeat(at[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        e, row, lim = elements[idx], np.repeat(todo, n), np.repeat(limit, n)
        weight = None if weights is None else weights[idx]
        rank, step = np.zeros(len(e)), 1
        found = []
        while len(e):
            h = mix(e + np.uint64(step * PRIME & MASK))
            rank = rank - np.log(_uniform(h))
            live = np.flatnonzero(rank <= lim)
            e, row, lim, rank, h = (x.take(live) for x in (e, row, lim, rank, h))
            dart = mix(h ^ np.uint64(0xD1B54A32D192ED03))
            if weight is None:
                found.append((row, rank, dart))
            else:
                weight = weight.take(live)
                low = _uniform(mix(h + np.uint64(7))) < weight
                found.append((row[low], rank[low], dart[low]))
            step += 1
        row, rank, dart = (np.concatenate(x) for x in zip(*found))
        cell = row * k + (dart % np.uint64(k)).astype(np.int64)
        np.minimum.at(ranks, cell, rank)
        first = rank == ranks[cell]
        ids[cell[first]] = dart[first]
        got, seen = ids.reshape(rows, k), np.isfinite(ranks).reshape(rows, k)
        sig[todo] = got[todo]
        todo = todo[~seen[todo].all(axis=1)]
        reach *= 2
    return sig


#: Coordinates of each band; no band has one twice.
_order = np.concatenate([np.random.default_rng(11 + i).permutation(K)[: K // ROWS * ROWS].reshape(-1, ROWS) for i in range(math.ceil(BANDS / (K // ROWS)))])[:BANDS]


def bands(sig: np.ndarray) -> np.ndarray:
    """(rows x BANDS) int32: a hash of each band's coordinates."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        out = mix(out + sig[:, _order[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(rows x len(SKETCH)) int64."""
    two = ((sig >> np.uint64(40)) & np.uint64(3)).reshape(len(sig), len(SKETCH), 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _differing(a: str, b: str) -> Column:
    """How many coordinates of two sketches differ."""
    out = F.lit(0)
    for s in SKETCH:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def _sets(batches: Iterator[pa.RecordBatch], frequent: Frequent, n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, elements, offsets) of (id, site, text, drop) batches."""
    for b in batches:
        at = 0
        for part in row_slices(b.column(2)):
            ids, sites, drop = (b.column(i).slice(at, len(part)) for i in (0, 1, 3))
            at += len(part)
            w = Words(bare_array(part))
            yield ids, *shingle_sets(w, n, frequent.kept_words(w, sites.to_pylist(), drop.to_pylist()))


def _nonblank(content: DataFrame) -> DataFrame:
    return content.select("id", "source_site", "content", "drop").filter(WITH_TEXT)


def signatures(content: DataFrame, frequent: Frequent, n: int = 3) -> DataFrame:
    """(id, set_hash, size, sketch, bands) of the contents that have words."""
    kind = content.schema["id"].dataType.simpleString()
    pieces = pa.struct([(s, pa.int64()) for s in SKETCH])

    def run(batches):
        for ids, e, at in _sets(batches, frequent, n):
            size = np.diff(at)
            i = np.flatnonzero(size > 0)
            if not len(i):
                continue
            sums = np.add.reduceat(np.append(mix(e + np.uint64(3)), np.uint64(0)), np.minimum(at[:-1], len(e)))
            sig = dart_minhash(e, at)[i]
            sketch = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(sketches(sig).T)], fields=list(pieces))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * BANDS), pa.array(bands(sig).ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(sums.view(np.int64)[i]), pa.array(size[i].astype(np.int32)), sketch, lists], ["id", "set_hash", "size", "sketch", "bands"])

    parts = ", ".join(f"{s}: bigint" for s in SKETCH)
    return _nonblank(content).mapInArrow(run, f"id {kind}, set_hash bigint, size int, sketch struct<{parts}>, bands array<int>")


def element_sets(content: DataFrame, frequent: Frequent, n: int = 3) -> DataFrame:
    """(id, elements as binary: sorted 32-bit values)."""
    kind = content.schema["id"].dataType.simpleString()

    def run(batches):
        for ids, e, at in _sets(batches, frequent, n):
            small = (e >> np.uint64(32)).astype(np.uint32)  # sorted, since the elements are
            yield pa.RecordBatch.from_arrays([ids, pa.array([small[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "elements"])

    return _nonblank(content).mapInArrow(run, f"id {kind}, elements binary")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
        shared, union = [], []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
            s = len(np.intersect1d(p, q, assume_unique=True))
            shared.append(s)
            union.append(len(p) + len(q) - s)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int32()), pa.array(union, pa.int32())], ["a", "b", "shared", "total"])


def near_pairs(content: DataFrame, frequent: DataFrame, threshold: float = 0.55, n: int = 3, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(classes (id, rep), pairs of reps (a, b, similarity) with a < b).

    `content` has id, source_site and content; `frequent` the (site, key) of the
    lines to set aside. A class holds the ids with equal sets, its rep is its
    lowest id; of rows that repeat an id one counts. Null and blank contents and
    contents without a word belong to no class. Ties at the threshold count.
    """
    kind = content.schema["id"].dataType.simpleString()
    once = latest_of_few(content.select("id", "source_site", "content"), "id", [F.xxhash64("content", "source_site")])
    content, keys = with_drops(once, frequent, most)
    made = written(signatures(content, keys, n), "signatures")
    reps = made.select("set_hash", "size", "id")
    rep_of = reps.groupBy("set_hash", "size").agg(F.min("id").alias("rep"))
    classes = written(reps.join(rep_of, ["set_hash", "size"]).select("id", "rep").distinct(), "classes")
    # the wide rows of the reps stay where they are: the others are few as a rule
    others = classes.filter("id <> rep").select("id")
    rows = made.join(F.broadcast(others) if others.count() <= CANDIDATE_ROWS else others, "id", "left_anti")
    long = rows.select("id", F.posexplode("bands").alias("no", "hash")).select("id", F.shiftleft(F.col("no").cast("bigint"), 32).bitwiseXOR(F.col("hash").cast("bigint")).alias("band"))
    # hashed by the lower id once, for the distinct pairs and for the join that follows
    raw = long.alias("x").join(long.alias("y"), "band").filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).repartition("a").distinct()
    one, two = (rows.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    # two bits agree with the probability J + (1 - J) / 4; four standard deviations below it
    p = (1 + 3 * threshold) / 4
    most_differ = K * (1 - p) + 4 * math.sqrt(K * p * (1 - p))
    near = raw.join(one, "a").join(two, "b").filter(F.least("size_a", "size_b") >= (threshold - 0.01) * F.greatest("size_a", "size_b")).filter(_differing("sketch_a", "sketch_b") <= most_differ)
    near = written(near.select("a", "b"), "candidates")
    wanted = written(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "candidate-ids")
    few = wanted.count() <= CANDIDATE_ROWS
    some = content.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    sets = written(element_sets(some, keys, n), "sets")
    both = near.join(sets.toDF("a", "ea"), "a").join(sets.toDF("b", "eb"), "b").select("a", "b", "ea", "eb")
    sure = both.mapInArrow(_overlap, f"a {kind}, b {kind}, shared int, total int").filter(F.col("shared") >= F.lit(threshold) * F.col("total"))
    pairs = written(sure.select("a", "b", (F.col("shared") / F.col("total")).alias("similarity")), "pairs")
    return classes, pairs


def id_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b: all pairs of ids that the classes and pairs stand for."""
    member = classes.select("rep", "id")
    x, y = member.toDF("a", "id_a"), member.toDF("b", "id_b")
    across = pairs.select("a", "b").join(x, "a").join(y, "b")
    inside = member.toDF("r", "id_a").join(member.toDF("r", "id_b"), "r").filter("id_a < id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).union(inside.select("id_a", "id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of `edges` (a, b): the lowest id that can be reached.

    Alternates links to the lowest neighbour for higher and for lower
    neighbours (large and small stars) until nothing changes, which takes about
    the logarithm of the longest chain in rounds; each round is written to the
    shared folder.
    """
    e = written(edges.select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        e = written(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before:
            break
        before = state
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(e.select(F.col("b"), F.col("b")).distinct()).groupBy("id").agg(F.min("component").alias("component"))


def near_groups(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, group_id, n_links): one row per id that has words.

    rep is the lowest id with the same text, group_id the lowest id reached over
    links, n_links the number of linked texts that differ from it.
    """
    part = components(pairs).toDF("rep", "component")
    links = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    j = classes.join(part, "rep", "left").join(links, "rep", "left")
    return j.select("id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))
