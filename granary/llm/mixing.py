"""Sources mixed to target shares of all tokens.

Token totals per cell (source, language, topic) are raked by iterative
proportional fitting to the sources' targets and to the languages' and topics'
shares of the corpus, no cell above its source's cap of repeats. A document of a
cell is then drawn by the cell's weight: its whole part as copies, and by its
fraction once more in order sampling, which stops within a source where the
tokens it still needs are reached. Running sums over a source are built from sums
per bucket, so no task sees a whole source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import written

MAX_CELLS = 200_000
BUCKETS, REACH = 128, 4


def fill_to(total: float, share: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Amounts in proportion to share, none above its room, that sum to total as far as there is room."""
    out = np.zeros(len(share))
    free = (share > 0) & (room > 0)
    left = total
    while left > 1e-9 and free.any():
        step = left * share * free / share[free].sum()
        over = free & (out + step >= room)
        if not over.any():
            return out + step
        left -= (room - out)[over].sum()
        out[over] = room[over]
        free &= ~over
    return out


def rake(tokens: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], cap: np.ndarray, rounds: int = 200, close: float = 1e-6) -> np.ndarray:
    """Weight per cell: iterative proportional fitting to the marginals, capped; the first group's come out exact.

    groups[i] is the cell's group in marginal i and targets[i] the tokens each
    group should have.
    """
    w = np.ones(len(tokens))

    def scale(w: np.ndarray, g: np.ndarray, want: np.ndarray, exact: bool = False) -> np.ndarray:
        for _ in range(200 if exact else 1):
            have = np.bincount(g, w * tokens, len(want))
            ratio = np.divide(want, have, out=np.ones(len(want)), where=have > 0)
            new = np.minimum(w * ratio[g], cap)
            if np.allclose(new, w, rtol=1e-12, atol=0):
                return new
            w = new
        return w

    for _ in range(rounds):
        before = w
        for g, want in reversed(list(zip(groups, targets))):
            w = scale(w, g, want)
        if np.abs(w - before).max(initial=0) < close:
            break
    return scale(w, groups[0], targets[0], exact=True)


def plan_mix(cells: list[tuple], targets: dict, total_tokens: float | None = None) -> tuple[list[float], float]:
    """(weight per cell, total tokens) for cells (source, lang, topic, tokens) and targets source -> (share, max repeats).

    Without `total_tokens` the total is the largest at which every source that
    has tokens reaches its share. With it, what a source cannot give goes to
    the others in proportion. Sources without a target or a share get weight 0;
    the shares of sources without tokens go to the others in proportion.
    """
    tokens = np.array([c[3] for c in cells], float)
    names = sorted({c[0] for c in cells if c[0] in targets and targets[c[0]][0] > 0})
    if not names:
        return [0.0] * len(cells), 0.0
    index = {s: i for i, s in enumerate(names)}
    use = np.array([c[0] in index for c in cells])
    kept = [c for c, u in zip(cells, use) if u]
    tok = tokens[use]
    source = np.array([index[c[0]] for c in kept])
    cap = np.array([float(targets[c[0]][1]) for c in kept])
    share = np.array([targets[s][0] for s in names], float)
    share /= share.sum()
    room = np.bincount(source, tok * cap, len(names))
    most = float((room / share).min())
    total = most if total_tokens is None else min(float(total_tokens), room.sum())
    want = fill_to(total, share, room)
    marginals, wants = [source], [want]
    for i in (1, 2):
        values = sorted({c[i] for c in kept}, key=lambda x: (x is None, x))
        g = np.array([values.index(c[i]) for c in kept])
        have = np.bincount(g, tok, len(values))
        marginals.append(g)
        wants.append(have / have.sum() * want.sum())
    w = np.zeros(len(cells))
    w[use] = rake(tok, marginals, wants, cap)
    return w.tolist(), float(want.sum())


def mix_sources(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selection (doc_id, source, n_tokens, copies), shares per source).

    `counts` has doc_id, source, lang, topic, n_tokens and text_key, which is
    equal for equal texts; `targets` source, target_share, max_repeats. A text
    that a source holds under several ids is used under the lowest of them, so
    that it is never used more often than its source allows. Documents without tokens (null, empty) are never
    chosen. Shares: source, target_share, actual_share, available_tokens,
    tokens, n_docs, max_copies; a target without documents has zeros; sources
    without a target are not listed. The draw is a function of the seed and the
    ids only. Repeated rows of targets: the largest share counts.
    """
    spark = counts.sparkSession
    row = F.struct("doc_id", "lang", "topic", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    one = counts.filter("n_tokens > 0").groupBy("source", "text_key").agg(F.min(row).alias("r")).select("r.doc_id", "source", "r.lang", "r.topic", "r.n_tokens")
    counts = written(one, "mix-counts")
    cells = counts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")).limit(MAX_CELLS + 1).collect()
    goal = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in goal.limit(MAX_CELLS + 1).collect()}
    if max(len(cells), len(wanted)) > MAX_CELLS:
        raise ValueError("too many sources, languages or topics for the driver's table of cells")
    weights, _ = plan_mix([tuple(r) for r in cells], wanted, total_tokens)
    rows = [(r.source, r.lang, r.topic, w) for r, w in zip(cells, weights)]
    cell = spark.createDataFrame(rows, "s_ string, l_ string, t_ string, w double")
    j = counts.join(F.broadcast(cell), F.col("source").eqNullSafe(F.col("s_")) & F.col("lang").eqNullSafe(F.col("l_")) & F.col("topic").eqNullSafe(F.col("t_"))).filter("w > 0")
    whole = F.floor(F.col("w") + F.lit(1e-9))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    j = j.select("doc_id", "source", "n_tokens", whole.cast("int").alias("whole"), F.greatest(F.col("w") - whole, F.lit(0.0)).alias("part"), u.alias("u"))
    # sequential Poisson sampling: in the order of u / fraction, about a fraction's worth of documents comes before 1
    order = F.when(F.col("part") < 1e-6, F.lit(float(REACH + 1))).otherwise(F.col("u") / F.col("part"))
    j = j.withColumn("order", order).withColumn("bucket", F.least(F.floor(F.col("order") * BUCKETS), F.lit(BUCKETS * REACH)).cast("int"))
    sums = j.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"), F.sum(F.col("n_tokens") * F.col("part")).alias("need"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"), F.sum("need").over(Window.partitionBy("source")).alias("need"))
    few = len(wanted) * (BUCKETS * REACH + 1) <= MAX_CELLS
    j = j.join(F.broadcast(start) if few else start, ["source", "bucket"])
    # buckets that begin beyond what is needed add nothing and stay out of the window; the last, open one is among them unless a source is tiny
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2
    drawn = F.when((F.col("part") >= 1e-6) & (middle <= F.col("need")), 1).otherwise(0)
    open_ = F.col("start") <= F.col("need")
    run = j.filter(open_).withColumn("drawn", drawn).unionByName(j.filter(~open_ & (F.col("whole") > 0)).withColumn("drawn", F.lit(0)))
    chosen = run.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("drawn")).alias("copies")).filter("copies > 0")
    chosen = written(chosen, "mix")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("max_copies"))
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    all_tokens = got.agg(F.sum("tokens").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = goal.join(have, "source", "left").join(got, "source", "left").join(F.broadcast(all_tokens))
    shares = shares.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), zero("available_tokens").alias("available_tokens"), zero("tokens").alias("tokens"), zero("n_docs").alias("n_docs"), zero("max_copies").alias("max_copies"))
    return chosen, shares


def marginals(counts: DataFrame, chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(dimension, value, wanted, reached): shares of all tokens by source, lang and topic.

    Wanted are a source's target among the sources that have tokens, and a
    language's and topic's share of those sources' tokens, each text of a source
    once. Where a cap or a source's target leaves no room, reached differs.
    """
    goal = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target"))
    one = counts.filter("n_tokens > 0").join(F.broadcast(goal), "source")
    # the row of a text that mix_sources keeps
    have = one.groupBy("source", "text_key").agg(F.min(F.struct("doc_id", "lang", "topic", "n_tokens")).alias("r"), F.first("target").alias("target")).select("source", "r.*", "target")
    j = have.join(chosen.select("doc_id", "copies"), "doc_id", "left").withColumn("used", F.col("n_tokens") * F.coalesce("copies", F.lit(0)))
    entry = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("source", "lang", "topic")))
    g = j.select(F.explode(entry).alias("e"), "n_tokens", "used", "target").groupBy("e.dimension", "e.value").agg(F.sum("n_tokens").alias("n"), F.sum("used").alias("u"), F.max("target").alias("target"))
    w = Window.partitionBy("dimension")
    base = F.when(F.col("dimension") == "source", F.col("target")).otherwise(F.col("n"))
    return g.select("dimension", "value", (base / F.sum(base).over(w)).alias("wanted"), F.coalesce(F.col("u") / F.nullif(F.sum("u").over(w), F.lit(0)), F.lit(0.0)).alias("reached"))
