"""Lines that a site puts into its documents.

Every line gets a key that ignores case, spacing, framing marks, markup, letter
form and numbers; a second key also ignores what follows a label and its
colon (a name). Distinct documents are counted per source and key, and keys
that reach a share of the source's documents are the site's own, unless most
sources share the line or it is a value of the documents' own fields. The lines
are then joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.pretokens import row_slices
from granary.llm.words import PRIME, Words, bare_array, mix
from granary.operators.corpus import latest_of_few
from granary.session import written

SHARE, LEAST = 0.05, 6
#: Up to so many frequent keys go to every task; beyond, the lines are found by joins. The results are the same.
BROADCAST_ROWS = 200_000
SALTS = 32
NUMBER, NAME, DOCUMENT = np.uint64(0x6E756D62), np.uint64(0x6E616D65), 0
STEP = np.uint64(PRIME ^ 0x5A5A5A5A5A5A)
#: Rows with an id and a sign that is not blank. The trim ends at the first such sign, whatever the length of the text.
WITH_TEXT = "id is not null and trim(leading ' \\r\\n\\t' from content) <> ''"


class LineKeys:
    """Keys of the lines of a batch: row, line (from 0), key, label key (0: no colon with words on both sides)."""

    def __init__(self, w: Words):
        h = np.where(w.digit, NUMBER, w.hash)
        line = w.first_line[w.row] + w.line
        if not len(h):
            self.row = self.line = np.zeros(0, np.int64)
            self.key = self.label = np.zeros(0, np.uint64)
            self.of_word = np.zeros(0, np.int64)
            return
        new = np.append(True, line[1:] != line[:-1])
        self.of_word = np.cumsum(new) - 1
        word = np.flatnonzero(new)
        self.row, self.line = w.row[word], w.line[word]
        keep = new | ~(w.digit & np.append(False, w.digit[:-1]))
        h, new, colon = h[keep], new[keep], w.colon[keep]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(h)))
        k = np.arange(len(h)) - np.repeat(begin, size)
        power = np.full(int(size.max()) + 1, STEP)
        power[0] = 1
        part = h * np.multiply.accumulate(power)[k]
        self.key = mix(np.add.reduceat(part, begin))
        running = np.cumsum(part, dtype=np.uint64)
        before = running[begin] - part[begin]
        # the first colon of a line, if words follow
        at = np.minimum.reduceat(np.where(colon, k, len(h)), begin)
        self.label = np.where(at < size - 1, mix(running[np.minimum(begin + at, len(h) - 1)] - before + NAME), np.uint64(0))


def line_keys(content: DataFrame) -> DataFrame:
    """(id, site, line_no, key, label) of every line with words; line 0 stands for the document."""
    kind = content.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in row_slices(b.column(2)):
                ids, sites = b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part))
                at += len(part)
                k = LineKeys(Words(bare_array(part)))
                docs = np.arange(len(part))
                rows = pa.array(np.concatenate([docs, k.row]))
                label = np.concatenate([np.zeros(len(docs), np.int64), k.label.view(np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows), sites.take(rows), pa.array(np.concatenate([np.zeros(len(docs)), k.line + 1]).astype(np.int32)), pa.array(np.concatenate([np.full(len(docs), DOCUMENT), k.key.view(np.int64)])),
                        pa.array(label, mask=label == 0),
                    ],
                    ["id", "site", "line_no", "key", "label"],
                )

    some = content.select("id", F.col("source_site").cast("string"), F.col("content").cast("string")).filter(WITH_TEXT)
    return some.mapInArrow(run, f"id {kind}, site string, line_no int, key bigint, label bigint")


def _keys_of_lines(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select("id", "site", *more, F.explode(F.array_compact(F.array("key", "label"))).alias("key"))


def field_keys(values: DataFrame) -> DataFrame:
    """(key): the line keys of texts that belong to the documents themselves, from (text)."""
    rows = values.filter("text is not null").distinct().select(F.lit(0).alias("id"), F.lit("").alias("source_site"), F.col("text").alias("content"))
    return line_keys(rows).filter("line_no > 0").select("key").distinct()


def frequent_keys(lines: DataFrame, share: float = SHARE, least: int = LEAST, fields: DataFrame | None = None) -> DataFrame:
    """(site, key) of the lines that are a site's own, from `line_keys`.

    A key that stands in more than half of the sites, and in three at least, each
    time at a quarter or more of its highest share, belongs to the documents
    themselves, as do the keys of `fields`.
    """
    n = _keys_of_lines(lines).distinct().groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"))
    n = written(n.filter(F.col("n") >= 2), "line-counts")
    docs = n.filter(F.col("key") == DOCUMENT).select("site", F.col("n").alias("docs"))
    shares = n.filter(F.col("key") != DOCUMENT).alias("n").join(docs.alias("d"), F.col("n.site").eqNullSafe(F.col("d.site"))).select("n.site", "key", "n", (F.col("n") / F.col("docs")).alias("share"))
    own = shares.filter((F.col("share") >= share) & (F.col("n") >= least))
    top = own.groupBy("key").agg(F.max("share").alias("top"))
    wide = shares.filter(F.col("share") >= share / 4).join(top, "key").groupBy("key").agg(F.count_if(F.col("share") >= F.col("top") / 4).alias("wide"))
    sites = docs.agg(F.count(F.lit(1)).alias("sites"))
    of_acts = wide.join(F.broadcast(sites)).filter((F.col("wide") * 2 > F.col("sites")) & (F.col("wide") >= 3)).select("key")
    own = own.join(of_acts, "key", "left_anti")
    if fields is not None:
        own = own.join(field_keys(fields), "key", "left_anti")
    return own.select("site", "key")


def _lines_with(lines: DataFrame, frequent: DataFrame, small: bool) -> DataFrame:
    """Distinct (id, line_no) of the lines whose key is a frequent one of their site.

    Where the keys are too many to go to every task, both sides are spread over
    SALTS parts of a key, since one key may stand in most documents.
    """
    keys = frequent.withColumnRenamed("site", "s_").withColumnRenamed("key", "k_")
    mine = _keys_of_lines(lines.filter("line_no > 0"), "line_no")
    on = F.col("site").eqNullSafe(F.col("s_")) & (F.col("key") == F.col("k_"))
    if small:
        found = mine.join(F.broadcast(keys), on, "left_semi")
    else:
        keys = keys.withColumn("t_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = mine.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        found = mine.join(keys, on & (F.col("salt") == F.col("t_")), "left_semi")
    return found.select("id", "line_no").distinct()


def is_small(frequent: DataFrame, most: int) -> bool:
    return frequent.limit(most + 1).count() <= most


def site_lines(content: DataFrame, share: float = SHARE, least: int = LEAST, fields: DataFrame | None = None, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(distinct (id, line_no) of the site's lines, frequent (site, key)).

    `content` has id, source_site, content; `fields` (text) the values of the
    documents' own fields, which are never a site's lines. Null and blank
    contents, rows without an id and empty tables give no lines; rows that
    repeat an id count once; a null source_site is a site of its own. Other
    columns are not read.
    """
    lines = written(line_keys(content), "line-keys")
    frequent = written(frequent_keys(lines, share, least, fields), "site-keys")
    return _lines_with(lines, frequent, is_small(frequent, most)), frequent


def site_keys(content: DataFrame, share: float = SHARE, least: int = LEAST, fields: DataFrame | None = None) -> DataFrame:
    """The frequent (site, key) of `site_lines` alone; the lines, which feed only the counts, are not stored."""
    return written(frequent_keys(line_keys(content), share, least, fields), "site-keys")


class Frequent:
    """Which lines of a batch are a site's own: by sorted keys of each site, or by each row's list of lines."""

    def __init__(self, rows=None):
        by: dict[str | None, list[int]] = {}
        for site, key in rows or ():
            by.setdefault(site, []).append(key)
        self.by = {s: np.sort(np.array(k, np.int64).view(np.uint64)) for s, k in by.items()}
        self.listed = rows is None

    def lines(self, w: Words, sites: list, drop: list) -> tuple[LineKeys, np.ndarray]:
        """(line keys of a batch, which of its lines are a site's own)."""
        k = LineKeys(w)
        own = np.zeros(len(k.key), bool)
        if self.listed:
            flat = [(i, n - 1) for i, ns in enumerate(drop) for n in ns or ()]
            if flat:
                i, n = np.array(flat, np.int64).T
                own = np.isin(k.row << 32 | k.line, i << 32 | n)
        else:
            for s in set(sites) & set(self.by):
                mine = np.array([x == s for x in sites])[k.row]
                own |= mine & (np.isin(k.key, self.by[s]) | np.isin(k.label, self.by[s]))
        return k, own

    def kept_words(self, w: Words, sites: list, drop: list) -> np.ndarray | None:
        """Which words are in no line of the site; None if there are no frequent lines."""
        if not (self.listed or self.by) or not len(w.hash):
            return None
        k, own = self.lines(w, sites, drop)
        return ~own[k.of_word]


def with_drops(content: DataFrame, frequent: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, Frequent]:
    """((id, source_site, content, drop), Frequent) for the tasks that set site lines aside.

    `content` has one row per id. Up to `most` frequent keys go to every task
    and no text is shuffled; beyond, each row gets the numbers of its lines by a
    join on its id.
    """
    c = content.select("id", F.col("source_site").cast("string"), F.col("content").cast("string"))
    if is_small(frequent, most):
        return c.withColumn("drop", F.lit(None).cast("array<int>")), Frequent([(r.site, r.key) for r in frequent.select("site", "key").collect()])
    drops = _lines_with(line_keys(c), frequent, False).groupBy("id").agg(F.collect_list("line_no").alias("drop"))
    return c.join(written(drops, "drops"), "id", "left"), Frequent()


def without_lines(content: DataFrame, frequent: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(id, source_site, content, n_removed): one row per id (the latest), its site lines taken out.

    `frequent` has the (site, key) of `site_lines`. Null contents stay null,
    blank ones as they are. Line ends stay.
    """
    kind = content.schema["id"].dataType.simpleString()
    last = latest_of_few(content.select("id", "source_site", "content", "crawled_at"), "id", [F.col("crawled_at").desc_nulls_last(), F.xxhash64("content")])
    rows, keys = with_drops(last, frequent, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in row_slices(b.column(2)):
                ids, sites, drop = (b.column(i).slice(at, len(part)) for i in (0, 1, 3))
                at += len(part)
                k, own = keys.lines(Words(bare_array(part)), sites.to_pylist(), drop.to_pylist())
                bad: dict[int, set[int]] = {}
                for i, j in zip(k.row[own].tolist(), k.line[own].tolist()):
                    bad.setdefault(i, set()).add(j)
                texts = part.to_pylist()
                for i, out in bad.items():
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in out)
                yield pa.RecordBatch.from_arrays([ids, sites, pa.array(texts, pa.string()), pa.array([len(bad.get(i, ())) for i in range(len(texts))], pa.int32())], ["id", "source_site", "content", "n_removed"])

    return rows.select("id", "source_site", "content", "drop").mapInArrow(run, f"id {kind}, source_site string, content string, n_removed int")
