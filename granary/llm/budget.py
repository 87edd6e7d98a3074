"""Token budget per slice: longest-match counts in linear time.

The tokens of a byte vocabulary form a trie. Every node has a failure link and
the number of tokens emitted on the way along it, so that greedy longest-match
counting reads each byte once and never backs up. Texts are cut into
pre-tokens first and every distinct pre-token of a batch is counted once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.encode import Encoder
from granary.llm.pretokens import pretokens, row_slices
from granary.llm.vocab import load_ranks, vocab_path

VOCAB = "byte_bpe_50k.tiktoken"
KEEP = 200_000


class LongestMatch:
    """Linear longest-match token counter over a vocabulary of byte strings."""

    def __init__(self, vocab):
        child: dict[int, int] = {}
        final, parent, byte = [False], [0], [0]
        for token in vocab:
            v = 0
            for c in token:
                w = child.get(v << 8 | c)
                if w is None:
                    w = child[v << 8 | c] = len(final)
                    final.append(False)
                    parent.append(v)
                    byte.append(c)
                v = w
            final[v] = v != 0
        by_level: dict[int, list[int]] = {}
        for k in child.values():
            by_level.setdefault(parent[k], []).append(k)
        fail, emits = [-1] * len(final), [0] * len(final)
        queue = deque(by_level.get(0, ()))
        while queue:
            v = queue.popleft()
            queue.extend(by_level.get(v, ()))
            if final[v]:
                fail[v], emits[v] = 0, 1
                continue
            z, n = fail[parent[v]], emits[parent[v]]
            while z >= 0 and z << 8 | byte[v] not in child:
                n += emits[z]
                z = fail[z]
            if z >= 0:
                fail[v], emits[v] = child[z << 8 | byte[v]], n
        self.child, self.fail, self.emits = child, fail, emits

    def count(self, piece: bytes) -> int:
        """Tokens of the greedy longest match; a byte no token starts with counts as one."""
        child, fail, emits = self.child, self.fail, self.emits
        v = n = 0
        for c in piece:
            w = child.get(v << 8 | c)
            while w is None:
                if v == 0:  # unknown byte
                    n += 1
                    w = 0
                    break
                if fail[v] < 0:  # dead end inside a token: the bytes so far are unknown
                    n += 1
                    v = 0
                else:
                    n += emits[v]
                    v = fail[v]
                w = child.get(v << 8 | c)
            v = w
        while v > 0:
            n += max(emits[v], 1) if fail[v] < 0 else emits[v]
            v = max(fail[v], 0)
        return n


def estimated_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocab: str = VOCAB, folder: str | None = None, exact: str | None = None) -> DataFrame:
    """`df` without `text`, with the longest-match token count (0 for empty and null).

    `exact` names a further column with the count by pair merging.
    """
    path = vocab_path(vocab, folder)
    rest = [f for f in df.schema.fields if f.name not in (text, out, exact)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = LongestMatch(load_ranks(path)), {}
        encoder = Encoder(path) if exact else None

        def of(piece: bytes) -> int:
            got = known.get(piece)
            if got is None:
                got = m.count(piece)
                if len(known) < KEEP and len(piece) < 64:  # bounds a task's memory; only saves time
                    known[piece] = got
            return got

        for b in batches:
            counts, merged = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in row_slices(b.column(len(rest))):
                tokens, rows = pretokens(part)
                coded = tokens.dictionary_encode()
                each = np.fromiter(map(of, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
                counts.append(np.diff(total[rows]))
                if encoder:
                    merged.append(encoder.counts(part))
            more = [pa.array(np.concatenate(x), pa.int64()) for x in ([counts, merged] if encoder else [counts])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *more], [*(f"c{i}" for i in range(len(rest))), "n_", "e_"][: len(rest) + len(more)])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)), "n_ bigint", *(["e_ bigint"] if exact else [])])
    got = df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(text).cast("string")).mapInArrow(run, schema)
    return got.toDF(*(f.name for f in rest), out, *([exact] if exact else []))


def token_budget(chunks: DataFrame, acts: DataFrame, sectors: DataFrame, vocab: str = VOCAB, folder: str | None = None, exact: bool = False) -> DataFrame:
    """Token and chunk totals per slice: (slice, key1, key2, n_chunks, n_tokens, n_chars), with `exact` also n_exact by pair merging.

    slice is `site_lang` (key1 = source_site, key2 = lang of the act),
    `legal_type` (key1, in lower case without outer space) or `sector` (key1, one
    value of legal_sectors in lower case; a chunk counts in each of its
    sectors). `sectors` has (chunk_id, sector). Chunks without a metadata row
    or value count under null. Rows that repeat a chunk_id are one chunk, the
    latest; rows that repeat an act's id are one act, the latest. Null chunk_ids
    count row by row.
    """
    t = estimated_tokens(chunks.select("chunk_id", "document_id", "created_at", "legal_type", F.length("text").alias("n_chars"), "text"), "text", vocab=vocab, folder=folder, exact="n_exact" if exact else None)
    sums = ["n_tokens", "n_chars", *(["n_exact"] if exact else [])]
    row = F.struct("created_at", *sums, "document_id", "legal_type")
    one = t.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max(row).alias("r")).select("chunk_id", "r.*")
    one = one.unionByName(t.filter("chunk_id is null"))
    act = acts.groupBy("id").agg(F.max(F.struct("crawled_at", "source_site", "lang")).alias("a")).select(F.col("id").alias("document_id"), "a.source_site", "a.lang")
    slices = sectors.groupBy("chunk_id").agg(F.collect_set("sector").alias("names"))
    joined = one.join(slices, "chunk_id", "left")
    per_act = joined.groupBy("document_id", "legal_type", "names").agg(F.count(F.lit(1)).alias("n_chunks"), *(F.sum(c).alias(c) for c in sums))
    wide = per_act.join(act, "document_id", "left")
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("slice"), a.alias("key1"), b.alias("key2"))
    none = F.lit(None).cast("string")
    entries = F.concat(
        F.array(entry("site_lang", F.col("source_site"), F.col("lang")), entry("legal_type", F.lower(F.trim("legal_type")), none)),
        F.transform(F.coalesce("names", F.array(none)), lambda s: entry("sector", s, none)),
    )
    return (
        wide.select(F.explode(entries).alias("e"), "n_chunks", *sums)
        .groupBy("e.slice", "e.key1", "e.key2")
        .agg(F.sum("n_chunks").alias("n_chunks"), *(F.sum(c).alias(c) for c in sums))
    )
