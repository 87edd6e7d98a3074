"""Token ids of every text under a public byte-level BPE vocabulary."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.pretokens import pretokens, row_slices
from granary.llm.vocab import load_ranks, vocab_path

VOCAB = "byte_bpe_50k.tiktoken"
KEEP = 200_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair merges first, leftmost first.

    A heap of candidate pairs over a linked list keeps long pieces at
    n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        left, j = parts[i], after[i]
        if left is None or j < 0 or left + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, pair + parts[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + pair))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes Arrow string arrays; merges are cached by pre-token."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.known: dict[bytes, list[int]] = {}

    def of(self, piece: bytes) -> list[int]:
        got = self.known.get(piece)
        if got is None:
            got = merge(piece, self.ranks)
            if len(self.known) < KEEP and len(piece) < 64:  # bounds a task's memory; only saves time
                self.known[piece] = got
        return got

    def encode(self, arr: pa.Array) -> pa.Array:
        """list<int32> of ids per row; empty for empty and null texts."""
        tokens, rows = pretokens(arr)
        coded = tokens.dictionary_encode()
        ids = [self.of(p) for p in coded.dictionary.to_pylist()]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.int32, int(lens.sum()))
        begin = np.concatenate([[0], np.cumsum(lens)])
        use = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = lens[use]
        out = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(begin[use] - out[:-1], size) + np.arange(out[-1])
        return pa.ListArray.from_arrays(pa.array(out[rows].astype(np.int32)), pa.array(flat[index]))

    def ends(self, ids: pa.Array) -> pa.Array:
        """list<int32>: the byte of its text at which each id ends."""
        if not hasattr(self, "size"):
            self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
            self.size[list(self.ranks.values())] = [len(t) for t in self.ranks]
        at, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(self.size[flat])])
        row = np.repeat(total[at[:-1] - at[0]], np.diff(at))
        return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array((total[1:] - row).astype(np.int32)))

    def counts(self, arr: pa.Array) -> np.ndarray:
        """Number of ids per row."""
        tokens, rows = pretokens(arr)
        coded = tokens.dictionary_encode()
        lens = np.fromiter((len(self.of(p)) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        total = np.concatenate([[0], np.cumsum(lens[coded.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(total[rows])


def token_ids(df: DataFrame, key: str, text: str, vocab: str = VOCAB, folder: str | None = None, offsets: bool = False) -> DataFrame:
    """(key, ids) for every row of `df`, without special tokens.

    Empty and null texts give an empty list; strings that look like special
    tokens are ordinary text. Repeated rows stay repeated; an empty table gives
    an empty one. Decoding the ids gives back the text's bytes. With `offsets`
    there is also `ends`, the byte of the text at which each token ends, so that
    tokens map back to their places.
    """
    path = vocab_path(vocab, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path)
        for b in batches:
            at = 0
            for part in row_slices(b.column(1)):
                ids = e.encode(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids, *([e.ends(ids)] if offsets else [])], ["k_", "ids", "ends"][: 2 + offsets])
                at += len(part)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"k_ {kind}, ids array<int>" + (", ends array<int>" if offsets else "")).withColumnRenamed("k_", key)


def decode(df: DataFrame, key: str, ids: str, vocab: str = VOCAB, folder: str | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids; null and empty lists give an empty text.

    Bytes of a cut list that are no whole characters become U+FFFD; an id
    outside the vocabulary is an error.
    """
    path = vocab_path(vocab, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {i: t for t, i in load_ranks(path).items()}
        for b in batches:
            texts = [b"".join(back[i] for i in x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k_", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"k_ {kind}, text string").withColumnRenamed("k_", key)


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", vocab: str = VOCAB, folder: str | None = None) -> DataFrame:
    """`df` without `text`, with the number of its tokens (0 for empty and null)."""
    path = vocab_path(vocab, folder)
    rest = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path)
        for b in batches:
            col = b.column(len(rest))
            n = [e.counts(part) for part in row_slices(col)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], [*(f"c{i}" for i in range(len(rest))), "n_"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)), "n_ bigint"])
    got = df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(text).cast("string")).mapInArrow(run, schema)
    return got.toDF(*(f.name for f in rest), out)
