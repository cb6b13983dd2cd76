"""Filling fixed-capacity containers with items (problem 6).

Shortest-pack-first over the length histogram: lengths are placed longest first, each into
the packs with the most room left; packs of one make-up are one pattern with a count, so the
work depends on the number of different lengths, not of items.  The patterns are joined back
to the items by an item's rank among those of its length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.common import checkpoint, ranked

Pattern = tuple[int, list[tuple[int, int]]]  # packs, [(length, how many of it in each pack)]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold all items of ``histogram`` (length up to ``capacity`` -> number)."""
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-room, tie, packs, pattern)
    serial = 0

    def push(room: int, count: int, pattern: list[tuple[int, int]]) -> None:
        nonlocal serial
        if count:
            serial += 1
            heapq.heappush(packs, (-room, serial, count, pattern))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left = histogram[length]
        while left and packs and -packs[0][0] >= length:
            room, _, count, pattern = heapq.heappop(packs)
            used = min(left, count)
            push(-room, count - used, pattern)
            last = pattern[-1]
            grown = [*pattern[:-1], (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)]
            push(-room - length, used, grown)
            left -= used
        each = capacity // length
        push(capacity - each * length, left // each, [(length, each)])
        if left % each:
            push(capacity - left % each * length, 1, [(length, left % each)])
    patterns = [(count, pattern) for _, _, count, pattern in sorted(packs, key=lambda p: p[1])]
    if empty := histogram.get(0):  # items without length go to the first pack, whatever their number
        if not patterns:
            return [(1, [(0, empty)])]
        count, pattern = patterns[0]
        patterns = [(1, [*pattern, (0, empty)]), *([(count - 1, pattern)] if count > 1 else []), *patterns[1:]]
    return patterns


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Sorted rows (length, first rank from 0, items a pack, first container)."""
    next_rank: dict[int, int] = {}
    rows, container = [], 0
    for count, pattern in patterns:
        for length, each in pattern:
            low = next_rank.get(length, 0)
            rows.append((length, low, each, container))
            next_rank[length] = low + count * each
        container += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def whitespace_tokens(text: Column) -> Column:
    """Number of maximal runs of characters other than space, \\t, \\n, \\v, \\f and \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens under the byte-level BPE whose ranks are in the file ``vocabulary``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "n_tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.text]})

    return df.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long")


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, pieces, token_from, token_to, n_tokens, container_id for ``sizes`` (doc_id, n_tokens).

    An item larger than ``capacity`` is cut into full pieces and a rest; all others are whole.
    A null or negative size counts as 0; items of size 0 share the first container.  Repeated
    rows are items of their own.  What reaches the driver is the histogram, at most
    ``capacity + 1`` rows, and what goes to the tasks are its patterns.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = checkpoint(sizes.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("_n")))
    parts = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int")
    pieces = (
        sized.withColumn("pieces", parts)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("token_from", F.col("piece").cast("long") * capacity)
        .withColumn("token_to", F.least(F.col("token_from") + capacity, F.col("_n")))
        .withColumn("n_tokens", F.col("token_to") - F.col("token_from"))
        .drop("_n")
    )
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    table = slots(pack_histogram(histogram, capacity))
    ranks = ranked(pieces, ["n_tokens"], F.xxhash64("doc_id", "piece"), ["doc_id", "piece"], rank="_rank")
    if not len(table):
        return ranks.withColumn("container_id", F.lit(0).cast("long")).drop("_rank")
    length, low, each, first = table.T
    lengths, starts = np.unique(length, return_index=True)

    @F.pandas_udf("long")
    def container(n: pd.Series, rank: pd.Series) -> pd.Series:
        # A rank's slot: the last of its length that begins at or before it.
        order = np.lexsort((rank.to_numpy(), n.to_numpy()))
        n_sorted, r_sorted = n.to_numpy()[order], rank.to_numpy()[order] - 1
        out = np.empty(len(order), np.int64)
        cut = np.flatnonzero(np.r_[True, n_sorted[1:] != n_sorted[:-1], True]) if len(order) else np.zeros(1, int)
        for a, b in zip(cut[:-1], cut[1:]):
            k = int(np.searchsorted(lengths, n_sorted[a]))
            s0, s1 = starts[k], starts[k + 1] if k + 1 < len(starts) else len(low)
            at = s0 + np.searchsorted(low[s0:s1], r_sorted[a:b], side="right") - 1
            out[order[a:b]] = first[at] + (r_sorted[a:b] - low[at]) // each[at]
        return pd.Series(out)

    return ranks.withColumn("container_id", container("n_tokens", "_rank")).select("doc_id", "piece", "pieces", "token_from", "token_to", "n_tokens", "container_id")
