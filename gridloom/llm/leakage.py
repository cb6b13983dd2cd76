"""Evaluation texts that leak into training text, by spaced-seed hashing (problem 7).

Texts become words: maximal runs of Unicode letters and digits in lower case, each a 64-bit
hash.  Fixed masks select some of the words of a window and ignore the others, so a substituted
word at an ignored position leaves the window's hash alone.  Hashes of test passages and of all
windows of the documents are joined; on the diagonal of each hit the passage is laid along the
document and compared word by word, with substitutions.

The two masks find every overlap of 30 words or more of which nine tenths are equal: no choice of
up to 3 substituted words in 30, 4 in 40 or 5 in 50 leaves no window of either mask untouched
(gone through completely in the tests), and a longer overlap can be cut into parts of 30 to 59
words, one of which has no more than its tenth.  Passages too short for the masks are hashed by
their first 1, 2, 4, 8 or 16 words and must stand whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Selected word positions of a window.
MASKS = ((0, 1, 2, 3, 7, 11, 13, 14, 15, 16), (0, 1, 2, 4, 5, 7, 9, 12, 14, 18))
#: Numbers of leading words by which short passages are hashed.
PREFIXES = (1, 2, 4, 8, 16)
WORD = re.compile(r"[^\W_]+")
#: Characters of test passages up to which their hashes are broadcast; beyond, both sides are shuffled by hash.
BROADCAST_CHARS = 4_000_000
#: Words handled at once in a task, words compared at once, word hashes remembered, diagonals verified at once.
WORDS_AT_ONCE, COMPARED_AT_ONCE, REMEMBERED, DIAGONALS_AT_ONCE = 400_000, 4_000_000, 1_000_000, 500

RESULT = "doc_id long, item_id long, exact_words int, overlap_words int, matching_words int, passage_words int"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_FACTORS = np.random.default_rng(11).integers(1, 2**63, (len(MASKS) + len(PREFIXES), 20), dtype=np.uint64) | np.uint64(1)
_ALL = (*MASKS, *(tuple(range(n)) for n in PREFIXES))


class _WordHashes(dict):
    """Word -> 64-bit hash, never 0; a bounded number is remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word) or 1
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_hashes = _WordHashes()


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def window_hashes(seq: np.ndarray, m: int) -> np.ndarray:
    """Hash of the window at each place for mask or prefix number ``m``."""
    mask = _ALL[m]
    n = max(0, len(seq) - mask[-1])
    h = np.zeros(n, np.uint64)
    for offset, factor in zip(mask, _FACTORS[m]):
        h += seq[offset : n + offset] * factor
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Passages:
    """Test passages as word hashes one after another; ``least`` parts long ones from short ones."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int) -> None:
        self.ids, self.least = [i for i, _ in items], least
        self.size = np.array([len(s) for _, s in items], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(self.size)][:-1].astype(np.int64)
        self.flat = np.concatenate([s for _, s in items]) if items else np.zeros(0, np.uint64)

    def seeds(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(mask number, hashes, passage numbers, places in the passage) of each mask in use."""
        out: dict[int, list] = {}
        for k, (a, n) in enumerate(zip(self.first, self.size)):
            seq = self.flat[a : a + n]
            if n >= self.least:
                for m in range(len(MASKS)):
                    h = window_hashes(seq, m)
                    out.setdefault(m, []).append((h, np.full(len(h), k), np.arange(len(h))))
            elif n:
                m = len(MASKS) + max(i for i, p in enumerate(PREFIXES) if p <= n)
                out.setdefault(m, []).append((window_hashes(seq, m)[:1], np.array([k]), np.array([0])))
        return [(m, *(np.concatenate(c) for c in zip(*parts))) for m, parts in sorted(out.items())]


class SeedIndex:
    """The seeds of passages sorted by hash, behind a bit table that keeps most windows out."""

    BITS = 22

    def __init__(self, passages: Passages) -> None:
        self.passages, self.tables = passages, []
        for m, h, k, at in passages.seeds():
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << self.BITS, bool)
            some[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True
            self.tables.append((m, h[order], k[order], at[order], some))

    def hits(self, seq: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct rows (passage number, place in ``seq`` of the passage's first word, text number)."""
        out = []
        for m, hs, ks, places, some in self.tables:
            h = window_hashes(seq, m)
            at = np.flatnonzero(some[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            low = np.searchsorted(hs, h[at], "left")
            count = np.searchsorted(hs, h[at], "right") - low
            entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            own = np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)
            out.append(np.stack([ks[entry], np.repeat(at, count) - places[entry], np.repeat(own, count)], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def longest_run(equal: np.ndarray) -> int:
    """Length of the longest run of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, equal.astype(np.int8), 0]))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def longest_overlap(equal: np.ndarray, tenths: int) -> tuple[int, int]:
    """(length, matches) of the longest stretch that begins and ends True and has at least tenths / 10 True; most matches of several."""
    if not equal.any():
        return 0, 0
    total = np.r_[0, np.cumsum(equal)]
    t = 10 * total - tenths * np.arange(len(total))
    starts = np.where(np.r_[equal, False], t, np.iinfo(np.int64).max)
    first = np.searchsorted(-np.minimum.accumulate(starts), -t, side="left")  # the leftmost start not above
    length = np.where(np.r_[False, equal], np.arange(len(t)) - first, 0)
    best = length.max()
    ends = np.flatnonzero(length == best)
    return int(best), int((total[ends] - total[first[ends]]).max())


def measure(seq: np.ndarray, starts: np.ndarray, ends: np.ndarray, passages: Passages, hits: np.ndarray, tenths: int) -> Iterator[tuple]:
    """(text number, passage number, exact, overlap, matches) of the hits that hold.

    ``seq`` holds texts at [starts, ends).  All diagonals are compared in one go; only those with
    enough equal words, hardly more than there are results, are looked at singly.
    """
    needed = np.where(passages.size >= passages.least, -(-passages.least * tenths // 10), passages.size)
    own = hits[:, 2]
    sizes = passages.size[hits[:, 0]]
    cut = np.r_[0, np.cumsum(sizes)]
    a = 0
    while a < len(hits):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + COMPARED_AT_ONCE, side="right")) - 1)
        n = sizes[a:b]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(hits[a:b, 1], n) + inside
        low, high = np.repeat(starts[own[a:b]], n), np.repeat(ends[own[a:b]], n)
        equal = (place >= low) & (place < high)
        equal &= seq[np.clip(place, 0, len(seq) - 1)] == passages.flat[np.repeat(passages.first[hits[a:b, 0]], n) + inside]
        ahead = np.r_[0, np.cumsum(n)]
        same = np.r_[0, np.cumsum(equal)]
        for i in np.flatnonzero(same[ahead[1:]] - same[ahead[:-1]] >= needed[hits[a:b, 0]]):
            part, k = equal[ahead[i] : ahead[i + 1]], int(hits[a + i, 0])
            if passages.size[k] < passages.least:
                yield int(own[a + i]), k, len(part), len(part), len(part)
            else:
                exact, (overlap, matches) = longest_run(part), longest_overlap(part, tenths)
                if overlap >= passages.least:
                    yield int(own[a + i]), k, exact, overlap, matches
        a = b


def _joined_texts(batch: pd.DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word hashes of texts parted by a 0, starts, ends), many texts at a time."""
    ids, parts, size = [], [], 0
    gap = np.zeros(1, np.uint64)

    def flush() -> tuple:
        lengths = np.array([len(p) for p in parts[::2]], dtype=np.int64)
        starts = np.r_[0, np.cumsum(lengths + 1)[:-1]].astype(np.int64)
        return ids, np.concatenate(parts), starts, starts + lengths

    for doc_id, text in zip(batch.doc_id, batch.text):
        own = word_hashes(text)
        if len(own):
            ids.append(doc_id)
            parts += [own, gap]
            size += len(own)
        if size > WORDS_AT_ONCE:
            yield flush()
            ids, parts, size = [], [], 0
    if parts:
        yield flush()


def _frame(found: list[tuple], ids: list, passages: Passages) -> pd.DataFrame:
    return pd.DataFrame([(ids[d], passages.ids[k], exact, overlap, matches, int(passages.size[k])) for d, k, exact, overlap, matches in found], columns=_COLUMNS)


def _by_broadcast(documents: DataFrame, items: DataFrame, least: int, tenths: int) -> DataFrame:
    passages = Passages([(r.item_id, word_hashes(r.passage)) for r in items.orderBy("item_id", "passage").collect()], least)
    shared = documents.sparkSession.sparkContext.broadcast(SeedIndex(passages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            for ids, seq, starts, ends in _joined_texts(batch):
                found = list(measure(seq, starts, ends, index.passages, index.hits(seq, ends), tenths))
                if found:
                    yield _frame(found, ids, index.passages)

    return documents.mapInPandas(run, RESULT)


def _by_shuffle(documents: DataFrame, items: DataFrame, least: int, tenths: int) -> DataFrame:
    items = items.withColumn("digest", F.md5("passage"))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item_id, passage, digest in zip(batch.item_id, batch.passage, batch.digest):
                for m, h, _, at in Passages([(item_id, word_hashes(passage))], least).seeds():
                    yield pd.DataFrame({"m": m, "h": h.view(np.int64), "item_id": item_id, "digest": digest, "at": at})

    seeded = items.mapInPandas(seeds, "m int, h long, item_id long, digest string, at long")
    used = sorted(r.m for r in seeded.select("m").distinct().collect())  # at most one row for each mask

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, seq, starts, ends in _joined_texts(batch):
                ids = np.array(ids)
                for m in used:
                    h = window_hashes(seq, m)
                    own = np.minimum(np.searchsorted(ends, np.arange(len(h)), side="right"), len(ends) - 1)
                    yield pd.DataFrame({"m": m, "h": h.view(np.int64), "doc_id": ids[own], "place": np.arange(len(h)) - starts[own]})

    hits = documents.mapInPandas(windows, "m int, h long, doc_id long, place long").join(seeded, ["m", "h"])
    diagonals = hits.select("doc_id", "item_id", "digest", (F.col("place") - F.col("at")).alias("start")).distinct()
    parts = diagonals.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / DIAGONALS_AT_ONCE).alias("_n"))
    part = F.pmod(F.xxhash64("item_id", "digest", "start"), F.col("_n"))
    work = diagonals.join(parts, "doc_id").withColumn("_part", part).join(items, ["item_id", "digest"]).groupBy("doc_id", "_part").agg(F.collect_list(F.struct("item_id", "passage", "start")).alias("hits"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, own in zip(batch.doc_id, batch.text, batch.hits):
                seq, numbers, kept = word_hashes(text), {}, []
                for h in own:
                    numbers.setdefault((h["item_id"], h["passage"]), len(numbers))
                    kept.append((numbers[h["item_id"], h["passage"]], h["start"], 0))
                passages = Passages([(i, word_hashes(p)) for i, p in numbers], least)
                found = list(measure(seq, np.zeros(1, np.int64), np.array([len(seq)]), passages, np.array(kept, dtype=np.int64), tenths)) if len(seq) else []
                if found:
                    yield _frame(found, [doc_id], passages)

    return documents.join(work, "doc_id").select("doc_id", "text", "hits").mapInPandas(verify, RESULT)


def leaks(documents: DataFrame, items: DataFrame, least: int = 30, tenths: int = 9) -> DataFrame:
    """Documents that hold a passage or a sufficient part of it, with the item that leaked.

    ``documents``: doc_id, text.  ``items``: item_id, passage.  One row for each (doc_id,
    item_id) that share an overlap of at least ``least`` words on one diagonal, of which
    ``tenths`` / 10 or more are equal (the others are substituted): ``exact_words`` is the longest
    run without substitution, ``overlap_words`` the longest tolerant overlap (it begins and ends
    with equal words), of which ``matching_words`` are equal, out of ``passage_words``.

    No such overlap is missed for ``least`` of 30 or more and ``tenths`` of 9 or more; other
    values are refused.  A passage with fewer than ``least`` words is found where all its words
    stand in a row, without substitution; then all four counts are its length.  Rows without an
    id, null and empty texts, and passages without a word match nothing.  Repeated documents or
    items give one row.

    Passages of up to ``BROADCAST_CHARS`` characters together are broadcast with their hashes, and
    one scan of the documents does all.  More of them are joined with the documents' windows by
    hash, and the hits with the texts by document; the results are the same.
    """
    if least < 30 or not 9 <= tenths <= 10:
        raise ValueError("overlaps must have at least 30 words, nine tenths of them equal")
    good = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    chars = good.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = (_by_broadcast if chars <= BROADCAST_CHARS else _by_shuffle)(texts, good, least, tenths)
    best = F.max(F.struct("overlap_words", "matching_words", "passage_words"))
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), best.alias("_b")).select("doc_id", "item_id", "exact_words", "_b.*")
