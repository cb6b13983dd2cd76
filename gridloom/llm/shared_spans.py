"""Long spans that occur verbatim in more than one record (problem 8).

1. Anchors, a filter.  Every window of ``least`` characters is named by the smallest hash of the
   ``ANCHOR``-grams inside it; windows in a row with one name form a stretch.  Equal windows have
   equal names, so only stretches whose name occurs in two records can hold a shared span.
2. Reference shards.  The text under such stretches, copies collapsed, is grouped by name: all
   windows that could be equal are in one group, and some groups make a shard of bounded size.
3. Suffix automata.  A group's automaton takes all its texts; every state knows the smallest and
   the largest record that reach it.  Streaming a text through it gives, at each position, the
   longest ending that another record has too: the matching statistics, whose entries of
   ``least`` or more are the maximal shared spans.

A group of more than ``GROUP_CHARS`` is named anew by longer grams, at last by whole windows,
which makes many small groups of it; all of them go through automata in the same way.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.common import checkpoint

LEAST, ANCHOR = 400, 100
#: Characters hashed at once; windows in one stretch (long runs of one character are cut there).
SLICE, STRETCH = 400_000, 2_000
#: Grams that name the windows of groups that are too large, by their share of a window; the last is the window itself.
FINER = (5 / 8, 1)
#: Most characters of a group (an automaton takes about 600 bytes for each), and characters wanted in a shard.
GROUP_CHARS, SHARD_CHARS = 200_000, 1_000_000
#: States after which the automata of a task are worked off.
STATES_AT_ONCE = 300_000

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_B, _B_INVERSE)):
                _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, each depending on its characters alone."""
    with np.errstate(over="ignore"):
        up, down = _tables(len(codes))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        h = (total[k:] - total[:-k]) * down[: len(codes) - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by running minima from both ends of blocks of w."""
    if w == 1:
        return h
    n = len(h) - w + 1
    rows = -(-len(h) // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    block[: len(h)] = h
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def stretches(codes: np.ndarray, ends: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window) in texts put one after another, ``ends`` their ends."""
    none = np.zeros(0, np.int64)
    if len(codes) < least:
        return none, none, none
    names = sliding_min(gram_hashes(codes, anchor), least - anchor + 1)
    new = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    # Windows over the end of a text don't count: stretches end there.
    bad_from, bad_to = np.maximum(ends - least + 1, 0), np.minimum(ends, len(names))
    cuts = np.unique(np.r_[new, bad_from[bad_from < len(names)], bad_to[bad_to < len(names)]])
    long = np.diff(np.r_[cuts, len(names)])
    if (long > STRETCH).any():
        cuts = np.unique(np.concatenate([np.arange(a, a + n, STRETCH) for a, n in zip(cuts, long)]))
    last = np.r_[cuts[1:], len(names)] - 1
    owner = np.searchsorted(ends, cuts, side="right")
    keep = (owner < len(ends)) & (last + least <= ends[np.minimum(owner, len(ends) - 1)])
    return names[cuts[keep]].view(np.int64), cuts[keep], last[keep]


def _anchors(least: int, anchor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple[int, int, str]] = []  # (doc, offset in the document, text)
            size = 0

            def flush() -> pd.DataFrame:
                ends = np.cumsum([len(t) for _, _, t in held])
                codes = np.frombuffer("".join(t for _, _, t in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                name, first, last = stretches(codes, ends, least, anchor)
                owner = np.searchsorted(ends, first, side="right")
                shift = (np.array([o for _, o, _ in held]) - np.r_[0, ends[:-1]])[owner]
                docs = np.array([d for d, _, _ in held], dtype=np.int64)[owner]
                return pd.DataFrame({"name": name, "doc_id": docs, "first": (first + shift).astype("int64"), "last": (last + shift).astype("int64")})

            for doc_id, text in zip(batch.doc_id, batch.text):
                if text is None or len(text) < least:
                    continue
                for a in range(0, len(text) - least + 1, SLICE):  # windows that begin in [a, a + SLICE)
                    part = text if len(text) <= SLICE else text[a : a + SLICE + least - 1]
                    held.append((doc_id, a, part))
                    size += len(part)
                    if len(text) <= SLICE:
                        break
                    if size > SLICE:
                        yield flush()
                        held, size = [], 0
                if size > SLICE:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    return run


def _cut_texts(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s["name"], doc_id, s["first"], text[s["first"] : s["last"] + least], s["large"]) for doc_id, text, own in zip(batch.doc_id, batch.text, batch.own) for s in own]
            yield pd.DataFrame(out, columns=["name", "doc_id", "first", "region", "large"])

    return run


class SuffixAutomata:
    """Suffix automata of several groups of texts in one table of states, each group from a root of its own."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = []
        self.link: list[int] = []
        self.length: list[int] = []
        self.added: list[tuple[np.ndarray, int, int]] = []

    def root(self) -> int:
        """A new, empty automaton."""
        self.next.append({})
        self.link.append(-1)
        self.length.append(0)
        return len(self.next) - 1

    def add(self, text: str, root: int, low: int, high: int) -> None:
        """Adds a text that records low to high deliver, and remembers the state of each of its prefixes."""
        nxt, link, length = self.next, self.link, self.length
        last, n, path = root, 0, []
        for c in text:
            n += 1
            here = nxt[last]
            if c in here:
                last, p = here[c], last
                if length[last] != n:
                    last = self._clone(p, last, c)
            else:
                p, last = link[last], len(nxt)
                here[c] = last
                nxt.append({})
                length.append(n)
                link.append(root)
                while p != -1:
                    there = nxt[p]
                    if c in there:
                        q = there[c]
                        link[last] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
                        break
                    there[c] = last
                    p = link[p]
            path.append(last)
        self.added.append((np.array(path, dtype=np.int64), low, high))

    def _clone(self, p: int, q: int, c: str) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matching(self) -> list[np.ndarray]:
        """Matching statistics of each text added: at each place the longest ending that a second record has.

        The least and greatest record that reach a state go from longer to shorter states along
        the suffix links, all states of one length at a time.
        """
        length, link = np.array(self.length), np.array(self.link)
        low, high = np.full(len(length), np.iinfo(np.int64).max), np.full(len(length), np.iinfo(np.int64).min)
        for path, a, b in self.added:
            low[path], high[path] = np.minimum(low[path], a), np.maximum(high[path], b)
        order = np.argsort(length, kind="stable")
        by_length = np.split(order, np.flatnonzero(np.diff(length[order])) + 1)[1:]
        for s in reversed(by_length):
            np.minimum.at(low, link[s], low[s])
            np.maximum.at(high, link[s], high[s])
        best, shared = np.zeros(len(length), np.int64), low != high
        for s in by_length:
            best[s] = np.where(shared[s], length[s], best[link[s]])
        return [best[path] for path, _, _ in self.added]


def maximal_spans(matching: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spans [begin, end) of at least ``least`` from matching statistics by end position, overlapping ones joined."""
    ends = np.flatnonzero(matching >= least)
    if not len(ends):
        return []
    begins = ends + 1 - matching[ends]
    cut = np.flatnonzero(np.r_[True, begins[1:] > np.maximum.accumulate(ends + 1)[:-1]])
    return [(int(begins[a:b].min()), int(ends[b - 1]) + 1) for a, b in zip(cut, np.r_[cut[1:], len(ends)])]


def _shard(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, automata, held = [], SuffixAutomata(), []

        def flush() -> None:
            for (name, key), matching in zip(held, automata.matching()):
                out.extend((name, key, a, b) for a, b in maximal_spans(matching, least))

        gc.disable()  # the states are many and have no cycles
        try:
            for name, group in pdf.groupby("name", sort=False):
                root = automata.root()
                for key, text, low, high in zip(group.key, group.region, group.low, group.high):
                    automata.add(text, root, low, high)
                    held.append((name, key))
                if len(automata.length) > STATES_AT_ONCE:
                    flush()
                    automata, held = SuffixAutomata(), []
            flush()
        finally:
            gc.enable()
        return pd.DataFrame(out, columns=["name", "key", "begin", "end"])

    return run


def _finer(least: int, anchor: int):
    """Stretches of texts by another gram: outer name and key, place in the text, and the text under each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for outer, key, text, low, high in zip(batch["name"], batch.key, batch.region, batch.low, batch.high):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                out += [(n, text[a : b + least], low, high, outer, key, a) for n, a, b in zip(*stretches(codes, np.array([len(text)]), least, anchor))]
            yield pd.DataFrame(out, columns=["name", "region", "low", "high", "outer_name", "outer_key", "place"])

    return run


def _groups(found: DataFrame, size: Column, low: str, high: str) -> DataFrame:
    """name, large: the names that two records have, and whether the texts under one are too many characters."""
    g = found.groupBy("name").agg(F.min(low).alias("_a"), F.max(high).alias("_b"), (F.sum(size) > GROUP_CHARS).alias("large"))
    return g.where("_a <> _b").select("name", "large")


def _matched(regions: DataFrame, least: int, finer: tuple[int, ...]) -> DataFrame:
    """name, key, begin, end: shared spans of the texts of a checkpointed table name, key, region, low, high, large.

    Groups marked ``large`` are parted by the first of the ``finer`` grams; when none is left, a
    group holds one text, collapsed.
    """
    if not finer:
        regions = regions.withColumn("large", F.lit(False))
    chars, large = regions.agg(F.coalesce(F.sum(F.length("region")), F.lit(0)), F.coalesce(F.max("large"), F.lit(False))).first()
    collapsed = lambda kept: regions.where(kept).groupBy("name", "key").agg(F.first("region").alias("region"), F.min("low").alias("low"), F.max("high").alias("high"))
    # A number of partitions of its own: the work is far larger than the bytes, by which they would be joined up.
    shards = max(4 * int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    small = collapsed(~F.col("large")).withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    spans = small.repartition(-(-shards // 2), "shard").groupBy("shard").applyInPandas(_shard(least), "name long, key binary, begin long, end long")
    if not large:
        return spans
    fields = "name long, region string, low long, high long, outer_name long, outer_key binary, place long"
    parts = checkpoint(collapsed(F.col("large")).mapInPandas(_finer(least, finer[0]), fields).withColumn("key", F.unhex(F.md5("region"))))
    inner = _matched(checkpoint(parts.join(_groups(parts, F.length("region"), "low", "high"), "name").select("name", "key", "region", "low", "high", "large")), least, finer[1:])
    back = parts.select("outer_name", "outer_key", "place", "name", "key").join(inner, ["name", "key"])
    return spans.unionByName(back.select(F.col("outer_name").alias("name"), F.col("outer_key").alias("key"), (F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("end")).alias("end")))


def shared_spans(documents: DataFrame, least: int = LEAST, anchor: int | None = None) -> DataFrame:
    """doc_id, begin, end: stretches of each text that occur verbatim in another record.

    ``documents``: doc_id, text.  Offsets count characters from 0, ``end`` is exclusive.  Each row
    is at least ``least`` characters long and made of spans of at least ``least`` characters that
    a record with another doc_id holds identically; rows of one record may overlap.  No span of
    that length is missed.  Null texts and texts shorter than ``least`` share nothing; a row
    delivered twice under one doc_id does not share with itself.
    """
    anchor = anchor or min(ANCHOR, max(1, least // 4))
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    found = checkpoint(texts.mapInPandas(_anchors(least, anchor), "name long, doc_id long, first long, last long"))
    groups = _groups(found, F.col("last") - F.col("first") + least, "doc_id", "doc_id")
    own = found.join(groups, "name").groupBy("doc_id").agg(F.collect_list(F.struct("name", "first", "last", "large")).alias("own"))
    regions = checkpoint(
        texts.join(own.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "own")
        .mapInPandas(_cut_texts(least), "name long, doc_id long, first long, region string, large boolean")
        .withColumn("key", F.unhex(F.md5("region")))
    )
    spans = _matched(regions.select("name", "key", "region", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"), "large"), least, tuple(max(anchor, round(least * f)) for f in FINER))
    return regions.select("name", "key", "doc_id", "first").join(spans, ["name", "key"]).select("doc_id", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))


def shared_shares(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, share of every document; overlapping spans count once.

    Documents that share nothing have 0; the share of an empty or null text is 0.
    """
    order = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(order), F.lit(0))), F.lit(0))
    covered = spans.distinct().withColumn("_n", fresh).groupBy("doc_id").agg(F.sum("_n").alias("shared_chars"))
    lengths = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    shared = F.coalesce(F.col("shared_chars"), F.lit(0))
    return lengths.join(covered, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))


def without_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents, each text without its spans; all copies of a shared stretch go.

    Overlapping spans are merged first.  Texts without a span, null texts included, stay as they are.
    """
    order = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(order), F.lit(0))
    gaps = spans.distinct().withColumn("_from", before).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("begin") > F.col("_from"), F.struct(F.col("_from").cast("int").alias("a"), F.col("begin").cast("int").alias("b"))))).alias("_gaps"),
        F.max("end").cast("int").alias("_last"),
    )
    kept = F.expr("concat(array_join(transform(_gaps, g -> substring(text, g.a + 1, g.b - g.a)), ''), substring(text, _last + 1))")
    out = documents.join(gaps, "doc_id", "left").withColumn("text", F.when(F.col("_last").isNull(), F.col("text")).otherwise(kept))
    return out.select(documents.columns)
