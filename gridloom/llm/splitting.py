"""Cutting oversized items at natural boundaries (problem 3).

An item is a stretch ``[lo, hi]`` of offsets: token offsets of a text (prefix sums, see
``split_texts``) or map coordinates of a raster axis (``split``).  Boundaries are sorted; each piece ends at the
last boundary within ``limit`` of its start, found by binary search, and the next piece starts
``overlap`` before that end.  Where no boundary advances, a hard cut is made at the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items sent with one copy of a boundary array.
ITEMS_PER_COPY = 4000

#: Tokens of a text: runs of characters other than white space, with the white space that follows.
TOKEN = re.compile(r"([^ \t\n\x0b\f\r]+)[ \t\n\x0b\f\r]*")
#: A token that ends a sentence, or a paragraph (an empty line follows).
NATURAL_END = re.compile(r"""[.!?]['")\]]*[ \t\n\x0b\f\r]*\Z|\n[ \t\x0b\f\r]*\n""")

PIECES = "item_id long, piece int, begin double, end double, hard_cut boolean"


def cuts(lo: float, hi: float, limit: float, overlap: float, bounds: np.ndarray) -> Iterator[tuple[float, float, bool]]:
    """(begin, end, hard) of the pieces of one item; needs 0 <= overlap < limit.

    The furthest boundary is always the best choice, since every later window only moves on
    with it; so a chain of boundary cuts is found whenever one exists.
    """
    begin = lo
    while hi - begin > limit:
        top = begin + limit
        i = int(np.searchsorted(bounds, top, side="right")) - 1
        end, hard = (float(bounds[i]), False) if i >= 0 and bounds[i] > begin + overlap else (top, True)
        if end - overlap <= begin:  # below the resolution of doubles: no piece can advance
            break
        yield begin, end, hard
        begin = end - overlap
    yield begin, hi, False


def _cut_bucket(items: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """Pieces of a bucket of items, whose boundaries come in the same bucket."""
    out = []
    order = np.lexsort((bounds.pos.to_numpy(), bounds["copy"].to_numpy(), bounds.source.to_numpy()))
    source, copy, pos = (bounds[c].to_numpy()[order] for c in ("source", "copy", "pos"))
    new = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (copy[1:] != copy[:-1])]) if len(pos) else np.zeros(0, int)
    marks = {(source[a], copy[a]): pos[a:b] for a, b in zip(new, np.r_[new[1:], len(pos)])}
    none = np.zeros(0)
    for item, src, cp, lo, hi, limit, overlap in zip(*(items[c].to_numpy() for c in ("item_id", "source", "copy", "lo", "hi", "limit", "overlap"))):
        own = marks.get((src, cp), none)
        inner = own[np.searchsorted(own, lo, side="right") : np.searchsorted(own, hi, side="left")]
        out += [(item, n, *p) for n, p in enumerate(cuts(float(lo), float(hi), float(limit), float(overlap), inner))]
    return pd.DataFrame(out, columns=["item_id", "piece", "begin", "end", "hard_cut"])


def split(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pieces of items longer than their limit: item_id, piece, begin, end, hard_cut.

    ``items``: item_id (unique), source (any key), lo, hi, limit, overlap.  ``bounds``: source,
    pos; unordered and repeated positions are allowed, null and stray ones are ignored.  Only
    boundaries strictly inside an item count.  Items that fit, and items whose parameters make
    no sense (null, not finite, overlap outside [0, limit)), yield no rows.

    Boundaries are made distinct before they are gathered, so a source has at most one entry for
    each offset.  A source with many items gets one copy of its boundaries for every
    ``ITEMS_PER_COPY`` items; copies and sources are spread over buckets by hash, a few for each
    shuffle partition, and a bucket is one task's work.
    """
    inf = float("inf")
    good = items.where((F.col("overlap") >= 0) & (F.col("overlap") < F.col("limit")) & (F.col("limit") < inf) & (F.col("hi") - F.col("lo") > F.col("limit")) & (F.abs("hi") < inf) & (F.abs("lo") < inf)).select("item_id", "source", "lo", "hi", "limit", "overlap")
    copies = good.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / ITEMS_PER_COPY).cast("int").alias("_copies"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    bucket = F.pmod(F.xxhash64("source", "copy"), F.lit(2 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left = good.join(copies.select("source", "_copies"), "source").withColumn("copy", F.pmod(F.xxhash64("item_id"), F.col("_copies")).cast("int")).withColumn("_bucket", bucket).drop("_copies")
    right = (
        bounds.select("source", F.col("pos").cast("double").alias("pos")).where("source is not null and pos is not null and not isnan(pos)").distinct()
        .join(copies, "source").where("pos > _lo and pos < _hi")
        .select("source", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy"), "pos").withColumn("_bucket", bucket)
    )
    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInPandas(_cut_bucket, PIECES)


def split_texts(documents: DataFrame, limit: int, overlap: int) -> DataFrame:
    """doc_id, piece, token_from, token_to, char_from, char_to, hard_cut, text: texts in pieces of at most ``limit`` tokens.

    ``documents``: doc_id, text.  Tokens are white-space tokens, and offsets are prefix sums of
    their number and of their characters.  A piece ends at the last end of a sentence or paragraph
    within the limit, else at the limit (``hard_cut``), and the next begins ``overlap`` tokens before.
    A text that fits is one piece.  Null texts and texts without a token have none; repeated rows
    are cut each.  A text is cut by itself in one pass, so nothing is gathered or shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                found = list(TOKEN.finditer(text or ""))
                if not found:
                    continue
                ends = np.flatnonzero([NATURAL_END.search(m[0]) is not None for m in found]) + 1.0
                for n, (begin, end, hard) in enumerate(cuts(0.0, float(len(found)), float(limit), float(overlap), ends)):
                    a, b = found[int(begin)].start(), found[int(end) - 1].end(1)
                    out.append((doc_id, n, int(begin), int(end), a, b, hard, text[a:b]))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "token_from", "token_to", "char_from", "char_to", "hard_cut", "text"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, token_from int, token_to int, char_from int, char_to int, hard_cut boolean, text string")
