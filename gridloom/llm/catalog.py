"""Queries and SQL of the operators for training corpora."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.common import checkpoint, table
from gridloom.functions.current import current_statistics, current_training
from gridloom.llm import leakage, packing, percentiles, sampling, shared_spans, splitting

CAPACITY = 2048
PIECE_TOKENS, PIECE_OVERLAP = 512, 64


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_training(spark, sf_dir).where(F.col("feature_class").between(1, 8))


def _allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.allocate(table(spark, sf_dir, "sampling_targets"), sampling.population_counts(_population(spark, sf_dir)))


def _fixed_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation worked out once, for queries that read it several times."""
    return checkpoint(_allocation(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of which a plan draws fewer rows, its reserve included, than its share and minimum ask for."""
    lines = _fixed_allocation(spark, sf_dir)
    drawn = sampling.draw(_population(spark, sf_dir), lines).groupBy("plan_id", "line").agg(F.count(F.lit(1)).alias("drawn"))
    counted = lines.join(drawn, ["plan_id", "line"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    below = (F.col("drawn") * 100 < F.col("sample_size").cast("long") * F.col("target_pct")) | (F.col("drawn") < F.col("min_rows"))
    return counted.where(below).select("plan_id", "feature_class").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each plan gets of each class, and where its target could not be met."""
    return _allocation(spark, sf_dir).withColumn("achieved_pct", F.round("achieved_pct", 6))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples themselves."""
    return sampling.draw(_population(spark, sf_dir), _fixed_allocation(spark, sf_dir)).where("not reserve").drop("reserve", "line")


def p1_sample_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the drawn rows of each plan, counted from them.

    ``foreign`` rows are not of the plan's site and class; ``lost_minima`` are lines below a minimum
    they have rows for; ``broken_nodes`` are nodes of the category tree, leaves included, that got
    less than they asked for although they have rows left, so that quota left them too early.
    """
    population, lines = _population(spark, sf_dir), _fixed_allocation(spark, sf_dir)
    sample = sampling.draw(population, lines).where("not reserve")
    real = population.select("segment_id", "site_id", "feature_class", F.lit(1).alias("_real"))
    checked = sample.join(real, ["segment_id", "site_id", "feature_class"], "left")
    counted = checked.groupBy("plan_id", "line").agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("segment_id").alias("segments"), F.count_if(F.col("_real").isNull()).alias("foreign"))
    leaves = lines.join(counted, ["plan_id", "line"], "left").fillna(0, ["drawn", "segments", "foreign"])
    path = sampling.tree_columns(F.col("feature_class"), sampling.CLASS_TREE)
    node = F.explode(F.array(path[0], F.concat(*path), F.concat(*path, F.col("line").cast("string"))))
    nodes = leaves.withColumn("_node", node).groupBy("plan_id", "_node").agg(F.sum("drawn").alias("d"), F.sum("quota").alias("q"), F.sum("available").alias("a"))
    broken = nodes.groupBy("plan_id").agg(F.count_if(F.expr("d < least(q, a)")).alias("broken_nodes"))
    totals = leaves.groupBy("plan_id").agg(*[F.sum(c).alias(c) for c in ("drawn", "segments", "foreign")], F.count_if(F.expr("drawn < least(min_rows, available)")).alias("lost_minima"))
    return totals.join(broken, "plan_id")


def _b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _population(spark, sf_dir).select("segment_id", "site_id", "feature_class")
    stats = current_statistics(spark, sf_dir, ["b6_mean"]).select("segment_id", "b6_mean", F.to_date("computed_at").alias("day"))
    return labels.join(stats.where("b6_mean is not null"), "segment_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["site_id", "feature_class"]
    found = percentiles.percentiles(percentiles.summarise(_b6(spark, sf_dir), groups, "b6_mean"), groups, [10, 50, 90])
    ranges = table(spark, sf_dir, "class_ranges").select("feature_class", "pct", "b6_low", "b6_high")
    outside = (F.col("n") >= 20) & ((F.col("result") < F.col("b6_low")) | (F.col("result") > F.col("b6_high")))
    return found.join(ranges, ["feature_class", "pct"]).where(outside).select("site_id", "feature_class", "pct").distinct()


def p2_site_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10th, 50th and 90th percentile of b6_mean for each site and class, exact."""
    groups = ["site_id", "feature_class"]
    out = percentiles.percentiles(percentiles.summarise(_b6(spark, sf_dir), groups, "b6_mean"), groups, [10, 50, 90])
    return out.select(*groups, "pct", "n", F.round("result", 6).alias("b6_percentile"))


def p2_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each day over all sites, from summaries of two portions that were made separately."""
    rows = _b6(spark, sf_dir)
    halves = [rows.where(F.pmod(F.xxhash64("segment_id"), F.lit(2)) == h) for h in (0, 1)]
    merged = percentiles.merge([percentiles.summarise(h, ["day"], "b6_mean") for h in halves], ["day"])
    return percentiles.percentiles(merged, ["day"], [10, 50, 90]).select("day", "pct", "n", F.round("result", 6).alias("b6_percentile"))


def p2_all_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each class over all sites, from the summary rounded to 0.5: within 0.25 of the exact percentiles."""
    out = percentiles.percentiles(percentiles.summarise(_b6(spark, sf_dir), ["feature_class"], "b6_mean", 0.5), ["feature_class"], [10, 50, 90])
    return out.select("feature_class", "pct", "n", F.round("result", 6).alias("b6_percentile"), F.lit(0.25).alias("error_bound"))


def _axis_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "tile_and_process").select("job_id", "raster_id", F.coalesce("tile_size", F.lit(150.0)).alias("limit"), F.coalesce("overlap", F.lit(50.0)).alias("overlap")).where("job_id is not null").distinct()
    rasters = table(spark, sf_dir, "rasters").select("raster_id", "minx", "miny", "maxx", "maxy")
    axes = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.col("minx").alias("lo"), F.col("maxx").alias("hi")), F.struct(F.lit(1).alias("a"), F.col("miny").alias("lo"), F.col("maxy").alias("hi"))))
    return jobs.join(rasters, "raster_id").withColumn("_x", axes).select((F.col("job_id") * 2 + F.col("_x.a")).alias("item_id"), (F.col("raster_id") * 2 + F.col("_x.a")).alias("source"), "_x.lo", "_x.hi", "limit", "overlap")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    seams = table(spark, sf_dir, "raster_seams").where(F.col("axis").isin("x", "y"))
    bounds = seams.select((F.col("raster_id") * 2 + F.when(F.col("axis") == "x", 0).otherwise(1)).alias("source"), "pos")
    out = splitting.split(_axis_items(spark, sf_dir), bounds)
    return out.select(F.expr("item_id div 2").alias("job_id"), F.when(F.col("item_id") % 2 == 0, "x").otherwise("y").alias("axis"), "piece", "begin", "end", "hard_cut")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("hard_cut").select("job_id", "axis").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all jobs."""
    return _pieces(spark, sf_dir)


def p3_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of at most 512 tokens that share 64."""
    out = splitting.split_texts(table(spark, sf_dir, "documents"), PIECE_TOKENS, PIECE_OVERLAP)
    return out.select("doc_id", "piece", "token_from", "token_to", "hard_cut", (F.col("char_to") - F.col("char_from")).alias("chars"), F.md5("text").alias("text_md5"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", packing.whitespace_tokens(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, CAPACITY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pieces came into more than one container."""
    spread = _packed(spark, sf_dir).groupBy("doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return spread.where("a <> b").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece, sized in white-space tokens."""
    return _packed(spark, sf_dir)


def _bpe_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = os.environ.get("GRIDLOOM_TOKENIZERS", os.path.dirname(public_tokenizers.__file__))
    sizes = packing.bpe_tokens(table(spark, sf_dir, "documents"), os.path.join(folder, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(sizes, CAPACITY)


def p6_bpe_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, sized in tokens of a public byte-level BPE; GRIDLOOM_TOKENIZERS names the folder of its file."""
    return _bpe_packed(spark, sf_dir)


def _packing_check(packed: DataFrame) -> DataFrame:
    """What must hold for containers, counted from them.

    ``overfull`` containers; ``broken`` documents, whose pieces do not follow each other from end to
    end or are more than needed; ``dense``: at most 2 % and one more containers than their tokens fill.
    """
    held = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("_n"))
    containers = held.agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("_n") > CAPACITY).alias("overfull"), F.sum("_n").alias("tokens"))
    size = F.sum("n_tokens")
    whole = (F.count(F.lit(1)) == F.max("pieces")) & (F.max("token_to") == size) & (F.min("token_from") == 0) & (F.max("pieces") == F.greatest(F.ceil(size / CAPACITY), F.lit(1)))
    docs = packed.groupBy("doc_id").agg(whole.alias("_ok"), F.max("pieces").alias("_p"))
    documents = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("_p").cast("long").alias("pieces"), F.count_if(F.col("_p") > 1).alias("cut_documents"), F.count_if(~F.col("_ok")).alias("broken"))
    dense = F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY) * 1.02 + 1
    return containers.join(documents).select("documents", "pieces", "cut_documents", "tokens", "overfull", "broken", dense.alias("dense"))  # one row each


def p6_container_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on the containers of white-space tokens."""
    return _packing_check(_packed(spark, sf_dir))


def p6_bpe_container_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on the containers of BPE tokens, as far as SQL knows the truth."""
    return _packing_check(_bpe_packed(spark, sf_dir)).select("documents", "overfull", "broken", "dense")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("exact_words >= 30").select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and leaked items with the extent of the overlap, substituted words included."""
    return _leaks(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is found elsewhere."""
    docs = table(spark, sf_dir, "documents")
    return shared_spans.shared_shares(docs, shared_spans.shared_spans(docs)).withColumn("share", F.round("share", 9))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_sample_check, p2_found, p2_site_class, p2_by_day, p2_all_sites, p3_found, p3_pieces, p3_text_pieces, p6_found, p6_containers, p6_container_check, p6_bpe_containers, p6_bpe_container_check, p7_found, p7_leaks, p8_found, p8_shares)}

_TRAINING = """ct AS (SELECT segment_id, arg_max(site_id, labelled_at) AS site_id, arg_max(coalesce(feature_class, -1), labelled_at) AS feature_class FROM training WHERE segment_id IS NOT NULL GROUP BY 1)"""
_B6 = f"""WITH {_TRAINING},
cs AS (SELECT DISTINCT s.segment_id, s.raster_id, s.b6_mean, CAST(s.computed_at AT TIME ZONE 'UTC' AS DATE) AS day FROM segment_statistics s JOIN (SELECT segment_id, max(computed_at) AS m FROM segment_statistics GROUP BY 1) l ON s.segment_id = l.segment_id AND s.computed_at = l.m),
v AS (SELECT ct.site_id, ct.feature_class, cs.day, cs.b6_mean FROM ct JOIN cs USING (segment_id) LEFT JOIN rasters r ON r.raster_id = cs.raster_id
 WHERE ct.feature_class BETWEEN 1 AND 8 AND cs.b6_mean IS NOT NULL AND isfinite(cs.b6_mean) AND (r.nodata IS NULL OR isnan(r.nodata) OR cs.b6_mean <> r.nodata)),
p AS (SELECT CAST(unnest([10, 50, 90]) AS INTEGER) AS pct)"""
_SPACE = " \\t\\n\\x0B\\f\\r"
_GRAM = "[^ \\t\\n\\x0B\\f\\r]+"
_WORD = "[\\p{L}\\p{N}]+"



def _allocation_sql() -> str:
    """The allocation level by level, as windows over one row for each class of a plan."""
    leaf = "feature_class, site_id, min_rows, sample_size, target_pct"
    tree = sampling.CLASS_TREE
    paths = [f"CASE feature_class {' '.join(f'WHEN {k} THEN {chr(39)}{p[i]}{chr(39)}' for k, p in tree.items())} END AS t{i}" for i in range(2)]
    steps, before = [], "l0"
    for level in range(3):
        parent = ", ".join(["plan_id", *[f"t{i}" for i in range(level)]])
        own = ", ".join(["plan_id", *[f"t{i}" for i in range(min(level + 1, 2))], *([leaf] if level == 2 else [])])
        n = f"s{level}"
        steps += [
            f"{n}a AS (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY {leaf}) = 1 AS f, sum(available) OVER (PARTITION BY {own}) AS cap, least(sum(quota) OVER (PARTITION BY {own}), sum(available) OVER (PARTITION BY {own})) AS base FROM {before})",
            f"{n}b AS (SELECT *, CASE WHEN f THEN cap - base ELSE 0 END AS spare, g - sum(CASE WHEN f THEN base ELSE 0 END) OVER (PARTITION BY {parent}) AS extra FROM {n}a)",
            f"{n}c AS (SELECT *, sum(spare) OVER (PARTITION BY {parent}) AS spares FROM {n}b)",
            f"{n}d AS (SELECT *, CASE WHEN spares > 0 THEN extra * spare // spares ELSE 0 END AS part, CASE WHEN spares > 0 THEN extra * spare % spares ELSE 0 END AS rem FROM {n}c)",
            f"{n}e AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY rem DESC, {leaf}) AS rk, extra - sum(part) OVER (PARTITION BY {parent}) AS odd FROM {n}d)",
            f"l{level + 1} AS (SELECT plan_id, {leaf}, available, quota, line, wanted, t0, t1, base + sum(part + CASE WHEN rk <= odd AND rem > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {own}) AS g FROM {n}e)",
        ]
        before = f"l{level + 1}"
    order = "feature_class, site_id, min_rows, sample_size, target_pct"
    return f"""WITH {_TRAINING}, n AS (SELECT site_id, feature_class, count(*) AS c FROM ct GROUP BY 1, 2),
t AS (SELECT DISTINCT s.plan_id, s.site_id, s.sample_size, s.feature_class, s.target_pct, s.min_rows, coalesce(n.c, 0) AS available, CAST(s.sample_size AS BIGINT) * s.target_pct AS share FROM sampling_targets s LEFT JOIN n USING (site_id, feature_class)),
u AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY {order}) AS line, sum(share) OVER (PARTITION BY plan_id) AS shares FROM t),
u1 AS (SELECT *, CASE WHEN shares > 0 THEN (shares // 100) * share // shares ELSE 0 END AS whole, CASE WHEN shares > 0 THEN (shares // 100) * share % shares ELSE 0 END AS rest FROM u),
u2 AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY rest DESC, {order}) AS rr, shares // 100 - sum(whole) OVER (PARTITION BY plan_id) AS spread FROM u1),
u3 AS (SELECT *, whole + CASE WHEN rr <= spread AND rest > 0 THEN 1 ELSE 0 END AS own, least(min_rows, available) AS kept FROM u2),
u4 AS (SELECT *, greatest(kept - own, 0) AS gain, greatest(own - kept, 0) AS excess FROM u3),
u5 AS (SELECT *, sum(excess) OVER (PARTITION BY plan_id) AS excesses, least(sum(gain) OVER (PARTITION BY plan_id), sum(excess) OVER (PARTITION BY plan_id)) AS given FROM u4),
u6 AS (SELECT *, CASE WHEN excesses > 0 THEN given * excess // excesses ELSE 0 END AS cut, CASE WHEN excesses > 0 THEN given * excess % excesses ELSE 0 END AS cut_rest FROM u5),
u7 AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY cut_rest DESC, {order}) AS cr, given - sum(cut) OVER (PARTITION BY plan_id) AS cut_odd FROM u6),
q AS (SELECT *, own + gain - cut - CASE WHEN cr <= cut_odd AND cut_rest > 0 THEN 1 ELSE 0 END AS quota, greatest((share + 99) // 100, min_rows) AS wanted FROM u7),
l0 AS (SELECT *, {", ".join(paths)}, least(sum(quota) OVER (PARTITION BY plan_id), sum(available) OVER (PARTITION BY plan_id)) AS g FROM q),
{", ".join(steps)}
SELECT plan_id, CAST(line AS INTEGER) AS line, site_id, sample_size, feature_class, target_pct, min_rows, available, CAST(wanted AS BIGINT) AS wanted, CAST(quota AS BIGINT) AS quota, CAST(g AS BIGINT) AS take,
 round(CAST(g AS DOUBLE) * 100 / nullif(CAST(sum(g) OVER (PARTITION BY plan_id) AS DOUBLE), 0), 6) AS achieved_pct, available < wanted AS short FROM {before}"""


#: An overlap of 30 words with nine tenths of them equal has 7 equal words in a row, which gives its diagonal.
_LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(passage), '{_WORD}') AS w FROM eval_items WHERE passage IS NOT NULL)),
dg AS (SELECT doc_id, i, array_to_string(w[i : i + 6], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 5)) AS i FROM d WHERE len(w) >= 30)),
eg AS (SELECT item_id, w, i, array_to_string(w[i : i + 6], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 5)) AS i FROM e WHERE n >= 30)),
dd AS (SELECT DISTINCT doc_id, item_id, eg.w, dg.i - eg.i AS s FROM dg JOIN eg USING (g)),
ew AS (SELECT doc_id, item_id, s, w, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x, len(w) AS n FROM dd),
dw AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d),
eq AS (SELECT ew.doc_id, item_id, s, n, ew.w, p, row_number() OVER (PARTITION BY ew.doc_id, item_id, s, ew.w ORDER BY p) AS r FROM ew JOIN dw ON dw.doc_id = ew.doc_id AND dw.q = ew.p + ew.s AND dw.x = ew.x),
ov AS (SELECT a.doc_id, a.item_id, a.s, a.w, max(struct_pack(overlap := b.p - a.p + 1, matching := b.r - a.r + 1, n := a.n)) AS best FROM eq a JOIN eq b USING (doc_id, item_id, s, w) WHERE b.p - a.p >= 29 AND 10 * (b.r - a.r + 1) >= 9 * (b.p - a.p + 1) GROUP BY ALL),
rn AS (SELECT doc_id, item_id, s, w, max(c) AS run FROM (SELECT doc_id, item_id, s, w, p - r AS island, count(*) AS c FROM eq GROUP BY ALL) GROUP BY ALL),
al AS (SELECT doc_id, item_id, run, best FROM ov JOIN rn USING (doc_id, item_id, s, w)
 UNION ALL SELECT d.doc_id, e.item_id, n, struct_pack(overlap := n, matching := n, n := n) FROM d JOIN e ON n BETWEEN 1 AND 29 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' ')),
mx AS (SELECT doc_id, item_id, max(run) AS run, max(best) AS best FROM al GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(run AS INTEGER) AS exact_words, CAST(best.overlap AS INTEGER) AS overlap_words, CAST(best.matching AS INTEGER) AS matching_words, CAST(best.n AS INTEGER) AS passage_words FROM mx"""


SQL = {
    "p7_leaks": _LEAKS,
    "p1_report": _allocation_sql(),
    "p1_sample_check": f"""WITH {_TRAINING}, n AS (SELECT site_id, feature_class, count(*) AS c FROM ct GROUP BY 1, 2),
t AS (SELECT DISTINCT s.*, coalesce(n.c, 0) AS available FROM sampling_targets s LEFT JOIN n USING (site_id, feature_class)),
p AS (SELECT plan_id, CAST(least(sum(available), greatest(sum(CAST(sample_size AS BIGINT) * target_pct) // 100, sum(least(min_rows, available)))) AS BIGINT) AS drawn FROM t GROUP BY 1)
SELECT plan_id, drawn, drawn AS segments, CAST(0 AS BIGINT) AS foreign, CAST(0 AS BIGINT) AS lost_minima, CAST(0 AS BIGINT) AS broken_nodes FROM p""",
    "p1_found": f"""WITH {_TRAINING}, n AS (SELECT site_id, feature_class, count(*) AS c FROM ct GROUP BY 1, 2)
SELECT DISTINCT t.plan_id, t.feature_class FROM sampling_targets t LEFT JOIN n ON n.site_id = t.site_id AND n.feature_class = t.feature_class
WHERE coalesce(n.c, 0) * 100 < t.sample_size * t.target_pct OR coalesce(n.c, 0) < t.min_rows""",
    "p2_found": f"""{_B6},
g AS (SELECT site_id, feature_class, count(*) AS n, quantile_cont(b6_mean, [0.1, 0.5, 0.9]) AS x FROM v GROUP BY 1, 2)
SELECT DISTINCT g.site_id, g.feature_class, c.pct FROM g JOIN class_ranges c USING (feature_class)
WHERE g.n >= 20 AND (g.x[CASE c.pct WHEN 10 THEN 1 WHEN 50 THEN 2 ELSE 3 END] < c.b6_low OR g.x[CASE c.pct WHEN 10 THEN 1 WHEN 50 THEN 2 ELSE 3 END] > c.b6_high)""",
    "p2_site_class": f"""{_B6}, g AS (SELECT site_id, feature_class, count(*) AS n, quantile_cont(b6_mean, [0.1, 0.5, 0.9]) AS x FROM v GROUP BY 1, 2)
SELECT site_id, feature_class, pct, n, round(x[CASE pct WHEN 10 THEN 1 WHEN 50 THEN 2 ELSE 3 END], 6) AS b6_percentile FROM g, p""",
    "p2_by_day": f"""{_B6}, g AS (SELECT day, count(*) AS n, quantile_cont(b6_mean, [0.1, 0.5, 0.9]) AS x FROM v GROUP BY 1)
SELECT day, pct, n, round(x[CASE pct WHEN 10 THEN 1 WHEN 50 THEN 2 ELSE 3 END], 6) AS b6_percentile FROM g, p""",
    "p2_all_sites": f"""{_B6}, g AS (SELECT feature_class, count(*) AS n, quantile_cont(round(b6_mean / 0.5) * 0.5, [0.1, 0.5, 0.9]) AS x FROM v GROUP BY 1)
SELECT feature_class, pct, n, round(x[CASE pct WHEN 10 THEN 1 WHEN 50 THEN 2 ELSE 3 END], 6) AS b6_percentile, CAST(0.25 AS DOUBLE) AS error_bound FROM g, p""",
    "p3_found": """WITH RECURSIVE j AS (SELECT DISTINCT t.job_id, t.raster_id, coalesce(t.tile_size, 150.0) AS s, coalesce(t.overlap, 50.0) AS o FROM tile_and_process t WHERE t.job_id IS NOT NULL),
i AS (SELECT job_id, 'x' AS axis, raster_id, s, o, minx AS lo, maxx AS hi FROM j JOIN rasters USING (raster_id) UNION ALL SELECT job_id, 'y', raster_id, s, o, miny, maxy FROM j JOIN rasters USING (raster_id)),
k AS (SELECT * FROM i WHERE o >= 0 AND o < s AND hi - lo > s),
w AS (SELECT job_id, axis, raster_id, s, o, lo, hi, lo AS b, FALSE AS stuck FROM k
 UNION ALL
 SELECT w.job_id, w.axis, w.raster_id, w.s, w.o, w.lo, w.hi, coalesce(n.pos - w.o, w.b), n.pos IS NULL FROM w, LATERAL (SELECT max(r.pos) AS pos FROM raster_seams r WHERE r.raster_id = w.raster_id AND r.axis = w.axis AND r.pos > w.lo AND r.pos < w.hi AND r.pos > w.b + w.o AND r.pos <= w.b + w.s) n
 WHERE NOT w.stuck AND w.hi - w.b > w.s)
SELECT DISTINCT job_id, axis FROM w WHERE stuck""",
    "p3_pieces": """WITH RECURSIVE j AS (SELECT DISTINCT t.job_id, t.raster_id, coalesce(t.tile_size, 150.0) AS s, coalesce(t.overlap, 50.0) AS o FROM tile_and_process t WHERE t.job_id IS NOT NULL),
i AS (SELECT job_id, 'x' AS axis, raster_id, s, o, minx AS lo, maxx AS hi FROM j JOIN rasters USING (raster_id) UNION ALL SELECT job_id, 'y', raster_id, s, o, miny, maxy FROM j JOIN rasters USING (raster_id)),
k AS (SELECT * FROM i WHERE o >= 0 AND o < s AND hi - lo > s),
w AS (SELECT job_id, axis, raster_id, s, o, lo, hi, -1 AS piece, CAST(NULL AS DOUBLE) AS b, lo + o AS e, FALSE AS hard FROM k
 UNION ALL
 SELECT w.job_id, w.axis, w.raster_id, w.s, w.o, w.lo, w.hi, w.piece + 1, w.e - w.o, CASE WHEN w.hi - (w.e - w.o) <= w.s THEN w.hi ELSE coalesce(n.pos, w.e - w.o + w.s) END, w.hi - (w.e - w.o) > w.s AND n.pos IS NULL
 FROM w, LATERAL (SELECT max(r.pos) AS pos FROM raster_seams r WHERE r.raster_id = w.raster_id AND r.axis = w.axis AND r.pos > w.lo AND r.pos < w.hi AND r.pos > w.e AND r.pos <= w.e - w.o + w.s) n WHERE w.e < w.hi)
SELECT job_id, axis, CAST(piece AS INTEGER) AS piece, b AS begin, e AS end, hard AS hard_cut FROM w WHERE piece >= 0""",
    "p3_text_pieces": f"""WITH RECURSIVE d AS (SELECT doc_id, t, len(t) AS n, list_filter(range(1, len(t) + 1), lambda i: regexp_matches(t[i], '[.!?][''")\\]]*[{_SPACE}]*$') OR regexp_matches(t[i], '\\n[ \\t\\x0B\\f\\r]*\\n')) AS b
 FROM (SELECT doc_id, regexp_extract_all(text, '[^{_SPACE}]+[{_SPACE}]*') AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) > 0),
w AS (SELECT doc_id, n, b, -1 AS piece, CAST(NULL AS BIGINT) AS f, CAST({PIECE_OVERLAP} AS BIGINT) AS e, FALSE AS hard FROM d
 UNION ALL
 SELECT doc_id, n, b, piece + 1, e - {PIECE_OVERLAP}, CASE WHEN n - e + {PIECE_OVERLAP} <= {PIECE_TOKENS} THEN n ELSE coalesce(pos, e - {PIECE_OVERLAP} + {PIECE_TOKENS}) END, n - e + {PIECE_OVERLAP} > {PIECE_TOKENS} AND pos IS NULL
 FROM (SELECT *, list_max(list_filter(b, lambda x: x > e AND x <= e - {PIECE_OVERLAP} + {PIECE_TOKENS} AND x < n)) AS pos FROM w WHERE piece < 0 OR e < n)),
x AS (SELECT w.*, rtrim(array_to_string(d.t[f + 1 : e], ''), E' \\t\\n\\x0B\\f\\r') AS body FROM w JOIN d USING (doc_id) WHERE piece >= 0)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(f AS INTEGER) AS token_from, CAST(e AS INTEGER) AS token_to, hard AS hard_cut, CAST(length(body) AS INTEGER) AS chars, md5(body) AS text_md5 FROM x""",
    "p6_container_check": f"""WITH t AS (SELECT len(regexp_extract_all(text, '{_GRAM}')) AS n FROM documents)
SELECT count(*) AS documents, CAST(sum(greatest(CAST(ceil(coalesce(n, 0) / {CAPACITY}) AS BIGINT), 1)) AS BIGINT) AS pieces, count(*) FILTER (WHERE n > {CAPACITY}) AS cut_documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS broken, TRUE AS dense FROM t""",
    "p6_bpe_container_check": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS broken, TRUE AS dense FROM documents",
    "p6_found": f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_GRAM}')) > {CAPACITY}",
    "p7_found": f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(passage), '{_WORD}') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i : i + 29], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 28)) AS i FROM d WHERE len(w) >= 30)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 29], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 28)) AS i FROM e WHERE len(w) >= 30))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p8_found": """WITH g AS (SELECT doc_id, md5(substring(text, CAST(i AS BIGINT), 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
r AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM g JOIN r USING (h)""",
    "p8_shares": """WITH g AS (SELECT doc_id, i, md5(substring(text, CAST(i AS BIGINT), 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
r AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, least(400, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 400)) AS n FROM g JOIN r USING (h)) GROUP BY 1)
SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(c.n, 0) AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(c.n, 0) / length(text)::DOUBLE, 9) ELSE 0.0 END AS share FROM documents LEFT JOIN c USING (doc_id)""",
}
