import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridloom.llm.catalog")
from gridloom.llm import leakage, packing, percentiles, sampling, shared_spans, splitting  # noqa: E402

TARGETS = "plan_id long, site_id string, sample_size int, feature_class int, target_pct int, min_rows int"


def _alloc(spark, targets, available):
    t = spark.createDataFrame(targets, TARGETS)
    a = spark.createDataFrame(available, "site_id string, feature_class int, available long")
    return {(r.plan_id, r.feature_class): r for r in sampling.allocate(t, a).collect()}


def test_unmet_quota_goes_to_siblings_then_cousins(spark):
    targets = [(1, "s", 100, 1, 40, 0), (1, "s", 100, 2, 10, 0), (1, "s", 100, 3, 25, 0), (1, "s", 100, 5, 25, 0)]
    got = _alloc(spark, targets, [("s", 1, 10), ("s", 2, 20), ("s", 3, 30), ("s", 5, 500)])
    # 30 are missing in class 1: its sibling 2 gives 10, the cousin 3 gives 5, the rest comes from 5
    assert {k[1]: r.take for k, r in got.items()} == {1: 10, 2: 20, 3: 30, 5: 40}
    assert {k[1] for k, r in got.items() if r.short} == {1}


def test_minima_repeats_nulls_and_missing_classes(spark):
    targets = [(1, "s", 10, 1, 90, 0), (1, "s", 10, 8, 10, 5), (1, "s", 10, 8, 10, 5), (2, "none", 10, 1, 100, 1), (3, None, None, 1, None, None)]
    got = _alloc(spark, targets, [("s", 1, 100), ("s", 8, 7), (None, 1, 5)])
    assert (got[1, 8].take, got[1, 8].short) == (5, False)
    assert got[1, 1].take == 5  # the minimum of class 8 is taken from its quota of 9
    assert (got[2, 1].take, got[2, 1].short) == (0, True)
    assert got[3, 1].take == 0 and not got[3, 1].short
    assert len(got) == 4


def test_empty_plans_and_populations(spark):
    assert _alloc(spark, [], [("s", 1, 4)]) == {}
    got = _alloc(spark, [(1, "s", 5, 1, 100, 0), (1, "s", 5, 99, 0, 2)], [])
    assert {(k[1], r.take, r.short) for k, r in got.items()} == {(1, 0, True), (99, 0, True)}


def test_random_allocations_are_whole(spark):
    rng = np.random.default_rng(3)
    targets, available = [], []
    for plan in range(30):
        pct, size = rng.multinomial(100, np.ones(8) / 8), int(rng.integers(1, 200))
        targets += [(plan, f"s{plan}", size, c + 1, int(pct[c]), int(rng.integers(0, 4))) for c in range(8)]
        available += [(f"s{plan}", c + 1, int(n)) for c, n in enumerate(rng.integers(0, 60, 8))]
    got = _alloc(spark, targets, available)
    for plan in range(30):
        rows = [r for (p, _), r in got.items() if p == plan]
        assert sum(r.take for r in rows) == min(sum(r.quota for r in rows), sum(r.available for r in rows))
        assert all(min(r.quota, r.available) <= r.take <= r.available for r in rows)
        assert sum(r.quota for r in rows) == max(rows[0].sample_size, sum(min(r.min_rows, r.available) for r in rows))
        assert all(r.take >= min(r.min_rows, r.available) for r in rows)
        for nodes in ((1, 2), (3, 4), (5, 6), (7, 8), (1, 2, 3, 4), (5, 6, 7, 8)):
            held = [r for r in rows if r.feature_class in nodes]
            assert sum(r.take for r in held) >= min(sum(r.quota for r in held), sum(r.available for r in held))
        for r in rows:
            assert r.short == (r.available < max(r.sample_size * r.target_pct / 100, r.min_rows))


def test_draw_is_exact_and_without_repeats(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 100)
    pop = spark.range(3000).select(F.col("id").alias("segment_id"), F.lit("s").alias("site_id"), F.when(F.col("id") < 2500, 1).otherwise(2).alias("feature_class"), F.lit("x").alias("rank"))
    t = spark.createDataFrame([(p, "s", 300, c, s, 1) for p in (1, 2) for c, s in ((1, 70), (2, 30))], TARGETS)
    alloc = sampling.allocate(t, sampling.population_counts(pop))
    rows = sampling.draw(pop, alloc).collect()
    assert not any(r.reserve for r in rows) and sorted(r.rank for r in rows if (r.plan_id, r.feature_class) == (1, 1)) == list(range(1, 211))
    for p in (1, 2):
        mine = [r.segment_id for r in rows if r.plan_id == p]
        assert len(mine) == len(set(mine)) == 300
        assert sum(i < 2500 for i in mine) == 210
    assert {r.segment_id for r in rows if r.plan_id == 1} != {r.segment_id for r in rows if r.plan_id == 2}
    assert sampling.draw(pop.limit(0), alloc).count() == 0


def test_reserve_shows_classes_that_run_out(spark):
    pop = spark.createDataFrame([(i, "s", 1 if i < 85 else 2) for i in range(115)] + [(200, None, 1), (201, "s", None)], "segment_id long, site_id string, feature_class int")
    t = spark.createDataFrame([(1, "s", 100, 1, 90, 0), (1, "s", 100, 2, 10, 30), (2, "s", 100, 1, 80, 0), (2, "s", 100, 2, 20, 30)], TARGETS)
    got: dict = {}
    for r in sampling.draw(pop, sampling.allocate(t, sampling.population_counts(pop))).collect():
        got.setdefault((r.plan_id, r.feature_class, r.reserve), set()).add(r.segment_id)
    # plan 1: class 1 gives 20 of its 90 to the minimum of class 2 and has 85 rows only; plan 2: 10 of 80
    assert {k: len(v) for k, v in got.items()} == {(1, 1, False): 70, (1, 1, True): 15, (1, 2, False): 30, (2, 1, False): 70, (2, 1, True): 10, (2, 2, False): 30}


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in np.round(rng.normal(100, 30, 4000))] + [("few", 1.0), ("few", 2.0)] + [("one", 5.0)] + [(None, 3.0), ("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("pct", F.lit(1)).repartition(4)
    halves = [df.where("v < 100"), df.where("not v < 100")]
    s = percentiles.merge([percentiles.summarise(h, ["g"], "v") for h in halves], ["g"])
    got = {(r.g, r.pct): (r.n, r.result) for r in percentiles.percentiles(s, ["g"], [10, 50, 90]).collect()}
    hot = [v for g, v in rows if g == "hot" and v is not None and np.isfinite(v)]
    for p in (10, 50, 90):
        assert got["hot", p][0] == 4000 and abs(got["hot", p][1] - np.percentile(hot, p)) < 1e-9
        assert abs(got["few", p][1] - np.percentile([1, 2], p)) < 1e-12
        assert got["one", p] == (1, 5.0) and got[None, p] == (1, 3.0)
    assert ("none", 50) not in got
    rough = percentiles.percentiles(percentiles.summarise(df, ["g"], "v", 8.0), ["g"], [10, 50, 90]).collect()
    assert all(abs(r.result - got[r.g, r.pct][1]) <= 4.0 for r in rough)
    assert percentiles.percentiles(percentiles.summarise(df.limit(0), ["g"], "v"), ["g"], [50]).count() == 0
    with pytest.raises(ValueError):
        percentiles.summarise(df, ["pct"], "v")


def _chain_exists(lo, hi, limit, overlap, marks):
    seen, todo = set(), [lo]
    marks = [m for m in marks if lo < m < hi]
    while todo:
        b = todo.pop()
        if hi - b <= limit:
            return True
        for m in marks:
            if b + overlap < m <= b + limit and m not in seen:
                seen.add(m)
                todo.append(m - overlap)
    return False


def test_cuts_are_legal_and_find_every_chain():
    rng = np.random.default_rng(5)
    for _ in range(600):
        hi, limit = float(rng.integers(10, 80)), float(rng.integers(5, 25))
        overlap = float(rng.integers(0, int(limit)))
        marks = np.unique(rng.integers(-5, 90, rng.integers(0, 25)).astype(float))
        inner = marks[(marks > 0) & (marks < hi)]
        pieces = list(splitting.cuts(0.0, hi, limit, overlap, inner))
        assert pieces[0][0] == 0 and pieces[-1][1] == hi
        for (b, e, hard), nxt in zip(pieces, pieces[1:]):
            assert e - b <= limit and nxt[0] == e - overlap and (hard or e in inner)
        assert pieces[-1][1] - pieces[-1][0] <= limit
        assert (not any(p[2] for p in pieces)) == _chain_exists(0.0, hi, limit, overlap, inner)


def test_split_handles_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(splitting, "ITEMS_PER_COPY", 3)
    items = spark.createDataFrame([(i, 1, 0.0, 100.0, 40.0, 10.0) for i in range(8)] + [(20, 1, 0.0, 30.0, 40.0, 10.0), (21, 1, 0.0, 100.0, 40.0, 40.0), (22, 1, 0.0, 100.0, None, 10.0), (23, 1, 0.0, 100.0, 40.0, float("nan")), (24, 2, 0.0, 100.0, 40.0, 10.0), (25, 1, None, 100.0, 40.0, 10.0), (26, 1, 0.0, 100.0, 40.0, -1.0)], "item_id long, source long, lo double, hi double, limit double, overlap double").withColumn("pos", F.lit("clash"))
    marks = spark.createDataFrame([(1, 35.0), (1, 35.0), (1, 60.0), (1, 85.0), (1, None), (1, -4.0), (1, 500.0), (None, 3.0)], "source long, pos double")
    got = {}
    for r in splitting.split(items, marks).collect():
        got.setdefault(r.item_id, []).append((r.piece, r.begin, r.end, r.hard_cut))
    assert set(got) == {*range(8), 24}
    assert sorted(got[0]) == [(0, 0.0, 35.0, False), (1, 25.0, 60.0, False), (2, 50.0, 85.0, False), (3, 75.0, 100.0, False)]
    assert sorted(got[24]) == [(0, 0.0, 40.0, True), (1, 30.0, 70.0, True), (2, 60.0, 100.0, False)]
    assert splitting.split(items.limit(0), marks).count() == 0


def test_histogram_packing_is_whole_and_dense():
    rng = np.random.default_rng(6)
    for _ in range(40):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(0, capacity + 1, rng.integers(1, 300))
        histogram = {int(k): int((lengths == k).sum()) for k in np.unique(lengths)}
        patterns = packing.pack_histogram(histogram, capacity)
        held: dict[int, int] = {}
        for count, pattern in patterns:
            assert sum(n * m for n, m in pattern) <= capacity
            for n, m in pattern:
                held[n] = held.get(n, 0) + count * m
        assert held == histogram
    real = np.minimum(rng.lognormal(6, 0.7, 20000).astype(int) + 20, 2048)
    patterns = packing.pack_histogram({int(k): int(v) for k, v in zip(*np.unique(real, return_counts=True))}, 2048)
    assert real.sum() / (2048 * sum(c for c, _ in patterns)) > 0.98


def test_pack_assigns_every_piece(spark):
    sizes = [(1, 10), (2, 25), (3, 7), (4, 0), (5, None), (6, 3), (6, 3), (7, 20), (8, 1), (9, -4)] + [(100 + i, 4) for i in range(40)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("rank", F.lit("clash"))
    rows = packing.pack(df, 10).collect()
    assert len(rows) == len(sizes) + 2 + 1
    load: dict[int, int] = {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert r.token_to - r.token_from == r.n_tokens
    assert max(load.values()) <= 10 and set(load) == set(range(len(load)))
    assert sorted(r.n_tokens for r in rows if r.doc_id == 2) == [5, 10, 10]
    assert {r.doc_id for r in rows if r.pieces > 1} == {2, 7}
    assert packing.pack(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_whitespace_tokens(spark):
    texts = ["", None, " ", "a", " a\tb\nc\x0bd\x0ce\rf ", "a b c", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(packing.whitespace_tokens(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 0, 1, 6, 2, 1]


def _words(n, salt):
    rng = np.random.default_rng(salt)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_leaks_exact_and_substituted(spark, monkeypatch, broadcast):
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", broadcast)
    monkeypatch.setattr(leakage, "COMPARED_AT_ONCE", 130)
    p, q, other = _words(50, 1), _words(40, 2), _words(300, 3)
    sub = p[:]
    for i in (9, 21, 33, 45):
        sub[i] = "changed"
    items = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(q)), (2, " ".join(q)), (3, "too short"), (4, None), (None, " ".join(p)), (5, "")], "item_id long, passage string").withColumn("doc_id", F.lit(0))
    docs = [
        (1, " ".join(other[:100] + p[10:40] + other[100:200])),
        (2, " ".join(other[:50] + p[10:39] + other[50:99])),
        (3, "§ ".join(w.upper() for w in other[:20] + p)),
        (4, " ".join(sub + q)),
        (None, " ".join(p)), (5, None), (6, ""), (7, " ".join(other)), (8, " ".join(q)), (8, " ".join(q)), (9, " ".join(_words(60_000, 9) + q)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(df, items).collect()}
    assert {k for k, r in got.items() if r.exact_words >= 30} == {(1, 1), (3, 1), (4, 2), (8, 2), (9, 2)}
    assert (got[4, 1].overlap_words, got[4, 1].matching_words, got[4, 1].passage_words) == (50, 46, 50)
    assert (2, 1) not in got
    assert got[1, 1].exact_words == 30
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_short_passages_are_found_whole(spark, monkeypatch, broadcast):
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", broadcast)
    p, q, r, other = _words(29, 21), _words(11, 22), _words(1, 23), _words(300, 24)
    items = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(q)), (3, r[0]), (4, "§ !"), (5, " ".join(_words(40, 25)))], "item_id long, passage string")
    docs = [
        (1, " ".join(other[:9] + p + other[9:20])),
        (2, "§ ".join(w.upper() for w in q)),
        (3, " ".join(other[:50] + q[:10] + ["changed"] + other[50:])),
        (4, " ".join(p[:28])), (5, p[28] + " " + " ".join(q + r + q)), (6, " ".join(q[:6])), (7, " ".join(q[6:])), (8, None),
    ]
    got = {(x.doc_id, x.item_id): tuple(x)[2:] for x in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), items).collect()}
    assert got == {(1, 1): (29,) * 4, (2, 2): (11,) * 4, (5, 2): (11,) * 4, (5, 3): (1,) * 4}


def test_masks_miss_no_choice_of_substituted_words():
    """Every choice of 3 words in 30, and of 4 inner ones in 40 or 5 in 50, leaves a window of a mask alone."""
    bits = lambda places: (np.uint64(1) << np.array(places, np.uint64)).sum(axis=-1, dtype=np.uint64)
    for n, k, edge in ((30, 3, 0), (40, 4, 1), (50, 5, 1)):
        lost = bits(list(itertools.combinations(range(edge, n - edge), k)))
        for mask in leakage.MASKS:
            for shift in range(n - mask[-1]):
                lost = lost[(lost & bits([p + shift for p in mask])) != 0]
        assert not len(lost)


def test_substituted_passages_are_all_found(spark):
    rng = np.random.default_rng(12)
    items = [(k, _words(int(rng.integers(30, 90)), 500 + k)) for k in range(200)]
    docs = []
    for k, ws in items:
        changed = ws[:]
        for i in 1 + rng.choice(len(ws) - 2, len(ws) // 10, replace=False):
            changed[i] = "other"
        docs.append((k, " ".join(["x"] * 40 + changed + ["y"] * 40)))
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, passage string")).collect()
    assert {(r.doc_id, r.item_id, r.overlap_words, r.matching_words) for r in found} == {(k, k, len(ws), len(ws) - len(ws) // 10) for k, ws in items}


def test_longest_overlap_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        e = rng.random(rng.integers(1, 40)) < 0.8
        n, m = leakage.longest_overlap(e, 9)
        best = max((j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if e[i] and e[j - 1] and 10 * e[i:j].sum() >= 9 * (j - i)), default=0)
        assert n == best and 10 * m >= 9 * n
        assert m == max((int(e[i : i + n].sum()) for i in range(len(e) - n + 1) if n and e[i] and e[i + n - 1]), default=0)


def _brute_spans(docs, least):
    found = {}
    for d, t in docs:
        if t is None:
            continue
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if any(e != d and u and t[i : i + least] in u for e, u in docs):
                cover[i : i + least] = True
        if cover.any():
            found[d] = found.get(d, np.zeros(len(t), bool)) | cover
    return found


@pytest.mark.parametrize("group_chars", [200_000, 60])
def test_shared_spans_match_brute_force(spark, monkeypatch, group_chars):
    monkeypatch.setattr(shared_spans, "GROUP_CHARS", group_chars)
    rng = np.random.default_rng(9)
    text = lambda n: "".join("abcd "[c] for c in rng.integers(0, 5, n))
    least, common = 24, [text(n) for n in (24, 30, 60, 23, 90)]
    docs = []
    for i in range(40):
        parts = [text(int(rng.integers(5, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            c = common[int(rng.integers(0, 5))]
            parts += [c[int(rng.integers(0, 3)) :], text(int(rng.integers(5, 40)))]
        docs.append((i, "".join(parts)))
    docs += [(50, docs[3][1]), (51, None), (52, ""), (53, "é\U0001f600" * 40), (54, "xé\U0001f600" * 3 + "é\U0001f600" * 20), (55, "z" * 5000), (55, "z" * 5000), (56, "y" + "z" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("name", F.lit("clash"))
    want = _brute_spans(docs, least)
    got = {}
    texts = dict(docs)
    for r in shared_spans.shared_spans(df, least).collect():
        assert r.end - r.begin >= least
        got.setdefault(r.doc_id, np.zeros(len(texts[r.doc_id]), bool))[r.begin : r.end] = True
    assert set(got) == set(want)
    for d in want:
        assert (got[d] == want[d]).all(), d
    shares = {r.doc_id: r for r in shared_spans.shared_shares(df, shared_spans.shared_spans(df, least)).collect()}
    assert all(shares[d].shared_chars == w.sum() for d, w in want.items())
    assert shares[51].share == 0 and shares[52].share == 0 and len(shares) == 47
    assert shared_spans.shared_spans(df.limit(0), least).count() == 0


def test_shared_spans_are_taken_out(spark):
    texts = {1: "0123456789é\U0001f600bcdef", 2: "unique", 3: None, 4: "", 5: "whole", 6: "abcdef"}
    df = spark.createDataFrame([(d, t, "x") for d, t in [*texts.items(), (2, "unique")]] + [(None, "no id", "x")], "doc_id long, text string, tag string")
    spans = [(1, 0, 2), (1, 4, 7), (1, 5, 9), (1, 5, 6), (1, 5, 6), (1, 9, 10), (1, 11, 12), (5, 0, 5), (6, 3, 6)]
    out = shared_spans.without_spans(df, spark.createDataFrame(spans, "doc_id long, begin long, end long"))
    assert out.columns == df.columns
    want = [(1, "23ébcdef", "x"), (2, "unique", "x"), (2, "unique", "x"), (3, None, "x"), (4, "", "x"), (5, "", "x"), (6, "abc", "x"), (None, "no id", "x")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    a = "".join(map(chr, np.random.default_rng(14).integers(97, 123, 500)))
    docs = spark.createDataFrame([(1, "A" + a + "B"), (2, "C" + a), (3, a[:399])], "doc_id long, text string")
    assert {tuple(r) for r in shared_spans.without_spans(docs, shared_spans.shared_spans(docs)).collect()} == {(1, "AB"), (2, "C"), (3, a[:399])}


def test_spans_in_very_long_texts(spark):
    rng = np.random.default_rng(13)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common, edge = text(400), text(399)
    long = text(399_800) + common + text(500_000) + edge + text(10)
    docs = [(1, long), (2, "A" + common + "B"), (3, "A" + edge + "B"), (4, text(100_000))]
    got = {(r.doc_id, r.begin, r.end) for r in shared_spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 399_800, 400_200), (2, 1, 401)}


def test_anchor_slices_join_up(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "SLICE", 64)
    rng = np.random.default_rng(10)
    a = "".join("abcdefgh"[c] for c in rng.integers(0, 8, 700))
    b = "q" * 37 + a[100:400] + "r" * 100
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    names = [set(shared_spans.stretches(codes(t), np.array([len(t)]), 30, 15)[0].tolist()) for t in (a, b)]
    assert names[0] & names[1]
    assert len(shared_spans.stretches(codes("ab"), np.array([2]), 30, 15)[0]) == 0
