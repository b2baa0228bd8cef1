import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import common, hashing, ngram_join, similar

from . import brute


def near_texts(n=90, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randint(0, 400))
    base = [[word() for _ in range(rng.choice([3, 12, 60, 200]))] for _ in range(12)]
    rows = []
    for d in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - d, " ".join(x.upper() if rng.random() < 0.1 else x for x in w), "s"))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("tile", [512, 4])
def test_equals_all_pairs(docs_of, monkeypatch, k, num, den, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar.verified_links, "__defaults__", (tile,))
    rows = near_texts()
    out = ngram_join.join_components(docs_of(rows, extra=True).repartition(5), k, num, den)
    assert sorted(tuple(r) for r in out.collect()) == brute.join_components([r[:2] for r in rows], k, num, den)


def test_odd_rows(docs_of, odd_rows):
    out = ngram_join.join_components(docs_of(odd_rows, extra=True)).collect()
    assert len(out) == len(odd_rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[5][1] == 4 and got[6] == (1, 6) and got[7] == (2, 7)
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert ngram_join.join_components(docs_of([])).count() == 0


def test_one_of_each_group_stays(docs_of, odd_rows):
    docs = docs_of(odd_rows, extra=True)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and {1, 2, 3, 4, 7, 8, 9} <= set(ids) and ids.count(None) == 2


def test_pipeline_stage_loses_no_link(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEGMENTS", 1)
    rows = near_texts()
    want = [d for d, _, root in brute.join_components([r[:2] for r in rows], 5, 80, 100) if d == root]
    kept = corpus_pipeline.near_stage(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("num", [80, 90])
def test_similar_sizes_share_a_band(spark, num):
    # Every size up to 3000 with the largest that can be similar to it.
    sizes = spark.range(1, 3001).select(F.col("id").alias("a"), F.floor(F.col("id") * 100 / num).alias("b"))
    low, high = similar.size_band(F.col("a")), similar.size_band(F.col("b"))
    bands = sizes.select("a", "b", low.alias("low"), high.alias("high")).orderBy("a").collect()
    own = [r.low for r in bands]
    assert own == sorted(own) and own[-1] > 20
    assert all(own[r.a - 1] <= own[min(r.b, 3000) - 1] <= r.high for r in bands)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.sampled_from([(90, 100), (80, 100)]), st.integers(0, 10**6))
def test_similar_sets_share_a_key(n, changes, limit, seed):
    num, den = limit
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    b = a.copy()
    for _ in range(min(changes, n)):
        what = rng.integers(3)
        i = rng.integers(len(b))
        b = np.delete(b, i) if what == 0 and len(b) > 1 else np.append(b, rng.integers(0, 2**63, dtype=np.uint64)) if what == 1 else np.append(np.delete(b, i), rng.integers(0, 2**63, dtype=np.uint64))
    b = np.unique(b)
    shared = len(np.intersect1d(a, b))
    if den * shared >= num * (len(a) + len(b) - shared):
        for most in (None, ngram_join.SEGMENTS):
            keys = [set(ngram_join.segment_keys(s, num, den, most).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]
        assert similar.linked([a, b], np.array([0, 1]), False, num, den) or len(a) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b\x85\xa0ß", max_size=60), max_size=12), st.integers(1, 40))
def test_words_are_those_of_the_rule(texts, block):
    old, hashing.BLOCK_BYTES = hashing.BLOCK_BYTES, block
    try:
        data, offsets = hashing.buffers(pa.array(texts, pa.string()))
        h, first, at = hashing.word_hashes(data, offsets)
    finally:
        hashing.BLOCK_BYTES = old
    seen = {}
    for i, t in enumerate(texts):
        w = brute.WORD.findall(t)
        assert at[i + 1] - at[i] == len(w)
        for word, x in zip(w, h[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("xxhash64(id) as a", "xxhash64(id + 1) as b").union(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a long, b long"))
    labels = common.components(chain, name="chain").groupBy("root").count().collect()
    assert sorted(r["count"] for r in labels) == [2, 201]
    assert common.components(spark.createDataFrame([], "a long, b long"), name="none").count() == 0


def test_bitmaps_keep_every_similar_pair_and_few_others():
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 40, 300, 310, 2500, 12_000):
        base = rng.integers(0, 2**63, n, np.int64)
        sets += [base, np.concatenate([base[: n - n // 20], rng.integers(0, 2**63, n // 20, np.int64)])]
        sets.append(rng.integers(0, 2**63, n, np.int64))
    sets = [np.sort(s).view(np.uint64) for s in sets]
    lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
    ids = pa.array(range(len(sets)), pa.int64())
    drawn = next(similar.with_bitmaps(iter([pa.RecordBatch.from_arrays([ids, ids, lists], names=["id", "root", "set"])])))
    bits = [np.array(b, np.int64).view(np.uint64) for b in drawn.column("bits").to_pylist()]
    hit = similar.partnered(drawn.column("n").to_numpy(), bits, np.zeros(len(sets), int), False, 80, 100)
    assert list(np.flatnonzero(hit)) == [i for i in range(len(sets)) if i % 3 < 2]


def test_only_rows_with_a_possible_partner_stay_in_a_cell(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1, [int(x) for x in np.sort(rng.integers(0, 2**62, 200))]) for i in range(60)]
    rows += [(100, 1, rows[0][2][:-5] + [2**62 + 1]), (101, 2, rows[1][2])]
    made = spark.createDataFrame(rows, "id long, root long, set array<long>")
    cells = made.mapInArrow(similar.with_bitmaps, "id long, root long, n long, bits array<long>").withColumns(
        {"cell": F.col("root"), "band": F.lit(0), "x": F.lit(0), "y": F.lit(0), "tile": F.lit(0)}
    )
    assert sorted(r["id"] for r in similar.with_partner(cells, 80, 100).collect()) == [0, 100]
    for tile in (8, 512):
        links = similar.verified_links(made, 80, 100, tile=tile)
        assert {tuple(sorted(r)) for r in links.collect()} == {(0, 100)}
