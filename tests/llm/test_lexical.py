import math
import re
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """(item_id, rank, doc_id, score) by scoring every document."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, ts in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in ts}
        scored = []
        for d, c, size in held:
            m = 50 + 50 * size * n // total
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["thé", "Æon", "日本"]
    shares = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=shares / shares.sum()))
    docs = [(i, text(int(rng.integers(1, 120)))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)]  # copies: equal scores
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("sizes", [None, (64, 8), (16, 16), (5, 8)])
def test_equals_scoring_every_document(spark, docs_of, corpus, sizes):
    docs, items = corpus
    df = docs_of([(d, t, "s") for d, t in docs], extra=True).selectExpr("*", "1 as n", "2 as tf", "3 as item").repartition(5)
    asked = spark.createDataFrame([(i, t) for i, t in items], ITEMS).selectExpr("*", "1 as terms", "'x' as doc_id")
    assert got(lexical.search(df, asked, sizes=sizes, sample_docs=100)) == plain(docs, items)


def test_many_groups_of_items(spark, docs_of, corpus):
    docs, items = corpus
    df = docs_of([(d, t, "s") for d, t in docs])
    asked = spark.createDataFrame(items, ITEMS)
    assert got(lexical.search(df, asked, k=7, most=(60, 20), sample_docs=50)) == plain(docs, items, 7)


def test_blocks_of_other_subjects_are_skipped(spark, docs_of):
    rng = np.random.default_rng(9)
    text = lambda s, n: " ".join(f"w{x}" for x in np.where(rng.random(n) < 0.8, 40 * s + rng.integers(0, 40, n), rng.integers(0, 400, n)))
    docs = [(i, text(i % 10, 60)) for i in range(1000)]
    items = spark.createDataFrame([(i, text(i, 12)) for i in range(10)], ITEMS)
    report = lexical.search(docs_of([(d, t, "s") for d, t in docs]).coalesce(1), items, k=3, sizes=(512, 8), sample_docs=100, report=True).collect()
    assert len(report) == 10 and sum(r.scored for r in report) < 0.65 * sum(r.blocks for r in report)


def test_odd_rows(spark, docs_of, odd_rows):
    items = [(1, "one TWO three"), (1, "word1x1 four"), (2, None), (3, ""), (4, "absent"), (None, "same line é" + "é" * 499), (5, "!!! ..."), (6, "word3x3 " * 9 + "word5x5 a_b")]
    rows = [*odd_rows, (10, "a\x00b\x7fthé\x1cTHÉ  x", "s"), (11, "a_b", None)]
    out = lexical.search(docs_of(rows, extra=True), spark.createDataFrame(items, ITEMS))
    assert got(out) == plain([(d, t) for d, t, _ in rows], items)


def test_empty_tables(spark, docs_of):
    some, none = spark.createDataFrame([(1, "a b")], ITEMS), spark.createDataFrame([], ITEMS)
    assert lexical.search(docs_of([]), some).count() == 0
    assert lexical.search(docs_of([(1, None, "s")]), some).count() == 0
    assert lexical.search(docs_of([(1, "a", "s")]), none).count() == 0
    assert lexical.search(docs_of([(1, "a", "s")]), some).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_bound_is_never_below_a_score():
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 900, (300, 40)) * (rng.random((300, 40)) < 0.2)
    rows, cols = np.nonzero(dense)
    weight = rng.integers(0, 20_000, 40)
    tile = lexical.Tile(rows, cols, dense[rows, cols], weight, 300, 8)
    w = weight.astype(float)
    for b in range(len(tile.summaries)):
        held = tile.docs[tile.starts[b] : tile.starts[b + 1]]
        assert len(held) and (tile.summaries[b] @ w >= (dense[held] @ w).max())
    assert set(tile.docs) == set(rows[weight[cols] > 0])
