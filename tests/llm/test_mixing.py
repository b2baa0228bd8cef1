from collections import defaultdict

from shelfwise.llm import mixing

from . import brute


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    """Share by weight, stop at the limit, share the excess anew, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped, left = {}, set(), sum(sizes.values())
    while True:
        open_weight = sum(weight[s] for s in names if s not in stopped)
        share = {s: left * weight[s] / open_weight for s in names if s not in stopped}
        over = {s for s in share if share[s] > limit * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        stopped |= over


def rows_of(n=400):
    return [(i, " ".join(["w"] * (i * 7 % 90)), [None, "b", "a", "tiny", "é"][(i * i) % 5 if i % 40 else 3]) for i in range(n)]


def test_targets_and_taken_words(docs_of):
    rows = rows_of()
    out = mixing.mix(docs_of(rows, extra=True)).collect()
    assert len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    words = {d: len(brute.WORD.findall(t)) for d, t, _ in rows}
    for r in out:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
        assert {r.source_size for r in out if r.source == s} == {sizes[s]}


def test_reruns_agree(docs_of):
    docs = docs_of(rows_of(100))
    pick = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert pick(mixing.mix(docs)) == pick(mixing.mix(docs.repartition(7)))


def test_many_shards(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)
    out = mixing.mix(docs_of(rows_of())).collect()
    assert len({(r.source, r.shard) for r in out}) > 20
    total = defaultdict(lambda: [0, 0.0, set()])
    for r in out:
        total[r.source][0] += r.taken
        total[r.source][1] = r.target
        total[r.source][2].add(r.shard)
    for taken, target, shards in total.values():
        assert abs(taken - target) <= mixing.BLOCK_WORDS * (1 + len(shards))


def test_documents_are_copied_as_the_mix_says(docs_of):
    rows = rows_of(120)
    docs = docs_of(rows, extra=True)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    got = defaultdict(int)
    for r in copies.collect():
        got[r.doc_id] += len(brute.WORD.findall(r.text))
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if n}


def test_odd_rows(docs_of, odd_rows):
    out = mixing.mix(docs_of(odd_rows, extra=True))
    assert out.count() == len(odd_rows)
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None, "a"), (2, "", None)])).collect()[0].taken == 0
    assert mixing.mixed_documents(docs_of([])).count() == 0
