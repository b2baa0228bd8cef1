import random

import pyarrow as pa
import pytest

from shelfwise.llm import paragraph_dedup, suffix_dedup

from . import brute


def byte_texts():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ij") for _ in range(5000))
    return [
        (1, base, "s"), (2, base[:2000] + "X" + base[2000:], "s"), (3, "q" * 3000, "s"), (4, "zz" + base[100:510] + "y", "s"),
        (5, base[1000:1401] + "é" * 300, "s"), (6, "é" * 260, "s"), (7, None, "s"), (8, "", "s"), (9, base[:399], "s"),
        (10, "ab" * 900 + base[3000:3450] + "ab" * 900, "s"), (11, base[4600:] + base[:300], "s"), (12, base[:399] + "!", "s"),
        (13, base[2500:2900], "s"), (14, "ab" * 900 + base[3001:3451] + "ba" * 900, "s"), (15, base, "s"),
    ]


def run(df):
    return sorted(tuple(r) for r in suffix_dedup.remove_repeats(df).collect())


@pytest.mark.parametrize("held", [100_000, 3])
def test_bytes_equal_plain_removal(docs_of, monkeypatch, held):
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", held)
    rows = byte_texts()
    assert run(docs_of(rows, extra=True).repartition(3)) == sorted(brute.remove_repeats([r[:2] for r in rows]))


def test_keys_that_do_not_fit(spark):
    """A key with many runs is flushed in between; every repeated or open row comes out once."""
    rows = [(1, i // 3 if i % 5 else 90_000 + i, i, 0) for i in range(3000)] + [(2, 5, 1, 1)] + [(3, 7, i, i) for i in range(400)] + [(4, i, i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, run long, rid long, pos long").coalesce(1)
    small, suffix_dedup.HELD_ROWS = suffix_dedup.HELD_ROWS, 10
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        got = sorted(tuple(r) for r in suffix_dedup.repeated(df, with_key=True).collect())
    finally:
        suffix_dedup.HELD_ROWS = small
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    plain = sorted(tuple(r) for r in suffix_dedup.repeated(df, with_key=True).collect())
    assert got == plain and len(got) == len(set(got))
    assert {(r[0], r[1]) for r in got if r[3] == 3} == {(i, i) for i in range(400)}
    assert sum(r[2] for r in got if r[3] == 4) == 400 and not [r for r in got if r[3] == 2]


def test_repeated_and_null_rows(docs_of, odd_rows):
    rows = odd_rows + [(None, "z" * 450, "s"), (50, "z" * 450, "s"), (51, "unique " + "y1" * 230, "s"), (51, "unique " + "y1" * 230, "s")]
    got = suffix_dedup.remove_repeats(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute.remove_repeats([r[:2] for r in rows]), key=str)
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


def words_of(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 5000)) for _ in range(n)]


def test_near_lines_and_set_in_passages(docs_of):
    rng = random.Random(11)
    clean = [(i, "\n".join(" ".join(words_of(rng, 60)) for _ in range(4)), "s") for i in range(30)]
    line, passage = words_of(rng, 60), words_of(rng, 60)
    near = line[:20] + ["changed"] + line[20:]
    rows = clean + [(100, " ".join(line), "s"), (101, "x\n" + " ".join(near), "s")]
    for d in (200, 201, 202):
        a = words_of(rng, 80)
        rows.append((d, " ".join(a[:30] + passage + a[30:]), "s"))
    out = paragraph_dedup.repeated_parts(docs_of(rows, extra=True)).collect()
    assert {r.doc_id for r in out} == {100, 101, 200, 201, 202}
    lines = {r.doc_id: r for r in out if r.kind == "paragraph"}
    assert not lines[100].removed and lines[101].removed and lines[101].of_doc == 100 and lines[101].start_word == 1
    parts = {r.doc_id: r for r in out if r.kind == "passage"}
    assert {d: r.of_doc for d, r in parts.items() if d >= 200} == {200: 200, 201: 200, 202: 200}
    for d in (200, 201, 202):
        assert 30 <= parts[d].start_word and parts[d].start_word + parts[d].n_words <= 90 and parts[d].n_words >= 30


def test_paragraphs_against_all_pairs(docs_of):
    rng = random.Random(2)
    base = [words_of(rng, rng.randint(13, 60)) for _ in range(8)]
    rows = []
    for d in range(50):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        rows.append((d, " ".join(w), "s"))
    sets = {d: brute.shingle_set(t, 5, False) for d, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute.roots(sets, links)
    want = {d: root[d] for d in sets if sum(root[x] == root[d] for x in sets) > 1}
    out = paragraph_dedup.repeated_parts(docs_of(rows)).where("kind = 'paragraph'").collect()
    assert {r.doc_id: r.of_doc for r in out} == want


def test_cuts_do_not_depend_on_the_text_around(docs_of):
    rng = random.Random(9)
    passage = words_of(rng, 55)
    found = []
    for d in range(40):
        a, b = words_of(rng, 20), words_of(rng, 20)
        found.append((d, " ".join(a + passage + b), "s"))
    out = paragraph_dedup.repeated_parts(docs_of(found)).where("kind = 'passage'").collect()
    assert {r.doc_id for r in out} == set(range(40)) and len({r.of_doc for r in out}) == 1


def test_odd_paragraphs(docs_of, odd_rows):
    out = paragraph_dedup.repeated_parts(docs_of(odd_rows)).collect()
    assert {r.doc_id for r in out} <= {4, 5}
    assert {(r.doc_id, r.removed) for r in out if r.kind == "paragraph"} == {(4, False), (5, True)}
    assert paragraph_dedup.repeated_parts(docs_of([])).count() == 0


def test_parts_share_what_a_window_needs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    pieces = [w for _, where in suffix_dedup.parts(pa.array(["x" * 1700, None, "y" * 400, "z" * 399])) for w in where]
    windows = sorted((row, base + i) for row, base, a, b in pieces for i in range(b - a - 399))
    assert windows == [(0, i) for i in range(1301)] + [(2, 0)]
