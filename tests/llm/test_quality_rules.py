import pytest

from shelfwise.llm import quality_rules

from . import brute


def test_counts_equal_plain_ones(docs_of, odd_rows):
    rows = odd_rows + [(20 + i, " ".join("ab cd ef gh".split()[j * i % 4] for j in range(i)), "s4") for i in range(12)]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(rows, extra=True)).collect() if r.doc_id is not None}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            assert tuple(got[doc_id][c] for c in quality_rules.COUNTS) == brute.counts(text), doc_id


def test_every_row_is_judged(docs_of, odd_rows):
    out = quality_rules.judge(docs_of(odd_rows))
    assert out.count() == len(odd_rows)
    assert not [r for r in out.collect() if r.base_failed and r.kept]


def test_bad_host_takes_its_good_documents_along(docs_of):
    good = " ".join(f"w{i}" for i in range(80))
    bad = [(i, "too short", "bad") for i in range(40)] + [(90, good, "bad")]
    fine = [(100 + i, good + f" {i}", f"h{i % 3}") for i in range(60)]
    kept = {r.doc_id for r in quality_rules.keep_good(docs_of(bad + fine, extra=True)).collect()}
    assert kept == {d for d, _, _ in fine}


def test_small_host_is_shrunk_to_the_rest(docs_of):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, f"h{i % 5}") for i in range(200)] + [(900, "short", "tiny"), (901, good, "tiny2")]
    out = {r.doc_id: r for r in quality_rules.judge(docs_of(rows)).collect()}
    assert not out[900].kept and out[900].base_failed and out[901].kept
    assert out[900].host_rate < 1.0


@pytest.mark.parametrize("make", [quality_rules.judge, quality_rules.keep_good])
def test_empty_table(docs_of, make):
    assert make(docs_of([])).count() == 0
