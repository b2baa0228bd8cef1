import textwrap

from shelfwise.llm import licenses


def test_lines_paragraphs_and_whole_texts(docs_of):
    mit, header = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0 header"]
    prose = "Nothing in this line says anything about terms of use at all.\n" * 5
    rows = [
        (1, prose + "  ** RELEASED under the MIT-License! **\n" + prose, "s"),
        (2, mit.replace(". ", ".\n").upper(), "s"),
        (3, "int main() {}\n\n" + header.replace(";", ";\n") + "\n\n" + prose, "s"),
        (4, prose, "s"),
        (5, "licensed under the license", "s"),
        (6, header.replace("software distributed", "code that we hand out"), "s"),
    ]
    out = {r.doc_id: r for r in licenses.scan(docs_of(rows, extra=True)).collect()}
    assert {d: r.license for d, r in out.items()} == {1: "MIT notice", 2: "MIT", 3: "Apache-2.0 header", 4: None, 5: None, 6: "Apache-2.0 header"}
    assert 2 * out[6].shared >= 0.8 * out[6].total and out[4].n_matches == 0


def test_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(9, "All rights reserved", None), (9, "All rights reserved", None)]
    out = licenses.scan(docs_of(rows)).collect()
    assert len(out) == len({d for d, _, _ in rows})
    assert [(r.license, r.n_matches) for r in out if r.doc_id == 9] == [("All rights reserved", 1)]
    assert licenses.scan(docs_of([])).count() == 0


def test_licences_across_paragraphs_and_within_lines(docs_of):
    prose = " ".join(f"word{i * 7919 % 1009}" for i in range(400)) + " "
    mit, apache, gpl = (licenses.TEMPLATES[n] for n in ("MIT", "Apache-2.0 header", "GPL-3.0 header"))
    split = lambda text, *at: "\n\n".join(text[a:b] for a, b in zip([0, *[text.index(x) for x in at]], [*[text.index(x) for x in at], None], strict=True))
    blocks = {
        1: split(mit, "The above", "THE SOFTWARE IS"),
        2: split(apache, "You may obtain", "http://www", "Unless"),
        3: split(gpl, "This program is distributed"),
        4: textwrap.fill(mit, 60),
        5: mit,
    }
    rows = [(d, f"{prose}\n\nLicence\n\n{block}\n\n{prose}", "s") for d, block in blocks.items()]
    rows += [(6, f"{prose}{apache} {prose}\nmore", "s"), (7, f"{prose}Released under the MIT License. {prose}", "s"), (8, prose * 3, "s")]
    rows += [(9, f"{prose}\n{prose}{textwrap.fill(mit, 60)}\n{prose}\nAll rights reserved.\n", "s")]
    rows += [(10, f"{prose}{apache.replace('software distributed', 'code that we hand out')} {prose}", "s")]
    out = {r.doc_id: r for r in licenses.scan(docs_of(rows, extra=True)).collect()}
    want = {1: "MIT", 2: "Apache-2.0 header", 3: "GPL-3.0 header", 4: "MIT", 5: "MIT", 6: "Apache-2.0 header", 7: "MIT notice", 8: None, 10: "Apache-2.0 header"}
    assert {d: out[d].license for d in want} == want
    assert (out[9].n_matches, out[1].shared * 2, out[8].n_matches) == (2, out[1].total, 0)
