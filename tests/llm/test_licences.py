import textwrap

import duckdb
import pandas as pd

from editloom.llm import licences
from tests.llm.fixtures import documents, odd_rows


def test_trained_well_on_paragraphs_held_back():
    classes, weights, bias, right = licences.train()
    assert right > 0.95 and len(classes) == len(bias) == len(licences.TEMPLATES) + 1
    assert 0 < len(weights) < 2000


def test_families_and_unknown(spark):
    rows = [(k, f"some text before\n{t}\nand behind", "s") for k, (f, ts) in enumerate(licences.TEMPLATES.items()) for t in ts]
    want = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = {x.doc_id: x for x in licences.scan_licences(documents(spark, rows)).where("paragraph = 1").collect()}
    assert [got[k].family for k in range(len(rows))] == want
    others = documents(spark, [(k, t, "s") for k, t in enumerate(licences.OTHERS)])
    assert {x.family for x in licences.scan_licences(others).collect()} == {"unknown"}


def test_a_changed_word_and_a_shared_line(spark):
    line = "Copyright 2020 Someone. This work is licensed under the GNU General Public License, version 3."
    docs = documents(spark, [(k, f"{line}\nrest {k}", "s") for k in range(300)])
    got = licences.scan_licences(docs).collect()
    assert len(got) == 300 and {(x.family, x.paragraph) for x in got} == {("gpl-3.0", 0)}


def test_odd_rows_and_sql(spark):
    rows = odd_rows() + [(300, "Released under the MIT License.", "a"), (300, "Released under the MIT License.", "a"), (301, "A license to fish\n\nLICENSED UNDER CC BY 4.0.", None)]
    docs = documents(spark, rows)
    got = sorted(map(tuple, licences.scan_licences(docs).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = sorted(con.sql(licences.op6_sql()).fetchall(), key=str)
    assert got == want and len(got) == 4
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_wrapped_notices(spark):
    long = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(t) > 72]
    rows, want = [], []
    for family, t in long:
        for width, lead in ((72, ""), (72, " * "), (30, "# ")):
            lines = [lead + x for x in textwrap.wrap(t, width)]
            rows.append((len(rows), "\n".join(["first line of the file", "", *lines, "", "x = 1"]), "s"))
            want.append((family, 2, "\n".join(lines)))
    assert len(long) > 5
    got = {}
    for x in licences.scan_licences(documents(spark, rows)).where("family <> 'unknown'").collect():
        got.setdefault(x.doc_id, []).append((x.family, x.paragraph, x.text))
    assert {k: {f for f, _, _ in v} for k, v in got.items()} == {k: {w[0]} for k, w in enumerate(want)}
    # a line of these notices can be one by itself
    assert [(k, got[k]) for k, w in enumerate(want) if w[0] not in ("apache-2.0", "cc-by-4.0") and got[k] != [w]] == []
    twice = documents(spark, [(1, rows[0][1] + "\n" * 9 + rows[0][1], "s"), (1, rows[0][1], "s"), (None, rows[0][1], "s")])
    assert licences.scan_licences(twice).where("family <> 'unknown'").count() == 4
