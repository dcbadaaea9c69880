"""Licences that differ in a word or two are told apart; the SQL states the whole semantics."""

import duckdb
import pytest

from tessera.llm import licenses, queries

ONE = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
HEADER = "# {}\n# Copyright (C) 2020 A. Nonymous\n#\n# {}\n#\n# It is distributed in the hope that it will be useful.\nimport os\n"


@pytest.fixture(scope="module")
def texts():
    out = [t for _, t in ONE] + [HEADER.format("tool.py", t.replace(" of the ", " of\n# the ")) for _, t in ONE]
    bsd = licenses.TEMPLATES["BSD-2-Clause"][0]
    return out + [bsd + " Some more. " + licenses.TEMPLATES["BSD-3-Clause"][0], "The code of this project was released under the MIT License.",
                  "word " * 400 + licenses.TEMPLATES["LGPL-3.0"][0] + " word" * 400, licenses.TEMPLATES["GPL-2.0"][0].replace("version 2", "version 4"),
                  ONE[0][1] + "\n" + licenses.TEMPLATES["MIT"][2], "licence", None, "", "Der Mann mit dem Hut", "Version 3 of the GNU General plan"]


def test_one_licence_for_one_notice(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: {m.licence for m in r.matches} for r in licenses.scan(docs).collect()}
    for i, (name, _) in enumerate(ONE):
        assert got[i] == {name}, (name, got[i])
        assert got[len(ONE) + i] in ({name}, set()), (name, got[len(ONE) + i])
    n = 2 * len(ONE)
    assert got[n] == {"BSD-3-Clause"} and got[n + 1] == {"MIT"} and got[n + 2] == {"LGPL-3.0"} and got[n + 3] == set()
    assert got[n + 4] == {"Apache-2.0", "MIT"} and all(got[i] == set() for i in range(n + 5, len(texts)))
    assert sum(bool(got[len(ONE) + i]) for i in range(len(ONE))) >= len(ONE) - 2


def test_query_equals_its_sql(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op9_license_scan(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op9_license_scan"]).fetchall())
    assert sum(r[1] for r in got) > 40


@pytest.mark.parametrize("percent", [80, 90])
def test_telling_words_are_needed(percent):
    for name, grams, marks in licenses.template_bigrams():
        told, whole = licenses.telling_words(grams, marks, percent)
        assert told
        if not whole:
            left = [g for g in grams if not set(told) & set(g.split())]
            assert 2 * len(left) / (len(left) + len(grams)) < percent / 100
