"""The licence scan against its SQL, on files that share notices and hold whole licence texts."""

import duckdb

from starweave.llm import queries
from starweave.llm.licence_texts import FULL_TEXTS
from starweave.llm.oracles import ORACLES


def test_shared_notices_and_whole_texts_equal_the_sql(spark, monkeypatch):
    notice = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "nothing of the kind"]
    rows = [(i, f"{notice[i % 3]}\nbody {i} of its own words " + "and more " * (i % 5) * 40, f"src{i // 30}") for i in range(90)]
    rows += [(300 + i, text, "whole") for i, text in enumerate(FULL_TEXTS.values())]
    rows += [(400 + i, "no notice", "whole") for i in range(5)] + [(500, None, None), (501, "", "whole"), (502, notice[0], None), (503, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "table", lambda s, d, name: frame)
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    got = queries.license_scan(spark, "")
    expected = con.execute(ORACLES["op4_license_scan"])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    found = sorted(map(str, map(tuple, got.select(*columns).collect())))
    assert found == sorted(map(str, expected.fetchall()))
    licences = {r["doc_id"]: (r["licence"], r["origin"]) for r in got.collect()}
    assert licences[0] == ("MIT", "own") and licences[1] == ("Apache-2.0", "own") and licences[503] == ("MIT", "inherited")
    assert [licences[300 + i] for i in range(len(FULL_TEXTS))] == [(name, "own") for name in FULL_TEXTS]
