from __future__ import annotations

from lodestrata import api


def test_sql_functions(spark):
    api.register_functions(spark)
    row = spark.sql("SELECT byte_entropy(X'00FF') AS e, json5_parse('{b: 1, a: [.5,],}') AS j, json5_parse('{') AS bad, longest_run('ab  c', '[a-z]+') AS r, line_count('a\\nb\\n') AS n").first()
    assert (row.e, row.j, row.bad, row.r, row.n) == (1.0, '{"a": [0.5], "b": 1}', None, 2, 2)
    assert api.rules_df(spark).count() == 35
    texts = spark.createDataFrame([("debugger;",), (None,)], "text string")
    assert [r.raw_signals for r in api.with_raw_signals(texts).collect()] == [["anti-debugging or automation check"], []]
