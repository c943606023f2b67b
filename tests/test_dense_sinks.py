import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dense as V
from quillspark.operators import retrieval as R
from quillspark.sources import sinks


def letters(texts):
    return np.array([[t.count(c) + 0.0 for c in "abcd"] for t in texts])


def test_build_goes_on_where_it_stopped(spark, tmp_path):
    units = spark.createDataFrame([(f"c{i}", "abcd"[i % 4] * (1 + i)) for i in range(20)] + [("none", None)], "chunk_id string, text string")
    path = str(tmp_path / "index")
    index = V.build_index(units, letters, path, model="letters", parts=3)
    assert index.count() == 21

    def refuses(texts):
        raise AssertionError("encoded again")

    assert V.build_index(units, refuses, path, model="letters", parts=3).count() == 21
    with pytest.raises(ValueError, match="another build"):
        V.build_index(units, letters, path, model="other", parts=3)
    got = V.nearest(index, [0, 3.0, 0, 0], 3).collect()
    assert [(r.chunk_id, r.similarity) for r in got] == [("c1", 1.0), ("c13", 1.0), ("c17", 1.0)]
    same = V.encoded(units.limit(1), letters).first().vector
    assert np.isclose(np.linalg.norm(same), 1)


def test_wrong_shapes_are_errors(spark):
    units = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    with pytest.raises(Exception, match="encoder made"):
        V.encoded(units, lambda texts: np.zeros((2, 3))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", None)], "n int, a string, z string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": "a|b\nc", "n": 1, "z": None}
    sinks.write_csv(df.drop("a"), str(tmp_path / "c"), ["n", "missing", "z"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).select(F.col("n"), F.col("missing")).collect()] == [("1", None)]
    assert sinks.markdown_table(df) == "| n | a | z |\n| --- | --- | --- |\n| 1 | a\\|b c |  |"
    assert sinks.markdown_table(df.union(df).union(df), limit=2).endswith(" |\n\nOnly 2 rows are shown; there are more.")
    assert "shown" not in sinks.markdown_table(df.union(df), limit=2)
    assert sinks.pretty_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}'


def test_questions():
    assert R.plain_query("## Title\n- **do** `this`\n2. that") == "Title\ndo this\nthat"
    assert R.reference_items("text\n- one (evidence: x)\n2. two\n* one") == ["one", "two"]
    assert R.query_variants("q", [("x", 2.0), ("q", 0.5), (" ", 9.0)], lambda t, intent: ["y", "x"]) == [("x", 2.0), ("q", 1.0), ("y", 0.8)]
