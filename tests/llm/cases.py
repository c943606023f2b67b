"""Rows that the operators must take: nulls, empty and long texts, repeated rows, clashing column names."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows, extra=()):
    """rows: (doc_id, text) or (doc_id, text, lang, source); extra: names of further columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    for name in extra:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df
