from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def odd(spark, rows):
    """The same with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    frame = docs(spark, rows)
    return frame.withColumns({c: F.lit(7) for c in ("key", "id", "n", "bands", "component_id", "kept", "row", "block", "score", "a", "b", "length", "piece", "base", "spans")})


NASTY = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id at all"), (5, "x" * 5000), (6, "a b c d e f g " * 700), (7, "Grüße, 世界! \U0001f600 naïve"), (8, "a b c d e f g " * 700)]
