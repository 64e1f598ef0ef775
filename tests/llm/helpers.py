from pyspark.sql import Row

#: Rows that every operator over documents must take: nulls, empty, blank and long texts, ties, repeated rows.
ODD = [
    (1, "the cat sat on the mat", "en", "src0"),
    (2, "the  cat sat\ton the mat", "en", "src0"),
    (3, "The Cat sat on the mat and so on", None, "src1"),
    (4, "", "en", None),
    (5, None, "fr", "src2"),
    (6, " \n\t ", "en", "src0"),
    (7, "word", "en", "src0"),
    (8, "word", "en", "src0"),
    (8, "word", "en", "src0"),
    (9, "é日本 🙂 " * 4000, "xx", "src3"),
    (10, "a" * 50_000, "en", "src9"),
    (11, "▁ under \x00 score \r\n", "en", "src1"),
    (None, "no id", "en", "src0"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ODD):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    extra = ["hash", "norm", "node", "key", "n", "raw", "shard", "bucket", "n_tokens", "score", "media", "keep_id"]
    return df.withColumns({c: F.lit("x") for c in extra})


def empty(spark):
    return documents(spark).limit(0)


def rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in rows(df)}


__all__ = ["ODD", "Row", "documents", "empty", "rows", "by_id"]
