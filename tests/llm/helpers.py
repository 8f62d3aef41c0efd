"""Small document tables with every awkward row, written where queries can read them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"


def odd_rows():
    long_text = "alpha beta gamma " * 4000
    return [
        (0, "The cat sat on the mat", "en", "a", 1, 9, "x"),
        (1, "The cat sat on the mat", "en", "a", 1, 9, "x"),
        (1, "The cat sat on the mat", "en", "a", 1, 9, "x"),
        (2, None, "fr", None, None, None, None),
        (3, "", None, "b", 0, 1, ""),
        (4, long_text, "en", "b", 1, 1, "y"),
        (5, "Größe über ÜBER naïve 日本語 \U0001f600 café", "de", "é", 1, 1, "y"),
        (None, "no id here", "en", "a", 1, 1, "z"),
        (7, " \t\n ", None, "a", 1, 1, "z"),
    ]


def table(spark, tmp_path, name, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
