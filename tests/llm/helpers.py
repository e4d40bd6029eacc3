"""Frames for the operators' tests."""

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["score", "fp", "digest", "key", "_gone", "_bad", "_cut", "_leak", "size", "bin_id", "row_key", "y", "band", "root", "found"]


def documents(spark, rows, extra=True):
    """(doc_id, text[, lang, source]) as documents, with columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DDL)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    return df


#: Null texts and ids, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "the cat sat on the mat and looked at the moon for a while"), (2, None), (3, ""), (4, "   \n\t "), (5, "the cat sat on the mat and looked at the moon for a while"),
    (6, "word " * 20_000), (7, "x"), (8, "é" * 300), (None, "no identifier here at all but some words"), (None, None), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (10, "日本語のテキスト 123 \U0001f600 end"),
]
