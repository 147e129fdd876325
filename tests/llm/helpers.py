"""Small tables with the awkward cases, and plain re-tellings of what the operators should return."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"
LONG = "lorem ipsum dolor " * 20000


def frame(spark, rows):
    """Rows (doc_id, text[, lang, source]) as a documents table with two extra columns whose names operators use too."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1.5, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    return frame(spark, [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k"), (6, "é😀 ok", None, None)])
