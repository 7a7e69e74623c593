"""Small awkward tables and plain versions shared by the tests."""

from pyspark.sql import types as T

LONG = "the quick word " * 9000

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for their own columns.
    T.StructField("score", T.StringType()), T.StructField("language", T.LongType()), T.StructField("copies", T.StringType()), T.StructField("_text", T.StringType()),
])

DOC_ROWS = [
    (1, "the cat sat on the mat and then the cat slept", "en", "a"),
    (2, "le chat était assis sur le tapis et puis il dormait", "fr", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n\x0b\x0c\r ", "fr", None),
    (6, "12345 !!! ???", None, "b"),
    (7, "the cat sat on the mat and then the cat slept", "en", "b"),
    (7, "the cat sat on the mat and then the cat slept", "en", "b"),
    (None, "the dog ran in the park with the other dog", "en", "a"),
    (None, None, None, None),
    (8, LONG, "en", "c"),
    (9, "é" * 70001, "fr", "c"),
    (10, "word", None, "a"),
    (11, "word\x1cword two", "en", "a"),
    (12, "nul\0inside the text", "en", "é"),
]


def doc_table(spark, rows=DOC_ROWS):
    return spark.createDataFrame([r + (len(r[1] or ""), "x", 1, "y", "z") for r in rows], DOC_SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def components(nodes, links):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
