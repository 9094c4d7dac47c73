"""Small tables with every odd row: nulls, empty, blank and long texts, ties, repeats, clashing names."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
BASE = [f"alpha{i} beta{i % 7}" for i in range(60)]


def near(k: int) -> str:
    words = " ".join(BASE).split()
    words[k % len(words)] = f"edit{k}"
    return " ".join(words)


ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (2, "One TWO three four five six", "en", "a", 27),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (6, LONG, "en", "b", len(LONG)),
    (7, "word", "de", "b", 4),
    (8, "word", "de", "b", 4),
    (8, "word", "de", "b", 4),
    (None, "no id here at all", "fr", "c", 17),
    (9, "Größe   naïve   日本語 🎉 é", "ja", "c", 20),
    (10, "same line\nsame line\nother\n\n\nsame line", "en", "c", 30),
    (11, "# * $ % & | < > symbols", None, None, 20),
    *[(20 + k, near(k), "en", "near", 500) for k in range(12)],
    (40, " ".join(BASE), "en", "near", 500),
    (41, " ".join(BASE), "en", "near", 500),
    (42, " ".join(f"{w} {w} {w}" for w in BASE), "en", "rep", 900),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCUMENTS)


def clashing(df):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ("size", "n", "h", "h1", "m", "rep", "cell", "part", "rank", "shard", "kept", "score", "ids", "block", "component", "cluster", "copies", "target", "host", "place", "value", "e", "base")
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def as_set(rows):
    return sorted(map(repr, map(tuple, rows)))
