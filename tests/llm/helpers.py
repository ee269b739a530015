"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from pyspark.sql import functions as F

BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood where nobody ever goes at night alone"
LONG = " ".join(f"word{i % 997} filler{i}" for i in range(9000))


def near(text: str, at: int, word: str) -> str:
    w = text.split()
    w[at] = word
    return " ".join(w)


ROWS = [
    (1, BASE, "en", "src0"), (2, BASE, "en", "src0"), (3, near(BASE, 24, "lonely"), "en", "src1"), (4, None, None, None), (5, "", "en", "src0"),
    (6, " \n\t ", "en", "src0"), (7, "two words", "de", "src2"), (8, "two  WORDS", "de", "src2"), (9, LONG, "en", "src0"), (10, LONG + " end", "en", "src0"),
    (11, "Größe ñandú\nzweite Zeile. dritte\n\nletzte", "de", "src1"), (12, "Released under the MIT License.\nsome other line of text here", "en", "src1"),
    (12, "Released under the MIT License.\nsome other line of text here", "en", "src1"), (None, "a text without an id that is long enough", "fr", "src3"),
    (14, "an id10t wrote this stupid line", "en", "src0"), (15, "a calm and friendly line", "en", "src0"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))


def clashing(df):
    """Extra columns with names that operators might use inside."""
    for c in ("id", "key", "n", "set_id", "block", "shard", "bucket", "h", "place", "copies", "html", "p"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
