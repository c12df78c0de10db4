"""Small tables with nulls, empty, long and repeated texts, ties and clashing column names."""

from pyspark.sql import functions as F

WORDS = "the cat sat on a mat while rain fell over old grey roofs and nobody came to look at it again that day".split()


def passage(n, shift=0):
    return " ".join(WORDS[(i * 7 + shift * 3 + i // 20) % len(WORDS)] + str((i + shift) % 13) for i in range(n))


ROWS = [
    (5, passage(60)), (3, passage(60)), (9, passage(60) + " and more words"), (1, None), (2, ""), (4, "   \n\t "),
    (7, "one"), (8, "Two three"), (8, "Two three"), (10, passage(3000, 5)), (11, "x" * 30000), (12, passage(40, 2) + "  \n " + passage(60)),
    (13, "naïve café ÉTÉ straße 東京 <|endoftext|> don't\xa0stop"), (14, passage(30, 9)), (15, passage(30, 9).upper()), (None, passage(20, 4)), (16, passage(20, 4)),
]


def frame(spark, rows=None):
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    # names that the operators use themselves
    return df.repartition(3).withColumns({c: F.lit(7) for c in ("content", "n_tokens", "bucket", "kind", "segment", "n", "group", "file", "normal", "score", "item_id", "start")})
