"""Small documents with the awkward cases every operator must stand."""

AWKWARD = [
    (1, "Hello  World, it's FINE. naïve Ünïcode ß ﬁ é İstanbul ΣΑΣ", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (5, "one", "en", "b", 3),
    (5, "one", "en", "b", 3),
    (6, "<|endoftext|>text<|startoftext|> <|endof|> ''s't'RE 12³ ½ 中文字  x y\x85z\x1fw 　q", "zh", "c", 50),
    (7, "word " * 3000 + "x" * 5000, "en", "c", 20000),
    (8, "a b c d e f g h a b c d e f g h\nline one\nline one\n\n \nline one $#*", "en", "a", 60),
    (None, "no id here at all", "en", None, 17),
    (9, "\U0001f600\U0001f600 ok &amp; <|im_end|>", "en", "a", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=True):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "size", "p", "h", "part", "ids", "_text", "score", "block", "hash", "label", "shard", "bin"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
