"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

LONG = "Thonea the reand, of " * 20000
TEXTS = [None, "", " \n\t ", "one", "one two three four", LONG, "Ab\ncd\n\nAb", "日本語 mixed İstanbul ŉ \x1c ok <|endoftext|>!", "same text here for all of them", "same text here for all of them"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp long, host string, n int, prefix string, bits string, id long, t string, kept string, component string, `a.b` int"


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en", "src0", len(t or ""), 0.5, "x", 1, "h", 2, "p", "b", 3, "t", "k", "c", 7) for i, t in enumerate(texts)]
    rows += [(len(texts) - 1, *rows[-1][1:]), (None, "a null id", None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark).limit(0)
