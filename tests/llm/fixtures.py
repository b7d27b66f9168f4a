"""Small documents with every odd case: nulls, empty and long texts, copies, near copies, ties."""

import random

SF = "/root/testdata/sf0.001"


def odd_documents(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(k))
    texts = [None, "", " ", "one", "One two", "a b c d", "a b c d e", "A B C D E", "\n\n", prose(6000)]
    while len(texts) < n:
        kind = r.random()
        base = r.choice(texts[9:])
        if kind < 0.15:
            texts.append(base)
        elif kind < 0.4:
            words = base.split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(prose(r.choice([3, 20, 60, 150, 400])))
    rows = [(i * 3, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (rows[21][0], "another text under the same id", "en", "s", 0), (None, texts[25], None, None, None), (None, None, None, None, None)]
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    """With extra columns whose names clash with what operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, COLUMNS)
    for c in ("piece", "key", "rep", "bucket", "h", "n", "digest", "h1", "line_no", "label"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(5, "doc_id", "text")
