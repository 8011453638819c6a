"""Documents with everything that may be odd about them, and plain versions of the operators."""

import random

DOCS = "doc_id BIGINT, text STRING, score STRING, fp INT, slot STRING, kept INT, turn INT, words STRING"


def odd_documents(spark, extra=()):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rng = random.Random(5)
    vocabulary = [f"w{rng.randrange(400)}{c}" for c in "abcdefgh" for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = prose(30_000)
    texts = [(1, prose(80)), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, prose(60)), (7, "x" * 5000), (8, prose(120)), (None, prose(70)), (None, None)]
    texts += [(9, texts[0][1]), (1, texts[0][1]), (1, prose(90)), (10, texts[7][1] + " tail"), (11, "É ́　日本語 🎉 ß\r\nİ"), (12, "\x00a\x1cb\x85c"), *extra]
    return spark.createDataFrame([(i, t, "s", 1, "x", 0, 2, "w") for i, t in texts], DOCS)


def empty(df):
    return df.where("1 = 0")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
