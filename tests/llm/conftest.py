import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("block", T.StringType()),
])


def corpus(seed=5, n=60):
    """Rows with nulls, empties, copies, near copies, junk, long texts, ties, common lines."""
    r = random.Random(seed)
    syllables = ["er", "tion", "the", "an", "re", "ou", "ing", "be", "sch", "que", "é", "os", "ment", "ci"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(4, 14))).capitalize() + "."
    texts = ["\n".join(" ".join(sentence() for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))) for _ in range(n)]
    texts[1] = texts[0]
    for i in range(2, 9):  # a family of near copies
        words = texts[0].split(" ")
        words[r.randrange(len(words))] = "zz" + str(i)
        texts[i] = " ".join(words)
    for i in range(10, 30):
        texts[i] += "\n  Licensed under the Apache License, Version 2.0. \n"
    passage = " ".join(sentence() for _ in range(9))
    for i in (31, 33, 35):
        words = texts[i].split(" ")
        texts[i] = " ".join([*words[:3], passage, *words[3:]])
    texts[40] = "$$$ ".join(word() for _ in range(90))
    texts[41] = ("AN!! NT!! THE!! " * 40).strip()
    texts[42] = "Mail a.b@mail.example.com. from 10.0.0.300 and 10.20.30.40, card 4111 1111 1111 1111, call +1 (743) 555-3824 or token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" é\U0001f600 x@y z@z.q"
    texts[43], texts[44], texts[45], texts[46] = "", None, " \n\t\n ", "one"
    texts[47] = "\n".join(sentence() for _ in range(3000))
    texts[48] = "Line that recurs in one text only.\n" * 5
    texts[49] = "two words"
    rows = [(i, t, "en", ["hot", "hot", "hot", "b", "c", None][i % 6], None if t is None else len(t), "x", None, "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[48], (None, texts[3], None, None, None, None, None, None, None, None), (None, None, None, "b", 0, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
