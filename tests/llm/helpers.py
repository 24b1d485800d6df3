"""Small frames and brute-force versions shared by the tests of churnlens.llm."""

import random

import public_tokenizers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs(spark, rows, extra=False):
    """(doc_id, text) rows, with columns whose names the operators use themselves if ``extra``."""
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("ids", "n", "start", "key", "rep", "phrase", "row", "lang_pred", "score", "base", "spans", "n_words", "first", "component", "posterior"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return [rng.choice(vocabulary) for _ in range(n)]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))
