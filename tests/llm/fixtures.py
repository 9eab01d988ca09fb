"""Small tables with the cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, _n int, size string, ids string"


def documents(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with those of results."""
    full = [(i, t, "en", s, None if t is None else len(t), 7, "x", 3, "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows(seed=1):
    """Null and empty texts, repeated rows, null ids and sources, a very long text, ties, odd spaces and characters."""
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "dél", "nu", "the", "of", "İx", "Σας", "<|endoftext|>", "a\u0301"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, text(r.randint(0, 60)), r.choice(["a", "b", "c", None])) for k in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, " \t\n", None), (None, text(5), "a"), (None, None, None)]
    rows += [rows[3], rows[3], (103, rows[4][1], "c"), (104, text(30_000), "a"), (105, "one\x0btwo\x0cthree\u00a0four", "b"), (106, "x" * 5000, "b")]
    return rows


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2.0, "q") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, score double, node string")
