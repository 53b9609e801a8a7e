"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

WORDS = "the of and rain under bright wanderer größe été niño 日本 a,b don't 42".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) + str(rng.randrange(50)) for _ in range(n))


def documents(seed=0, n=40):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randrange(1, 120))) for i in range(n)]
    passage = text(rng, 70)
    rows += [(n, rows[3][1]), (n + 1, text(rng, 10) + " " + passage + " " + text(rng, 10)), (n + 2, passage), (n + 3, rows[5][1] + " tail"), (n + 4, None), (n + 5, ""), (n + 6, " \n\t "), (n + 7, "x"), (n + 8, "ab " * 3000), (n + 9, "y" * 5000), (n + 10, passage + " " + passage), (n + 11, "😀 \x00 ▁ end")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    """With extra columns named like operators' own ones."""
    data = [(i, t, "src", i, 7, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, n_tokens int, kept string").repartition(parts)
