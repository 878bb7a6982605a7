"""Edit distances of long texts against the whole matrix."""

import random

from pyspark.sql import functions as F

from pagegrid.functions import metrics


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damaged(rng, items, edits, alphabet):
    items = list(items)
    for _ in range(edits):
        k = rng.randrange(len(items) + 1)
        kind = rng.randrange(3)
        if kind:
            items[k : k + kind - 1] = [rng.choice(alphabet)]
        else:
            items[k : k + 1] = []
    return items


def test_distances_of_long_texts(spark):
    rng = random.Random(5)
    rows = [("a" * 300, "a" * 299, 1), ("é" * 300, "", 300), ("x" * 300, "x" * 300, 0)]
    rows.append(("ab" * 200, "ba" * 200, distance("ab" * 200, "ba" * 200)))
    for edits in (1, 5, 70, 200, 700):
        a = "".join(rng.choices("abcé😀", k=900))
        b = "".join(damaged(rng, a, edits, "abcé😀"))
        rows.append((a, b, distance(a, b)))
    got = spark.createDataFrame(rows, "a string, b string, want int").select(
        "want", metrics.edit_distance(F.col("a"), F.col("b")).alias("got")
    )
    assert all(r.want == r.got for r in got.collect())


def test_word_distances_beyond_a_byte_of_words(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(700)]
    rows = [("a b", "c d", 2, 2), ("", "c d", 2, 0), ("a a b", "b a a", 2, 3)]
    for edits in (0, 3, 100, 600):
        a = rng.choices(words, k=600)
        b = damaged(rng, a, edits, words)
        rows.append((" ".join(a), " ".join(b), distance(a, b), len(a)))
    frame = spark.createDataFrame(rows, "a string, b string, want int, n int")
    got = frame.select("want", "n", metrics.wer(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(abs(r.got - (r.want / r.n if r.n else 1.0)) < 1e-12 for r in got)
