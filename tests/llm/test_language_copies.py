"""The language sample of a table with very large groups of copies."""

import numpy as np
from pyspark.sql import functions as F

from pagegrid.llm import language


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    words = {"en": "the of and that with this", "de": "der die und nicht auch mit", "fr": "le la et dans pour avec"}
    rng = np.random.default_rng(12)
    texts = [(" ".join(rng.choice(w.split(), 30)), g) for g, w in words.items() for _ in range(100)]
    table = spark.createDataFrame(texts, "text string, lang string")
    # Languages of 100 texts each: of few copies, of many, and of many of one text.
    copies = F.when(F.col("lang") == "de", 400).when(F.col("text") == texts[-1][0], 40_000).otherwise(1)
    table = table.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")
    sizes = []
    fit = language._fit_bits

    def seen(x, targets):
        sizes.extend(np.unique(targets, axis=0, return_counts=True)[1].tolist())
        return fit(x, targets)

    monkeypatch.setattr(language, "_fit_bits", seen)
    model = language.train(table, sample=40)
    assert len(sizes) == 3 and all(20 <= n <= 60 for n in sizes)
    assert np.mean([model.predict(t)[0] == g for t, g in texts]) > 0.97
