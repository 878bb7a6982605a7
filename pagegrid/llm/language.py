"""Language identification by error-correcting output codes.

Each language has a codeword; each bit is predicted by a logistic classifier over hashed
n-grams of the whole text, and the codeword with the least weighted loss wins. Where the two
best codewords are close, the answer is flagged as ambiguous.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not
ambiguous; so is every text when there is no labelled row. A null doc_id is not held out.
Repeated rows get equal answers. An empty table gives no rows. Labels come from ``text`` and
``lang`` alone; other columns are never looked at.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows per language that the classifiers are fitted on, as expected by their hash.
SAMPLE = 400
#: Hashed n-gram counts of a text; lengths of the n-grams in UTF-8 bytes.
WIDTH = 1 << 12
LENGTHS = (2, 3, 4)
BLOCK = 1 << 20
#: Above so many languages the codewords are random instead of all possible splits.
EXHAUSTIVE = 6
#: Least share of the best codeword against the second best.
MARGIN = 0.55
UNDETERMINED = "und"
#: Letters, and numbers such as fractions, which ``has_letter`` tells from them.
LETTER = re.compile(r"[^\W\d_]")
#: Letters and bytes of other alphabets stay, all else is one kind of gap.
KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in LETTER.finditer(text))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(name), F.lit(parts)) == part


def ngram_counts(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts."""
    raw = text.lower().encode("utf-8", "replace")
    counts = np.zeros(WIDTH, np.int64)
    longest = max(LENGTHS)
    for at in range(0, len(raw), BLOCK):
        letters = KEPT[np.frombuffer(raw[at : at + BLOCK + longest - 1], np.uint8)]
        code = letters
        for length in range(2, longest + 1):
            code = code[:-1] * np.uint32(257) + letters[length - 1 :]
            if length in LENGTHS and len(code):
                own = code[:BLOCK] * np.uint32(2654435761) + np.uint32(length)
                counts += np.bincount(own >> np.uint32(20), minlength=WIDTH)
    root = np.sqrt(counts, dtype=np.float64)
    size = math.sqrt(counts.sum())
    return root / size if size else root


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language: all splits of few languages, random ones of many."""
    if languages <= EXHAUSTIVE:
        splits = itertools.product((1, -1), repeat=max(0, languages - 1))
        return np.array([[1, *s] for s in splits if -1 in s], float).reshape(-1, languages).T
    bits = math.ceil(10 * math.log2(languages))
    drawn = [
        np.random.default_rng(seed).choice((-1.0, 1.0), (languages, bits)) for seed in range(64)
    ]
    return max(drawn, key=lambda c: (c[:, None] != c[None]).sum(2)[np.triu_indices(languages, 1)].min())


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    #: How far each bit is trusted: what it got right of the sample, above chance.
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, share of the best codeword, and whether the second best is close."""
        if not self.languages or text is None or not has_letter(text):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = ngram_counts(text) @ self.weights + self.bias
        losses = (np.logaddexp(0, -self.codes * margins) * self.trust).sum(1) / self.trust.sum()
        share = np.exp(-(losses - losses.min()) * len(margins) ** 0.5)
        share /= share.sum()
        best, second = np.argsort(-share, kind="stable")[:2]
        close = share[best] < MARGIN * (share[best] + share[second])
        return self.languages[best], float(share[best]), bool(close)


def _fit_bits(x: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every bit by gradient steps with momentum; rows weigh by class."""
    weights, bias = np.zeros((x.shape[1], targets.shape[1])), np.zeros(targets.shape[1])
    share = 1 / (2 * np.stack([(targets < 0).mean(0), (targets > 0).mean(0)]).clip(1e-9))
    scale = np.where(targets > 0, share[1], share[0]) / len(x)
    speed = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(300):
        margin = np.clip(targets * (x @ weights + bias), -50, 50)
        pull = -targets * scale / (1 + np.exp(margin))
        speed = 0.9 * speed[0] - 4 * (x.T @ pull + 1e-5 * weights), 0.9 * speed[1] - 4 * pull.sum(0)
        weights, bias = weights + speed[0], bias + speed[1]
    return weights, bias


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [ngram_counts(x).astype(np.float32).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "features"]
        )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled texts per language, picked by a hash of the text.

    ``labelled`` has text and lang. Counts per language cover the distinct texts of all rows,
    copies count once; a language's picked share is ``sample`` over its count, so what the
    driver gets is bounded by languages times sample times the size of a feature vector,
    whatever the table's size.
    """
    usable = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    steps = 1 << 30
    drawn = F.xxhash64("text", F.lit(17))
    texts = usable.select("lang", drawn.alias("drawn")).distinct()
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], *[np.zeros((0, 0))] * 4)
    codes = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, *[codes] * 4)
    limit = F.create_map(
        *[F.lit(v) for k in languages for v in (k, min(steps, math.ceil(steps * sample / counts[k])))]
    )
    picked = usable.where(F.pmod(drawn, F.lit(steps)) < limit[F.col("lang")])
    # Equal texts share a hash: one of each is enough, and bounds what a hot text can add.
    picked = picked.dropDuplicates(["lang", "text"])
    rows = picked.mapInArrow(_features, "lang string, features binary").toArrow()
    place = {k: i for i, k in enumerate(languages)}
    wanted = np.array([place[k] for k in rows["lang"].to_pylist()], int)
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float32).reshape(-1, WIDTH)
    order = np.lexsort((x[:, 0], x.sum(1), wanted))
    x, wanted = x[order].astype(float), wanted[order]
    targets = codes[wanted]
    weights, bias = _fit_bits(x, targets)
    right = (np.sign(x @ weights + bias) == targets).mean(0)
    return Model(languages, codes, weights, bias, (2 * right - 1).clip(0.01))


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predict(x) for x in batch.column("text").to_pylist()]
            names, scores, close = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in batch.schema.names if k != "text"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(close, pa.bool_()),
                ],
                names=[*(k for k in batch.schema.names if k != "text"), "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_predictor(shared), schema)


def predict_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows that are not held out, then answer for every row."""
    return identify(docs, train(docs.where(~held_out(F.col("doc_id"), 3, 1)), sample))


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or ambiguous."""
    model = train(docs.where(~held_out(F.col("doc_id"), 3, 1)), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [shared.value.predict(x) for x in texts]
            yield batch.filter(pa.array([k != UNDETERMINED and not c for k, _, c in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
