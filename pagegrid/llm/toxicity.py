"""Toxicity scores from a lexicon that also catches misspellings, and from context.

The lexicon is learnt: words far more frequent in toxic than in other labelled texts, by
their share of texts, and by more than chance makes likely. Texts that use a word between the
same two neighbours, as copies do, count as one. Levenshtein automata walk a trie of it to find misspelled terms; words
that other texts use are never taken for misspellings. Around every hit, a window says
whether the term is quoted or reported rather than used. A logistic model on sums over the
hits gives the score.

Defined cases: null and empty texts score as texts without hits. Without labelled rows, or
with labels of one class only, every score is the share of toxic labels (0 without labels).
A null doc_id counts as the empty string, which is held out. Repeated rows get equal scores.
An empty table gives no rows. Scores look at the text alone; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import checkpoint, text_of
from pagegrid.llm.language import held_out
from pagegrid.llm.lexicon import STRIPPED, Lexicon

#: Labelled documents per class that the lexicon and the model are fitted on, as expected by
#: their hash, and most terms of the lexicon.
SAMPLE = 2500
TERMS = 5000
#: Least toxic texts with a term, least ratio of its shares of toxic and other texts, and least
#: likelihood ratio (G, chi-squared with one degree of freedom) against equal shares: 1 in 1000.
SUPPORT, RATIO, LIKELIHOOD = 3, 8.0, 10.83
#: Tokens looked at on either side of a hit.
WINDOW = 6
QUOTES = "\"'“”„«»‘’"
REPORTING = frozenset("said says called calls wrote writes quoted quote word term slur".split())
CACHED = 300_000
FEATURES = 6


class Hits(dict):
    """What the lexicon says of a token; forgets all when full."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        found = self.lexicon.look_up(token)
        if len(self) >= CACHED:
            self.clear()
        if len(token) <= 48:
            self[token] = found
        return found


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    #: The score of every text where there is nothing to fit.
    constant: float = 0.0

    @functools.cached_property
    def hits(self) -> Hits:
        return Hits(Lexicon(self.terms, self.ordinary))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "hits"}

    def features(self, text: str) -> list[float]:
        """Sums over the hits: used and quoted terms by weight, misspelled ones, density."""
        tokens = text.lower().split()
        hits = self.hits
        found = [(k, f) for k, f in enumerate(map(hits.__getitem__, tokens)) if f]
        used = quoted = misspelled = 0.0
        distinct = set()
        for k, (term, edits) in found:
            weight = self.terms[term]
            if is_quoted(tokens, k):
                quoted += weight
                continue
            distinct.add(term)
            if edits:
                misspelled += weight / (1 + edits)
            else:
                used += weight
        density = (used + misspelled) / math.sqrt(len(tokens) + 1)
        return [
            math.log1p(used),
            math.log1p(misspelled),
            math.log1p(quoted),
            math.log1p(len(distinct)),
            density,
            float(bool(distinct)),
        ]

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.constant
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ self.weights) + self.bias)))))


def is_quoted(tokens: list[str], k: int) -> bool:
    """Is the token inside quotation marks that open and close near it, or reported?"""
    own = tokens[k]
    if len(own) > 2 and own[0] in QUOTES and own.rstrip(".,;:!?")[-1:] in QUOTES:
        return True
    before, after = tokens[max(0, k - WINDOW) : k + 1], tokens[k : k + WINDOW + 1]
    opened = closed = False
    for token in before:
        if token[0] in QUOTES:
            opened = True
        if token is not own and token.rstrip(".,;:!?")[-1:] in QUOTES:
            opened = False
    for token in after:
        if token.rstrip(".,;:!?")[-1:] in QUOTES:
            closed = True
            break
        if token is not own and token[0] in QUOTES:
            break
    return (opened and closed) or any(t.strip(".,;:") in REPORTING for t in before[-3:-1])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with both classes of equal weight, by Newton steps."""
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(len(w)) * len(x) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (share * (p - y)) + ridge @ w
        bend = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w = w - np.linalg.solve(bend, pull)
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame | None, float]:
    """Text and label of about ``sample`` training documents per class; share of toxic ones."""
    usable = labels.select(
        F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")
    ).where("toxic in (0, 1) and _id is not null")
    usable = usable.where(~held_out(F.col("_id"), 5, 0)).dropDuplicates(["_id"])
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return None, share
    steps = 1 << 30
    limits = {k: min(steps, math.ceil(steps * sample / n)) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(steps))
    limit = F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0])
    picked = F.broadcast(usable.where(draw < limit))  # about twice ``sample`` ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_of(docs).alias("text"))
    return texts.join(picked, "_id").select("text", "toxic"), share


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a text once, with the tokens beside its first place in it."""
    for batch in batches:
        for text, toxic in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            tokens = text.lower().split()
            beside: dict[str, str] = {}
            for k, token in enumerate(tokens):
                if (word := token.strip(STRIPPED)) and word not in beside:
                    beside[word] = " ".join(tokens[max(0, k - 1) : k] + [""] + tokens[k + 1 : k + 2])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(beside), pa.string()),
                    pa.array(list(beside.values()), pa.string()),
                    pa.array([toxic] * len(beside), pa.int32()),
                ],
                names=["word", "beside", "toxic"],
            )


def _likelihood(bad: Column, good: Column, share: float) -> Column:
    """G of the toxic and other texts with a word against the share of toxic ones in all texts."""
    both = bad + good
    part = F.when(bad > 0, bad * F.log(bad / (both * share))).otherwise(0.0)
    return 2 * (part + F.when(good > 0, good * F.log(good / (both * (1 - share)))).otherwise(0.0))


def _measured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = [own.features(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and model from labelled documents whose id's remainder is not held out.

    The driver gets at most ``TERMS`` terms, the sample's words that other texts use and that
    lie near a term, and ``FEATURES`` numbers per sampled document.
    """
    picked, share = _sample(docs, labels, sample)
    if picked is None:
        return Model(constant=share)
    # One half teaches the words, the other half how far to trust what they find in new texts.
    teach = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    taught, measured = picked.where(teach), picked.where(~teach)
    totals = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(constant=share)
    words = taught.mapInArrow(_words, "word string, beside string, toxic int")
    counts = (
        words.groupBy("word", F.xxhash64("beside").alias("beside"))
        .agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"))
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    counts = checkpoint(counts)
    ratio = ((F.col("bad") + 0.5) / (totals[1] + 1)) / ((F.col("good") + 0.5) / (totals[0] + 1))
    terms = (
        counts.where(F.col("bad") >= SUPPORT)
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= RATIO)
        .where(_likelihood(F.col("bad"), F.col("good"), totals[1] / sum(totals.values())) >= LIKELIHOOD)
        .orderBy(F.desc("ratio"), "word")
        .limit(TERMS)
        .collect()
    )
    lexicon = {r["word"]: math.log(r["ratio"]) for r in terms}
    if not lexicon:
        return Model(constant=share)
    spark = docs.sparkSession
    near = spark.sparkContext.broadcast(Model(terms=lexicon))

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = near.value.hits.lexicon
            yield batch.filter(
                pa.array([bool(known.nearest(w)) for w in batch.column("word").to_pylist()], pa.bool_())
            )

    used = counts.where("good > 0").select("word").mapInArrow(misread, "word string").collect()
    model = Model(terms=lexicon, ordinary=frozenset(r["word"] for r in used) - lexicon.keys())
    shared = spark.sparkContext.broadcast(model)
    rows = measured.mapInArrow(_measured(shared), "x array<double>, toxic int").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, FEATURES)
    y = rows["toxic"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(constant=share)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights, model.bias = _fit((x - model.mean) / model.scale, y)
    return model


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scores = [own.score(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        text_of(docs).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_scorer(shared), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train, then score every row of ``docs``."""
    return score(docs, train(docs, labels, sample))
