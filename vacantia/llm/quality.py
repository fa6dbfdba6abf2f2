"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import fresh

BITS = 22
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_CACHE_LIMIT = 300_000
#: A sample of at most so many rows is fitted by the driver itself.
FEW_ROWS = 100


def _capitals(text: str) -> int:
    """Upper-case letters of the whole text."""
    if text.isascii():
        letters = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
        return int(((letters >= 65) & (letters <= 90)).sum())
    return sum(map(str.isupper, text))


def _bucket(token: str, bits: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


class Featurizer:
    """Text → sorted distinct hash buckets: words, runs of symbols, and a few shape marks.

    Every word of the text counts, once, and so do its beginnings of four to seven letters, which
    stand for all forms of a stem. Shape marks are coarse shares (capitals, symbols, repeated
    neighbours, repeated words), so that junk without telling words has features too.
    """

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.known: dict[str, tuple[int, ...]] = {}

    def _buckets(self, token: str) -> tuple[int, ...]:
        starts = [f"p:{token[:k]}" for k in range(4, min(len(token), 8))] if token[0].isalpha() else []
        return tuple(_bucket(x, self.bits) for x in ("w:" + token, *starts))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        tokens = _TOKEN.findall(text.lower())
        distinct = set(tokens)
        known, buckets = self.known, []
        if len(known) > _CACHE_LIMIT:
            known.clear()
        for token in distinct:
            at = known.get(token)
            if at is None:
                at = known[token] = self._buckets(token)
            buckets += at
        n, chars = len(tokens), len(text)
        upper = 10 * _capitals(text) // max(1, chars)
        symbols = 10 * sum(len(t) for t in tokens if not t[0].isalpha()) // max(1, chars)
        spread = 10 * len(distinct) // max(1, n)
        repeated = 10 * sum(map(str.__eq__, tokens, tokens[1:])) // max(1, n)
        marks = (f"#upper:{upper}", f"#symbols:{symbols}", f"#repeated:{repeated}",
                 f"#spread:{spread}:{min(n, 4096).bit_length()}", f"#words:{n.bit_length()}", "#bias")
        # Eight buckets a mark: a handful of marks has to weigh as much as many words.
        for mark in marks:
            at = known.get(mark)
            if at is None:
                at = known[mark] = tuple(_bucket(f"{i}{mark}", self.bits) for i in range(8))
            buckets += at
        return np.unique(np.array(buckets, dtype=np.int32))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(w.x - cut[k-1]) with ascending cuts."""

    weights: np.ndarray
    cuts: np.ndarray
    bits: int = BITS

    def latent(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum() / len(buckets) ** 0.25)

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """Column k-1 holds P(grade >= k)."""
        return 1.0 / (1.0 + np.exp(-np.clip(latent[:, None] - self.cuts[None, :], -40, 40)))


def fit_arrays(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, epochs: int = 8,
    rate: float = 0.3, l2: float = 1e-5, min_rows: int = 3, seed: int = 7,
) -> OrdinalModel:
    """Stochastic gradient fit (per-weight step sizes) of one weight vector and ordered cuts.

    Buckets seen in fewer than ``min_rows`` rows keep weight 0. Cuts are a start and positive
    gaps, so they stay ordered.
    """
    rng = np.random.default_rng(seed)
    weights = np.zeros(1 << bits, dtype=np.float32)
    if not rows or n_grades < 2:
        return OrdinalModel(weights, np.zeros(max(1, n_grades - 1)), bits)
    # Row by row: a row names a bucket once, and one array of all rows would be held three times over.
    seen = np.zeros(1 << bits, dtype=np.int32)
    for r in rows:
        seen[r] += 1
    often = seen >= min_rows
    kept = [r[often[r]] for r in rows]
    scale = np.array([len(r) for r in rows], dtype=np.float64) ** -0.25
    squares = np.full(1 << bits, 1e-6, dtype=np.float32)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(0.01, 0.99)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    gaps = np.log(np.diff(cuts, prepend=cuts[0] - 1.0).clip(1e-3))
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for batch in np.array_split(rng.permutation(len(kept)), max(1, len(kept) // 32)):
            sizes = np.array([len(kept[i]) for i in batch])
            flat = np.concatenate([kept[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            latent = np.bincount(owner, weights[flat], len(batch)) * scale[batch]
            g = grades[batch]
            above = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = above[g + 1] - latent, above[g] - latent
            s_up, s_low = 1 / (1 + np.exp(-upper.clip(-30, 30))), 1 / (1 + np.exp(-lower.clip(-30, 30)))
            s_up[np.isinf(upper)], s_low[np.isinf(lower)] = 1.0, 0.0
            mass = (s_up - s_low).clip(1e-9)
            d_up, d_low = s_up * (1 - s_up) / mass, s_low * (1 - s_low) / mass
            slope = (d_up - d_low) * scale[batch]  # of the loss, by the latent score
            touched, at = np.unique(flat, return_inverse=True)
            grad = np.bincount(at, slope[owner], len(touched)) / len(batch) + l2 * weights[touched]
            squares[touched] += grad ** 2
            weights[touched] -= step * grad / np.sqrt(squares[touched])
            by_cut = np.zeros(n_grades - 1)
            for k in range(n_grades - 1):
                by_cut[k] = (-d_up[g == k].sum() + d_low[g == k + 1].sum()) / len(batch)
            by_gap = np.cumsum(by_cut[::-1])[::-1] * np.exp(gaps)
            by_gap[0] = by_cut.sum()
            gaps[1:] -= 0.3 * step * by_gap[1:]
            cuts = cuts[0] - 0.3 * step * by_gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])
    return OrdinalModel(weights, cuts, bits)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from two marks: 0 toxic, 1 of low quality, 2 good. Unmarked rows fall out."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
        .when(F.col("quality") == 1, 2).alias("grade"),
    ).filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())


def fit(
    documents: DataFrame, ratings: DataFrame, n_grades: int = 3, sample_rows: int = 12_000,
    bits: int = BITS,
) -> OrdinalModel:
    """Fit on rated documents: all of them, or the ``sample_rows`` first by key hash if there are more.

    The sample's ids are few and bounded, so they are broadcast. Its hashed features, not its
    texts, go to one task, which fits the model on them; the driver gets the weights that are not 0
    and the cuts alone. A sample of at most ``FEW_ROWS`` rows is fitted by the driver, to the same
    model. One row per id: of several documents with one id the one with the least features in byte
    order counts. A document rated twice counts once, with its lowest grade. With no rated rows all
    weights are 0.
    """
    sample = (
        ratings.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rated = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Featurizer(bits)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "grade": batch["grade"],
                "buckets": [features(t).tobytes() for t in batch["text"]],
            })

    features = rated.mapInPandas(hashed, "doc_id long, grade int, buckets binary")
    one = features.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("buckets").alias("buckets"))

    def fit_rows(batches: Iterable[pd.DataFrame]) -> OrdinalModel:
        got = sorted(
            ((d, g, np.frombuffer(b, dtype=np.int32)) for batch in batches
             for d, g, b in zip(batch["doc_id"], batch["grade"], batch["buckets"])),
            key=lambda r: r[0],
        )
        return fit_arrays([r[2] for r in got], np.array([r[1] for r in got], dtype=np.int64), n_grades, bits)

    if sample_rows <= FEW_ROWS:
        return fit_rows([one.toPandas()])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fit_rows(batches)
        at = np.flatnonzero(model.weights).astype(np.int32)
        yield pd.DataFrame({
            "at": [at.tobytes()], "weights": [model.weights[at].tobytes()], "cuts": [model.cuts.tobytes()]})

    found = one.repartition(1).mapInPandas(fitted, "at binary, weights binary, cuts binary").collect()
    weights, cuts = np.zeros(1 << bits, dtype=np.float32), np.zeros(max(1, n_grades - 1))
    for r in found:  # one row, or none where nothing is rated
        weights[np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["weights"], dtype=np.float32)
        cuts = np.frombuffer(r["cuts"], dtype=np.float64)
    return OrdinalModel(weights, cuts, bits)


def score(documents: DataFrame, model: OrdinalModel, good: int = 2) -> DataFrame:
    """Adds expected grade and tail probabilities to every document; the whole text is read.

    ``expected_grade`` is the sum of the tails, ``p_good`` is P(grade >= ``good``). A NULL text
    counts as empty. No row is lost or added; equal texts get equal scores. Only texts go through
    Python, so ids and other columns stay as they are; columns named like the three scores are replaced.
    """
    # Plain arrays: a broadcast is pickled by reference to its class.
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.cuts, model.bits))

    @F.pandas_udf("expected_grade double, p_good double, p_clean double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = OrdinalModel(*shared.value)
        features = Featurizer(held.bits)
        for texts in batches:
            latent = np.array([held.latent(features(t)) for t in texts], dtype=np.float64)
            tails = held.tails(latent)
            yield pd.DataFrame({
                "expected_grade": tails.sum(axis=1), "p_good": tails[:, good - 1], "p_clean": tails[:, 0]})

    inputs = documents.drop("expected_grade", "p_good", "p_clean")
    (found,) = fresh(inputs.columns, "scored")
    return inputs.withColumn(found, scored("text")).select(
        *[F.col(f"`{c}`") for c in inputs.columns], f"{found}.*")


def accepted(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose tail probability reaches the threshold."""
    return scored.filter(F.col("p_good") >= least)
