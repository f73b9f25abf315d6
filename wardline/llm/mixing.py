"""Document rates that bring the expected tokens of each domain to target weights."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import held_out, lowest_hashes, pieces, written
from wardline.llm.hashing import words_of

# Labelled texts in the sample, each whole.
SAMPLE_TEXTS = 4000
BUCKETS = 1 << 16
PASSAGE = 16
HELD_BYTES = 4 << 20
# Steps at most, and the share of the total under which the projected gradient ends the fit.
ROUNDS, TOLERANCE = 150, 1e-6
# Dampings of the steps tried in one pass, as shares of all tokens, and their lengths.  Under
# the largest one a step is a plain projected gradient step, which never leads up.
DAMPINGS, LENGTHS = 10.0 ** np.arange(-10, 1), (1.0, 0.3)
STRENGTHS = (1.0, 2.0, 4.0, 8.0, 16.0)
# What a mixture of the given documents should hold of each domain, and a document's copies at most.
MIXTURE = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
HIGHEST = 20.0


@dataclass(frozen=True)
class Model:
    """Log-probabilities of word buckets by domain, the domains' shares, and a strength.

    Each passage of PASSAGE words is judged by its mean word, taken ``strength`` times;
    a text belongs to each domain as far as its passages do.
    """

    domains: tuple[str, ...]
    table: np.ndarray
    prior: np.ndarray
    strength: float

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and how far it belongs to each domain."""
        words = words_of(texts, lower=True)
        n, size, owners = len(words.counts), len(self.domains), words.owners()
        passages = -(-words.counts // PASSAGE)
        first = np.cumsum(passages) - passages
        place = np.arange(len(owners)) - (words.ends - words.counts)[owners]
        of = first[owners] + place // PASSAGE
        buckets, total = (words.hashes >> np.uint64(48)).astype(np.int64), int(passages.sum())
        long = np.bincount(of, minlength=total)
        z = np.stack([np.bincount(of, weights=self.table[buckets, d], minlength=total) for d in range(size)], axis=1)
        z = np.log(self.prior) + z / np.maximum(1, long)[:, None] * np.minimum(long, self.strength)[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True)) if total else z
        z = z / z.sum(axis=1, keepdims=True)
        text = np.repeat(np.arange(n), passages)
        p = np.stack([np.bincount(text, weights=z[:, d] * long, minlength=n) for d in range(size)], axis=1)
        p = p / np.maximum(1, words.counts)[:, None]
        p[words.counts == 0] = self.prior
        return words.counts, p


def _counted(size: int):
    """Words of the texts' buckets by part (0 learns the trial, 1 tests it) and domain."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, size, BUCKETS), dtype=np.int64)
        for batch in pieces(batches, "text", HELD_BYTES):
            words = words_of(batch.column(0), lower=True)
            part, label = (batch.column(k).to_numpy().astype(np.int64)[words.owners()] for k in (1, 2))
            np.add.at(table, (part, label, (words.hashes >> np.uint64(48)).astype(np.int64)), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table.reshape(-1)[at])], ["at", "n"])

    return count


def _losses(domains: tuple[str, ...], table: np.ndarray, prior: np.ndarray):
    """For each strength, the loss of the tested texts' own domains."""

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(STRENGTHS))
        for batch in pieces(batches, "text", HELD_BYTES):
            label = batch.column(2).to_numpy().astype(np.int64)
            for k, strength in enumerate(STRENGTHS):
                _, p = Model(domains, table, prior, strength).posteriors(batch.column(0))
                total[k] -= np.log(np.maximum(p[np.arange(len(p)), label], 1e-9)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "loss"])

    return loss


def _table(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-frequencies of the buckets; words that no domain favours stay out of the evidence."""
    smooth = counts.T + 0.05
    table = np.log(smooth / smooth.sum(axis=0))
    return table - table.mean(axis=1, keepdims=True)


def train(labelled: DataFrame, domains: tuple[str, ...], text_col: str = "text", domain_col: str = "domain") -> Model:
    """Word frequencies of each domain, and the strength that predicts best what they were not counted on.

    The sample is a bounded number of different labelled texts, picked by their hash,
    each whole: Spark counts their words, and only sums by bucket reach the driver.  Rows
    without a text or with a domain that is not asked for teach nothing.  The shares are
    those of the sample; without rows all domains are alike.
    """
    size = len(domains)
    rows = labelled.filter(F.col(domain_col).isin(*domains) & F.col(text_col).isNotNull())
    picked = rows.filter(lowest_hashes(rows, F.col(text_col), SAMPLE_TEXTS)).select(F.col(text_col).alias("text"), F.col(domain_col).alias("domain")).distinct()
    part = (F.pmod(F.xxhash64("text", "domain", F.lit("part")), F.lit(4)) == 3).cast("int")
    label = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    sample = written(picked.select("text", part.alias("part"), label.cast("int").alias("label")), "domain-sample")
    seen = np.zeros((2, size))
    for row in sample.groupBy("part", "label").count().collect():
        seen[row["part"], row["label"]] = row["count"]
    prior = (seen.sum(axis=0) + 1.0) / (seen.sum() + size)
    if not seen.sum():
        return Model(domains, np.zeros((BUCKETS, size), np.float32), prior, 4.0)
    counts = np.zeros(2 * size * BUCKETS)
    sums = sample.mapInArrow(_counted(size), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["at"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(2, size, BUCKETS)
    best = 4.0
    if seen[0].any() and seen[1].any():
        losses = sample.filter("part = 1").mapInArrow(_losses(domains, _table(counts[0]), prior), "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss"))
        best = STRENGTHS[min((r["loss"], r["k"]) for r in losses.collect())[1]]
    return Model(domains, _table(counts.sum(axis=0)).astype(np.float32), prior, best)


def language_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The domains of MIXTURE as the language of labelled documents outside the held-out fold says them."""
    labelled = labels.select("doc_id").filter(~held_out(F.col("doc_id")))
    # A bounded number of ids, found by their hash.
    picked = labelled.filter(lowest_hashes(labelled, F.col("doc_id"), SAMPLE_TEXTS)).distinct()
    return train(docs.join(F.broadcast(picked), "doc_id", "left_semi"), tuple(sorted(MIXTURE)), domain_col="lang")


def as_lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.reshape(-1)))


def _posteriors(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HELD_BYTES):
            counts, p = model.posteriors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), as_lists(p)], ["id", "tokens", "posterior"])

    return predict


def rates(p: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], lowest: float, highest: float = np.inf) -> np.ndarray:
    """Rates after the given steps from 1.

    A step is the gradient by domain and what it makes of it: rates at a bound which the
    gradient pushes against stay, the others go against the step and back into the bounds.
    """
    now = np.full(len(p), min(max(1.0, lowest), highest))
    for gradient, step in steps:
        now = _moved(p, now, (gradient, step), lowest, highest)
    return now


def _held(slope: np.ndarray, now: np.ndarray, lowest: float, highest: float) -> np.ndarray:
    return ((now <= lowest) & (slope > 0)) | ((now >= highest) & (slope < 0))


def _lists(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(table: DataFrame, sums, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass: sums and maxima of what each task sends, ``size`` numbers."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(size), np.zeros(size)
        for batch in batches:
            t = batch.column(0).to_numpy().astype(float)
            if (t > 0).any():
                found = sums(t[t > 0], _lists(batch.column(1))[t > 0])
                total, most = total + found, np.maximum(most, found)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total), pa.array(most)], ["k", "total", "most"])

    found = table.select("tokens", "posterior").mapInArrow(send, "k int, total double, most double")
    total, most = np.zeros(size), np.zeros(size)
    for row in found.groupBy("k").agg(F.sum("total").alias("total"), F.max("most").alias("most")).collect():
        total[row["k"]], most[row["k"]] = row["total"], row["most"]
    return total, most


def _trials(table: DataFrame, steps, trials: list[tuple[np.ndarray, np.ndarray]], lowest: float, highest: float, size: int) -> np.ndarray:
    """Expected tokens by domain after each trial of a next step."""

    def totals(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        now = rates(p, steps, lowest, highest)
        return np.concatenate([(_moved(p, now, trial, lowest, highest) * t) @ p for trial in trials])

    return _summed(table, totals, len(trials) * size)[0].reshape(len(trials), size)


def _moved(p: np.ndarray, now: np.ndarray, step: tuple[np.ndarray, np.ndarray], lowest: float, highest: float) -> np.ndarray:
    return np.where(_held(p @ step[0], now, lowest, highest), now, np.clip(now - p @ step[1], lowest, highest))


def _free(table: DataFrame, steps, gradient: np.ndarray, lowest: float, highest: float) -> tuple[np.ndarray, float]:
    """Second moments of the rows that the gradient may move, and the largest projected gradient."""
    size = len(gradient)

    def moments(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        now, slope = rates(p, steps, lowest, highest), p @ gradient
        free = ~_held(slope, now, lowest, highest)
        return np.append(((p * (t * free)[:, None]).T @ p).reshape(-1), np.abs(slope[free]).max(initial=0.0))

    total, most = _summed(table, moments, size * size + 1)
    return total[:-1].reshape(size, size), float(most[-1])


def _final(steps, lowest: float, highest: float, model: Model | None = None):
    """Rates of rows with posteriors, or of texts, which then go with the other columns."""

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if model is None else pieces(batches, "text", HELD_BYTES):
            if not batch.num_rows:
                continue
            columns = {name: batch.column(name) for name in batch.schema.names}
            if model is not None:
                counts, p = model.posteriors(columns.pop("text"))
                columns |= {"tokens": pa.array(counts.astype(np.int64)), "posterior": as_lists(p)}
            now = rates(_lists(columns["posterior"]), steps, lowest, highest)
            # No rate of a text without tokens changes a total.
            now = np.where(columns["tokens"].to_numpy() > 0, now, min(max(1.0, lowest), highest))
            yield pa.RecordBatch.from_pydict(columns | {"rate": pa.array(now)})

    return final


def fit_rates(table: DataFrame, weights: np.ndarray, total: float | None, lowest: float, highest: float = np.inf) -> list[tuple[np.ndarray, np.ndarray]]:
    """Projected-gradient steps to the least squares over all documents.

    Minimises the squared distance of the expected domain totals from ``weights *
    total`` over rates between ``lowest`` and ``highest``, in the metric of tokens, so that
    a document's rate does not hang on its length.  The gradient of a rate is the posterior
    times the domains' errors.  Each step takes it under the inverse second moments of
    the rows that are free to move, damped: one pass finds the moments, a second one tries
    the dampings and lengths, and the one that leaves least is taken, so the distance only
    falls.  Nothing of a document is kept between passes.

    The end is the projected gradient under TOLERANCE of the total.  If ROUNDS steps or
    the doubles' precision end the fit before, the steps found so far are returned, the
    nearest rates met, with a warning that states the gradient left.
    """
    size = len(weights)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    none = (np.zeros(size), np.zeros(size))
    now = _trials(table, steps, [none], lowest, highest, size)[0]
    # Each row's posterior sums to 1: at equal rates the totals are all tokens times the rate.
    seen = now.sum() / min(max(1.0, lowest), highest)
    if seen == 0:
        return steps
    target = weights * (least_total(now, weights) if total is None else total)
    size_of = max(1.0, float(target.sum()))
    for _ in range(ROUNDS):
        gradient = now - target
        moments, largest = _free(table, steps, gradient, lowest, highest)
        if largest / size_of < TOLERANCE:
            return steps
        trials = [
            (gradient, length * np.linalg.solve(moments + damping * seen * np.eye(size), gradient))
            for damping in DAMPINGS for length in LENGTHS
        ]
        totals = _trials(table, steps, trials, lowest, highest, size)
        left = ((totals - target) ** 2).sum(axis=1)
        best = int(left.argmin())
        if left[best] >= (gradient ** 2).sum():
            break
        steps.append(trials[best])
        now = totals[best]
    warnings.warn(f"rates after {len(steps)} steps: the projected gradient is {largest / size_of:.1e} of the total, {TOLERANCE:.0e} is asked for", stacklevel=2)
    return steps


def least_total(totals: np.ndarray, weights: np.ndarray) -> float:
    """The smallest total at which no domain has to lose tokens to meet its weight."""
    asked = (weights > 0) & (totals > 0)
    return float((totals[asked] / weights[asked]).max()) if asked.any() else float(totals.sum())


def mix(
    docs: DataFrame, model: Model, weights: dict[str, float], total: float | None = None, lowest: float = 0.0, highest: float = np.inf,
    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """A rate for each document, under which expected domain tokens meet the weights.

    ``weights`` are normalised to 1; a domain that has none is asked for nothing.
    ``total`` is the number of tokens (words) to reach; None takes the smallest at which
    no domain must lose any.  Rates are at least ``lowest`` and at most ``highest``, which
    keeps a document from being repeated without end for a domain the data hardly hold.
    Where targets can't be met, the result is the nearest in least squares; if ROUNDS
    steps don't reach it, the nearest rates met, with a warning.

    Returns id, tokens, posterior (in the model's order of domains), rate and copies,
    one row per input row, with the columns named in ``carry`` as they were (their rows
    are judged once more on the way, which needs no join).  ``copies`` rounds the rate up
    or down by the id's hash, in the long run without bias.  A null or empty text has no
    tokens, the model's prior as its posterior and the rate 1 (or the nearer bound); an empty table
    gives no rows.  Repeated rows have equal rates.  Only the columns named are read.
    """
    asked = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    if not asked.sum():
        raise ValueError("no domain of the model has a weight")
    if not 0 <= lowest <= highest or highest == 0:
        raise ValueError("rates lie between 0 <= lowest <= highest, and highest is over 0")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    kinds = {f.name: f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"}
    made = "tokens long, posterior array<double>"
    table = written(rows.select("id", "text").mapInArrow(_posteriors(model), f"{kinds['id']}, {made}"), "posteriors")
    steps = fit_rates(table, asked / asked.sum(), total, lowest, highest)
    source = rows if carry else table
    final = source.mapInArrow(_final(steps, lowest, highest, model if carry else None), f"{', '.join(kinds.values())}, {made}, rate double")
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit("mix")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return final.select(
        F.col("id").alias(id_col), "tokens", "posterior", "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"),
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)),
    )
