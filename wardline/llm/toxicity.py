"""Toxicity from subword bags: averaged embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import held_out, labelled_texts, pieces, sample_labels
from wardline.llm.quality_classifier import logistic

# Bounds of the training sample: texts of each label and bytes of a text whose words
# are learnt; of longer ones only the highest bag and the number of bags travel, for the curve.
SAMPLE_TEXTS = 2000
SAMPLE_BYTES = 16_000
BUCKETS = 1 << 17
DIMENSIONS = 12
GRAMS = (3, 4, 5)
# Words in a bag, and from one bag to the next: an insult counts as much in a long text as in a short one.
BAG, STEP = 3, 1
EPOCHS = 14
# Clean bags above the last point of their tail.
LEAST_BAGS = 64

WORD = re.compile(r"\w+").findall
# Bytes of text whose grams are held at once.
HELD_BYTES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_BORDER = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether a word may hold it (as ``\\w`` says)."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, and of the words themselves.

    Returns (number of the word, bucket) pairs in no order and the number of words of
    each text.  A word's grams take in the border before and after it, so a gram at an
    end differs from one inside.
    """
    parts = [np.frombuffer(f" {t} ".lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    codes = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    letter = _letters()[codes]
    # Runs of other characters shrink to one border; each text begins with one.
    text_of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    kept = letter.copy()
    kept[:1] = True
    kept[1:] |= letter[:-1] & ~letter[1:]
    codes, letter, text_of = np.where(letter, codes, _BORDER).astype(np.uint64)[kept], letter[kept], text_of[kept]
    border = np.cumsum(~letter)
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    counts = np.bincount(text_of[starts], minlength=len(parts))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    owners, buckets = [], []
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    with np.errstate(over="ignore"):
        h = codes * _M
        for n in range(2, GRAMS[-1] + 1):
            h = (h[:-1] ^ codes[n - 1:]) * _M
            h ^= h >> np.uint64(29)
            if n >= GRAMS[0]:
                # No border but at the ends: the inner positions are all of one word.
                inside = border[n - 2: len(codes) - 1] == border[: len(h)]
                owners.append(border[1: len(h) + 1][inside] - 1)
                buckets.append(((h * _M) >> shift)[inside])
        ends = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
        # Position in the word; the first character of all is a border.
        place = np.arange(len(codes)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(codes)]])))
        powers = np.cumprod(np.full(int((ends - starts).max()) + 1, _M, dtype=np.uint64))
        terms = np.where(letter, (codes + np.uint64(77)) * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
        whole = np.add.reduceat(terms, starts)
        whole ^= whole >> np.uint64(31)
        owners.append(np.arange(len(starts)))
        buckets.append((whole * _M) >> shift)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64), counts


@dataclass(frozen=True)
class Tail:
    """How rarely a bag of clean text reaches a log-odds: log shares at ascending points.

    Shares halve from point to point down to the LEAST_BAGS highest bags; beyond these
    the log share falls by ``fall`` a unit, as fitted to their mean excess.
    """

    points: np.ndarray = field(default_factory=lambda: np.zeros(1))
    logs: np.ndarray = field(default_factory=lambda: np.zeros(1))
    fall: float = 1.0

    def log_share(self, odds: np.ndarray) -> np.ndarray:
        return np.interp(odds, self.points, self.logs) - self.fall * np.maximum(0, odds - self.points[-1])

    def surprise(self, highest: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """-log of the chance that clean text of so many bags has one as high; the same for clean texts of every length."""
        expected = np.log(bags) + self.log_share(highest)
        # 1 - exp(-e) is e itself where e is small.
        return np.where(expected < -20, -expected, -np.log(-np.expm1(-np.exp(np.clip(expected, -20, 3)))))


def tail(bags: np.ndarray) -> Tail:
    """The tail of the log-odds of clean bags."""
    if not len(bags):
        return Tail()
    ordered = np.sort(bags)[::-1]
    ranks = [len(ordered)]
    while ranks[-1] // 2 >= LEAST_BAGS:
        ranks.append(ranks[-1] // 2)
    excess = float(ordered[: ranks[-1]].mean() - ordered[ranks[-1] - 1])
    # Of equal points the one with the greatest share says how many bags reach it.
    points, first = np.unique(ordered[np.array(ranks) - 1], return_index=True)
    return Tail(points, np.log(np.array(ranks)[first] / len(ordered)), 1 / max(excess, 0.05 * float(ordered.std()), 1e-3))


@dataclass(frozen=True)
class Model:
    """What a bucket adds to the softmax's log-odds, and the curve over how rarely clean text holds a text's highest bag.

    Averaging is linear, so after training each bucket's embedding matters only by
    its product with the difference of the softmax's two rows.
    """

    weights: np.ndarray
    bias: float
    slope: float
    base: float
    clean: Tail = field(default_factory=Tail)

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each word of the texts, and the number of words of each text."""
        owners, buckets, counts = subwords(texts)
        n = int(counts.sum())
        sums = np.bincount(owners, weights=self.weights[buckets], minlength=n)
        return sums / np.maximum(1, np.bincount(owners, minlength=n)), counts

    def highest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of each text's highest bag, and its number of bags."""
        scores, counts = self.word_scores(texts)
        ends = np.cumsum(counts)
        means = (bag_means(scores[e - n: e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True))
        found = np.array([(m.max(), len(m)) for m in means], dtype=np.float64).reshape(-1, 2)
        return found[:, 0] + self.bias, found[:, 1]

    def evidence(self, highest: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Surprises from about ten on say the same."""
        return np.log1p(self.clean.surprise(highest, bags))

    def probability(self, highest: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(highest, bags) + self.base, -30, 30)))


def bag_starts(n: int) -> np.ndarray:
    """First words of the overlapping bags that cover ``n`` words."""
    if n <= BAG:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - BAG, STEP), n - BAG)


def bag_means(scores: np.ndarray) -> np.ndarray:
    """Mean word score of each bag; a text without words has one bag of 0."""
    if not len(scores):
        return np.zeros(1)
    starts = bag_starts(len(scores))
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    ends = np.minimum(starts + BAG, len(scores))
    return (sums[ends] - sums[starts]) / (ends - starts)


def fit(
    texts: list[tuple[str, int]], share: float, seed: int = 7, longer: Callable[[Model], list[tuple[float, float, int]]] = lambda model: [],
) -> Model:
    """Embeddings and softmax trained jointly by gradient steps over bags.

    The first epochs show bags drawn at random under their text's label; the later
    ones show a text's highest bag and one other, so that the words which make a text
    toxic are found although only the text is labelled.  A third of the texts gives the
    tail of clean bags and fits the curve, with what ``longer`` finds under the model's
    words in texts too long to be here: highest bag, number of bags and label.  The curve
    is weighted to ``share``, the share of label 1 among labelled rows.
    """
    share = min(0.999, max(0.001, share))
    base = float(np.log(share / (1 - share)))
    ys = np.array([y for _, y in texts])
    if len(set(ys.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, base)
    rng = np.random.default_rng(seed)
    split = [WORD(text.lower()) for text, _ in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    owners, buckets, _ = subwords(list(vocabulary))
    order = np.argsort(owners, kind="stable")
    owners, buckets = owners[order], buckets[order]
    first = np.searchsorted(owners, np.arange(len(vocabulary) + 1))
    numbers = [np.array([vocabulary[w] for w in words], dtype=np.int64) for words in split]
    fold = np.arange(len(texts)) % 3 == 2
    learn = np.flatnonzero(~fold & np.array([len(x) > 0 for x in numbers]))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    memory, memory_soft = np.full(BUCKETS, 1e-6, np.float32), 1e-6

    def word_scores():
        value = table @ (softmax[1] - softmax[0])
        return np.add.reduceat(value[buckets], first[:-1]) / np.diff(first)

    def step(bags: list[np.ndarray], y: np.ndarray, rate: float):
        nonlocal softmax, bias, memory_soft
        words = np.concatenate(bags)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        counts = np.diff(first)[words]
        at = np.repeat(first[words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        ids, of = buckets[at], np.repeat(bag, counts)
        # Each subword's part of its bag's mean.
        part = np.repeat(1 / (counts * np.array([len(b) for b in bags])[bag]), counts).astype(np.float32)
        rows = table[ids]
        starts = np.searchsorted(of, np.arange(len(bags)))
        hidden = np.add.reduceat(rows * part[:, None], starts)
        logits = hidden @ softmax.T + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = p.copy()
        error[np.arange(len(y)), y] -= 1
        push = (error @ softmax)[of] * part[:, None]
        order = np.argsort(ids, kind="stable")
        unique, where = np.unique(ids[order], return_index=True)
        gradient = np.add.reduceat(push[order], where)
        memory[unique] += (gradient ** 2).mean(1)
        table[unique] -= rate * gradient / np.sqrt(memory[unique])[:, None]
        soft = error.T @ hidden / len(y)
        memory_soft += float((soft ** 2).mean())
        softmax -= rate * soft / np.sqrt(memory_soft)
        bias -= 0.1 * rate * error.mean(0)

    for epoch in range(EPOCHS):
        scores = word_scores() if epoch >= 3 else None
        bags, labels = [], []
        for doc in learn.tolist():
            words = numbers[doc]
            starts = bag_starts(len(words))
            picked = {int(rng.integers(len(starts)))}
            if scores is not None:
                top = int(bag_means(scores[words]).argmax())
                picked = {top} if ys[doc] else picked | {top}
            for k in picked:
                bags.append(words[starts[k]: starts[k] + BAG])
                labels.append(int(ys[doc]))
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 128):
            part = order[i: i + 128]
            step([bags[j] for j in part], np.array([labels[j] for j in part]), 0.15 * (1 - epoch / (EPOCHS + 1)))
    weights = (table @ (softmax[1] - softmax[0])).astype(np.float64)
    model = Model(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    scores = word_scores()
    rest = np.flatnonzero(fold) if len(set(ys[fold].tolist())) == 2 else np.arange(len(texts))
    means = [bag_means(scores[numbers[d]]) + model.bias for d in rest]
    model = replace(model, clean=tail(np.concatenate([m for m, y in zip(means, ys[rest], strict=True) if not y])))
    measured = [(m.max(), len(m), y) for m, y in zip(means, ys[rest].tolist(), strict=True)] + longer(model)
    highest, bags, y = (np.array(column, dtype=np.float64) for column in zip(*measured, strict=True))
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    slope, base = logistic(model.evidence(highest, bags), y, weight)
    return replace(model, slope=slope, base=base)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HELD_BYTES):
            highest, bags = model.highest(batch.column("text").to_pylist())
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(model.probability(highest, bags)), pa.array(highest), pa.array(bags)],
                [*kept, "score", "highest", "bags"],
            )

    return score


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold."""
    texts = labelled_texts(docs, labels, target, SAMPLE_TEXTS, SAMPLE_BYTES)
    share = labels.filter(~held_out(F.col("doc_id")) & F.col(target).isin(0, 1)).agg(F.avg(target)).first()[0]

    def longer(model: Model) -> list[tuple[float, float, int]]:
        picked = F.broadcast(sample_labels(labels, [target], SAMPLE_TEXTS).select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("label")))
        rows = docs.select(F.col("doc_id").alias("id"), "text").filter(F.octet_length("text") > SAMPLE_BYTES).join(picked, "id")
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = rows.select("id", "label", "text").mapInArrow(_scorer(model), f"id {kind}, label int, score double, highest double, bags double")
        return sorted((r["highest"], r["bags"], r["label"]) for r in found.drop("score").distinct().collect())

    return fit(texts, 0.5 if share is None else share, longer=longer)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability of label 1 for every whole text, from its highest bag of words.

    A long text has more bags, so a higher one by chance: the curve is over how rarely
    clean text of as many bags holds one as high.

    Returns id, held_out, score and predicted (1 where score >= threshold), one row
    per input row in no order.  A null text is an empty one, which has one bag of score
    0.  An empty table gives no rows; a model without both labels gives every text the
    share of label 1 (0.5 without labels).  Only the id and text columns are read, and
    the id never enters the score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_scorer(model), f"id {kind}, score double, highest double, bags double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
