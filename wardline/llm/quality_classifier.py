"""Quality scores from how much better one zstandard dictionary packs a text than another."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import held_out, labelled_texts, sample_labels

# Bounds of the training sample: texts of each label, and bytes of a text that travels.
SAMPLE_TEXTS = 2500
SAMPLE_BYTES = 32_000
DICTIONARY_TEXTS = 1500
DICTIONARY_BYTES = 250_000
LEVEL = 3
SLICE = 2000
# Bytes that are packed at a time: all of a text meets the dictionaries, not its own start.
PIECE = 2048
# Added to a text's length when sizes are compared, so that a few words decide little.
PRIOR_BYTES = 100


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic curve over the normalised difference.

    The curve runs over the difference's distance from the middle between the labels'
    medians, on a scale that is linear there and logarithmic far away: odd texts
    don't flatten the curve, and a larger difference always has a larger score.
    """

    good: bytes
    bad: bytes
    slope: float
    base: float
    middle: float = 0.0
    spread: float = 1.0

    def evidence(self, difference: float) -> float:
        return math.asinh((difference - self.middle) / self.spread)

    def probability(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.evidence(difference) + self.base))))

    def differ(self):
        """A function from bytes to the normalised difference of compressed sizes, summed over pieces."""
        if not self.good or not self.bad:
            return lambda text: 0.0
        import zstandard

        def packer(content: bytes):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary).compress

        good, bad = packer(self.good), packer(self.bad)

        def difference(text: bytes) -> float:
            cuts = (text[i: i + PIECE] for i in range(0, len(text), PIECE))
            return sum(len(bad(piece)) - len(good(piece)) for piece in cuts) / (len(text) + PRIOR_BYTES)

        return difference


def _dictionary(texts: list[str], shared: set[str]) -> bytes:
    import zstandard

    kept = ["\n".join(line for line in text.split("\n") if line not in shared).encode() for text in texts]
    slices = [text[i: i + SLICE] for text in kept for i in range(0, len(text), SLICE)]
    total = sum(map(len, slices))
    size = min(DICTIONARY_BYTES, total // 4)
    try:
        return zstandard.train_dictionary(size, slices, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too little text to choose from: the slices are the dictionary.
        return b"".join(slices)[:DICTIONARY_BYTES]


def logistic(x, y, weight, steps: int = 60) -> tuple[float, float]:
    """Slope and base of the weighted logistic curve, by Newton steps with a slight pull to 0."""
    import numpy as np

    spread = float(np.std(x)) or 1.0
    design = np.stack([np.asarray(x) / spread, np.ones(len(x))], axis=1)
    theta = np.zeros(2)
    pull = np.diag([1e-3, 1e-6]) * float(np.sum(weight))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + pull @ theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / spread), float(theta[1])


def fit(texts: list[tuple[str, int]], share_good: float, longer: Callable[[Model], list[tuple[float, int]]] = lambda model: []) -> Model:
    """Dictionaries from the first texts of each label, the curve from the rest.

    Lines of more than one text say nothing about quality and stay out of both
    dictionaries.  ``longer`` gives the differences and labels, under a model's
    dictionaries, of texts too long to be here; the curve is fitted on them too.  Texts
    of the curve are weighted to ``share_good``, the share of label 1 among all labelled
    rows.  With one label only, that share is every score.
    """
    import numpy as np

    by = {label: [text for text, y in texts if y == label] for label in (0, 1)}
    # Two thirds train at most, so that the curve has texts the dictionaries don't know.
    cut = {label: min(DICTIONARY_TEXTS, (2 * len(rows) + 2) // 3) for label, rows in by.items()}
    share = min(0.999, max(0.001, share_good))
    base = math.log(share / (1 - share))
    if not by[0] or not by[1]:
        return Model(b"", b"", 0.0, base)
    lines = Counter(line for label in by for text in by[label][: cut[label]] for line in set(text.split("\n")))
    shared = {line for line, n in lines.items() if n > 1}
    model = Model(_dictionary(by[1][: cut[1]], shared), _dictionary(by[0][: cut[0]], shared), 0.0, base)
    rest = {label: rows[cut[label]:] or rows for label, rows in by.items()}
    differ = model.differ()
    measured = [(differ(text.encode()), label) for label in (0, 1) for text in rest[label]] + longer(model)
    x, y = (np.array(column) for column in zip(*measured, strict=True))
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    low, high = (float(np.median(x[y == label])) for label in (0, 1))
    middle, spread = (low + high) / 2, abs(high - low) / 4 or float(np.std(x)) or 1.0
    placed = replace(model, middle=middle, spread=spread)
    slope, base = logistic(np.array([placed.evidence(d) for d in x]), y, weight)
    # A better fit to the good dictionary never lowers a score.
    return replace(placed, slope=max(slope, 0.0), base=base)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = model.differ()
        for batch in batches:
            differences = [differ(text or b"") for text in batch.column("text").cast(pa.binary()).to_pylist()]
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array([model.probability(d) for d in differences], pa.float64()), pa.array(differences, pa.float64())],
                [*kept, "score", "difference"],
            )

    return score


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold.

    Of sampled texts over SAMPLE_BYTES only the differences travel, for the curve.
    """
    texts = labelled_texts(docs, labels, target, SAMPLE_TEXTS, SAMPLE_BYTES)
    share = labels.filter(~held_out(F.col("doc_id")) & F.col(target).isin(0, 1)).agg(F.avg(target)).first()[0]

    def longer(model: Model) -> list[tuple[float, int]]:
        picked = F.broadcast(sample_labels(labels, [target], SAMPLE_TEXTS).select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("label")))
        rows = docs.select(F.col("doc_id").alias("id"), "text").filter(F.octet_length("text") > SAMPLE_BYTES).join(picked, "id")
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = rows.select("id", "label", "text").mapInArrow(_scorer(model), f"id {kind}, label int, score double, difference double")
        return sorted((r["difference"], r["label"]) for r in found.drop("score").distinct().collect())

    return fit(texts, 0.5 if share is None else share, longer)


def score_quality(
    docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """The probability of label 1 for every whole text.

    Returns id, held_out, score, predicted (1 where score >= threshold) and the
    normalised difference, one row per input row in no order, with the columns named in
    ``carry`` as they were.  A null text is an empty one: its difference is 0 and it gets
    the score of the curve there.  An empty table gives no rows; a model without labels
    scores 0.5.  Only the columns named are read, and the id never enters the score.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    scored = rows.mapInArrow(_scorer(model), f"{schema}, score double, difference double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "difference", *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)),
    )
