"""Quality rules learned as an ordered decision list over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import held_out, sample_labels

# Bounds of the labelled sample and of the list.
SAMPLE_TEXTS = 10_000
MOST_RULES = 12
MOST_CONDITIONS = 4
THRESHOLDS = 48
LEAST_COVER = 8
LEAST_PRECISION = 0.8

REPEAT_WINDOW = 8
# The signs counted as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
CAPITALS = bytes(range(65, 91))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_exclaims"]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(REPEAT_WINDOW)], dtype=np.uint64)


def repeated_words(words: list, window: int = REPEAT_WINDOW) -> tuple[int, int]:
    """Words inside windows that the text holds twice or more, and distinct words.

    Windows of different hash differ; only those of equal hash are compared word by word.
    """
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    n = len(words) - window + 1
    if n < 2:
        return 0, len(numbers)
    mixed = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        sums += mixed[k: k + n] * _POWERS[k]
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, len(numbers)
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found: dict[tuple, list[int]] = {}
    for at in np.flatnonzero(twice).tolist():
        found.setdefault(tuple(words[at: at + window]), []).append(at)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for places in found.values():
        if len(places) > 1:
            np.add.at(covered, places, 1)
            np.add.at(covered, [p + window for p in places], -1)
    return int((np.cumsum(covered[:-1]) > 0).sum()), len(numbers)


def statistics(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    repeated = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    repeats, distinct = repeated_words(words)
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeated, repeats, lines, distinct,
        len(raw) - len(raw.translate(None, CAPITALS)), text.count("!"),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text) for text in batch.column(1).to_pylist()]
        columns = [list(x) for x in zip(*rows, strict=True)] or [[] for _ in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per input row; a null text is an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """The statistics that conditions test; shares, so that length alone decides nothing."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "exclaims_per_word": F.col("n_exclaims") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "capital_share": F.col("n_capitals") / letters,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.value if self.above else x <= self.value

    def column(self, available: dict[str, Column]) -> Column:
        test = available[self.feature]
        return test > F.lit(self.value) if self.above else test <= F.lit(self.value)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, dtype=bool)
    for condition in rule:
        inside &= condition.holds(data[condition.feature])
    return inside


def _quantiles(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """THRESHOLDS values that cut the rows' weight into equal parts."""
    order = np.argsort(values, kind="stable")
    middle = np.cumsum(weight[order]) - weight[order] / 2
    middle -= middle[0]
    return np.interp(np.linspace(0, 1, THRESHOLDS + 2)[1:-1] * middle[-1], middle, values[order])


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> Rule:
    """Conditions added one by one, each with the largest information gain on what is left.

    Gains and thresholds count the rows by weight, LEAST_COVER the rows themselves.
    """
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad & inside).any():
        p, n = weight[bad & inside].sum(), weight[~bad & inside].sum()
        best, gained = None, 1e-9
        for name, values in data.items():
            for value in np.unique(_quantiles(values[inside], weight[inside])):
                for above in (True, False):
                    condition = Condition(name, above, float(value))
                    now = inside & condition.holds(values)
                    if (bad & now).sum() < LEAST_COVER:
                        continue
                    p1, n1 = weight[bad & now].sum(), weight[~bad & now].sum()
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                    if gain > gained:
                        best, gained = condition, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(data[best.feature])
    return tuple(rule)


def _prune(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule that does best on rows it was not grown on."""
    best, worth, precision, hits = rule, -2.0, 0.0, 0
    for size in range(len(rule), 0, -1):
        now = _covers(rule[:size], data, len(bad))
        p, n = float(weight[bad & now].sum()), float(weight[~bad & now].sum())
        value = (p - n) / (p + n) if p + n else -2.0
        if value >= worth:
            best, worth, precision, hits = rule[:size], value, p / (p + n) if p + n else 0.0, int((bad & now).sum())
    return best, precision, hits


def learn(data: dict[str, np.ndarray], bad: np.ndarray, share_bad: float | None = None) -> list[Rule]:
    """Sequential covering: rules for rejection, in order; what none covers is kept.

    Two thirds of the rows grow a rule and the rest prune it; rows it covers leave
    both parts.  Learning ends when a rule is right in less than LEAST_PRECISION of
    the cases it was not grown on, or finds too few.  Gain and precision refer to
    ``share_bad``, the share of bad rows among all labelled ones; None takes the share
    given here.
    """
    here = bad.mean() if len(bad) else 0.0
    share = here if share_bad is None else share_bad
    weight = np.where(bad, share / here, (1 - share) / (1 - here)) if 0 < here < 1 else np.ones(len(bad))
    rules: list[Rule] = []
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MOST_RULES:
        grow, prune = left & ~part, left & part
        if (bad & grow).sum() < LEAST_COVER:
            break
        rule = _grow({k: v[grow] for k, v in data.items()}, bad[grow], weight[grow])
        if not rule:
            break
        rule, precision, hits = _prune(rule, {k: v[prune] for k, v in data.items()}, bad[prune], weight[prune])
        if precision < LEAST_PRECISION or hits < 2:
            break
        rules.append(rule)
        left &= ~_covers(rule, data, len(bad))
    return rules


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> list[Rule]:
    """Rules from the statistics of a bounded sample of labelled rows outside the held-out fold.

    Only numbers reach the driver: one row of features per sampled text.  The sample
    takes each label on its own; its rows are weighted to the labels' shares among all
    labelled rows outside the fold.  Without both labels there are no rules.
    """
    picked = F.broadcast(sample_labels(labels, [target], SAMPLE_TEXTS).toDF("_id", "_label"))
    sampled = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(picked, "_id")
    marked = sampled.select(F.struct("_id", "_label").alias("key"), F.col("_text").alias("text"))
    measured = text_statistics(marked, "key", "text")
    names = features()
    rows = measured.select("id.*", *(c.alias(n) for n, c in names.items())).toPandas().drop_duplicates()
    rows = rows.sort_values(["_id", *names], kind="stable")
    order = np.random.default_rng(11).permutation(len(rows))
    data = {n: rows[n].to_numpy(dtype=np.float64)[order] for n in names}
    share_bad = labels.filter(~held_out(F.col("doc_id")) & F.col(target).isin(0, 1)).agg(F.avg(1 - F.col(target))).first()[0]
    return learn(data, rows["_label"].to_numpy()[order] == 0, share_bad)


def verdict(rules: list[Rule], available: dict[str, Column] | None = None) -> Column:
    """The list as one ordered conditional expression: false at the first rule that holds."""
    available = available or features()
    out = None
    for rule in rules:
        test = None
        for condition in rule:
            column = condition.column(available)
            test = column if test is None else test & column
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base verdict and the list's verdict for every whole text.

    Returns id, the counts, base_failed (fewer than 20 words, or over 30 % of them in
    repeated windows of 8) and kept (false where base_failed, else the list's verdict),
    one row per input row.  A null or empty text has counts of 0 and fails.  An empty
    table gives no rows; other columns are neither read nor returned.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = text_statistics(docs, id_col, text_col)
    return measured.select(
        F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
    )
