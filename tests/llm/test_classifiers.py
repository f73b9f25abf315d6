"""Quality, toxicity and rules: held-out accuracy, brute force, edge rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardline.llm import quality_classifier, quality_rules, toxicity

DIR = "/root/testdata/sf0.1"


def auc(scores, y):
    scores, y = np.asarray(scores), np.asarray(y)
    values, inverse, counts = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = (y == 1).sum()
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return docs, spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word", None), (3, "word", None), (None, "x y", "c"), (5, "the of and " * 20_000, "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def joined(scored, labels, target):
    rows = scored.join(labels.select("doc_id", target), "doc_id").filter("held_out").toPandas()
    assert set(rows["held_out"]) == {True}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])
    return rows


def test_quality(spark, given, edge):
    docs, labels = given
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score_quality(docs, model)
    assert scored.count() == docs.count()
    rows = joined(scored, labels, "quality")
    assert auc(rows["score"], rows["quality"]) > 0.97
    assert rows["predicted"][rows["quality"] == 1].mean() > 0.98
    found = quality_classifier.score_quality(edge, model).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    assert quality_classifier.score_quality(edge.limit(0), model).count() == 0
    empty = quality_classifier.train(docs.limit(0), labels.limit(0))
    assert [r["score"] for r in quality_classifier.score_quality(edge.limit(1), empty).collect()] == [0.5]
    one = quality_classifier.train(docs, labels.filter("quality = 1"))
    assert quality_classifier.score_quality(edge, one).filter("score > 0.9").count() == 6


def test_quality_of_long_texts(spark, given):
    """Length takes nothing from the evidence, and labels of long texts reach the curve."""
    docs, labels = given
    model = quality_classifier.train(docs, labels)
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").filter(quality_classifier.held_out(docs["doc_id"])).orderBy("doc_id").collect()
    grown = {y: "\n".join([r["text"] for r in rows if r["quality"] == y and r["text"]] * 20).encode() for y in (0, 1)}
    sizes = (40_000, 200_000, 1_000_000)
    long = [(10 * k + y, grown[y][:size].decode(errors="ignore")) for k, size in enumerate(sizes) for y in (0, 1)]
    table = spark.createDataFrame(long, "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_classifier.score_quality(table, model).collect()}
    for k in range(len(sizes)):
        assert found[10 * k]["difference"] < -0.02 and found[10 * k]["predicted"] == 0
        assert found[10 * k + 1]["difference"] > 0.02 and found[10 * k + 1]["predicted"] == 1
    # The same texts with labels turned around, all but the shorter ones': the curve hears of them.
    many = spark.createDataFrame([(10**6 + i, long[1][1]) for i in range(400)], "doc_id long, text string")
    turned = many.select("doc_id").selectExpr("doc_id", "0 as quality")
    both = docs.select("doc_id", "text").unionAll(many), labels.select("doc_id", "quality").unionAll(turned)
    assert quality_classifier.train(*both).slope < 0.8 * quality_classifier.train(docs, both[1]).slope


def test_toxicity(spark, given, edge):
    docs, labels = given
    model = toxicity.train(docs, labels)
    rows = joined(toxicity.score_toxicity(docs, model), labels, "toxic")
    assert auc(rows["score"], rows["toxic"]) > 0.9  # labels of this size are noisy
    # A misspelling shares grams with the word and stands out from plain words.
    word, wrong, plain = model.word_scores(["stupid stupidd", "there"])[0]
    assert word > plain and wrong > plain
    assert toxicity.score_toxicity(edge, model).count() == 6
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert [r["score"] for r in toxicity.score_toxicity(edge.limit(1), empty).collect()] == [0.5]


def test_toxicity_of_long_texts(spark, given):
    """Clean text scores alike at every length, and the score is the brute-force one."""
    docs, labels = given
    model = toxicity.train(docs, labels)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out(docs["doc_id"])).orderBy("doc_id").collect()
    clean = [r["text"] for r in rows if r["toxic"] == 0 and r["text"]]
    rng, long = np.random.default_rng(4), []
    for size, times in ((2_000, 300), (16_000, 60), (60_000, 30), (200_000, 15), (600_000, 15)):
        for _ in range(times):
            order = [clean[i] for i in rng.permutation(len(clean))]
            held = np.cumsum([len(text) for text in order])
            long.append((size, "\n".join(order[: int(np.searchsorted(held, size)) + 1])))
    table = spark.createDataFrame([(10 * i, size, text) for i, (size, text) in enumerate(long)], "doc_id long, size int, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    means = {size: np.mean([scores[10 * i] for i, (s, _) in enumerate(long) if s == size]) for size, _ in long}
    assert all(abs(mean - means[2_000]) < 0.05 for mean in means.values()), means
    for i in range(0, 300, 60):
        words = toxicity.WORD(long[i][1].lower())
        odds = [float(model.word_scores([w])[0][0]) for w in words]
        bags = [np.mean(odds[k: k + 3]) for k in range(max(1, len(words) - 2))]
        found = float(model.probability(np.array([max(bags) + model.bias]), np.array([float(len(bags))]))[0])
        assert scores[10 * i] == pytest.approx(found, abs=1e-9)
    # Long labelled texts reach the curve: told that half of them are toxic, it trusts the bags less.
    many = spark.createDataFrame([(10**6 + i, long[-1][1][: 20_000]) for i in range(400)], "doc_id long, text string")
    told = many.select("doc_id").selectExpr("doc_id", "1 as toxic")
    both = docs.select("doc_id", "text").unionAll(many), labels.select("doc_id", "toxic").unionAll(told)
    assert toxicity.train(*both).slope < 0.8 * toxicity.train(docs, both[1]).slope


def test_tail_of_clean_bags():
    values = np.random.default_rng(2).exponential(1.0, 200_000)
    found = toxicity.tail(values)
    for x in (0.5, 2.0, 6.0, 9.0, 14.0):
        assert found.log_share(np.array([x]))[0] == pytest.approx(-x, abs=0.3 + 0.5 * max(0, x - 9))
    # The highest of any number of clean bags is as surprising as any other.
    rng = np.random.default_rng(3)
    for n in (10, 1000, 20_000):
        highest = np.array([rng.choice(values, n).max() for _ in range(300)])
        assert found.surprise(highest, np.full(300, float(n))).mean() == pytest.approx(1.0, abs=0.25)
    assert toxicity.tail(np.zeros(0)).log_share(np.zeros(1)).tolist() == [0.0]
    same = toxicity.tail(np.ones(50))
    assert np.isfinite(same.surprise(np.array([0.0, 1.0, 5.0]), np.ones(3) * 1e9)).all()


def test_words_of_texts():
    texts = ["", "a", "a bb, ccc-d", " \n", "_x é9 " * 3, "日本 語"]
    owners, buckets, counts = toxicity.subwords(texts)
    assert counts.tolist() == [len(toxicity.WORD(t)) for t in texts]
    assert set(owners.tolist()) == set(range(int(counts.sum())))
    # A word has the same buckets wherever it stands: n-grams with both borders, and itself.
    for word in ("a", "bb", "ccc", "stupid"):
        alone = sorted(toxicity.subwords([word])[1].tolist())
        o, b, _ = toxicity.subwords([f"xx {word}.", f"{word}"])
        assert sorted(b[o == 1].tolist()) == alone == sorted(b[o == 2].tolist())
        assert len(alone) == 1 + sum(max(0, len(word) + 2 - n + 1) for n in (3, 4, 5))
    assert toxicity.subwords([])[2].tolist() == []


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_against_brute_force(spark, given, edge):
    docs, _ = given
    sample = docs.filter("doc_id < 600").unionByName(edge.filter("doc_id is not null"), allowMissingColumns=True).select("doc_id", "text")
    rows = quality_rules.text_statistics(sample).collect()
    texts = {}
    for r in sample.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    got = Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((i, *brute(t)) for i, some in texts.items() for t in some)
    odd = "a\x0bb\x1cc d\n\n \n|x\n|x\r\n" + "é" * 3
    assert quality_rules.statistics(odd)[:5] == brute(odd)


def test_rules(spark, given, edge):
    docs, labels = given
    rules = quality_rules.train(docs, labels)
    assert rules and all(len(r) <= quality_rules.MOST_CONDITIONS for r in rules)
    out = quality_rules.apply_rules(docs, rules)
    rows = out.join(labels.select("doc_id", "quality"), "doc_id").filter("not base_failed").toPandas()
    rows = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]]
    assert rows["kept"][rows["quality"] == 1].mean() > 0.97
    assert rows["kept"][rows["quality"] == 0].mean() < 0.5
    # The expression says what the rules say one by one.
    names = quality_rules.features()
    some = out.limit(500).select("kept", "base_failed", *(c.alias(n) for n, c in names.items())).collect()
    for r in some:
        hit = any(all((r[c.feature] > c.value) == c.above for c in rule) for rule in rules)
        assert r["kept"] == (not r["base_failed"] and not hit)
    assert quality_rules.apply_rules(edge, rules).filter("kept").count() == 0
    assert quality_rules.apply_rules(edge.limit(0), []).count() == 0
    assert quality_rules.train(docs, labels.limit(0)) == []


def test_rules_keep_to_the_mix_of_all_labelled_rows(spark, monkeypatch):
    """Ten times the same rows give the same list, though the sample then holds as many bad texts as good ones."""
    words = " ".join(chr(97 + i) * 4 for i in range(26))
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2000):
        bad = i % 10 == 0
        sign, loud = bad and rng.random() < 0.25, rng.random() < (0.5 if bad else 0.05)
        rows.append((i, words + " #" * sign + " !" * loud, 0 if bad else 1))
    monkeypatch.setattr(quality_rules, "SAMPLE_TEXTS", 1500)
    lists = []
    for times in (1, 10):
        table = spark.createDataFrame([(i + 2000 * k, text, y) for k in range(times) for i, text, y in rows], "doc_id long, text string, quality int")
        lists.append(quality_rules.train(table.select("doc_id", "text"), table.select("doc_id", "quality")))
    assert lists[0] and [[(c.feature, c.above) for c in r] for r in lists[0]] == [[(c.feature, c.above) for c in r] for r in lists[1]]
    assert quality_rules._quantiles(np.array([3.0, 1, 2]), np.ones(3)) == pytest.approx(np.quantile([1, 2, 3], np.linspace(0, 1, 50)[1:-1]))
