"""Phrases, proximity and contamination against plain searches, and edge rows."""

import random
import re

from pyspark.sql import functions as F

from wardline.llm.positional_index import contamination, exact_phrases, index_documents, near_terms, phrases_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def plain_contamination(docs, items, window):
    windows = {}
    for key, text in items:
        found = words(text)
        if key is not None and found:
            for s in range(max(1, len(found) - window + 1)):
                windows.setdefault(tuple(found[s: s + window]), set()).add(str(key))
    rows = []
    for key, text in docs:
        found, hit, held = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(found) - size + 1):
                names = windows.get(tuple(found[s: s + size]))
                if names:
                    hit.update(range(s, s + size))
                    held |= names
        rows.append((key, len(found), len(hit), len(held), sorted(held), bool(hit)))
    return sorted(rows, key=str)


def corpus():
    rng = random.Random(11)
    few = ["the", "of", "a", "la", "de"]

    def text(n):
        return " ".join(rng.choice(few) for _ in range(n))

    items = [(1, text(30)), (2, "Rare words, only here; and É!"), (3, text(4)), (10, text(12)), (10, text(11)), (None, "never counted at all"), (5, None), (6, " -- "), (7, "the")]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(60)]
    passage = items[0][1]
    docs += [(100 + i, f"x{i} {passage.upper()} . tail") for i in range(40)]
    docs += [(200, "rare Words only\nhere and É"), (201, "rare words only here and é"), (202, None), (203, ""), (204, "never counted at all")]
    docs += [(205, f"{passage} {passage}"), (205, f"{passage} {passage}"), (None, passage), (206, " ".join(passage.split()[:9])), (207, ("la de " * 5_000) + passage)]
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(k, t, "z", 1) for k, t in docs], "doc_id long, text string, item string, pos int").repartition(6)
    right = spark.createDataFrame([(k, t, "z", 1) for k, t in items], "item_id long, text string, doc_id string, term int").repartition(3)
    return left, right


def test_contamination_is_exact(spark):
    docs, items = corpus()
    left, right = frames(spark, docs, items)
    for window in (10, 3):
        got = sorted((tuple(r) for r in contamination(left, right, window).collect()), key=str)
        assert got == plain_contamination(docs, items, window)
    none = contamination(left, right.limit(0))
    assert none.count() == len(docs) and none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert contamination(left.limit(0), right).count() == 0


def test_no_python_on_the_way(spark):
    docs, items = corpus()
    left, right = frames(spark, docs, items)
    plan = contamination(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_phrases_and_proximity(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 40)))) for i in range(50)] + [(None, "a b"), (60, None)]
    queries = [(1, "a b"), (2, "a B a"), (3, "f"), (4, "c d e a"), (5, "zz"), (6, ""), (7, None), (8, "a zz")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = index_documents(left, phrases_of(asked, "query_id", "text"))
    got = sorted((tuple(r) for r in exact_phrases(index, asked).collect()), key=str)
    want = []
    for key, text in docs:
        found = words(text)
        for query, phrase in queries:
            asked_words = words(phrase)
            if asked_words:
                want += [(key, query, s) for s in range(len(found) - len(asked_words) + 1) if found[s: s + len(asked_words)] == asked_words]
    assert got == sorted(want, key=str)
    for within in (2, 4, 7):
        got = sorted((tuple(r) for r in near_terms(index, asked, within).collect()), key=str)
        want = []
        for key, text in docs:
            found = words(text)
            for query, phrase in queries:
                terms = set(words(phrase))
                if terms:
                    want += [(key, query, s) for s in range(len(found)) if found[s] in terms and terms <= set(found[s: s + within])]
        assert got == sorted(want, key=str)


def test_index_lengths(spark):
    docs, items = corpus()
    left, right = frames(spark, docs, items)
    index = index_documents(left, phrases_of(right, "item_id", "text"))
    assert sorted((r["id"] or -1, r["n_words"]) for r in index.lengths().collect()) == sorted((k or -1, len(words(t))) for k, t in docs)
    assert index.frequencies().filter(F.col("frequency") < 1).count() == 0
