"""A distributed positional inverted index: exact phrases, proximity, contaminated words.

A posting is one row (term, doc, pos).  Only DataFrame functions run here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The term of the posting that ends every document, at the position after its last word.
END = ""


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters outside ASCII, with A-Z lowered; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


@dataclass(frozen=True)
class Index:
    """Postings (term, doc, pos, id) of the terms in ``vocabulary`` (word, term), both stored.

    ``doc`` numbers the rows; ``id`` is filled in the posting that ends a document.
    """

    postings: DataFrame
    vocabulary: DataFrame

    def lengths(self) -> DataFrame:
        """(doc, id, n_words) of every document."""
        return self.postings.filter("term = 0").select("doc", "id", F.col("pos").cast("long").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return self.postings.filter("term > 0").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def index_documents(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The postings of every word of every document that is among ``terms`` (a column ``word``).

    Postings of words that no search asks for would never be read, so they are not
    kept.  The vocabulary is written, so that its size decides whether it is sent
    to the executors or met in a shuffle.  Repeated rows are documents each; a null
    or empty text has only the posting that ends it.
    """
    asked = terms.select("word").filter(F.col("word") != END).distinct()
    ordered = asked.select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    ending = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).cast("long").alias("term"))
    vocabulary = written(ordered.unionAll(ending), "terms")
    ended = F.concat(words(F.col(text_col)), F.array(F.lit(END)))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("doc"), ended.alias("words"))
    spread = rows.select("doc", "id", F.posexplode("words").alias("pos", "word"))
    postings = spread.join(vocabulary, "word").select("term", "doc", "pos", F.when(F.col("term") == 0, F.col("id")).alias("id"))
    return Index(written(postings, "postings"), vocabulary)


def phrases_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, row, at, word, size): the words of each search text; rows without an id are left out."""
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.size("words"))
    return numbered.select("item", "row", "size", F.posexplode("words").alias("at", "word"))


def matching_runs(index: Index, phrases: DataFrame, window: int) -> DataFrame:
    """(doc, item, row, pos, at): document words inside an exact occurrence of ``window`` words in a row.

    A search text with fewer words is one window.  A window's two rarest terms give
    the lists that are read first.  Every posting (doc, pos) of a term at place
    ``at`` of the text votes for the offset ``pos - at``; the rarest list is
    intersected with the second on equal offsets, and only at offsets that both
    hold are the other terms' postings read.  Runs of places found at one offset
    that are as long as a window are its occurrences; nothing is dropped and no
    list is cut.
    """
    terms = phrases.join(index.vocabulary, "word").join(index.frequencies(), "term", "left")
    ahead = Window.partitionBy("row").orderBy("at").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "at", "term")).over(ahead))
    rarest = (
        terms.select("item", "row", "size", "at", "term", ranked.alias("ranked"))
        .filter(F.col("at") <= F.greatest(F.col("size") - window, F.lit(0)))
        .filter(F.col("ranked")[0]["frequency"] > 0)
        .select("row", F.col("ranked")[0].alias("first"), F.coalesce(F.get("ranked", F.lit(1)), F.col("ranked")[0]).alias("second"))
        .select("row", F.col("first.at").alias("at"), F.col("first.term").alias("term"), F.col("second.at").alias("at2"), F.col("second.term").alias("term2"))
        .distinct()
    )
    anchors = written(rarest, "anchors")
    one = index.postings.select("term", "doc", "pos").join(anchors, "term").select("doc", "row", (F.col("pos") - F.col("at")).alias("offset"), "at2")
    seconds = anchors.select("row", F.col("at2"), F.col("term2").alias("term")).distinct()
    two = index.postings.select("term", "doc", "pos").join(seconds, "term").select("doc", "row", (F.col("pos") - F.col("at2")).alias("offset"), "at2")
    both = one.join(two, ["doc", "row", "offset", "at2"], "left_semi")
    places = written(both.select("doc", "row", "offset").distinct(), "offsets")
    # All words of the text at these offsets, from the lists of the documents concerned.
    wanted = places.join(terms.select("item", "row", "at", "size", "term"), "row").withColumn("pos", F.col("offset") + F.col("at"))
    held = index.postings.select("term", "doc", "pos").join(places.select("doc").distinct(), "doc", "left_semi")
    found = wanted.join(held, ["doc", "pos", "term"])
    along = Window.partitionBy("doc", "row", "offset").orderBy("at")
    islands = found.withColumn("run", F.col("at") - F.row_number().over(along))
    length = F.count(F.lit(1)).over(Window.partitionBy("doc", "row", "offset", "run"))
    return islands.withColumn("length", length).filter(F.col("length") >= F.least("size", F.lit(window))).select("doc", "item", "row", "pos", "at")


def exact_phrases(index: Index, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(id of the document, query, start): every place where all words of a query stand in its order.

    The index must hold the queries' words.  Queries without words match nothing; rows that
    repeat an id are documents each.
    """
    phrases = written(phrases_of(queries, id_col, text_col), "queries")
    size = phrases.groupBy("row").agg(F.max("size").alias("size"))
    longest = phrases.agg(F.max("size")).first()[0] or 1
    runs = matching_runs(index, phrases, longest).withColumn("start", F.col("pos") - F.col("at"))
    whole = runs.groupBy("doc", "item", "row", "start").agg(F.count(F.lit(1)).alias("n")).join(size, "row").filter("n = size")
    return whole.join(index.lengths(), "doc").select("doc", "id", F.col("item").alias("query"), F.col("start").cast("long").alias("start")).distinct().drop("doc")


def near_terms(index: Index, queries: DataFrame, within: int, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(id, query, start): places where ``within`` words in a row hold all different words of a query, in any order.

    ``start`` is the first of the query's words there.  Postings near the rarest
    word's are the only ones compared: positions are cut into stretches of
    ``within`` words, and a word can only count in the stretch of the rarest word or
    in one beside it.  The index must hold the queries' words.
    """
    phrases = written(phrases_of(queries, id_col, text_col).select("item", "row", "word").distinct(), "queries")
    terms = phrases.join(index.vocabulary, "word").join(index.frequencies(), "term", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    rare = terms.groupBy("row").agg(F.min(F.struct("frequency", "term"))["term"].alias("term"))
    rare = rare.join(phrases.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row")
    stretch = F.floor(F.col("pos") / within)
    lists = index.postings.select("term", "doc", "pos")
    seeds = lists.join(rare, "term").select("doc", "row", "n", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct()
    near = lists.join(terms.select("item", "row", "term"), "term").withColumn("stretch", stretch).join(seeds, ["doc", "row", "stretch"])
    ahead = Window.partitionBy("doc", "row").orderBy("pos").rangeBetween(0, within - 1)
    hits = near.withColumn("seen", F.size(F.collect_set("term").over(ahead))).filter(F.col("seen") == F.col("n"))
    return hits.join(index.lengths(), "doc").select("doc", "id", F.col("item").alias("query"), F.col("pos").cast("long").alias("start")).distinct().drop("doc")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """What each document holds of the test items, exactly.

    A document word counts when it lies in an occurrence of ``window`` words of an item
    (all words of a shorter item).  Returns per input row: id, n_words, n_hit, n_items,
    items (their ids as sorted strings), contaminated.

    Null and empty texts have no words and are clean; items without words or without
    an id match nothing; items that repeat an id count once; no items leave every document
    clean; no documents give no rows; other columns are neither read nor returned.
    """
    phrases = written(phrases_of(items, item_col, item_text), "items")
    index = index_documents(docs, phrases, id_col, text_col)
    runs = written(matching_runs(index, phrases, window).select("doc", "item", "pos").distinct(), "runs")
    hit = runs.select("doc", "pos").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    named = runs.select("doc", F.col("item").cast("string").alias("item")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    rows = index.lengths().join(hit, "doc", "left").join(named, "doc", "left").withColumn("items", F.coalesce("items", none))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", F.col("n_hit").isNotNull().alias("contaminated"),
    )
