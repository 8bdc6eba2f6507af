"""Benchmark passages in documents, by a positional inverted index in DataFrame operations only.

``build`` reads the documents once. A posting is (term, row, pos): a word of the test texts, a document's row and the word's
place in it; each document has one posting more, of the term END, whose place is its number of words. Postings are written
in segments sorted by term, one for each task, so indexing shuffles nothing. Words that no test text has are not looked
up by any phrase and are left out.

``phrases`` finds the windows of the test texts. Of every window the two rarest terms are looked up, and their lists are
shifted by the terms' places in the text: postings of one text, row and diagonal (place in the document less place in the
text) meet. Only diagonals on which both terms of a window meet are gone through word by word, against the postings of the
rows concerned. ``near`` finds sets of words that lie close together in any order, from the rarest two in the same way.

What is broadcast is made of the test texts, or the rows of candidates, each counted first; beyond
BROADCAST_ROWS the same joins are left to shuffles, which Spark splits where a word is hot.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: The term of the posting that ends each document.
END = -1
#: Rows of a table that is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words are runs of what these ranges leave, which after lower-casing of A-Z are digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, not yet lower-cased (``lowered`` does not change where words begin and end)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _sent(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (stored) to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df.hint("merge")


@dataclass
class Texts:
    """Test texts by content: ``items`` (text, item_id string), ``terms`` (word, term), ``places`` (text, n, p, term)."""

    items: DataFrame
    terms: DataFrame
    places: DataFrame


def test_texts(benchmark: DataFrame) -> Texts:
    """Items with equal words are one text. Null ids are written as empty strings; items without words are left out."""
    words = F.transform(words_of(F.col("text")), lowered)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words"))
    items = items.where(F.size("words") > 0)
    texts = stored(items.select("words").distinct().withColumn("text", F.monotonically_increasing_id()))
    placed = texts.select("text", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    terms = stored(placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    return Texts(stored(items.join(texts, "words").select("text", "item_id").distinct()), terms, stored(placed.join(terms, "word").select("text", "n", "p", "term")))


def build(docs: DataFrame, texts: Texts) -> DataFrame:
    """The index of ``docs`` (doc_id, text): term, row, pos, and the doc_id where the term is END; see the module."""
    spark = docs.sparkSession
    ends = spark.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    found = numbered.select("row", "doc_id", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    found = found.withColumn("word", lowered(F.col("word"))).join(_sent(stored(texts.terms.union(ends))), "word")
    whose = F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")
    return stored(found.select("term", "row", "pos", whose).sortWithinPartitions("term", "row", "pos"))


def frequencies(index: DataFrame) -> DataFrame:
    return stored(index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("found")))


def _rows_of(index: DataFrame, candidates: DataFrame) -> DataFrame:
    """Postings of the candidates' rows; all of them where the rows are too many to send."""
    rows = stored(candidates.select("row").distinct())
    postings = index.where(F.col("term") != END).select("row", "pos", "term")
    return postings.join(F.broadcast(rows), "row", "left_semi") if rows.count() <= BROADCAST_ROWS else postings


def phrases(index: DataFrame, texts: Texts, found: DataFrame, width: int = 10) -> DataFrame:
    """(text, row, diagonal, hits): places ``hits`` of the text that are in a window found in the row, diagonal words later.

    A window is ``width`` consecutive words of a text, or all of a shorter one.
    """
    # every window: its words' frequencies, and the places of its two rarest words
    length = F.least(F.col("n"), F.lit(width))
    opens = F.explode(F.sequence(F.greatest(F.col("p") - length + 1, F.lit(0)), F.least(F.col("p"), F.col("n") - length)))
    inside = texts.places.join(found, "term", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("opens", opens)
    rare = F.slice(F.array_sort(F.collect_list(F.struct("found", "p", "term"))), 1, 2)
    windows = inside.groupBy("text", "opens").agg(rare.alias("rare")).where(F.col("rare")[0]["found"] > 0)
    windows = stored(windows)
    seeds = stored(windows.select("text", F.inline("rare")).select("text", "p", "term").distinct())
    pair = F.struct(F.col("rare")[0]["p"].alias("a"), F.element_at("rare", -1)["p"].alias("b"))
    pairs = _sent(stored(windows.groupBy("text").agg(F.collect_set(pair).alias("pairs"))))
    lists = index.join(_sent(seeds), "term").select("text", "row", (F.col("pos") - F.col("p")).alias("diagonal"), "p")
    met = lists.groupBy("text", "row", "diagonal").agg(F.collect_set("p").alias("met")).join(pairs, "text")
    both = F.exists("pairs", lambda x: F.array_contains("met", x["a"]) & F.array_contains("met", x["b"]))
    candidates = stored(met.where(both).select("text", "row", "diagonal"))
    # the candidates word by word
    wanted = candidates.join(_sent(texts.places), "text").withColumn("pos", F.col("p") + F.col("diagonal"))
    same = wanted.join(_rows_of(index, candidates), ["row", "pos", "term"])
    runs = same.groupBy("text", "row", "diagonal").agg(F.array_sort(F.collect_list("p")).alias("m"), F.first(length).alias("length"))
    whole = lambda j: F.get("m", j + F.col("length") - 1) == F.get("m", j) + F.col("length") - 1
    held = F.filter("m", lambda p, i: F.exists(F.sequence(F.greatest(i - F.col("length") + 1, F.lit(0)), i), whole))
    return runs.select("text", "row", "diagonal", held.alias("hits")).where(F.size("hits") > 0)


def near(index: DataFrame, queries: DataFrame, found: DataFrame, within: int) -> DataFrame:
    """(query, row, pos): places of a query's rarest word that are in ``within`` consecutive words with all its others.

    ``queries`` has (query, term), each pair once. A query with a word that no document has is found nowhere.
    """
    ranked = W.partitionBy("query").orderBy("found", "term")
    known = queries.join(found, "term", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    known = known.withColumn("nth", F.row_number().over(ranked)).withColumn("size", F.count("*").over(W.partitionBy("query")))
    known = stored(known.withColumn("least", F.min("found").over(W.partitionBy("query"))).where(F.col("least") > 0))
    seeds = stored(known.where(F.col("nth") <= 2).select("query", "term", "nth", "size"))
    lists = index.join(_sent(seeds), "term")
    first = lists.where(F.col("nth") == 1).select("query", "row", "size", "pos")
    cells = F.explode(F.expr(f"sequence((pos - {within - 1}) div {within} - 1, (pos + {within - 1}) div {within})")).alias("cell")
    second = lists.where(F.col("nth") == 2).select("query", "row", F.col("pos").alias("other"), F.expr(f"pos div {within}").cast("long").alias("cell"))
    met = first.select("*", cells).join(second, ["query", "row", "cell"]).where(F.abs(F.col("pos") - F.col("other")) < within)
    candidates = stored(met.select("query", "row", "size", "pos").distinct().unionByName(first.where("size = 1")))
    postings = _rows_of(index, candidates).select("row", "term", F.col("pos").alias("at"), F.expr(f"pos div {within}").cast("long").alias("cell"))
    wanted = candidates.join(_sent(known.select("query", "term")), "query").select("*", cells)
    close = wanted.join(postings, ["row", "term", "cell"]).where(F.abs(F.col("at") - F.col("pos")) < within)
    close = close.groupBy("query", "row", "pos", "size").agg(F.collect_set(F.struct("at", "term")).alias("all"))
    # some run of ``within`` words that begins with a word of the query and holds ``pos`` has every word
    has = lambda x: F.array_distinct(F.transform(F.filter("all", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + within)), lambda y: y["term"]))
    every = F.exists("all", lambda x: (x["at"] <= F.col("pos")) & (F.size(has(x)) == F.col("size")))
    return close.where(every).select("query", "row", "pos")


def rare_words(texts: Texts, found: DataFrame, words: int) -> DataFrame:
    """(query, term): the ``words`` rarest different words of each text, of those that documents have, as a query for ``near``."""
    known = texts.places.select("text", "term").distinct().join(found, "term").join(texts.terms, "term")
    order = W.partitionBy("text").orderBy("found", "word")
    return known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= words).select(F.col("text").alias("query"), "term")


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, near_words: int = 5, near_within: int = 20) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated and n_near.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A document word is hit if it
    is inside any occurrence of a window of ``width`` words of an item (all words of a shorter item). n_items counts the
    different item_ids with such windows, items_sha256 is the digest of their ids, sorted as strings and joined by
    commas (of nothing: of the empty string). n_near counts items whose ``near_words`` rarest words lie within
    ``near_within`` consecutive words in any order, verbatim or not. A null text has no words; an item without words is
    found nowhere; a null item_id is written as an empty string. Repeated rows and ids of documents each give a row.
    Empty tables give no rows, or rows without hits.
    """
    texts = test_texts(benchmark)
    index = build(docs, texts)
    found = frequencies(index)
    hits = stored(phrases(index, texts, found, width))
    covered = hits.select("row", F.explode(F.transform("hits", lambda p: p + F.col("diagonal"))).alias("pos")).distinct()
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    of_items = hits.select("row", "text").distinct().join(_sent(texts.items), "text")
    ids = F.array_join(F.array_sort(F.collect_set("item_id")), ",")
    n_items = of_items.groupBy("row").agg(F.countDistinct("item_id").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    close = near(index, rare_words(texts, found, near_words), found, near_within).select("row", F.col("query").alias("text")).distinct()
    n_near = close.join(_sent(texts.items), "text").groupBy("row").agg(F.countDistinct("item_id").alias("n_near"))
    rows = index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    rows = rows.join(n_hit, "row", "left").join(n_items, "row", "left").join(n_near, "row", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select(
        "doc_id", "n_words", count("n_hit"), count("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), count("n_near"),
    )
