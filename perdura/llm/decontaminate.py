"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

Method: the training tokens that some benchmark window needs are stored as postings
(term, text, position). A window is ten consecutive words of a benchmark item (all
words of a shorter item). Corpus-wide term counts rank the words of each window; the
lists of its two rarest words are intersected after taking off the words' offsets in
the item, which leaves (text, item, alignment) candidates. Exact phrase matches are
the candidates whose remaining words agree; proximity matches are those whose two
rarest words stand within `slack` positions of where the item has them.

A text is known by its 128-bit digest: copies share their lists and candidates, which
are combined before each shuffle, and results return to the rows by that digest.

Rows: a null text has no words. An item without words has no window. Items that share
an item_id count as one item. Repeated documents each get their row. Other columns of
the inputs are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.names import unused
from perdura.sources.staging import stage_table

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null gives none."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.length(whole) == F.octet_length(whole)
    plain = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.filter(F.split(plain, NOT_WORD), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def benchmark_items(items: DataFrame) -> DataFrame:
    """(item, item_id, words): one row for each distinct item with words."""
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("item", F.xxhash64("item_id", "words"))
    )


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each asked term occurs in all texts; a term that never occurs has no row."""
    return (
        texts.select(F.explode(words_of(F.col("text"))).alias("term"))
        .join(terms, "term", "leftsemi")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )


def window_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, start, length, first, second): offsets in the item of a window's two rarest words.

    A window with a word that no text has cannot occur and is left out. A window of
    one word has the same offset twice.
    """
    places = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    starts = F.explode(
        F.sequence(
            F.greatest(F.col("at") - (window - 1), F.lit(0)),
            F.least(F.col("at"), F.greatest(F.col("size") - window, F.lit(0))),
        )
    )
    return (
        places.join(counts, "term", "left")
        .select("item", "at", F.coalesce("n", F.lit(0)).alias("n"), F.least("size", F.lit(window)).alias("length"),
                starts.alias("start"))
        .groupBy("item", "start", "length")
        .agg(F.array_sort(F.collect_list(F.struct("n", "at"))).alias("ranked"))
        .where(F.col("ranked")[0]["n"] > 0)
        .select("item", "start", "length", F.col("ranked")[0]["at"].alias("first"),
                F.get(F.col("ranked"), F.least(F.size("ranked"), F.lit(2)) - 1)["at"].alias("second"))
    )


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, at) of every occurrence of the asked terms."""
    return texts.select("key", F.posexplode(words_of(F.col("text"))).alias("at", "term")).join(
        terms, "term", "leftsemi"
    )


class PhraseIndex:
    """Candidates, phrases and proximities of benchmark items in texts (key, text); equal texts share a key."""

    def __init__(self, texts: DataFrame, items: DataFrame, window: int = WINDOW):
        self.texts, self.window = texts, window
        self.items = stage_table(benchmark_items(items), "items")
        asked = self.items.select(F.explode("words").alias("term")).distinct()
        counts = stage_table(term_counts(texts, asked), "term_counts")
        self.anchors = stage_table(window_anchors(self.items, counts, window), "anchors")
        places = self.items.select("item", F.posexplode("words").alias("offset", "term"))
        wanted = self.anchors.select("item", F.explode(F.array("first", "second")).alias("offset")).distinct()
        self.places = stage_table(places.join(wanted, ["item", "offset"]), "places")
        self.postings = stage_table(postings(texts, self.places.select("term").distinct()), "postings")

    def lists(self) -> DataFrame:
        """(key, item, diagonal, offset): postings less the offset of their word in the item."""
        return self.postings.join(self.places, "term").select(
            "key", "item", (F.col("at") - F.col("offset")).alias("diagonal"), "offset"
        )

    def alignments(self) -> DataFrame:
        """(key, item, diagonal) at which both rarest words of some window stand."""
        # written first: a join of two scans is one whose hot items adaptive execution splits
        rare = stage_table(
            self.anchors.groupBy("item").agg(F.collect_set(F.struct("first", "second")).alias("pairs")), "rare"
        )
        return (
            self.lists()
            .groupBy("key", "item", "diagonal")
            .agg(F.collect_set("offset").alias("offsets"))
            .join(rare, "item")
            .where(
                F.exists(
                    "pairs",
                    lambda p: F.array_contains("offsets", p["first"]) & F.array_contains("offsets", p["second"]),
                )
            )
            .select("key", "item", "diagonal")
        )

    def phrases(self) -> DataFrame:
        """(key, item_id, begin, stop): word runs of a text that equal a whole window of an item."""
        found = stage_table(self.alignments(), "alignments")
        rows = (
            self.texts.join(found, "key")
            .join(self.items, "item")
            .select("key", "item_id", "diagonal", "words", words_of(F.col("text")).alias("text_words"))
            .withColumn("length", F.least(F.size("words"), F.lit(self.window)))
        )
        starts = F.filter(
            F.sequence(F.lit(0), F.size("words") - F.col("length")),
            lambda s: (F.col("diagonal") + s >= 0)
            & (
                F.slice("text_words", F.greatest(F.col("diagonal") + s, F.lit(0)) + 1, F.col("length"))
                == F.slice("words", s + 1, F.col("length"))
            ),
        )
        return (
            rows.select("key", "item_id", "length", "diagonal", F.explode(starts).alias("start"))
            .withColumn("begin", F.col("diagonal") + F.col("start"))
            .select("key", "item_id", "begin", (F.col("begin") + F.col("length")).alias("stop"))
        )

    def proximities(self, slack: int = 5) -> DataFrame:
        """(key, item_id, start, at): the two rarest words of a window, at most `slack` places out of step.

        The second list is cut into cells as wide as the slack, so a word is compared
        with its own cell and the two beside it only.
        """
        rare = self.anchors.select("item", "start", "first", "second").distinct()
        step = max(1, slack)
        cell = lambda c: F.floor(F.col(c) / step)
        one = (
            self.lists().withColumnRenamed("offset", "first").withColumnRenamed("diagonal", "one")
            .join(rare, ["item", "first"])
            .withColumn("cell", F.explode(F.array(cell("one") - 1, cell("one"), cell("one") + 1)))
        )
        two = self.lists().withColumnRenamed("offset", "second").withColumn("cell", cell("diagonal"))
        return (
            one.join(two, ["key", "item", "second", "cell"])
            .where(F.abs(F.col("one") - F.col("diagonal")) <= slack)
            .join(self.items.select("item", "item_id"), "item")
            .select("key", "item_id", "start", (F.col("one") + F.col("first")).alias("at"))
            .distinct()
        )


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(digest(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of docs."""
    keyed = docs.select("doc_id", digest(F.col("text")).alias("key"), word_count(F.col("text")).alias("n_words"))
    matches = stage_table(PhraseIndex(keyed_texts(docs), benchmark, window).phrases().distinct(), "matches")
    hits = (
        matches.select("key", F.explode(F.expr("sequence(begin, stop - 1)")).alias("at"))
        .distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    )
    items = matches.select("key", "item_id").distinct().groupBy("key").agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids")
    )
    found = stage_table(hits.join(items, "key"), "contaminated")
    none = F.lit(0).cast("long")
    return keyed.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in whose text no window of the benchmark occurs."""
    matches = stage_table(
        PhraseIndex(keyed_texts(docs), benchmark, window).phrases().select("key").distinct(), "contaminated"
    )
    key = unused(docs.columns, "_key")
    return docs.withColumn(key, digest(F.col("text"))).join(
        matches.withColumnRenamed("key", key), key, "leftanti"
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
