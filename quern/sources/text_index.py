"""An inverted index of texts that is kept, ranked search over it, and titles near a misspelt one.

Postings (term, id, how often, length of the text) lie in folders by a hash of the term and are sorted by
term within a file, so a search opens the folders of its words and reads the row groups that may hold
them.  A term that a third of all texts have is no hot key: its postings are dealt by id as well, over as many
files as a folder has.

Ranking is BM25.  Rare words are read first; if what frequent words can add at most (each term's bound is
kept) cannot lift a text without any rare word among the best, frequent words are read for the candidates
alone, and the ranks are the same."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.batches import bounded, slices

#: Fixed values of the ranking: how soon repetition saturates, how much length counts.
K1, B = 1.2, 0.75
#: Folders of the postings; the share of texts from which on a word is frequent.
FOLDERS, FREQUENT = 64, 0.1
#: A word: letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
#: In place of a term: the row that says how long a text is.  No word is empty.
LENGTH = ""


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _folder(term: Column) -> Column:
    return F.when(term == LENGTH, F.lit(-1)).otherwise(F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int"))


def counted(batches):
    """Postings (term, id, n, size) of texts (id, text), in parts by the bytes of the texts."""
    for b in slices(batches, 1):
        ids, terms, n, sizes = [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            own = Counter(words(text))
            size = sum(own.values())
            own[LENGTH] = size
            ids += [i] * len(own)
            terms += own
            n += own.values()
            sizes += [size] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int32()), pa.array(sizes, pa.int32())], names=["term", "id", "n", "size"])


@dataclass
class TextIndex:
    """`postings/folder=...`, `terms/folder=...` and `about`, all under one path."""

    spark: SparkSession
    path: str

    def build(self, docs: DataFrame, id_col: str = "title", text_col: str = "content") -> TextIndex:
        """Index every row's whole text.  A null text is an empty one; rows without an id are left out; of
        rows with one id the scores add up.  One shuffle: counts are made where a text lies."""
        kind = docs.schema[id_col].dataType.simpleString()
        bounded(self.spark)

        rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        rows = rows.mapInArrow(counted, f"term string, id {kind}, n int, size int").withColumn("folder", _folder(F.col("term")))
        dealt = rows.repartition(parts * FOLDERS, "folder", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("folder", "term", "id")
        dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/postings")
        total = self._read("postings", f"term string, id {kind}, n int, size int, folder int").where("folder = -1").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("words")).first()
        about = {"texts": total["texts"], "mean": (total["words"] or 0) / max(1, total["texts"]) or 1.0, "id": kind}
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")
        terms = self.postings().where("folder >= 0").groupBy("folder", "term").agg(F.count(F.lit(1)).alias("texts"), F.max(self.impact()).alias("most"))
        terms.sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/terms")
        return self

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def about(self) -> dict:
        return json.loads(self._read("about", "about string").first()[0])

    def postings(self) -> DataFrame:
        return self._read("postings", f"term string, id {self.about()['id']}, n int, size int, folder int")

    def terms(self) -> DataFrame:
        return self._read("terms", "term string, texts long, most double, folder int")

    def impact(self) -> Column:
        """What a posting adds to its text's score, but for the word's weight."""
        n = F.col("n").cast("double")
        return n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("size") / F.lit(self.about()["mean"])))

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of some terms: their folders are opened, and the terms are pushed to the files."""
        where = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_folder(F.col("term")).alias("f")).distinct()
        return table.where(F.col("folder").isin([r["f"] for r in where.collect()]) & F.col("term").isin(terms))  # as many as a query has words

    def weights(self, terms: list[str]) -> dict[str, tuple[float, float, int]]:
        """{word: (weight, most that it adds, texts with it)} of the words that occur."""
        if not terms:
            return {}
        n = self.about()["texts"]
        rows = self._of(self.terms(), terms).collect()  # a row for each word
        weight = lambda k: log(1 + (n - k + 0.5) / (k + 0.5))
        return {r["term"]: (weight(r["texts"]), weight(r["texts"]) * r["most"], r["texts"]) for r in rows}

    def _scored(self, known: dict, terms: list[str]) -> DataFrame:
        """(id, score) of each text that has one of the terms, by these terms alone."""
        weight = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, known[t][0])]), F.col("term"))
        return self._of(self.postings(), terms).select("id", (weight * self.impact()).alias("part")).groupBy("id").agg(F.sum("part").alias("score"))

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"id {self.about()['id']}, score double")

    def search(self, query: str, results: int = 2) -> DataFrame:
        """(id, score): the best texts for the words of a query, ties (nine digits) to the smaller id."""
        known = self.weights(sorted(set(words(query))))
        if not known or results < 1:
            return self._none()
        order = [F.desc(F.round("score", 9)), "id"]
        often = sorted(t for t, k in known.items() if k[2] > FREQUENT * self.about()["texts"])
        rare = sorted(set(known) - set(often))
        if often and rare:
            some = self._scored(known, rare)
            best = some.orderBy(*order).limit(results).collect()
            more = sum(known[t][1] for t in often)
            if len(best) == results and best[-1]["score"] > more + 1e-9:  # without a rare word none comes this far
                able = some.where(F.col("score") >= best[-1]["score"] - more - 1e-9)
                rest = self._of(self.postings(), often).join(able.select("id"), "id", "left_semi")
                weight = F.element_at(F.create_map(*[F.lit(x) for t in often for x in (t, known[t][0])]), F.col("term"))
                rest = rest.select("id", (weight * self.impact()).alias("score"))
                return able.unionByName(rest).groupBy("id").agg(F.sum("score").alias("score")).orderBy(*order).limit(results)
        return self._scored(known, sorted(known)).orderBy(*order).limit(results)

    def search_all(self, queries: DataFrame, results: int = 2) -> DataFrame:
        """(query_id, id, score): search() for many queries (query_id, text) at once, by joins; queries that
        find nothing have no row."""

        def split(batches):
            for b in slices(batches, 1):
                own = [sorted(set(words(t))) for t in b.column(1).to_pylist()]
                which = pa.array([i for i, w in enumerate(own) for _ in w], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array([x for w in own for x in w], pa.string())], names=["query_id", "term"])

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", "text").mapInArrow(split, f"query_id {kind}, term string").withColumn("folder", _folder(F.col("term")))
        n, k = F.lit(float(self.about()["texts"])), F.col("texts")
        asked = asked.join(self.terms().select("folder", "term", F.log(1 + (n - k + 0.5) / (k + 0.5)).alias("weight")), ["folder", "term"])
        parts = self.postings().join(asked, ["folder", "term"]).select("query_id", "id", (F.col("weight") * self.impact()).alias("part"))
        scored = parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
        first = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        return scored.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= results).drop("_r")


# ---------------------------------------------------------------- titles near a misspelt one

#: Edits that a suggestion is away at most; a text is cut in one piece more, so that one is left whole.
EDITS = 2
#: Digits of a title that are kept apart from its frame, at most; a title with more is a frame as it is.
DIGITS = 12


def _piece(size: Column, no: Column) -> tuple[Column, Column]:
    """(where the piece of a text of that size begins, from 0, and its size)."""
    begin = F.floor(no * size / (EDITS + 1)).cast("int")
    return begin, F.floor((no + 1) * size / (EDITS + 1)).cast("int") - begin


def _each(low: int, high: int) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(low, high + 1)]))


def _form(low: Column, whole: bool) -> Column:
    """A text as (frame, digits, whole): without its digits and these alone, or as it is."""
    frame, digits = (low, F.lit("")) if whole else (F.regexp_replace(low, "[0-9]", ""), F.regexp_replace(low, "[^0-9]", ""))
    return F.struct(frame.alias("frame"), digits.alias("digits"), F.lit(whole).alias("whole"))


def _digits(low: Column) -> Column:
    return F.length(F.regexp_replace(low, "[^0-9]", ""))


def _lessened(text: Column, most: Column) -> Column:
    """The text with up to `most` (2 at most) of its characters left out: an array of (rest, dropped)."""
    n = F.length(text)
    without = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n))
    two = lambda i, j: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), F.substring(text, j + 1, n))
    row = lambda rest, k: F.struct(rest.alias("rest"), F.lit(k).alias("dropped"))
    same = F.array(row(text, 0))
    no = F.filter(same, lambda x: F.lit(False))
    ones = F.transform(F.sequence(F.lit(1), n), lambda i: row(without(i), 1))
    twos = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: row(two(i, j), 2))))
    return F.array_distinct(F.concat(same, F.when((most >= 1) & (n >= 1), ones).otherwise(no), F.when((most >= 2) & (n >= 2), twos).otherwise(no)))


def _dropped(apart: Column, longer: Column) -> Column:
    """How many digits a text may lose at most on the way to what both have in common, where the other's frame is
    `apart` edits away and `longer` characters longer: an edit of a frame alone takes no digit, and one that
    changes a digit into another character makes the other's frame longer."""
    is_ = lambda c: c.cast("int")
    return F.when(apart == 0, F.lit(2)).when(apart == 1, 1 + is_(longer == 1)).otherwise(is_(longer >= 0) + is_(longer == 2))


@dataclass
class TitleIndex:
    """Titles by their frames and digits: (size, no, piece, frame, whole) in `pieces/folder=...`, (key, dropped, title) in
    `titles/folder=...`, both under a path.

    A frame is a title without its digits: many titles differ in a number alone (addresses, volumes, years).
    Two titles within EDITS edits have frames within EDITS edits, and these share a piece: of EDITS + 1 pieces
    one has no edit, and it stands in the other frame at most EDITS places away.  Their digits are equal once
    at most EDITS are left out of each.  So a title is found by a frame near the query's together with what is
    left of the digits (key: a hash of both), and titles of one frame meet only if their numbers are alike.
    How many are left out is bounded by the edits: one that puts a digit for a digit leaves one out on both sides,
    one that touches a frame leaves one out on one side at most."""

    spark: SparkSession
    path: str

    def build(self, titles: DataFrame, title_col: str = "title") -> TitleIndex:
        own = titles.select(F.col(f"`{title_col}`").alias("title")).where("title is not null").distinct()
        low, no = F.lower("title"), F.col("no")
        own = own.select("title", F.when(_digits(low) <= DIGITS, _form(low, False)).otherwise(_form(low, True)).alias("form")).select("title", "form.*")

        begin, size = _piece(F.length("frame"), no)
        frames = own.select("frame", "whole").distinct().withColumn("no", _each(0, EDITS))
        rows = frames.select(F.length("frame").alias("size"), "no", F.substring("frame", begin + 1, size).alias("piece"), "frame", "whole")
        rows = rows.withColumn("folder", F.pmod(F.xxhash64("piece"), F.lit(FOLDERS)).cast("int"))
        rows.hint("rebalance", "folder").sortWithinPartitions("folder", "size", "no", "piece").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/pieces")

        rows = own.select("title", "frame", "whole", F.explode(_lessened(F.col("digits"), F.lit(EDITS))).alias("x"))
        rows = rows.select(F.xxhash64("frame", "whole", "x.rest").alias("key"), F.col("x.dropped").cast("byte").alias("dropped"), "title")
        rows = rows.withColumn("folder", F.pmod("key", F.lit(FOLDERS)).cast("int"))
        rows.hint("rebalance", "folder").sortWithinPartitions("folder", "key").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/titles")
        return self

    def _frames(self, asked: DataFrame) -> DataFrame:
        """(frame, whole, other, apart): for each frame asked for, the frames of titles within EDITS edits."""
        pieces = self.spark.read.schema("size int, no int, piece string, frame string, whole boolean, folder int").parquet(f"{self.path}/pieces")
        d, shift = F.col("d"), F.col("shift")
        asked = asked.withColumn("d", _each(-EDITS, EDITS)).withColumn("size", F.length("frame") + d)
        asked = asked.where("size >= 0").withColumn("no", _each(0, EDITS)).withColumn("shift", _each(-EDITS, EDITS))
        asked = asked.where(F.abs(shift) + F.abs(d + shift) <= EDITS)  # edits before the piece, and after it
        begin, size = _piece(F.col("size"), F.col("no"))
        at = begin + shift
        asked = asked.where((at >= 0) & (at + size <= F.length("frame"))).select("frame", "whole", "size", "no", F.substring("frame", at + 1, size).alias("piece")).distinct()
        asked = asked.withColumn("folder", F.pmod(F.xxhash64("piece"), F.lit(FOLDERS)).cast("int"))
        pairs = asked.join(pieces.withColumnRenamed("frame", "other"), ["folder", "size", "no", "piece", "whole"]).select("frame", "whole", "other").distinct()
        return pairs.withColumn("apart", F.levenshtein("frame", "other", EDITS)).where("apart >= 0")

    def near(self, queries: DataFrame, most: int = 3) -> DataFrame:
        """(query_id, rank, title, edits): the nearest titles of each query (query_id, text) within EDITS edits,
        letter case aside, ties in order of title; `most` for each.  Queries of one text are looked up once."""
        titles = self.spark.read.schema("key long, dropped byte, title string, folder int").parquet(f"{self.path}/titles")
        low = F.col("text")
        asked = queries.where("text is not null").select("query_id", F.lower("text").alias("text")).distinct()
        # A title that is a frame as it is has more than DIGITS digits, and a query near it two less at most.
        some = F.when(_digits(low) <= DIGITS + EDITS, _form(low, False)), F.when(_digits(low) > DIGITS - EDITS, _form(low, True))
        texts = asked.select("text").distinct().select("text", F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("form")).select("text", "form.*")

        found = texts.join(self._frames(texts.select("frame", "whole").distinct()), ["frame", "whole"])
        apart, longer = F.col("apart"), F.length("other") - F.length("frame")
        left = found.select("text", "other", "whole", "apart", longer.alias("longer"), F.explode(_lessened(F.col("digits"), _dropped(apart, longer))).alias("x"))
        able = F.least(_dropped(apart, -F.col("longer")), 2 * EDITS - apart - F.col("x.dropped"))
        left = left.select("text", F.xxhash64("other", "whole", "x.rest").alias("key"), able.alias("able"))
        left = left.where("able >= 0").withColumn("folder", F.pmod("key", F.lit(FOLDERS)).cast("int"))
        pairs = left.join(titles, ["folder", "key"]).where("dropped <= able").select("text", "title", F.levenshtein("text", F.lower("title"), EDITS).alias("edits"))
        pairs = pairs.where("edits >= 0").distinct()

        order = ["edits", "title"]
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(*order))).where(F.col("rank") <= most).drop("rank")
        first = Window.partitionBy("query_id").orderBy(*order)
        return asked.join(best, "text").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select("query_id", "rank", "title", "edits")


def search_with_suggestion(index: TextIndex, titles: TitleIndex, query: str, results: int = 2) -> tuple[DataFrame, str | None]:
    """The hits of a query, and the title nearest to it where one is near and not the query itself."""
    asked = index.spark.createDataFrame([(0, query)], "query_id int, text string")
    near = titles.near(asked, 1).where(F.col("edits") > 0).first()
    return index.search(query, results), near["title"] if near else None
