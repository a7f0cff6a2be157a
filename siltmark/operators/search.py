"""Search of findings for many queries at once, by an inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .findings import SYNONYMS

#: Longest beginning of a term by which words that hold it are looked up.
GRAM = 3
FIELDS = ("title", "detail", "location", "category", "severity", "scanner")
#: Findings of the same words and category that are handed out together, at most about so many.
CHUNK = 100_000


def _split(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9_]+"), lambda w: w != "")


def _grams(word: Column) -> Column:
    """All different pieces of 1 to GRAM characters of a word."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda k: F.substr(word, k, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*(F.when(F.length(word) >= n, at(n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)))))


def _beginnings(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.substr(word, F.lit(1), k))


def _near(word: Column) -> Column:
    """A word and what is left of it without any one character: two words one edit apart share one of these."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substr(word, F.lit(1), k - 1), F.substr(word, k + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def _distance_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


@dataclass(frozen=True)
class Index:
    """Findings of the same words and category are one text. members: (keys, body) of every finding; rows (body, category) and postings (body, word) of texts; grams (gram, word) and near (piece, word) of each different word."""

    keys: tuple[str, ...]
    members: DataFrame
    rows: DataFrame
    postings: DataFrame
    grams: DataFrame
    near: DataFrame


def build(findings: DataFrame, keys: tuple[str, ...] = ("repo_id", "id")) -> Index:
    """Index findings by the words of their fields. keys must tell rows apart; of rows that are equal in them, the words count together."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in FIELDS)))
    each = findings.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(_split(text))))).alias("words"), F.array_sort(F.collect_set("category")).alias("categories"))
    body = F.unhex(F.sha2(F.to_json(F.struct("words", "categories")), 256))
    members = checkpointed(each.select(*keys, "words", "categories", body.alias("body")))
    texts = checkpointed(members.groupBy("body").agg(F.any_value("words").alias("words"), F.any_value("categories").alias("categories")))
    postings = texts.select("body", F.explode("words").alias("word"))
    words = checkpointed(postings.select("word").distinct())
    return Index(keys, members.select(*keys, "body"), texts.select("body", F.explode("categories").alias("category")), postings, words.select(F.explode(_grams(F.col("word"))).alias("gram"), "word"), words.select(F.explode(_near(F.col("word"))).alias("piece"), "word"))


def _handed_out(index: Index, hit: DataFrame) -> DataFrame:
    """Rows of texts (body, ...) for every finding of each text. Texts of many findings are handed out in several parts."""
    parts = F.ceil(F.count("*") / CHUNK).cast("int").alias("_parts")
    large = F.broadcast(index.members.groupBy("body").agg(parts).filter("_parts > 1"))  # at most one for CHUNK findings
    every = F.coalesce("_parts", F.lit(1))
    own = index.members.join(large, "body", "left").withColumn("_part", F.pmod(F.xxhash64(*index.keys), every).cast("int")).drop("_parts")
    spread = hit.join(large, "body", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), every - 1))).drop("_parts")
    return spread.join(own, ["body", "_part"])


def _holding(index: Index, terms: DataFrame) -> DataFrame:
    """(term, word) of words that hold a term, found by the term's first characters."""
    asked = terms.withColumn("gram", F.substr("term", F.lit(1), F.lit(GRAM)))
    return asked.join(index.grams, "gram").filter(F.col("word").contains(F.col("term"))).select("term", "word")


def _categories(terms: DataFrame) -> DataFrame:
    """(term, category) of terms that begin a word which stands for the category, or begin with one."""
    known = terms.sparkSession.createDataFrame([(c, s) for c, words in SYNONYMS.items() for s in words.split()], "category string, synonym string")
    begins = known.select("category", F.explode(_beginnings(F.col("synonym"))).alias("term")).distinct()
    longer = terms.select("term", F.explode(_beginnings(F.col("term"))).alias("synonym"))
    return terms.join(F.broadcast(begins), "term").select("term", "category").unionByName(longer.join(F.broadcast(known), "synonym").select("term", "category")).distinct()


def search_all(index: Index, queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, keys, relevance) of every finding in which every term of a query is found, as findings.search gives it for each query apart.

    Queries (one text column) meet the index by their terms: words that hold a term by its first characters, words that a term begins with by its beginnings, words one edit away by pieces with a
    character left out; texts only by such words, each once, however many findings have it. Queries without a term, which findings.search answers with everything, have no rows here; a null one is such a query. Equal queries count once.
    """
    asked = queries.select(F.col(query).alias("query")).filter("query is not null").distinct()
    terms = checkpointed(asked.select("query", F.explode(_split(F.lower(F.trim("query")))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")))
    each = checkpointed(terms.select("term").distinct())
    points = lambda df, n: df.select("term", "word", F.lit(n).alias("points"))
    held = points(_holding(index, each), 3)
    words = index.postings.select("word").distinct()
    begun = points(each.select("term", F.explode(_beginnings(F.col("term"))).alias("word")).join(words, "word"), 2)
    pieces = each.filter(F.length("term") >= 4).select("term", F.explode(_near(F.col("term"))).alias("piece"))
    typed = points(pieces.join(index.near, "piece").filter(_distance_one(F.col("word"), F.col("term"))).distinct(), 1)
    best = checkpointed(held.unionByName(begun).unionByName(typed).groupBy("term", "word").agg(F.max("points").alias("points")))
    by_word = best.join(index.postings, "word").select("term", "body", "points")
    cats = checkpointed(_categories(each))
    own = cats.join(index.rows, "category").select("term", "body", F.lit(2).alias("points"))
    synonyms = each.sparkSession.createDataFrame([(c, s) for c, x in SYNONYMS.items() for s in x.split()], "category string, term string")
    hints = synonyms.join(_holding(index, synonyms.select("term").distinct()), "term").select("category", "word").distinct().join(index.postings, "word").select("category", "body").distinct()
    told = cats.join(hints, "category").select("term", "body", F.lit(1).alias("points"))
    found = by_word.unionByName(own).unionByName(told).groupBy("term", "body").agg(F.max("points").alias("points"))
    wanted = terms.groupBy("query").agg(F.count("*").alias("n"))
    hit = terms.join(found, "term").groupBy("query", "body").agg(F.count("*").alias("n"), F.sum(F.col("points") * F.col("times")).alias("relevance"))
    whole = checkpointed(hit.join(wanted, ["query", "n"]).select("query", "body", F.col("relevance").cast("int").alias("relevance")))
    return _handed_out(index, whole).select("query", *index.keys, "relevance")
