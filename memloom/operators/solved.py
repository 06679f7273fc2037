"""Solved problems: keyword postings and search. problems: id, title, root_cause, fix, tags (array), created_at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings as PO
from .retrieval import top


def keyword_index(problems: DataFrame) -> DataFrame:
    """K8: keyword, id: a row a posting (a keyword of every problem is no single row): tags and title words beyond one character, cleaned of signs."""
    title = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+"), lambda w: F.length(w) > 1)
    words = F.transform(F.concat(F.coalesce("tags", F.array().cast("array<string>")), title), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9çğıöşü-]", ""))
    return problems.select("id", F.explode(F.array_distinct(F.filter(words, lambda w: w != ""))).alias("keyword")).select("keyword", "id")


def search_solved(problems: DataFrame, keywords: DataFrame, most: int | None = None) -> DataFrame:
    """K7: query_id, id, hits: problems that hold a keyword in title, cause, fix or tags, or whose index keys and the keyword hold one another.

    keywords: query_id, keyword. All three tests are postings of character runs; distinct keys, not problems, meet the keywords.
    With `most`, each query's newest problems up to that number, and their place.
    """
    none = F.array().cast("array<string>")
    text = F.lower(F.concat_ws(" ", F.concat(F.array(*(F.coalesce(c, F.lit("")) for c in ("title", "root_cause", "fix"))), F.coalesce("tags", none))))
    asked = keywords.select("query_id", F.lower("keyword").alias("_kw"))
    words, index = asked.select(F.col("_kw").alias("term")).distinct(), keyword_index(problems)
    keys = index.select(F.col("keyword").alias("id"), F.col("keyword").alias("text")).distinct()
    whole = PO.holders(problems.select("id", text.alias("text")), words).select(F.col("term").alias("_kw"), "id")
    inside = PO.containing(keys, words).select(F.col("term").alias("_kw"), F.col("id").alias("keyword"))
    around = PO.containing(words.select(F.col("term").alias("id"), F.col("term").alias("text")), keys.select(F.col("text").alias("term"))).select(F.col("id").alias("_kw"), F.col("term").alias("keyword"))
    by_key = inside.unionByName(around).distinct().join(index, "keyword").select("_kw", "id")
    found = asked.join(whole.unionByName(by_key).distinct(), "_kw").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    if most is None:
        return found
    return top(found.join(problems.select("id", "created_at"), "id"), most, F.desc("created_at"), F.asc("id"), name="place").drop("created_at")
