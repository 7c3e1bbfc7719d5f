"""Entry points that put operators together, from a prompt to an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweft.functions import text as T
from lumenweft.operators import listings, search
from lumenweft.plans import inverted
from lumenweft.sources import files


def _story_tokens(store: DataFrame) -> Column:
    parts = [T.blank(F.col(c)) if c in store.columns else F.lit("") for c in ("summary", "rich_descriptive_paragraph")]
    words = F.array_join("keywords", " ") if "keywords" in store.columns else F.lit("")
    return search.story_tokens(T.blank(F.col("title")), *parts, words)


def index_stories(store: DataFrame, path: str, id_col: str = "record_id") -> dict:
    """A stored index over the stories' texts, for ``search_stories``."""
    return inverted.build_index(store, path, id_col, _story_tokens(store))


def search_stories(store: DataFrame, prompt: str, top_k: int = 5, embedder: Callable[[str], list[float]] | None = None, id_col: str = "record_id", index: str | None = None) -> DataFrame:
    """The stories nearest to a prompt: by vector if there is an embedder, else by TF-IDF over title, summary,
    paragraph and keywords, by the ``index`` stored for them if one is named. Guards come before any plan is made."""
    query = search.check_search(prompt, top_k)
    if embedder is not None:
        return search.vector_top_k(store, embedder(query), top_k, id_col)
    if index is not None:
        found = inverted.search_index(store.sparkSession, index, query, top_k)
    else:
        found = search.lexical_top_k(store, query, top_k, id_col, _story_tokens(store))
    return store.join(F.broadcast(found.select(F.col("id").alias(id_col), F.col("score").alias("vector_similarity"))), id_col).orderBy(F.desc("vector_similarity"))


def intent_prompt(intent: dict) -> str:
    """What is searched for an intent: its query and keywords."""
    return " ".join([intent["query"], *intent["keywords"]])


def intent_prompts(query: Column, keywords: Column) -> Column:
    """The same, for columns."""
    return F.array_join(F.concat(F.array(query), keywords), " ")


def combine_exports(spark, folder: str) -> DataFrame:
    """All posts of a folder, the first of each identity, preferred columns first."""
    rows = files.read_folder(spark, folder)
    once = listings.keep_first(rows, listings.identity(rows.drop("ordinal")), "ordinal").drop("ordinal")
    return once.select(*listings.ordered_columns(once.columns))
