"""Requests that a model answers: intent, features, final recommendation. The model is any function from text to text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.operators import recommend
from lumenweft.session import ship

Generate = Callable[[str], str]


class Unavailable(Exception):
    """The model can't be reached; a local fallback may answer instead."""


def check_intent(spark, text: str, generate: Generate) -> dict:
    """Intent, keywords and query of a request; if the model is unavailable, keywords are taken from the text."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("The request is empty.")
    try:
        answer = generate(text)
    except Unavailable:
        words = spark.range(1).select(T.fallback_keywords(F.lit(text)).alias("w")).first().w
        return {"intent": "story search", "keywords": words, "query": text, "user_input": text}
    return recommend.clean_intent(recommend.parse_object(answer), text)


def recommendation(candidates: DataFrame, prompt: str, generate: Generate) -> DataFrame:
    """One row: the model's choice among one to five candidates, title and link from the candidate; or the fallback."""
    ids = [r.record_id for r in candidates.select("record_id").limit(6).collect()]
    recommend.check_candidates(prompt, ids)
    try:
        answer = generate(prompt)
    except Unavailable:
        return recommend.fallback(candidates, prompt)
    value = json.loads(answer)
    reasons = value.get("emotional_match_reasons")
    row = (1, str(value.get("recommended_record_id", "")), value.get("pitch_script"), [str(r) for r in reasons] if isinstance(reasons, list) else None)
    out = recommend.resolve(candidates, candidates.sparkSession.createDataFrame([row], "request_id long, record_id string, pitch string, reasons array<string>"))
    if not out.first().valid:
        raise ValueError("The model's answer is not a usable choice among the candidates.")
    return out.drop("request_id", "valid")


FEATURES = "rich_descriptive_paragraph string, keywords array<string>, emotional_scores map<string,double>, error string"
MOST_SUMMARY = 12_000


def checked_features(value: object) -> dict:
    """Features as they are stored, or ValueError."""
    if not isinstance(value, dict):
        raise ValueError("no object")
    text, words, scores = (value.get(k) for k in ("rich_descriptive_paragraph", "keywords", "emotional_scores"))
    if not isinstance(text, str) or not text.strip():
        raise ValueError("no paragraph")
    if not isinstance(words, list) or not 5 <= len(words) <= 8 or any(not str(w).strip() for w in words):
        raise ValueError("keywords")
    if not isinstance(scores, dict) or set(scores) != set(fixed.AXES) or not all(0.0 <= float(v) <= 1.0 for v in scores.values()):
        raise ValueError("scores")
    return {"rich_descriptive_paragraph": text.strip(), "keywords": [str(w).strip().lower() for w in words], "emotional_scores": {k: float(v) for k, v in scores.items()}}


def extract_features(stories: DataFrame, generate: Generate, attempts: int = 2) -> DataFrame:
    """``stories`` (summary, ...) with features or, after ``attempts``, ``error``; a missing summary is not tried again."""
    from pyspark.sql.types import StructType

    ship(stories.sparkSession)
    schema = StructType([*stories.schema.fields, *StructType.fromDDL(FEATURES).fields])

    def one(summary: str | None) -> dict:
        why = "no summary"
        for _ in range(attempts if summary and summary.strip() else 0):
            try:
                return checked_features(json.loads(generate(summary[:MOST_SUMMARY]))) | {"error": None}
            except Exception as problem:  # noqa: BLE001  the model's fault, kept with the row
                why = f"{type(problem).__name__}: {problem}"
        return {"rich_descriptive_paragraph": None, "keywords": None, "emotional_scores": None, "error": why}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([one(s) for s in frame["summary"]], index=frame.index, columns=["rich_descriptive_paragraph", "keywords", "emotional_scores", "error"])
            yield pd.concat([frame, found], axis=1)

    return stories.mapInPandas(run, schema)


def processed(stories: DataFrame) -> DataFrame:
    """Stories (ordinal, record_id, cmu_id, title, summary, features) with stable id, content hash and search payload."""
    title, summary = F.col("title"), F.col("summary")
    named = F.coalesce(F.nullif(T.strip(T.blank(title)), F.lit("")), F.lit("Untitled"))
    return stories.withColumns({
        "source_record_hash": T.content_hash(title, summary),
        "search_payload": T.search_payload(named, F.col("keywords"), F.col("rich_descriptive_paragraph")),
        "record_id": T.stable_id(F.col("record_id"), F.col("cmu_id"), F.col("ordinal"), title, summary),
    })


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def canonical(text: Column) -> Column:
    """NFC and single spaces, for a column. There is no expression for NFC: texts with more than ASCII go to Python, the
    others stay where they are."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(text.isNull(), None).when(plain, T.squeeze(text)).otherwise(_composed(F.when(~plain, text)))
