"""Curation of posts: union, identity, deduplication in a given order, extraction, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T


def _column(df: DataFrame, name: str) -> Column:
    return T.blank(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def identity(df: DataFrame) -> Column:
    """What makes a post the same post: its first link (with the key's name), else a digest of text, time, author and
    group, else a digest of the whole row."""
    out = F.concat(F.lit("row:"), F.sha1(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))))
    for key in reversed([k for k in fixed.TEXT_KEYS if k in df.columns]):
        parts = [T.strip(_column(df, k)) for k in (key, *fixed.FALLBACK_KEYS)]
        out = F.when(T.strip(_column(df, key)) != "", F.concat(F.lit("fallback:"), F.sha1(F.concat_ws("|", *parts)))).otherwise(out)
    for key in reversed([k for k in fixed.URL_KEYS if k in df.columns]):
        link = T.strip(_column(df, key))
        out = F.when(link != "", F.concat(F.lit(key + ":"), link)).otherwise(out)
    return out


def keep_first(df: DataFrame, key: Column, *order: str, last: bool = False) -> DataFrame:
    """Of the rows with one key the first (or last) in the given order; not an arbitrary one."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    ranked = df.withColumn("_key", key).withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(*by)))
    return ranked.where("_rn = 1").drop("_key", "_rn")


def ordered_columns(columns: list[str]) -> list[str]:
    """Preferred columns that exist, then the others by name."""
    first = [c for c in fixed.FIRST_COLUMNS if c in columns]
    return first + sorted(set(columns) - set(first))


def filter_listings(posts: DataFrame, *order: str, months: str = fixed.MONTHS, limit: int = 20_000) -> DataFrame:
    """Qualifying listings of posts (author, timestamp, postUrl, text, source_file), deduplicated before they are filtered.

    The first post of a link, or of author and the text's first 200 characters, stands for it even if it is rejected. A
    column ``Post URL`` has the link where postUrl is empty or not there.
    """
    text = T.blank(F.col("text"))
    url = F.coalesce(F.nullif(_column(posts, "postUrl"), F.lit("")), _column(posts, "Post URL"))
    key = F.when(url != "", url).otherwise(F.concat(T.blank(F.col("author")), F.lit("|"), F.substring(text, 1, 200)))
    once = keep_first(posts, key, *order)
    amount = F.replace(F.regexp_extract(text, fixed.RENT, 1), F.lit(","), F.lit(""))
    kept = once.where(text.rlike(fixed.KIND) & T.blank(F.col("timestamp")).rlike(months) & (amount != "") & (amount.try_cast("bigint") < limit))
    place = T.strip(F.regexp_extract(text, fixed.PLACE, 1))
    bathroom = F.when(text.rlike(fixed.BATHROOM), "Private/attached").when(text.rlike(fixed.SHARED_BATHROOM), "Shared").otherwise(fixed.NO_BATHROOM)
    return kept.select(
        T.blank(F.col("author")).alias("poster_name"),
        F.when(text.rlike(fixed.PLACE), place).otherwise(fixed.NO_PLACE).alias("google_map_location"),
        bathroom.alias("private_bathroom"),
        T.blank(F.col("timestamp")).alias("post_date"),
        url.alias("post_link"),
        amount.cast("bigint").alias("room_rent_including_maintenance_inr"),
        T.contacts(text).alias("contact_number"),
        F.substring(text, 1, 1500).alias("additional_requirements"),
        F.concat(F.regexp_extract(text, fixed.KIND, 1), F.lit("BHK")).alias("bhk"),
        T.blank(F.col("source_file")).alias("source_file"),
    )


def merge_listings(base: DataFrame, detail: DataFrame, keep_commas: bool = False) -> DataFrame:
    """Base posts (first of a link) with details (last of a link); defaults stand only where no detail matches.

    ``base``: ordinal, poster, link, bath, rent, gender; ``detail``: ordinal, link, place, bathroom, needs, contact. Rupee
    signs read in a wrong encoding are mended.
    """
    left = keep_first(base.withColumn("link", T.blank(F.col("link"))), F.col("link"), "ordinal")
    right = keep_first(detail.withColumn("link", T.blank(F.col("link"))), F.col("link"), "ordinal", last=True)
    right = right.select("link", "place", "bathroom", "needs", "contact", F.lit(True).alias("matched"))
    joined = left.join(right, "link", "left")
    given = lambda column, default: F.when(F.col("matched").isNull(), default).otherwise(T.blank(F.col(column)))
    poster, place, needs = (mojibake(c) for c in (T.blank(F.col("poster")), given("place", F.lit("Not available")), given("needs", F.lit("Not specified"))))
    rent = T.blank(F.col("rent"))
    return joined.select(
        F.replace(poster, F.lit(" · Follow"), F.lit("")).alias("poster_name"),
        place.alias("place"),
        given("bathroom", F.coalesce("bath", F.lit("Not stated"))).alias("bathroom"),
        (rent if keep_commas else F.replace(rent, F.lit(","), F.lit(""))).alias("rent"),
        T.blank(F.col("gender")).alias("gender"),
        needs.alias("needs"),
        given("contact", F.lit("N/A")).alias("contact"),
        "link",
    )


def mojibake(c: Column) -> Column:
    """A rupee sign that was read in the wrong encoding."""
    return F.replace(c, F.lit("â‚¹"), F.lit("₹"))
