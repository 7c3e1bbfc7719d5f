"""A stored inverted index for TF-IDF cosine search, extended by later documents, read only where a query's terms are.

What is on disk:

* ``segments``: the terms of each document and how often it has them, cut once and never changed; an extension adds one.
* ``postings``: blocks of a term's postings (document, frequency over the document's length), in folders by a hash of the
  term, sorted by term. A block holds the documents of one part; parts gather documents of about the same length (so that
  few parts hold the largest weights) and have PART documents at most, give or take. A block knows its largest weight.
* ``documents``: every document's id, length and part.
* a log of versions, each of which names the segments it is made of and its own postings and documents.

Lengths and weights depend on all documents, so a version's postings are made anew from all its segments; texts are not
cut again. A search opens the folders of its terms and reads their blocks' largest weights; a few parts of the largest
possible score are searched for a lower bound, and of the others only the blocks of parts that could reach it are read. The
result is that of a search over everything.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.functions import text as T
from lumenweft.operators.search import idf
from lumenweft.session import delete, scratch
from lumenweft.sources import commits

#: Documents of a part about; folders that postings are dealt to for each so many of them; parts that a search begins with.
PART, POSTINGS_PER_BUCKET, FIRST_PARTS = 1 << 16, 1 << 26, 4
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
#: Relative slack when a bound is compared with a score, as both are sums of rounded numbers.
SLACK = 1e-9


def _log(path: str) -> str:
    return f"{path}/_log"


def _segment(docs: DataFrame, path: str, id_col: str, tokens: Column) -> str:
    """Writes (id, term, tf) of some documents, and their ids, as some have no terms; texts are cut once, ids come from there."""
    folder = f"{path}/segments/{uuid.uuid4().hex}"
    cut = _table(docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")), "tokens")
    cut.select("id").write.parquet(f"{folder}/ids")
    cut.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf")).write.parquet(f"{folder}/terms")
    return folder


def _table(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _publish(spark: SparkSession, path: str, segments: list[str]) -> dict:
    """Writes the postings and documents of some segments; what a version says of them."""
    ids = spark.read.parquet(*(f"{s}/ids" for s in segments))
    postings = spark.read.parquet(*(f"{s}/terms" for s in segments))
    n = ids.count()
    repeated = ids.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).select(F.col("id").cast("string")).take(3)
    if repeated:
        raise ValueError(f"Ids of documents are null or repeat: {[r.id for r in repeated]}")
    df = _table(postings.groupBy("term").agg(F.count("*").alias("df")), "df")
    totals = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.count("*").alias("terms")).first()
    square = (F.col("tf") * idf(F.lit(float(n)), F.col("df"))) ** 2
    # Squares are added in order of size, so that documents of the same terms have the same length to the last bit.
    squares = postings.join(df, "term").groupBy("id").agg(F.sort_array(F.collect_list(square)).alias("s"))
    lengths = squares.select("id", F.greatest(F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)), F.lit(1e-8)).alias("length"))
    lengths = ids.join(lengths, "id", "left").withColumn("tier", F.coalesce(F.floor(2 * F.log2("length")).cast("int"), F.lit(-100)))
    lengths = _table(lengths, "lengths")
    tiers = lengths.groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier").collect()
    first, slices = 0, F.create_map(*(x for r in tiers for x in (F.lit(r.tier), F.lit(-(-r.n // PART))))) if tiers else None
    begins = []
    for r in tiers:
        begins += [F.lit(r.tier), F.lit(first)]
        first += -(-r.n // PART)
    part = F.create_map(*begins)[F.col("tier")] + F.pmod(F.xxhash64("id"), slices[F.col("tier")].cast("long")).cast("int") if tiers else F.lit(0)
    name = uuid.uuid4().hex
    lengths.select("id", "length", part.cast("int").alias("part")).write.parquet(f"{path}/documents/{name}")
    places = spark.read.parquet(f"{path}/documents/{name}")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, totals.postings // POSTINGS_PER_BUCKET))
    weighed = postings.join(places, "id")
    one = F.struct(F.col("id"), (F.col("tf") / F.col("length")).alias("weight"))
    blocks = weighed.groupBy("term", "part").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    blocks = blocks.select("term", "part", F.size("rows").alias("n"), F.array_max(F.col("rows")["weight"]).alias("most"), F.col("rows")["id"].alias("ids"), F.col("rows")["weight"].alias("weights"), bucket_of(F.col("term"), buckets).alias("bucket"))
    blocks.repartitionByRange("bucket", "term", "part").sortWithinPartitions("bucket", "term", "part").write.partitionBy("bucket").parquet(f"{path}/postings/{name}")
    return {"segments": segments, "postings": f"{path}/postings/{name}", "documents": f"{path}/documents/{name}", "n": n, "n_terms": totals.terms, "n_postings": totals.postings, "parts": first, "buckets": buckets, "id": ids.schema["id"].dataType.simpleString()}


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _change(spark: SparkSession, path: str, segment: str, keep: bool) -> dict:
    made: dict | None = None

    def version(number: int, before: dict | None) -> dict:
        nonlocal made
        if made:
            _drop(spark, made)
        made = _publish(spark, path, [*(before["segments"] if before and keep else []), segment])
        return made | {"number": number}

    try:
        return commits.transact(spark, _log(path), version)
    except Exception:
        for folder in [segment, *([made["postings"], made["documents"]] if made else [])]:
            delete(spark, folder)
        raise


def _drop(spark: SparkSession, version: dict) -> None:
    for folder in (version["postings"], version["documents"]):
        delete(spark, folder)


def build_index(docs: DataFrame, path: str, id_col: str, tokens: Column) -> dict:
    """An index of ``docs`` alone at ``path``; returns its version. ValueError if an id is null or repeats: nothing changes
    then. Documents without terms count as documents. Earlier versions stay until ``forget``."""
    return _change(docs.sparkSession, path, _segment(docs, path, id_col, tokens), keep=False)


def extend_index(docs: DataFrame, path: str, id_col: str, tokens: Column) -> dict:
    """Adds ``docs`` to the index at ``path`` (or begins one): frequencies, lengths and weights are those of all documents.

    Two who extend at once come one after the other; no document is lost.
    """
    return _change(docs.sparkSession, path, _segment(docs, path, id_col, tokens), keep=True)


def forget(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all but the last ``keep`` versions, and the segments that none of these has; returns how many versions went."""
    old = commits.forget(spark, _log(path), keep)
    kept = {s for number in commits.numbers(spark, _log(path)) for s in commits.read(spark, _log(path), number)["segments"]}
    for version in old:
        _drop(spark, version)
        for segment in set(version["segments"]) - kept:
            delete(spark, segment)
    return len(old)


def current(spark: SparkSession, path: str) -> dict:
    """The version that counts; ValueError if there is no index."""
    _, version = commits.latest(spark, _log(path))
    if version is None:
        raise ValueError(f"There is no index at {path}.")
    return version


def _postings(spark: SparkSession, version: dict) -> DataFrame:
    schema = f"term string, part int, n int, most double, ids array<{version['id']}>, weights array<double>, bucket int"
    return spark.read.schema(schema).parquet(version["postings"])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, most): every term, in how many documents it is, and its largest weight. No posting is read."""
    blocks = _postings(spark, current(spark, path))
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))


def _terms_of(spark: SparkSession, version: dict, prompt: str) -> tuple[Counter, list[int]]:
    """A prompt's terms and the folders of their postings, by the same expressions as the index; no job is run."""
    terms = T.terms(F.lit(prompt))
    one = spark.sql("select 1").select(terms.alias("t"), F.transform(terms, lambda t: bucket_of(t, version["buckets"])).alias("b")).first()
    return Counter(one.t), sorted(set(one.b))


class Search:
    """A query over one version: its blocks, what each of its terms is worth, and the steps of a search."""

    def __init__(self, spark: SparkSession, version: dict, prompt: str):
        self.spark, self.version, self.prompt = spark, version, prompt
        self.counts, buckets = _terms_of(spark, version, prompt)
        self.names = list(self.counts)
        blocks = _postings(spark, version)
        self.blocks = blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(self.names)) if self.names else blocks.where("false")

    def prepare(self) -> None:
        """Reads in how many documents each term is: one row a term, from the blocks' heads."""
        df = {r.term: r.df for r in self.blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weight = {t: math.log((1.0 + self.version["n"]) / (1.0 + df.get(t, 0))) + 1.0 for t in self.names}
        length = max(math.sqrt(sum((c * weight[t]) ** 2 for t, c in self.counts.items())), 1e-8)
        worth = {t: (j, c * weight[t] ** 2 / length) for j, (t, c) in enumerate(self.counts.items())}
        self.place = F.create_map(*(x for t, (j, _) in worth.items() for x in (F.lit(t), F.lit(j))))[F.col("term")]
        self.gain = F.create_map(*(x for t, (_, g) in worth.items() for x in (F.lit(t), F.lit(g))))[F.col("term")]

    def bounds(self) -> DataFrame:
        """(part, bound): no document of a part scores more. From the blocks' heads."""
        return self.blocks.groupBy("part").agg((F.sum(self.gain * F.col("most")) * (1 + SLACK)).alias("bound"))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """(id, score) of the documents in some blocks, the terms' shares added in the order of the query."""
        each = blocks.select(self.place.alias("j"), self.gain.alias("gain"), F.inline(F.arrays_zip("ids", "weights"))).select(F.col("ids").alias("id"), F.struct("j", (F.col("gain") * F.col("weights")).alias("s")).alias("share"))
        shares = F.sort_array(F.collect_list("share"))
        return each.groupBy("id").agg(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x.s).alias("score"))

    def tie(self) -> Column:
        return F.sha2(F.concat(F.lit(self.prompt), F.lit("\x00"), F.col("id").cast("string")), 256)

    def best(self, scored: DataFrame, k: int) -> DataFrame:
        return scored.orderBy(F.desc("score"), F.desc(self.tie()), F.desc("id")).limit(k)

    def reachable(self, k: int) -> DataFrame:
        """The blocks that can hold one of the k best: those of parts whose bound is not below the k-th best score among the
        FIRST_PARTS parts of the largest bounds."""
        if self.version["parts"] <= FIRST_PARTS:
            return self.blocks
        first = [r.part for r in self.bounds().orderBy(F.desc("bound"), "part").limit(FIRST_PARTS).collect()]
        least = self.scores(self.blocks.where(F.col("part").isin(first))).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        if least.n < k:
            return self.blocks
        return self.blocks.join(self.bounds().where(F.col("bound") >= least.least).select("part"), "part", "left_semi")


def search_index(spark: SparkSession, path: str, prompt: str, k: int) -> DataFrame:
    """(id, score): the k documents of the largest TF-IDF cosine with a prompt, as ``lexical_top_k`` finds them over all rows.

    Ties go to the larger sha256 of prompt, null byte and id. Documents without a shared term follow at 0 if there are fewer
    than k others; only then are all ids read. Prompt terms that no document has count in the prompt's length. A prompt
    without terms finds nothing. Repeated or null ids can't be in an index. The driver holds k rows.
    """
    version = current(spark, path)
    search = Search(spark, version, prompt)
    empty = spark.createDataFrame([], f"id {version['id']}, score double")
    if not search.names or not version["n"]:
        return empty
    search.prepare()
    rows = search.best(search.scores(search.reachable(k)), k).collect()
    found = spark.createDataFrame(rows, empty.schema)
    if len(rows) >= min(k, version["n"]):
        return search.best(found, k)
    # Fewer than k share a term: all of these are in ``found``.
    others = spark.read.parquet(version["documents"]).select("id").join(F.broadcast(found), "id", "left_anti")
    return search.best(found.unionByName(search.best(others.withColumn("score", F.lit(0.0)), k)), k)


def share_read(spark: SparkSession, path: str, prompt: str, k: int) -> tuple[int, int, int]:
    """(postings that a search reads, those of its terms, those of the index)."""
    version = current(spark, path)
    search = Search(spark, version, prompt)
    if not search.names:
        return 0, 0, version["n_postings"]
    search.prepare()
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return total(search.reachable(k)), total(search.blocks), version["n_postings"]
