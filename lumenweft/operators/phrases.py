"""Mood vectors by a lexicon of any size: a table of words and phrases instead of an expression that grows with them.

Phrases are found by one automaton over all of them (Aho-Corasick), in one pass over a text. They count longest first, and
what a phrase covers is taken out before the next is looked for; after a phrase is taken out only the places around it are
passed over again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.operators.mood import NEUTRAL
from lumenweft.session import ship

#: Rows of a lexicon: it is held by the driver and every task.
MOST_ROWS = 5_000_000
Deltas = list[tuple[int, float]]


class Lexicon:
    """Words and phrases, in the order in which phrases count, with what each adds to which axis."""

    def __init__(self, rows: list[tuple[str, Deltas]]):
        self.words = {key: deltas for key, deltas in rows if " " not in key and "-" not in key}
        phrases = sorted((r for r in rows if " " in r[0] or "-" in r[0]), key=lambda r: -len(r[0]))
        self.phrases = [(key.replace("-", " "), deltas) for key, deltas in phrases]
        self.longest = max((len(p) for p, _ in self.phrases), default=0)
        places: dict[str, list[int]] = {}
        for k, (phrase, _) in enumerate(self.phrases):
            places.setdefault(phrase, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for phrase, own in places.items():
            self.automaton.add_word(phrase, own)
        if places:
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        """The phrases that stand in a text."""
        return {k for _, own in self.automaton.iter(text) for k in own} if self.phrases else set()

    def counted(self, text: str) -> Iterator[Deltas]:
        """What the phrases of a text add, longest first, each taken out (for a blank) before the next."""
        waiting = sorted(self.found(text))
        seen = set(waiting)
        while waiting:
            k = heapq.heappop(waiting)
            phrase, deltas = self.phrases[k]
            parts = text.split(phrase)
            if len(parts) == 1:
                continue
            yield deltas
            text = " ".join(parts)
            # Where a phrase was, the two sides may make another one: with the blank, and with short parts between.
            around = [0]
            for part in parts[:-1]:
                around.append(around[-1] + len(part) + 1)
            windows = {(max(0, at - 1 - self.longest) // self.longest) for at in around[1:]}
            near = "\0".join(text[w * self.longest : (w + 4) * self.longest] for w in sorted(windows))
            for new in self.found(near) - seen:
                if new > k:
                    seen.add(new)
                    heapq.heappush(waiting, new)

    def mood(self, tokens: list[str]) -> list[float]:
        total = [0.0] * len(fixed.AXES)
        hits = [self.words[t] for t in tokens if t in self.words]
        hay = " ".join([*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))])
        for deltas in (*hits, *self.counted(hay)):
            for axis, delta in deltas:
                total[axis] += delta
        return [min(1.0, max(0.0, NEUTRAL + d)) for d in total]


def read_lexicon(lexicon: DataFrame) -> list[tuple[str, Deltas]]:
    """The rows (phrase, axis, delta; ordinal, if there is one, puts phrases of one length in order, else their text does) of
    a lexicon by phrase. ValueError beyond MOST_ROWS and for axes that are not. Null phrases, axes and deltas count as none."""
    named = lexicon.where("phrase is not null and axis is not null and delta is not null")
    order = ["ordinal", "phrase"] if "ordinal" in lexicon.columns else ["phrase"]
    rows = named.select(*order, "axis", F.col("delta").cast("double").alias("delta")).limit(MOST_ROWS + 1)
    if rows.count() > MOST_ROWS:
        raise ValueError(f"A lexicon has {MOST_ROWS} rows at most.")
    axis = {a: k for k, a in enumerate(fixed.AXES)}
    out: dict[str, Deltas] = {}
    for r in rows.orderBy(*order, "axis").toLocalIterator():
        if r.axis not in axis:
            raise ValueError(f"{r.axis!r} is no axis.")
        out.setdefault(r.phrase, []).append((axis[r.axis], r.delta))
    return list(out.items())


def parse_moods(df: DataFrame, text: str, lexicon: DataFrame, name: str = "mood") -> DataFrame:
    """``df`` with the mood vector of ``text`` by a lexicon table, as ``mood.parse_mood`` has it for a lexicon in the plan.

    Null texts are neutral. Row-local: nothing is shuffled, and neither the plan nor the time for a text grows with the
    lexicon.
    """
    spark = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast(read_lexicon(lexicon))
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    inner = "_tokens"
    while inner in df.columns:
        inner += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(shared.value)
        for batch in batches:
            moods = [known.mood(tokens or []) for tokens in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(moods, pa.list_(pa.float64()))], names=schema.names)

    return df.withColumn(inner, T.mood_tokens(F.col(f"`{text}`"))).mapInArrow(run, schema)
