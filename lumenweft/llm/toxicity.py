"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon holds the words that labelled toxic texts share; its trie is intersected with the Levenshtein automaton of
one edit, determinised as words are read, so misspelled terms are found at the cost of a few table look-ups. Each hit is
weighed by its context: hits inside quotation marks or after a word of saying count apart from the others. A logistic
model over these sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import crc32_mod, materialize
from lumenweft.session import ship

#: Bound on the labelled rows that the lexicon and the model are fitted on (in order of a hash of doc_id).
TRAIN_ROWS = 20_000
#: Shorter terms allow no edit; words around a hit that are its context; remembered words of a task.
EDIT_LENGTH, CONTEXT_WORDS, REMEMBERED = 5, 12, 400_000

WORDS = re.compile(r"[^\W\d_]+")
# Words that introduce someone else's words.
SAYING = frozenset("said says say wrote writes quote quoted quotes called calls reported reports dit disait sagte schrieb zitat dijo escribió cita".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}


class FuzzyTrie:
    """Trie of terms, read through a Levenshtein automaton of one edit; states are determinised on first use."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        self.deepest = [0]
        for k, term in enumerate(terms):
            node = 0
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                node = self.children[node][ch]
            self.final[node] = k
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int]] = []
        self.start = self._state({0: 0})

    def _state(self, items: dict[int, int]) -> int:
        """Number of a set of (node, edits), edits being least; a term's character may be left out (one edit)."""
        for node, edits in list(items.items()):
            if edits == 0:
                for child in self.children[node].values():
                    items.setdefault(child, 1)
        if not items:
            return -1
        key = frozenset(items.items())
        known = self.number.get(key)
        if known is None:
            known = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(edits, self.final[node]) for node, edits in key if self.final[node] >= 0 and (edits == 0 or len(self.terms[self.final[node]]) >= EDIT_LENGTH)]
            edits, term = min(ends, default=(-1, -1))
            self.accepts.append((term, edits))
        return known

    def _move(self, state: int, ch: str) -> int:
        items: dict[int, int] = {}
        for node, edits in self.sets[state]:
            same = self.children[node].get(ch)
            if same is not None:
                items[same] = min(edits, items.get(same, 9))
            if edits == 0:
                items[node] = min(1, items.get(node, 9))  # one character too many
                for child in self.children[node].values():  # another character
                    items[child] = min(1, items.get(child, 9))
        return self._state(items)

    def look_up(self, word: str) -> tuple[int, int]:
        """(term, edits) of the closest term, or (-1, -1)."""
        if len(self.sets) > 200_000:
            self.reset()
        state = self.start
        for ch in word:
            moves = self.moves[state]
            nxt = moves.get(ch)
            if nxt is None:
                nxt = moves[ch] = self._move(state, ch)
            if nxt < 0:
                return -1, -1
            state = nxt
        return self.accepts[state]


class Matcher:
    """Finds terms in texts; remembers the words it has seen, up to a bound."""

    def __init__(self, terms: dict[str, float], exceptions: set[str]):
        self.names = sorted(terms)
        self.weights = [terms[t] for t in self.names]
        self.trie, self.exceptions = FuzzyTrie(self.names), exceptions
        self.seen: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        hit = self.seen.get(word)
        if hit is None:
            hit = self.trie.look_up(word)
            if hit[1] > 0 and word in self.exceptions:
                hit = (-1, -1)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[word] = hit
        return hit

    def hits(self, text: str) -> tuple[int, list[tuple[int, str, int, int, bool]]]:
        """Number of words; (word number, word, term, edits, quoted) of each hit."""
        low = text.lower()
        words = WORDS.findall(low)
        if not any(self.word(w)[0] >= 0 for w in set(words)):
            return len(words), []
        found = []
        before: list[str] = []
        for k, match in enumerate(WORDS.finditer(low)):
            term, edits = self.word(match[0])
            if term >= 0:
                found.append((k, match[0], term, edits, quoted(low, match.start(), match.end()) or any(w in SAYING for w in before[-CONTEXT_WORDS:])))
            before.append(match[0])
            if len(before) > 4 * CONTEXT_WORDS:
                del before[: -CONTEXT_WORDS]
        return len(words), found

    def features(self, n_words: int, found: list[tuple[int, str, int, int, bool]]) -> list[float]:
        exact = [self.weights[h[2]] for h in found if not h[4] and h[3] == 0]
        fuzzy = [self.weights[h[2]] for h in found if not h[4] and h[3] > 0]
        told = [self.weights[h[2]] for h in found if h[4]]
        # Hits come in the order of the text: those around each are counted between two pointers.
        near, low, high = 0, 0, 0
        for h in found:
            while h[0] - found[low][0] > CONTEXT_WORDS:
                low += 1
            while high < len(found) and found[high][0] - h[0] <= CONTEXT_WORDS:
                high += 1
            near = max(near, high - low)
        return [
            math.log1p(sum(exact)), math.log1p(sum(fuzzy)), math.log1p(sum(told)), max(exact, default=0.0), math.log1p(len({h[2] for h in found})),
            math.log1p(100 * len(found) / max(1, n_words)), math.log1p(near),
        ]


def quoted(text: str, start: int, end: int, reach: int = 200) -> bool:
    """Whether a span stands between quotation marks that open and close near it."""
    left, right = text[max(0, start - reach) : start], text[end : end + reach]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if left.count(opening) % 2 and closing in right:
                return True
        elif left.rfind(opening) > left.rfind(closing) and closing in right:
            return True
    return False


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the constant of a penalised logistic regression (Newton steps)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], penalty)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + shrink * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _word_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic texts, all texts) over the distinct words of each text, by batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            counts: dict[str, list[int]] = {}
            part = batch.slice(at, 500)
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for word in set(WORDS.findall((text or "").lower())):
                    c = counts.setdefault(word, [0, 0])
                    c[0] += toxic
                    c[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["word", "toxic", "n"])


def _near_terms(terms: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, set())
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if matcher.trie.look_up(w)[1] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    return run


def _features(terms: dict[str, float], exceptions: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, exceptions)
        for batch in batches:
            rows = [matcher.features(*matcher.hits(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], set[str], np.ndarray]:
    """Lexicon with weights, clean words next to it, and the model, from the labelled rows where ``usable`` holds.

    Two thirds of the rows give the lexicon, the others the model, so the model sees terms as new texts show them. A doc_id
    trains once, with its least text. What is collected comes from ``train_rows`` texts at most, and is all of it.
    """
    labelled = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("long").alias("toxic"))
    rows = materialize(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("late")), "labelled")
    early, late = rows.where("not late").select("text", "toxic"), rows.where("late").select("text", "toxic")
    words = early.mapInArrow(_word_labels, "word string, toxic long, n long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    words = materialize(words, "word-labels")
    positive = early.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]
    least = max(3, math.ceil(0.004 * positive))
    top = words.where((F.col("toxic") >= least) & (F.col("toxic") >= 0.8 * F.col("n"))).orderBy(F.desc("toxic"), "word").collect()
    terms = {r.word: math.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5)) for r in top}
    if not terms:
        return {}, set(), np.zeros(8)
    clean = words.where("n - toxic >= 2 and 2 * toxic < n").select("word").mapInArrow(_near_terms(terms), "word string")
    # All of them: an edit away from a term, and in the rows trained on, so they are bounded by these.
    exceptions = {r.word for r in clean.collect()}
    seen = late.mapInArrow(_features(terms, exceptions), "x array<double>, y long").collect()
    x, y = np.array([r.x for r in seen]).reshape(len(seen), 7), np.array([r.y for r in seen], float)
    return terms, exceptions, fit_logistic(x, y) if len(seen) else np.append(np.ones(7), -3.0)


SCANNED = "doc_id {id}, n_words long, hits array<struct<word: string, at: long, term: string, edits: int, quoted: boolean>>, score double"


def _scanner(terms: dict[str, float], exceptions: set[str], model: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, exceptions)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, hits, scores = [], [], []
                for text in part.column(1).to_pylist():
                    n, found = matcher.hits(text or "")
                    z = float(np.dot(model, [*matcher.features(n, found), 1.0])) if terms else -30.0
                    counts.append(n)
                    hits.append([{"word": h[1], "at": h[0], "term": matcher.names[h[2]], "edits": h[3], "quoted": h[4]} for h in found])
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(hits, schema.field("hits").type), pa.array(scores)], schema=schema)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, usable, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, n_words, hits, score) for each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Null and empty texts have no hits and the least score; without labels nothing is toxic. Several labels of one
    doc_id count as toxic if one is; null labels are left out. Repeated rows are scored each; more columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ddl = SCANNED.format(id=read.schema["doc_id"].dataType.simpleString())
    terms, exceptions, model = train(read, labels, usable, train_rows)
    return read.mapInArrow(_scanner(terms, exceptions, model, to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id) mod 3 is 1 are held out of the training; a score of 0.7 predicts toxic."""
    held = crc32_mod(F.col("doc_id"), 3) == 1
    scored = toxicity(docs, labels, ~held)
    return scored.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")
