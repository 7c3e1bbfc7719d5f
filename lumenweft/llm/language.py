"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ORDER-grams over folded letters; everything between two runs of letters is one blank. Highest
orders are discounted counts, lower ones continuation counts, and the lowest falls back to all letters alike. The n-grams of
all languages lie in one sorted array of hashes for each order, with a row of log-probabilities, one for each language, and
the contexts in another, with the logarithms of what interpolation leaves: a character costs one look-up for all languages,
and one more for each order it backs off. The language of the least cross-entropy a character is chosen. Texts of the
training rows that no model saw calibrate two things: how sure a choice is, by its lead over the second, and how high the
cross-entropy of a text of its length may be before it counts as none of the languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import chunks, crc32_mod, mix64
from lumenweft.llm.toxicity import fit_logistic
from lumenweft.session import ship

#: Characters of an n-gram.
ORDER = 5
#: Bound on the sample that the models are fitted on: about so many characters a language, in pieces of PIECE, drawn by a
#: hash over all training texts. Models hold CELLS numbers at most, so with very many languages each has a shorter sample.
FIT_CHARACTERS, PIECE, CELLS = 1_000_000, 2_000, 64_000_000
#: Bounds on the languages, by the length of their training texts, and on the rows that calibrate.
MOST_LANGUAGES, CALIBRATION_ROWS = 256, 20_000
#: One in so many training rows calibrates and is in no model.
CALIBRATES = 10
#: Share of the calibration texts whose cross-entropy is too high to be accepted.
REJECTED = 0.001
#: A letter takes so many bits of an n-gram: the most frequent letters of the sample have a number, the others share one.
LETTER_BITS = 12
BLANK, OTHER = 32, (1 << LETTER_BITS) - 1
#: Texts are read in slices of so many bytes, each beginning as a text does.
SLICE = 4 << 20
NONE = "und"


class Folding:
    """Letters by code point, folded; marks keep to their letter; all else is a blank. The table fills as characters occur."""

    MARK = 1 << 21

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if len(out) and out.min() < 0:
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                self.table[p] = ord(c.lower()[0]) if c.isalpha() else p | self.MARK if unicodedata.category(c)[0] == "M" else BLANK
            out = self.table[points]
        return out


def sliced(offsets: np.ndarray, data: np.ndarray, most: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of slices of ``most`` bytes at most, cut between characters, and the text that each slice belongs to."""
    cuts, owner = [0], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > most:
            a += most
            while data[a] & 0xC0 == 0x80 and a > cuts[-1] + 1:
                a -= 1
            cuts.append(a)
            owner.append(k)
        cuts.append(b)
        owner.append(k)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


def _points(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and where each text begins (n + 1). What is no UTF-8 counts as replacement characters."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return points, np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    except UnicodeDecodeError:
        own = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(own).encode("utf-32-le"), np.uint32), np.append(0, np.cumsum([len(t) for t in own]))


def letters(offsets: np.ndarray, data: np.ndarray, fold: Folding) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters, each text after ORDER - 1 blanks of its own; the text of each; whether it is one of those blanks;
    and the number of letters (not marks) of each text."""
    points, at = _points(offsets, data)
    n, sizes = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n), sizes)
    folded = fold(points)
    n_letters = np.bincount(doc[(folded != BLANK) & (folded < Folding.MARK)], minlength=n)
    out = np.full(len(points) + n * ORDER, BLANK, np.int32)
    out[np.arange(len(points)) + doc * ORDER + ORDER - 1] = folded & (Folding.MARK - 1)
    lead = np.zeros(len(out), bool)
    begin = at[:-1] + np.arange(n) * ORDER
    for k in range(ORDER - 1):
        lead[begin + k] = True
    keep = (out != BLANK) | lead
    keep[1:] |= out[:-1] != BLANK
    keep &= np.repeat(n_letters > 0, sizes + ORDER)
    return out[keep], np.repeat(np.arange(n), sizes + ORDER)[keep], lead[keep], n_letters


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, n) of the chosen pieces of each text: rows (language, text, pieces)."""
    fold = Folding()
    for batch in batches:
        own: dict[int, list[str]] = {}
        for language, text, pieces in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            own.setdefault(language, []).extend(text[p * PIECE : (p + 1) * PIECE] for p in pieces)
        for language, texts in own.items():
            column = pa.array(texts, pa.large_string())
            for _, _, offsets, data in chunks(pa.RecordBatch.from_arrays([column], ["text"])):
                codes, _, lead, _ = letters(offsets, data, fold)
                ends = np.flatnonzero(~lead)
                hashes = np.zeros(len(ends), np.uint64)
                for k in range(ORDER - 1, -1, -1):
                    hashes = mix64(hashes * np.uint64(31) + codes[ends - k].astype(np.uint64))
                _, some, counts = np.unique(hashes, return_index=True, return_counts=True)
                if len(some):
                    text = np.stack([codes[ends[some] - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
                    grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.int32()), pa.array(grams), pa.array(counts)], ["language", "gram", "n"])


class Sorted:
    """A sorted array of the hashes of distinct keys, with an index over their first bits."""

    def __init__(self, keys: np.ndarray):
        hashes = mix64(keys.astype(np.uint64))
        self.order = np.argsort(hashes)  # of the keys given, in the order of the array
        self.hashes = hashes[self.order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.index = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        hashes = mix64(keys)
        first = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.index[first], self.index[first + 1]
        out = np.full(len(keys), -1, np.int32)
        here = np.flatnonzero(at < end)
        at, end, hashes = at[here], end[here], hashes[here]
        while len(here):
            found = self.hashes[at]
            same = found == hashes
            out[here[same]] = at[same]
            at += 1
            on = (found < hashes) & (at < end)
            here, at, end, hashes = here[on], at[on], end[on], hashes[on]
        return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << LETTER_BITS * n) - 1)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of the values of each and the number of its rows."""
    found, place, rows = np.unique(keys, return_inverse=True, return_counts=True)
    return found, np.bincount(place, values, len(found)), rows


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


class Models:
    """The models of all languages, from rows (language number, gram, count)."""

    def __init__(self, names: list[str], language: np.ndarray, grams: list[str], counts: np.ndarray):
        self.names = names
        width = len(names)
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        letter, place = np.unique(points, return_inverse=True)
        weight = np.bincount(place.ravel(), np.repeat(counts, ORDER), len(letter))
        number = np.full(len(letter), OTHER, np.int64)
        by = np.lexsort((letter, -weight))[: OTHER]
        number[by] = np.arange(len(by))
        self.alphabet = (letter, number)
        vocabulary = len(by) + 1
        ids = number[place.reshape(points.shape)].astype(np.uint64)
        keys = np.zeros(len(ids), np.uint64)
        for k in range(ORDER):
            keys = (keys << np.uint64(LETTER_BITS)) | ids[:, k]
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for v in range(width):
            own, n, _ = _sums(keys[language == v], counts[language == v])
            levels[ORDER].append((own, n))
            for k in range(ORDER - 1, 0, -1):
                # How many different characters stand before an n-gram.
                own, _, n = _sums(own & _mask(k), np.ones(len(own)))
                levels[k].append((own, n.astype(float)))
        self.tables, self.contexts = {}, {}
        before = np.full((1, width), 1.0 / vocabulary)
        keys_before = np.zeros(1, np.uint64)
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([own for own, _ in levels[k]]))
            context = union >> np.uint64(LETTER_BITS)
            contexts, of = np.unique(context, return_inverse=True)
            shorter, _ = _place(keys_before, union & _mask(k - 1))
            p, left = np.zeros((len(union), width)), np.ones((len(contexts), width))
            for v, (own, n) in enumerate(levels[k]):
                once, twice = np.sum(n == 1), np.sum(n == 2)
                discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
                at, _ = _place(union, own)
                seen, total, kinds = _sums(own >> np.uint64(LETTER_BITS), n)
                where, _ = _place(contexts, seen)
                sums = np.ones(len(contexts))
                sums[where] = total
                left[where, v] = discount * kinds / total
                p[at, v] = np.maximum(n - discount, 0) / sums[of[at]]
            p += left[of] * before[shorter]
            table, held = Sorted(union), Sorted(contexts)
            self.tables[k] = (table, np.log(p[table.order]).astype(np.float32))
            self.contexts[k] = (held, np.log(left[held.order]).astype(np.float32))
            before, keys_before = p, union
        self.unseen = np.float32(-np.log(vocabulary))

    def numbers(self) -> np.ndarray:
        out = np.full(Folding.MARK, OTHER, np.uint16)
        out[self.alphabet[0]] = self.alphabet[1]
        return out

    def score(self, codes: np.ndarray, doc: np.ndarray, lead: np.ndarray, n: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each of n texts in each language, and the characters it is of."""
        out = np.zeros((n, len(self.names)))
        ids = numbers[codes].astype(np.uint64)
        keys = ids.copy()
        for k in range(1, ORDER):
            keys[k:] |= ids[:-k] << np.uint64(LETTER_BITS * k)
        rest = np.flatnonzero(~lead)
        n_codes = np.bincount(doc[rest], minlength=n)
        keys = keys[rest]
        doc = doc[rest]

        def add(values: np.ndarray, at: np.ndarray) -> None:
            if len(at):
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                out[at[begin]] += np.add.reduceat(values, begin, axis=0, dtype=np.float64)

        for k in range(ORDER, 0, -1):
            table, logs = self.tables[k]
            place = table.find(keys & _mask(k))
            hit = place >= 0
            add(logs[place[hit]], doc[hit])
            keys, doc = keys[~hit], doc[~hit]
            held, left = self.contexts[k]
            place = held.find((keys & _mask(k)) >> np.uint64(LETTER_BITS))
            hit = place >= 0
            add(left[place[hit]], doc[hit])
        add(np.full((len(doc), len(self.names)), self.unseen), doc)
        return out, n_codes


def _choice(models: Models, batch: pa.RecordBatch, fold: Folding, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: first row, end, cross-entropy of each text in each language, its characters, its letters."""
    for first, end, offsets, data in chunks(batch):
        n = end - first
        cuts, owner = sliced(offsets, data)
        totals, n_codes, n_letters = np.zeros((n, len(models.names))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        groups = [(0, len(owner))] if len(owner) == n else [(k, k + 1) for k in range(len(owner))]
        for a, b in groups:
            own = cuts[a : b + 1]
            codes, doc, lead, found = letters(own - own[0], data[own[0] : own[-1]], fold)
            sums, counts = models.score(codes, doc, lead, b - a, numbers)
            np.add.at(totals, owner[a:b], sums)
            np.add.at(n_codes, owner[a:b], counts)
            np.add.at(n_letters, owner[a:b], found)
        yield first, end, -totals / np.maximum(1, n_codes)[:, None], n_codes, n_letters


def _leads(entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best language of each row (the first of equals), its cross-entropy, and its lead over the second."""
    best = entropy.argmin(axis=1) if entropy.shape[1] else np.zeros(len(entropy), np.int64)
    least = np.take_along_axis(entropy, best[:, None], 1)[:, 0]
    if entropy.shape[1] < 2:
        return best, least, np.full(len(entropy), 1.0)
    return best, least, np.partition(entropy, 1, axis=1)[:, 1] - least


class Calibration:
    """How sure a choice is and how high a cross-entropy may be, from texts (language, best, entropy, lead, characters)."""

    def __init__(self, width: int, rows: list[tuple[int, int, float, float, int]]):
        own = np.array(rows, float).reshape(-1, 5)
        right = own[:, 0] == own[:, 1]
        features = self.features(own[:, 3], own[:, 4])
        # Without calibration texts a lead of 0.05 a character over 100 characters makes a choice rather sure.
        self.weights = fit_logistic(features, right.astype(float)) if len(own) >= 20 else np.array([0.5, 10.0, 0.0])
        good = own[right]
        self.mean, self.spread = np.full(width, np.inf), np.ones((width, 2))
        z = []
        for v in range(width):
            mine = good[good[:, 1] == v]
            if len(mine) < 5:
                continue
            self.mean[v] = np.average(mine[:, 2], weights=np.sqrt(mine[:, 4]))
            x = np.stack([np.ones(len(mine)), 1 / np.maximum(1, mine[:, 4])], axis=1)
            fit = np.linalg.lstsq(x, (mine[:, 2] - self.mean[v]) ** 2, rcond=None)[0]
            self.spread[v] = np.maximum(fit, [1e-4, 1e-2])
            z.append(self.z(mine[:, 1].astype(int), mine[:, 2], mine[:, 4]))
        self.cut = float(np.quantile(np.concatenate(z), 1 - REJECTED)) if z else np.inf

    @staticmethod
    def features(lead: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([np.log1p(lead * n), np.minimum(lead, 1.0)], axis=1)

    def z(self, best: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By how many deviations the cross-entropy of a text of n characters lies above what is usual."""
        return (entropy - self.mean[best]) / np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(1, n))

    def sure(self, lead: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(lead, n) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _calibration_rows(shared):
    """(language, best, entropy, lead, n) of rows (text, language) with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, fold = shared.value, Folding()
        numbers = models.numbers()
        for batch in batches:
            languages = batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, entropy, n, n_letters in _choice(models, batch, fold, numbers):
                best, least, lead = _leads(entropy)
                some = n_letters > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (languages[first:end], best, least, lead, n)], ["language", "best", "entropy", "lead", "n"])

    return run


def train(docs: DataFrame, usable: Column) -> tuple[Models, Calibration] | None:
    """Models and calibration from the rows where ``usable`` holds and lang is not null; None without any letter.

    The driver holds the n-grams of a bounded sample (FIT_CHARACTERS, CELLS), a row a language and CALIBRATION_ROWS rows of
    five numbers.
    """
    spark = ship(docs.sparkSession)
    drawn = F.xxhash64("doc_id", "text")
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.withColumn("h", drawn).withColumn("calibrates", F.pmod("h", F.lit(CALIBRATES)) == 0)
    size = F.length("text")
    facts = known.groupBy("lang").agg(F.sum(F.when(~F.col("calibrates"), size).otherwise(0)).alias("size"), F.count_if("calibrates").alias("n"))
    facts = facts.orderBy(F.desc("size"), "lang").limit(MOST_LANGUAGES).collect()
    names = [r.lang for r in facts]
    if not names:
        return None
    most = min(FIT_CHARACTERS, CELLS // len(names) ** 2)
    table = spark.createDataFrame([(r.lang, k, min(1.0, most / max(1, r.size))) for k, r in enumerate(facts)], "lang string, language int, share double")
    own = known.join(F.broadcast(table), "lang")
    # A piece is drawn if its number in [0, 1) is below its language's share.
    at = lambda p: F.pmod(F.xxhash64("h", p), F.lit(1 << 40)) / float(1 << 40)
    pieces = F.filter(F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int")), lambda p: at(p) < F.col("share"))
    fit = own.where(~F.col("calibrates") & (size > 0)).select("language", "text", pieces.alias("pieces")).where(F.size("pieces") > 0)
    counts = fit.mapInArrow(_grams, "language int, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    language = counts.column("language").to_numpy()
    # A language without a letter in the sample has no model.
    there = np.unique(language)
    models = Models([names[k] for k in there], np.searchsorted(there, language), counts.column("gram").to_pylist(), counts.column("n").to_numpy().astype(float))
    number = {int(k): v for v, k in enumerate(there)}
    share = min(1.0, CALIBRATION_ROWS / max(1, sum(r.n for r in facts)))
    texts = own.where(F.col("calibrates") & (F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40) < share)).select("text", "language")
    shared = spark.sparkContext.broadcast(models)
    rows = texts.mapInArrow(_calibration_rows(shared), "language int, best long, entropy double, lead double, n long").collect()
    return models, Calibration(len(models.names), [(number.get(r.language, -1), r.best, r.entropy, r.lead, r.n) for r in rows])


def _predictor(shared, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, fold = shared.value, Folding()
        numbers = trained[0].numbers() if trained else None
        for batch in batches:
            ids = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            if trained is None:
                nothing = [pa.array([NONE] * batch.num_rows), *(pa.array(np.zeros(batch.num_rows)) for _ in range(2)), pa.array(np.ones(batch.num_rows, bool))]
                yield pa.RecordBatch.from_arrays([*ids, *nothing], [*keys, "lang_pred", "score", "cross_entropy", "rejected"])
                continue
            models, calibration = trained
            names = np.array(models.names, object)
            for first, end, entropy, n, n_letters in _choice(models, batch, fold, numbers):
                best, least, lead = _leads(entropy)
                some = n_letters > 0
                sure = np.where(some, calibration.sure(lead, n), 0.0)
                rejected = ~some | (sure < 0.5) | (calibration.z(best, least, n) > calibration.cut)
                found = [pa.array(np.where(some, names[best], NONE), pa.string()), pa.array(sure), pa.array(np.where(some, least, 0.0)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in ids), *found], [*keys, "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, usable: Column, *extra: Column) -> DataFrame:
    """(doc_id, the columns of ``extra``, lang_pred, score, cross_entropy, rejected) for each row of ``docs`` (doc_id, text, lang).

    ``lang_pred`` is the language with the least cross-entropy a character (natural logarithms), ties going to the one with
    more training text; ``und`` for a null text, one without a letter, and where nothing could be learnt. ``score`` is the
    calibrated chance that the choice is right (0 for und). ``rejected`` says that the text looks like none of the learned
    languages: the chance is under one half, or the cross-entropy too high for its length. It leaves ``lang_pred`` as it is.

    Models learn from ``usable`` rows with text and lang; lang, source and doc_id never enter a prediction (doc_id and text
    draw the sample). Repeated rows are read each. Other columns, clashing names among them, are ignored; an empty table
    gives no rows. Very long texts are read in slices of SLICE bytes.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, usable))
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"), *extra)
    keys = [c for c in read.columns if c != "text"]
    types = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keys)
    return read.mapInArrow(_predictor(shared, keys), f"{types}, lang_pred string, score double, cross_entropy double, rejected boolean")


def op11(docs: DataFrame) -> DataFrame:
    """Texts whose crc32(doc_id) mod 4 is 2 are held out; a row without doc_id is not."""
    held = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, ~held, held.alias("held_out"))
