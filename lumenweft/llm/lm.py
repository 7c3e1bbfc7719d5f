"""Language-model scoring with a weighted backoff automaton.

All n-grams of the training texts seen LEAST times or more are in the model; an arc carries a smoothed log-probability, a
failure arc the backoff weight. The model grows with the corpus, so no task holds it: texts are cut into chunks, whose
distinct n-grams are dealt by hash to buckets. A bucket adds up what all chunks send and answers each with the totals of
what it sent. Round by round a chunk learns the counts of its words and pairs, of its triples (of kept pairs only) and how
much of its contexts the kept n-grams take; then it scores its texts. Words never seen fall back to the add-one unigram of
the whole corpus.

An n-gram's hash is sent once: later rounds name it by its place in what the bucket has already, by one bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import chunks, crc32_mod, mix64, word_hashes
from lumenweft.llm.language import Sorted
from lumenweft.llm.substrings import pack, unpack
from lumenweft.session import ship

#: Times that an n-gram is seen at least to be kept, whatever the size of the corpus.
LEAST = 2
#: Taken off the count of a kept n-gram, in quarters, so that sums stay whole numbers.
DISCOUNT_QUARTERS = 3
DISCOUNT = DISCOUNT_QUARTERS / 4
#: Bits of an n-gram's hash beyond those of the number of tokens: an n-gram is taken for another one of the corpus with a
#: chance of 1 in 2**20 or less, whatever its size. Words keep all 64.
SPARE_BITS = 20
#: Stands for the end of a text; no word hashes to it but by chance (1 in 2**64).
END = np.uint64(0x656E64)
#: Text of a chunk and of what a bucket holds, in bytes about.
CHUNK, BUCKET_BYTES = 3 << 20, 8 << 20
LEAST_BUCKETS = 32


def _tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and where each text begins (n + 1)."""
    hashes, first = word_hashes(offsets, data)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


class Backoff:
    """The automaton of a small corpus in one place, built from its counts alone: what tests hold the chunks' automata to.
    Arcs (state * width + word) lead to (log10 probability, next state); failure arcs have weights.

    State 0 is the empty context; a context is a state if it has a kept successor. The counts of kept n-grams are
    discounted; what that leaves of a context is the weight of its failure arc, and goes to all words by their probability
    in the next shorter context: to those that have an arc as part of its probability. All add up to one.
    """

    def __init__(self, counts: np.ndarray, total: int, distinct: int, levels: list[dict[int, int]]):
        self.width = width = len(counts)
        self.total, self.distinct = total, distinct
        unigram = (counts + 1.0) / (total + distinct + 1)
        grams: dict[tuple[int, ...], int] = {(w,): int(c) for w, c in enumerate(counts)}
        followers: dict[tuple[int, ...], dict[int, int]] = {}
        shorter = [(w,) for w in range(width)]
        for level in levels:
            now = []
            for code, n in sorted(level.items()):
                gram = (*shorter[code // width], code % width)
                grams[gram] = n
                now.append(gram)
                followers.setdefault(gram[:-1], {})[gram[-1]] = n
            shorter = now
        contexts = [(), *sorted(followers, key=lambda g: (len(g), g))]
        number = {g: k for k, g in enumerate(contexts)}
        self.fail, self.back, self.arcs = [0] * len(contexts), [0.0] * len(contexts), {}

        def longest(gram: tuple[int, ...]) -> int:
            while gram not in number:
                gram = gram[1:]
            return number[gram]

        def probability(context: tuple[int, ...], word: int) -> float:
            weight = 0.0
            while context:
                if context in number:
                    arc = self.arcs.get(number[context] * width + word)
                    if arc:
                        return 10 ** (weight + arc[0])
                    weight += self.back[number[context]]
                context = context[1:]
            return 10**weight * unigram[word]

        for word in range(width):
            self.arcs[word] = (math.log10(unigram[word]), longest((word,)))
        for context in contexts[1:]:
            state, seen = number[context], grams[context]
            self.fail[state] = longest(context[1:])
            left = 1 - sum(n - DISCOUNT for n in followers[context].values()) / seen
            self.back[state] = math.log10(left)
            for word, n in followers[context].items():
                p = (n - DISCOUNT) / seen + left * probability(context[1:], word)
                self.arcs[state * width + word] = (math.log10(p), longest((*context, word)))
        self.down = [0.0] * len(contexts)
        for state in range(1, len(contexts)):
            self.down[state] = self.back[state] + self.down[self.fail[state]]

    def score(self, words: list[int]) -> float:
        """Sum of log10 probabilities; of a word outside (-1) only the weights of falling back to the empty context."""
        arcs, back, fail, down, width = self.arcs, self.back, self.fail, self.down, self.width
        state, total = 0, 0.0
        for word in words:
            if word < 0:
                if state:
                    total += down[state]
                    state = 0
                continue
            arc = arcs.get(state * width + word)
            while arc is None:
                total += back[state]
                state = fail[state]
                arc = arcs.get(state * width + word)
            total += arc[0]
            state = arc[1]
        return total



class _Chunk:
    """Tokens of some texts as places in their distinct words, and the n-grams among them.

    ``at[k]`` has, for each token, the place among the chunk's distinct n-grams of the one of k words that ends there, or
    -1. An n-gram is looked at if the two one shorter in it are kept. n-grams do not cross texts.
    """

    def __init__(self, payload: bytes):
        words, ids, self.begin, train = unpack(payload)
        self.words, self.width = _values(words), len(words) // 8
        self.ids = _numbers(ids)
        self.doc = np.repeat(np.arange(len(self.begin) - 1, dtype=np.int32), np.diff(self.begin))
        self.trained = train.astype(bool)[self.doc]
        self.start = np.zeros(len(self.ids), bool)
        self.start[self.begin[:-1]] = True
        self.at = {1: np.where(self.words[self.ids] == END, np.int32(-1), self.ids)}
        self.hashes = {1: self.words}
        self.n = {1: np.bincount(self.ids[self.trained], minlength=self.width)}
        self.prefix, self.suffix, self.word = {}, {}, {}

    def before(self, k: int) -> np.ndarray:
        """The n-gram of k words that ends right before each token, or -1."""
        out = np.roll(self.at[k], 1)
        out[self.start] = -1
        return out

    def grow(self, k: int, kept: np.ndarray) -> None:
        """Finds the n-grams of k words, given which of the shorter ones are kept."""
        left, right = self.before(k - 1), self.at[k - 1]
        here = np.flatnonzero((left >= 0) & (right >= 0))
        here = here[kept[left[here]] & kept[right[here]]]
        codes, place = np.unique(left[here].astype(np.int64) * self.width + self.ids[here], return_inverse=True)
        self.at[k] = np.full(len(self.ids), -1, np.int32)
        self.at[k][here] = place
        some = np.empty(len(codes), np.int64)
        some[place] = here  # one place of each, no matter which
        self.prefix[k], self.suffix[k] = (codes // max(1, self.width)).astype(np.int32), right[some]
        self.word[k] = (codes % max(1, self.width)).astype(np.int32)
        self.hashes[k] = mix64(mix64(self.hashes[k - 1][self.prefix[k]]) + self.words[self.word[k]])
        self.n[k] = np.bincount(place[self.trained[here]], minlength=len(codes))


def asked_in(round_: int, order: int) -> list[tuple[bool, int]]:
    """(are they new, words) of the n-grams asked about in a round: first the counts of words and pairs; then what the
    followers of each context take of it, and the counts of n-grams two words longer."""
    if round_ == 0:
        return [(True, k) for k in range(1, min(order, 2) + 1)]
    return [(False, round_)] + [(True, round_ + 2)] * (round_ + 2 <= order)


def _talk(chunk: _Chunk, order: int, total: int, distinct: int):
    """What a chunk asks, round by round as in ``asked_in``: (which of its n-grams, a number for each to add up).

    It is sent, for each, (totals, is it the first to ask). Returns the logarithms of each token's unigram and backoff
    probability, as the automaton gives them, and whether it is known. The last two arguments matter from the second round on.
    """
    count, first, p, left = {}, {}, {}, {}
    if order > 1:
        chunk.grow(2, np.ones(chunk.width, bool))
    levels = range(1, min(order, 2) + 1)
    every = {k: np.ones(len(chunk.hashes[k]), bool) for k in levels}
    for k, (sums, firsts) in zip(levels, (yield [(every[k], chunk.n[k]) for k in levels]), strict=True):
        count[k], first[k] = sums, firsts
    kept = {1: every[1]}
    p[1] = (count[1] + 1.0) / (total + distinct + 1)
    for k in range(2, order + 1):
        kept[k] = count[k] >= LEAST
        own = kept[k] & first[k]
        taken = np.bincount(chunk.prefix[k][own], 4 * count[k][own] - DISCOUNT_QUARTERS, len(kept[k - 1])).astype(np.int64)
        asks = [(count[k - 1] >= LEAST, taken)]
        if k < order:
            chunk.grow(k + 1, kept[k])
            asks.append((np.ones(len(chunk.hashes[k + 1]), bool), chunk.n[k + 1]))
        told = yield asks
        # At least the discount of one n-gram is left; less could only come from hashes that are the same by chance.
        seen = np.maximum(1.0, count[k - 1])
        left[k - 1] = np.maximum(1 - told[0][0] / (4 * seen), DISCOUNT / seen * (told[0][0] > 0))
        before = chunk.prefix[k]
        p[k] = np.where(kept[k], (count[k] - DISCOUNT) / np.maximum(1, count[k - 1][before]) + left[k - 1][before] * p[k - 1][chunk.suffix[k]], 0.0)
        if k < order:
            count[k + 1], first[k + 1] = told[1]
    return Arcs(chunk, order, kept, p, left).read(chunk), count[1][chunk.ids] > 0


#: Tokens of a segment; the texts of a chunk are read through the automaton in segments, side by side.
SEGMENT = 256


class Arcs:
    """The states, arcs and failure arcs that a chunk's texts can reach.

    State 0 is the empty context; a context is a state if it has a kept successor in the corpus. ``arcs`` finds state *
    width + word; ``weight`` and ``to`` have an arc's log10 probability and next state, ``fail`` and ``back`` a state's failure
    arc. State 0 has an arc for every word, so no token is left without one.
    """

    def __init__(self, chunk: _Chunk, order: int, kept: dict[int, np.ndarray], p: dict[int, np.ndarray], left: dict[int, np.ndarray]):
        self.order, self.width = order, chunk.width
        state: dict[int, np.ndarray] = {}
        n = 1
        for k in range(1, order):
            some = left[k] < 1
            state[k] = np.where(some, n + np.cumsum(some) - 1, 0)
            n += int(some.sum())
        # The longest end of an n-gram that is a state, by way of its end that is one word shorter.
        longest: dict[int, np.ndarray] = {}
        for k in range(1, order + 1):
            shorter = longest[k - 1][chunk.suffix[k]] if k > 1 else np.zeros(chunk.width, np.int64)
            longest[k] = np.where(state[k] > 0, state[k], shorter) if k < order else shorter
        self.fail, self.back = np.zeros(n, np.int64), np.zeros(n)
        for k in range(1, order):
            some = np.flatnonzero(state[k])
            self.back[state[k][some]] = np.log10(left[k][some])
            if k > 1:
                self.fail[state[k][some]] = longest[k - 1][chunk.suffix[k][some]]
        self.first, self.after = np.log10(p[1]), longest[1]
        keys, weights, to = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k in range(2, order + 1):
            some = np.flatnonzero(kept[k])
            keys.append(state[k - 1][chunk.prefix[k][some]] * self.width + chunk.word[k][some])
            weights.append(np.log10(p[k][some]))
            to.append(longest[k][some])
        self.arcs = Sorted(np.concatenate(keys))
        self.weight, self.to = np.concatenate(weights)[self.arcs.order], np.concatenate(to)[self.arcs.order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of a word after each state, and the states that follow."""
        total, then = self.first[word], self.after[word]
        here = np.flatnonzero(state)
        at, words, passed = state[here], word[here], np.zeros(len(here))
        while len(here):
            arc = self.arcs.find((at * self.width + words).astype(np.uint64))
            found = arc >= 0
            total[here[found]] = passed[found] + self.weight[arc[found]]
            then[here[found]] = self.to[arc[found]]
            on = ~found
            here, at, words, passed = here[on], at[on], words[on], passed[on] + self.back[at[on]]
            at = self.fail[at]
            last = at == 0  # the empty context has an arc for every word
            total[here[last]] += passed[last]
            here, at, words, passed = here[~last], at[~last], words[~last], passed[~last]
        return total, then

    def read(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the chunk's tokens: of the unigram, and along the automaton.

        A text begins in the empty context. A segment further in begins as many tokens early as a context has words at most:
        after these the automaton is in the state it would be in from the text's begin.
        """
        ids, lead = chunk.ids, self.order - 1
        score = np.zeros(len(ids))
        starts = [np.arange(a, b, SEGMENT) for a, b in zip(chunk.begin[:-1].tolist(), chunk.begin[1:].tolist(), strict=True)]
        ends = np.repeat(chunk.begin[1:], [len(x) for x in starts])
        begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        early = np.minimum(lead, begin - np.repeat(chunk.begin[:-1], [len(x) for x in starts]))
        ends = np.minimum(ends, begin + SEGMENT)
        at, state = begin - early, np.zeros(len(begin), np.int64)
        # Those with most tokens first: a step takes the first of them.
        by = np.argsort(at - ends, kind="stable")
        at, ends, begin, state = at[by], ends[by], begin[by], state[by]
        sizes = ends - at
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -k, side="left"))  # segments of more than k tokens
            now = at[:n] + k
            total, state[:n] = self.step(state[:n], ids[now])
            own = now >= begin[:n]
            score[now[own]] = total[own]
        return self.first[ids], score


class _Deal:
    """A chunk's n-grams in the order of their buckets (the low bits of their hashes) and of the rest of their hashes."""

    def __init__(self, hashes: np.ndarray, bits: int, buckets: int):
        low = buckets.bit_length() - 1
        hashes = hashes >> np.uint64(64 - bits)
        bucket, rest = hashes & np.uint64(buckets - 1), hashes >> np.uint64(low)
        self.order = np.argsort((bucket << np.uint64(bits - low)) | rest)
        self.rest = rest[self.order]
        self.begin = np.append(0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as the largest of them needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _planes(values: np.ndarray) -> np.ndarray:
    """Numbers, sorted for the most part, as differences modulo 2**64, byte plane by byte plane."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def _values(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _flat(numbers: np.ndarray) -> np.ndarray:
    """32-bit numbers, byte plane by byte plane."""
    return np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks: number, tokens, training tokens, the tokens, and (doc_id, held_out) as an Arrow stream."""
    chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in batches:
        for first, end, offsets, data in chunks(batch, most=CHUNK):
            tokens, begin = _tokens(offsets, data)
            words, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            # The frequent words have the small numbers, which take little space; about equally frequent ones stay sorted.
            by = np.argsort(-np.frexp(counts)[1], kind="stable")
            number = np.empty(len(by), np.int64)
            number[by] = np.arange(len(by))
            words, ids = words[by], number[ids]
            part = batch.slice(first, end - first).select(["doc_id", "held_out"])
            train = np.array([h is False for h in part.column(1).to_pylist()], np.uint8)
            payload = pack(_planes(words), _flat(ids), begin, train, level=3)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_batch(part)
            n_train = int(np.diff(begin)[train == 1].sum())
            columns = [pa.array([chunk]), pa.array([len(tokens)]), pa.array([n_train]), pa.array([payload], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "n_tokens", "n_train", "payload", "rows"])
            chunk += 1


def _spread(key: int) -> int:
    """Partition of a chunk, whose number has its low bits mostly clear."""
    return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32


def _pairs_of(key: int) -> int:
    """Two buckets go to a partition, one after the other: a task costs something by itself."""
    return key >> 1


def _by_key(rows: Iterator[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Pairs of a partition gathered by key, in the order of their values' first two numbers."""
    held: dict[int, list[tuple]] = {}
    for key, row in rows:
        held.setdefault(key, []).append(row)
    for key in sorted(held):
        yield key, sorted(held.pop(key), key=lambda r: r[:2])


class _Size:
    """What all tasks know: longest n-grams, buckets, bits of the hashes of words and of longer n-grams."""

    def __init__(self, order: int, buckets: int, tokens: int):
        self.order, self.buckets = order, buckets
        self.long_bits = max(buckets.bit_length(), min(64, tokens.bit_length() + SPARE_BITS))

    def deal(self, chunk: _Chunk, k: int) -> _Deal:
        return _Deal(chunk.hashes[k], 64 if k == 1 else self.long_bits, self.buckets)


def _replay(rows: list[tuple], rounds: int, size: _Size, total: int, distinct: int):
    """A chunk's talk from its rows (round, bucket, payload; round -1: itself): what it asks next, or its result.

    The answers to a round come bucket by bucket, in the order in which the n-grams were dealt.
    """
    chunk = _Chunk(rows[0][2])
    talk = _talk(chunk, size.order, total, distinct)
    asks, dealt = next(talk), {}
    for r in range(rounds):
        told = [unpack(x[2]) for x in rows if x[0] == r]
        answers = []
        for j, ((new, k), (which, values)) in enumerate(zip(asked_in(r, size.order), asks, strict=True)):
            if new:
                dealt[k] = size.deal(chunk, k)
            order = dealt[k].order[which[dealt[k].order]]
            sums, firsts = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
            if told:
                sums[order] = np.concatenate([t[2 * j] for t in told])
            if told and new:
                firsts[order] = np.concatenate([np.unpackbits(t[2 * j + 1])[: len(t[2 * j])] for t in told])
            answers.append((sums, firsts))
        try:
            asks = talk.send(answers)
        except StopIteration as done:
            return chunk, dealt, done.value
    return chunk, dealt, asks


def _asker(r: int, size: _Size, total: int, distinct: int):
    """(bucket, (chunk, round, payload)): for each kind of a round's n-grams, hashes or bits, and numbers."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in _by_key(rows):
            chunk, dealt, asks = _replay(own, r, size, total, distinct)
            kinds = asked_in(r, size.order)
            dealt |= {k: size.deal(chunk, k) for new, k in kinds if new}
            turned = [(new, dealt[k], which[dealt[k].order], values[dealt[k].order]) for (new, k), (which, values) in zip(kinds, asks, strict=True)]
            for b in range(size.buckets):
                parts, some = [], False
                for new, deal, which, values in turned:
                    here = slice(deal.begin[b], deal.begin[b + 1])
                    some |= bool(which[here].any())
                    parts += [_planes(deal.rest[here]) if new else np.packbits(which[here]), _narrow(values[here][which[here]])]
                if some:
                    yield b, (key, r, pack(*parts, level=1))

    return run


def _answerer(r: int, size: _Size):
    """Adds up a bucket: (chunk, (round, bucket, payload, words)) for each chunk that asked in round ``r``.

    For each kind of n-grams the totals, and of new ones a bit: whether this chunk is the first that trains on it. What a
    chunk asked before is at hand, for the n-grams it now names by bits. The words with a count stand in one of the rows.
    """

    def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for bucket, rows in _by_key(pairs):
            opened = {x[:2]: unpack(x[2]) for x in rows}
            asking = [x[0] for x in rows if x[1] == r]
            replies: list[list[np.ndarray]] = [[] for _ in asking]
            words = 0
            for j, (new, k) in enumerate(asked_in(r, size.order)):
                if new:
                    hashes = [_values(opened[c, r][2 * j]) for c in asking]
                else:
                    since = next((q, i) for q in range(r) for i, x in enumerate(asked_in(q, size.order)) if x == (True, k))
                    listed = [_values(opened[c, since[0]][2 * since[1]]) if (c, since[0]) in opened else np.zeros(0, np.uint64) for c in asking]
                    hashes = [h[np.unpackbits(opened[c, r][2 * j])[: len(h)].astype(bool)] for c, h in zip(asking, listed, strict=True)]
                values = np.concatenate([opened[c, r][2 * j + 1].astype(np.int64) for c in asking] or [np.zeros(0, np.int64)])
                cuts = np.cumsum([len(h) for h in hashes])[:-1]
                found, place = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_inverse=True)
                # Sums below 2**53 are exact as floats.
                sums = np.bincount(place, values, len(found)).astype(np.int64)
                for reply, part in zip(replies, np.split(sums[place], cuts), strict=bool(asking)):
                    reply.append(_narrow(part))
                if new:
                    seen = np.flatnonzero(values > 0)[::-1]
                    first = np.full(len(found), -1)
                    first[place[seen]] = seen  # the last that is written is the first in order
                    firsts = np.zeros(len(place), bool)
                    firsts[first[first >= 0]] = True
                    for reply, part in zip(replies, np.split(firsts, cuts), strict=bool(asking)):
                        reply.append(np.packbits(part))
                    if k == 1:
                        words = int(firsts.sum())
                else:
                    for reply in replies:
                        reply.append(np.zeros(0, np.uint8))
            for i, (c, reply) in enumerate(zip(asking, replies, strict=True)):
                yield c, (r, bucket, pack(*reply, level=1), words if i == 0 else 0)

    return run


SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(rounds: int, size: _Size, total: int, distinct: int):
    """The scores of each chunk's texts."""

    def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for _, rows in _by_key(pairs):
            chunk, _, ((base, score), known) = _replay(rows, rounds, size, total, distinct)
            part = pa.ipc.open_stream(rows[0][3]).read_next_batch()
            n = part.num_rows
            columns = [
                part.column(0),
                part.column(1),
                pa.array(np.diff(chunk.begin)),
                pa.array(np.bincount(chunk.doc, known, n).astype(np.int64)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(np.bincount(chunk.doc, base, n)),
                pa.array(np.bincount(chunk.doc, score, n)),
            ]
            yield from zip(*(c.to_pylist() for c in columns), strict=True)

    return run


def lm_scores(docs: DataFrame, held_out: object, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    ``held_out`` is a boolean column; rows where it is true train nothing. Null texts count as empty and consist of the
    end alone. Repeated rows count and are scored each. Without training texts every word is unknown. Base and score
    are sums over tokens of log10 probabilities: of the add-one unigram, and of the backoff automaton. Other columns,
    clashing names among them, are ignored; an empty table gives no rows. A text of any length is one chunk at most.
    """
    spark = ship(docs.sparkSession)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    n_bytes = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    coded = read.mapInArrow(_coder, "chunk long, n_tokens long, n_train long, payload binary, rows binary").rdd
    # Chunks, what they ask and what they are told meet by key. They are pairs in RDDs, as those keep the places they were
    # dealt to: a chunk and a hash are moved once, not again every round.
    parts = max(spark.sparkContext.defaultParallelism, coded.getNumPartitions(), n_bytes // (4 * CHUNK))
    home = coded.map(lambda r: (r[0], (-1, r[1], bytes(r[3]), bytes(r[4]), r[2]))).partitionBy(parts, _spread)
    tokens, total = home.map(lambda r: (r[1][1], r[1][4])).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    size = _Size(order, 1 << max(LEAST_BUCKETS - 1, n_bytes // BUCKET_BYTES).bit_length(), tokens)
    known, heard, distinct = home, None, 0
    for r in range(max(1, order)):
        asked = known.mapPartitions(_asker(r, size, total, distinct)).partitionBy(size.buckets >> 1, _pairs_of)
        heard = asked if heard is None else heard.union(asked)
        told = heard.mapPartitions(_answerer(r, size)).partitionBy(parts, _spread)
        if r == 0:
            distinct = told.map(lambda x: x[1][3]).sum()
        known = known.union(told)
    scored = known.mapPartitions(_scorer(max(1, order), size, total, distinct))
    return spark.createDataFrame(scored, SCORED.format(id=read.schema["doc_id"].dataType.simpleString()), verifySchema=False)


def op5(docs: DataFrame) -> DataFrame:
    """Texts whose crc32(doc_id) mod 7 is 2 are held out; a row without doc_id is not."""
    return lm_scores(docs, F.coalesce(crc32_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
