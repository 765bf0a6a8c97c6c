"""Language-model scoring: a log-bilinear model over words, trained by noise-contrastive estimation.

Every word of the shared dictionary has a context vector and a score vector of its own. The most frequent ones are classes of their own, the others
form groups of neighbours in frequency, about as many groups as words in each; words outside the dictionary fall into classes by their last two letters.
The vector of a context is the sum of the context vectors of the CONTEXT words before, each scaled for its distance; a class's score is the
product of that vector with its own plus a bias, and so is the score of a word in its group. Both are normalised, over all classes and over all words of the group, by
matrix products for a batch of positions. Only outside the dictionary words have their share of the class's count, with one place for
unknown words:

    P(word | context) = P(class | context) * P(word | class, context)                                in the dictionary (1 for a class of one word)
    P(word | context) = P(class | context) * (c + 1) / (N_class + V_class + 1)                       outside

Training is distributed: texts are dealt, by a hash of the row, into rounds and in these into shards of about SHARD positions, however the table is
partitioned. Every shard starts from the parameters of the round before and takes steps on each of its positions once; the parameters and the sums of
squares that set their step sizes are then averaged, weighted by positions. All rounds together see every position once. Counts cover all
training documents. The size of the dictionary is bounded by its words' share of the tokens, which also gives each of them several occurrences in a
shard. Of the words outside it, those above a smaller share are looked up with their counts, too; words too rare for that get their counts by a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import written
from marketloom.llm.quality import is_held_out

END = "\n"  # the token after the last word; no word has white space
FOLDS, HELD_FOLD = 7, 2
HEAD_SHARE = 100_000  # words that are at least one in so many tokens are in the shared dictionary: so many at most
COUNTED_SHARE = 400_000  # words that are at least one in so many tokens are looked up with their counts: so many at most
WORD_CLASSES, ENDING_CLASSES = 96, 32
CLASSES = WORD_CLASSES + ENDING_CLASSES
CONTEXT, WIDTH, NOISE, GROUP_NOISE = 4, 12, 24, 16
BATCH, RATE = 4096, 0.3
SHARD = 1_000_000  # positions that are trained on one after another
ROUNDS = (1, 4, 8, 16)  # where rounds end, in sixteenths of the texts
TASKS = 20_000  # at most so many tasks train in a round; beyond it a task trains several shards
SCORED = 512  # positions in one matrix product
TOGETHER = 65_536  # positions that are scored together
HELD_BATCHES = 32  # so many batches of positions are shuffled together
PARTIAL_WORDS = 400_000  # distinct words that a task counts before it hands them on
CACHED_WORDS = 300_000
LN10 = math.log(10)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in bytes, A-Z lower-cased, separated by ASCII white space; then the end."""
    found = (text or b"").lower().split()
    found.append(END.encode())
    return found


def ending_class(word: Column) -> Column:
    return F.lit(WORD_CLASSES) + F.pmod(F.crc32(F.right(word, F.lit(2))), F.lit(ENDING_CLASSES)).cast("int")


class Places(dict):
    """Place of a word in the shared dictionary; of any other word, the size of the dictionary plus its class. Words that are only ``counted``
    have numbers of their own above all places. Other words are remembered up to a bound."""

    def __init__(self, words: list[bytes], counted: list[bytes] = ()):
        super().__init__()
        self.words, self.counted = words, counted
        self._restart()
        places = np.array([self._class_place(word) for word in counted], np.int64)
        self.place_of = np.concatenate([np.arange(len(words) + CLASSES), places])

    def _restart(self) -> None:
        self.clear()
        self.update(zip(self.words, range(len(self.words))))
        first = len(self.words) + CLASSES
        self.update(zip(self.counted, range(first, first + len(self.counted))))

    def _class_place(self, word: bytes) -> int:
        end = word.decode("utf-8", "replace")[-2:].encode()
        return len(self.words) + WORD_CLASSES + zlib.crc32(end) % ENDING_CLASSES

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS + len(self.words) + len(self.counted):
            self._restart()
        self[word] = value = self._class_place(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words; ``place_of`` has the place of each number."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def group_bounds(words: int) -> np.ndarray:
    """Where groups of the dictionary's words after those that are classes begin, and the end of the last: about as many groups as words in each."""
    others = max(words - WORD_CLASSES, 0)
    size = math.isqrt(max(others - 1, 0)) + 1
    return np.minimum(np.arange(0, others + size, size), others)


def classes_of(words: list[bytes]) -> np.ndarray:
    """Class by place: the first words of the dictionary are classes of their own, the others form groups, all words outside fall into
    the classes of their endings."""
    groups = np.repeat(np.arange(len(group_bounds(len(words))) - 1), np.diff(group_bounds(len(words))))
    return np.concatenate([np.arange(min(WORD_CLASSES, len(words))), CLASSES + groups, np.arange(CLASSES)])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) of all texts; each task counts on its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def partial() -> pd.DataFrame:
            return pd.DataFrame({"token": [w.decode("utf-8", "replace") for w in held], "c": np.fromiter(held.values(), np.int64, len(held))})

        for batch in batches:
            for text in batch["text"]:
                held.update(tokens(text))
                if len(held) >= PARTIAL_WORDS:
                    yield partial()
                    held.clear()
        if held:
            yield partial()

    return docs.select("text").mapInPandas(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def sizes_of(words: int) -> tuple[int, ...]:
    """Numbers of parameters for a dictionary of so many words; without one, places are classes."""
    bounds = group_bounds(words)
    classes = CLASSES + len(bounds) - 1
    return (words + CLASSES) * WIDTH, CONTEXT * WIDTH, classes * WIDTH, classes, int(bounds[-1]) * WIDTH, int(bounds[-1])


class Parameters:
    """Context vectors R by place, distance scales C, class vectors Q and biases b, vectors T and biases t of the words in groups, as one flat
    array."""

    SIZES = sizes_of(0)

    def __init__(self, flat: np.ndarray, words: int = 0):
        self.flat, self.words, self.bounds = flat, words, group_bounds(words)
        at = np.cumsum((0, *sizes_of(words)))
        self.R = flat[at[0] : at[1]].reshape(-1, WIDTH)
        self.C = flat[at[1] : at[2]].reshape(CONTEXT, WIDTH)
        self.Q = flat[at[2] : at[3]].reshape(-1, WIDTH)
        self.b = flat[at[3] : at[4]]
        self.T = flat[at[4] : at[5]].reshape(-1, WIDTH)
        self.t = flat[at[5] : at[6]]

    @classmethod
    def start(cls, share: np.ndarray, in_group: np.ndarray, words: int) -> Parameters:
        """Small vectors and the log shares of classes, and of words in their groups, as biases: the unigram model."""
        random = np.random.default_rng(7)
        flat = (random.standard_normal(sum(sizes_of(words))) * 0.1).astype(np.float32)
        found = cls(flat, words)
        found.C[:] = 1 / CONTEXT
        found.b[:] = np.log(share)
        found.t[:] = np.log(in_group)
        return found

    def context_vectors(self, before: np.ndarray) -> np.ndarray:
        """The context vectors of positions with the places ``before`` them, one row for each distance."""
        out = self.R.take(before[0], axis=0) * self.C[0]
        for k in range(1, CONTEXT):
            out += self.R.take(before[k], axis=0) * self.C[k]
        return out

    def log_probabilities(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(target class | before), normalised over all classes."""
        return self._of_classes(self._contexts_in_parts(before), target)

    def word_log_probabilities(self, before: np.ndarray, place: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(word | before) for words of the dictionary, of P(target class | before) for others."""
        h = self._contexts_in_parts(before)
        out = self._of_classes(h, target)
        grouped = np.flatnonzero(target >= CLASSES)
        grouped = grouped[np.argsort(target[grouped], kind="stable")]
        first = np.searchsorted(target[grouped], np.arange(CLASSES, CLASSES + len(self.bounds)))
        bound = _longest(h) * _longest(self.T) + np.abs(self.t).max(initial=0)
        for group, (low, high) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            for start in range(first[group], first[group + 1], SCORED):
                at = grouped[start : min(start + SCORED, first[group + 1])]
                scores = h[at] @ self.T[low:high].T
                scores += self.t[low:high]
                out[at] += _normalised(scores, place[at] - WORD_CLASSES - low, bound)
        return out

    def _contexts_in_parts(self, before: np.ndarray) -> np.ndarray:
        scaled = [self.R * c for c in self.C]
        h = np.empty((before.shape[1], WIDTH), np.float32)
        for start in range(0, len(h), SCORED):
            part = slice(start, start + SCORED)
            h[part] = scaled[0].take(before[0, part], axis=0)
            for k in range(1, CONTEXT):
                h[part] += scaled[k].take(before[k, part], axis=0)
        return h

    def _of_classes(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        bound = _longest(h) * _longest(self.Q) + np.abs(self.b).max(initial=0)
        for start in range(0, len(target), SCORED):
            part = slice(start, start + SCORED)
            scores = h[part] @ self.Q.T
            scores += self.b
            out[part] = _normalised(scores, target[part], bound)
        return out


def _longest(vectors: np.ndarray) -> float:
    return math.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0))


def _normalised(scores: np.ndarray, own: np.ndarray, bound: float = math.inf) -> np.ndarray:
    """Log of the softmax of each row at its own column, of scores within 80 of 0, if not within the ``bound`` anyway; overwrites the scores."""
    if not bound < 79 and scores.size and (scores.max() > 80 or scores.min() < -80):
        np.clip(scores, -80, 80, out=scores)
    found = scores[np.arange(len(scores)), own].astype(np.float64)
    np.exp(scores, out=scores)
    return found - np.log(scores @ np.ones(scores.shape[1], np.float32))


def place_type(words: int) -> np.dtype:
    """The type in which places are stored, for a dictionary of so many words."""
    return np.dtype("<u2" if words + CLASSES <= 1 << 16 else "<u4")


def contexts(texts: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The places of all texts, one after another, and, for each distance, nearest first, the places that stand so far before each
    in its text; ends, whose place is 0, stand before the beginning."""
    ends = bytes(CONTEXT * kind.itemsize)
    padded = np.frombuffer(ends + ends.join(texts), kind)
    lengths = np.array([len(text) for text in texts]) // kind.itemsize
    at = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(texts) + 1) * CONTEXT, lengths)
    return padded[at], np.stack([padded[at - k] for k in range(1, CONTEXT + 1)])


def _sums(at: np.ndarray, columns: Iterable[np.ndarray], count: int) -> np.ndarray:
    """Sums of the rows, given by columns, that belong to each of ``count`` numbers."""
    out = np.empty((count, WIDTH), np.float32)
    for k, column in enumerate(columns):
        out[:, k] = np.bincount(at, column, count)
    return out


def _chance(scores: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(scores, -30, 30, out=scores)
    np.exp(np.negative(scores, out=scores), out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


class Trainer:
    """Noise-contrastive estimation by AdaGrad steps on batches. All positions of a batch share noise classes, which come from all classes, and all
    those of a group share noise words of that group, so that their scores are matrix products. Of places and words only those of the batch move."""

    def __init__(self, start: np.ndarray, squares: np.ndarray, share: np.ndarray, in_group: np.ndarray, class_at: np.ndarray, seed: int = 0):
        words = len(class_at) - CLASSES
        self.p, self.squares, self.class_at = Parameters(start.copy(), words), Parameters(squares.copy(), words), class_at
        self.log_noise = (np.log(share) + math.log(NOISE)).astype(np.float32)
        self.cumulative = np.cumsum(share)
        self.log_group_noise = (np.log(in_group) + math.log(GROUP_NOISE)).astype(np.float32)
        # Rises from g to g + 1 over the words of group g, so one search finds a word in any group.
        groups = [np.cumsum(in_group[low:high]) for low, high in zip(self.p.bounds[:-1], self.p.bounds[1:])]
        self.group_cumulative = np.concatenate([g + c / c[-1] for g, c in enumerate(groups)]) if groups else np.empty(0)
        self.random = np.random.default_rng([11, seed])
        self.slot = np.empty(max(len(self.p.R), len(self.p.T)), np.int64)
        self.scratch = np.empty(max(map(np.size, (self.p.R, self.p.C, self.p.Q, self.p.b, self.p.T, self.p.t))), np.float32)

    @staticmethod
    def first_squares(words: int) -> np.ndarray:
        """Sums of squared gradients before the first step."""
        found = Parameters(np.full(sum(sizes_of(words)), 1e-5, np.float32), words)
        for part in (found.C, found.Q, found.b):
            part[:] = 1e-2
        return found.flat

    def _move(self, name: str, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        g, p = getattr(self.squares, name), getattr(self.p, name)
        if at is None:
            held = self.scratch[: g.size].reshape(g.shape)
            g += np.multiply(gradient, gradient, out=held)
            gradient *= RATE
            gradient /= np.sqrt(g, out=held)
            p += gradient
        else:
            now = g[at] + gradient * gradient
            g[at] = now
            p[at] += RATE * gradient / np.sqrt(now)

    def _move_rows(self, vectors: str, at: np.ndarray, gradients: Iterable[np.ndarray], biases: str = "", errors: np.ndarray | None = None) -> None:
        """Moves the vectors, and biases, numbered ``at`` by the sums of their gradients, which come by columns. Where most rows of the table may occur, all
        are moved, most by sums and some by 0, which is cheaper than picking them."""
        count, ids, at = len(getattr(self.p, vectors)), None, at.astype(np.intp, copy=False)
        if count > 2 * len(at):
            ids, at = self._numbered(at)
            count = len(ids)
        self._move(vectors, _sums(at, gradients, count), ids)
        if biases:
            self._move(biases, np.bincount(at, errors, count).astype(np.float32), ids)

    def _numbered(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ids and, for each of ``ids``, the number of its own among them."""
        every = np.arange(len(ids))
        self.slot[ids] = every
        last = self.slot[ids]
        chosen = last == every
        return ids[chosen], (np.cumsum(chosen) - 1)[last]

    def step(self, before: np.ndarray, place: np.ndarray) -> None:
        p, n = self.p, len(place)
        order = np.argsort(self.class_at[place].astype(np.int16), kind="stable")  # positions of one class stand together
        before, place = before.take(order, axis=1), place[order].astype(np.int64)
        target = self.class_at[place]
        classes = len(p.b)
        rows = p.R.take(before, axis=0)
        h = rows[0] * p.C[0]
        for k in range(1, CONTEXT):
            h += rows[k] * p.C[k]
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), classes - 1)
        q, false_q = p.Q.take(target, axis=0), p.Q[noise]
        true = np.einsum("ij,ij->i", h, q) + (p.b - self.log_noise)[target]
        data = (1 - _chance(true)) / n
        false = h @ false_q.T
        false += p.b[noise] - self.log_noise[noise]
        _chance(false)
        false *= -1 / n
        firsts = np.flatnonzero(np.diff(target, prepend=-1))
        dq, db = np.zeros_like(p.Q), np.zeros_like(p.b)
        dq[target[firsts]] = np.add.reduceat(h * data[:, None], firsts)
        db[target[firsts]] = np.add.reduceat(data, firsts)
        np.add.at(dq, noise, false.T @ h)
        np.add.at(db, noise, false.sum(axis=0))
        dh = q * data[:, None]
        dh += false @ false_q
        grouped = np.searchsorted(target, CLASSES)
        if grouped < n:
            dh[grouped:] += self._words(h[grouped:], place[grouped:] - WORD_CLASSES, target[grouped:] - CLASSES, n)
        dc = np.stack([np.einsum("nw,nw->w", rows[k], dh) for k in range(CONTEXT)])
        scales, of_contexts = p.C.T.copy(), np.ascontiguousarray(dh.T)
        self._move_rows("R", before.ravel(), (np.multiply.outer(c, g).ravel() for c, g in zip(scales, of_contexts)))
        for name, gradient in (("C", dc), ("Q", dq), ("b", db)):
            self._move(name, gradient)

    def _words(self, h: np.ndarray, own: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        """Moves the vectors of words in groups, which stand in order of their group; returns the gradient of their context vectors."""
        p = self.p
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        found = group[starts]
        drawn = np.searchsorted(self.group_cumulative, found[:, None] + self.random.random((len(found), GROUP_NOISE)))
        noise = np.minimum(drawn, (p.bounds[found + 1] - 1)[:, None])
        vectors, biases = p.T[noise], p.t[noise] - self.log_group_noise[noise]
        mine = p.T.take(own, axis=0)
        data = (1 - _chance(np.einsum("ij,ij->i", h, mine) + (p.t - self.log_group_noise).take(own))) / n
        false = np.empty((len(own), GROUP_NOISE), np.float32)
        parts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(own)]))
        for g, (first, last) in enumerate(parts):
            np.dot(h[first:last], vectors[g].T, out=false[first:last])
        false += np.repeat(biases, np.diff([*starts, len(own)]), axis=0)
        _chance(false)
        false *= -1 / n
        dh = mine * data[:, None]
        moved = np.empty_like(vectors)
        for g, (first, last) in enumerate(parts):
            np.dot(false[first:last].T, h[first:last], out=moved[g])
            dh[first:last] += false[first:last] @ vectors[g]
        errors = np.concatenate([data, np.add.reduceat(false, starts).ravel()])
        gradients = np.concatenate([h * data[:, None], moved.reshape(-1, WIDTH)])
        self._move_rows("T", np.concatenate([own, noise.ravel()]), gradients.T, "t", errors)
        return dh


def train_on(texts: Iterator[bytes], trainer: Trainer, kind: np.dtype) -> int:
    """Takes steps on every position of the encoded texts once; returns how many there were."""
    held: list[bytes] = []
    waiting = seen = 0

    def steps() -> None:
        ids, before = contexts(held, kind)
        order = trainer.random.permutation(len(ids))  # neighbours in a batch come from many documents
        for first in range(0, len(order), BATCH):
            at = order[first : first + BATCH]
            trainer.step(before.take(at, axis=1), ids.take(at))
        held.clear()

    for text in texts:
        held.append(text)
        waiting += len(text) // kind.itemsize
        if waiting >= HELD_BATCHES * BATCH:
            steps()
            seen, waiting = seen + waiting, 0
    if waiting:
        steps()
    return seen + waiting


def _mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parameters averaged by weight, as one row."""
    total, weight = None, 0.0
    for batch in batches:
        for flat, w in zip(batch["flat"], batch["weight"]):
            part = np.frombuffer(flat, np.float32) * np.float64(w)
            total, weight = part if total is None else total + part, weight + w
    if weight:
        yield pd.DataFrame({"flat": [(total / weight).astype(np.float32).tobytes()], "weight": [weight]})


def train_round(texts: DataFrame, shards: int, start: np.ndarray, share: np.ndarray, in_group: np.ndarray, words: int) -> np.ndarray:
    """Parameters and squares, one after the other, after one run through the encoded texts (uid, places), dealt into so many shards; averaged over
    the shards, in two steps."""
    tasks = min(shards, TASKS)
    shared = texts.sparkSession.sparkContext.broadcast((start, share, in_group))
    kind = place_type(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, shares, in_groups = shared.value
        class_at = classes_of([b""] * words)

        def trained() -> Iterator[pd.DataFrame]:
            rows = (row for batch in batches for row in zip(batch["shard"], batch["places"]))
            for shard, of_shard in groupby(rows, key=lambda row: row[0]):
                trainer = Trainer(*np.split(flat, 2), shares, in_groups, class_at, shard)
                seen = train_on((places for _, places in of_shard), trainer, kind)
                yield pd.DataFrame({"flat": [np.concatenate([trainer.p.flat, trainer.squares.flat]).tobytes()], "weight": [float(seen)]})

        yield from _mean(trained())

    schema = "flat binary, weight double"
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit("shard")), F.lit(shards)))
    dealt = dealt.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "uid")
    mapped = dealt.select("shard", "places").mapInPandas(run, schema)
    row = mapped.repartition(math.isqrt(tasks)).mapInPandas(_mean, schema).repartition(1).mapInPandas(_mean, schema).first()
    return np.frombuffer(row["flat"], np.float32) if row else start


def train(texts: DataFrame, positions: int, share: np.ndarray, in_group: np.ndarray, words: int) -> np.ndarray:
    """The parameters after all rounds over the encoded texts (uid, places) with so many positions in all."""
    state = np.concatenate([Parameters.start(share, in_group, words).flat, Trainer.first_squares(words)])
    sixteenth = F.pmod(F.xxhash64("uid", F.lit("round")), F.lit(ROUNDS[-1]))
    for low, high in zip((0, *ROUNDS), ROUNDS):
        shards = max(1, round(positions * (high - low) / ROUNDS[-1] / SHARD))
        state = train_round(texts.where((sixteenth >= low) & (sixteenth < high)), shards, state, share, in_group, words)
    return np.split(state, 2)[0]


def encode(docs: DataFrame, words: list[bytes], logs: np.ndarray, known: np.ndarray, counted: list[bytes], counted_logs: np.ndarray) -> DataFrame:
    """Every text as the places of its tokens, split and looked up once for training and scoring, with the sums over the words of the shared
    dictionary and over those that are only counted, and the rarer words with their numbers; stored, with a number for each row."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((words, logs, known, counted, counted_logs))
    width = place_type(len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_words, log_of, is_known, counted_words, counted_log_of = shared.value
        size, places = len(found_words), Places(found_words, counted_words)
        log_of = np.concatenate([log_of, np.zeros(len(counted_words))])
        is_known = np.concatenate([is_known, np.ones(len(counted_words), bool)])
        place_of = places.place_of.astype(width)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            rare_words: list[str] = []
            times: list[int] = []
            ends = [0]
            for text in batch.column("text").to_pylist():
                words_of = tokens(text)
                at = places.of(words_of)
                rare = Counter([words_of[i] for i in np.flatnonzero((at >= size) & (at < size + CLASSES)).tolist()])
                counted_at = at[at >= size + CLASSES] - (size + CLASSES)
                rare_words += [w.decode("utf-8", "replace") for w in rare]
                times += rare.values()
                ends.append(len(times))
                values = (len(at), np.count_nonzero(is_known[at]), log_of[at].sum(), counted_log_of[counted_at].sum(), place_of[at].tobytes())
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(*x)) for x in ((rare_words, pa.string()), (times, pa.int64()))]
            arrays = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns, kinds), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "held_out", "n_tokens", "head_known", "head_log", "counted_log", "places", "rare", "times"]
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_log double, counted_log double, places binary,"
        " rare array<string>, times array<long>"
    )
    return written(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text under smoothed
    counts and under the model).

    Null texts are empty: their one token is the end. A null id is not held out. Repeated rows are scored alike. Without training documents
    all counts are 0. An empty table gives no rows.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), is_held_out(doc_id, FOLDS, HELD_FOLD).alias("held_out")
    )
    training = base.where(~F.col("held_out"))
    counts = written(count_tokens(training))
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = totals[0] or 0, totals[1]
    in_head = (F.col("c") * HEAD_SHARE >= n) | (F.col("token") == END)
    is_counted = ~in_head & (F.col("c") * COUNTED_SHARE >= n)
    found = [(r["token"], r["c"], r["counted"]) for r in counts.where(in_head | is_counted).select("token", "c", is_counted.alias("counted")).collect()]
    head = sorted(((w, c) for w, c, only_counted in found if not only_counted), key=lambda x: (-x[1], x[0]))
    looked_up = sorted((w, c) for w, c, only_counted in found if only_counted)
    vocabulary = [END] + [w for w, _ in head if w != END]  # the end has place and class 0
    words = [w.encode() for w in vocabulary]
    rest = counts.where(~in_head)
    by_class = rest.groupBy(ending_class(F.col("token")).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    count_of = dict(head)
    own = np.array([count_of.get(w, 0) for w in vocabulary], np.float64)
    class_at, bounds = classes_of(words), group_bounds(len(words))
    size = np.bincount(class_at[: len(words)], own, CLASSES + len(bounds) - 1)
    kinds = np.zeros(len(size))
    for row in by_class:
        size[row["k"]], kinds[row["k"]] = row["n"], row["v"]
    share = (size + 1) / (size + 1).sum()
    others = own[WORD_CLASSES:] + 1
    in_group = others / np.repeat(np.add.reduceat(others, bounds[:-1]), np.diff(bounds)) if len(others) else others

    # What is left of a word's probability once its class and, in a group, the word itself are scored.
    inside = np.zeros(len(size))
    inside[WORD_CLASSES:CLASSES] = np.log10((size + kinds + 1)[WORD_CLASSES:CLASSES])
    # By place: log10(c + 1) of the words of the dictionary, nothing for classes.
    logs, known = np.concatenate([np.log10(own + 1), np.zeros(CLASSES)]), np.concatenate([own > 0, np.zeros(CLASSES, bool)])
    counted_logs = np.log10(np.array([c for _, c in looked_up], np.float64) + 1)
    encoded = encode(base, words, logs, known, [w.encode() for w, _ in looked_up], counted_logs)
    flat = train(encoded.where(~F.col("held_out")).select("uid", "places"), n, share, in_group, len(words))

    tail = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("uid", "t.rare", "t.times")
    rare = rest.select(F.col("token").alias("rare"), "c").hint("shuffle_hash")
    sums = tail.join(rare, "rare").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_log"), F.sum("times").alias("tail_known")
    )
    joined = model_scores(encoded, flat, inside, len(words)).join(sums, "uid", "left")
    tail_log = F.col("counted_log") + F.coalesce("tail_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("class_log") + tail_log).alias("score"),
    )


def model_scores(encoded: DataFrame, flat: np.ndarray, inside: np.ndarray, words: int) -> DataFrame:
    """The encoded rows without their places and rarer words, with the model's log10 probability of each text but for the counts of the rarer words."""
    shared = encoded.sparkSession.sparkContext.broadcast((flat, inside))
    kept = ["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "counted_log"]
    kinds, width = dict(encoded.dtypes), place_type(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parameters, left = shared.value
        model, class_at = Parameters(parameters, words), classes_of([b""] * words)
        in_class = left[class_at]
        for batch in batches:
            texts, sums, first = batch["places"].tolist(), [], 0
            while first < len(texts):  # texts are scored together up to a bound, longer ones alone
                last, total = first, 0
                while last < len(texts) and total < TOGETHER:
                    total += len(texts[last]) // width.itemsize
                    last += 1
                places, before = contexts(texts[first:last], width)
                lengths = np.array([len(text) for text in texts[first:last]]) // width.itemsize
                logs = model.word_log_probabilities(before, places.astype(np.int64), class_at[places]) / LN10 - in_class[places]
                sums.append(np.add.reduceat(logs, np.cumsum(lengths) - lengths))
                first = last
            if texts:
                yield batch[kept].assign(class_log=np.concatenate(sums))

    return encoded.select(*kept, "places").mapInPandas(run, ", ".join(f"{name} {kinds[name]}" for name in kept) + ", class_log double")
