"""Language-model scoring: a log-bilinear neural model, trained with noise-contrastive estimation.

Corpus counts. A first pass counts every token of the training documents (words and one end per text); the table of all
counts stays distributed. The model's words are those that occur MIN_COUNT times at least, the MOST_WORDS most frequent at
most: their number grows with the corpus until the parameters take what MOST_WORDS allows (a few MB, in every task).
They stand in up to WORD_CLASSES classes of neighbouring ranks with about equal sums of the roots of their counts, so a
frequent word is a class of its own. Every other word is in one of TAIL classes by its last bytes.

Model. Context vector h = R[w1] C1 + R[w2] C2 (R: embeddings, C: a matrix per position). P(word) = P(class) P(word | class),
both log-bilinear: h . Q[x] + b[x] over all classes, and over the words of one class. A word of a tail class has
its count's share in the class (plus one, with one place for words never seen). So the probabilities of all texts sum to one.

Training is noise-contrastive: for every observed class NOISE classes are drawn from their unigram distribution (the draws
are shared by a batch), for every observed word NOISE_WORDS words from the unigram distribution of its class, and logistic
regression tells observed from drawn; no sum over outputs is taken. Each task learns from all tokens of its share of the
texts, from the same start, with numpy matrix products and Adagrad; shares hold SHARE_TOKENS tokens at least, so a corpus cut
into many small partitions is learnt no worse. Models are averaged row by row, weighted by how often a task's texts touched
the row, so tasks that never saw a word don't hold it back; ROUNDS such rounds are made (each starts from the last one's
average). What travels is one model a task.

Scoring. Distinct contexts of a piece go through one matrix product for the classes, tokens of a class through one for its
words; both are normalised by their sums. The counts of the most frequent tokens are broadcast (HEAD at most, whole steps of
counts); the other words of a text are joined with the distributed counts. Words outside the head are no hot keys in training
texts, as about HEAD words are at least as frequent; of those that only scored texts have, a text sends each once.

Defined results: null and empty texts are a single end token; without training tokens all words are unseen and scores
stay finite; null ids are in the fold of the empty text; repeated rows are scored each; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import Shared, crc_mod, release, small_batches, stage, table
from tagmill.llm.wordhash import BLANK_WORDS, Hasher, chunks, utf8

DIM = 16
#: Words of the model: how often they occur at least, and how many there are at most.
MIN_COUNT, MOST_WORDS = 10, 16_384
WORD_CLASSES, TAIL = 96, 64
HEAD = 200_000
#: Drawn classes a token, different draws a batch, drawn words a token.
NOISE, DRAWS, NOISE_WORDS = 10.0, 48, 1
RATE, ROUNDS = 0.15, 1
#: Tokens of a step of training, at most; a piece makes MIN_STEPS steps at least.
BATCH, MIN_STEPS = 16_384, 128
#: Contexts or tokens of a matrix product in scoring, and bytes of the texts that are scored together.
ROWS, SCORED_BYTES = 2048, 1 << 20
#: A training task has so many tokens at least, unless there are fewer.
SHARE_TOKENS = 4_000_000
#: Rows of the model that travel together.
MODEL_ROWS = 512
#: Tokens that a task holds at once (a longer text alone counts as one piece).
CHUNK = 1 << 21
#: A counter that grows beyond so many words is passed on and begun anew.
MOST_COUNTED = 500_000
#: The end of a text: no word can hold a blank.
END = b"\n"
FOLDS, HELD_OUT = 7, 2


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(BLANK_WORDS).split()


def class_of(word: bytes, classes: int = TAIL) -> int:
    return zlib.crc32(word[-3:]) % classes


def crc_table() -> np.ndarray:
    """Of zlib's CRC-32, by its rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def classes_of(hasher: Hasher, classes: int = TAIL) -> np.ndarray:
    """class_of() of all words that hasher hashed last."""
    last, held = hasher.last_bytes(3)
    step, crc = crc_table(), np.full(len(held), 0xFFFFFFFF, np.uint32)
    for k in range(3):
        there = held >= 3 - k
        crc = np.where(there, step[(crc ^ last[k]) & 255] ^ (crc >> 8), crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % classes).astype(np.int64)


def class_column(word: Column, classes: int = TAIL) -> Column:
    last = F.when(F.octet_length(word) > 3, F.substring(word, -3, 3)).otherwise(word)
    return F.pmod(F.crc32(last), F.lit(classes)).cast("int")


def counted(docs: DataFrame) -> DataFrame:
    """word (binary), n over the texts of docs (a column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                held.update(tokens_of(text))
                held[END] += 1
                if len(held) > MOST_COUNTED:
                    yield made(held)
                    held = Counter()
        yield made(held)
        del held
        release()

    def made(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ranks and counts of the head, the model's words and their classes, and the sizes of tail classes.

    A token's symbol is its rank if it is a word of the model, else `words` plus its tail class."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, types: int, words: int, by_tail: dict[int, tuple[int, int]], tail: int, word_classes: int, cut: int = -1):
        self.cut = cut  # words of this step of counts and below aren't in the head
        self.total, self.types, self.words, self.tail = total, types, words, tail
        self.head = [w for w, _ in head]
        self.counts = np.array([n for _, n in head], np.int64)
        self.by_tail = by_tail  # over all words that aren't words of the model: tokens, types
        self.symbols = words + tail
        roots = np.cumsum(np.sqrt(np.maximum(self.counts[:words], 1)))
        # a class ends where its share of the roots does; a large root may pass several ends
        at = np.minimum((roots - roots[:1] / 2) / (roots[-1:] / word_classes) if words else roots, word_classes - 1).astype(np.int64)
        self.first = np.append(np.flatnonzero(np.diff(at, prepend=-1)), words).astype(np.int64)  # classes' first words, and the end
        self.n_word_classes = len(self.first) - 1
        self.classes = self.n_word_classes + tail

    def prepare(self) -> Vocabulary:
        """Look-up tables, made once in each worker."""
        if hasattr(self, "log_count"):
            return self
        self.end = 0 if self.head else -1  # the head's first
        self.log_count = np.log10(self.counts + 1.0)
        sizes = [sum(self.by_tail.get(c, (0, 0))) + 1.0 for c in range(self.tail)]
        self.log_tail = np.log10(np.array(sizes))
        # of each symbol its class; of each class its share of tokens, of each word its share of the class
        sizes = np.diff(self.first)
        self.class_of = np.concatenate([np.repeat(np.arange(self.n_word_classes), sizes), self.n_word_classes + np.arange(self.tail)])
        self.size = np.concatenate([sizes, np.ones(self.tail, np.int64)])
        n = self.counts[: self.words].astype(np.float64) + 0.5
        inside = np.add.reduceat(n, self.first[:-1]) if self.words else np.zeros(0)
        share = np.concatenate([inside, [self.by_tail.get(c, (0, 0))[0] + 0.5 for c in range(self.tail)]])
        self.share = share / share.sum()
        self.part = n / np.repeat(inside, sizes)
        self.upto = np.cumsum(n)  # drawing words: the first whose sum exceeds a number between those of its class
        self.below = np.concatenate([[0.0], self.upto])[self.first]
        return self


class Symbols:
    """Ranks and symbols of the tokens of whole chunks of texts: the `most` first words of the head are known by their hashes."""

    def __init__(self, v: Vocabulary, most: int):
        self.v, self.hasher = v, Hasher(BLANK_WORDS)
        known = self.hasher.words([b" ".join(v.head[:most])])[0]  # the end, which is no word, comes first and splits away
        ranks = np.array([i for i, w in enumerate(v.head[:most]) if w != END], np.int64)
        order = np.argsort(known)
        self.known, self.ranks = known[order], ranks[order]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens, each text's end being its last: hashes (the end's is 0), ranks (-1 if not known) and symbols; tokens by text."""
        hashes, counts = self.hasher.words(texts)
        ranks = np.full(len(hashes), -1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            ranks = np.where(self.known[at] == hashes, self.ranks[at], ranks)
        symbols = np.where((ranks >= 0) & (ranks < self.v.words), ranks, self.v.words + classes_of(self.hasher, self.v.tail))
        ends = np.cumsum(counts + 1) - 1
        whole = np.ones(len(hashes) + len(texts), bool)
        whole[ends] = False
        end = self.v.words + class_of(END, self.v.tail) if self.v.end < 0 else self.v.end  # it has no rank where nothing was taught
        out = np.zeros(len(whole), np.uint64), np.full(len(whole), self.v.end), np.full(len(whole), end)
        for into, values in zip(out, (hashes, ranks, symbols), strict=True):
            into[whole] = values
        return *out, counts + 1

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for _, part in chunks(texts):
            *_, symbols, counts = self.read(part)
            yield from np.split(symbols, np.cumsum(counts)[:-1])

    def tail(self, hashes: np.ndarray, ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """What the last read() doesn't know: text, word and times of each distinct word of a text."""
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero((ranks < 0) & (hashes != 0))
        order = np.lexsort((hashes[at], owner[at]))
        at = at[order]
        new = np.flatnonzero((np.diff(hashes[at], prepend=np.uint64(0)) != 0) | (np.diff(owner[at], prepend=-1) != 0))
        word = at[new] - owner[at[new]]  # the ends before it are no words
        data, starts, ends = self.hasher.last
        whole = data.tobytes()
        return owner[at[new]], [whole[a:b] for a, b in zip(starts[word].tolist(), ends[word].tolist(), strict=True)], np.diff(np.append(new, len(at)))


def step_of(n: Column) -> Column:
    return F.floor(F.log2(n) * 64).cast("int")


def vocabulary(counts: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, tail: int = TAIL, head: int = HEAD, word_classes: int = WORD_CLASSES) -> Vocabulary:
    # a histogram of counts in steps of a 64th of a power of two says where the head ends, so that its words alone are sorted
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step_of(F.col("n")).alias("step")).count().collect()), reverse=True)
    held, cut = 0, -1
    for step, size in sizes:
        if held + size > head:
            cut = step
            break
        held += size
    # the end is always a word of the model
    top = counts.filter((step_of(F.col("n")) > cut) | (F.col("word") == END)).toArrow()
    pairs = sorted(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True), key=lambda x: (x[0] != END, -x[1], x[0]))
    words = min(most_words, max(1, sum(n >= min_count for _, n in pairs))) if pairs else 0
    sums = counts.groupBy(class_column(F.col("word"), tail).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, types = {r["c"]: r["n"] for r in sums}, {r["c"]: r["v"] for r in sums}
    total, kinds = sum(tokens.values()), sum(types.values())
    for w, k in pairs[:words]:  # the model's own words aren't in tail classes
        c = class_of(w, tail)
        tokens[c], types[c] = tokens[c] - k, types[c] - 1
    return Vocabulary(pairs, total, kinds, words, {c: (tokens[c], types[c]) for c in tokens}, tail, word_classes, cut)


class Model:
    """All parameters as rows of one matrix: r (symbols and the begin of a text), q (classes), p (words), c1, c2; and the biases of q and p."""

    def __init__(self, v: Vocabulary, rows: np.ndarray, biases: np.ndarray):
        self.rows, self.biases = rows, biases
        self.r, self.q, self.p, self.c1, self.c2 = np.split(rows, np.cumsum([v.symbols + 1, v.classes, v.words, DIM]))
        self.qb, self.pb = np.split(biases, [v.classes])

    @classmethod
    def start(cls, v: Vocabulary, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        rows = rng.normal(0, 0.1, (v.symbols + 1 + v.classes + v.words + 2 * DIM, DIM)).astype(np.float32)
        out = cls(v, rows, np.log(np.concatenate([v.share, v.part])).astype(np.float32))
        out.c1[:] = np.eye(DIM) + out.c1 / 10
        out.c2[:] = np.eye(DIM) / 2 + out.c2 / 10
        return out

    def like(self, v: Vocabulary, value: float) -> Model:
        return Model(v, np.full_like(self.rows, value), np.full_like(self.biases, value))

    def copy(self, v: Vocabulary) -> Model:
        return Model(v, self.rows.copy(), self.biases.copy())


def windows(symbols: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Context code (w1 * (begin + 1) + w2; w1 the nearer) and symbol of all tokens; `begin` stands before a text."""
    near, far = [], []
    for x in symbols:
        near.append(np.concatenate([[begin], x[:-1]]))
        far.append(np.concatenate([[begin, begin], x[:-2]])[: len(x)])
    return np.concatenate(near) * (begin + 1) + np.concatenate(far), np.concatenate(symbols)


class Places:
    """Sums of rows by place: the places that occur, and how often."""

    def __init__(self, at: np.ndarray):
        small = at.astype(np.uint16) if MOST_WORDS + TAIL < 1 << 16 else at  # these are sorted by their digits
        self.order = np.argsort(small, kind="stable")
        sorted_ = at[self.order]
        self.first = np.flatnonzero(np.diff(sorted_, prepend=-1))
        self.at, self.times = sorted_[self.first], np.diff(np.append(self.first, len(at)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.first)


def unlikely(odds: np.ndarray) -> np.ndarray:
    """1 - logistic(odds)."""
    np.exp(odds, out=odds)
    odds += 1
    return np.reciprocal(odds, out=odds)


class Learner:
    """NCE with Adagrad on the tokens of one task."""

    def __init__(self, v: Vocabulary, model: Model, seed: int, rate: float = RATE):
        self.v, self.m, self.g = v, model.copy(v), model.like(v, 1.0)
        self.times = np.zeros(len(model.rows), np.float64)
        self.ends = dict(zip(("r", "q", "p", "c1", "c2"), np.cumsum([0, v.symbols + 1, v.classes, v.words, DIM]).tolist(), strict=True))
        self.rate, self.seen, self.rng = rate, 0, np.random.default_rng(seed)
        self.draw = np.cumsum(v.share)
        self.shift = np.log(NOISE * v.share).astype(np.float32)
        self.word_shift = np.log(NOISE_WORDS * v.part).astype(np.float32)

    def learn(self, context: np.ndarray, symbol: np.ndarray) -> None:
        n = len(symbol)
        steps = max(-(-n // BATCH), min(MIN_STEPS, -(-n // 64)))
        near, far = (x.astype(np.int32) for x in np.divmod(context, self.v.symbols + 1))
        symbol = symbol.astype(np.int32)
        for part in np.array_split(self.rng.permutation(n), steps):
            self.step(near[part], far[part], symbol[part])
        self.seen += n

    def noise(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drawn classes of a batch; which tokens choose among several words; the words drawn for each, one row a draw."""
        v = self.v
        classes = np.minimum(np.searchsorted(self.draw, self.rng.random(DRAWS), "right"), v.classes - 1)
        c = v.class_of[symbol]
        some = np.flatnonzero(v.size[c] > 1)
        lo, hi = v.below[c[some]], v.below[c[some] + 1]
        words = np.searchsorted(v.upto, lo + self.rng.random((NOISE_WORDS, len(some))) * (hi - lo), "right")
        return classes, some, np.minimum(words, v.first[c[some] + 1] - 1)

    def gradients(self, near: np.ndarray, far: np.ndarray, symbol: np.ndarray, classes: np.ndarray, some: np.ndarray, words: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Of each group of rows those touched, how often, and the ascent of the log-likelihood of telling observed from drawn, of rows and of biases."""
        m = self.m
        # a context word's part of h is made once a batch, however often the word stands there
        sides = [(Places(w), name) for w, name in ((near, "c1"), (far, "c2"))]
        h = np.zeros((len(symbol), DIM), np.float32)
        for p, name in sides:
            h[p.order] += np.repeat(m.r[p.at] @ getattr(m, name), p.times, 0)
        c = self.v.class_of[symbol]
        own, drawn = m.q[c], m.q[classes]
        up = unlikely(np.einsum("td,td->t", h, own) + (m.qb - self.shift)[c])
        down = h @ drawn.T
        down += (m.qb - self.shift)[classes]
        down = unlikely(down)
        down -= 1
        down *= np.float32(NOISE / DRAWS)
        dh = down @ drawn
        own *= up[:, None]
        dh += own
        p = Places(c)
        dq, db, times = np.zeros_like(m.q), np.zeros_like(m.qb), np.zeros(len(m.q))
        dq[p.at], db[p.at], times[p.at] = p.sums(up[:, None] * h), p.sums(up), p.times
        np.add.at(dq, classes, down.T @ h)
        np.add.at(db, classes, down.sum(0))
        np.add.at(times, classes, len(symbol) * NOISE / DRAWS)
        out = {"q": (np.arange(len(dq)), times, dq, db)}
        if len(some):
            hs, x = h[some], symbol[some]
            every, weight = [x, *words], []
            add = np.zeros_like(hs)
            for k, w in enumerate(every):
                row = m.p[w]
                g = unlikely(np.einsum("td,td->t", hs, row) + (m.pb[w] - self.word_shift[w]))
                if k:
                    g -= 1
                row *= g[:, None]
                add += row
                weight.append(g)
            dh[some] += add
            p, g = Places(np.concatenate(every)), np.concatenate(weight)
            out["p"] = p.at, p.times, p.sums(np.concatenate([w[:, None] * hs for w in weight])), p.sums(g)
        both = []
        for p, name in sides:
            sums, r, matrix = p.sums(dh), m.r[p.at], getattr(m, name)
            out[name] = np.arange(DIM), np.full(DIM, len(symbol)), r.T @ sums, None
            both.append((p.at, p.times, sums @ matrix.T))
        p = Places(np.concatenate([x[0] for x in both]))
        out["r"] = p.at, np.add.reduceat(np.concatenate([x[1] for x in both])[p.order], p.first), p.sums(np.concatenate([x[2] for x in both])), None
        return out

    def step(self, near: np.ndarray, far: np.ndarray, symbol: np.ndarray) -> None:
        for name, (at, times, d, bias) in self.gradients(near, far, symbol, *self.noise(symbol)).items():
            for part, value in ((name, d), (name + "b", bias)):
                if value is not None:
                    rows, g = getattr(self.m, part), getattr(self.g, part)
                    g[at] = past = g[at] + value * value
                    rows[at] += self.rate * value / np.sqrt(past)
            self.times[self.ends[name] + at] += times


def pieces(texts: Iterator[tuple], size: int = CHUNK) -> Iterator[list[tuple]]:
    """Groups (tokens' outputs last) into lists of about size tokens."""
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += len(x[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(docs: DataFrame, v: Vocabulary, shared, rounds: int = ROUNDS, share_tokens: int = SHARE_TOKENS) -> Model:
    """The average model of all tasks; docs has a column text. shared: the broadcast vocabulary."""
    spark = docs.sparkSession
    model = Model.start(v.prepare())
    if not v.total:
        return model
    texts = docs.select("text").coalesce(max(1, v.total // share_tokens))
    biased = slice(v.symbols + 1, v.symbols + 1 + v.classes + v.words)
    for turn in range(rounds):
        begun = spark.sparkContext.broadcast((model.rows, model.biases))

        def run(batches: Iterator[pa.RecordBatch], begun=begun, turn=turn) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            voc = shared.value.prepare()
            learner, symbols = Learner(voc, Model(voc, *begun.value), part, RATE / (1 + turn)), Symbols(voc, voc.words)
            found = ((x,) for batch in batches for x in symbols.of(utf8(batch.column(0))))
            for piece in pieces(found):
                with np.errstate(over="ignore"):  # exp() to infinity is a probability of 0
                    learner.learn(*windows([x[0] for x in piece], voc.symbols))
            if learner.seen:
                out = np.zeros((len(learner.m.rows), DIM + 2), np.float32)  # rows, biases, and how often a row was touched
                out[:, :DIM], out[biased, DIM] = learner.m.rows, learner.m.biases
                out *= learner.times[:, None]
                out[:, DIM + 1] = learner.times
                del learner
                for at in range(0, len(out), MODEL_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([out[at : at + MODEL_ROWS].tobytes()], pa.binary())], names=["at", "part", "x"])
            release()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = lambda at, x: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["at", "x"])
            now, total = None, None
            for batch in batches:
                for at, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if at != now:
                        if now is not None:
                            yield made(now, total)
                        now, total = at, 0.0
                    total = total + np.frombuffer(x.as_py(), np.float32).astype(np.float64)
            if now is not None:
                yield made(now, total)

        # in the order of tasks, so that the same sums come out
        sums = texts.mapInArrow(run, "at int, part int, x binary").repartition("at").sortWithinPartitions("at", "part").mapInArrow(add, "at int, x binary").toArrow()
        whole = np.zeros((len(model.rows), DIM + 2))
        for at, x in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
            got = np.frombuffer(x, np.float64).reshape(-1, DIM + 2)
            whole[at : at + len(got)] = got
        touched = whole[:, -1] > 0
        means = whole[touched, :-1] / whole[touched, -1:]
        model.rows[touched] = means[:, :DIM]
        both = np.zeros(len(model.rows), np.float32)
        both[biased] = model.biases
        both[touched] = means[:, DIM]
        model.biases[:] = both[biased]
    return model


class Scorer:
    """Normalised log-probabilities of a model."""

    def __init__(self, v: Vocabulary, model: Model):
        self.v, self.m = v, model
        self.near, self.far = model.r @ model.c1, model.r @ model.c2

    def log_probabilities(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural logs; a row of a matrix product for each distinct context, and for each token that is one of a class."""
        v, m = self.v, self.m
        own, which = np.unique(context, return_inverse=True)
        near, far = np.divmod(own, v.symbols + 1)
        h = self.near[near]
        h += self.far[far]
        out, c = np.empty(len(symbol)), v.class_of[symbol]
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(0, len(own) + ROWS, ROWS))
        for k, lo in enumerate(range(0, len(own), ROWS)):
            mine = order[ends[k] : ends[k + 1]]
            out[mine] = chosen(h[lo : lo + ROWS], m.q, m.qb, which[mine] - lo, c[mine])
        some = np.flatnonzero(v.size[c] > 1)
        some = some[np.argsort(c[some].astype(np.uint16), kind="stable")]
        for lo, hi in zip(*bounds_of(c[some]), strict=True):
            first, last = v.first[c[some[lo]]], v.first[c[some[lo]] + 1]
            for at in range(lo, hi, ROWS):
                mine = some[at : min(hi, at + ROWS)]
                out[mine] += chosen(h[which[mine]], m.p[first:last], m.pb[first:last], np.arange(len(mine)), symbol[mine] - first)
        return out


def bounds_of(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return first, np.append(first, len(sorted_))[1:]


def chosen(h: np.ndarray, rows: np.ndarray, biases: np.ndarray, at: np.ndarray, output: np.ndarray) -> np.ndarray:
    """Log-softmax over the outputs (rows, biases) of the contexts h, at some places."""
    scores = h @ rows.T
    scores += biases
    own = scores[at, output]
    with np.errstate(over="ignore"):
        total = np.exp(scores).sum(1)
    if total.min() > 1e-30 and total.max() < 1e30:
        return own - np.log(total)[at]
    top = scores.max(1)  # beyond the range of exp()
    return own - (top + np.log(np.exp(scores - top[:, None]).sum(1)))[at]


OUT = "rid long, word binary, times int, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, score double"


def score_texts(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows where held_out isn't true train."""
    spark = docs.sparkSession
    small_batches(spark)
    held = held_out if held_out is not None else crc_mod(docs[id_col], FOLDS) == HELD_OUT
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("text"))
    taught = rows.filter(~F.col("held_out"))
    counts = stage(counted(taught), "lm-counts")
    v = vocabulary(counts)
    shared = Shared(spark, v)
    model = Shared(spark, Scorer(v.prepare(), train(taught, v, shared)))
    id_type = dict(rows.dtypes)["doc_id"]
    schema = OUT.format(id=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        voc = scorer.v
        base_log = math.log10(voc.total + voc.types + 1)
        log10 = math.log(10)
        reader = Symbols(voc, len(voc.head))
        known = np.append(voc.log_count, 0.0)  # the last: of what is not in the head, or the end where nothing was taught
        for batch in batches:
            for first, part in chunks(utf8(batch.column(3)), SCORED_BYTES):
                hashes, ranks, symbols, lengths = reader.read(part)
                begins = np.cumsum(lengths) - lengths
                logs = scorer.log_probabilities(*windows(np.split(symbols, begins[1:]), voc.symbols)) / log10
                count_log = known[ranks]
                rare = symbols >= voc.words
                logs[rare] += count_log[rare] - voc.log_tail[symbols[rare] - voc.words]
                which, words, times = reader.tail(hashes, ranks, lengths)
                own, n = batch.slice(first, len(part)), len(part)
                rid = own.column(0)
                lone = lambda values, kind, n=len(words): pa.concat_arrays([pa.array(values, kind), pa.nulls(n, kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([rid, rid.take(pa.array(which))]),
                        # the key of a text's own row is no word and differs from row to row
                        pa.array([b" %d" % i for i in rid.to_pylist()] + words, pa.binary()),
                        pa.concat_arrays([pa.array(np.zeros(n, np.int32)), pa.array(times, pa.int32())]),
                        pa.concat_arrays([own.column(1), pa.nulls(len(words), own.column(1).type)]),
                        pa.concat_arrays([own.column(2), pa.nulls(len(words), pa.bool_())]),
                        lone(lengths, pa.int64()),
                        lone(np.add.reduceat((ranks >= 0).astype(np.int64), begins), pa.int64()),
                        lone(np.add.reduceat(count_log, begins) - lengths * base_log, pa.float64()),
                        lone(np.add.reduceat(logs, begins), pa.float64()),
                    ],
                    names=[x.split()[0] for x in schema.split(", ")],
                )
        release()

    scored = rows.mapInArrow(run, schema)
    rest = counts.filter((step_of(F.col("n")) <= v.cut) & (F.col("word") != END))
    joined = scored.join(rest.select(F.col("word").alias("w"), "n"), F.col("word") == F.col("w"), "left")
    more = F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") + F.lit(1.0))).otherwise(F.lit(0.0))
    whole = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        (F.max("base") + F.sum(more)).alias("base_score"),
        (F.max("score") + F.sum(more)).alias("score"),
    )
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
