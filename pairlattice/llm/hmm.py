"""Hidden Markov language model: Baum-Welch counts added across partitions, exact scaled forward scores.

Hidden states emit word classes, and a class emits its words. A word holding at least
1/``OWN_CLASS`` of all training tokens is a class of its own; the others share classes by
their last letters, and within such a class have smoothed relative frequencies
(c + 0.5) / (N_b + 0.5 (V_b + 1)), one unseen word included, so the model is a proper
distribution over words and ends. As words depend on states through classes only, the scaled
forward recursion over classes, times each word's share of its class, is the text's exact
likelihood.

Baum-Welch starts with one round on each of ``PARTS_FIRST`` parts of the training rows, so that these rounds
together read every row once, at any size. Rounds over all training rows follow until the likelihood of
a token gains less than ``SETTLED``; as it is below 0, that ends. Tasks send expected
counts (states by classes, a fixed size) that are added in two levels.

A text is looked up word by word once, after counting, and written as two bytes a word with
what the base score needs; rounds and scoring read that.

Word counts are a table that grows with the corpus and never leaves Spark. Words holding
1/``SENT`` of the tokens (at most ``SENT`` of them, whatever the corpus) are sent to tasks;
the tokens of all rarer words meet the count table in a join.

Defined cases: a null or empty text is an end alone; a null doc_id is trained on; repeated
rows are scored row by row; with no training rows every count is 0 and all states are equal;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.llm.common import bounded_batches, sum_arrays, sum_parts, written

STATES, SHARED_CLASSES = 8, 1024
OWN_CLASS, SENT = 1 << 14, 1 << 19
PARTS_FIRST, SETTLED, SEED = 8, 0.002, 5
#: Tokens whose recursion runs side by side, tokens gathered to choose texts of like length from, steps between scalings.
TOGETHER, GATHERED, SCALED = 100_000, 1_500_000, 8
#: Words that a worker keeps at most, their bytes at most, and bytes of a text whose words are held at a time.
FLUSH, KEPT_BYTES, PART = 400_000, 64 << 20, 4 << 20
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """A text's words, some bytes of it at a time: whatever its length, few words are held; at least one part."""
    data, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at + PART < len(data) and (gap := _GAP.search(data, at + PART)):
        yield data[at : gap.start()].split()
        at = gap.start()
    yield data[at:].split()


def shared_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:] + (b"#" if not word[-1:].isalpha() and word[-1:] < b"\x80" else b"")) % SHARED_CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, bucket, c): training count of each word by its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_pydict({"h": np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64), "bucket": pa.array(map(shared_class, words), pa.int32()), "c": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in word_parts(text):
                    seen.update(words)
                    if len(seen) > FLUSH:
                        yield flush()
        if seen:
            yield flush()

    rows = docs.select("text").mapInArrow(run, "h long, bucket int, c long")
    return rows.groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What tasks know of words: hashes sent (sorted), their counts and classes, and the shared classes' sums."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    shared_log: np.ndarray  # log10 of each shared class's denominator
    n_classes: int  # own classes, shared classes, the end
    tokens: int
    types: int
    docs: int
    unigram: np.ndarray  # class probabilities
    tag: str = ""


def lexicon(counts: DataFrame, docs: int) -> Lexicon:
    total = counts.agg(F.sum("c"), F.count("*")).first()
    words, types = total[0] or 0, total[1]
    tokens = words + docs
    sent = sorted((r["h"], r["c"], r["bucket"]) for r in counts.filter(F.col("c") * SENT >= max(1, words)).collect())
    h, c, b = (np.array([r[i] for r in sent], np.int64) for i in range(3))
    own = c * OWN_CLASS >= max(1, words)
    n_own = int(own.sum())
    classes = np.where(own, np.cumsum(own) - 1, n_own + b).astype(np.int64)
    per = counts.filter(F.col("c") * OWN_CLASS < max(1, words)).groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(SHARED_CLASSES), np.zeros(SHARED_CLASSES)
    for r in per:
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    mass = np.concatenate((c[own] + 0.5, n + 0.5 * (v + 1), [docs + 0.5]))
    order = np.argsort(h.view(np.uint64), kind="stable")
    return Lexicon(h[order], c[order], classes[order], np.log10(n + 0.5 * (v + 1)), n_own + SHARED_CLASSES + 1, tokens, types + (docs > 0), docs, mass / mass.sum(), uuid.uuid4().hex)


class Words(dict):
    """word -> place in the arrays of its class, log10(c + 0.5), hash and whether the lexicon holds it.

    New words only get a place; ``settle`` looks all of them up at once. Starts anew when full.
    """

    def __init__(self, lex: Lexicon) -> None:
        self.lex, self.keys64 = lex, lex.hashes.view(np.uint64)
        self.lex_logs = np.log10(lex.counts + 0.5)
        self.first_shared = lex.n_classes - 1 - SHARED_CLASSES
        self.new: list[bytes] = []
        self.room(FLUSH)

    def room(self, n: int) -> None:
        self.clear()
        self.held = 0
        self.classes, self.logs, self.shared, self.hash, self.sent = np.empty(n, np.int32), np.empty(n), np.empty(n), np.empty(n, np.uint64), np.empty(n, bool)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def settle(self) -> None:
        if not self.new:
            return
        at = slice(len(self) - len(self.new), len(self))
        self.held += sum(map(len, self.new))
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.new), np.uint64, len(self.new))
        known = np.zeros(len(h), bool)
        if len(self.keys64):
            place = np.minimum(np.searchsorted(self.keys64, h), len(self.keys64) - 1)
            known = self.keys64[place] == h
        k = np.empty(len(h), np.int64)
        k[~known] = [self.first_shared + shared_class(w) for w, x in zip(self.new, known.tolist(), strict=True) if not x]
        logs = np.zeros(len(h))
        if known.any():
            k[known], logs[known] = self.lex.classes[place[known]], self.lex_logs[place[known]]
        shared = np.where(k >= self.first_shared, self.lex.shared_log[np.maximum(k - self.first_shared, 0)], np.nan)
        self.classes[at], self.logs[at], self.shared[at], self.hash[at], self.sent[at] = k, logs, shared, h, known
        self.new = []

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > len(self.logs) or self.held > KEPT_BYTES:
            self.room(max(FLUSH, len(words)))
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.settle()
        return out


_KEPT: dict[str, Words] = {}


def kept_words(lex: Lexicon) -> Words:
    """The worker's table of words for a lexicon; tasks and rounds on one worker share it."""
    if lex.tag not in _KEPT:
        _KEPT.clear()
        _KEPT[lex.tag] = Words(lex)
    return _KEPT[lex.tag]


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (classes + 1, K); the last row is padding: probability 1


def first_model(lex: Lexicon) -> Model:
    rng = np.random.default_rng(SEED)
    emit = lex.unigram[:, None] * np.exp(0.5 * rng.standard_normal((lex.n_classes, STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES), move, np.vstack((emit / emit.sum(0), np.ones(STATES))))


def _groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts of like length together, so that padding is little."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    group: list[int] = []
    for i in order:
        n = len(texts[i])
        if group and (n * (len(group) + 1) > TOGETHER or n > 1.3 * len(texts[group[0]]) + 20):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _emitted(model: Model, x: np.ndarray) -> np.ndarray:
    """(T, B, K): the emission probabilities of (T, B) classes."""
    return np.take(model.emit, x.ravel().astype(np.intp), axis=0).reshape(*x.shape, STATES)


def _steps(model: Model, e: np.ndarray, first: int, length: int, a: np.ndarray | None, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The recursion over steps with emissions e, from number first of length: the values after them, and the logarithms of the scales taken out.

    a: the values before, None at the start. Forward values are scaled to sum 1 every SCALED steps, which keeps them far from underflow.
    """
    log = np.zeros(e.shape[1])
    out = np.empty((2, e.shape[1], STATES)) if alpha is None else alpha
    for t in range(first, first + len(e)):
        now = out[(t - first) % len(out)]
        if t:
            np.matmul(a, model.move, out=now)
            now *= e[t - first]
        else:
            np.multiply(model.start, e[0], out=now)
        if t % SCALED == SCALED - 1 or t == length - 1:
            s = now.sum(1)
            now /= s[:, None]
            log += np.log(s)
        a = now
    return a.copy(), log


def _blocks(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of steps whose values are held together: all of a group of several texts, of a long one twice TOGETHER tokens."""
    size = max(SCALED, 2 * TOGETHER // x.shape[1] // SCALED * SCALED)
    return [(t, min(t + size, len(x))) for t in range(0, len(x), size)]


def forward(model: Model, x: np.ndarray) -> np.ndarray:
    """x: (T, B) classes -> natural log-likelihood of each column."""
    a, log = None, np.zeros(x.shape[1])
    for first, last in _blocks(x):
        a, more = _steps(model, _emitted(model, x[first:last]), first, len(x), a)
        log += more
    return log


def padded(texts: list[np.ndarray], pad: int) -> np.ndarray:
    x = np.full((max(map(len, texts)), len(texts)), pad, np.int32)
    for j, t in enumerate(texts):
        x[: len(t), j] = t
    return x


def expected_counts(model: Model, texts: list[np.ndarray], into: np.ndarray) -> float:
    """Adds the forward-backward counts: K starts, K x K moves, then classes x K emissions. Gives the texts' log-likelihood.

    Forward and backward values are known up to a factor per step and text, which the posteriors'
    own sums take out. Of a long text the forward values before each block of steps are kept, and those of a block
    are worked out again on the way back, so memory is that of one block and two bytes a token.
    """
    k, pad, likely = STATES, len(model.emit) - 1, 0.0
    counts, back = into[k + k * k :].reshape(pad, k), model.move.T.copy()
    for group in _groups(texts):
        x = padded([texts[i] for i in group], pad)
        blocks, before = _blocks(x), [None]
        for first, last in blocks[:-1]:
            a, log = _steps(model, _emitted(model, x[first:last]), first, len(x), before[-1])
            likely += float(log.sum())
            before.append(a)
        moved, following = np.zeros((k, k)), None  # following: emission times backward value of the first step of the later block
        for (first, last), a in zip(reversed(blocks), reversed(before)):
            alpha = np.empty((last - first, x.shape[1], k))
            e, beta = _emitted(model, x[first:last]), np.empty_like(alpha)
            _, log = _steps(model, e, first, len(x), a, alpha)
            if following is None:
                likely += float(log.sum())
            after = np.empty((last - first + 1, x.shape[1], k))  # after[t]: emission times backward value at t
            if following is None:
                after[-2], beta[-1] = e[-1], 1.0
            else:
                after[-1] = following
            for t in range(last - 1 if following is not None else last - 2, first - 1, -1):
                i = t - first
                b = np.matmul(after[i + 1], back, out=beta[i])
                if t % SCALED == 0:
                    s = b.sum(1, keepdims=True)
                    b /= s
                    after[i + 1] /= s
                np.multiply(e[i], b, out=after[i])
            gamma = np.multiply(alpha, beta, out=beta)
            total = gamma.sum(2, keepdims=True)
            n = last - first - (following is None)  # steps that move on
            seen = x[first + 1 : first + 1 + n, :, None] != pad
            moved += (alpha[:n] / total[:n]).reshape(-1, k).T @ (after[1 : n + 1] * seen).reshape(-1, k)
            gamma /= total
            if first == 0:
                into[:k] += gamma[0].sum(0)
            flat, g = x[first:last].ravel().astype(np.intp), gamma.reshape(-1, k)
            for s in range(k):
                counts[:, s] += np.bincount(flat, weights=g[:, s], minlength=pad + 1)[:pad]
            following = after[0]
        into[k : k + k * k] += (model.move * moved).ravel()
    return likely


def next_model(lex: Lexicon, counts: np.ndarray) -> Model:
    k = STATES
    start = counts[:k] + 1.0
    move = counts[k : k + k * k].reshape(k, k) + 1.0 + 9.0 * np.eye(k)
    emit = counts[k + k * k :].reshape(lex.n_classes, k) + 200.0 * lex.unigram[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), np.vstack((emit / emit.sum(0), np.ones(k))))


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Every row of docs (doc_id, text, held_out) by one look at its text: a row number, what needs no model, and its words' classes.

    classes are the text's classes with the end, two bytes each (there are under 2^16 of them); rare
    and times are the words that the lexicon does not hold and how often each occurs.
    """
    sent_lex = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx = sent_lex.value
        known, end, row = kept_words(lx), np.uint16(lex_end(lx)), TaskContext.get().partitionId() << 40
        end_log = math.log10(lx.docs + 0.5)
        for batch in batches:
            n, n_known, logs, shares, rare, times, classes = ([] for _ in range(7))
            for text in batch.column(1).to_pylist():
                length, of_lexicon, log, share, hashes, times_of, held = 1, int(lx.docs > 0), end_log, 0.0, [], [], []
                for words in word_parts(text):
                    at = known.of(words)
                    sent, shared = known.sent[at], known.shared[at]
                    inside = ~np.isnan(shared)
                    h, k = np.unique(known.hash[at[~sent]], return_counts=True)
                    hashes.append(h)
                    times_of.append(k)
                    length += len(at)
                    of_lexicon += int(sent.sum())
                    log += float(known.logs[at].sum())
                    share += float((known.logs[at] - shared)[inside].sum())
                    held.append(known.classes[at].astype(np.uint16))
                h, k = hashes[0], times_of[0]
                if len(hashes) > 1:
                    h, place = np.unique(np.concatenate(hashes), return_inverse=True)
                    k = np.bincount(place, np.concatenate(times_of), len(h))
                n.append(length)
                n_known.append(of_lexicon)
                logs.append(log)
                shares.append(share)
                rare.append(h.view(np.int64))
                times.append(k.astype(np.int32))
                held.append(end)
                classes.append(b"".join(x.tobytes() for x in held))
            rows = np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_pydict({"row": rows, "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "logs": pa.array(logs, pa.float64()), "shares": pa.array(shares, pa.float64()), "rare": pa.array(rare, pa.list_(pa.int64())), "times": pa.array(times, pa.list_(pa.int32())), "classes": pa.array(classes, pa.binary())})

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, shares double, rare array<long>, times array<int>, classes binary")


def _decoded(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def train_round(encoded: DataFrame, lex: Lexicon, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all rows of encoded (classes): the next model, and the mean log-likelihood of a token by this one.

    Counts are made in tasks and added across partitions.
    """
    now = encoded.sparkSession.sparkContext.broadcast(model)
    n = STATES + STATES**2 + lex.n_classes * STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n + 2)  # then log-likelihood and tokens

        def add(texts: list[np.ndarray]) -> None:
            counts[n] += expected_counts(now.value, texts, counts[:n])
            counts[n + 1] += sum(map(len, texts))

        texts, held = [], 0
        for batch in batches:
            more = _decoded(batch.column(0))
            texts += more
            held += sum(map(len, more))
            if held > GATHERED:
                add(texts)
                texts, held = [], 0
        add(texts)
        yield from sum_parts(counts)

    counts = sum_arrays(encoded.select("classes").mapInArrow(run, "part int, spread int, counts binary"))
    now.unpersist()
    if not len(counts) or not counts[n + 1]:
        return model, 0.0
    return next_model(lex, counts[:n]), counts[n] / counts[n + 1]


def train_model(encoded: DataFrame, lex: Lexicon, model: Model) -> Model:
    """Rounds on the parts of encoded (row, classes), then full rounds until a token's likelihood settles."""
    for part in range(PARTS_FIRST):
        model, _ = train_round(encoded.filter(F.pmod("row", F.lit(PARTS_FIRST)) == part), lex, model)
    before, likely = -math.inf, None
    while likely is None or likely - before >= SETTLED:
        before = before if likely is None else likely
        model, likely = train_round(encoded, lex, model)
    return model


def baum_welch(docs: DataFrame, lex: Lexicon, model: Model, rounds: int) -> Model:
    """Rounds over all rows of docs (text)."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"))
    encoded = written(encode(rows, lex))
    for _ in range(rounds):
        model, _ = train_round(encoded, lex, model)
    return model


def lex_end(lex: Lexicon) -> int:
    return lex.n_classes - 1


def score(docs: DataFrame, held_out: str = "crc32(coalesce(cast(doc_id as string), '')) % 5 = 1") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(held_out).alias("held_out"))
    train = docs.filter("not held_out")
    counts = written(word_counts(train))
    n_train = train.count()
    lex = lexicon(counts, n_train)
    encoded = written(encode(docs, lex))
    learned = encoded.filter("not held_out")
    model = train_model(learned, lex, first_model(lex))
    sent_model, pad = spark.sparkContext.broadcast(model), lex.n_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            likely = np.zeros(len(texts))
            for group in _groups(texts):
                likely[group] = forward(sent_model.value, padded([texts[i] for i in group], pad)) / math.log(10)
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            texts.clear()
            return rows.append_column("likely", pa.array(likely, pa.float64())).to_batches()[0]

        for batch in batches:
            texts += _decoded(batch.column(0))
            held.append(batch.select(range(1, batch.num_columns)))
            if sum(map(len, texts)) > GATHERED:
                yield flush()
        if texts:
            yield flush()

    plain = ("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "shares")
    scored = encoded.select("classes", *plain).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, shares double, likely double")
    scored = written(scored.withColumn("model", F.col("likely") + F.col("shares")).drop("likely", "shares"))
    asked = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    few = counts.filter(F.col("c") * SENT < max(1, lex.tokens - lex.docs)).select("h", "c")
    met = asked.join(few, "h", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = scored.join(met, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    whole = math.log10(lex.tokens + 0.5 * (lex.types + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("logs") + F.col("rare_log") - F.col("n_tokens") * whole).alias("base_score"), (F.col("model") + F.col("rare_log")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
