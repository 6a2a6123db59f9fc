"""A hidden Markov language model.

A state emits a word by the word's class (a hash of its last bytes, CLASSES of them), and within its class by its
smoothed count; the text's end is a class of its own. Transitions and class emissions are trained by Baum-Welch on all
training text, whole: the counts of neighbouring classes, folded into COARSE, give the states their start (Baum-Welch
over all pairs of neighbours, by their counts); then rounds over the texts add up expected counts across partitions
until the likelihood of a token gains less than GAIN, ROUNDS at most. Scores are exact: the scaled forward recursion
runs over whole texts.

The counts of up to TABLE words, those above the least count that allows it, are broadcast; texts' other words go to
the full counts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, cut, fold, mix, row_key, slices, span_hashes, utf8, words

STATES, CLASSES, SEGMENT = 8, 4096, 128
#: Starts and rounds over the counts of pairs, rounds over the texts at most, and the gain (log10 of a token's likelihood) below
#: which the latter end.
COARSE, STARTS, PAIR_ROUNDS, ROUNDS, GAIN = 1024, 4, 40, 5, 5e-4
#: The bound of what each worker holds: words in the broadcast table.
TABLE = 1 << 20
SMOOTH = 0.1
#: The hash that stands for the end of a text.
END = 0x454E44


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and class of each token of the texts, and where each text's tokens begin (one more: the end)."""
    data, bounds = utf8(texts)
    data = fold(data)
    starts, ends, first = words(data, bounds)
    own = span_hashes(data, starts, ends)
    code = np.minimum(ends - starts, 4).astype(np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        code = code * np.uint64(257) + np.where(at >= starts, data[np.maximum(at, 0)] if len(data) else 0, 256).astype(np.uint64)
    kind = (mix(code * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(CLASSES)).astype(np.int32)
    counts = np.diff(first)
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    hashes, classes = np.full(offsets[-1], END, np.uint64), np.full(offsets[-1], CLASSES, np.int32)
    at = np.arange(len(own)) + np.repeat(np.arange(len(counts)), counts)  # each earlier text has one end
    hashes[at], classes[at] = own, kind
    return hashes.view(np.int64), classes, offsets


@dataclass
class Hmm:
    """start (states), moves (states x states), emits (classes + 1 x states)."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @staticmethod
    def of_counts(start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Hmm:
        start, moves, emits = start + 1e-3, moves + 1e-3, emits + 1e-3
        return Hmm(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0, keepdims=True))


def expected_counts(model: Hmm, classes: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The expected counts of starts, moves and emissions, and log10 of the likelihood, texts taken in segments of at
    most `segment` tokens; the parts of a text after its first segment start from all states alike, so they add nothing
    to the starts."""
    states = len(model.start)
    counts = np.diff(offsets)
    parts = -(-counts // segment)
    of = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][of] + nth * segment
    length = np.minimum(counts[of] - nth * segment, segment)
    order = np.argsort(-length, kind="stable")
    begin, length, lead = begin[order], length[order], nth[order] == 0
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # how many segments are longer than t
    start_sum, move_sum, emit_sum = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
    if not longest:
        return start_sum, move_sum, emit_sum, 0.0
    emits, moves = model.emits.astype(np.float32), model.moves.astype(np.float32)
    alphas, shown, log = [], [], 0.0
    alpha = np.where(lead[:, None], model.start[None], model.start.mean() * np.ones((1, states))).astype(np.float32)
    for t in range(longest):
        m = active[t]
        e = emits[classes[begin[:m] + t]]
        alpha = (alpha[:m] if t == 0 else alpha[:m] @ moves) * e
        scale = alpha.sum(1, keepdims=True)
        log += float(np.log10(scale).sum(dtype=np.float64))
        alpha /= scale
        alphas.append(alpha)
        shown.append(e)
    beta = np.ones((0, states), np.float32)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        full = np.ones((m, states), np.float32)
        if t + 1 < longest:
            n = active[t + 1]
            ahead = shown[t + 1] * beta
            full[:n] = ahead @ moves.T
            full[:n] /= full[:n].sum(1, keepdims=True)
            pair = alphas[t][:n]
            scale = np.einsum("ns,ns->n", pair @ moves, ahead)[:, None]
            move_sum += moves * (pair.T @ (ahead / scale))
        beta = full
        gamma = alphas[t] * beta
        gamma /= gamma.sum(1, keepdims=True)
        if t == 0:
            start_sum += gamma[lead].sum(0)
        alphas[t] = gamma
    at = np.concatenate([classes[begin[: active[t]] + t] for t in range(longest)])
    gamma = np.concatenate(alphas)
    for s in range(states):
        emit_sum[:, s] = np.bincount(at, gamma[:, s], CLASSES + 1)
    return start_sum, move_sum, emit_sum, log


def log10_likelihoods(model: Hmm, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 of the likelihood of each text's classes, by the scaled forward recursion. model.emits may hold any
    weights; so it can carry a factor of each class."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    begin, length = offsets[:-1][order], counts[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")
    out = np.zeros(len(counts))
    alpha = np.repeat(model.start[None], len(counts), 0)
    for t in range(longest):
        m = active[t]
        alpha = (alpha if t == 0 else alpha[:m] @ model.moves) * model.emits[classes[begin[:m] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:m] += np.log10(scale)
    result = np.empty(len(counts))
    result[order] = out
    return result


def held_out(id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, mod 10, is 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """w (hash), k (class), c (count) of the tokens of train (text), ends included. Each task counts about 8 MB of
    text at a time before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 23):
            parts = [tokens(x["text"])[:2] for x in slices(iter([batch]), "text")]
            hashes, kinds = (np.concatenate(p) for p in zip(*parts, strict=True))
            names, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(names), pa.array(kinds[first]), pa.array(n)], ["w", "k", "c"])

    return arrow_map(train.select("text"), run, "w long, k int, c long").groupBy("w").agg(F.min("k").alias("k"), F.sum("c").alias("c"))


def coded(train: DataFrame) -> DataFrame:
    """The classes of each text of train, as 16-bit numbers in a binary, written for the rounds to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, classes, offsets = tokens(batch["text"])
            data = classes.astype(np.int16).tobytes()
            yield pa.record_batch([pa.array([data[2 * a : 2 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], ["codes"])

    return cut(arrow_map(train.select("text"), run, "codes binary"))


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = batch["codes"].to_pylist()
    return np.frombuffer(b"".join(rows), np.int16).astype(np.int32), np.cumsum([0, *(len(r) // 2 for r in rows)])


def pair_counts(codes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, n: how often coarse class j follows i within texts. At most (COARSE + 1) ** 2 rows, of each task and to
    the driver (16 MB)."""
    wide = COARSE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, np.int64)
        for batch in slices(batches, "codes"):
            classes, _ = _codes(batch)
            coarse = np.where(classes == CLASSES, COARSE, classes % COARSE)
            total += np.bincount((coarse[:-1] * wide + coarse[1:])[coarse[:-1] != COARSE], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "n"])

    rows = arrow_map(codes, run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = rows["k"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(k)
    return *divmod(k[order], wide), n[order].astype(np.float64)


def pair_model(i: np.ndarray, j: np.ndarray, n: np.ndarray, states: int, seed: int, rounds: int = PAIR_ROUNDS, block: int = 1 << 16) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Baum-Welch over pairs of neighbouring coarse classes (i, j), n of each, from a start drawn by seed: log10 of the
    likelihood before the last round, and share of the states, moves, emissions."""
    wide, rng = COARSE + 1, np.random.default_rng(seed)
    seen = (np.bincount(i, n, wide) + np.bincount(j, n, wide))[:, None] + 0.05
    share, moves, emits, log = np.ones(states) / states, np.eye(states) * 30 + 1, seen * rng.gamma(3.0, 1.0, (wide, states)), 0.0
    for _ in range(rounds):
        moves, emits = moves / moves.sum(1, keepdims=True), emits / emits.sum(0, keepdims=True)
        first, move_sum, emit_sum, log = np.zeros(states), np.full((states, states), 0.1), 0.02 * seen / seen.sum() * np.ones(states), 0.0
        for a in range(0, len(n), block):
            left, right, own = share * emits[i[a : a + block]], emits[j[a : a + block]], n[a : a + block]
            ahead = right @ moves.T
            total = (left * ahead).sum(1)
            log += float(own @ np.log10(total))
            weight = (own / total)[:, None]
            before, after = left * ahead * weight, (left @ moves) * right * weight
            move_sum += moves * ((left * weight).T @ right)
            first += before.sum(0)
            for s in range(states):
                emit_sum[:, s] += np.bincount(i[a : a + block], before[:, s], wide) + np.bincount(j[a : a + block], after[:, s], wide)
        share, moves, emits = (first + 1e-3) / (first + 1e-3).sum(), move_sum, emit_sum
    return log, (share, moves / moves.sum(1, keepdims=True), emits / emits.sum(0, keepdims=True))


def train_hmm(train: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """The model after Baum-Welch over all of train (text), and log10 of the likelihood of all of its classes, under the
    model that each round began with. mass: the weight of each class in train."""
    codes = coded(train)
    pairs = pair_counts(codes)
    share, moves, coarse = max((pair_model(*pairs, states, seed) for seed in range(STARTS)), key=lambda x: x[0])[1]
    of = np.append(np.arange(CLASSES) % COARSE, COARSE)
    within = (mass + 1e-3) / np.bincount(of, mass + 1e-3)[of]
    model, seen = Hmm.of_counts(share, moves, coarse[of] * within[:, None] * max(mass.sum(), 1.0)), []
    for _ in range(rounds):
        model, log = _round(codes, model)
        seen.append(log)
        if len(seen) > 1 and seen[-1] - seen[-2] < GAIN * mass.sum():
            break
    return model, seen


def _round(codes: DataFrame, model: Hmm) -> tuple[Hmm, float]:
    """One round of Baum-Welch over all texts: each task adds up its own expected counts, Spark those of the tasks.
    Also log10 of the likelihood under the given model."""
    shape = (len(model.start), CLASSES + 1)
    shared = codes.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Hmm(*shared.value), None
        for batch in slices(batches, "codes"):
            got = np.concatenate([np.ravel(x) for x in expected_counts(own, *_codes(batch))])
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(np.abs(total) > 1e-9)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

    # At most states * (classes + states + 2) sums come to the driver.
    rows = arrow_map(codes, run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(shape[0] + shape[0] ** 2 + shape[0] * shape[1] + 1)
    flat[rows["i"].to_numpy()] = rows["n"].to_numpy()
    start, moves, emits, log = np.split(flat, np.cumsum([shape[0], shape[0] ** 2, shape[0] * shape[1]]))
    shared.unpersist()
    return Hmm.of_counts(start, moves.reshape(shape[0], shape[0]), emits.reshape(shape[1], shape[0])), float(log[0])


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have a greater one."""
    steps = counts.groupBy(F.when(F.col("c") < 64, F.col("c").cast("double")).otherwise(F.floor(F.log2("c") * 16) + 1000).alias("s")).agg(F.count("*").alias("n"), F.max("c").alias("c"))
    room = most
    for row in sorted(steps.collect(), key=lambda r: -r["c"]):
        room -= row["n"]
        if room < 0:
            return row["c"]
    return 0


@dataclass
class Trained:
    """What training gives: the words' counts (w, k, c), all tokens, distinct ones, the weight of each class, the model,
    and log10 of the likelihood of the training text's classes before each round over the texts."""

    counts: DataFrame
    total: int
    distinct: int
    mass: np.ndarray
    model: Hmm
    seen: list[float]


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> Trained:
    """Counts and model of the rows of docs that aren't held out."""
    own = docs.filter(~held_out(id)).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = cut(word_counts(own))
    mass = np.zeros(CLASSES + 1)
    total = distinct = 0
    for k, c, n in counts.groupBy("k").agg(F.sum("c"), F.count("*")).collect():
        mass[k] = c + SMOOTH * n
        total, distinct = total + c, distinct + n
    return Trained(counts, total, distinct, mass, *train_hmm(own, mass, states, rounds))


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, table: int = TABLE, trained: Trained | None = None) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows that aren't held out train the model, unless one is given. Tokens are the words with A-Z lower-cased, then one
    end. base_score is the log10 probability by smoothed word counts, score that of the hidden Markov model. A null
    text counts as empty: its one token is the end. A row with a null id trains, and is scored. Rows equal in id and
    text are counted each, and get equal scores. Other columns are ignored, whatever their names. If nothing trains,
    all counts are 0 and the model is that of no counts; an empty table gives no rows.
    """
    trained = trained or train(docs, id, text, states, rounds)
    counts, total, distinct, mass, model = trained.counts, trained.total, trained.distinct, trained.mass, trained.model
    source = docs.select(F.col(id).alias("id"), row_key(text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(id).alias("held_out"))
    least = _least_count(counts, table)
    top = counts.filter(F.col("c") > least).select("w", "c").toArrow()
    order = np.argsort(top["w"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((top["w"].to_numpy()[order], top["c"].to_numpy()[order], model.start, model.moves, model.emits / (mass + SMOOTH)[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, *weights = shared.value
        own = Hmm(*weights)
        logs = np.log10(values + SMOOTH)
        for batch in slices(batches, "text", 1 << 23):
            parts = [tokens(x["text"]) for x in slices(iter([batch]), "text")]
            hashes, classes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            counts_ = np.concatenate([np.diff(p[2]) for p in parts])
            offsets = np.concatenate([[0], np.cumsum(counts_)])
            if len(names):
                at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                known = names[at] == hashes
                value = np.where(known, logs[at], 0.0)
            else:
                known, value = np.zeros(len(hashes), bool), np.zeros(len(hashes))
            sums = np.add.reduceat(value, offsets[:-1])
            n_known = np.add.reduceat(known.astype(np.int64), offsets[:-1])
            bounds = np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[~known]))
            columns = [batch["id"], batch["row"], batch["held_out"], pa.array(counts_), pa.array(n_known), pa.array(sums), pa.array(log10_likelihoods(own, classes, offsets)), rare]
            yield pa.record_batch(columns, ["id", "row", "held_out", "n_tokens", "known", "sum", "hidden", "rare"])

    kind = source.schema["id"].dataType.simpleString()
    scored = cut(arrow_map(source, run, f"id {kind}, row long, held_out boolean, n_tokens long, known long, sum double, hidden double, rare array<long>"))
    pairs = scored.filter(F.size("rare") > 0).dropDuplicates(["id", "row"]).select("id", "row", F.explode("rare").alias("w")).groupBy("id", "row", "w").agg(F.count("*").alias("n"))
    looked = pairs.join(counts.filter(F.col("c") <= least).select("w", "c"), "w", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    rare = looked.groupBy("id", "row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * log).alias("rare_sum"))
    rare = rare.select(F.col("id").alias("_i"), F.col("row").alias("_r"), "rare_known", "rare_sum")
    joined = scored.drop("rare").join(rare, F.col("id").eqNullSafe(F.col("_i")) & (F.col("row") == F.col("_r")), "left")
    logs = F.col("sum") + F.coalesce("rare_sum", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(total + SMOOTH * (distinct + 1)))).alias("base_score"),
        (logs + F.col("hidden")).alias("score"),
    )


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
