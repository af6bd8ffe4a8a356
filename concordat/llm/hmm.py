"""A hidden Markov language model trained by Baum-Welch over the whole corpus.

A state emits a *class*; the ``HEAD`` most frequent training words are classes of their own
and every other word belongs to a class of its ending, within which it has its smoothed
share of the class.  So the tables that every task needs are bounded, while the counts
of all words stay distributed: a word's count is joined by the word.  The likelihood of a
text is exact: the forward recursion over its classes, times its words' shares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import fold, keyed_text, slices, stored, words_of

STATES = 8
#: Most frequent training words that are classes of their own; the document's end is one.
HEAD = 4096
#: Classes of the other words, by a hash of their last three bytes.
ENDINGS = 512
#: Most frequent training words whose counts every task holds.
LOCAL_WORDS = 1 << 17
#: Full passes of Baum-Welch over the training documents.
ITERATIONS = 10
#: Steps on the sequences that first tables may be given; training gives none.
START_STEPS = 20
#: Tokens of a training sequence; longer documents are several.
SEQUENCE = 128
#: Tokens that a scoring step runs through; longer documents are joined by transfer matrices.
STRETCH = 512
#: Tokens counted for every class before training, shared out as in the corpus.
SMOOTHING = 50.0
#: The end of a document; no word is empty.
END = b""


def ending(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-3:]) % ENDINGS


def tokens_of(text: str) -> list[bytes]:
    return [*words_of(text), END]


# Counting


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, ending, n`` over all tokens of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in slices(batches, "text", 4 << 20):
            for text in batch.column(0):
                tally.update(tokens_of(text.as_py()))
            if len(tally) > 400_000:
                yield out(tally)
                tally = Counter()
        if tally:
            yield out(tally)

    def out(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array(tally.keys(), pa.binary()), "ending": pa.array([ending(w) for w in tally], pa.int32()),
                "n": pa.array(tally.values(), pa.int64()),
            }
        )

    counted = texts.select("text").mapInArrow(run, "word binary, ending int, n long")
    return counted.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the training words."""

    tokens: int
    words: int
    #: Count and class of the words that tasks hold.
    local: dict[bytes, tuple[int, int]]
    #: Per ending: log10 of the class's tokens and words and one unknown.
    size_log: np.ndarray
    #: Share of every class among the training tokens, each class counted once more.
    shares: np.ndarray


def vocabulary(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    # The least count that no more than LOCAL_WORDS words reach, in eighths of a doubling.
    step, least, above = F.floor(F.log2("n") * 8), None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        above += r["words"]
        if above > LOCAL_WORDS:
            break
        least = r["step"]
    is_end = F.col("word") == F.lit(bytearray(END))
    top = counts.filter(is_end | (step >= least) if least is not None else is_end).collect()
    top.sort(key=lambda r: (bytes(r["word"]) != END, -r["n"], bytes(r["word"])))
    local = {bytes(r["word"]): (r["n"], i if i < HEAD else r["ending"]) for i, r in enumerate(top)}
    local.setdefault(END, (0, 0))
    in_class = {r["ending"]: (r["n"], r["v"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    size, kinds, totals = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(HEAD + ENDINGS)
    for e, (n, v) in in_class.items():
        size[e - HEAD], kinds[e - HEAD] = n, v
    for i, r in enumerate(top[:HEAD]):
        totals[i] = r["n"]
        size[r["ending"] - HEAD] -= r["n"]
        kinds[r["ending"] - HEAD] -= 1
    totals[HEAD:] = size
    # A class can hold fewer words than HEAD; such classes are never emitted, nor given a share.
    used = np.ones(HEAD + ENDINGS, bool)
    used[max(1, len(top)) : HEAD] = False
    shares = np.where(used, totals + 1, 0)
    return Vocabulary(int(sums[0] or 0), int(sums[1]), local, np.log10(size + kinds + 1), shares / shares.sum())


def encoded(docs: DataFrame, trained_on: Column, words: Vocabulary) -> DataFrame:
    """One row per document: its classes, what is known of its words here, and its other words.

    ``known_log`` sums log10(count + 1) over the words held here, ``share_log`` what the
    shares within classes lack of the counts still to be joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        log_n = {w: float(np.log10(n + 1)) for w, (n, _) in known.local.items()}
        of_class = {w: c for w, (_, c) in known.local.items()}
        size_log = np.concatenate((np.zeros(HEAD), known.size_log))
        place = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for text in batch.column(2):
                tokens = tokens_of(text.as_py())
                classes = list(map(of_class.get, tokens))
                rest = [t for t, c in zip(tokens, classes) if c is None]
                if rest:
                    classes = [ending(t) if c is None else c for t, c in zip(tokens, classes)]
                logs = np.array([log_n.get(t, 0.0) for t in tokens])
                classes = np.array(classes, "<u2")
                tail = classes >= HEAD
                seen = sum(1 for t in tokens if t in of_class and known.local[t][0] > 0) if not known.tokens else len(tokens) - len(rest)
                rows.append((place, len(tokens), seen, float(logs.sum()), float(logs[tail].sum() - size_log[classes].sum()), classes.tobytes(), rest))
                place += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                ["doc_id", "training", "row", "n_tokens", "n_seen", "known_log", "share_log", "classes", "rest"],
            )

    texts = docs.select("doc_id", trained_on.alias("training"), "text")
    schema = (
        "doc_id long, training boolean, row long, n_tokens long, n_seen long, known_log double, share_log double, classes binary, rest array<binary>"
    )
    return texts.mapInArrow(run, schema)


# The model


@dataclass
class Tables:
    first: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # classes x states

    def flat(self) -> np.ndarray:
        return np.concatenate((self.first, self.moves.ravel(), self.emits.ravel()))


def from_counts(flat: np.ndarray, shares: np.ndarray) -> Tables:
    """Tables from expected counts; every class keeps a little of its share in each state."""
    first, moves, emits = flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(-1, STATES)
    first, moves, emits = first + 0.1, moves + 0.1, emits + SMOOTHING * shares[:, None]
    return Tables(first / first.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def expected_counts(sequences: list[np.ndarray], opens: np.ndarray, model: Tables) -> np.ndarray:
    """Baum-Welch counts over sequences of classes, side by side; ``opens`` marks those that
    open a document, the others start from the states' long-run shares."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    opens = opens[order]
    steps, b = int(lengths[0]), len(order)
    grid = np.zeros((steps, b), np.int64)
    for j, i in enumerate(order):
        grid[: lengths[j], j] = sequences[i]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
    long_run = np.linalg.matrix_power(model.moves, 64)[0]
    alpha = np.zeros((steps, b, STATES))
    now = np.where(opens[:, None], model.first, long_run) * model.emits[grid[0]]
    scale = np.ones((steps, b))
    for t in range(steps):
        n = active[t]
        if t:
            now = (alpha[t - 1, :n] @ model.moves) * model.emits[grid[t, :n]]
        scale[t, :n] = now[:n].sum(1)
        alpha[t, :n] = now[:n] / scale[t, :n, None]
    beta = np.ones((b, STATES))
    moves = np.zeros((STATES, STATES))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        gamma = alpha[t, :n] * beta[:n]
        if t:
            ahead = beta[:n] * model.emits[grid[t, :n]] / scale[t, :n, None]
            moves += alpha[t - 1, :n].T @ ahead
            beta[:n] = ahead @ model.moves.T
        alpha[t, :n] = gamma
    first = alpha[0][opens].sum(0)
    kept = np.arange(b) < np.array(active)[:, None]
    kept[0] &= opens  # the first token of the others has been counted as the last one before
    classes, gamma = grid[kept], alpha[kept]
    emits = np.stack([np.bincount(classes, gamma[:, k], len(model.emits)) for k in range(STATES)], 1)
    return np.concatenate((first, (moves * model.moves).ravel(), emits.ravel()))


def cut(classes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Training sequences of at most ``SEQUENCE`` tokens, and which of them open a document.

    The others begin with the token before them, so that the move across the cut is counted.
    """
    out, opens = [], []
    for own in classes:
        for at in range(0, len(own), SEQUENCE):
            out.append(own[max(at - 1, 0) : at + SEQUENCE])
            opens.append(at == 0)
    return out, np.array(opens, bool)


def start_tables(sample: list[np.ndarray], shares: np.ndarray, seed: int = 3) -> Tables:
    rng = np.random.default_rng(seed)
    emits = shares[:, None] * rng.uniform(0.2, 1.8, (len(shares), STATES))
    moves = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    model = Tables(np.full(STATES, 1 / STATES), moves, emits / emits.sum(0))
    if sample:
        sequences, opens = cut(sample)
        for _ in range(START_STEPS):
            model = from_counts(expected_counts(sequences, opens, model), shares)
    return model


def train(rows: DataFrame, shares: np.ndarray) -> Tables:
    """Baum-Welch from random tables: each pass sums expected counts over all partitions of the training rows."""
    training = rows.filter("training").select("classes")
    model = start_tables([], shares)
    context = rows.sparkSession.sparkContext
    for _ in range(ITERATIONS):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES**2 + len(shares) * STATES)
            for batch in slices(batches, "classes", 1 << 19):
                sequences, opens = cut([np.frombuffer(c.as_buffer(), "<u2").astype(np.int64) for c in batch.column(0)])
                for at in range(0, len(sequences), 2048):
                    total += expected_counts(sequences[at : at + 2048], opens[at : at + 2048], shared.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.float64())})

        sums = training.mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(STATES + STATES**2 + len(shares) * STATES)
        for r in sums:
            flat[r["place"]] = r["n"]
        model = from_counts(flat, shares)
    return model


def forward(sequences: list[np.ndarray], starts: np.ndarray, model: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion over several sequences at once.

    ``starts`` (sequences x rows x states) are weights of the state at the first token before
    it is emitted.  Returns those after the last token, scaled, and the log10 of the scale.
    """
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    grid = np.zeros((int(lengths[0]), len(order)), np.int64)
    for j, i in enumerate(order):
        grid[: lengths[j], j] = sequences[i]
    now, logs = starts[order].copy(), np.zeros(len(order))
    for t in range(len(grid)):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        live = now[:n] @ model.moves if t else now[:n]
        live = live * model.emits[grid[t, :n]][:, None, :]
        scale = live.sum((1, 2))
        now[:n] = live / scale[:, None, None]
        logs[:n] += np.log10(scale)
    back = np.argsort(order)
    return now[back], logs[back]


def log10_likelihoods(documents: list[np.ndarray], model: Tables) -> list[float]:
    """Exact log10 probability of each document's classes.

    A document of more than ``STRETCH`` tokens is cut; every later stretch is run from each state
    at once, which gives its transfer matrix, and the matrices are applied in order.
    """
    heads = [d[:STRETCH] for d in documents]
    state, logs = forward(heads, np.broadcast_to(model.first, (len(heads), 1, STATES)), model)
    later = [(i, d[at : at + STRETCH]) for i, d in enumerate(documents) for at in range(STRETCH, len(d), STRETCH)]
    total, vector = logs.tolist(), state[:, 0, :]
    for lo in range(0, len(later), 512):
        part = later[lo : lo + 512]
        matrices, scales = forward([s for _, s in part], np.broadcast_to(model.moves, (len(part), STATES, STATES)), model)
        for (i, _), matrix, scale in zip(part, matrices, scales):
            moved = vector[i] @ matrix
            size = moved.sum()
            vector[i] = moved / size
            total[i] += float(scale + np.log10(size))
    return total


def state_scores(rows: DataFrame, model: Tables) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "classes", 1 << 20):
            documents = [np.frombuffer(c.as_buffer(), "<u2").astype(np.int64) for c in batch.column(batch.schema.get_field_index("classes"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(log10_likelihoods(documents, shared.value), pa.float64())], [*batch.schema.names[:-1], "state_log"]
            )

    kept = rows.select("row", "doc_id", "training", "n_tokens", "n_seen", "known_log", "share_log", "classes")
    return kept.mapInArrow(run, "row long, doc_id long, training boolean, n_tokens long, n_seen long, known_log double, share_log double, state_log double")


def language_model_scores(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text: ``doc_id, training, n_tokens, n_known, train_tokens, base_score, score``.

    ``trained_on`` says, in terms of ``doc_id``, which rows to learn from; NULL is no.
    ``base_score`` is the log10 probability under add-one unigram counts, ``score`` that under
    the model.  An empty or NULL text has its end token alone; repeated ids are rows of their
    own; without training rows the counts are zero and the tables uniform.
    """
    texts = keyed_text(docs, id_col, text_col)
    trained_on = F.coalesce(trained_on, F.lit(False))
    counts = stored(word_counts(texts.filter(trained_on)), "lm-counts")
    words = vocabulary(counts)
    rows = stored(encoded(texts, trained_on, words), "lm-rows")
    model = train(rows, words.shares)
    # Words that tasks do not hold get their counts by a join; frequent words are not among them.
    rest = rows.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    joined = rest.join(counts.select("word", "n"), "word", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rest_log"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rest_known"),
    )
    scored = state_scores(rows, model).join(sums, "row", "left")
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    return scored.select(
        "doc_id", "training", "n_tokens", (F.col("n_seen") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + rest_log - F.col("n_tokens") * F.lit(float(np.log10(words.tokens + words.words + 1)))).alias("base_score"),
        (F.col("state_log") + F.col("share_log") + rest_log).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from; a row with a NULL id is not in it."""
    return F.coalesce(fold(id_col, 7) == 2, F.lit(False))
