"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import TEXT_BATCH_ROWS, only, rows_below, short_batches, written

# Latent states, and classes of words that they emit: the checksum of a word's last bytes, bare of punctuation. A class's
# words are told apart by their counts, so that every word of any corpus has a probability of its own.
STATES, CLASSES, TAIL = 8, 1 << 14, 4
PUNCTUATION = b".,;:!?()[]\"'-"
END = b""
# Passes of Baum-Welch over all training texts, after some over a sample of so many tokens that parts the states.
PASSES, SAMPLE_PASSES, SAMPLE_TOKENS, SAMPLE_BLOCKS, SEED = 3, 12, 1 << 18, 8, 5
# Tokens by which a state's emissions are drawn to those of the corpus, and transitions to even ones.
EMISSION_PRIOR, MOVE_PRIOR = 50.0, 1e-3
ADDED = 0.1
# Tokens of a block of documents (one row; a longer text is a block of its own), of a window, and windows handled at once.
BLOCK_TOKENS, WINDOW, SLAB = 1 << 20, 64, 4096
# Values of one row of the counts of a task.
SLICE = 4096
# Blocks, and words of a block, that Python gets at once.
BLOCKS_AT_ONCE, WORDS_AT_ONCE = 2, 1 << 16

BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words array<long>, classes array<int>, counts array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Model:
    """Row k of ``moves`` and ``emits``: from state k to the others, and the classes it emits; a text starts from ``start`` by a move.

    ``mass`` is the smoothed count of each class, ``tokens`` and ``types`` count the training tokens.
    """

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    mass: np.ndarray
    tokens: int
    types: int


def packed(tokens: np.ndarray) -> bytes:
    """Tokens as their low halves, then their high ones, which are nearly all zero and vanish in compression."""
    return b"".join(np.ascontiguousarray(half).tobytes() for half in tokens.astype("<i4").view("<u2").reshape(-1, 2).T)


def unpacked(data: pa.BinaryScalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), "<u2").reshape(2, -1).T).view("<i4")[:, 0]


def word_class(word: bytes) -> int:
    return 0 if word == END else 1 + zlib.crc32(word.strip(PUNCTUATION)[-TAIL:]) % (CLASSES - 1)


def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: whole documents (``doc_id, held, text``) gathered into ``BLOCK`` rows with a vocabulary of their own."""
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    block = TaskContext.get().partitionId() << 32
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    ids: list[int | None] = []
    held: list[bool] = []
    texts: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        size = len(vocabulary)
        learned = [t for t, h in zip(texts, held, strict=True) if not h]
        counts = np.bincount(np.concatenate([np.zeros(0, "i4"), *learned]), minlength=size)
        words = np.fromiter(map(xxh64_intdigest, vocabulary), np.uint64, size).view("i8")
        classes = np.fromiter(map(word_class, vocabulary), "i4", size)
        values = [block, ids, held, [len(t) for t in texts], packed(np.concatenate(texts)), words, classes, counts]
        columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in BLOCK.split(", ")])

    total = 0
    for batch in rows_below(batches, TEXT_BATCH_ROWS):
        for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True):
            words = text.encode().lower().split() if text else []
            words.append(END)
            texts.append(np.fromiter(map(vocabulary.__getitem__, words), "i4", len(words)))
            ids.append(doc_id)
            held.append(out)
            total += len(words)
            if total >= BLOCK_TOKENS:
                yield row()
                block, total, ids, held, texts = block + 1, 0, [], [], []
                vocabulary.clear()
    if texts:
        yield row()


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the first window of each, and every window's first place and size."""
    per_text = -(-lengths // WINDOW)
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(lengths)), per_text)
    inside = (np.arange(len(text)) - first[text]) * WINDOW
    return first, (np.cumsum(lengths) - lengths)[text] + inside, np.minimum(WINDOW, lengths[text] - inside)


def slabs(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Windows in slabs, longer ones first, and how many of them have a token at each place."""
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), SLAB):
        own = order[at : at + SLAB]
        yield own, [int(np.searchsorted(-size[own], -place)) for place in range(int(size[own[0]]))]


def products(model: Model, classes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's product of (moves x emissions), scaled, and the logarithm of its scale."""
    states = len(model.start)
    found = np.empty((len(begin), states, states))
    scale = np.zeros(len(begin))
    emits = np.ascontiguousarray(model.emits.T)
    for own, alive in slabs(begin, size):
        m = np.repeat(np.eye(states)[None], len(own), axis=0)
        for place, n in enumerate(alive):
            m[:n] = (m[:n].reshape(-1, states) @ model.moves).reshape(n, states, states) * emits[classes[begin[own[:n]] + place]][:, None, :]
            if place % 8 == 7 or place == len(alive) - 1:
                z = m[:n].max(axis=(1, 2))
                m[:n] /= z[:, None, None]
                scale[own[:n]] += np.log10(z)
        found[own] = m
    return found, scale


def forward(model: Model, lengths: np.ndarray, first: np.ndarray, m: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 likelihood of each text, and the states before each window."""
    per_text = -(-lengths // WINDOW)
    order = np.argsort(-per_text, kind="stable")
    before = np.empty((len(m), len(model.start)))
    now = np.repeat(model.start[None], len(lengths), axis=0)
    score = np.zeros(len(lengths))
    for k in range(int(per_text.max(initial=0))):
        own = order[: int(np.searchsorted(-per_text[order], -k))]
        at = first[own] + k
        before[at] = now[own]
        after = (now[own][:, None, :] @ m[at])[:, 0]
        z = after.sum(axis=1)
        now[own] = after / z[:, None]
        score[own] += np.log10(z) + scale[at]
    return score, before


def backward(model: Model, lengths: np.ndarray, first: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What follows each window and each text's start, for each state, up to a scale."""
    per_text = -(-lengths // WINDOW)
    order = np.argsort(-per_text, kind="stable")
    after = np.empty((len(m), len(model.start)))
    now = np.ones((len(lengths), len(model.start)))
    for k in range(int(per_text.max(initial=0)) - 1, -1, -1):
        own = order[: int(np.searchsorted(-per_text[order], -k))]
        at = first[own] + k
        after[at] = now[own]
        rest = (m[at] @ now[own][:, :, None])[:, :, 0]
        now[own] = rest / rest.sum(axis=1)[:, None]
    return after, now


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of whole texts laid end to end: states they start from, moves, and emissions (states x classes)."""
    states = len(model.start)
    moves, emitted = np.zeros((states, states)), np.zeros((states, model.emits.shape[1]))
    first, begin, size = windows_of(lengths)
    m, scale = products(model, classes, begin, size)
    _, before = forward(model, lengths, first, m, scale)
    after, rest = backward(model, lengths, first, m)
    start = model.start * rest
    start = (start / start.sum(axis=1)[:, None]).sum(axis=0)
    emits = np.ascontiguousarray(model.emits.T)
    for own, alive in slabs(begin, size):
        ahead = np.empty((len(alive) + 1, len(own), states))
        ahead[0] = before[own]
        for place, n in enumerate(alive):
            step = (ahead[place, :n] @ model.moves) * emits[classes[begin[own[:n]] + place]]
            ahead[place + 1, :n] = step / step.sum(axis=1)[:, None]
        behind = after[own]
        for place in range(len(alive) - 1, -1, -1):
            n = alive[place]
            seen = classes[begin[own[:n]] + place]
            weight = emits[seen] * behind[:n]
            come = ahead[place, :n] @ model.moves
            weight /= (come * weight).sum(axis=1)[:, None]
            moves += ahead[place, :n].T @ weight
            come *= weight
            for k in range(states):
                emitted[k] += np.bincount(seen, come[:, k], minlength=emitted.shape[1])
            behind[:n] = weight @ model.moves.T
            behind[:n] /= behind[:n].sum(axis=1)[:, None]
    return start, moves * model.moves, emitted


def improved(model: Model, start: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Model:
    """The model that expected counts ask for."""
    start, moves = start + MOVE_PRIOR, moves + MOVE_PRIOR
    emits = (emitted + EMISSION_PRIOR * (model.mass / model.mass.sum())) / (emitted.sum(axis=1) + EMISSION_PRIOR)[:, None]
    return Model(start / start.sum(), moves / moves.sum(axis=1)[:, None], emits, model.mass, model.tokens, model.types)


def training_part(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, lengths) of the training documents of each block."""
    for row in zip(*(batch.column(c) for c in ("tokens", "classes", "lengths", "held")), strict=True):
        tokens, classes, lengths, held = unpacked(row[0]), *(x.values.to_numpy(zero_copy_only=False) for x in row[1:])
        yield classes[tokens[np.repeat(~held, lengths)]], lengths[~held]


def in_batches(df: DataFrame):
    """``df`` as an Arrow table, its blocks read a few at a time."""
    with short_batches(df.sparkSession, BLOCKS_AT_ONCE):
        return df.toArrow()


def sampled(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes and lengths of a bounded sample of training texts, cut to windows: evenly spaced ones of a few blocks."""
    most = SAMPLE_TOKENS // SAMPLE_BLOCKS // WINDOW

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_below(batches, 1):
            for classes, lengths in training_part(batch):
                _, begin, size = windows_of(lengths)
                some = np.unique(np.linspace(0, len(begin) - 1, most).astype("i8")) if len(begin) else np.zeros(0, "i8")
                own = np.concatenate([classes[:0], *(classes[begin[k] : begin[k] + size[k]] for k in some)])
                columns = [batch.column("block"), pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([size[some].tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "classes", "lengths"])

    found = blocks.select("block", "tokens", "classes", "lengths", "held").mapInArrow(pick, "block long, classes array<int>, lengths array<long>")
    rows = in_batches(found.orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS))
    return tuple(np.concatenate([np.zeros(0, "i8"), *(x.values.to_numpy() for x in rows.column(c))]) for c in ("classes", "lengths"))


def summed_counts(blocks: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over the training documents of all blocks. A task adds up what it reads; slices of the counts of all tasks
    are added apart, so what meets in a task is as long as a slice for each task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    states, classes = model.emits.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states + states * states + states * classes)
        for batch in rows_below(batches, 1):
            for seen, lengths in training_part(batch):
                if len(lengths):
                    total += np.concatenate([x.ravel() for x in expected_counts(model, seen, lengths)])
        cuts = range(0, len(total), SLICE)
        padded = np.pad(total, (0, -len(total) % SLICE)).reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array(list(padded), pa.list_(pa.float64()))], ["slice", "counts"])

    found = blocks.select("tokens", "classes", "lengths", "held").mapInArrow(count, "slice int, counts array<double>")
    added = found.groupBy("slice").agg(Summarizer.sum(array_to_vector("counts")).alias("counts")).select("slice", vector_to_array("counts").alias("counts"))
    rows = in_batches(added)
    total = np.zeros((-(-(states + states * states + states * classes) // SLICE), SLICE))
    for at, counts in zip(rows.column("slice").to_pylist(), rows.column("counts"), strict=True):
        total[at] = counts.values.to_numpy()
    total = total.ravel()
    return total[:states], total[states : states + states * states].reshape(states, states), total[states + states * states :][: states * classes].reshape(states, classes)


def fit(blocks: DataFrame, vocabulary: DataFrame) -> Model:
    """Train on the blocks' training documents; ``vocabulary`` holds ``word, class, times`` of all words.

    States are parted on a bounded sample; then every pass reads all training texts. Only counts by class reach the driver, a
    fixed number of values.
    """
    rows = vocabulary.filter("times > 0").groupBy("class").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("types")).toArrow()
    times, types = np.zeros(CLASSES), np.zeros(CLASSES)
    at = rows.column("class").to_numpy()
    times[at], types[at] = rows.column("times").to_numpy(), rows.column("types").to_numpy()
    mass = times + ADDED * (types + 1)
    draw = np.random.default_rng(SEED)
    emits = mass * (0.5 + draw.random((STATES, CLASSES)))
    moves = 0.8 * np.eye(STATES) + 0.2 / STATES
    model = Model(np.full(STATES, 1 / STATES), moves, emits / emits.sum(axis=1)[:, None], mass, int(times.sum()), int(types.sum()))
    classes, lengths = sampled(blocks)
    for _ in range(SAMPLE_PASSES if len(lengths) else 0):
        model = improved(model, *expected_counts(model, classes, lengths))
    for _ in range(PASSES):
        model = improved(model, *summed_counts(blocks, model))
    return model


def likelihoods(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of every text's classes, exactly, by the scaled forward recursion."""
    first, begin, size = windows_of(lengths)
    return forward(model, lengths, first, *products(model, classes, begin, size))[0]


def score_blocks(blocks: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """``SCORES`` of every document. ``known`` holds ``home, at, times``: how often each word of block ``home`` occurs in training."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(right.column("at").to_numpy())
        times = right.column("times").to_numpy()[at]
        row = {c: left.column(c)[0] for c in ("doc_ids", "held", "lengths", "tokens", "classes")}
        classes, lengths = (row[c].values.to_numpy() for c in ("classes", "lengths"))
        tokens = unpacked(row["tokens"])
        begin = np.cumsum(lengths) - lengths
        weight = np.log10(times + ADDED)
        base = np.add.reduceat(weight[tokens], begin) - lengths * np.log10(model.tokens + ADDED * (model.types + 1))
        inside = np.add.reduceat((weight - np.log10(model.mass)[classes])[tokens], begin)
        seen = np.add.reduceat((times > 0)[tokens].astype("i8"), begin)
        found = inside + likelihoods(model, classes[tokens], lengths)
        columns = [row["doc_ids"].values, row["held"].values, *(pa.array(x) for x in (lengths, seen, base, found))]
        return pa.table(dict(zip([f.split(" ")[0] for f in SCORES.split(", ")], columns, strict=True)))

    own = blocks.select("block", "doc_ids", "held", "lengths", "tokens", "classes")
    return own.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(score, SCORES)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: the checksum of its id leaves 0 on division by 10. One without an id is not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words between ASCII white space, ``A-Z`` lower-cased, and an end, counted as one; learned from are the documents that
    are not held out. ``base_score`` is that of single words with 0.1 added to every count. ``score`` is that of a hidden
    Markov model whose states emit classes of words (``word_class``); a class gives each of its words a share by its count,
    0.1 added, and one share to whatever is unknown, so that a state's words and unknown ones add up to 1.

    Documents are gathered into blocks with a vocabulary of their own, once; a table of (block, word) pairs is counted and
    joined by word, so the corpus's vocabulary is never sent, held or cut, and returns to the blocks as counts. Baum-Welch
    reads the blocks in place: a text's windows are multiplied into matrices, through which the exact forward and backward
    recursions run, whatever the text's length; tasks' counts of classes, a fixed number, are added up. Everything that later
    steps read again is written. Words are told apart by 64-bit checksums.

    A null or empty text is its end alone; a null ``doc_id`` is not held out; repeated rows are documents of their own; where
    nothing is learned every token scores 0 in the base; an empty table gives an empty result; other columns are not carried along.
    """
    rows = only(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").withColumn("held", held_out("doc_id"))
    blocks = written(rows.select("doc_id", "held", "text").mapInArrow(encode_blocks, BLOCK), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "classes", "counts")).alias("at", "of"))
    pairs = pairs.select("block", "at", F.col("of.words").alias("word"), F.col("of.classes").alias("class"), F.col("of.counts").alias("times"))
    vocabulary = written(pairs.groupBy("word").agg(F.first("class").alias("class"), F.sum("times").alias("times")), "vocabulary")
    model = fit(blocks, vocabulary)
    known = pairs.select("block", "at", "word").join(vocabulary.select("word", "times"), "word").select(F.col("block").alias("home"), "at", "times")
    scored = written(score_blocks(blocks, known, model), "scores", WORDS_AT_ONCE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
