"""Language of whole texts: a convolutional network over bytes, trained in NumPy on labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import TEXT_BATCH_ROWS, only, rows_below

# Bytes per window, embedding, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 12
# Training: the model is fitted on a bounded sample, the documents of each language with the smallest hashes of their id,
# and at most so many windows of each.
SAMPLE_PER_LANG, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED = 300, 4, 6, 64, 0.004, 7
UNKNOWN = "und"
# Windows that are convolved at once.
BLOCK = 64

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # (256, EMBED); row 0 is padding and stays zero
    kernel: np.ndarray  # (widest * EMBED, filters); rows beyond a filter's width stay zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(n, bytes) to (n, bytes, widest * EMBED): the embedded bytes that a filter sees from each place."""
        wide = max(WIDTHS)
        padded = np.zeros((len(windows), windows.shape[1] + wide - 1), np.uint8)
        padded[:, : windows.shape[1]] = windows
        x = self.embed[padded]
        return np.concatenate([x[:, k : k + windows.shape[1]] for k in range(wide)], axis=2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        found = []
        for at in range(0, len(windows), BLOCK):
            x = self.patches(windows[at : at + BLOCK])
            n, places, wide = x.shape
            peaks = (x.reshape(-1, wide) @ self.kernel).reshape(n, places, -1).max(axis=1) + self.bias
            found.append(softmax(np.maximum(peaks, 0) @ self.out + self.out_bias))
        return np.concatenate(found) if found else np.zeros((0, len(self.langs)), "f4")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in consecutive windows of fixed length, the last padded with zeros; ASCII letters in lower case."""
    data = np.frombuffer(text.lower(), np.uint8)
    windows = np.zeros((-(-len(data) // size), size), np.uint8)
    windows.reshape(-1)[: len(data)] = data
    return windows


def train(windows: np.ndarray, langs: list[str], target: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit the network by Adam on cross entropy; ``target`` indexes ``langs``."""
    rng = np.random.default_rng(seed)
    wide, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    shape = np.zeros((wide, EMBED, filters), "f4")
    for k, width in enumerate(WIDTHS):
        shape[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    live = shape.reshape(wide * EMBED, filters)
    embed = rng.normal(0, 0.5, (256, EMBED)).astype("f4")
    embed[0] = 0
    net = Network(
        langs, embed, (rng.normal(0, 0.3, live.shape) * live).astype("f4"), np.zeros(filters, "f4"),
        rng.normal(0, 0.2, (filters, len(langs))).astype("f4"), np.zeros(len(langs), "f4"),
    )
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            grads = gradients(net, windows[pick], target[pick])
            grads["kernel"] *= live
            grads["embed"][0] = 0
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype("f4"))
    return net


def gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy. Max pooling passes a filter's gradient to the one place it fired from."""
    x = net.patches(windows)
    n, places, wide = x.shape
    maps = (x.reshape(-1, wide) @ net.kernel).reshape(n, places, -1)
    peak = maps.argmax(axis=1)  # (n, filters)
    pooled = np.take_along_axis(maps, peak[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(pooled, 0)
    wrong = softmax(hidden @ net.out + net.out_bias)
    wrong[np.arange(n), target] -= 1
    wrong /= n
    back = (wrong @ net.out.T) * (pooled > 0)
    seen = x[np.arange(n)[:, None], peak]  # (n, filters, wide * EMBED)
    padded = np.zeros((n, windows.shape[1] + max(WIDTHS) - 1), np.uint8)
    padded[:, : windows.shape[1]] = windows
    bytes_seen = padded[np.arange(n)[:, None, None], peak[:, :, None] + np.arange(max(WIDTHS))]
    to_embed = np.zeros_like(net.embed)
    np.add.at(to_embed, bytes_seen, (back[:, :, None] * net.kernel.T).reshape(n, -1, max(WIDTHS), EMBED))
    return {
        "embed": to_embed, "kernel": np.einsum("nf,nfw->wf", back, seen), "bias": back.sum(axis=0),
        "out": hidden.T @ wrong, "out_bias": wrong.sum(axis=0),
    }


def fit(
    docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_lang: int = SAMPLE_PER_LANG, per_doc: int = SAMPLE_WINDOWS,
) -> Network | None:
    """Train on a bounded sample of the labelled documents for which ``learn_from`` holds; None if there is none.

    At most ``per_lang`` documents of a language (those with the smallest hashes of their id) and ``per_doc`` windows of each,
    spread over its whole text, reach the driver.
    """
    labelled = docs if learn_from is None else docs.filter(learn_from)
    rows = only(labelled, doc_id=f"{id_col}:long", text=f"{text_col}:string", lang=f"{lang_col}:string").filter("lang IS NOT NULL AND text IS NOT NULL")
    draw = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(SEED)).alias("draw"))
    chosen = ids.withColumn("no", F.row_number().over(draw)).filter(F.col("no") <= per_lang)
    bounds = chosen.groupBy("lang").agg(F.max("draw").alias("bound")).collect()  # one row per language
    if not bounds:
        return None
    bound = F.create_map(*(F.lit(v) for r in bounds for v in (r["lang"], r["bound"])))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            out: list[tuple] = []
            for lang, draw, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "draw", "doc_id", "text")), strict=True):
                cut = cut_windows(text.encode())
                for k in np.unique(np.linspace(0, len(cut) - 1, per_doc).astype(int)) if len(cut) else ():
                    out.append((lang, draw, doc_id, int(k), cut[k].tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "draw", "doc_id", "no", "bytes"])

    drawn = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(SEED))).filter(F.col("draw") <= F.element_at(bound, F.col("lang")))
    texts = drawn.dropDuplicates(["lang", "doc_id"]).select("lang", "draw", "doc_id", "text")
    sample = texts.mapInArrow(windows, "lang string, draw long, doc_id long, no long, bytes binary").toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["lang", "draw", "doc_id", "no"], kind="stable")
    langs, target = np.unique(sample["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
    data = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW)
    return train(data, [str(x) for x in langs], target)


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the language of every whole text and its score.

    All windows of a text are classified; the score of a language is the mean of its probabilities, weighted by the
    windows' lengths, and the highest wins (on a tie the first by name). A null text, or one without letters, gives ``und`` and 0,
    as does every text if nothing could be learned. Input columns stay; columns named like the results are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (lang_out, score_out)]
    at = next(k for k, f in enumerate(kept) if f.name == text_col)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            langs, scores = [], []
            texts = batch.column(at).to_pylist()
            known = [t is not None and net is not None and _LETTER.search(t) is not None for t in texts]
            for text, ok in zip(texts, known, strict=True):
                if not ok:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                data = text.encode()
                total = np.zeros(len(net.langs))
                for part in range(0, len(data), WINDOW * 4096):  # a long text in parts, so that memory stays bounded
                    windows = cut_windows(data[part : part + WINDOW * 4096])
                    weights = np.full(len(windows), WINDOW, "f8")
                    weights[-1] = len(data[part : part + WINDOW * 4096]) - WINDOW * (len(windows) - 1)
                    total += weights @ net.probabilities(windows)
                share = total / total.sum()
                best = int(share.argmax())
                langs.append(net.langs[best])
                scores.append(float(share[best]))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, lang_out, score_out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(classify, f"{schema}, `{lang_out}` string, `{score_out}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: the checksum of its id leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train outside of the held-out fold and predict for all: ``doc_id, held_out, lang_pred, score``.

    Only texts are inputs of a prediction. An empty table gives an empty result.
    """
    net = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    rows = only(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").withColumn("held_out", held_out("doc_id"))
    return predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")
