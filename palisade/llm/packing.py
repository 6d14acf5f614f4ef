"""Token sequences of fixed size: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import TEXT_BATCH_ROWS, only, per_worker, rows_below, written

SIZE, END_ID = 2048, 1
# Pieces that are packed together; the number of groups follows the number of pieces.
GROUP_PIECES, SEED = 2048, 20261
# Entries of the cache of encoded words in a Python worker, and the longest word that it keeps.
CACHE_WORDS, CACHE_BYTES = 600_000, 48

# How a tokenizer file says that it takes words apart at white space and drops it.
SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True,
}

PIECES = "doc_id long, row_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of a text as little-endian 32-bit integers, through a cache of its words where the tokenizer allows it.

    A tokenizer that splits at white space, drops it and merges nothing across it gives a text the ids of its words (between
    ASCII white space) in order. Where it lower-cases, words of ASCII alone are cached in lower case; in others a capital may
    first compose with what follows. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the task one core
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        form = json.loads(self.tokenizer.to_str())
        steps = (form["normalizer"] or {}).get("normalizers", [form["normalizer"]]), (form["pre_tokenizer"] or {}).get("pretokenizers", [form["pre_tokenizer"]])
        self.by_words = bool(steps[1][0]) and {k: steps[1][0].get(k) for k in SPLIT} == SPLIT and all(n and n["type"] in ("NFC", "Lowercase", "Replace") for n in steps[0])
        self.by_words = self.by_words and all(n["type"] != "Replace" or (n["pattern"], n["content"]) == ({"Regex": r"\s+"}, " ") for n in steps[0])
        self.lowers = self.by_words and any(n["type"] == "Lowercase" for n in steps[0])

    def encode(self, text: bytes) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        if self.lowers and b"<|" not in text:  # special tokens are told apart by case, the rest is not
            words = text.lower().split() if text.isascii() else [w.lower() if w.isascii() else w for w in words]
        parts = list(map(self.known.get, words))
        if None in parts:
            new = list(dict.fromkeys(word for word, part in zip(words, parts, strict=True) if part is None))
            done = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
            found = {word: np.array(e.ids, "<u4").tobytes() for word, e in zip(new, done, strict=True)}
            parts = [found[word] if part is None else part for word, part in zip(words, parts, strict=True)]
            for word, ids in found.items():
                if len(word) <= CACHE_BYTES and len(self.known) < CACHE_WORDS:
                    self.known[word] = ids
        return b"".join(parts)


def cut_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    size: int = SIZE, keep_ids: bool = False,
) -> DataFrame:
    """Encode every document and cut it into pieces of ``size`` tokens and a rest: ``PIECES`` (and ``ids`` if asked).

    A document is its ids and ``end_id``. A null text is an empty one, so every row has at least one piece. ``row_id`` tells
    rows apart that repeat a ``doc_id``. The tokenizer is a file, named by its path on the executors.
    """
    schema = PIECES + (", ids array<long>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"word encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            out: list[tuple] = []
            ids = []
            for doc_id, row_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_id", "text")), strict=True):
                whole = encoder.encode(text or b"") + end
                n = len(whole) // 4
                for start in range(0, n, size):
                    part = whole[4 * start : 4 * (start + size)]
                    out.append((doc_id, row_id, start, len(part) // 4, zlib.crc32(part), n))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i8"))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            names = ["doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = only(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, schema)


class Tournament:
    """Bins in the order they were opened; finds the first with room for an item in a logarithm of their number.

    A node holds the larger room of its two children, so the way down takes the left child whenever that is enough.
    """

    def __init__(self, bins: int, size: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return leaf


def first_fit_decreasing(lengths: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; ``order`` visits them from long to short. Full items get bins of their own."""
    bins, offsets = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    full = lengths[order] >= size
    bins[order[full]] = np.arange(full.sum())
    rest, opened = order[~full], int(full.sum())
    tree, filled = Tournament(len(rest), size), [0] * len(rest)
    for k in rest.tolist():
        length = int(lengths[k])
        at = tree.place(length)
        bins[k], offsets[k] = opened + at, filled[at]
        filled[at] += length
    return bins, offsets


def pack(pieces: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` in it.

    Pieces are dealt at random (by a hash of row, start and seed) into groups of about ``group_pieces``, and each group is
    packed by itself: no group grows with the input, nor with any document, source or repeated text. ``pieces`` is counted,
    so it should be a written table.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    carried = [f for f in pieces.schema.fields if f.name != "row_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", sequence_id long, offset long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["start"], pdf["row_id"], pdf["doc_id"].fillna(-1), -pdf["length"]))
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), order, size)
        return pdf[[f.name for f in carried]].assign(sequence_id=(int(pdf["__group"].iloc[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("row_id", "start", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(one, schema)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    size: int = SIZE, group_pieces: int = GROUP_PIECES, keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents: one row per piece, ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (``ids``).

    Texts are encoded where they are read; only their pieces travel, written once to shared storage. A null or empty
    text is one piece that holds the end id; equal rows are packed each; a null ``doc_id`` stays null; an empty table gives
    an empty result; other columns are not carried along.
    """
    pieces = written(cut_pieces(docs, id_col, text_col, tokenizer, end_id, size, keep_ids), "pieces")
    return pack(pieces, size, group_pieces)
