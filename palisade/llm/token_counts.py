"""Tokens per section: whole documents are encoded once and token spans joined to section spans."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TEXT_BATCH_ROWS, only, per_worker, rows_below

# Which section gets a token whose characters lie in several of them.
RULES = ("start", "majority", "end")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_sections(text: str) -> list[tuple[int, int]]:
    """Spans of the lines of a text, each with its line break; they cover the text. An empty text is one empty line."""
    spans, at = [], 0
    while (end := text.find("\n", at)) >= 0:
        spans.append((at, end + 1))
        at = end + 1
    return [*spans, (at, len(text))] if at < len(text) or not spans else spans


def load_encoding(path: str | None):
    """The encoding of a rank file (default: the public byte-level one), and the bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    width = np.zeros(max(ranks.values()) + 1, "i8")
    for token, rank in ranks.items():
        width[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point spans [start, end) of tokens, given their lengths in bytes.

    A token that holds only part of a character spans that character.
    """
    ends = np.cumsum(lengths)
    heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters begun up to and with each byte
    return heads[ends - lengths] - 1, heads[ends - 1]


def attribute(
    first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "start"
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and those of them that cross its borders.

    Sections are sorted, do not overlap and cover the text. ``start``: a token counts where its first character lies,
    ``end``: its last one, ``majority``: most of its characters, the earliest section on a tie.
    """
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, last - 1, "right") - 1
    owner = low if rule == "start" else high if rule == "end" else low.copy()
    crossing = np.flatnonzero(low != high)
    if rule == "majority":
        for k in crossing.tolist():
            held = np.minimum(ends[low[k] : high[k] + 1], last[k]) - np.maximum(starts[low[k] : high[k] + 1], first[k])
            owner[k] = low[k] + int(held.argmax())
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[tuple[int, int]]] = line_sections,
    rule: str = "start", tokenizer: str | None = None,
) -> DataFrame:
    """Tokens of every section of every document: ``doc_id, section, start, end, n_tokens, n_crossing``.

    A document is encoded once as a whole, so its counts add up to its tokens exactly as a model reads it; cutting first
    would change the tokens at every border. Spans count code points, ``section`` counts from 0. ``sections`` returns
    sorted spans that cover the text. Rows never leave their partition.

    A null or empty text has one empty section without tokens; repeated rows count each; an empty table gives an empty
    result; other columns are not carried along.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, width = per_worker(f"encoding {tokenizer}", lambda: load_encoding(tokenizer))
        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            doc_ids = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                spans = np.array(sections(text), "i8").reshape(-1, 2)
                if text:
                    spanned = token_spans(text.encode(), width[encoding.encode_to_numpy(text, disallowed_special=())])
                    counts = attribute(*spanned, spans[:, 0], spans[:, 1], rule)
                else:
                    counts = (np.zeros(len(spans), "i8"),) * 2
                doc_ids += [doc_id] * len(spans)
                for to, values in zip(out, (np.arange(len(spans)), spans[:, 0], spans[:, 1], *counts), strict=True):
                    to.append(values)
            joined = [np.concatenate(c) if c else np.array([], "i8") for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(joined[0], pa.int32()), *(pa.array(c, pa.int64()) for c in joined[1:])],
                ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    return only(df, doc_id=f"{id_col}:long", text=f"{text_col}:string").mapInArrow(count, SCHEMA)
