"""Benchmark items in documents, up to an edit distance: pieces by the pigeonhole rule, verified bit-parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import TEXT_BATCH_ROWS, only, rows_below

# Edits allowed per character of an item.
ERROR_RATE = 0.07
# Characters of items whose pieces are searched in one pass over the documents; more items take further passes.
PASS_CHARS = 8_000_000

_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, distance int, budget int"


def normalize(text: str) -> str:
    """Lower case, words joined by single spaces; punctuation and layout do not count as edits."""
    return " ".join(_WORD.findall(text.lower()))


@dataclass
class Item:
    """A benchmark item, its error budget, and the occurrences of each character as bits, however many."""

    item_id: int | None
    text: str
    budget: int
    masks: dict[str, int]


def item_of(item_id: int | None, text: str, rate: float = ERROR_RATE) -> Item:
    whole = normalize(text)
    places: dict[str, bytearray] = {}
    for at, c in enumerate(whole):
        places.setdefault(c, bytearray(-(-len(whole) // 8)))[at >> 3] |= 1 << (at & 7)
    return Item(item_id, whole, int(len(whole) * rate), {c: int.from_bytes(bits, "little") for c, bits in places.items()})


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces (offset, text) of nearly equal length: within the budget one of them is untouched."""
    n = budget + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_distance(item: Item, text: str) -> int:
    """Smallest edit distance of the item to any part of the text (Myers' bit vectors, one step per character)."""
    size = len(item.text)
    full, top = (1 << size) - 1, 1 << (size - 1)
    masks, plus, minus, score = item.masks, full, 0, size
    best = size
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & full  # a match may begin anywhere: the first row is zero
        plus = (down << 1 & full) | (full & ~(vertical | up))
        minus = up & vertical
    return best


def matches(automaton, items: list[Item], text: str, whole_words: bool = False) -> Iterator[tuple[int, int, int]]:
    """(item, distance, budget) of every item that lies in the text within its budget; ``text`` is normalized.

    With ``whole_words`` an item without a budget counts only where it begins and ends with a word of the text.

    A piece's hit places its item on a diagonal; stretches of near diagonals are merged, so that a stretch of text is
    verified once per item however many pieces hit it.
    """
    starts: dict[int, set[int]] = {}
    for end, places in automaton.iter(text) if automaton is not None else ():
        for k, offset, length in places:
            starts.setdefault(k, set()).add(end + 1 - length - offset)
    for k, diagonals in starts.items():
        item = items[k]
        if whole_words and not item.budget:  # its hits are the item itself
            diagonals = {at for at in diagonals if text[max(0, at - 1) : at] in ("", " ") and text[at + len(item.text) :][:1] in ("", " ")}
            if not diagonals:
                continue
        reach, low, high = item.budget, None, None
        stretches: list[tuple[int, int]] = []
        for at in sorted(diagonals):
            a, b = max(0, at - reach), at + len(item.text) + reach
            if high is not None and a < high:
                high = b
            else:
                if high is not None:
                    stretches.append((low, high))
                low, high = a, b
        stretches.append((low, high))
        distance = min(best_distance(item, text[a:b]) for a, b in stretches)
        if distance <= item.budget:
            yield item.item_id, distance, item.budget


def build_automaton(items: list[Item]):
    import ahocorasick

    by_piece: dict[str, list[tuple[int, int, int]]] = {}
    for k, item in enumerate(items):
        for offset, piece in pieces(item.text, item.budget):
            by_piece.setdefault(piece, []).append((k, offset, len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, places in by_piece.items():
        automaton.add_word(piece, places)
    automaton.make_automaton()
    return automaton


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS, whole_words: bool = False,
) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, distance, budget``, one row per document row and item.

    Both sides are normalized (case, punctuation and layout do not count). A document holds an item if some part of its
    whole text is within ``rate`` edits per character of it. No pair is missed: the pieces' exact hits are complete by the
    pigeonhole rule. Items travel in passes of bounded size, each an Aho-Corasick automaton in the tasks; documents never
    move, and no join or group can be hot.

    Items so short that they may have no edits are part of any text that holds their characters, be it in the midst of words;
    with ``whole_words`` they match whole words only.

    Null texts, items without letters or digits, and items without an id, which no row could name, match nothing; equal items are reported each; repeated document rows
    are reported each; empty tables give an empty result; other columns are not carried along.
    """
    texts = only(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").filter("text IS NOT NULL")

    def detector(listed: list[tuple[int, str]]):
        def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, automaton = prepare(listed, rate)
            for batch in rows_below(batches, TEXT_BATCH_ROWS):
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    out += [(doc_id, *m) for m in matches(automaton, items, normalize(text), whole_words)]
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "budget"])

        return detect

    found = [texts.mapInArrow(detector(listed), SCHEMA) for listed in item_passes(benchmark.filter(F.col(f"`{item_col}`").isNotNull()), item_col, item_text_col, pass_chars)]
    return reduce(DataFrame.unionByName, found)


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS, whole_words: bool = False,
) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns; see :func:`find_items`. Null texts stay.

    Items without an id count as well.

    Each pass of items filters what the pass before it has kept, where the documents are: nothing is shuffled or joined.
    """
    at = next(k for k, f in enumerate(docs.schema.fields) if f.name == text_col)

    def remover(listed: list[tuple[int, str]]):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, automaton = prepare(listed, rate)
            for batch in rows_below(batches, TEXT_BATCH_ROWS):
                kept = [t is None or next(matches(automaton, items, normalize(t), whole_words), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

        return clean

    for listed in item_passes(benchmark, item_col, item_text_col, pass_chars):
        docs = docs.mapInArrow(remover(listed), docs.schema)
    return docs


def item_passes(benchmark: DataFrame, item_col: str, item_text_col: str, pass_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in passes of about ``pass_chars`` characters each; at least one pass, if an empty one."""
    items = only(benchmark, item_id=f"{item_col}:long", text=f"{item_text_col}:string").filter("text IS NOT NULL")
    passes = 1 + (items.select(F.sum(F.length("text"))).head()[0] or 0) // pass_chars
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def prepare(listed: list[tuple[int, str]], rate: float):
    """The items and the automaton of their pieces, in a task; those without letters or digits match nothing."""
    items = [item for item_id, text in listed if (item := item_of(item_id, text, rate)).text]
    return items, build_automaton(items) if items else None
