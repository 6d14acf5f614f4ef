"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score.

Columns only: no Python runs on the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import only

SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
# Characters before a span that are searched for context words, and the score an added span needs.
CONTEXT_CHARS, MIN_SCORE = 40, 0.5
# Lengths of international account numbers by country: fixed values of the registry.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = _digits(value)

    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substring(digits, -k, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def mod97(value: Column) -> Column:
    """The check of account numbers: country and check digits moved to the end, letters as two digits, rest 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substring(moved, k, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


# What every account number begins with; most places of a text fail it at their first character.
AHEAD = "(?=[A-Z]{2}[0-9]{2})"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``needs``: a text that every hit holds. ``base`` spans stay whatever their score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    needs: str = ""
    base: bool = True


# The quantifiers are possessive where nothing that follows could need a character back, and hits of a run of characters
# are only tried at its start or where the last hit ended, so that long runs cost linear time and no stack.
KINDS = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda v: F.lit(True), 0.8, "mail|contact|write to|address", "@",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: F.rlike(v, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        0.6, "ip|host|server|login", ".",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.6, "phone|tel|call|mobile|fax", "+"),
    Kind(
        "iban", AHEAD + "(?:" + "|".join(f"{c}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")", mod97,
        0.7, "iban|account|bank|konto", base=False,
    ),
    Kind("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", lambda v: F.lit(True), 0.3, "phone|tel|call|mobile|fax", base=False),
)
CONTEXT_BONUS = 0.2


def _proposals(kind: Kind, text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(kind.needs)), hits).otherwise(none) if kind.needs else hits


def _confirmed(kind: Kind, text: Column, hits: Column) -> Column:
    """Spans of the hits that pass their check. A hit's place is the length of all texts between and of hits before it.

    Texts between hits are cut only where some hit passes.
    """
    gaps = F.split(text, kind.pattern, -1)
    empty = F.array().cast(SPANS)

    def add(acc: Column, k: Column) -> Column:
        hit = F.get(hits, k)
        start = acc["at"] + F.length(F.get(acc["gaps"], k))
        end = start + F.length(hit)
        near = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))))
        score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.context)), CONTEXT_BONUS).otherwise(0.0)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("value"), score.alias("score"))
        keep = kind.valid(hit) if kind.base else kind.valid(hit) & (score >= MIN_SCORE)
        return F.struct(end.alias("at"), acc["gaps"].alias("gaps"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), gaps.alias("gaps"), empty.alias("spans"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), begin, add, lambda acc: acc["spans"])
    return F.when(F.exists(hits, kind.valid), folded).otherwise(empty)


def find_personal_data(df: DataFrame, text_col: str = "text", out: str = "personal_data") -> DataFrame:
    """Add ``out``: all spans of personal data, ``array<(kind, start, end, value, score)>``, by kind in the order of
    ``KINDS``, then start; code points, end exclusive.

    Hits of a kind are the leftmost that do not overlap each other; those that fail their check are dropped. Added kinds
    (account numbers, national telephone numbers near a word that says so) must reach ``MIN_SCORE`` and lie outside of
    the spans of base kinds. A null text is an empty one without spans. The input's other columns stay; a column named
    ``out`` is replaced. Whole texts are searched; no shuffle, no Python.
    """
    text, hits, found = "__pii_text", [f"__pii_hits_{k.name}" for k in KINDS], [f"__pii_{k.name}" for k in KINDS]
    step = df.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    step = step.withColumns({h: _proposals(k, F.col(text)) for h, k in zip(hits, KINDS, strict=True)})
    step = step.withColumns({f: _confirmed(k, F.col(text), F.col(h)) for f, h, k in zip(found, hits, KINDS, strict=True)})
    base = F.concat(*(F.col(f) for f, k in zip(found, KINDS, strict=True) if k.base))
    added = F.concat(*(F.col(f) for f, k in zip(found, KINDS, strict=True) if not k.base))
    step = step.withColumns({"__pii_base": base, "__pii_added": added})
    apart = F.filter("__pii_added", lambda a: ~F.exists("__pii_base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return step.withColumn(out, F.concat("__pii_base", apart)).drop(text, *hits, *found, "__pii_base", "__pii_added")


def digest(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(names: list[str]) -> Callable[[Column], Column]:
    return lambda span: span["kind"].isin(names)


def redact(df: DataFrame, text_col: str = "text", spans: str = "personal_data") -> DataFrame:
    """Replace every span by its kind in brackets, such as ``[EMAIL]``; overlapping spans become one, of the first kind."""

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(s))
        )

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged = F.when(F.size(by_start) > 1, F.aggregate(by_start, F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge)).otherwise(by_start)
    step = df.withColumn("__merged", merged)
    text = F.col(f"`{text_col}`").cast("string")

    def piece(s: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(F.col("__merged"), k - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    tail = F.substring(text, F.element_at("__merged", -1)["end"] + 1, F.length(text))
    redacted = F.when(F.size("__merged") > 0, F.concat(F.array_join(F.transform("__merged", piece), ""), tail)).otherwise(text)
    return step.withColumn(text_col, redacted).drop("__merged")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and its spans (``personal_data``); see :func:`find_personal_data`.

    Repeated rows are searched each; an empty table gives an empty result; other columns are not carried along.
    """
    return find_personal_data(only(df, doc_id=f"{id_col}:long", text=f"{text_col}:string")).select("doc_id", "personal_data")
