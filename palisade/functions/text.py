"""Column functions over report text, prompts and model answers (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .paths import _col

_WS = " \t\n\r\x0b\x0c"


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(_WS))


def token_count(text: Column | str) -> Column:
    """Length-based estimate: four code points per token, rounded down."""
    return F.floor(F.length(_col(text)) / F.lit(K.CHARS_PER_TOKEN)).cast("int")


def section(text: Column | str, name: str) -> Column:
    """Stripped text after the first ``name:`` up to the next blank line; '' if absent."""
    text = _col(text)
    label = name + ":"
    at = F.locate(label, text)
    rest = text.substr(at + len(label), F.length(text))
    return F.when(at > 0, strip(F.substring_index(rest, "\n\n", 1))).otherwise(F.lit(""))


def section_list(text: Column | str, name: str) -> Column:
    """One item per non-blank line of a section, list dashes removed."""
    lines = F.filter(F.split(section(text, name), "\n", -1), lambda s: strip(s) != "")
    return F.transform(lines, lambda s: strip(F.btrim(s, F.lit("- "))))


def json_object(text: Column | str) -> Column:
    """Outermost ``{...}`` if it is valid JSON, else null."""
    return _valid_json(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0))


def json_array(text: Column | str) -> Column:
    """Outermost ``[...]`` if it is valid JSON, else null."""
    return _valid_json(F.regexp_extract(_col(text), r"(?s)\[.*\]", 0))


def _valid_json(raw: Column) -> Column:
    # The parser ignores what follows a value; nothing but one value fits both an array and a field.
    whole = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    return F.when((raw != "") & whole, raw)


def normalise_severity(severity: Column | str) -> Column:
    severity = _col(severity)
    return F.when(F.lower(severity).isin(K.SEVERITIES), severity).otherwise(F.lit("Medium"))


def truncate_middle(text: Column | str, limit: int = 2000) -> Column:
    """Keep the first and last halves of an over-long text around a marker."""
    text = _col(text)
    half = limit // 2
    return F.when(
        F.length(text) > limit,
        F.concat(F.left(text, F.lit(half)), F.lit(K.MIDDLE_MARK), F.right(text, F.lit(half))),
    ).otherwise(text)


def truncate_to_budget(text: Column | str, tokens: Column | str, max_tokens: int) -> Column:
    """Head/tail truncation of a context whose enclosing prompt has ``tokens`` tokens.

    The kept size is ``int(len * max_tokens / tokens * 0.7)``, 60 % head and 40 % tail.
    """
    text, tokens = _col(text), _col(tokens)
    kept = F.floor(F.length(text) * (F.lit(float(max_tokens)) / tokens) * F.lit(0.7))
    head, tail = F.floor(kept * F.lit(0.6)).cast("int"), F.floor(kept * F.lit(0.4)).cast("int")
    # A zero-length tail slice keeps the whole text, as a negative-zero slice does.
    end = F.when(tail == 0, text).otherwise(F.right(text, tail))
    shorter = (kept < F.length(text)) & (F.length(text) > 0) & (head + tail < F.length(text))
    return F.when(
        (tokens > max_tokens) & shorter, F.concat(F.left(text, head), F.lit(K.MIDDLE_MARK), end)
    ).otherwise(text)


def truncate_context(text: Column | str, limit: int = K.CONTEXT_CHARS) -> Column:
    text = _col(text)
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(K.TRUNCATED_MARK))
    ).otherwise(text)


def budget_parts(prompt: Column | str, context_size: int, output_tokens: int) -> Column:
    """A prompt as parts that each fit the context window; joined by blank lines they hold every section.

    Sections (between blank lines) fill a part as long as they fit; one that fits no part is cut into pieces of a whole
    part. One fold over the section *sizes* gives each its part, so texts are only sliced: no explode, no window and no
    shuffle of the texts.
    """
    available = context_size - output_tokens - K.TOKEN_SAFETY
    most = available * K.CHARS_PER_TOKEN
    sections = F.split(_col(prompt), "\n\n", -1)
    pieces = F.flatten(
        F.transform(
            sections,
            lambda s: F.transform(
                F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / F.lit(most)), F.lit(1)).cast("int") - 1),
                lambda k: F.substring(s, k * most + 1, F.lit(most)),
            ),
        )
    )
    start = F.struct(F.lit(0).alias("used"), F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        tokens = token_count(piece) + K.SECTION_BUFFER
        fits = (acc["at"] == 0) | (acc["used"] + tokens <= available)
        return F.struct(
            F.when(fits, acc["used"] + tokens).otherwise(tokens).alias("used"),
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"]))).alias("starts"),
            (acc["at"] + 1).alias("at"),
        )

    def cut(bound: Column) -> Column:
        ends = F.concat(F.slice(bound["starts"], F.lit(2), F.size(bound["starts"])), F.array(F.size(bound["pieces"])))
        return F.transform(
            bound["starts"], lambda s, k: F.array_join(F.slice(bound["pieces"], s + 1, F.get(ends, k) - s), "\n\n")
        )

    # Arrays of one element let an expression be bound once and reused.
    folded = F.transform(F.array(pieces), lambda p: F.struct(F.aggregate(p, start, step, lambda a: a["starts"]).alias("starts"), p.alias("pieces")))
    return F.element_at(F.transform(folded, cut), 1)
