"""Overlapping text chunks, file summaries and chunk ordinals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import constants as K, paths as P
from ..functions.nested import items
from ..session import TEXT_BATCH_ROWS


def line_chunks(text: str, size: int = K.CHUNK_CHARS, overlap: int = K.CHUNK_OVERLAP) -> list[str]:
    """Whole-line chunks of at least ``size`` characters with whole-line overlap.

    With ``c`` the running length of the lines (newline included), the chunk
    that starts at line ``s`` ends at the first line where ``c`` has grown by
    ``size``, and the next one starts at the earliest line that leaves at most
    ``overlap`` characters before that end.
    """
    lines = text.split("\n")
    c = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])))
    out, s, n = [], 0, len(lines)
    while s < n:
        end = int(np.searchsorted(c, c[s] + size))
        if end > n:
            out.append("\n".join(lines[s:]))
            break
        out.append("\n".join(lines[s:end]))
        s = int(np.searchsorted(c, c[end] - overlap))
    return out


def window_chunks(text: str, size: int = K.LARGE_CHUNK_CHARS, overlap: int = K.LARGE_CHUNK_OVERLAP) -> list[str]:
    """Fixed windows that end after the last newline of their final ``overlap`` characters."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            end = text.rfind("\n", start + size - overlap, end) + 1 or end
        out.append(text[start:end])
        if end == n:
            break
        start = end - overlap
    return out


def split_chunks(content: Column | str, windows: bool = False) -> Column:
    """Chunk texts of each row: whole lines, or fixed ``windows`` for texts without useful lines, as the caller says.

    The start of a chunk depends on the end of the one before it, so this runs
    in Arrow batches; rows only meet their own text.  Of a batch, however many
    texts it has, a few at a time are Python objects.
    """

    @arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = window_chunks if windows else line_chunks
        for texts in batches:
            yield _sliced(texts, cut)

    return run(content)


def _sliced(texts: pa.Array, cut: Callable[[str], list[str]], rows: int = TEXT_BATCH_ROWS) -> pa.Array:
    """The lists that ``cut`` makes of texts, ``rows`` of them at a time."""
    kind = pa.list_(pa.string())
    parts = [
        pa.array([cut(t) if t else [] for t in texts.slice(start, rows).to_pylist()], kind) for start in range(0, len(texts), rows)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def chunks(files: DataFrame, text: str = "content", windows: bool = False) -> DataFrame:
    """One row per chunk with its per-file ordinal; other columns pass through in the JVM.

    Empty and missing texts have no chunks.
    """
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(items(split_chunks(text, windows))).alias("chunk_idx", text))


def with_embedding_idx(chunked: DataFrame) -> DataFrame:
    """Global chunk ordinal per repository, in (file order, chunk order).

    Counts chunks per file, turns the counts into file offsets through order
    ranges, and adds the per-file ordinal: no sort of a whole repository.
    """
    per_file = chunked.groupBy("repo_id", "ord").agg(F.count(F.lit(1)).alias("__n"))
    starts = _running_start(per_file, ["repo_id"], "ord", "__n", "__start")
    return (
        chunked.join(starts.select("repo_id", "ord", "__start"), ["repo_id", "ord"])
        .withColumn("embedding_idx", (F.col("__start") + F.col("chunk_idx")).cast("long"))
        .drop("__start")
    )


def _running_start(df: DataFrame, keys: list[str], order: str, size: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Exclusive running sum of ``size`` by ``order`` within ``keys``, by order ranges."""
    sliced = df.withColumn("__slot", F.floor(F.col(order) / F.lit(width)))
    cells = [*keys, "__slot"]
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*cells).agg(F.sum(size).alias("__t"))
        .select(*cells, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    )
    return (
        sliced.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(offsets, cells)
        .withColumn(name, F.col("__off") + F.col("__in"))
        .drop("__slot", "__off", "__in")
    )


def _listing(title: str, names: Column, lead: str) -> Column:
    """``title`` and the first items as ``- name`` lines, then how many more there are."""
    shown = F.transform(F.slice(names, 1, K.SUMMARY_ITEMS), lambda n: F.concat(F.lit("- "), n, F.lit("\n")))
    more = F.when(
        F.size(names) > K.SUMMARY_ITEMS,
        F.concat(F.lit("... and "), F.size(names) - K.SUMMARY_ITEMS, F.lit(" more\n")),
    ).otherwise("")
    return F.when(F.size(names) > 0, F.concat(F.lit(lead + title + ":\n"), F.array_join(shown, ""), more)).otherwise("")


def file_summary(comps: DataFrame) -> DataFrame:
    """Add ``summary`` (structure header) and ``indexed_text`` (header + content).

    Files without classes and functions are indexed as they are.
    """
    summary = F.concat(
        F.lit("File: "), "name", F.lit("\nLanguage: "), "type", F.lit("\n\n"),
        _listing("Classes", F.transform("classes", lambda c: c["name"]), ""),
        _listing("Functions", F.transform("functions", lambda f: f["name"]), "\n"),
        _listing("Imports", F.col("imports"), "\n"),
    )
    structured = (F.size("classes") > 0) | (F.size("functions") > 0)
    return comps.withColumn("summary", F.when(structured, summary)).withColumn(
        "indexed_text",
        F.when(
            structured, F.concat("summary", F.lit("\n\n"), "content")
        ).otherwise(F.col("content")),
    )


def chunk_rows(comps: DataFrame) -> DataFrame:
    """Chunk table of a component table, with the metadata that retrieval filters on."""
    indexed = file_summary(comps).select(
        "repo_id", "path", "ord", F.col("indexed_text").alias("content"), F.col("type").alias("language"),
        P.extension("path").alias("extension"), "is_entry_point",
        F.transform("classes", lambda c: c["name"]).alias("classes"),
        F.transform("functions", lambda f: f["name"]).alias("functions"), "imports",
    )
    return chunks(indexed)
