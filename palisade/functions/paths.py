"""Column functions over repo-relative paths and file names (JVM-side only)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from . import constants as K

_SUFFIX = r"[^/.][^/]*(\.[^./]+)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(path: Column | str) -> Column:
    return F.translate(_col(path), "\\", "/")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """Everything before the last slash; empty for a top-level file."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def raw_extension(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), _SUFFIX, 1)


def extension(path: Column | str) -> Column:
    """Lower-cased last suffix of the base name; dotfiles have none."""
    return F.lower(raw_extension(path))


def stem(path: Column | str) -> Column:
    name = basename(path)
    return name.substr(F.lit(1), F.length(name) - F.length(raw_extension(path)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Look a key up in a map literal, which the optimizer folds to a constant."""
    return F.try_element_at(F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in table.items())), F.lit("[|]"), F.lit("=")), key)


def grammar_language(ext: Column | str) -> Column:
    """Grammar family of an extension, null when there is none."""
    return _lookup(K.GRAMMAR_LANGUAGE, _col(ext))


def display_language(ext: Column | str) -> Column:
    return F.coalesce(_lookup(K.DISPLAY_LANGUAGE, F.lower(_col(ext))), F.lit(K.UNKNOWN_LANGUAGE))


def contains_any(text: Column | str, words: Iterable[str]) -> Column:
    """One alternation regex: a single pass over the text, inside codegen."""
    return _col(text).rlike("|".join(re.escape(w) for w in words))


def matching_words(text: Column | str, words: list[str]) -> Column:
    """The words (with their positions) that occur in ``text``: array<struct<pos,word>>."""
    pairs = F.transform(F.split(F.lit("|".join(words)), "[|]"), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    return F.filter(pairs, lambda p: F.contains(_col(text), p["word"]))


def glob_regex(glob: str, any_char: str = "[^/]") -> str:
    """Translate ``*``/``?``/``[...]`` to a regex fragment (driver side, constant input)."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(any_char + "*")
        elif c == "?":
            out.append(any_char)
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def path_matches(path: Column | str, pattern: str) -> Column:
    """Glob over the whole path if the pattern has a wildcard, substring otherwise."""
    if "*" in pattern or "?" in pattern:
        return _col(path).rlike(r"(?s)^" + glob_regex(pattern, any_char=".") + r"\z")
    return F.contains(_col(path), F.lit(pattern))


def is_ignored(path: Column | str, strict_globs: bool = False) -> Column:
    """True if any directory or the file name itself matches an ignore pattern.

    Patterns that contain a slash never match a bare name, so by default they
    have no effect; ``strict_globs`` applies them the way they read.
    """
    parts = [r"(?:^|/)(?:" + "|".join(glob_regex(g) for g in K.IGNORE_NAMES) + r")(?:/|\z)"]
    if strict_globs:
        parts.append(r"(?:^|/)(?:" + "|".join(glob_regex(g) for g in K.STRICT_IGNORE_DIRS) + r")/")
        parts.append(r"(?:^|/)(?:" + "|".join(glob_regex(g) for g in K.STRICT_IGNORE_FILES) + r")\z")
    return _col(path).rlike("|".join(parts))


def is_test_path(path: Column | str) -> Column:
    return F.contains(F.lower(_col(path)), F.lit(K.TEST_WORD))


def is_entry_point(path: Column | str, content: Column | str) -> Column:
    """Well-known stem, or a marker in the content that belongs to the extension.

    The file is bound as one array element, so that ``path`` and ``content``
    occur once in the plan even where they are derived columns.
    """
    stems = "|".join(K.ENTRY_STEMS)

    def entry(f: Column) -> Column:
        hit = F.lower(f["path"]).rlike(rf"(?:^|/)(?:{stems})(?:\.[^./]+)?\z")
        for suffix, marks in K.ENTRY_MARKS.items():
            marked = F.lit(False)
            for mark in marks:
                marked = marked | F.contains(f["content"], F.lit(mark))
            if suffix == ".php":
                head = F.left(f["content"], F.lit(K.PHP_OPEN_TAG_WINDOW))
                marked = marked | F.contains(head, F.lit(K.PHP_OPEN_TAG))
            hit = hit | (f["path"].rlike(rf"[^/.][^/]*\{suffix}\z") & marked)
        return hit

    return F.exists(F.array(F.struct(_col(path).alias("path"), _col(content).alias("content"))), entry)


def is_component(path: Column | str) -> Column:
    return extension(path).isin(K.COMPONENT_EXTENSIONS)
