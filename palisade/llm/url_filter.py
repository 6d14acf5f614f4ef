"""URL filter: list rules by host and path, else a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

# Vocabulary of the filter. A strict term rejects alone, soft terms reject together.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "escorts", "camgirls", "warez", "malware", "phishing", "keygen")
SOFT_TERMS = (
    "adult", "bet", "betting", "bitcoin", "casino", "cheap", "crack", "dating", "erotic", "gambling", "hot", "jackpot",
    "loan", "loans", "naked", "nude", "pharmacy", "pills", "poker", "replica", "sex", "sexy", "slots", "torrent", "viagra",
)
# Several distinct soft terms weigh as much as a strict one.
SOFT_LIMIT = 2
# (verdict, rule): a host and its subdomains, and the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, terms array<string>"


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path of a URL; both empty where there is no ``://``."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_LOWER), path


def rule_index(rules: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by host: (path, rule, verdict), longest path first."""
    index: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        index.setdefault(host, []).append((slash + path, rule, verdict))
    for entries in index.values():
        entries.sort(key=lambda e: (-len(e[0]), e[0]))
    return index


def find_rule(host: str, path: str, index: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits: (rule, verdict). Of equally long rules the longer host wins."""
    best = None
    suffix = host
    while suffix:
        for start, rule, verdict in index.get(suffix, ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = (rule, verdict)
                break
        suffix = suffix.partition(".")[2]
    return best


def find_terms(automaton, url: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone, between characters that are not letters or digits."""
    text, strict, soft = url.translate(_LOWER), set(), set()
    for end, (term, is_strict) in automaton.iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            (strict if is_strict else soft).add(term)
    return strict, soft


def judge_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One verdict per row: ``page_id, host, path, rule, verdict, n_strict, n_soft, terms``.

    The longest list rule that fits decides; where none fits, a URL is blocked if it holds one strict term or
    ``soft_limit`` distinct soft terms. Terms are searched in the whole URL in one Aho-Corasick pass, so its cost does
    not depend on the size of the vocabulary. A row never leaves its partition.

    A null URL or one without ``://`` has empty host and path; the vocabulary still judges its text (null: allow).
    Repeated rows are judged each; an empty table gives an empty result; other columns are not carried along.
    """
    import ahocorasick

    index, strict, soft = rule_index(rules), tuple(strict), tuple(soft)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in soft:
            automaton.add_word(term, (term, False))
        for term in strict:
            automaton.add_word(term, (term, True))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("host", "path", "rule", "verdict", "n_strict", "n_soft", "terms")}
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                hits, weak = find_terms(automaton, url) if url and len(automaton) else (set(), set())
                rule, verdict = find_rule(host, path, index) or (None, "block" if hits or len(weak) >= soft_limit else "allow")
                for k, v in zip(out, (host, path, rule, verdict, len(hits), len(weak), sorted(hits | weak)), strict=True):
                    out[k].append(v)
            text, number = pa.string(), pa.int64()
            kinds = (text, text, text, text, number, number, pa.list_(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["page_id", *out]
            )

    return only(df, page_id=f"{id_col}:long", url=f"{url_col}:string").mapInArrow(judge, SCHEMA)
