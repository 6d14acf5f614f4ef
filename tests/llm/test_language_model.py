"""The language model against sums over all paths, a plain forward recursion, and plain counts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from palisade.llm import language_model, queries


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_rows(rows, model):
    """Result rows of (doc_id, text) by plain Python, word by word."""
    count = Counter(w for i, text in rows if not is_held(i) for w in tokens_of(text))
    total, kinds = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        words = tokens_of(text)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        now, score = model.start, 0.0
        for w in words:
            g = language_model.word_class(w)
            now = (now @ model.moves) * model.emits[:, g] * (count[w] + 0.1) / model.mass[g]
            score += math.log10(now.sum())
            now = now / now.sum()
        out.append((i, is_held(i), len(words), sum(count[w] > 0 for w in words), total, base, score))
    return sorted(out, key=repr)


@pytest.fixture
def trained(monkeypatch):
    """The models that a test has trained."""
    found, fit = [], language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: found.append(fit(*a)) or found[-1])
    return found


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_given_documents(spark, sf, table, trained, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 20_000)
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    got = queries.op13_language_model(spark, sf)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = got.collect()
    compare(found, plain_rows(rows, trained[0]))
    held = [r for r in found if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def random_model(states, classes, seed=0):
    draw = np.random.default_rng(seed)
    rows = [draw.random(n) + 0.05 for n in (states, (states, states), (states, classes), classes)]
    return language_model.Model(rows[0] / rows[0].sum(), rows[1] / rows[1].sum(axis=1)[:, None], rows[2] / rows[2].sum(axis=1)[:, None], rows[3], 9, 4)


@pytest.mark.parametrize(("window", "slab"), [(2, 3), (3, 100), (64, 2)])
def test_counts_are_those_of_all_paths(window, slab, monkeypatch):
    monkeypatch.setattr(language_model, "WINDOW", window)
    monkeypatch.setattr(language_model, "SLAB", slab)
    model, draw = random_model(2, 4), np.random.default_rng(1)
    lengths = np.array([1, 7, 2, 6, 3, 4])
    classes = draw.integers(0, 4, lengths.sum())
    start, moves, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    scores = []
    for text in np.split(classes, np.cumsum(lengths)[:-1]):
        paths = {}
        for path in itertools.product(range(2), repeat=len(text) + 1):
            p = model.start[path[0]]
            for a, b, g in zip(path, path[1:], text):
                p *= model.moves[a, b] * model.emits[b, g]
            paths[path] = p
        whole = sum(paths.values())
        scores.append(math.log10(whole))
        for path, p in paths.items():
            start[path[0]] += p / whole
            for a, b, g in zip(path, path[1:], text):
                moves[a, b] += p / whole
                emitted[b, g] += p / whole
    got = language_model.expected_counts(model, classes, lengths)
    for g, w in zip(got, (start, moves, emitted), strict=True):
        assert g == pytest.approx(w)
    assert language_model.likelihoods(model, classes, lengths) == pytest.approx(scores)


def test_training_raises_the_likelihood():
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 300, 60)
    classes = np.concatenate([(draw.integers(0, 5, n) + 5 * (k % 2)) for k, n in enumerate(lengths)])
    model = random_model(3, 10, 7)
    scores = []
    for _ in range(6):
        scores.append(language_model.likelihoods(model, classes, lengths).sum())
        model = language_model.improved(model, *language_model.expected_counts(model, classes, lengths))
        assert model.emits.sum(axis=1) == pytest.approx(1) and model.moves.sum(axis=1) == pytest.approx(1)
    assert all(a < b + 60 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0] + 100


def test_odd_texts(spark, docs, trained, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 500)
    rows = [(k, ("alpha beta Gamma. " if k % 3 else "un deux trois, ") * (k % 7)) for k in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\x0b\n"), (103, "É é \x1c ß x"), (None, "alpha beta"), (5, rows[5][1]), (5, "other words"), (104, "many words " * 40_000)]
    got = language_model.score_documents(docs(rows).repartition(3)).collect()
    compare(got, plain_rows(rows, trained[-1]))
    # What is held out teaches nothing.
    held = next(k for k in range(80) if is_held(k) and k % 7)
    changed = [(i, "never seen before " * 5 if i == held else t) for i, t in rows]
    again = language_model.score_documents(docs(changed).repartition(3)).collect()
    other = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in again if r["doc_id"] != held}
    assert all(other[r["doc_id"], r["n_tokens"]] == pytest.approx(r["base_score"]) for r in got if r["doc_id"] != held)
    assert [r["n_known"] for r in again if r["doc_id"] == held] == [1]


def test_classes_share_their_mass(spark, docs, trained):
    language_model.score_documents(docs([(k, f"a bb ccc d{k} a") for k in range(20)])).collect()
    model = trained[-1]
    count = Counter(w for k in range(20) if not is_held(k) for w in tokens_of(f"a bb ccc d{k} a"))
    share = model.emits / model.mass  # of 1 in the smoothed count of a class
    known = sum(share[:, language_model.word_class(w)] * (n + 0.1) for w, n in count.items())
    assert known + share.sum(axis=1) * 0.1 == pytest.approx(1)


def test_nothing_to_learn(spark, docs, trained):
    assert language_model.score_documents(docs([])).collect() == []
    held = next(k for k in range(100) if is_held(k))
    rows = [(held, "a b c"), (held, None)]
    got = language_model.score_documents(docs(rows)).collect()
    compare(got, plain_rows(rows, trained[-1]))
    assert [r["base_score"] for r in got] == [0.0, 0.0] and all(r["train_tokens"] == 0 and r["score"] < 0 for r in got)
