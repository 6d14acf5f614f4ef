"""Similarity join, components and the pipeline against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from palisade.llm import decontaminate, jaccard, language, pii, queries
from palisade.llm.components import connected_components


def shingle_set(text, words):
    parts = (text or "").encode().lower().split()
    return frozenset(tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def groups(rows, rule):
    """(size, component, links) of every row, by comparing all pairs of rows."""
    sets = [shingle_set(t, rule.words) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rule.base * len(sets[a] & sets[b]) >= rule.part * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(sets[k]), low[find(k)] if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows))


def joined(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect())


def near_copies(rng, count, words, edits):
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(words)]
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(["x", "Y", "zz", ""])
        yield " ".join(copy)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [t for size in (30, 120, 400) for t in near_copies(rng, 45, size, size // 15)]
    rows += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows += ["", " \n\t", "one", "ONE", "one two", "é É", "é é", "same text here and there"] + ["Same  TEXT here\nand there"] * 5
    rng.shuffle(rows)
    return list(enumerate(rows, 10)) + [(5, rows[0]), (10, rows[0])]


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(1, 60, 100)])
def test_links_of_all_pairs(docs, texts, rule):
    rows = texts + [(900, None)]
    assert joined(jaccard.similar_documents(docs(rows), rule)) == groups(rows, rule)


@pytest.mark.parametrize("limits", [(2, 2048, 512), (2, 2, 512), (2, 2, 7), (100, 2048, 3)])
def test_long_lists_and_large_clusters(docs, texts, limits, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED_LIST", limits[0])
    monkeypatch.setattr(jaccard, "PAIRWISE_LIST", limits[1])
    monkeypatch.setattr(jaccard, "BLOCK_SETS", limits[2])
    rule = jaccard.Rule()
    assert joined(jaccard.similar_documents(docs(texts), rule)) == groups(texts, rule)


def test_lists_beyond_all_limits_and_shuffled_texts(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED_LIST", 2)
    monkeypatch.setattr(jaccard, "LEADER_LIST", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rule = jaccard.Rule()
    assert joined(jaccard.similar_documents(docs(texts), rule)) == groups(texts, rule)


def test_no_documents(docs):
    assert jaccard.similar_documents(docs([])).collect() == []
    assert joined(jaccard.similar_documents(docs([(1, None), (2, "")]))) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_chains_through_rows_without_an_id(docs):
    words = [f"w{k}" for k in range(60)]
    middle, left, right = (" ".join(w) for w in (words, ["x", *words[1:]], [*words[:-1], "y"]))
    rows = [(None, middle), (7, left), (9, right), (None, middle + " z"), (None, "alone " * 2)]
    rule = jaccard.Rule(3, 96, 100)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.similar_documents(docs(rows), rule).collect()}
    assert got == {(None, 58, 7, 3), (7, 58, 7, 1), (9, 58, 7, 1), (None, 59, 7, 1), (None, 1, None, 0)}


def test_similarity_of_the_table(spark, sf, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    assert joined(queries.op9_ngram_jaccard(spark, sf)) == groups(rows, jaccard.Rule())


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(2)
    rule = jaccard.Rule()
    for size in (5, 100, 1700, 3000):
        base = rng.integers(0, 1 << 63, size).astype("u8")
        sets = [np.unique(np.r_[base[rng.random(size) > 0.04], rng.integers(0, 1 << 63, size // 30 + 1).astype("u8")]) for _ in range(40)]
        sets.sort(key=len)
        n = np.array([len(s) for s in sets])
        bits = [jaccard.bitmap(s) for s in sets]
        for limit in (100, 1):
            jaccard.PAIRWISE_LIST, kept = limit, jaccard.PAIRWISE_LIST
            try:
                edges = jaccard.forest_of_list(n, bits, rule)
            finally:
                jaccard.PAIRWISE_LIST = kept
            tree = list(range(len(sets)))
            for a, b in edges:
                old, new = tree[a], tree[b]
                tree = [new if t == old else t for t in tree]
            for a in range(len(sets)):
                for b in range(a):
                    shared = len(np.intersect1d(sets[a], sets[b]))
                    assert tree[a] == tree[b] or 100 * shared < 90 * (n[a] + n[b] - shared)


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 180)] + [(7, k) for k in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(1, 1)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(spark, sf, table):
    read = lambda df: [r.asDict() for r in df.collect()]
    docs, bench = table("documents"), [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    (_, stage1), (_, stage2), (_, stage3), (_, stage4), (_, stage5) = corpus_pipeline.STAGES
    one = corpus_pipeline.written(stage1(spark, docs, sf), "t")
    labels = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert {r["doc_id"] for r in read(one)} == {i for i, r in labels.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE}
    two = corpus_pipeline.written(stage2(spark, one, sf), "t")
    rows = [(r["doc_id"], r["text"]) for r in read(one)]
    assert sorted(r["doc_id"] for r in read(two)) == sorted(i for i, _, c, _ in groups(rows, corpus_pipeline.NEAR) if i == c)
    three = corpus_pipeline.written(stage3(spark, two, sf), "t")
    items = [decontaminate.item_of(i, t) for i, t in bench]
    dirty = lambda t: any(decontaminate.best_distance(s, decontaminate.normalize(t)) <= s.budget for s in items)
    assert sorted(r["doc_id"] for r in read(three)) == sorted(r["doc_id"] for r in read(two) if not dirty(r["text"]))
    four = corpus_pipeline.written(stage4(spark, three, sf), "t")
    before, after = ({r["doc_id"]: r for r in read(df)} for df in (three, four))
    spans = {r["doc_id"]: r["personal_data"] for r in pii.personal_data(three).collect()}
    for i, r in before.items():
        text, at = "", 0
        for s in sorted(spans[i], key=lambda s: s["start"]):
            if s["start"] >= at:
                text += r["text"][at : s["start"]] + f"[{s['kind'].upper()}]"
                at = s["end"]
        assert after[i]["text"] == text + r["text"][at:] and after[i]["n_chars"] == len(after[i]["text"])
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = read(stage5(spark, four, sf))
    assert {r["doc_id"] for r in five} == set(after)
    assert len(read(corpus_pipeline.run(spark, sf))) == len(five)


def test_near_duplicates_go_by_row(spark, docs, sf):
    words = [f"w{k}" for k in range(60)]
    first, second, third = (" ".join(w) for w in (words, [*words, "x"], [*words, "y"]))
    other, more = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, first), (2, second), (2, other), (3, more), (3, more + " z"), (None, third), (None, "one of its own without an id"), (4, None), (4, None)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), sf).collect()]
    assert sorted(t for i, t in kept if i == 3) in ([more], [more + " z"])
    assert {k for k in kept if k[0] != 3} == {(1, first), (2, other), (None, "one of its own without an id"), (4, None)} and len(kept) == 5


def test_pipeline_on_odd_documents(spark, docs, sf):
    text = "the quick brown fox jumps over the lazy dog and runs away from the house of the bear"
    rows = [(1, text), (1, text), (2, text.upper()), (3, None), (4, ""), (5, "12"), (6, "other words that are not the same as any of those before"), (7, "w " * 100_000)]
    df = docs(rows, {6: "en", 7: None})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, df, sf), name)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), sf).collect() == []
        df = out
    assert sorted(r["doc_id"] for r in df.collect()) == [1, 6, 7]
