"""Language, neighbours, token counts, shards and packs against brute force."""

import zlib

import numpy as np
import pytest
from palisade.llm import ann, common, language, packing, queries, sharding, token_counts


def test_language_of_held_out_documents(spark, sf, table):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in table("documents").collect()}
    got = queries.op2_language(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]][0] for r in got if r["held_out"] and len(truth[r["doc_id"]][1] or "") > 100]
    assert np.mean(held) > 0.97


def test_language_edge_cases(spark, docs):
    rows = [(k, "the cat and the dog of the house " * 9 if k % 2 else "der hund und die katze in dem haus " * 9) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "12 !?"), (53, "the " * 300_000), (54, "é"), (1, rows[1][1])]
    df = docs(rows, {k: "en" if k % 2 else "de" for k in range(40)})
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (50, 51, 52))
    assert got[53]["lang_pred"] == "en" and all(got[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(40))
    assert {r["lang_pred"] for r in language.identify(docs(rows)).collect()} == {"und"}  # nothing to learn from
    assert language.identify(docs([])).collect() == []


def test_prediction_reads_nothing_but_text(spark, docs):
    net = language.train(np.frombuffer(b"ab" * 960, np.uint8).reshape(-1, 192), ["x", "y"], np.array([0, 1] * 5))
    a, b = docs([(1, "abc")]), docs([(2, "abc")], {2: "y"})
    assert [r["score"] for r in language.predict(a, net, score_out="s2").selectExpr("s2 AS score").collect()] == [
        r["score"] for r in language.predict(b, net, score_out="s2").selectExpr("s2 AS score").collect()
    ]


def nearest(ids, vectors, query_id, query, k):
    scores = [(-float((v * query).sum()), i) for i, v in zip(ids, vectors, strict=True) if i != query_id]
    return [i for _, i in sorted(scores)[:k]]


def test_recall_of_neighbours(spark, sf, table):
    rows = table("embeddings").collect()
    ids, vectors = [r["vec_id"] for r in rows], [np.array(r["embedding"], "f8") for r in rows]
    by_id = dict(zip(ids, vectors, strict=True))
    found = {}
    for r in sorted(queries.op4_ann(spark, sf).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(float((by_id[q] * by_id[r["vec_id"]]).sum()), abs=1e-12) for r in got)
        hits += len({r["vec_id"] for r in got} & set(nearest(ids, vectors, q, by_id[q], 20)))
    assert hits >= 0.95 * 20 * len(found)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]), (9, [-1.0, 0.5]), (20, [1.0]), (40, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, vec array<double>, rank int, score double")
    got = [tuple(r) for r in ann.search(df, df.filter("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (40, 1, 3, 2.0), (40, 2, 9, 0.5), (40, 3, 0, 0.0)]
    small = df.filter("vec_id < 2")
    assert [tuple(r) for r in ann.search(small, small, k=20).orderBy("query_id").collect()] == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]
    assert ann.search(df.limit(0), df).collect() == [] == ann.search(df, df.limit(0)).collect()


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=(3, 8, 5)[i % 3]) for i in range(300)} | {999: np.ones(50)}  # the last is malformed
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, vec array<double>")
    found = {}
    for r in ann.search(df, df.filter("vec_id < 30 OR vec_id = 999"), k=6, candidate_rows=20, query_rows=7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    alike = lambda q: [i for i, v in vectors.items() if len(v) == len(vectors[q])]
    want = {q: nearest(alike(q), [vectors[i] for i in alike(q)], q, vectors[q], 6) for q in range(30)}
    assert set(found) == set(want) and all(len(found[q]) == 6 for q in want)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 6 * len(want)


def test_copies_are_ranked_by_id(spark):
    df = spark.createDataFrame([(i, [0.3, 0.1, -0.2] if i % 3 else [0.1 * i, 1.0, 0.0]) for i in range(600)], "vec_id long, vec array<float>")
    got = ann.search(df, df.filter("vec_id = 1"), k=5, candidate_rows=50).orderBy("rank").collect()
    vectors = {r["vec_id"]: np.array(r["vec"], "f8") for r in df.collect()}
    assert [r["vec_id"] for r in got] == nearest(list(vectors), list(vectors.values()), 1, vectors[1], 5)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_sections(spark, docs, rule):
    texts = ["one two\nthree\n\n\nfour é 😀\n", "", None, "\n", "x" * 20_000 + "\n" + "y " * 9_000, "no break", "a\n" * 3000]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    encoding, width = token_counts.load_encoding(None)
    want = []
    for doc_id, text in rows:
        text = text or ""
        lines = text.splitlines(keepends=True) if text else [""]
        ends = np.cumsum([len(x) for x in lines])
        spans = list(zip(ends - [len(x) for x in lines], ends, strict=True))
        counts = [0] * len(spans)
        owner, at = [k for k, c in enumerate(text) for _ in c.encode()], 0  # the character of each byte
        for token in encoding.encode_ordinary(text):
            first, stop = owner[at], owner[at + int(width[token]) - 1] + 1
            at += int(width[token])
            held = [max(0, min(b, stop) - max(a, first)) for a, b in spans]
            own = [k for k, h in enumerate(held) if h]
            counts[own[0] if rule == "start" else own[-1] if rule == "end" else max(own, key=lambda k: (held[k], -k))] += 1
        want += [(doc_id, k, a, b, c) for k, ((a, b), c) in enumerate(zip(spans, counts, strict=True))]
    got = [tuple(r)[:5] for r in token_counts.section_tokens(docs(rows), rule=rule).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts.section_tokens(docs([])).collect() == []


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (1, 3)])
def test_hilbert_curve_visits_neighbours(spark, axes, bits):
    from pyspark.sql import functions as F

    side = 1 << bits
    cells = spark.range(side**axes).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"x{k}") for k in range(axes)])
    rows = cells.withColumn("at", sharding.hilbert_index([F.col(f"x{k}") for k in range(axes)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side**axes))
    steps = np.abs(np.diff(np.array([r[:-1] for r in rows]), axis=0)).sum(axis=1)
    assert set(steps) == {1}


def test_shards(spark, sf, table, docs):
    texts = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    check_shards(queries.op6_sharding(spark, sf).collect(), list(texts.items()))
    rows = [(k, "same") for k in range(100)] + [(100, None), (101, ""), (101, ""), (102, "é" * 200_000)]
    check_shards(sharding.shard_documents(docs(rows)).collect(), rows)
    assert sharding.shard_documents(docs([])).collect() == []
    check_shards(sharding.shard_documents(docs(rows[:5])).collect(), rows[:5])


@pytest.mark.parametrize("part", [1 << 20, 16])
def test_equal_texts_share_a_shard(spark, monkeypatch, part):
    monkeypatch.setattr(sharding, "PART_ROWS", part)
    texts = [f"text {k} " * (k % 9) for k in range(40)] + ["hot"] * 70 + [None, ""]
    rows = [(k, texts[k % len(texts)] if k % 3 else "hot") for k in range(900)]
    full = [(k, t, ["de", "en", None][k % 3], f"s{k % 7}") for k, t in rows]
    got = sharding.shard_documents(spark.createDataFrame(full, "doc_id long, text string, lang string, source string").repartition(5)).collect()
    check_shards(got, rows)
    shards = {}
    for r in got:
        shards.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert sum(len(s) - 1 for s in shards.values()) <= 23


def check_shards(got, rows):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    cells = sorted((r["shard"], r["slot"], r["cell"], r["size"], r["text_crc32"]) for r in got)
    assert [c[2] for c in cells] == sorted(c[2] for c in cells)
    # Equal texts lie side by side, so that the ends of the runs alone cut their groups.
    together = [c[3:] for c in cells]
    assert len(set(together)) == 1 + sum(a != b for a, b in zip(together, together[1:])) if together else True


def test_written_shards_prune(spark, docs, tmp_path):
    df = docs([(k, "t" * (k % 50)) for k in range(2000)])
    sharding.write_shards(df.drop("shard"), sharding.shard_documents(df), str(tmp_path / "out"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000 and back.select("shard").distinct().count() == 24
    sources = back.groupBy("shard").agg({"source": "min", "text": "max"}).collect()
    assert len(sources) == 24


def test_written_shards_hold_every_row_once(spark, docs, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, None), (2, None), (3, "")]
    df = docs(rows)
    sharding.write_shards(df, sharding.shard_documents(df, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(df.columns)
    assert sorted(map(repr, back.drop("shard").select(*[c for c in df.columns if c != "shard"]).collect())) == sorted(map(repr, df.drop("shard").collect()))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [2, 3, 3]


def test_a_folder_of_one_machine_is_refused(monkeypatch):
    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: conf.get(key.replace(".", "_"), default))})

    with pytest.raises(ValueError):
        common.shared_path(Session("spark://x", spark_sql_warehouse_dir="file:/tmp/w"), "t")
    assert common.shared_path(Session("spark://x", spark_sql_warehouse_dir="hdfs://n/w"), "t").startswith("hdfs://n/w/.shared/t-")
    assert common.shared_path(Session("local[2]", spark_sql_warehouse_dir="/tmp/w"), "t").startswith("/tmp/w/.shared/t-")
    assert common.shared_path(Session("spark://x", spark_checkpoint_dir="s3a://b/", spark_sql_warehouse_dir="/w"), "t").startswith("s3a://b/t-")


def test_packing_is_whole_and_tight(spark, sf, table, docs):
    texts = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    rows = check_packs(queries.op7_packing(spark, sf).collect(), texts)
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sum(used.values()) >= 0.97 * 2048 * (len(used) - 1)
    odd = [(1, None), (2, ""), (3, "a b " * 5000), (4, "x" * 30_000), (5, "<|endoftext|> <|ENDOFTEXT|> İ Σ ﬁ 's it's 12"), (5, "same id"), (2, "")]
    check_packs(packing.pack_documents(docs(odd)).collect(), odd)
    assert packing.pack_documents(docs([])).collect() == []


def test_decomposed_letters_and_another_tokenizer(spark, docs):
    import public_tokenizers

    odd = [(k, f"A {x} b{x}c, {x.lower()}D e") for k, x in enumerate(["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "K\u212a", "E\u0301", "I\u0307", "\u1e9e"])]
    odd += [(20, "Plain WORDS\x1cand\x85more\u00a0of\u2028them"), (21, " \u0301x\n\u0301Y"), (22, "It's  THE\tend "), (23, "")]
    check_packs(packing.pack_documents(docs(odd)).collect(), odd)
    other = public_tokenizers.path("byte_bpe_50k.json")
    check_packs(packing.pack_documents(docs(odd), tokenizer=other).collect(), odd, other)


def check_packs(rows, texts, path=None):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(want)
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and s[-1][0] + s[-1][1] <= 2048
    return rows


def test_first_fit_decreasing_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 80))
        order = np.argsort(-lengths, kind="stable")
        bins, offsets = packing.first_fit_decreasing(lengths, order, 100)
        room, plain = [], {}
        for k in order:
            at = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
            if at == len(room):
                room.append(100)
            plain[k] = (at, 100 - room[at])
            room[at] -= lengths[k]
        assert {k: (bins[k], offsets[k]) for k in order} == plain


def test_kept_ids_round_trip(spark, docs):
    rows = packing.pack_documents(docs([(1, "the cat sat " * 900)]), keep_ids=True).orderBy("start").collect()
    assert [len(r["ids"]) for r in rows] == [r["length"] for r in rows] and rows[-1]["ids"][-1] == 1
