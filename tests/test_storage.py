import glob
import os

from palisade import session
from palisade.plans import lifecycle
from palisade.sources import results
from palisade.streaming import ingest

FILES = "repo_id string, path string, content string, length long, ord long"


def files(rows, *names):
    return rows(FILES, [("r" if "/" not in n else n.split("/")[0], n, f"text of {n}", 10, i) for i, n in enumerate(names)])


def test_store_replaces_appends_and_clears(spark, rows, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    assert store.load().count() == 0
    store.save(ingest.chunk_vectors(files(rows, "a/x.py", "b/y.py")))
    store.save(ingest.chunk_vectors(files(rows, "a/z.py")))
    assert sorted(r.path for r in store.load().collect()) == ["a/z.py", "b/y.py"]
    store.append(ingest.chunk_vectors(files(rows, "b/w.py")))
    assert {r.repo_id: r.chunks for r in store.sizes().collect()} == {"a": 1, "b": 2}
    store.clear()
    assert store.load().count() == 0


def test_a_replaced_batch_is_dropped_once(spark, rows, tmp_path, monkeypatch):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    store.save(ingest.chunk_vectors(files(rows, "a/x.py", "a/y.py", "b/y.py")))
    store.append(ingest.chunk_vectors(files(rows, "a/w.py")), "more")
    dropped, drop = [], store._drop
    monkeypatch.setattr(store, "_drop", lambda *names: (dropped.append(names), drop(*names)))
    store.save(ingest.chunk_vectors(files(rows, "a/u.py", "a/v.py")))
    assert len(dropped) == 2 and {repo for repo, _ in dropped} == {"a"}
    assert sorted(r.path for r in store.load().collect()) == ["a/u.py", "a/v.py", "b/y.py"]


def test_ingest_twice_adds_nothing(spark, rows, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    batch = files(rows, "a/x.py", "a/x.py", "a/test.py", "a\\x.py")
    ingest.ingest_batch(store, batch)
    once = store.load().count()
    ingest.ingest_batch(store, batch)
    assert once == store.load().count() == 1 + 1  # "a\\x.py" belongs to repository "r"


def test_a_replayed_batch_is_made_whole(spark, rows, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    ingest.ingest_batch(store, files(rows, "a/x.py"), "s-0")
    batch = rows(FILES, [("a", f"d/{i}.py", "\n".join(["t" * 90] * 60), 10, i) for i in range(40)]).repartition(4)
    ingest.ingest_batch(store, batch, "s-1")
    whole = sorted((r.path, r.chunk_idx) for r in store.load().collect())
    parts = sorted(glob.glob(str(tmp_path / "store/repo_id=a/batch=s-1/*.parquet")))
    for part in parts[: max(1, len(parts) // 2)]:
        os.remove(part)
    ingest.ingest_batch(store, batch, "s-1")
    assert sorted((r.path, r.chunk_idx) for r in store.load().collect()) == whole
    ingest.ingest_batch(store, batch, "s-2")
    assert store.load().count() == len(whole)


def test_stream_restarts_where_it_stopped(spark, rows, tmp_path):
    store = ingest.open_store(spark, str(tmp_path / "store"))
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.schema(results.schemas.FILES).parquet(source)
        ingest.start(stream, store, checkpoint, available_now=True).awaitTermination()
        return store.load().count()

    files(rows, "a/x.py").write.parquet(source)
    assert run() == 1 and run() == 1
    files(rows, "a/x.py", "b/y.py").write.mode("append").parquet(source)
    assert run() == 2


def test_scratch_uses_the_clusters_folder(spark, rows):
    base = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(base)
    df = session.stage(files(rows, "a"), "t")
    assert base in df.inputFiles()[0] and df.count() == 1


def test_threat_model_splits_large_owners(spark, rows, tmp_path):
    t = rows(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results.schemas.THREATS),
             [("r", "component", "a", i, "t", None, "Low", None, None, None, False) for i in range(5)])
    owners = rows("repo_id string, owner_kind string, owner string", [("r", "component", "a"), ("r", "flow", "quiet")])
    risk = rows("repo_id string, overall_risk string", [("r", "Low")])
    results.save_threat_model(results.threat_model(owners, t, risk, part=2), str(tmp_path / "m"))
    back = results.load_threat_model(spark, str(tmp_path / "m"))
    assert sorted((m.owner, m.part, len(m.threats)) for m in back.collect()) == [("a", 0, 2), ("a", 1, 2), ("a", 2, 1), ("quiet", 0, 0)]
    assert results.model_threats(back).count() == 5


def test_missing_model_becomes_an_empty_one(spark, rows, tmp_path):
    stacks = rows("repo_id string, tech_stack string", [("r", ".py (1 files)")])
    got = results.load_threat_model(spark, str(tmp_path / "none"), stacks).collect()
    assert [(m.repo_id, m.overall_risk, m.threats) for m in got] == [("r", "Unknown", None)]


def test_text_sink_keeps_order_over_part_files(spark, rows, tmp_path):
    lines = rows("repo_id string, ord long, line string", [("r", i, f"line {i}") for i in range(1000)][::-1])
    results.save_text(lines, str(tmp_path / "doc"), ["ord"], files=4)
    parts = sorted(glob.glob(str(tmp_path / "doc/repo_id=r/part-*.txt")))
    assert len(parts) > 1
    assert "".join(open(p).read() for p in parts).split("\n")[:-1] == [f"line {i}" for i in range(1000)]


def test_lifecycle(spark, rows, tmp_path):
    py = "import os\nfrom util_b import x\nclass A:\n    def m(self):\n        pass\ndef run(a):\n    pass\n"
    corpus = rows(FILES, [("r", "src/main.py", py, 90, 1), ("r", "src/util_b.py", "def helper(x):\n    pass\n", 30, 2)])
    a = lifecycle.analyze(corpus)
    assert a.components.count() == 2 and a.chunks.count() == 2
    assert [(e.src_path, e.dst_path) for e in a.edges.collect()] == [("src/main.py", "src/util_b.py")]
    bounds = rows("repo_id string, response_id long, text string",
                  [("r", 1, "SECURITY_BOUNDARIES:\n- Web: w\n- Lib: l\n\nFILES_BY_BOUNDARY:\n- Web: src/main.py\n- Lib: src/util_b.py")])
    threats = rows("repo_id string, owner_kind string, owner string, text string",
                   [("r", "flow", "src/main.py", "Type: Tampering\nSeverity: Medium"), ("r", "component", "src/main.py", "Type: Spoofing\nSeverity: Low")])
    vulns = rows("repo_id string, response_id long, text string", [])
    m = lifecycle.threat_model(a, bounds, threats, vulns)
    assert {(f.source, f.crosses_boundary) for f in m.flows.collect()} == {("src/main.py", True), ("src/util_b.py", False)}
    assert m.risk.first().overall_risk == "High"  # Medium on a crossing flow weighs 3
    lifecycle.save_model(spark, m, str(tmp_path / "model"))
    back = lifecycle.load_model(spark, str(tmp_path / "model"))
    for name in ("boundaries", "members", "flows", "cross_flows", "threats", "vulnerabilities", "risk"):
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(m, name).collect())), name
    lifecycle.save_report(a, m, str(tmp_path / "report"), "today")
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "report/repo_id=r/*.txt"))))
    assert text.startswith("# Security Threat Analysis Report\n") and "**Overall Risk Level:** High" in text
    assert text.index("## Components Analysis") < text.index("### src/main.py (Python)") < text.index("## Recommendations")
    lifecycle.save_diagrams(a, str(tmp_path / "diagrams"))
    assert glob.glob(str(tmp_path / "diagrams/class_diagram/repo_id=r/*.txt"))
    assert not glob.glob(str(tmp_path / "diagrams/threat_diagram"))
    lifecycle.save_diagrams(a, str(tmp_path / "drawn"), m)
    drawn = [x.line for x in results.load_lines(spark, str(tmp_path / "drawn/threat_diagram")).orderBy("line_no").collect()]
    assert drawn[0] == "flowchart TD" and drawn[-1] == "    end"
    assert drawn.index("    subgraph security_boundary_0[Lib]") < drawn.index("        src/main_py[src/main.py]")
    assert "    src/main_py -->|Crosses: Web → Lib| src/util_b_py" in drawn


def test_report_of_a_saved_model(spark, rows, tmp_path):
    threats = rows("repo_id string, owner_kind string, owner string, ordinal long, type string, description string, severity string, impact string, "
                   "mitigation string, code_snippet string, crosses_boundary boolean",
                   [("r", "component", "a", 0, "Spoofing", "d", "High", "i", None, None, False), ("r", "flow", "f", 0, "Leak", "e", "Low", None, "m", None, True)])
    risk = rows("repo_id string, overall_risk string", [("r", "High"), ("quiet", "Low")])
    owners = rows("repo_id string, owner_kind string, owner string", [("r", "component", "a"), ("r", "flow", "f"), ("r", "component", "b"), ("quiet", "component", "c")])
    results.save_threat_model(results.threat_model(owners, threats, risk), str(tmp_path / "model"))
    lifecycle.report_from_saved(spark, str(tmp_path / "model"), str(tmp_path / "report"))
    lines = results.load_lines(spark, str(tmp_path / "report")).orderBy("repo_id", "line_no").collect()
    text = {r: "\n".join(x.line for x in lines if x.repo_id == r) for r in ("r", "quiet")}
    assert "**Overall Risk Level:** High" in text["r"] and "Address Spoofing threat: d" in text["r"] and text["r"].index("### a") < text["r"].index("### b")
    assert "**Overall Risk Level:** Low" in text["quiet"] and "No threats identified." in text["quiet"]
    stacks = rows("repo_id string", [("lost",)])
    lifecycle.report_from_saved(spark, str(tmp_path / "nothing"), str(tmp_path / "empty"), stacks)
    empty = [x.line for x in results.load_lines(spark, str(tmp_path / "empty")).collect()]
    assert any("Unknown" in x for x in empty)


def test_tables_are_saved_where_their_rows_lie(spark, rows, tmp_path):
    table = rows("a long, b string", [(i, f"t{i}") for i in range(30)]).repartition(3, "a")
    results.save_tables(spark, {"t": table}, str(tmp_path))
    assert len(glob.glob(str(tmp_path / "t/rows/*.json"))) == sum(n > 0 for n in [len(p) for p in table.rdd.glom().collect()]) > 1
    assert sorted(results.load_tables(spark, str(tmp_path), ["t"])["t"].collect()) == sorted(table.collect())
