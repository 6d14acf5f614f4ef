from pyspark.sql import functions as F

from palisade.functions import constants as K
from palisade.operators import graph as G, prompts as Q, report as Rp, risk as Rk
from palisade.plans import model_queries, views

from .conftest import SF

FLOWS = "repo_id string, source string, function string, parameters array<string>, ord long"
THREATS = (
    "repo_id string, owner_kind string, owner string, ordinal long, type string, description string, severity string, "
    "impact string, mitigation string, code_snippet string, crosses_boundary boolean"
)


def setup(rows):
    flows = rows(FLOWS, [("r", "A.x", "f", ["p"], 1), ("r", "A.x", "", [], 2), ("r", "A.x", "g", [], 3), ("r", "B", "h", [], 4),
                         ("r", "C", "i", [], 5), ("r", "", "j", [], 6)])
    edges = rows("repo_id string, src string, dst string", [("r", "A", "B"), ("r", "A", "C"), ("r", "B", "A.x"), ("q", "C", "B")])
    members = rows("repo_id string, boundary string, member string, ord long",
                   [("r", "in", "A.x", 1), ("r", "in", "B", 1), ("r", "out", "B", 2), ("r", "in", "C", 1)])
    return flows, edges, members


def test_crossings(rows):
    flows, edges, members = setup(rows)
    got = {(x.source, x.function, x.destination, x.source_boundary, x.destination_boundary)
           for x in Rk.cross_boundary_flows(flows, edges, members).collect()}
    assert got == {("A.x", "f", "B", "in", "out"), ("A.x", "g", "B", "in", "out"), ("B", "h", "A.x", "out", "in")}


def test_flags_cover_the_whole_source(rows, plan):
    flows, edges, members = setup(rows)
    flagged = Rk.flow_flags(flows, edges, members)
    assert {(f.ord, f.crosses_boundary) for f in flagged.collect()} == {(1, True), (2, True), (3, True), (4, True), (5, False), (6, False)}
    assert "Window" not in plan(flagged)


def test_members_without_repository_apply_to_all(rows):
    flows, edges, members = setup(rows)
    got = Rk.flow_flags(flows, edges, members.drop("repo_id"))
    assert got.filter("crosses_boundary").count() == 4


def threat(repo, kind, owner, n, sev, crosses=False):
    return (repo, kind, owner, n, "t", "d", sev, None, None, None, crosses)


def test_risk_levels(rows):
    df = rows(THREATS, [
        threat("one_high", "component", "a", 1, "High"), threat("crossing", "flow", "a", 1, "Medium", True),
        threat("plain_flow", "flow", "a", 1, "Medium"), threat("avg", "component", "a", 1, "Low"), threat("avg", "component", "a", 2, "Medium"),
        threat("quirk", "component", "a", 1, "high"), threat("vuln", "vulnerability", "a", 1, "Low"),
    ])
    repos = rows("repo_id string", [("none",), ("one_high",)]).unionByName(df.select("repo_id"))
    got = {r.repo_id: r.overall_risk for r in Rk.overall_risk(df, repos).collect()}
    assert got == {"one_high": "High", "crossing": "High", "plain_flow": "High", "avg": "Medium", "quirk": "Low",
                   "vuln": "High", "none": "Low"}
    fixed = {r.repo_id: r.overall_risk for r in Rk.overall_risk(df, normalize_case=True).collect()}
    assert fixed["quirk"] == "High"


def test_risky_relationships(rows):
    edges = rows("repo_id string, src string, dst string, ord long",
                 [("r", f"s{i}", f"t{j}", i * 10 + j) for i in range(7) for j in range(i + 1)])
    high = rows("repo_id string, component string", [("r", f"s{i}") for i in range(1, 7)])
    lines = [r.line for r in Rk.risky_relationships(edges, high).orderBy("position").collect()]
    assert lines == ["s1 -> t0, t1", "s2 -> t0, t1, t2", "s3 -> t0, t1, t2...", "s4 -> t0, t1, t2...", "s5 -> t0, t1, t2..."]


def test_findings_and_recommendations(rows):
    df = rows(THREATS, [threat("r", "component", "a", 2, "High"), threat("r", "component", "a", 1, "Medium"),
                        threat("r", "flow", "f", 1, "High"), threat("r", "flow", "f", 2, "high"), threat("r", "vulnerability", "v", 1, "High")])
    owners = rows("repo_id string, owner_kind string, owner string", [("r", "component", "a"), ("r", "component", "quiet")])
    found = Rp.findings(owners, df).orderBy("owner", "ordinal").collect()
    assert [(f.owner, f.severity, f.impact) for f in found] == [("a", "Medium", "Unknown"), ("a", "High", "Unknown"), ("quiet", None, None)]
    recs = Rp.recommendations(df).orderBy("priority_order", "kind_order", "target", "ordinal").collect()
    assert [(r.type, r.target, r.priority) for r in recs] == [("Component", "a", "High"), ("Data Flow", "f", "High"), ("Component", "a", "Medium")]
    assert recs[0].description == "Address t threat: d" and recs[0].action == "No mitigation provided"


def test_boundary_context(rows):
    flows, edges, members = setup(rows)
    bounds = rows("repo_id string, boundary string, description string", [("r", "in", "inner"), ("r", "out", None)])
    got = {f.ord: f.boundary_context for f in Q.flow_boundary_context(Rk.flow_flags(flows, edges, members), members, bounds).collect()}
    assert got[5] == "" and got[1] == "Source is within security boundary: in - inner\nWARNING: This data flow crosses security boundaries!"
    assert got[4].count("Source is within") == 2


def test_questions(rows):
    df = rows("repo_id string, path string, ord long, purpose string, is_entry_point boolean, is_critical boolean",
              [("r", "a.php", 1, "Login DB", True, False), ("r", "b.rb", 2, "auth to database", False, True), ("r", "c.tsx", 3, None, False, False)])
    got = {}
    for q in Q.component_questions(df).orderBy("pos").collect():
        got.setdefault(q.path, []).append(q.question)
    assert got["a.php"][4] == "Are there any file operations?" and "How are passwords stored?" in got["a.php"]
    assert got["a.php"][-len(K.PRIORITY_QUESTIONS):] == K.PRIORITY_QUESTIONS == got["b.rb"][-len(K.PRIORITY_QUESTIONS):]
    assert got["b.rb"][2:5] == ["How is SQL injection prevented?", "Are prepared statements used?", "How are passwords stored?"]
    assert got["c.tsx"][2:] == ["Are there any DOM manipulation functions?", "How is AJAX/fetch used?", "Is there input sanitization?"]


def test_limits(rows):
    fn = "array<struct<name: string, parameters: array<string>>>"
    f = lambda n, p: (n, [f"p{i}" for i in range(p)])
    df = rows(
        f"classes array<struct<name: string, methods: {fn}>>, functions {fn}, imports array<string>, dependencies array<string>, context string",
        [([(f"C{i}", [f(f"m{j}", 7) for j in range(6)]) for i in range(4)], [f("g", 9)] * 6, ["i"] * 6, ["d"] * 6, "x" * 2001)],
    )
    a, b = Q.component_parts(df).orderBy("part").collect()
    assert [len(c.methods) for c in a.classes + b.classes] == [6] * 4 and len(a.classes[0].methods[0].parameters) == 7
    assert (len(a.functions), len(b.functions), len(a.imports), len(b.imports), len(a.dependencies), len(b.dependencies)) == (5, 1) * 3
    assert (a.context, b.context) == ("x" * 2000, "x")


def test_prompts_continue(rows):
    fn = "array<struct<name: string, parameters: array<string>>>"
    df = rows(
        f"repo_id string, path string, name string, classes array<struct<name: string, methods: {fn}>>, functions {fn}, imports array<string>, context string",
        [("r", "d/a", "a", [], [], [], "y" * 3000)],
    )
    a, b = Q.structure_prompts(df).orderBy("part").collect()
    assert a.prompt.endswith("Code snippet: " + "y" * 2000) and b.prompt.endswith("Code snippet: " + "y" * 1000)


def test_nodes_and_edges_keep_the_first(rows):
    nodes = rows("repo_id string, node_id string, label string, class string, ord long", [("r", "a", "later", "y", 2), ("r", "a", "first", "x", 1)])
    assert [(n.label, n["class"]) for n in G.dedupe_nodes(nodes).collect()] == [("first", "x")]
    flows = rows(FLOWS, [("r", "a b.c", "f", ["p", "q"], 2), ("r", "a b.c", "f", [], 1), ("r", "", "f", [], 3)])
    assert [(e.src, e.dst, e.label) for e in G.flow_edges(flows).collect()] == [("a_b_c", "f", "")]
    known = rows("repo_id string, name string", [("r", "other")])
    assert G.flow_edges(flows, known).count() == 0


def test_threat_numbers_restart_per_owner(rows):
    df = rows(THREATS, [threat("r", "component", "a.b", 70_000, "High"), threat("r", "component", "a.b", 5, "Low"), threat("r", "flow", "f", 9, "Low")])
    flows = rows(FLOWS, []).withColumn("crosses_boundary", F.lit(False))
    cross = rows("repo_id string, source string, destination string, source_boundary string, destination_boundary string, ord long", [])
    got = {(e.src, e.dst) for e in G.threat_graph_edges(flows, cross, df).collect()}
    assert got == {("a_b", "a_b_threat_1"), ("a_b", "a_b_threat_0"), ("f", "flow_f_threat_0")}


def test_repeated_relations_count_once(rows):
    flows, edges, members = setup(rows)
    twice = edges.unionByName(edges)
    once = sorted(map(str, Rk.crossing_sources(flows, edges, members).collect()))
    assert sorted(map(str, Rk.crossing_sources(flows, twice, members, repeated=True).collect())) == once
    marks = [(r.repo_id, r.source) for r in Rk.crossing_marks(flows, twice, members).collect()]
    assert sorted(marks) == [("r", "A.x"), ("r", "B")]
    assert sorted(map(str, Rk.flow_flags(flows, twice, members).collect())) == sorted(map(str, Rk.flow_flags(flows, edges, members).collect()))


def test_first_crossing_flows_hold_the_first_pairs(rows, monkeypatch):
    flows = rows(FLOWS, [("r", f"A{n % 3}", f"f{n}", [], n // 2) for n in range(40)] + [("r", "A0", "", [], 0), ("q", "A1", "f", [], 1)])
    edges = rows("repo_id string, src string, dst string", [(r, f"A{n}", f"B{m}") for r in "rq" for n in range(2) for m in range(9)])
    members = rows("boundary string, member string, ord long", [("in", f"A{n}", 1) for n in range(3)] + [("out", f"B{m}", 1) for m in range(8)])
    crossing = Rk.crossing_sources(flows, edges, members)
    few = Q.first_crossing_flows(flows, crossing)
    assert few.count() == 5 * 8 + 8  # five flows of one repository, the only one of the other, eight destinations each
    every = Rk.cross_boundary_flows(flows, edges, members)
    assert sorted(map(str, Q.cross_flow_samples(few).collect())) == sorted(map(str, Q.cross_flow_samples(every).collect()))


def test_context_goes_to_crossing_sources_only(rows):
    flows, edges, members = setup(rows)
    zones = rows("repo_id string, boundary string, description string", [("r", "in", "i"), ("r", "out", None)])
    flagged = Rk.flow_flags(flows, edges, members)
    marks = Rk.crossing_marks(flows, edges, members)
    given = sorted(map(str, Q.flow_boundary_context(flagged, members, zones, marks).collect()))
    assert given == sorted(map(str, Q.flow_boundary_context(flagged, members, zones).collect()))


def test_graph_edges_of_distinct_crossings_are_not_shuffled(rows, plan):
    flows, edges, members = setup(rows)
    flagged = Rk.flow_flags(flows, edges, members).localCheckpoint()
    cross = Rk.crossing_sources(flows, edges, members).localCheckpoint()
    threats = rows(THREATS, [threat("r", "flow", "A.x", 1, "High")])
    once = G.threat_graph_edges(flagged, cross, threats, once=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, G.threat_graph_edges(flagged, cross, threats).collect()))
    shuffles = lambda df: plan(df.filter("kind = 'crossing'")).count("Exchange")
    assert shuffles(once) < shuffles(G.threat_graph_edges(flagged, cross, threats))


def test_crossing_flows_read_their_links_once(spark, plan):
    found = model_queries.cross_boundary_flows(spark, SF)
    assert "lineitem.parquet" not in plan(found) and "links-" in plan(found)


def test_findings_are_dealt_by_their_number(spark, plan, monkeypatch):
    monkeypatch.setattr(model_queries, "dealt", lambda df, keys: views.dealt(df, keys, rows=50))
    count = spark.read.parquet(f"{SF}/events.parquet").count()
    for query in (model_queries.findings_report, model_queries.report_text):
        assert f"{-(-count // 50)}), REPARTITION_BY_NUM" in plan(query(spark, SF))
    few, cores = spark.range(40), spark.sparkContext.defaultParallelism
    assert views.dealt(few, ["id"], -(-40 // cores)) is few
    assert views.dealt(few, ["id"], 2).rdd.getNumPartitions() == 20
    assert views.dealt(few, ["id"], 39 // cores).rdd.getNumPartitions() == max(4, -(-40 // (39 // cores)))
