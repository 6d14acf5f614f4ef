"""The threat diagram as one ordered document, and files of lines read back in order."""

import os
import time

from pyspark.sql import functions as F

from palisade import session
from palisade.functions import constants as K
from palisade.operators import drawing as D
from palisade.plans import drawing_queries
from palisade.sources import results

from .conftest import SF

MEMBERS = "repo_id string, boundary string, member string, ord long"
COMPS = "repo_id string, name string, is_priority boolean, ord long"
FLOWS = "repo_id string, source string, function string, parameters array<string>, crosses_boundary boolean, ord long, seq long"
CROSS = "repo_id string, source string, destination string, source_boundary string, destination_boundary string, ord long"
THREATS = "repo_id string, owner_kind string, owner string, ordinal long, type string, severity string, function string"
VULNS = "repo_id string, ordinal long, type string, severity string, components array<string>"


def body(df, repo="r"):
    got = [x.line for x in D.numbered_lines(df).filter(F.col("repo_id") == repo).orderBy("line_no").collect()]
    head, legend = 2 + len(K.THREAT_STYLES), len(K.THREAT_LEGEND)
    assert got[:head] == ["flowchart TD", "    %% Threat Model Diagram", *K.THREAT_STYLES] and got[-legend:] == K.THREAT_LEGEND
    return [x.strip() for x in got[head:-legend]]


def draw(rows, members=(), comps=(), flows=(), cross=(), threats=(), vulns=(), repos=(), **how):
    m = rows(MEMBERS, list(members))
    return D.threat_drawing(
        m, m, rows(COMPS, list(comps)), rows(FLOWS, list(flows)), rows(CROSS, list(cross)), rows(THREATS, list(threats)),
        rows(VULNS, list(vulns)), rows("repo_id string", [(r,) for r in repos]), **how,
    )


def test_every_part_in_its_place(rows):
    got = body(draw(
        rows,
        members=[("r", "Web", "a.py", 2), ("r", "Db", "d e", 1), ("r", "Web", "d e", 3), ("r", "Web", "a_py", 4)],
        comps=[("r", "z.py", True, 7), ("r", "a.py", True, 1), ("r", "b", False, 2)],
        flows=[("r", "a.py", "run", ["x", "y"], True, 5, 1), ("r", "b", "go", [], False, 5, 0), ("r", "b", "", [], True, 6, 0), ("r", "b", None, None, True, 6, 1)],
        cross=[("r", "a.py", "d e", "Web", "Db", 9), ("r", "a.py", "d e", "Web", "Db", 4), ("r", "a.py", "q", "Web", "Db", 4)],
        threats=[("r", "component", "b", 70_000, "late", "High", None), ("r", "component", "b", 3, "soon", "odd", None),
                 ("r", "flow", "b", 1, "spoof", "MEDIUM", "go"), ("r", "component", "gone", 1, "x", "Low", None)],
        vulns=[("r", 0, "leak", "High", ["b", "new one", ""]), ("r", 1, "none", "Low", None)],
    ))
    assert got == [
        "subgraph security_boundary_0[Db]", "d_e[d e]", "class d_e component;", "end", "class security_boundary_0 boundary;",
        "subgraph security_boundary_1[Web]", "a_py[a.py]", "class a_py component;", "end", "class security_boundary_1 boundary;",
        "b[b]", "class b component;", "b_threat_0{{ soon (odd) }}", "class b_threat_0 lowThreat;", "b --> b_threat_0",
        "b_threat_1{{ late (High) }}", "class b_threat_1 highThreat;", "b --> b_threat_1",
        "z_py[z.py]", "class z_py critical;",
        "gone[gone]", "class gone component;", "gone_threat_0{{ x (Low) }}", "class gone_threat_0 lowThreat;", "gone --> gone_threat_0",
        "go(go)", "class go dataflow;", "b --> go", "flow_b_go_threat_0{{ spoof (MEDIUM) }}", "class flow_b_go_threat_0 mediumThreat;", "go --> flow_b_go_threat_0",
        "run(run)", "class run dataflow;", f"a_py -->|{K.CROSSING_MARK} x, y| run",
        "a_py -->|Crosses: Web → Db| d_e", "q[q]", "class q component;", "a_py -->|Crosses: Web → Db| q",
        "vulnerability_0[/leak (High)/]", "class vulnerability_0 vulnerability;", "b -.-> vulnerability_0",
        "new_one[new one]", "class new_one component;", "new_one -.-> vulnerability_0",
        "vulnerability_1[/none (Low)/]", "class vulnerability_1 vulnerability;",
    ]


def test_empty_models_have_a_frame(rows):
    df = draw(rows, repos=["r", "s"])
    assert body(df) == [] and body(df, "s") == []
    assert draw(rows).count() == 0


def test_boundaries_are_numbered_once(rows):
    numbered = D.boundary_order(rows(MEMBERS, [("r", "B", "x", 5), ("r", "A", "y", 5), ("r", "B", "z", 1 << 40), ("s", "B", "x", 0)]))
    assert {(x.repo_id, x.boundary, x["index"]) for x in numbered.collect()} == {("r", "A", 0), ("r", "B", 1), ("s", "B", 0)}


def test_files_keep_the_order_of_lines(spark, rows, tmp_path):
    lines = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("repo_id"), F.col("id").alias("ord"),
        F.concat(F.lit("line "), 5000 - F.col("id")).alias("line"),
    ).repartition(7)
    results.save_text(lines, str(tmp_path / "t"), ["ord"], files=5)
    files = {p.name for p in (tmp_path / "t").rglob("*.txt")}
    assert len(files) > 2
    got = results.load_lines(spark, str(tmp_path / "t")).orderBy("repo_id", "line_no").collect()
    for repo, wanted in (("a", [i for i in range(5000) if i % 3 == 0]), ("b", [i for i in range(5000) if i % 3])):
        mine = [x for x in got if x.repo_id == repo]
        assert [x.line_no for x in mine] == list(range(1, len(wanted) + 1))
        assert [x.line for x in mine] == [f"line {5000 - i}" for i in wanted]


def test_lines_are_made_of_tables_that_are_derived_once(spark, plan):
    text = plan(drawing_queries.drawing(spark, SF))
    assert all(name in text for name in ("/flagged-", "/inside-", "/ends-")) and "/links-" not in text


def test_the_first_flow_of_a_source_places_it(rows):
    flows = rows(FLOWS, [("r", "a", "f", [], False, 9, 0), ("r", "a", "g", [], False, 4, 0), ("r", "b", "f", [], False, 6, 0)])
    none = {n: rows(s, []) for n, s in (("m", MEMBERS), ("c", COMPS), ("x", CROSS), ("t", THREATS), ("v", VULNS))}
    for f in (flows, flows.drop("seq")):
        for t in (none["t"], none["t"].drop("function")):
            got = body(D.threat_drawing(none["m"], none["m"], none["c"], f, none["x"], t, none["v"], f))
            assert [x for x in got if "class" not in x] == ["a[a]", "g(g)", "a --> g", "b[b]", "f(f)", "b --> f", "a --> f"]


def test_folded_lines_are_numbered_in_rounds_as_single_lines_are(rows, monkeypatch):
    model = dict(
        members=[("r", "Web", "a.py", 2), ("r", "Db", "d e", 1), ("s", "Web", "a_py", 4), ("r", None, "x", 1), ("r", "Db", None, 1)],
        comps=[("r", "z.py", True, 70_000), ("r", "a.py", True, 1), ("s", "b", False, 2), ("r", "no place", True, None), (None, "n", False, 3)],
        # Flows of one place, some of them alike: their nodes and arrows are told apart by their texts.
        flows=[("r", f"s{i % 3}", f"f{i % 4}", ["x"], i % 2 == 0, 65_536 * (i % 3), 0) for i in range(12)] + [("s", "b", "go", [], None, None, 0), ("r", None, "go", None, True, 5, 1)],
        cross=[("r", "a.py", d, "Web", "Db", 4) for d in ("d e", "q", "q", "d.e", None)],
        threats=[("r", "component", "a.py", i * 50_000, "late", "High", None) for i in range(3)] + [("t", "flow", "gone.x", 1, "spoof", None, "go")],
        vulns=[("r", 0, "leak", "High", ["b", "new one", ""]), ("s", 1, None, "Low", None)],
        repos=["r", "empty", None],
    )
    found = lambda df: sorted((x.repo_id, x.line_no, x.line or "") for x in df.collect())
    wanted = found(D.numbered_lines(draw(rows, **model)))
    asked = []
    monkeypatch.setattr(session, "ROUND_ROWS", 9)
    monkeypatch.setattr(D, "rounds", lambda *n: asked.append(session.rounds(*n)) or asked[-1])
    got = D.numbered_lines(draw(rows, **model, folded=True))
    assert found(got) == wanted and len(wanted) > 100 and asked[0] > 1


def _staged(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_the_diagram_keeps_little_on_disk(spark, plan):
    """Neither unnumbered lines nor tables that nothing reads any more stay, and no round leaves its shuffled files."""
    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        found = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}

    before, tables = shuffled(), _staged(spark)
    numbered = drawing_queries.threat_drawing(spark, SF)
    left = {name.rsplit("-", 1)[0] for name in _staged(spark) - tables}
    assert "numbered" in left and not left & {"links", "crossings", "inside", "lines", "starts"}
    until = time.time() + 20  # files are removed behind the job's back
    while (more := sum(n for name, n in shuffled().items() if name not in before)) > 10_000 and time.time() < until:
        time.sleep(0.2)
    assert "Exchange" not in plan(numbered) and more <= 10_000  # sums of counts


def test_rounds_hold_every_key_once(spark):
    keys = spark.range(50).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("k"))
    parts = [keys.filter(session.in_round(r, 3, "k")) for r in range(3)]
    assert all(p.count() for p in parts) and sum(p.count() for p in parts) == 50
    assert session.rounds(0, 4) == 1 and session.rounds(session.ROUND_ROWS + 1, 4) == 2 and session.rounds(1 << 60, 4) == 4
    table = session.stage_parts(parts, "parts")
    assert sorted(table.collect(), key=str) == sorted(keys.collect(), key=str)
    session.unstage(table, keys)
    assert not any(name.startswith("parts-") for name in _staged(spark))
