import random

from palisade.operators import responses as A

FIELDS = ["type", "description", "severity", "impact", "mitigation", "code_snippet"]


def model(text):
    """Independent sequential model of the record parser."""
    out, cur = [], {}

    def close():
        nonlocal cur
        if "type" in cur:
            rec = {f: cur.get(f, None if f == "code_snippet" else "Not specified") for f in FIELDS}
            if rec["severity"].lower() not in ("low", "medium", "high"):
                rec["severity"] = "Medium"
            out.append(tuple(rec[f] for f in FIELDS))
            cur = {}

    for line in map(str.strip, text.split("\n")):
        if not line:
            close()
        elif ":" in line:
            k, v = line.split(":", 1)
            k = k.strip().lower().replace(" ", "_")
            if k in FIELDS:
                cur[k] = v.strip()
    close()
    return out


def parse(rows, texts, **kw):
    df = rows("response_id long, text string", list(enumerate(texts)))
    got = {}
    for r in A.threat_rows(df, **kw).orderBy("response_id", "ordinal").collect():
        got.setdefault(r.response_id, []).append(tuple(r[f] for f in FIELDS))
    return [got.get(i, []) for i in range(len(texts))]


def test_threats_against_model(rows):
    rng = random.Random(2)
    lines = ["Type: A", "type : B: c", "Severity: high", "Severity: odd", "Impact: x", "", "  ", "noise", "- Type: no",
             "Code Snippet: f(x)", "Description: d", "Mitigation:", "TYPE:", "key: v"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    assert parse(rows, texts) == [model(t) for t in texts]


def test_bullets_only_on_request(rows):
    text = "- Type: Spoofing\n- Severity: Low\n"
    assert parse(rows, [text]) == [[]]
    assert parse(rows, [text], strip_bullets=True)[0][0][:3] == ("Spoofing", "Not specified", "Low")


def test_threat_parsing_stays_inside_the_row(rows, plan):
    text = plan(A.threat_rows(rows("response_id long, text string", [(1, "Type: x")])))
    assert "Exchange" not in text and "Window" not in text


def answers(rows, *texts):
    return rows("repo_id string, response_id long, text string", [("r", i, t) for i, t in enumerate(texts)])


def test_boundaries_merge(rows):
    df = answers(
        rows,
        "DESCRIPTION: tiny\n\nSECURITY_BOUNDARIES:\n- Web: short\n* Bad: x\n\nFILES_BY_BOUNDARY:\n- Web: a.py, b.py,\n- Db: early.py",
        "DESCRIPTION: a much longer description\n\nSECURITY_BOUNDARIES:\n- Web: a longer one: yes\n- Db: data\n\nFILES_BY_BOUNDARY:\n- Web: b.py, c.py\n- Db: d.py",
        "DESCRIPTION: brief",
    )
    lines = A.boundary_lines(df)
    merged = A.merge_boundaries(lines)
    assert {(b.boundary, b.description, b.first_response) for b in merged.collect()} == {
        ("Web", "a longer one: yes", 0), ("Db", "data", 1)
    }
    members = A.merge_members(A.boundary_member_lines(df), merged)
    assert {(m.boundary, m.member) for m in members.collect()} == {("Web", "a.py"), ("Web", "b.py"), ("Web", "c.py"), ("Db", "d.py")}
    assert A.architecture_description(df).first().description == "a much longer description"


def test_vulnerabilities(rows):
    good = 'x [{"type": "t", "components": ["a", "b"]}, {"type": "u", "extra": 1}] y'
    got = A.vulnerability_rows(answers(rows, good, '[{"type": "t"}, {]', "no", '{"type": "t"}')).orderBy("ordinal").collect()
    assert [(v.response_id, v.ordinal, v.type, v.components, v.severity) for v in got] == [
        (0, 0, "t", ["a", "b"], None), (0, 1, "u", None, None)
    ]


def test_default_boundary(rows):
    files = rows("repo_id string, path string, ord long", [(r, f"f{i:02d}", i) for r in "ab" for i in range(40)])
    named = rows("repo_id string, boundary string", [("a", "Web")])
    got = A.default_boundary(files, named).orderBy("position").collect()
    assert [(g.repo_id, g.member) for g in got] == [("b", f"f{i:02d}") for i in range(40)]
    assert A.default_boundary(files, named, limit=3).count() == 3
