"""URL filter, personal data, HTML extraction and decontamination against plain Python."""

import hashlib
import html
import random
import re

import pytest
from palisade.llm import decontaminate, html_text, pii, queries, url_filter
from palisade.plans.check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, con, sf, name):
    ok, note = compare(spark, con, sf, queries.QUERIES[name], queries.ORACLE[name])
    assert ok is True, note


def test_url_verdicts(spark):
    urls = {
        1: ("http://a.net/x", "net/", "block"), 2: ("https://EXAMPLE.net/en/1?q", "example.net/en/", "allow"),
        3: ("http://m.example.com/de/", "example.com/de/", "block"), 4: ("http://x.org/fr/1", "org/fr/", "allow"),
        5: ("http://x.org/xxx", None, "block"), 6: ("http://x.org/xxxl", None, "allow"), 7: ("http://poker.x.org/?a=bet", None, "block"),
        8: ("http://poker.x.org/poker", None, "allow"), 9: (None, None, "allow"), 10: ("porn", None, "block"), 11: ("", None, "allow"),
        12: ("http://a.net", None, "allow"), 13: ("x://net/" + "a/" * 50_000, "net/", "block"), 14: ("http://notnet.com/de/", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "z") for k, v in urls.items()], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}
    assert url_filter.judge_urls(df.limit(0)).collect() == []
    assert url_filter.split_url("HTTP://A.Net:80/P?q#f") == ("a.net:80", "/P")


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda v: luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def base_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_personal_data_in_odd_texts(spark, docs):
    rng = random.Random(5)
    alphabet = "ab1029 4.-+()@%_é😀\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "000255.1.1.1 256.1.1.1", "4111 1111-1111 1111", "9" * 30_000, "a" * 30_000, "a@" + "b." * 20_000 + "c", "+1(((((((2 345678901"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (0, texts[0])]
    got = pii.personal_data(docs(rows)).collect()
    names = [k.name for k in pii.KINDS if k.base]
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["personal_data"] if s["kind"] in names] == base_spans(by_id[r["doc_id"]])
    assert pii.personal_data(docs([])).collect() == []


def test_added_kinds_and_redaction(spark, docs):
    text = "é my iban DE89 3704 0044 0532 0130 00, not DE88370400440532013000; call (212) 555-0100 or 212-555-0101 x@y.zz"
    found = pii.find_personal_data(docs([(1, text), (2, None), (3, "")]))
    spans = {r["doc_id"]: r["personal_data"] for r in found.collect()}
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans[1]] == [
        ("email", "x@y.zz"), ("iban", "DE89 3704 0044 0532 0130 00"), ("tel", "(212) 555-0100"), ("tel", "212-555-0101"),
    ]
    assert spans[2] == spans[3] == []
    texts = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert texts[1] == "é my iban [IBAN], not DE88370400440532013000; call [TEL] or [TEL] [EMAIL]"
    assert texts[2] is None and texts[3] == ""


def test_no_python_on_native_paths(spark, docs, plan):
    from palisade.llm import sharding

    for df in (pii.personal_data(docs([(1, "a")])), sharding.shard_documents(docs([(1, "a")]))):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def article(page):
    """The blocks of the article element, read with two patterns."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)[^>]*>", inner[1].replace("<br>", " ")) if inner else []
    return "\n\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks) if b)


def test_page_texts(spark, table, sf):
    pages = {r["page_id"]: r["html"] for r in table("pages").collect()}
    got = queries.op8_html_text(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: article(v) for k, v in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice"><p>We use cookies, and more of them.</p></div>
<script>var t="</p><article>";</script>%s<aside><p>Read this as well, it is longer than you think it should be.</p></aside>
<section id="comments"><article><p>I do not agree with any of this, said a reader at length.</p></article></section>
<form><label>Mail</label><input name="q"></form><footer><p>&copy; 2020</p></footer></body></html>"""
STORY = "<h1>A  title</h1><p>First\n&amp; long paragraph of the story, which goes on for a while to be found.<p>Second.<div class='ad'>Buy!</div><p>Third<br>line &lt;b&gt;."
TEXT = "A title\n\nFirst & long paragraph of the story, which goes on for a while to be found.\n\nSecond.\n\nThird line <b>."


def test_a_page_without_marks():
    links = "".join(f"<div><a href='/{k}'>Section {k}</a></div>" for k in range(8))
    story = "".join(f"<div>Sentence number {k} of a story that is told at some length, as stories are.</div>" for k in range(6))
    page = f"<body>{links}<div><h2>Head</h2></div>{story}{links}<div>&copy; 2024 Site, all rights reserved</div>"
    want = ["Head", *(f"Sentence number {k} of a story that is told at some length, as stories are." for k in range(6))]
    assert html_text.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", "<div class='content'>%s</div>", "%s"])
def test_noise_around_the_story(wrap):
    assert html_text.main_text(PAGE % (wrap % STORY)) == TEXT


def test_all_lines_between_surge_and_dive():
    long = "Copyright is what this paragraph is about, and it says so at its start before it goes on for quite a while longer."
    story = ["The first paragraph of a story that is told at some length, as most of the stories are.", "A link of its own", "(c) stands for it", long, "All rights reserved? No.", "An end."]
    page = "<body><p>%s<p><a href='/x'>%s</a><p>%s<p>%s<p>%s<p>%s<div>&copy; 2024 Site</div>" % tuple(story)
    assert html_text.main_text(page) == "\n\n".join(story)
    last = "<body><p>%s<p>%s<p><a href='/a'>About</a>" % (story[0], long)  # long, so it is text even at the end
    assert html_text.main_text(last) == f"{story[0]}\n\n{long}"


@pytest.mark.parametrize("name", ["elementor-widget-container", "sidebar-right", "search alert", "share"])
def test_a_wrapper_with_a_noise_word(name):
    paragraphs = [f"Paragraph {k} of a story inside of a wrapper that is named like something else." for k in range(4)]
    parts = "".join(f"<div class='{name}'><p>{p}</p></div>" for p in paragraphs)
    for body in (f"<div id='{name}'>{''.join(f'<p>{p}' for p in paragraphs)}</div>", f"<div class='{name}'>{parts}</div>", parts):
        page = f"<body><nav>Go to one of the places</nav><div class='cookie'>We use cookies.</div>{body}<div style='display:none'>{'hidden ' * 200}</div>"
        assert html_text.main_text(page) == "\n\n".join(paragraphs)


PARAGRAPH = "A paragraph of the story that is told at some length, so that it is surely no bar of links."


@pytest.mark.parametrize("opened", [
    "article class='overflow-hidden p-4'", "article", "main", "article data-x='hidden'", "article aria-hidden='false'", "div class='overflow-hidden rounded'", "div title='not display : none'",
])
def test_what_looks_hidden(opened):
    tag = opened.split()[0]
    hidden = "".join(f"<div {a}>{PARAGRAPH} Unseen.</div>" for a in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "style='color:red; display: none'", "class=x hidden id=y"))
    page = f"<body><nav><a href='/'>Home</a></nav><{opened}><p>{PARAGRAPH}</p>{hidden}<p class='visually-hidden-not'>{PARAGRAPH} More.</p></{tag}><footer>Foot</footer>"
    assert html_text.main_text(page) == f"{PARAGRAPH}\n\n{PARAGRAPH} More."


def test_noise_words_inside_content():
    bars = "<div class='social-links'><a href='/f'>Share</a> or <a href='/t'>send</a></div><div class='search'>Find it here</div><div class='comments'><p>%s I disagree.</p></div>" % PARAGRAPH
    page = f"<body><article><h1>Title</h1><p class='social-science'>{PARAGRAPH}</p><div class='search-results'><p>{PARAGRAPH} Two.</p><p>Short.</p></div>%s</article>"
    assert html_text.main_text(page % "") == f"Title\n\n{PARAGRAPH}\n\n{PARAGRAPH} Two.\n\nShort."
    assert html_text.main_text(f"<body><article><h1>Title</h1><p>{PARAGRAPH}</p>{bars}</article>") == f"Title\n\n{PARAGRAPH}"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup"), (4, "u", "<p>" * 5000 + "x"), (5, "u", "<article><p>a &lt <b 'unclosed> c"), (5, "u", "<nav>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS n_chars")
    got = [(r["page_id"], r["text"]) for r in html_text.extract_text(df).collect()]
    assert got[:4] == [(1, ""), (2, ""), (3, "no markup"), (4, "x")] and got[5] == (5, "") and got[4][1].startswith("a <")
    assert html_text.extract_text(df.limit(0)).collect() == []


def edit_distance_within(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != x)))
        last = row
    return min(last)


def test_bit_vectors_equal_the_matrix():
    rng = random.Random(3)
    for _ in range(500):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.best_distance(decontaminate.item_of(1, item, 0.1), text) == edit_distance_within(item, text)


def test_short_items_and_items_without_an_id(spark, docs):
    rows = [(1, "banana bread"), (2, "A, b."), (3, "not a  b but"), (4, "a ba b"), (5, "tuna b"), (6, "a text that no item is part of, though it has words")]
    bench = spark.createDataFrame([(7, "a b"), (None, "that no item is part of")], "item_id long, text string")
    got = decontaminate.find_items(docs(rows), bench, whole_words=True).collect()
    assert sorted(map(tuple, got)) == [(2, 7, 0, 0), (3, 7, 0, 0)]
    left = decontaminate.remove_contaminated(docs(rows), bench, whole_words=True)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5]


def test_a_half_of_a_long_item_is_not_the_item(spark, docs):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(1000)]
    near = list(words)
    for k in range(0, 1000, 40):
        near[k] = "other"
    rows = [(1, " ".join(words[:520])), (2, "Before. " + ", ".join(words) + " after"), (3, " ".join(near)), (4, " ".join(words[500:] + words[:500]))]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    size = len(" ".join(words))
    assert size > 5000
    got = {r["doc_id"]: r for r in decontaminate.find_items(docs(rows), bench, whole_words=True).collect()}
    assert set(got) == {2, 3} and got[2]["distance"] == 0 < got[3]["distance"] <= got[3]["budget"] == int(size * decontaminate.ERROR_RATE)
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(docs(rows), bench).collect()) == [1, 4]


def test_items_with_edits_are_found(spark, docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 40)))) for k in range(12)] + [(90, None), (91, " !"), (92, "ab")]
    rows = []
    for k in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if k % 2:
            passage = list(items[k % 12][1])
            for _ in range(rng.randint(0, len(passage) // 10)):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            text = f"{text}. {''.join(passage).upper()}; {text}"
        rows.append((k, text))
    rows += [(200, None), (201, ""), (3, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text in rows:
        for item_id, item in items:
            whole = decontaminate.item_of(item_id, item or "")
            distance = edit_distance_within(whole.text, decontaminate.normalize(text or ""))
            if whole.text and text is not None and distance <= whole.budget:
                want.append((doc_id, item_id, distance, whole.budget))
    got = sorted(map(tuple, decontaminate.find_items(docs(rows), bench).collect()))
    assert got == sorted(want) and len({w[2] for w in want}) > 3
    assert sorted(map(tuple, decontaminate.find_items(docs(rows), bench, pass_chars=300).collect())) == got
    left = decontaminate.remove_contaminated(docs(rows), bench, pass_chars=300)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in rows if d not in {w[0] for w in want})
    assert left.columns == docs(rows).columns
    assert decontaminate.find_items(docs([]), bench).collect() == [] == decontaminate.find_items(docs(rows), bench.limit(0)).collect()
