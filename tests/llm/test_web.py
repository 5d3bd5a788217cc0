"""Page text and WARC archives."""

import hashlib
import math
import random
import uuid
from html.parser import HTMLParser

import numpy as np
import pytest

from lexloom.llm import html_text, warc
from lexloom.llm.html_text import extract, main_text, path_scores
from lexloom.session import shared_folder

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>"</script></head><body>
<header><h1>Site name, with marks. Many.</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, as all do. Please agree, now.</p></div>
<div class="wrap"><div class="side-bar left"><p>Read more, much more. It is all here, today.</p></div>
<div class="content"><h2>Head &amp; line</h2><!-- no --><p>First part, with <b>bold</b> and <a href="x">a link</a>
in it. It goes on, and on.<p>Second&nbsp;part &lt;here&gt;, with a<br>break. It also goes on.
<ul><li>one item, short.<li>two items, short.</ul><form><p>Your name, please.</p></form></div>
<section class="comments"><p>I do not agree, not at all. Never.</p></section></div>
<footer><p>All rights, reserved. Here.</p></footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE).split("\n") == [
        "Head & line",
        "First part, with bold and a link in it. It goes on, and on.",
        "Second part <here>, with a break. It also goes on.",
        "one item, short.",
        "two items, short.",
    ]


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("   ", ""),
        ("plain words, here.", "plain words, here."),
        ("<p>a<br>b<p>c", "a b\nc"),
        ("<article><h1>t</h1></article>", "t"),
        ("<article></article><footer>f, g.</footer>", ""),
        ("<article><p>cut off, right he", "cut off, right he"),
        ("<article><p>cut in a tag, yes.</p></artic", "cut in a tag, yes."),
        ("<script>never ends", ""),
        ("<article><p>1 < 2, and 3 > 2.</p></article>", "1 < 2, and 3 > 2."),
        ("<article><p>&#x41;&#66;&copy &unknown; &am</p></article>", "AB© &unknown; &am"),
        ("<article><p>a  b\t\n c</p></article>", "a b c"),
        ("<div><article><header><h1>Title, here.</h1></header><p>Body, here.</p></article></div>", "Title, here.\nBody, here."),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_paths_with_more_text_and_marks_score_higher():
    paths = ["/nav/li"] * 6 + ["/div/p"] * 6
    scores = path_scores(paths, np.array([5] * 6 + [200] * 6), np.array([0] * 6 + [4] * 6))
    assert scores[6:].min() > scores[:6].max()


def pages(spark):
    same = "<article><p>" + "equal words, all of them. " * 8 + "</p></article>"
    rows = [(4, "http://a/", same), (2, "http://b/", same), (9, None, same), (None, "http://n/", same), (2, "http://b/", same)]
    rows += [(10, "http://c/", "short"), (11, "http://d/", "short"), (12, "http://e/\r\nX: y", None), (13, "http://f/", "")]
    rows += [(14, "http://g/", "é" * 60), (15, "http://h/", "é" * 60), (16, "http://i/", "WARC/1.1\r\n\r\nnot a record\r\n\r\n" * 9)]
    rows += [(17, "http://j/", "long " * 60_000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, text int, payload string")


def test_extract_keeps_rows(spark):
    df = pages(spark)
    rows = extract(df).collect()
    assert len(rows) == df.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["page_id"]: r["text"] for r in rows}[12] == ""
    assert extract(df.limit(0)).count() == 0


@pytest.fixture
def archives(spark):
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


@pytest.mark.parametrize("few", [50_000, 0])
def test_round_trip_equals_brute_force(spark, archives, few, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", few)
    df = pages(spark)
    got = [tuple(r) for r in warc.round_trip(df, archives).collect()]
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    wanted = []
    for page, data in rows:
        ids = [p for p, d in rows if d == data and p is not None]
        first = min(ids) if len(data) >= 100 and ids else page
        revisit = page != first
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_payloads_and_fields_come_back(spark, archives):
    df = pages(spark)
    warc.write_archives(df, archives)
    read = warc.read_archives(spark, archives)
    rows = read.where("record_type = 'response'").collect()
    html = {r["page_id"]: r["html"] or "" for r in df.collect()}
    for r in rows:
        page = r["record_id"].removeprefix("<urn:page:").removesuffix(">")
        assert r["payload"].decode() == html[int(page)] and r["payload_length"] == len(r["payload"])
        assert r["headers"]["content-type"].startswith("application/http")
    assert {r["target_uri"] for r in rows if r["record_id"] == "<urn:page:12>"} == {"http://e/%0D%0AX: y"}


def test_header_predicates_are_pushed(spark, archives, capfd):
    warc.write_archives(pages(spark), archives)
    read = warc.read_archives(spark, archives, "record_id", "record_type", "target_uri")
    asked = read.where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r["record_id"] for r in asked.collect()] == ["<urn:page:4>"]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan  # the source applies both


def test_unwanted_payloads_are_skipped(spark, archives):
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo

    warc.write_archives(pages(spark), archives)
    schema = T.StructType.fromDDL("record_id string, payload binary")
    reader = warc.WarcReader(archives, schema)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit")])) == []
    read = [size for part in reader.partitions() for _, size in reader.rows(part.value)]
    assert len(read) == 4 and sum(read) == 0  # revisits only; their payloads are empty


def test_broken_archives_are_told(tmp_path):
    import io

    assert warc.parse_header(io.BufferedReader(io.BytesIO(b"\r\n\r\n"))) is None
    with pytest.raises(ValueError):
        warc.parse_header(io.BufferedReader(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))
    folded = io.BufferedReader(io.BytesIO(b"WARC/1.0\r\nA: b\r\n c\r\n\r\n"))
    assert warc.parse_header(folded) == {"a": "b c"}


def test_no_pages(spark, archives):
    assert warc.round_trip(pages(spark).limit(0), archives).count() == 0


def test_clashing_columns_and_repeated_pages(spark, archives):
    rows = [(1, "http://a", "<p>" + "x" * 200, 7, "a", "b", "c", "d")] * 2 + [(2, None, None, 7, "a", "b", "c", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int, payload_digest string, record_type string, refers_to string, payload string")
    got = sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.round_trip(df, archives).collect())
    assert got == [(1, "response", 203), (1, "response", 203), (2, "response", 0)]


# --- selection by paths --------------------------------------------------------


class Tree(HTMLParser):
    """Text nodes of a well-formed page as (text, chain of (tag, number, classes)), slowly and by the book."""

    def __init__(self, page):
        super().__init__()
        self.chain, self.found, self.number, self.block = [], [], 0, 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.number += 1
        self.block += tag in html_text.BLOCKS
        self.chain.append((tag, self.number, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        self.block += tag in html_text.BLOCKS
        assert self.chain.pop()[0] == tag

    def handle_data(self, data):
        self.found.append((data, list(self.chain), self.block))


def slow_main_text(page):
    nodes = [n for n in Tree(page).found if n[0].strip() and not any(t in html_text.OUTSIDE or c == "ad" for t, _, c in n[1])]
    if not nodes:
        return ""
    path = lambda n: "/".join(t for t, _, _ in n[1] if t in html_text.BLOCKS or t == "a")
    linked = lambda n: any(t == "a" for t, _, _ in n[1])
    by_path = {}
    for n in nodes:
        by_path.setdefault(path(n), []).append(n)
    text = {p: sum(0 if linked(n) else len(n[0].strip()) for n in ns) / len(ns) for p, ns in by_path.items()}
    stops = {p: sum(c in ".,;:!?…" for n in ns for c in n[0]) / len(ns) for p, ns in by_path.items()}

    def smoothed(values, i):
        near = [(math.exp(-((j - i) ** 2) / 2), values[path(nodes[j])]) for j in range(max(0, i - 2), min(len(nodes), i + 3))]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    if len(nodes) >= 5:
        scores = [math.sqrt(smoothed(text, i) * (1 + smoothed(stops, i))) for i in range(len(nodes))]
    else:
        scores = [math.sqrt(text[path(n)] * (1 + stops[path(n)])) for n in nodes]
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    of_path = {}
    for n, s in zip(nodes, scores):
        of_path.setdefault(path(n), []).append(s)
    chosen = {p for p, s in of_path.items() if sum(s) / len(s) >= html_text.THRESHOLD * spread and sum(s) > 0}
    content = [n for n in nodes if path(n) in chosen] or [n for n in nodes if not linked(n)]
    article = lambda n: next((k for t, k, _ in n[1] if t in ("article", "main")), None)
    container = lambda n: [0, *(k for t, k, _ in n[1] if t in html_text.REGIONS)][-1]
    listed = lambda n: next((k for t, k, _ in n[1] if t == "ul"), None)
    menus = set()
    for k in {listed(n) for n in nodes if not article(n)} - {None}:
        mine = [n for n in nodes if listed(n) == k]
        links = [len(n[0].strip()) for n in mine if linked(n)]
        if len(links) > 2 and sum(links) > 0.6 * sum(len(n[0].strip()) for n in mine):
            menus.add(k)
    lines = {}
    for n in nodes:
        bridged = article(n) and article(n) in map(article, content)
        beside = container(n) in [container(c) for c in content if not article(c)]
        if bridged or listed(n) not in menus and (n in content or beside):
            lines.setdefault(n[2], []).append(n[0])
    return "\n".join(" ".join("".join(parts).split()) for parts in lines.values())


def invented(rng):
    words = lambda n: " ".join("".join(rng.choices("abcde", k=rng.randint(1, 8))) + rng.choice(["", "", ",", "."]) for _ in range(n))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "div", "div", "section", "ul", "h2", "article", "nav", "ad"])
        if kind in ("div", "section", "article", "ad") and depth < 3:
            inner = "".join(part(depth + 1) for _ in range(rng.randint(1, 4)))
            return f'<div class="ad">{inner}</div>' if kind == "ad" else f"<{kind}>{inner}</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{rng.choice(['<a>%s</a>', '%s']) % words(3)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind == "nav":
            return f"<nav>{words(3)}</nav>"
        return f"<h2>{words(3)}</h2>" if kind == "h2" else f"<p>{words(rng.choice([2, 30, 60]))}</p>"

    return "<html><body>" + "".join(part(0) for _ in range(rng.randint(1, 7))) + "</body></html>"


def test_main_text_equals_a_slow_extractor():
    rng = random.Random(6)
    for _ in range(400):
        page = invented(rng)
        assert html_text.main_text(page) == slow_main_text(page), page


def test_scores_of_paths_decide(monkeypatch):
    """With constant scores other nodes come out on pages whose boilerplate no name gives away."""
    rng = random.Random(7)
    pages_ = [invented(rng) for _ in range(200)]
    before = [html_text.main_text(p) for p in pages_]
    monkeypatch.setattr(html_text, "path_scores", lambda paths, lengths, marks: np.ones(len(paths)))
    assert sum(a != b for a, b in zip(before, map(html_text.main_text, pages_))) > 25


def test_nothing_of_several_articles_is_lost():
    prose = lambda n: "<p>" + "Some words here, and more of them. " * n + "</p>"
    two = html_text.main_text(f"<body><article>{prose(12)}</article><article>{prose(24)}</article></body>")
    assert [len(x) for x in two.split("\n")] == [12 * 35 - 1, 24 * 35 - 1]
    beside = html_text.main_text(f"<body><article>{prose(12)}</article><div>{prose(60)}{prose(58)}</div></body>")
    assert [len(x) for x in beside.split("\n")] == [12 * 35 - 1, 60 * 35 - 1, 58 * 35 - 1]
    listed = html_text.main_text(f"<body><article><h1>T</h1>{prose(9)}<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></article></body>")
    assert listed.split("\n")[0] == "T" and listed.split("\n")[-3:] == ["one", "two", "three"]


def test_very_long_pages(spark):
    page = "<body><article>" + "<p>Long, very long. </p>" * 60_000 + "</article></body>"
    rows = spark.createDataFrame([(1, "u", page, "x", 1), (1, "u", page, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = [(r["page_id"], r["n_chars"]) for r in html_text.extract(rows).collect()]
    assert got == [(1, 60_000 * 17 - 1)] * 2
