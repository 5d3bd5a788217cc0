import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.operators import aggregate, changes, chunk, edition, embed, quality, reconcile, search, views
from lexloom.operators.order import monotone_rows


# --- chunks -------------------------------------------------------------------


def packed(spark, prefix, clauses):
    df = spark.createDataFrame([(prefix, clauses)], "p string, c array<string>")
    return df.select(chunk.pack(chunk.units_of(F.col("p"), F.col("c"))).alias("out")).first().out


def sentence(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n)) + "."


def test_chunks_stay_in_band_and_lose_nothing(spark):
    clauses = [sentence(30, f"c{i}x") for i in range(10)]
    out = packed(spark, "Title", clauses)
    counts = [len(c.split()) for c in out]
    assert all(120 <= n <= 180 for n in counts[:-1]) and counts[-1] <= 180
    assert " ".join(out).split() == " ".join(["Title", *clauses]).split()


def test_one_long_clause_falls_back_to_sentences(spark):
    text = " ".join(sentence(20, f"s{i}x") for i in range(20))
    out = packed(spark, "", [text])
    assert all(len(c.split()) <= 180 for c in out) and all(c.endswith(".") for c in out)
    assert " ".join(out).split() == text.split()


def test_small_buffer_absorbs_pieces_of_the_next_unit(spark):
    out = packed(spark, "Short title", [sentence(50, "a") + " " + sentence(60, "b") + " " + sentence(70, "c")])
    assert out[0].startswith("Short title a0") and out[0].endswith("b59.")
    assert out[1].startswith("c0")


def test_no_text_no_chunk(spark):
    assert packed(spark, "", []) == []
    assert packed(spark, "", [" "]) == []


def test_a_sentence_over_the_cap_stays_whole(spark):
    assert [len(c.split()) for c in packed(spark, "", [sentence(200)])] == [200]


# --- reconciliation -----------------------------------------------------------


def table_lcs(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_alignment_equals_the_full_table_at_any_memory_bound():
    random.seed(1)
    for _ in range(200):
        a = [random.choice("abcde") for _ in range(random.randint(0, 40))]
        b = [random.choice("abcde") for _ in range(random.randint(0, 40))]
        for budget in (10**6, 100, 1):
            assert reconcile.common_subsequence(a, b, budget) == table_lcs(a, b)


FUSIONS = [
    ("नाव पानी में", "नाव पानी में", "नाव पानी में", 0),
    ("", "", "", 0),
    ("घाट पर", "", "घाट पर", 2),
    ("कािठन काम", "काठिन काम", "काठिन काम", 1),
    ("बड़ी 2[नदी किनारे", "बड़ी [नदी किनारे", "बड़ी [नदी किनारे", 0),
    ("वन में | फल", "वन में। फल", "वन में। फल", 0),
    ("एक दो तीन", "एक तीन", "एक दो तीन", 1),
    ("एक तीन", "एक प�ड़ तीन", "एक तीन", 1),
    ("पेड़ों की छाया", "पे�� की छाया", "पेड़ों की छाया", 2),
    ("पहली\nदूसरी पंक्ति", "पहली\nदूसरी प�क्ति", "पहली\nदूसरी पंक्ति", 1),
    ("एक तीन", "एक दो तीन", "एक दो तीन", 1),
]


def test_fusion_picks_sides_and_flags(spark):
    df = spark.createDataFrame([(i, o, l) for i, (o, l, _, _) in enumerate(FUSIONS)], "i int, ocr string, layer string")
    got = reconcile.fuse(df, "ocr", "layer").orderBy("i").collect()
    assert [(r.text, len(r.flags)) for r in got] == [(t, n) for _, _, t, n in FUSIONS]


def test_fusion_quality_counts(spark):
    df = spark.createDataFrame([(o, l) for o, l, _, _ in FUSIONS], "ocr string, layer string")
    row = reconcile.fusion_quality(reconcile.fuse(df, "ocr", "layer")).first()
    assert (row.pages, row.flags, row.one_sided, row.unresolved) == (11, 9, 7, 0)


# --- search -------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(1, "rights of the child"), (2, "child labour and child rights"), (3, "union list"), (4, "what the union is")]
    return spark.createDataFrame(docs, "id long, text string")


def test_search_needs_all_words_and_ranks_by_bm25(corpus):
    hits = search.keyword_search(corpus, "id", "text", {1: "child rights", 2: "Union", 3: "nothing here"}).orderBy("qid", "rank")
    assert [(r.qid, r.id, r.total_hits) for r in hits.collect()] == [(1, 2, 2), (1, 1, 2), (2, 3, 2), (2, 4, 2)]


def test_stop_words_are_dropped_only_without_hits(corpus):
    asked = {1: "what is the child", 2: "what the union is"}
    hits = search.keyword_search(corpus, "id", "text", asked, retry=True).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, r.refined) for r in hits] == [(1, 2, True), (1, 1, True), (2, 4, False)]
    assert search.refine("what is the") == "what is the"


def test_limit_shows_the_first_and_counts_all(spark):
    docs = spark.range(40).select(F.col("id"), F.lit("same words").alias("text"))
    hits = search.keyword_search(docs, "id", "text", {1: "words"}, k=12).collect()
    assert sorted(r.id for r in hits) == list(range(12)) and {r.total_hits for r in hits} == {40}


def test_vector_search_in_blocks_equals_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 4)).round(1)
    data[50:] = data[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(60, None), (61, [0.0] * 4), (62, [1.0, float("nan"), 0.0, 0.0]), (63, []), (64, [1.0, 2.0]), (65, [1.0, None, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows + odd, "id long, v array<float>").repartition(3)
    asked = vectors.filter("id % 3 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    monkeypatch.setattr(search, "VECTOR_ROWS", 7)
    monkeypatch.setattr(search, "QUERY_ROWS", 4)
    got = search.vector_search(vectors, "id", "v", asked, "qid", "qv", cutoff=0.2, k=5).collect()
    units = data.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    cosines = np.round(units @ units.T, 6)
    want = {}
    for q in range(0, 60, 3):
        order = sorted((i for i in range(60) if cosines[q, i] >= 0.2), key=lambda i: (-cosines[q, i], i))
        want |= {(q, rank): i for rank, i in enumerate(order[:5], 1)}
    assert {(r.qid, r["rank"]): r.id for r in got} == want


def test_hybrid_shows_each_item_once(spark):
    by_word = spark.createDataFrame([(1, 10, "a", 4.0), (1, 11, "a", 2.0), (1, 12, "b", 2.0)], "qid int, id int, item string, score double")
    by_meaning = spark.createDataFrame([(1, 11, "a", 0.9), (1, 13, "c", 0.5)], "qid int, id int, item string, score double")
    rows = search.hybrid_search(by_word, by_meaning, "id", "item").orderBy("rank").collect()
    assert [(r.item, r.id, r.score) for r in rows] == [("a", 10, 0.5), ("b", 12, 0.0), ("c", 13, 0.0)]


def test_quantization_rounds_halves_up_and_restores(spark):
    df = spark.createDataFrame([(1, [1.27, -0.005, 0.005, -1.27, 0.0])], "id int, v array<double>")
    row = search.quantize(df, "v").withColumn("back", search.dequantize(F.col("codes"), F.col("scale"))).first()
    assert list(row.codes) == [127, 0, 1, -127, 0]
    assert abs(row.back[0] - 1.27) < 1e-6


def test_embeddings_are_unit_and_pluggable(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "")], "id int, text string")
    v = {r.id: r.v for r in docs.select("id", embed.hashed_embedding(F.col("text"), 16).alias("v")).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and set(v[3]) == {0.0}

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = {r.id: r.vector for r in embed.embed(docs, "id", "text", load).collect()}
    assert abs(out[1][0] - 10 / 101**0.5) < 1e-6 and out[3] == [0.0, 1.0]


# --- editions and picks -------------------------------------------------------


def test_positional_zip_can_refuse_to_guess(spark):
    a, b = spark.createDataFrame([(1,), (5,)], "x long"), spark.createDataFrame([(2,), (9,), (11,)], "y long")
    assert edition.positional_zip(a, "x", b, "y").count() == 3
    with pytest.raises(PySparkException, match="lists disagree at position 3"):
        edition.positional_zip(a, "x", b, "y", agree=F.lit(True)).collect()


def test_crosscheck_flags_low_overlap(spark):
    a = spark.createDataFrame([("1", "the same words"), ("2", "totally different"), ("3", "only here"), ("4", "1[(a)]")], "n string, t string")
    b = spark.createDataFrame([("1", "the 2[same] words."), ("2", "nothing alike"), ("9", "elsewhere"), ("4", "x y")], "n string, u string")
    rows = {r.n: r for r in edition.crosscheck(a, b, "n", "t", "u", fv.SIMILARITY_THRESHOLD).collect()}
    assert (rows["1"].similarity, rows["1"].flagged) == (1.0, False)
    assert (rows["2"].similarity, rows["2"].flagged) == (0.0, True)
    assert rows["4"].similarity == 0.0
    assert (rows["3"].presence, rows["9"].presence) == ("left only", "right only")


def test_gated_synthesis(spark):
    have, ref = spark.createDataFrame([("1", "x")], "n string, t string"), spark.createDataFrame([("1",), ("238",)], "n string")
    filled = edition.synthesize_missing(have, ref, "n", {"t": F.lit("[Omitted.]")})
    assert sorted(r.n for r in filled.collect()) == ["1", "238"]
    assert edition.synthesize_missing(have, ref, "n", {"t": F.lit("")}, F.lit(False)).count() == 1


def test_reference_links(spark):
    rows = [("article", "21A", None), ("part", "4A", None), ("amendment", "42", None), ("page", "/preamble/", "Preamble"), ("page", "/x/", None)]
    df = spark.createDataFrame(rows, "k string, v string, l string")
    got = [r.o for r in df.select(edition.item_link(F.col("k"), F.col("v"), F.col("l")).alias("o")).collect()]
    assert [(g.href, g.label) if g else None for g in got] == [
        ("/articles/21a/", "Article 21A"), ("/parts/4a/", "Part IVA"), ("/amendments/42/", "42nd Amendment"), ("/preamble/", "Preamble"), None,
    ]


def test_equal_counts_go_to_the_first_seen(spark):
    df = spark.createDataFrame([("k", 1976, 3), ("k", 1951, 1), ("k", 1976, 4), ("k", 1951, 9)], "k string, y int, pos int")
    assert aggregate.most_frequent(df, ["k"], "y", "pos").first().y == 1951


def test_longest_text_earliest_of_equals(spark):
    df = spark.createDataFrame([("k", 2, "bbb"), ("k", 1, "aaa"), ("k", 3, "c")], "k string, pos int, t string")
    assert aggregate.longest_per_key(df, ["k"], "t", "pos").first().t == "aaa"


def test_running_maximum_equals_the_cursor_walk(spark):
    random.seed(2)
    docs = [(d, i, f"{random.randint(1, 30)}{random.choice(['', 'A', 'AA', 'B'])}") for d in range(20) for i in range(60)]

    def key(n):
        digits = n.rstrip("AB")
        return int(digits), n[len(digits) :]

    want = set()
    for d in range(20):
        cursor = (0, "")
        for _, i, n in (r for r in docs if r[0] == d):
            if key(n) > cursor:
                cursor = key(n)
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc int, line int, n string")
    assert {(r.doc, r.line) for r in monotone_rows(df, "doc", "line", "n").collect()} == want


def test_timeline_stacks_inside_a_year(spark):
    rows = spark.createDataFrame([(i, 1951 + i // 2) for i in range(106)], "number int, year int")
    placed = views.timeline(rows, "number", "year").orderBy("number").collect()
    assert placed[0].x == 24.0 and placed[-1].x == 976.0
    assert (placed[0].y, placed[1].y) == (292, 278)
    ticks = [r.year for r in views.timeline_ticks(rows, "year").orderBy("year").collect()]
    assert ticks == [1960, 1970, 1980, 1990, 2000]


# --- quality and changes ------------------------------------------------------

ITEM = "number string, part string, title string, clauses array<struct<number:string,text:string,kind:string>>, status string, amended_by array<string>"


def test_item_schema_names_every_broken_field(spark):
    good = ("21A", "3", "Education.", [("1", "text", None)], "in-force", None)
    bad = ("x1", "33AB", "", [(None, "", "verse")], "gone", None)
    empty = ("1", "1", "t", [], "omitted", [])
    df = quality.with_item_defaults(spark.createDataFrame([good, bad, empty], ITEM))
    found = {(r.number, r.field) for r in quality.schema_errors(df, ["number"], quality.item_rules()).collect()}
    assert found == {
        ("x1", "number"), ("x1", "part"), ("x1", "title"), ("x1", "clauses.text"), ("x1", "clauses.kind"), ("x1", "status"), ("1", "clauses"),
    }


def test_amendment_and_bill_schemas(spark):
    fields = "number int, year int, title string, introduced_in string, passed_lok_sabha string, passed_rajya_sabha string, assent string, in_force string, theme string, articles_affected array<string>"
    rows = [(106, 2023, "t", "2023-09-19", None, None, None, None, None, None), (0, 1949, "", "19-09-2023", None, None, None, None, "odd", None)]
    df = quality.with_amendment_defaults(spark.createDataFrame(rows, fields))
    found = {(r.number, r.field) for r in quality.schema_errors(df, ["number"], quality.amendment_rules(2026)).collect()}
    assert found == {(0, "number"), (0, "year"), (0, "title"), (0, "introduced_in"), (0, "theme")}
    bills = spark.createDataFrame(
        [("a", "both", "pending", None, "2026-01-01", "https://x.org/1"), ("b", "lords", "stuck", "soon", None, "no url")],
        "title string, house string, status string, introduced_on string, last_verified string, source_url string",
    )
    broken = {r.field for r in quality.schema_errors(bills, ["title"], quality.bill_rules()).collect()}
    assert broken == {"house", "status", "introduced_on", "last_verified", "source_url"}


def test_curated_list_and_count_band(spark):
    rows = [("equality-1", "t", "s", [("article", "14", None)]), ("Bad Id", "t", "s", [("verse", "", None)])]
    df = spark.createDataFrame(rows, "id string, title string, summary string, refs array<struct<type:string,value:string,label:string>>")
    assert {r.field for r in quality.schema_errors(df, ["id"], quality.essential_rules()).collect()} == {"id", "refs.type", "refs.value"}
    assert quality.count_band(df, 8, 12, "entries").first().detail == "2 entries, must be 8 to 12"
    assert quality.count_band(df, 1, 2, "entries").count() == 0


def test_gate_lists_problems_and_passes_clean_tables(spark):
    errors = spark.createDataFrame([("14", "title", "must not be empty")], "number string, field string, message string")
    with pytest.raises(ValueError, match="1 problem.*\n14: title: must not be empty"):
        quality.require_clean(errors, "sync")
    quality.require_clean(errors.filter("false"), "sync")


def test_page_states(spark):
    current = spark.createDataFrame([("a", "same"), ("b", "moved"), ("c", None), ("d", "first"), ("e", None)], "url string, body string")
    previous = spark.createDataFrame([("a", "same"), ("b", "before"), ("c", "kept"), ("z", "gone")], "url string, body string").select(
        "url", F.sha2("body", 256).alias("hash")
    )
    rows = {r.url: r for r in changes.page_states(current, previous).collect()}
    assert {u: r.state for u, r in rows.items()} == {"a": "same", "b": "changed", "c": "unreachable", "d": "new", "e": "unreachable", "z": "dropped"}
    kept = {r.url: r.hash for r in previous.collect()}
    assert rows["c"].hash == kept["c"] and rows["e"].hash is None


def test_index_and_count_flags(spark):
    html = '<a href="https://x/a.pdf">a</a><a href="https://x/new.pdf">n</a>'
    index = spark.createDataFrame([("i", html), ("j", None)], "url string, html string")
    known, seen = spark.createDataFrame([("https://x/a.pdf",)], "link string"), spark.createDataFrame([], "link string")
    flags = {(r.kind, r.key) for r in changes.index_flags(index, known, seen).collect()}
    assert flags == {("index-page-unreachable", "j"), ("new-edition", "https://x/new.pdf")}
    leads = spark.createDataFrame([("up", "been 107 amendments"), ("even", "106 amendments"), ("down", "9 amendments"), ("odd", "many")], "k string, lead string")
    counts = {(r.kind, r.key) for r in changes.count_flags(leads, "k", "lead", F.lit(106)).collect()}
    assert counts == {("count-moved", "up"), ("count-unknown", "odd")}


def test_links_seen_survive_an_unreachable_index(spark):
    index = spark.createDataFrame([("j", None)], "url string, html string")
    seen = spark.createDataFrame([("https://x/a.pdf",)], "link string")
    assert [r.link for r in changes.next_links(index, seen).collect()] == ["https://x/a.pdf"]


def test_report_names_every_flag(spark):
    flags = spark.createDataFrame([("new-edition", "k", "https://x/new.pdf")], "kind string, key string, detail string")
    lines = [r.line for r in changes.report_lines(flags, "2031-02-03", first_run=True).orderBy("section", "line").collect()]
    assert lines == [
        "# Source check report",
        "",
        "Checked: 2031-02-03",
        "",
        changes.REPORT_NOTE,
        "",
        changes.REPORT_FIRST,
        "",
        "## Changes detected",
        "",
        "- **new-edition**: https://x/new.pdf",
        "",
        changes.REPORT_ASKS,
    ]
    nothing = [r.line for r in changes.report_lines(flags.filter("false"), "2031-02-03").orderBy("section", "line").collect()]
    assert nothing == [*lines[:6], changes.REPORT_SOUND]


def test_arrow_batches_of_texts_are_bounded(spark):
    from lexloom.operators import embed, reconcile

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b", "a c")], "doc_id long, ocr string, layer string")
    for build in (lambda: reconcile.fuse(docs, "ocr", "layer"), lambda: docs.select(embed.hashed_embedding(F.col("ocr")))):
        spark.conf.unset(setting)
        build()
        assert int(spark.conf.get(setting)) <= 8 << 20


def test_a_batch_of_noisy_texts_is_worked_off_in_slices():
    import pyarrow as pa

    from lexloom.operators import reconcile

    texts = ["x" * n for n in (10, 0, 500, 3000, 20, 30)] + [None]
    batch = pa.RecordBatch.from_pydict({"ocr": texts, "layer": texts})
    parts = list(reconcile.slices(batch, "ocr", "layer", 1000))
    assert pa.Table.from_batches(parts).column("ocr").to_pylist() == texts
    assert len(parts) > 2 and all(p.num_rows for p in parts)
    assert list(reconcile.slices(batch.slice(0, 0), "ocr", "layer")) == []
