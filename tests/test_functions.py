from pyspark.sql import functions as F

from lexloom.functions import numbers, prose, script, text, urls


def test_clean_legal_text(one):
    marked = ["Every lake 3[and every RIVER] is", "Wells; [(d) the springs; and] (e)", "Left out.]", "under rule 9.]", "the 1[depth and  width] of a pond"]
    plain = ["Every lake and every RIVER is", "Wells; (d) the springs; and (e)", "Left out.", "under rule 9.", "the depth and width of a pond"]
    assert one(text.clean_legal_text, marked) == plain


def test_first_year(one):
    assert one(text.first_year, ["Moved by a rule of 1963, part 2", "none here", "in 31963 and 2011"]) == ["1963", None, "2011"]


def test_roman_labels_both_ways(one):
    labels = ["2", "5", "7B", "10", "16A", "24", "38", "40", "99B", "444", "1666", "3999A"]
    roman = ["II", "V", "VIIB", "X", "XVIA", "XXIV", "XXXVIII", "XL", "XCIXB", "CDXLIV", "MDCLXVI", "MMMCMXCIXA"]
    assert one(numbers.roman_label, labels) == roman
    assert one(numbers.roman_number, roman) == labels
    assert one(numbers.roman_number, ["Q", "", "IIII", "VX", "XXXX"]) == [None] * 5


def test_ordinals_round_trip(spark):
    """All up to 1,000 and a part of the rest up to the limit."""
    ids = spark.range(1, 1001).union(spark.range(1001, 1_000_000, 977)).union(spark.createDataFrame([(999_999,), (500_000,)], "id long"))
    df = ids.select(F.col("id").cast("int").alias("n"), numbers.ordinal_words(F.col("id")).alias("w"))
    back = df.withColumn("b", numbers.ordinal_number(F.col("w")))
    assert back.filter("b IS NULL OR b <> n").count() == 0
    named = {r.n: r.w for r in df.filter("n IN (3, 57, 300, 208, 715, 640, 1000, 500000)").collect()}
    assert named == {
        3: "Third",
        57: "Fifty-seventh",
        300: "Three hundredth",
        208: "Two hundred and eighth",
        715: "Seven hundred and fifteenth",
        640: "Six hundred and fortieth",
        1000: "One thousandth",
        500000: "Five hundred thousandth",
    }
    assert spark.range(1).select(numbers.ordinal_words(F.lit(1_000_000)), numbers.ordinal_words(F.lit(0))).first() == (None, None)


def test_ordinal_words_in_other_spellings(one):
    words = ["sixty third", "SIXTYTHIRD", "the hundredth", "two thousand three hundred and first", "gibberish", "", "sixty-x"]
    assert one(numbers.ordinal_number, words) == [63, 63, 100, 2301, None, None, None]


def test_amendment_ids(one):
    got = one(numbers.amendment_id, [1, 2, 3, 5, 11, 12, 13, 22, 53, 100, 113], "int")
    assert [g.split("-")[0] for g in got] == ["1st", "2nd", "3rd", "5th", "11th", "12th", "13th", "22nd", "53rd", "100th", "113th"]


def test_citations_stay_in_range(one):
    line = "the Constitution (Sixty-first Amendment) Act, 1988 and the Constitution (Two thousandth Amendment) Act"
    assert one(numbers.citations, [line, "none"]) == [[61, 2000], []]
    assert one(lambda c: numbers.citations(c, most=200), [line, "none"]) == [[61], []]


def test_theme_rules(one):
    themes = one(numbers.theme, [["356", "14"], ["14"], ["243ZA"], ["60"], ["1"], []], "array<string>")
    assert themes == ["emergency", "rights", "social", "federal", "general", "general"]


def test_visible_text_ignores_script_noise(one):
    body = "<p>The ferry leaves at noon.</p>"
    pages = [f"<html><style>p{{margin:{n}px}}</style><script>var seed={n}</script><!-- run {n} -->{body}</html>" for n in (4, 71)]
    assert one(text.visible_text, pages) == ["The ferry leaves at noon."] * 2


def test_page_links_in_order_without_repeats(one):
    html = '<a href="/maps/z.PDF">z</a><a href="maps/a.pdf#p2">a</a><a href="/maps/">all</a><a href="/maps/z.PDF">z</a><img src="x.pdf">'
    assert one(text.page_links, [html]) == [["/maps/z.PDF", "maps/a.pdf#p2"]]
    assert one(lambda c: text.page_links(c, None), [html]) == [["/maps/z.PDF", "maps/a.pdf#p2", "/maps/"]]


def test_phrase_number(one):
    assert one(text.phrase_number, ["so far 31 amendments were made", "its 1 amendment", "amendments, many", None]) == [31, 1, None, None]


def test_lede_band(one):
    long = " ".join(f"word{i:02d}" for i in range(58)) + ". Tail of more words that go on and on and on."
    short = "Only a few words here"
    no_stop = " ".join(f"w{i}" for i in range(90))
    got = one(text.trim_to_band, [long, short, no_stop])
    assert got[0].endswith("word57.") and len(got[0].split()) == 58
    assert got[1] == short
    assert len(got[2].split()) == 60 and got[2].endswith("w59.")


def test_clamped_titles(one):
    site = " | Codex"
    got = one(lambda c: text.clamp_title(c, site), ["short | Codex", "x" * 70 + site, "y" * 70])
    assert got[0] == "short | Codex"
    assert len(got[1]) == 60 and got[1].endswith("… | Codex")
    assert got[2] == "y" * 57 + "…"


def test_tokens_glue_punctuation_across_lines(one):
    got = one(text.page_tokens, ["हैं | और\n, x", "| a"])
    assert [(t.line, t.word) for t in got[0]] == [(0, "हैं|"), (0, "और,"), (1, "x")]
    assert [t.word for t in got[1]] == ["|", "a"]


def test_heading_title_and_body(one):
    def both(c):
        title, body = text.heading_title_body(c)
        return F.concat_ws("#", title, body)

    assert one(both, ["घाट,--नाव की जगह", "घाट - नाव", "बिना पाठ-"]) == ["घाट#नाव की जगह", "घाट#नाव", "बिना पाठ#"]


def test_refused_urls(one):
    refused = [
        "http://localhost/x", "https://api.localhost/x", "https://localhost:8080/x", "http://127.9.9.9/x",
        "http://10.255.255.255/x", "http://172.16.0.1/x", "http://172.31.255.255/x", "http://192.168.1.1/x",
        "http://169.254.1.1/", "http://100.64.0.1/", "http://0.0.0.0/", "http://[::1]/", "http://[::]/",
        "http://[::ffff:10.0.0.1]/", "http://[::ffff:7f00:1]/", "http://[fe80::1]/", "http://[fd00::1]/",
    ]
    safe = [
        "https://github.com/a/b", "http://example.com/file.bin", "https://8.8.8.8/f", "https://172.32.0.1/f",
        "https://[2606:4700::6810:85e5]/file", "http://100.128.0.1/",
    ]
    assert all(r.startswith("refused") for r in one(urls.refusal, refused))
    assert one(urls.refusal, safe) == [None] * len(safe)
    schemes = one(urls.refusal, ["file:///etc/passwd", "ftp://example.com/f", "data:text/plain,hi"])
    assert all(r.startswith("scheme not allowed") for r in schemes)
    assert one(urls.refusal, ["not a url"]) == ["not a valid URL"]


CLEAN = "नदी के किनारे पेड़ों की छाया में बच्चे खेलते, गाते और कहानियां सुनते हैं।"


def test_script_issues(one):
    texts = [CLEAN, "प्रकृति में ऋतु बदलती है", "बड़ी सड़क", "पेड", "x | y", "कािठन", "ि पेड़", "प�ड़ो�", "80\ue0f2.", "पानी |", "फल| और", "वन‌ में"]
    got = [[i.rule for i in row] for row in one(script.issues, texts)]
    assert got[:5] == [[], [], [], [], []]
    assert got[5:] == [["sign-after-sign"], ["sign-at-start"], ["replacement", "replacement"], ["private-use"],
                       ["pipe-danda"], ["pipe-danda"], ["zwnj"]]
    assert one(script.issue_count, texts) == [len(g) for g in got]
    assert one(script.issues, ["पानी�ड़"])[0][0]["index"] == 4


def test_latin_before_a_sign_counts_as_word_start(one):
    assert [i.rule for i in one(script.issues, ["abि"])[0]] == ["sign-at-start"]


def test_repair(one):
    damaged = ["कािठन", "िदन", "पेड और कािठन", "पेड़ ि", "फल है | और", "वन‌ में", CLEAN]
    assert one(script.repair, damaged) == ["काठिन", "दिन", "पेड और काठिन", "पेड़ ि", "फल है । और", "वन में", CLEAN]


def test_inline_clauses(one):
    got = one(
        script.inline_clauses,
        [
            "नदी सब की है । (2) कोई उसे बांध नहीं सकता ।",
            "(5) जहां नियम (1) से पानी बंटता है ।",
            "इन घाटों पर,- (क) नाव; (ख) जाल; और (ग) अन्य साधन ।",
            "पहली बात । (2क) किनारे का कर । (2ख) पुल का कर ।",
            'मूल नियम । स्पष्टीकरण-इस नियम में "घाट" का अर्थ है-',
            "झील सब की है । [(2) कुआं भी ।] (3) तालाब भी,-",
            "() (1) हर साल । (2) दूसरी बात ।",
            "",
        ],
    )
    assert [[c.number for c in row] for row in got] == [
        [None, "2"], ["5"], [None, "क", "ख", "ग"], [None, "2क", "2ख"], [None, None], [None, "2", "3"], ["1", "2"], [],
    ]
    assert got[4][1].kind == "explanation"


def test_hindi_headings(one):
    lines = ["7. घाट-नाव बांधने की जगह", "[48ग. झील की सफाई", "बहती 6. नदी का पानी", "1. 1958 के अधिनियम से", "(ख) दूसरा", "980. बहुत दूर"]
    got = one(script.heading, lines)
    assert [(h.number_hi, h.latin, h.prefix) if h else None for h in got] == [
        ("7", "7", ""), ("48ग", "48C", ""), ("6", "6", "बहती "), None, None, ("980", "980", ""),
    ]


def test_suffixes_and_candidates(one):
    assert one(script.latin_number, ["7ख", "48घ", "112यग", "33", "6ह"]) == ["7B", "48D", "112ZC", "33", None]
    assert one(script.number_candidates, ["2112यझ", "33"]) == [["2112यझ", "112यझ", "12यझ", "2112यज"], ["33"]]


def test_line_kinds(one):
    lines = ["भारत का संविधान 88", "THE CONSTITUTION OF INDIA", "312", "(भाग 2-घाट) 9", "4. राजपत्र, 1958 से", "6. नदी का पानी"]
    assert one(script.line_kind, lines) == ["furniture"] * 4 + ["footnote", "body"]


def test_prose_lint(one):
    plain = "A boy ran to the big red barn. " * 8
    bad = "Moreover, we delve into lakes — soon. " * 3
    rules = [[i.rule for i in row] for row in one(prose.lint, [plain, bad, ""])]
    assert rules[0] == ["reading-level"]
    assert rules[1][:4] == ["length", "banned-phrase", "banned-phrase", "dash"]
    assert rules[2] == ["length"]
    assert one(prose.lint_short, ["A boy ran to the barn and slept in the hay."])[0][0].rule == "length"


def test_hindi_lint(one):
    good = " ".join(["हर गांव में पानी साफ और मीठा मिलना चाहिए।"] * 5)
    rules = [[i.rule for i in row] for row in one(prose.lint_hindi, [good, "only latin words", good + " आइए -- कािठन"])]
    assert rules == [[], ["length", "language"], ["banned-phrase", "dash", "devanagari"]]


def test_syllables(one):
    assert one(prose.syllables, ["she", "lakes", "harbour", "rowing", "harmony"]) == [1, 1, 2, 2, 3]


def test_word_edges_read_ascii_letters_only(one):
    assert one(text.is_footnote_line, ["12. Über üsch. und", "12. Über usch. und"]) == [True, False]
    assert one(text.first_year, ["ü1978 x", "u1978 x"]) == ["1978", None]


def test_tokens_and_issues_of_a_long_text_take_time_in_proportion(one):
    """A copy of the whole text per word or issue made this a matter of many minutes."""
    import time

    started = time.time()
    words = 60_000
    got = one(text.page_tokens, ["ab | cd\n" * (words // 2)])[0]
    assert len(got) == words and got[-1]["line"] == words // 2 - 1 and got[-2]["word"] == "ab|"
    line = "कीी पानी\ufffdड़ abि | गa\n"
    n = 8_000
    found = one(script.issues, [line * n])[0]
    alone = one(script.issues, [line + line + line])[0]
    per_line = len(alone) // 3
    assert len(found) == n * per_line
    middle = alone[per_line : 2 * per_line]
    far = found[(n - 2) * per_line : (n - 1) * per_line]
    assert [(f["rule"], f["excerpt"], f["index"] - (n - 3) * len(line)) for f in far] == [(m["rule"], m["excerpt"], m["index"]) for m in middle]
    assert time.time() - started < 60
