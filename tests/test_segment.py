import pytest
from pyspark.sql import functions as F

from lexloom.operators.segment import segment_statutes
from lexloom.operators.statute_walk import Gate

DASH = "—"
BOUNDARY = f"""continue to be such citizen.
11. Parliament to regulate the right.{DASH}Nothing in
the foregoing provisions shall derogate.

PART III
FUNDAMENTAL RIGHTS
General
12. Definition.{DASH}In this Part, the State includes the Government.
13. Laws inconsistent with
rights.{DASH}(1) All laws in force shall be void.
(2) The State shall not make any law.
(3) In this article,{DASH}
(a) law includes any Ordinance;
1[(4) Nothing in this article shall apply.]
Right to Equality
14. Equality before law.{DASH}The State shall not deny.
15. Prohibition of discrimination.{DASH}(1) The State shall not discriminate.
(2) No citizen shall be subject to any restriction.

1. Ins. by the Constitution (Twenty-fourth Amendment) Act, 1971, s. 2 (w.e.f. 5-11-1971).

6
"""
BARE = f"""173. Qualification.{DASH}A person shall not be qualified unless he{DASH}
(c) possesses such other qualifications.
2. Subs. by the Constitution (Sixteenth Amendment) Act, 1963, s. 4, for cl. (a)
1[174.
Sessions of the State Legislature, prorogation and
dissolution.{DASH}(1) The Governor shall summon the House.
(2) The Governor may dissolve the Assembly.]
175. Right of Governor.{DASH}(1) The Governor may address the Assembly.
"""
VARIANTS = f"""124. Establishment of the Court.{DASH}(1)
There shall be a Supreme Court.
(2) Every Judge 2[on the recommendation] shall hold
1[(2A) The age of a Judge shall be determined.]
(3) A person shall not be qualified.
Explanation I.{DASH}The wearing of kirpans.
Illustration. A case.
"""
FUSED = f"""32. Remedies.{DASH}(1) The right is guaranteed.
132A. [Validity of State laws.].{DASH}Omitted by the Constitution (Forty-third
Amendment) Act, 1977, s. 3 (w.e.f. 13-4-1978).
2[33. Power of Parliament to modify

in their application.{DASH}Parliament may determine.
"""
SCHEDULE = """s. 6 (w.e.f. 31-10-2019).

[Articles 59(3), 65(3), 75(6), 97]
PART A
PROVISIONS AS TO THE PRESIDENT 1***
The emoluments per mensem.
"""
WHOLE = f"""PART I contents
1. Name of the Union.
WE, THE PEOPLE OF INDIA, having resolved
1[to constitute]
1. Subs. by the Constitution (Forty-second Amendment) Act, 1976.

GIVE TO OURSELVES THIS CONSTITUTION.
PART I
THE UNION
1. Name.{DASH}India shall be a Union.
FIRST SCHEDULE
1[The States]
1. Subs. by the Constitution (Seventh Amendment) Act, 1956.

APPENDIX I
2. Not an item.{DASH}ignored
"""


@pytest.fixture(scope="module")
def excerpts(spark):
    texts = {"boundary": BOUNDARY, "bare": BARE, "variants": VARIANTS, "fused": FUSED, "schedule": SCHEDULE}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return segment_statutes(docs, "articles")


@pytest.fixture(scope="module")
def items(excerpts):
    return {(r.doc_id, r.number): r for r in excerpts.items.collect()}


def numbers_of(items, doc):
    return [n for d, n in sorted(items, key=lambda k: items[k].item_no) if d == doc]


def test_items_parts_and_sections(excerpts, items):
    assert numbers_of(items, "boundary") == ["11", "12", "13", "14", "15"]
    assert items["boundary", "14"].title == "Equality before law."
    assert items["boundary", "13"].title == "Laws inconsistent with rights."
    assert items["boundary", "14"].section == "Right to Equality"
    assert items["boundary", "12"].section == "General"
    assert (items["boundary", "11"].part, items["boundary", "12"].part) == ("", "3")
    assert [(p.number, p.name) for p in excerpts.parts.collect()] == [("3", "FUNDAMENTAL RIGHTS")]


def test_marked_clause_and_footnote_link(items):
    a13 = items["boundary", "13"]
    assert [c.number for c in a13.clauses] == ["1", "2", "3", "4"]
    assert a13.clauses[2].text == f"In this article,{DASH} (a) law includes any Ordinance;"
    assert a13.amended_by == ["24th-amendment"]
    # The footnote comes after the item closed, so the status stays.
    assert a13.status == "in-force"


def test_late_footnotes_count_when_status_is_not_frozen(spark):
    docs = spark.createDataFrame([("d", BOUNDARY)], "doc_id string, text string")
    rows = segment_statutes(docs, "articles", status_as_closed=False).items.filter("number = '13'").collect()
    assert rows[0].status == "amended"


def test_bare_number_heading(items):
    assert numbers_of(items, "bare") == ["173", "174", "175"]
    a174 = items["bare", "174"]
    assert a174.title == "Sessions of the State Legislature, prorogation and dissolution."
    assert [c.number for c in a174.clauses] == ["1", "2"]
    assert items["bare", "173"].status == "amended"
    assert items["bare", "173"].amended_by == ["16th-amendment"]


def test_clause_variants(items):
    clauses = items["variants", "124"].clauses
    assert [(c.number, c.kind) for c in clauses] == [
        ("1", "clause"), ("2", "clause"), ("2A", "clause"), ("3", "clause"), (None, "explanation"), (None, "illustration"),
    ]
    assert clauses[0].text == "There shall be a Supreme Court."
    assert clauses[4].text == "The wearing of kirpans."


def test_fused_marker_and_omitted_item(items):
    assert numbers_of(items, "fused") == ["32", "32A", "33"]
    a = items["fused", "32A"]
    assert (a.title, a.status, a.amended_by) == ("Validity of State laws.", "omitted", ["43rd-amendment"])
    assert items["fused", "33"].title == "Power of Parliament to modify in their application."


def test_schedule_anchor(excerpts):
    rows = excerpts.schedules.collect()
    assert [(r.number, r.title) for r in rows] == [(2, "Provisions as to the President and the Governors of States")]
    assert rows[0].text.startswith("PART A\nPROVISIONS")


def test_whole_document_phases(spark):
    st = segment_statutes(spark.createDataFrame([("d", WHOLE)], "doc_id string, text string"))
    assert [(r.number, r.part, r.title) for r in st.items.collect()] == [("1", "1", "Name.")]
    assert [(r.number, r.name) for r in st.parts.collect()] == [("1", "THE UNION")]
    assert st.preambles.first().preamble == (
        "WE, THE PEOPLE OF INDIA, having resolved [to constitute] GIVE TO OURSELVES THIS CONSTITUTION."
    )
    schedule = st.schedules.first()
    assert (schedule.number, schedule.title, schedule.text) == (1, "[The States]", "[The States]")
    assert [(n.marker, n.item_no) for n in st.footnotes.orderBy("note_no").collect()] == [(1, None), (1, None)]


def test_footnote_marker_is_consumed(spark):
    body = f"""1. One.{DASH}text
1[marked]
1. Ins. by the Constitution (First Amendment) Act, 1951.

2. Two.{DASH}text
1. Ins. by the Constitution (Second Amendment) Act, 1952.

"""
    st = segment_statutes(spark.createDataFrame([("d", body)], "doc_id string, text string"), "articles")
    got = {r.number: r.amended_by for r in st.items.collect()}
    # The second footnote finds its marker used up and goes to the open item.
    assert got == {"1": ["1st-amendment"], "2": ["2nd-amendment"]}


def test_partition_count_does_not_matter(spark):
    docs = [(f"{k}-{i}", v) for i in range(20) for k, v in {"a": BOUNDARY, "b": BARE, "c": FUSED, "w": WHOLE}.items()]

    def run(parts):
        df = spark.createDataFrame(docs, "doc_id string, text string").repartition(parts)
        return sorted(map(str, segment_statutes(df, "articles").items.collect()))

    assert run(1) == run(8)


def test_gate_against_a_plain_walk():
    import random

    random.seed(3)
    cases = []
    for _ in range(60):
        events, n = [], 1
        for line in range(30):
            n = max(1, n + random.choice([-2, 0, 1, 1, 2, 50, 400]))
            number = str(n)[:3] + random.choice(["", "", "A"])
            events.append((line, random.choice("HHBBC"), number))
        cases.append(events)

    def value(number):
        return int("".join(ch for ch in number if ch.isdigit()) or 0)

    def plain(events):
        last, is_open, out = 0, False, []
        for line, kind, number in events:
            v, tail = value(number), number[1:]
            if kind == "C":
                is_open = False
                continue
            digits = tail.rstrip("A")
            fused = kind == "H" and last > 0 and v > last + 40 and digits.isdigit() and int(digits) <= last + 40
            fits = is_open and (v > last or (v == last and number.endswith("A"))) and v <= last + 40
            if fused:
                out.append((line, tail, int(number[0])))
                last = int(digits) or last
            elif kind == "H" or fits:
                out.append((line, number, None))
                last = v or last
            else:
                continue
            is_open = True
        return out

    def gated(events):
        gate, out = Gate(), []
        for line, kind, number in events:
            if kind == "C":
                gate.open = False
            elif kind == "H":
                out.append((line, *gate.heading(number)))
            elif gate.continues(number):
                gate.accept(number)
                out.append((line, number, None))
        return out

    assert all(gated(c) == plain(c) for c in cases)


def test_a_schedule_anchor_inside_a_footnote_stays_in_it(spark):
    body = f"""5. Rivers.{DASH}A river is public.
1. Subs. by the Constitution (Third Amendment) Act, 1954, for
[Articles 59(3) and others
THIRTEENTH of its kind

6. Lakes.{DASH}A lake is public.

[Articles 59(3), 65(3)]
Allowances of the keeper
"""
    st = segment_statutes(spark.createDataFrame([("d", body)], "doc_id string, text string"), "articles")
    assert [r.number for r in st.items.orderBy("item_no").collect()] == ["5", "6"]
    note = st.footnotes.first()
    assert (note.line_no, note.last_line, note.item_no) == (1, 3, 1)
    assert [(r.number, r.text) for r in st.schedules.collect()] == [(2, "Allowances of the keeper")]


def test_documents_longer_than_a_batch(spark):
    """Batches of Arrow cut documents anywhere; the walk does not."""
    docs = [(f"d{i}", "\n".join(f"{n}. Item {n}.{DASH}text of {n}" for n in range(1, 300 if i % 3 else 30))) for i in range(12)]
    docs += [("none", None), ("empty", ""), ("blank", " \n\n")]
    df = spark.createDataFrame(docs, "doc_id string, text string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        items = segment_statutes(df, "articles").items.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("item_no").alias("last"))
        got = {r.doc_id: (r.n, r.last) for r in items.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {f"d{i}": (299, 299) if i % 3 else (29, 29) for i in range(12)}


def test_time_follows_the_items(spark):
    """One document of twice the items takes about twice the time: nothing is quadratic in it."""
    import time

    def seconds(count):
        text = "\n".join(f"{n % 900 + 1}. Item.{DASH}(1) words 1[here]\n1. Ins. by the Constitution (First Amendment) Act, 1951.\n" for n in range(count))
        df = spark.createDataFrame([("d", text)], "doc_id string, text string")
        started = time.perf_counter()
        assert segment_statutes(df, "articles").items.count() > count // 2
        return time.perf_counter() - started

    seconds(500)
    assert seconds(16000) < 8 * max(seconds(4000), 0.5)
