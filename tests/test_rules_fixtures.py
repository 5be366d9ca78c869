"""Hand-written cases for rules whose SQL twin could repeat a mistake."""

from pyspark.sql import functions as F

from quire.operators import checking as C
from quire.operators import detection as D
from quire.operators import evidence as E
from quire.operators import limits as L
from quire.sources import files


def test_outcome_focus_goes_by_number(spark):
    texts = [9, 8, 7, 6, 1, 2]
    s = spark.createDataFrame([(1, i, f"Outcome {n}", "x") for i, n in enumerate(texts)], "doc_id long, section_no int, heading string, text string")
    got = D.focus_sections(s, D.detect_outcomes(s, "doc_id"), "doc_id").orderBy("place").collect()
    assert [r.section_no for r in got] == [4, 5, 3, 2]


def test_cap_marks_exactly_so_many_of_a_tie(spark):
    df = spark.createDataFrame([("g", 1, i) for i in range(10)], "g string, o int, id int")
    got = {r.id: r.checked for r in D.cap_entities(df, ["g"], F.col("o"), 3).collect()}
    assert [i for i in got if got[i]] == [0, 1, 2]


def test_quotes_in_other_alphabets_are_shown(spark):
    s = spark.createDataFrame([(1, 0, "So: Η ΟΔΟΣ ΜΑΣ, “it’s” a—B… end")], "doc_id long, section_no int, text string")
    q = spark.createDataFrame([(1, "Η ΟΔΟΣ ΜΑΣ"), (2, "\"it's\" a-b... end"), (3, "not in it at all"), (4, "So: … a—b")], "quote_id long, quote string")
    shown = E.show_quotes(E.verify_quotes(s, "doc_id", "section_no", q, "quote_id"), s, "doc_id", "section_no")
    assert {r.quote_id: r.shown for r in shown.collect()} == {1: "Η ΟΔΟΣ ΜΑΣ", 2: "it’s” a—B … end", 4: "So … a—B"}
    lists = E.quote_lists(q.withColumn("l", F.lit(1)), shown.select("quote_id", "shown"), "l", "quote_id").first()
    assert (lists.kept, lists.dropped) == (3, 1)


def test_the_first_answer_to_a_condition_counts(spark):
    def item(answers):
        c = ",".join(f'{{"n":{n},"answer":"{a}","quote":""}}' for n, a in answers)
        return f'{{"items":[{{"id":"a","status":"met","finding":"f","evidence":[],"conditions":[{c}]}}]}}'
    df = spark.createDataFrame([(1, item([(1, "maybe"), (1, "yes"), (2, "no")])), (2, item([(1, "yes"), (2, "no"), (2, "maybe")]))], "batch int, reply string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a")], "batch int, id string")
    assert {r.batch: r.problem == "" for r in C.validate_items(df, wanted, "batch", 2).collect()} == {1: False, 2: True}


def test_actions_of_all_sources_that_are_not_met(spark):
    links = spark.createDataFrame([("i", f"s{k}", k) for k in range(8)], "item string, source string, place int")
    results = spark.createDataFrame([(f"s{k}", "missing", f"g{k}", f"a{k}") for k in range(8)], "source string, status string, gap string, action string")
    got = C.derived_items(links, "item", results, "source", "place").first()
    assert got.gaps == "; ".join(f"g{k}" for k in range(6)) and got.actions == " ".join(f"a{k}" for k in range(8))


def test_fields_come_from_the_rubric(spark):
    entities = spark.createDataFrame([(1, 10, "S")], "doc int, entity int, label string")
    cells = spark.createDataFrame([(10, 8, "met")], "entity int, field int, status string")
    got = {r.field: r.status for r in C.field_coverage(cells, "doc", entities, [1, 8]).collect()}
    assert got[8] == "met" and set(got) == {1, 8}


def test_carriage_returns_in_frames(spark):
    text = "data: a\r\ndata: b\r\n\r\ndata: c\r\n\r\n"
    for size in (1, 2, 3, 5, 100):
        rows = [(1, at, text[i:i + size]) for at, i in enumerate(range(0, len(text), size))]
        got = L.event_frames(spark.createDataFrame(rows, "r int, at long, body string"), "r").orderBy("frame_no").collect()
        assert [r.data for r in got] == ["a\nb", "c"], size


def test_a_source_without_front_matter_stays(spark):
    cat = spark.createDataFrame([("a", "A", "k", "t", None, "u", "2026-01-01T00"), ("b", "B", "k", None, None, None, None)], "id string, short string, kind string, title string, publisher string, url string, updated string")
    front = spark.createDataFrame([("a", "x", "p", "y", "z")], "id string, title string, publisher string, url string, updated string")
    assert {r.id: r.publisher for r in files.source_catalogue(cat, front).collect()} == {"a": "p", "b": None}


def test_own_words_where_lower_case_is_longer(spark):
    s = spark.createDataFrame([(1, 0, "  At the  İzmir­li  Ofİs…“Dİ” and ΟΔΟΣ. İ")], "doc_id long, section_no int, text string")
    q = spark.createDataFrame([(1, "İzmirli ofİs"), (2, "the İzmirli … Dİ\" AND οδος")], "quote_id long, quote string")
    shown = E.show_quotes(E.verify_quotes(s, "doc_id", "section_no", q, "quote_id"), s, "doc_id", "section_no")
    assert {r.quote_id: r.shown for r in shown.collect()} == {1: "İzmir­li Ofİs", 2: "the İzmir­li … Dİ” and ΟΔΟΣ"}


def test_quotes_without_an_inner_word(spark):
    s = spark.createDataFrame([(1, 0, "some planning words"), (1, 1, "replanned wording"), (2, 0, "nothing here")], "doc_id long, section_no int, text string")
    q = spark.createDataFrame([(1, "plann"), (2, "planning words"), (3, "absent"), (4, "some planning words")], "quote_id long, quote string")
    found = lambda q: {(r.quote_id, r.doc_id, r.section_no) for r in E.verify_quotes(s, "doc_id", "section_no", q, "quote_id").collect()}
    assert found(q) == {(1, 1, 0), (2, 1, 0), (4, 1, 0)}
    assert found(q.where("quote_id = 4")) == {(4, 1, 0)} and found(q.where("quote_id = 0")) == set()


def test_percentile_of_calls_with_ties_and_nulls(spark):
    import numpy as np
    ms = {"a": [5], "b": [3] * 19 + [9, 100], "c": list(range(1, 42)), "d": [None, 4, None, 8], "e": [None]}
    log = spark.createDataFrame([(f, "c", "m", True, x, 1) for f, all_ in ms.items() for x in all_], "feature string, connection string, model string, ok boolean, ms long, tokensIn int")
    got = {r.feature: r for r in L.usage_rollup(log, F.lit("p")).collect()}
    for f, all_ in ms.items():
        given = [x for x in all_ if x is not None]
        assert got[f].calls == len(all_) == got[f].tokens and got[f].slowest == max(given, default=None)
        assert got[f].p95 == (round(float(np.percentile(given, 95)), 4) if given else None)
