import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import evidence as E
from quire.operators import ranking as R
from quire.operators import terms as TM


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_terms_match_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abç") for _ in range(n))
    vocab = sorted({word(rnd.randint(2, 18)) for _ in range(400)} | {"abcabcabcabcabcabc"})
    asked = rnd.sample(vocab, 60) + [word(12), word(16), "abcabcabcabcabcabd"]
    v = spark.createDataFrame([(t,) for t in vocab], "term string")
    q = spark.createDataFrame([(t,) for t in set(asked)], "qterm string")
    near = {(r.qterm, r.term, r.distance) for r in TM.vocabulary_near(q, v).collect()}
    limit = lambda t: min(6, int(len(t) * 0.15 + 0.5))
    want = {(a, b, distance(a, b)) for a in set(asked) for b in vocab if 1 <= distance(a, b) <= limit(a)}
    assert near == want and len(want) > 20
    starts = {(r.qterm, r.term) for r in TM.vocabulary_prefixes(q, v).collect()}
    assert starts == {(a, b) for a in set(asked) for b in vocab if b != a and b.startswith(a)}


def test_contains_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    words = ["the", "plan", "sets", "out", "homes", "planner", "x", "homes."]
    hay = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(80)]
    needles = ["plan", "lan", "sets out", "homes the plan", "out homes", "e p", "nothing here at all", "plan sets out homes", "s. t", "the the the the"]
    h = spark.createDataFrame(list(enumerate(hay)), "k int, body string")
    n = spark.createDataFrame(list(enumerate(needles)), "q int, needle string")
    got = {(r.k, r.q) for r in TM.contains_pairs(h, "k", "body", n, "q", "needle").collect()}
    assert got == {(i, j) for i, b in enumerate(hay) for j, s in enumerate(needles) if s in b}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budget_fill_matches_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(q, i, float(rnd.randint(1, 9)), rnd.choice([1, 5, 9, 30, 60, 61]), rnd.randint(0, 3)) for q in range(6) for i in range(150)]
    required = {(q, i) for q in range(6) for i in rnd.sample(range(150), 2)}
    df = spark.createDataFrame(rows, "q int, p int, score double, size int, locator_size int")
    need = df.join(spark.createDataFrame(list(required), "q int, p int"), ["q", "p"]).drop("score")
    got = {}
    for r in R.budget_retrieve(df, "q", "p", 100, 5, need).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append(r.p)
    for q in range(6):
        mine = {r[1]: r for r in rows if r[0] == q}
        chosen, used = [], 0
        for i in sorted(i for a, i in required if a == q):
            if used + mine[i][3] > 100 and chosen:
                continue
            chosen.append(i)
            used += mine[i][3] + mine[i][4]
        for r in sorted(mine.values(), key=lambda r: (-r[2], r[1])):
            if len(chosen) >= 5:
                break
            if r[1] not in chosen and (q, r[1]) not in required and used + r[3] <= 100:
                chosen.append(r[1])
                used += r[3] + r[4]
        assert got[q] == sorted(chosen)


def test_fit_passages(spark):
    texts = ["a " * 400, "b " * 1500, "c " * 100]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "q int, rank int, text string")
    out = [r.text for r in R.fit_passages(df, "q", 2000).orderBy("place").collect()]
    assert sum(map(len, out)) <= 2000 and out[0] == texts[0] and out[1].endswith("b…") and out[2] == texts[2]
    tight = [r.text for r in R.fit_passages(df, "q", 700).orderBy("place").collect()]
    assert sum(map(len, tight)) <= 700 and len(tight) == 1


def test_quotes(spark):
    sections = [(1, 1, "The Plan\nThe Council will deliver “at least 1,200 homes” by 2040."), (1, 2, "Later, homes come first and\nthen the  roads — always."), (2, 1, "at least 1,200 homes")]
    s = spark.createDataFrame(sections, "doc int, sec int, text string")
    quotes = {1: 'will deliver "at least 1,200 HOMES"', 2: "homes come first and then the roads - always", 3: "will deliver at most 1,200 homes", 4: "Later … roads", 5: "roads … Later", 6: "ho", 7: "1,200 homes."}
    q = spark.createDataFrame(list(quotes.items()), "id int, quote string")
    found = E.show_quotes(E.verify_quotes(s, "doc", "sec", q, "id"), s, "doc", "sec")
    got = {(r.id, r.doc): (r.sec, r.shown) for r in found.collect()}
    assert got == {
        (1, 1): (1, "will deliver “at least 1,200 homes"), (2, 1): (2, "homes come first and then the roads — always"), (4, 1): (2, "Later … roads"),
        (7, 1): (1, "1,200 homes"), (7, 2): (1, "1,200 homes")}
    scope = spark.createDataFrame([(2, 1, 1), (7, 2, 1)], "id int, doc int, sec int")
    assert {(r.id, r.doc) for r in E.verify_quotes(s, "doc", "sec", q, "id", scope=scope).collect()} == {(7, 2)}


def test_anchor_rule_keeps_all_full_matches(spark):
    rnd = random.Random(4)
    rows = [(1, i, float(rnd.randint(1, 50)), rnd.choice([0, 1, 1, 1]), rnd.choice("abcdefgh")) for i in range(120)]
    df = spark.createDataFrame(rows, "q int, p int, score double, tier int, anchor string")
    got = [(r.p, r.anchor) for r in R.unique_anchor(df, "q", "p", ["anchor"], 6).orderBy("rank").collect()]
    order = sorted(rows, key=lambda r: (r[3], -r[2], r[1]))
    listed = [r for n, r in enumerate(order) if r[3] == 0 or n < 18]
    seen, want = set(), []
    for r in listed:
        if r[4] not in seen and len(want) < 6:
            seen.add(r[4])
            want.append((r[1], r[4]))
    assert got == want


def test_merge_takes_turns(spark):
    lists = [(1, 0, 1, 10, 50), (1, 0, 2, 11, 60), (1, 1, 1, 10, 50), (1, 1, 2, 12, 40), (1, 1, 3, 9, 5)]
    df = spark.createDataFrame(lists, "g int, list_no int, rank int, p int, size int")
    assert [r.p for r in R.merge_passages(df, "g", "list_no", "p", 100).orderBy("place").collect()] == [9, 10, 12]
    assert df.select(F.count("*")).first()[0] == 5


def test_scores_are_dealt_by_passage(spark):
    """No exchange by a field, which has three values, or by a term, which may be in every passage."""
    passages = spark.createDataFrame([(i, "plan homes", "head", f"t{i % 3}", "plan homes by the road") for i in range(30)], "p int, text string, heading string, title string, body string")
    asked = spark.createDataFrame([(1, "plan roads"), (2, "homes")], "q int, text string")
    for df in (R.search(passages, "p", asked, "q", expand=False), R.scores(passages, "p", asked, "q")):
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(field#" not in plan and "hashpartitioning(term#" not in plan


def test_many_expansions_give_the_same_scores(spark):
    rnd = random.Random(8)
    words = [a + b for a in "abcdefgh" for b in "xyz"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = spark.createDataFrame([(i, text(20), text(2), "title") for i in range(40)], "p int, text string, heading string, title string")
    expanded = spark.createDataFrame([(w[0], w, 1.0 / (1 + i)) for i, w in enumerate(words[:12])] + [("q", "ax", 0.5)], "qterm string, term string, weight double")
    few, many = ({(r.p, r.qterm): round(r.score, 9) for r in R.field_scores(passages, "p", expanded, m).collect()} for m in (False, True))
    assert few == many and len(few) > 100


def test_terms_are_counted_inside_the_row(spark):
    from collections import Counter

    from quire import fixed

    texts = ["Homes, homes and HOMES by the road; a road", "", "the of", "one", None, "\n\nplan plan\rplan " * 30]
    df = spark.createDataFrame([(i, t, "h", "t") for i, t in enumerate(texts)], "p int, text string, heading string, title string")
    postings = R.field_postings(df, "p")
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    got = {r.p: (dict(zip(r.words.split("\n"), r.tfs)), r.len) for r in postings.where("field = 'text'").collect()}
    split = lambda t: [w for w in re.split(r"[\n\r\s.,;]+", t)]
    want = {i: Counter(w for w in split(t.lower()) if len(w) > 1 and w not in fixed.INDEX_STOP) for i, t in enumerate(texts) if t is not None}
    assert {i: {w: n for w, n in c.items() if w} for i, (c, _) in got.items()} == want
    assert {i: n for i, (_, n) in got.items()} == {i: len(set(split(t))) for i, t in enumerate(texts) if t is not None}
    counts = {r.term: (r.text, r.heading, r.title) for r in R.field_counts(postings).collect()}
    assert counts == {w: (sum(w in c for c in want.values()), 0, 0) for w in set().union(*want.values())}


def test_rare_and_frequent_terms_give_the_same_scores(spark, monkeypatch):
    """Looked up all by broadcast, or rare ones by term: the same sums, and only the passage is dealt again."""
    rnd = random.Random(5)
    words = [a + b for a in "abcdefghij" for b in "xyzw"]
    text = lambda n: " ".join(words[min(int(rnd.expovariate(0.15)), len(words) - 1)] for _ in range(n))
    passages = spark.createDataFrame([(i, text(15), text(2), "title") for i in range(40)] + [(99, "", "", "")], "p int, text string, heading string, title string")
    asked = spark.createDataFrame([(1, "a b cx"), (2, "dx ey tit"), (3, "jw")], "q int, text string")
    rows = lambda df: {(r.q, r.p, r.score, r.matched, r.tier) for r in df.collect()}
    few = R.search(passages, "p", asked, "q")
    dealt = [re.search(r"hashpartitioning\(.*?, \d+\)", line)[0] for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert [d for d in dealt if "field#" not in d] == [d for d in dealt if "(p#" in d] and len([d for d in dealt if "(p#" in d]) == 1
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(R, "FREQUENT", 0.02)
    many = R.search(passages, "p", asked, "q")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("hashpartitioning(p#") >= 1 and "hashpartitioning(q#" not in plan
    assert rows(few) == rows(many) and len(rows(few)) > 30


def test_pairs_of_an_anchor_are_worked_out_once(spark):
    df = spark.range(200).selectExpr("id % 3 as q", "id as p", "cast(id * 7919 % 101 as double) as score", "cast(id % 2 as int) as tier", "id % 5 as anchor")
    out = R.unique_anchor(df, "q", "p", ["anchor"], 6)
    assert "7919" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.groupBy("q").agg(F.countDistinct("anchor").alias("n")).where("n = 5").count() == 3
