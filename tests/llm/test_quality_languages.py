"""Which reference a document is held against."""

import random

from quire.llm import quality as rules


def prose(rng, letters, n):
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    return lambda: " ".join(rng.choice(vocabulary) for _ in range(n))


def test_a_language_beyond_the_64th_has_a_reference(docs):
    rng = random.Random(5)
    latin, greek = prose(rng, "abcdefghijklmnoprstuvw", 200), prose(rng, "αβγδεζηθικλμνοπρστυω", 200)
    rows = [(100 * i + k, latin(), f"l{i:02}") for i in range(66) for k in range(7)]
    rows += [(9000 + k, greek(), "el") for k in range(6)]
    got = {r.doc_id: r for r in rules.judge(docs(rows)).collect()}
    assert len(rules.references(docs(rows))) == 67
    assert all(got[9000 + k].kept and got[9000 + k].d_class < 0.1 for k in range(6))


def test_null_languages_meet_the_nearest_of_all_and_thin_ones_none(docs):
    rng = random.Random(6)
    latin, greek = prose(rng, "abcdefghijklmnoprstuvw", 200), prose(rng, "αβγδεζηθικλμνοπρστυω", 200)
    rows = [(k, latin(), "en") for k in range(8)] + [(10 + k, greek(), "el") for k in range(8)]
    rows += [(20 + k, latin(), None) for k in range(8)] + [(30, greek(), None), (31, greek(), "thin"), (32, "#$% 123 &&& 456 " * 3 + " ".join(f"{i}#{i}" for i in range(60)), None)]
    rows += [(33, prose(rng, "アイウエオカキク", 200)(), "ja")]  # a clean text in a script of its own
    rows += [(40 + k, " ".join(f"{k}{i}%{i}" for i in range(200)), None) for k in range(8)]
    got = {r.doc_id: r for r in rules.judge(docs(rows)).collect()}
    assert [r["lang"] for r in rules.references(docs(rows))] == ["el", "en"]
    assert all(got[d].kept for d in [*range(8), *range(10, 18), *range(20, 28), 30, 31, 33])
    assert got[31].d_class == got[33].d_common == 0
    assert not any(got[40 + k].kept for k in range(8)) and not got[32].kept
