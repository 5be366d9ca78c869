"""Spelling variants against brute force: near words by deletion, on odd rows and with a dictionary of any size."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import gram_index, letter_runs, spelling


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near_of(words):
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in words:
                near[w].add(short), near[short].add(w)
            holes[i, short].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    return near


def brute(rows):
    words = words_of(rows)
    near, form = near_of(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_against_brute_force(spark, docs, rows):
    found = [(r["doc_id"], r["text"]) for r in rows("documents")]
    assert result(spelling.variants(docs(found))) == brute(found)


@pytest.mark.parametrize("frequent", [1e-9, 0.01, 2.0])
def test_any_dictionary_finds_all(docs, monkeypatch, frequent):
    """With every gram, some or none frequent; words of one letter, of equal halves and with repeats among them."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(150)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaab", "abcabc", "abcabcabc", "xyzxyzxyz", "yzxyzxyz", "ÉÉÉÉÉÉ", "éééééé", "×÷×÷×÷", "×÷×÷×"]
    text = " ".join(w for w in base for _ in range(rng.choice([5, 6, 40, 300])))
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    assert result(spelling.variants(docs([(1, text)]))) == brute([(1, text)])


def test_odd_rows(docs, spark):
    odd = [(None, "Straße Strasse " * 6), (2, None), (3, ""), (4, "x" * 50_000), (5, "x" * 50_000), (6, "naïve-naïvé naïveté " * 40), (7, "ǅungla Ʌlphabet \U0001F642emoji word\x00word " * 9)]
    odd += [(8, "recieve " * 5 + "receive " * 30), (8, "recieve " * 5 + "receive " * 30), (9, "y" * 50_000 + " " + ("y" * 50_000 + " ") * 5)]
    assert result(spelling.variants(docs(odd).withColumnRenamed("source", "n").withColumnRenamed("lang", "word"))) == brute(odd)
    assert spelling.variants(docs(odd).limit(0)).count() == 0
    assert spelling.variants(docs([(1, "too few words here")])).count() == 0


def test_chains_lead_to_their_last_form(docs):
    text = " ".join(["aaaaaa "] * 3200 + ["aaaaab "] * 640 + ["aaaabb "] * 120 + ["aaabbb "] * 24)
    got = result(spelling.variants(docs([(1, text)])))
    assert got == brute([(1, text)]) and got["aaabbb"][1] == "aaaaaa"


def test_one_edit_never_changes_more_grams_than_said():
    rng = random.Random(8)
    for size in (0, 5, 60):
        grams = gram_index.Grams({"".join(rng.choice("ab") for _ in range(3)) for _ in range(size)})
        for _ in range(400):
            w = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 10)))
            found = grams.split(w)
            i = rng.randrange(len(w) + 1)
            k, v = rng.choice([(0, w[:i] + rng.choice("ab") + w[i:]), (1, w[:i] + w[i + 1:]), (1, w[:i] + rng.choice("abc") + w[i + 1:])])
            if k and i == len(w) and v != w:
                continue
            kept = sum((Counter(g for _, g in found) & Counter(g for _, g in grams.split(v))).values())
            assert kept >= len(found) - grams.affected(w, found)[k]


def test_checksums_go_on_from_a_prefix():
    import numpy as np
    data = np.frombuffer(b"abcdefghij", np.uint8)
    starts, ends = np.array([0, 2, 2, 9]), np.array([2, 2, 9, 10])
    before = np.array([zlib.crc32(b"1:")] * 4, np.uint32)
    assert letter_runs.crc_of(data, starts, ends, before).tolist() == [zlib.crc32(b"1:" + data[a:b].tobytes()) for a, b in zip(starts, ends)]
