"""Each operator against a plain version or its library, on a test table and on odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from brute import dedup, groups, quality
from conftest import MEDIUM, SMALL

from quire.llm import curve_search, html_extract, line_dedup, mixing, parity_join, piece_lattice, token_counts, url_templates
from quire.llm import quality as rules

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LINE = "This line is long enough to be looked at, forty characters at least."
ODD = [None, "", " ", "\n", "a", "A  b\tc\x0bd", "é ß İ ſ K", "x" * 30_000, "word " * 9_000, " \u00a0x\u2028y ", "<s> </s> <|endoftext|> ▁a ▁▁b", "e\u0301 ﬁ 你好 🙂🙂", "tab\tand\r\nline  end ", "\x00 nul"]


@pytest.fixture
def odd(docs):
    return docs([(i, t, "en" if i % 3 else None, None if i % 2 else "s") for i, t in enumerate(ODD)])


def result(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_line_dedup(docs):
    base = [(i, f"  {LINE.upper() if i % 2 else LINE}\t\nown line number {i} that is long enough for the rule too\nshort\n{LINE}") for i in range(1, 7)]
    four = [(i, "Another line of forty characters or more, in four documents.") for i in range(10, 14)]
    got = result(line_dedup.dedup_lines(docs([*base, *four, (20, None), (21, "")])))
    want = dedup([*base, *four, (20, None), (21, "")])
    assert {d: (r["n_lines"], r["n_dropped"], r["text"]) for d, r in got.items()} == {d: (len(a), len(a) - len(b), "\n".join(b)) for d, (a, b) in want.items()}
    assert got[6]["n_dropped"] == 0 and got[1]["n_dropped"] == 2 and got[10]["n_dropped"] == 0


def test_line_dedup_batches_and_odd_rows(docs, odd):
    rows = [(i, f"{LINE}\n{'b' * (35 + i % 9)}") for i in range(40)]
    want = dedup(rows)
    for batches in (1, 5):
        got = result(line_dedup.dedup_lines(docs(rows), batches=batches))
        assert all(got[d]["text"] == "\n".join(b) for d, (_, b) in want.items())
    assert line_dedup.dedup_lines(odd).count() == len(ODD)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    same = docs([(1, LINE)] * 6 + [(None, LINE)])
    assert sorted(str(r.text) for r in line_dedup.dedup_lines(same.withColumnRenamed("source", "n_lines")).collect()) == ["", *[LINE] * 6]


def test_parity_join_small_sets_are_exact(docs):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(n)] for n in [5, 6, 7, 8, 9, 12, 16, 20, 31, 33, 64, 90, 200]]
    rows = []
    for w in base:
        for _ in range(14):
            v = list(w)
            for _ in range(rng.randrange(1 + len(v) // 25)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(99)}"
            if rng.random() < 0.6:
                v = v[:len(v) - rng.randrange(1 + len(v) // 5)] + [f"t{rng.randrange(5)}" for _ in range(rng.randrange(1 + len(v) // 12))]
            rows.append(" ".join(v))
    rows = list(enumerate(rows + ["one two", "One  two", "one", None, "", " "]))
    got = result(parity_join.similar_documents(docs(rows)))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == groups(rows)


def test_parity_join_table(spark, rows):
    want = groups([(r["doc_id"], r["text"]) for r in rows("documents", MEDIUM)])
    got = result(parity_join.similar_documents(spark.read.parquet(f"{MEDIUM}/documents.parquet")))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want


def test_parity_join_odd_rows(docs, odd):
    got = result(parity_join.similar_documents(odd))
    assert len(got) == len(ODD) and all(got[i]["component_id"] == i for i in range(len(ODD))) and [got[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 8)] == [0, 0, 0, 0, 1, 1]
    assert parity_join.similar_documents(odd.limit(0)).count() == 0
    twice = docs([(3, "a b c d e f"), (3, "other words stand here now"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "other words stand here now")])
    got = sorted((str(r.doc_id), r.component_id) for r in parity_join.similar_documents(twice).collect())
    assert got == [("3", 3), ("3", 3), ("7", 3), ("9", 3), ("None", 3)]
    assert parity_join.one_per_group(twice).count() == 2


def test_join_keys_meet_and_sketch_bounds():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 100, 511, 512, 700]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = rng.integers(0, 1 + parity_join.differ(len(a), len(a)) // 2)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**64, rng.integers(0, drop + 2), dtype=np.uint64)]))
            apart = int(np.bitwise_count(parity_join.parity_sketch(a) ^ parity_join.parity_sketch(b)).sum())
            assert apart <= len(np.setxor1d(a, b))
            if parity_join.similar(a, b):
                sent = [{k for keys, most in parity_join.join_keys(x) for k in np.sort(keys)[:most].tolist()} for x in (a, b)]
                assert sent[0] & sent[1]


def test_token_counts(spark, odd, rows):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(WORDS)
    want = {r["doc_id"]: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows("documents")}
    got = result(token_counts.count_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), WORDS))
    assert {d: r["n_tokens"] for d, r in got.items()} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) and r["n_bytes"] == len(r["text"].encode()) for r in got.values())
    for path in (WORDS, public_tokenizers.path("byte_bpe_50k.json"), PIECES):
        got = result(token_counts.count_tokens(odd, path))
        if path.endswith(".json"):
            want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in ODD]
        else:
            import sentencepiece
            want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in ODD])]
        assert [got[i]["n_tokens"] for i in range(len(ODD))] == want, path
    assert token_counts.count_tokens(odd.limit(0), WORDS).count() == 0


def test_mix_targets(docs):
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 400), ("a", 600), ("b", 4000), ("c", 9000), (None, 2000), ("c", 0)] + [("b", 300)] * 10)]
    rows.append((99, None, "en", "a"))
    got = result(mixing.mix(docs(rows)))
    # total 19000; weights a 5, b 2, c 1, null 5; a is full at 3000 and null at 6000, so b and c share 10000 as 2 to 1
    assert {r["source"]: round(r["target"], 6) for r in got.values()} == {"a": 3000, "b": round(20000 / 3, 6), "c": round(10000 / 3, 6), None: 6000}
    for s in ("a", "b", "c", None):
        own = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= mixing.BLOCK
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    again = result(mixing.mix(docs(rows[::-1])))
    assert {d: r["taken"] for d, r in again.items()} == {d: r["taken"] for d, r in got.items()}


def test_mix_odd_rows(docs, odd):
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0
    none = result(mixing.mix(docs([(1, None), (2, " ")])))
    assert all(r["taken"] == 0 and r["target"] == 0 for r in none.values())
    twice = docs([(1, "a b c", "en", "s")] * 3)
    assert sum(r.taken for r in mixing.mix(twice).collect()) in range(0, 28)
    assert set(mixing.repeat_to_mix(odd).columns) == set(odd.columns)


def test_sainte_lague(spark):
    rng = random.Random(2)
    votes = [(i, rng.randrange(1, 10**6) if i % 7 else rng.randrange(0, 3)) for i in range(60)]
    for seats in (0, 1, 7, 59, 60, 1000, 12345):
        held = {i: 0 for i, _ in votes}
        for _ in range(seats):
            top = max(votes, key=lambda v: (v[1] / (2 * held[v[0]] + 1), -v[0]))
            held[top[0]] += 1
        df = spark.createDataFrame([(i, v, seats) for i, v in votes], "source long, target long, seats long")
        assert {r.source: r.quota for r in mixing.apportion(df, [], ["source"], "target", "seats").collect()} == held, seats


def test_nearest(spark, rows):
    table = rows("embeddings", MEDIUM)
    v = np.array([r["embedding"] for r in table], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    from pyspark.sql import functions as F
    got = curve_search.nearest(spark.read.parquet(f"{MEDIUM}/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect()
    place = {r["vec_id"]: i for i, r in enumerate(table)}
    hits = n = 0
    for q in [r["vec_id"] for r in table if r["vec_id"] % 50 == 0]:
        near = unit @ unit[place[q]]
        near[place[q]] = -2
        want = {table[i]["vec_id"] for i in np.argsort(-near)[:5]}
        mine = sorted([r for r in got if r.query_id == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - near[place[r.vec_id]]) < 1e-9 for r in mine)
        hits, n = hits + len(want & {r.vec_id for r in mine}), n + 5
    assert hits / n >= 0.9


def test_nearest_odd_rows(spark):
    from pyspark.sql import functions as F
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [inf, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []), *[(i, [2.0, 0.0]) for i in range(10, 30)], (50, [2.0, 0.0]), (100, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in curve_search.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got[:5] == [(0, i + 1, 10 + i, 1.0) for i in range(5)]
    assert got[5:10] == [(50, 1, 0, 1.0), *[(50, i + 2, 10 + i, 1.0) for i in range(4)]]
    assert got[10:] == [(100, 1, 0, 0.0), *[(100, i + 2, 10 + i, 0.0) for i in range(4)]]
    assert curve_search.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hilbert_steps_by_one():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(curve_search.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_quality_counts(spark, odd, rows):
    for df, table in ((spark.read.parquet(f"{SMALL}/documents.parquet"), {r["doc_id"]: r["text"] for r in rows("documents")}), (odd, dict(enumerate(ODD)))):
        got = result(rules.judge(df))
        assert {d: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for d, r in got.items()} == {d: quality(t) for d, t in table.items()}
        assert not any(r["kept"] and r["base_failed"] for r in got.values())
    assert rules.judge(odd.limit(0)).count() == 0


def test_quality_verdicts_follow_labels(spark, rows):
    good = {r["doc_id"]: r["quality"] for r in rows("labels", MEDIUM)}
    got = result(rules.judge(spark.read.parquet(f"{MEDIUM}/documents.parquet")))
    clean = [got[d] for d, q in good.items() if q == 1 and not got[d]["base_failed"]]
    junk = [got[d] for d, q in good.items() if q == 0]
    assert all(r["kept"] for r in clean)
    assert sum(not r["kept"] for r in junk) >= 0.6 * len(junk)


def test_js_distance():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert np.allclose(rules.js_distance(p, np.array([0.0, 1.0])), [1.0, np.sqrt(0.5 * (0.5 * np.log2(2) + 0.5 * np.log2(0.5 / 0.75) + np.log2(1 / 0.75)))])


URLS = [None, "", "no scheme", "http://", "http://a.com", "HTTP://WWW.Example.COM/en/1?x://y", "http://example.com/en/2#z", "https://x.net/fr/3", "https://x.net/fr", "https://net/es/", "https://dotnet/es/", "http://a.org/p/1.html", "http://a.org//", "http://b.com\n/q"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    got = result(url_templates.judge_urls(df), "page_id")
    hosts = ["", "", "", "", "a.com", "www.example.com", "example.com", "x.net", "x.net", "net", "dotnet", "a.org", "a.org", "b.com\n"]
    paths = ["", "", "", "", "", "/en/1", "/en/2", "/fr/3", "/fr", "/es/", "/es/", "/p/1.html", "//", "/q"]
    assert [got[i]["host"] for i in range(len(URLS))] == hosts and [got[i]["path"] for i in range(len(URLS))] == paths
    assert [got[i]["rule"] for i in range(len(URLS))] == [None] * 5 + ["www.example.com/en/", "example.com/en/", "net/fr/", None, "net/es/", None, None, None, None]
    assert got[7]["verdict"] == "block" and got[5]["verdict"] == "allow" and got[11]["verdict"] == "allow"
    assert url_templates.judge_urls(df.limit(0)).count() == 0


def test_url_templates_reject_by_label(spark):
    urls = [f"http://h.org/bad/{i}" for i in range(60)] + [f"http://h.org/good/{i}" for i in range(60)] + [f"http://sub.h.org/bad/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules_ = [("h.org", f"/bad/{d}", "block") for d in "12345"] + [("h.org", f"/good/{d}", "allow") for d in "12345"]
    got = result(url_templates.judge_urls(df, rules_), "page_id")
    assert got[7]["rule"] is None and got[7]["verdict"] == "block" and got[67]["verdict"] == "allow"


def test_url_templates_of_any_depth(spark):
    urls = [f"http://h.org/a/b/c/d/{w}/x/{i}" for w in ("bad", "good") for i in range(60)] + [f"http://h.org/r{'/s' * 40}/{w}" for w in "uv"] + ["http://h.org/a/b", "http://h.org"]
    df = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, segments string")
    rules_ = [("h.org", f"/a/b/c/d/{w}/x/{d}", v) for w, v in (("bad", "block"), ("good", "allow")) for d in "12345"]
    got = result(url_templates.judge_urls(df, rules_), "page_id")
    assert got[7]["rule"] is None and got[7]["verdict"] == "block" and got[67]["verdict"] == "allow"
    assert got[7]["template"].endswith("/bad/+/*") and got[120]["template"] == got[121]["template"] == "/*" * 42
    assert got[122]["template"].count("/") == 2 and got[123]["template"] == "" and got[7]["segments"] == "t"


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two<b> three<br>four<p>Five &lt;six&gt;</article><footer>Foot</footer></body></html>", "A & B\nOne two three four\nFive <six>"),
    ("<article><header>no</header><p>yes</p><aside>no</aside><div class='ad'>no</div><form><p>no</p></form><ul><li>one<li>two</ul><script>if (a < b) '</p>'</script><div id=comments><p>no, a long comment of a reader that goes on and on</p></div><p>end</article>", "yes\none\ntwo\nend"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><!-- <p>no</p> --><p>a &#233; &nbsp;b</p></article>", "1\n2\n3\na é \u00a0b"),
    ("", ""), (None, ""), ("<nav>x</nav>", ""), ("<<<>>> < a <article>5 < 6 & 7 > 2</article", "5 < 6 & 7 > 2</article"),
]


def test_html_text(spark):
    train = spark.read.parquet(f"{SMALL}/pages.parquet")
    tree = html_extract.train(train)
    df = spark.createDataFrame([(i, "u", h, "t") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = result(html_extract.extract_text(df, tree), "page_id")
    assert [got[i]["text"] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract_text(df.limit(0)).count() == 0
    plain = "<body><div class=sidebar>x</div><p>" + "A long paragraph of running text that says something, with <a href=x>a link</a>. " * 3 + "</p><p>" + "More of it goes here, and it is long enough. " * 3 + "</p></body>"
    assert tree.extract(plain).startswith("A long paragraph") and "x" not in tree.extract(plain).split("\n")[0][:1]


LONG = "A long paragraph of running text that says something and goes on for a while, so that it is long. " * 3
NAMED = [
    ('<article><p>See <a href="/hidden-gems">the gems</a> now</p></article>', "See the gems now"),
    ('<article><p title="a hidden valley">Valley</p></article>', "Valley"),
    ('<article><p>See <a href="/v?id=share">that</a></p></article>', "See that"),
    ('<article><div class="post-body with-sidebar"><p>Text</p></div></article>', "Text"),
    ('<article><div id="search-for-meaning"><p>Text</p></div></article>', "Text"),
    ('<article><p class="notice-period">Text</p></article>', "Text"),
    ('<article><p hidden>no</p><p>yes</p><p style="display: none">no</p><p class="site-nav">no</p></article>', "yes"),
    (f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div class='site-footer'>f</div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<table><tr><td><a href=a>Home</a> <a href=b>News</a></td><td><p>{LONG}</p></td></tr></table>", LONG.strip()),
    (f"<article><p>{LONG}</p><div id=comments>{f'<p>{LONG}</p>' * 30}</div></article>", LONG.strip()),
    (f"<article>{f'<p>{LONG}</p>' * 30}<aside><p>buy</p></aside></article>", "\n".join([LONG.strip()] * 30)),
    ("<article><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></article>", "One\nTwo"),
    ("<p>before</p><script src=/a/>x</script><svg/><p>after" + "<b>" * 30_000 + "<div>" * 300 + "</i>" * 30_000, "before\nafter"),
]


def test_html_names_and_layouts(spark):
    tree = html_extract.train(spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert [tree.extract(h) for h, _ in NAMED] == [t for _, t in NAMED]
    bare = spark.createDataFrame([("u", "<p>" + LONG, 1), (None, "<nav>x</nav>", 2)], "url string, html string, q_row int")
    got = result(html_extract.extract_text(bare), "q_row")  # no page marks its article: the prior decides
    assert (got[1]["text"], got[1]["n_chars"], got[2]["text"]) == (LONG.strip(), len(LONG.strip()), "")


def test_html_training_and_messages_matter(spark):
    """F1 by characters on pages not fitted to, whose article mark is taken away."""
    tree = html_extract.train(spark.read.parquet(f"{SMALL}/pages.parquet"))
    held = [r["html"] for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").filter("page_id >= 30").collect()]

    def f1(odds_of):
        hit = taken = wanted = 0
        for source in held:
            page = html_extract.Page(source or "")
            labels = page.labels()
            if labels:
                odds = odds_of(page.unmarked())
                for run in filter(None, page.runs):
                    n, want, got = len(run[1].strip()), labels[run[0]], odds[run[0]] > 0
                    hit, taken, wanted = hit + n * (want and got), taken + n * got, wanted + n * want
        return 2 * hit / (taken + wanted)

    whole, alone, prior = f1(tree.marginals), f1(tree.own), f1(html_extract.Tree().marginals)
    assert whole > 0.999 and whole > alone + 0.05 and whole > prior


def test_html_marginals_match_enumeration():
    import itertools
    import math
    tree = html_extract.Tree({"tag p": 0.7, "tag li in other": -0.4, "edge other": 0.6, "edge plain": 1.5})
    page = html_extract.Page("<div><p>some text</p><nav><ul><li>x</li></ul></nav><p>t</p></div>")
    n, got = len(page.tags), tree.marginals(page)
    own, edges = tree.own(page), page.edges()
    one, all_ = [0.0] * n, 0.0
    for y in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(o for o, v in zip(own, y, strict=True) if v) + sum(tree.weights.get(edges[i], 0) for i in range(1, n) if y[i] == y[page.parents[i]]))
        all_ += p
        for i in range(n):
            one[i] += p * y[i]
    assert np.allclose(got, [math.log(a / (all_ - a)) for a in one])


def test_pieces(spark, odd, rows):
    import sentencepiece
    plain = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df, table in ((spark.read.parquet(f"{SMALL}/documents.parquet"), {r["doc_id"]: r["text"] for r in rows("documents")}), (odd, dict(enumerate(ODD)))):
        for frequent in (0, 3000):
            out = piece_lattice.decode(piece_lattice.encode(df, PIECES, frequent), PIECES)
            got = result(out)
            assert {d: list(r["ids"]) for d, r in got.items()} == {d: plain.encode(t or "") for d, t in table.items()}
            assert {d: r["decoded"] for d, r in got.items()} == {d: plain.decode(plain.encode(t or "")) for d, t in table.items()}
            assert {d: r["decoded"] for d, r in got.items()} == {d: (t or "").replace("▁", " ") for d, t in table.items()}
    assert piece_lattice.encode(odd.limit(0), PIECES).count() == 0


def test_viterbi_finds_the_best_path(spark):
    rng = random.Random(4)
    table = {p: -rng.random() * 6 - 1 for p in {"".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(18)}}
    units = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 8))) for _ in range(40)})

    def best(u):
        if not u:
            return 0.0
        return max([best(u[k:]) + table[u[:k]] for k in (1, 2, 3) if u[:k] in table] + ([best(u[1:]) - 20.0] if u[0] not in table else []))

    pieces = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(table.items())], "piece string, id int, score double")
    got = piece_lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces, 3, bpe=False).collect()
    for r in got:
        assert "".join(x.piece for x in r.found) == r.unit
        assert sum(table[x.piece] if x.id is not None else -20.0 for x in r.found) == pytest.approx(best(r.unit))


def test_columns_that_clash_stay(spark):
    """A document's own columns with the names that the operators use within."""
    df = spark.createDataFrame([(1, "some words", 7, "r"), (2, None, 8, "s")], "doc_id long, text string, n_bytes long, ids string")
    got = result(token_counts.count_tokens(df, WORDS))
    assert got[1]["n_bytes"] == 10 and got[2]["n_bytes"] == 0 and got[1]["ids"] == "r"
    got = result(piece_lattice.decode(piece_lattice.encode(df, PIECES), PIECES))
    assert got[1]["decoded"] == "some words" and got[2]["ids"] == [] and got[1]["n_bytes"] == 7
