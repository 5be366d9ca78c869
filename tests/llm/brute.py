"""Plain versions of the operators, for small tables."""

import re

SPACE = " \t\n\x0b\f\r"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [w.translate(_FOLD) for w in found] if fold else found


def key(line):
    return line.strip(SPACE).translate(_FOLD)


def dedup(rows, min_chars=40, min_docs=5):
    """doc_id to (lines, kept) for rows (doc_id, text) of distinct ids."""
    holds = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holds.setdefault(k, set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        out[doc] = (lines, [x for x in lines if len(holds.get(key(x), ())) < min_docs or max(holds[key(x)]) == doc])
    return out


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def groups(rows):
    """doc_id to (set size, least id of its component)."""
    sets = {doc: shingle_set(text) for doc, text in rows}
    head = {doc: doc for doc in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    head[max(p, q)] = min(p, q)
    return {doc: (len(sets[doc]), find(doc)) for doc in ids}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text, fold=False)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i:i + 5]), []).append(i)
    cover = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def bigram_scores(rows, training, mu):
    """doc_id to (tokens, known, base, score), and the number of training tokens; ``training`` by id."""
    import math
    from collections import Counter
    one, two, begins = Counter(), Counter(), 0
    for doc, text in rows:
        if training(doc):
            seq = [*words(text), None]
            one.update(seq)
            two.update(zip(["<begin>", *seq[:-1]], seq, strict=True))
            begins += 1
    total = sum(one.values())
    share = lambda w: (one[w] + 0.1) / (total + 0.1 * (len(one) + 1))
    out = {}
    for doc, text in rows:
        seq = [*words(text), None]
        base = sum(math.log10(share(w)) for w in seq)
        score = sum(math.log10((two[h, w] + mu * share(w)) / ((begins if h == "<begin>" else one[h]) + mu)) for h, w in zip(["<begin>", *seq[:-1]], seq, strict=True))
        out[doc] = (len(seq), sum(one[w] > 0 for w in seq), base, score)
    return out, total
