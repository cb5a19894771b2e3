"""Spelling variants against plain loops; the scan against all pairs of a vocabulary, and what it skips."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from cytolake.llm import spelling

WORDS = st.lists(st.text("abcà", min_size=6, max_size=12), unique=True, max_size=60)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    cut, links = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cut[w[:k], w[k + 1 :]].add(w)
            if (d := w[:k] + w[k + 1 :]) in n:
                links[w].add(d)
                links[d].add(w)
    for same in cut.values():
        for w in same:
            links[w] |= same - {w}
    forms = {w: f for w in n if links[w] and n[f := min(links[w], key=lambda x: (-n[x], x))] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n[w], len(links[w]), forms.get(w), n.get(forms.get(w)), root))
    return sorted(out)


def found(docs):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect())


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_scan_finds_each_near_word_of_a_stretch_once(words):
    words = sorted(words)
    for share in (0, 3):
        q, w, _ = spelling.SortedList(words).near(words, np.full(len(words), share)) if words else ((), (), 0)
        got = [*zip([*map(int, q)], [*map(int, w)])]
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and a[:share] == b[:share]}
        assert len(got) == len(want) and {*got} == want


def test_words_run_past_the_last_query():
    q, w, _ = spelling.SortedList(["abcdefg", "abcdefgh", "abcdefghi"]).near(["abcdef"], np.array([6]))
    assert w.tolist() == [0]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", min_size=4, max_size=8), st.text("abc", max_size=5))
def test_no_range_is_skipped_that_holds_a_near_word(prefix, query, rest):
    if near(prefix + rest, query) or prefix + rest == query:
        assert spelling.within_one(prefix, query)


def test_stretches_are_skipped_by_their_prefix():
    """Of 3,000 words behind a wrong prefix the scan computes a few rows only."""
    words = sorted({"zz" + f"{k:04d}" for k in range(3000)} | {"abcdef", "abcdeg"})
    q, w, rows = spelling.SortedList(words).near(["abcdef"], np.array([0]))
    assert w.tolist() == [words.index("abcdeg")] and rows < 40


def test_variants_of_dense_vocabularies(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab" if i % 2 else "abcdÀ") if rng.random() < 0.9 else " " for _ in range(3000))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "abcdefg Abcdefh " * 9), *[(102, "x" * 20_000 + " " + "x" * 19_999)] * 5]
    rows += [(200 + k, "variant " * 40 + "varient " * 6 + "varieent " + "éclairs " + "éclair ") for k in range(6)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    want = brute(rows)
    assert found(df) == want
    assert any(r[3] for r in want) and max(r[2] for r in want) > 5


def test_odd_documents_and_none(docs, odd_texts, no_docs):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(4, odd_texts[4])]
    assert found(docs) == brute(rows)
    assert found(no_docs) == []


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(None, "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "aaabbb " * 625 + "aabbbb " * 3125)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and {r[5] for r in got} == {"aabbbb"}
