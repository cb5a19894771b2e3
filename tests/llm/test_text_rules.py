"""License notices, quality rules and personal data against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytolake.llm import licenses, pii, quality
from tests.llm.conftest import prose


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = []
    for phrase, label, _ in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_base_places_and_null_texts(docs, odd_texts):
    for r in licenses.scan(docs).collect():
        n, places = base_places(odd_texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_edits_within_the_bound_are_found_with_their_place():
    *_, labels, score, spans = licenses.scan_text("see the Gnu Generall Public Licence terms")
    assert labels == "gpl" and spans == "gpl:2:5:2" and 0.9 < score < 1
    assert licenses.scan_text("the gnus generate public lizards")[5] == ""
    assert licenses.scan_text("under it license")[5:] == ("mit", 1 - 1 / 11, "mit:1:2:1")  # short words may hold the edits
    assert licenses.scan_text("CC BY, cc by")[1] == 2


def test_notices_keep_every_exact_place_next_to_inexact_ones():
    text = " ".join(["mit license", "mit licence"] * 50)
    n, places = base_places(text)
    assert licenses.scan_text(text)[1] == len(places) == 50


def test_planted_notices_within_their_bound_are_found():
    rng = random.Random(8)
    notices = [licenses.Notice(*x, base=True) for x in licenses.BASE + licenses.NOTICES]
    found = planted = 0
    for notice in notices:
        for _ in range(60 if notice.edits else 0):
            text = list(notice.text)
            for _ in range(rng.randint(1, notice.edits)):
                at = rng.randrange(len(text))
                if text[at] != " ":
                    kind = rng.choice("dis")
                    text[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("abcdefghij")]
            planted += 1
            found += notice.label in licenses.scan_text(f"{prose(planted, 30)} {''.join(text)} {prose(planted + 1, 30)}")[5].split(",")
    assert found >= 0.98 * planted, (found, planted)


def test_many_notices_and_no_documents(spark, no_docs):
    text = "mit licence, apache license; mit license. " * 3000
    assert licenses.scan_text(text)[1] == 6000 and licenses.scan_text(text)[7].count("mit:") == 6000
    assert licenses.scan(no_docs).count() == 0


def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_statistics():
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = [b"w%d" % x for x in rng.integers(0, 3, rng.integers(0, 60))]
        assert quality.repeat_words(words) == brute_repeats(words)
    text = "a b\na b\n \nA#b *\n\na b"
    assert quality.text_stats(text)[:4] == (8, len(re.sub(r"[\x20\x09-\x0D]", "", text)), 2, 2)
    assert quality.text_stats(None) == (0,) * 8


def labelled(n=900):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"symbols": rng.integers(0, 40, n) / 40, "upper": rng.integers(0, 40, n) / 40, "noise": rng.random(n)})
    rows["quality"] = 1 - ((rows["symbols"] > 0.8) | ((rows["upper"] > 0.7) & (rows["symbols"] > 0.5))).astype(int)
    rows["part"] = np.arange(n) % 3
    return rows


def test_rules_are_learned_pruned_and_read_as_spark_expressions(spark):
    rows = labelled()
    rules = quality.learn_rules(rows)
    assert rules and all(name != "noise" for rule in rules for name, _, _ in rule)
    kept = rows.assign(kept=spark.createDataFrame(rows[["symbols", "upper", "noise"]]).select(quality.rules_expression(rules, {c: F.col(c) for c in ("symbols", "upper", "noise")}).alias("k")).toPandas()["k"])
    assert (kept[kept["quality"] == 1]["kept"]).mean() > 0.99 and (~kept[kept["quality"] == 0]["kept"]).mean() > 0.9
    assert quality.learn_rules(rows[rows["quality"] == 1]) == []


def test_quality_on_odd_and_missing_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    out = quality.judge(docs, rules)
    assert out.count() == docs.count() and not out.where("n_words < 20 AND NOT base_failed").count()
    kept = quality.keep(docs, rules)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality.fit(no_docs, labels) == [] and quality.fit(docs, labels.where("FALSE")) == []
    assert quality.judge(no_docs, []).count() == 0


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, (_, rule) in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = [int(c) for c in m.group() if c.isdigit()][::-1]
            luhn = sum(d if i % 2 == 0 else 2 * d // 10 + 2 * d % 10 for i, d in enumerate(digits)) % 10 == 0
            fine = {0: True, 1: k != 1 or all(int(p) <= 255 for p in m.group().split(".")), 2: 12 <= len(digits) <= 19 and luhn, 3: 9 <= len(digits) <= 15}[k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = np.random.default_rng(9)
    parts = ["a", "@", ".", "b-c", "1", "23", "255", "256", "+", " ", "(", "-", "4111111111111111", "@x.y", "10.0.0.1", "+1 5", "é", "%"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 200_000) == []


def test_contexts_find_unseen_identifiers_and_leave_other_text_alone(spark):
    seen = [(i, f"some words here reach me at user{i}@mail.example.com thanks") for i in range(12)]
    other = [(100, "reach me at user77(at)mail today"), (101, "we met at 2024-11-28 in the hall"), (102, None)]
    docs = spark.createDataFrame(seen + other, "doc_id long, text string")
    patterns = pii.learn_patterns(docs)
    assert "me at <>" in patterns and "at <>" not in patterns
    got = {r.doc_id: r for r in pii.find(docs, patterns).collect()}
    assert got[100].spans == "id:12:26" and got[101].spans == "" and got[102].spans == ""
    assert got[3].n_email == 1 and got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
    masked = {r.doc_id: r.text for r in pii.redact(docs, patterns).collect()}
    assert masked[100] == "reach me at [ID] today" and masked[3] == "some words here reach me at [EMAIL] thanks" and masked[102] is None


def test_notices_with_a_letter_too_many_at_either_end():
    """All edits allowed spent before the first letter, inside, or after the last one; with a letter more it isn't the notice."""
    for text, label, edits in [(t, x, k) for t, x, k in licenses.BASE + licenses.NOTICES if k]:
        head, tail = text.split(" ", 1)
        for k in range(edits + 2):
            for t in ("z" * k + text, text + "z" * k, head + "z" * k + " " + tail):
                found = licenses.scan_text(f"under {t}, or so; {t}")[7].split(",")
                hits = [x for x in found if x.startswith(f"{label}:")]
                assert len(hits) == (2 if k <= edits else 0) and all(x.endswith(f":{k}") for x in hits), (t, found)


def name(i):
    return "".join("abcdefghij"[int(d)] for d in f"{i:05}")


def test_all_contexts_are_kept_and_joined(spark):
    lines = [f"p{name(i)} at u{k}x{i}@m.org" for i in range(20_100) for k in range(5)] + ["we are at home"] * 30_000
    texts = ["\n".join(lines[k : k + 250]) for k in range(0, len(lines), 250)] + [f"x p{name(9999)} at user77(at)mail today", "q at user77(at)mail", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs, pii.learn_patterns(docs)).collect()}
    assert len(got) == len(texts) and [got[len(texts) - k] for k in (3, 2, 1)] == ["id:12:26", "", ""]


def planted_identifiers(seed):
    """Texts with identifiers of unseen shapes, in contexts that seeds share, and numbers elsewhere; and their places."""
    rng = random.Random(seed)
    contexts = ["my mail is {} now", "call {} please", "account number {} of", "token = \"{}\" ;", "user id: {} at", "server {} port", "reach me under {} today"]
    seeds = [lambda: f"u{rng.randrange(10**6)}@x{rng.randrange(99)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"{rng.getrandbits(160):040x}"]
    unseen = [lambda: f"u{rng.randrange(10**6)}(at)host", lambda: f"ID-{rng.randrange(10**7):07}", lambda: f"{rng.randrange(10**8)}/{rng.randrange(10)}"]
    texts, planted = [], []
    for i in range(700):
        k = i % len(contexts)
        fresh = rng.random() < 0.2
        one = rng.choice(unseen if fresh else seeds)()
        before = prose(1000 + i, 20) + (f" in {rng.randrange(10**6, 10**7)} " if rng.random() < 0.3 else " ")
        head, tail = contexts[k].split("{}")
        if fresh:
            planted.append((i, len(before + head), len(before + head + one)))
        texts.append(before + head + one + tail + " " + prose(3000 + i, 20))
    return texts, planted


def brute_patterns(texts):
    """Scores of the confident patterns after all turns, by plain loops."""
    edges, follow = {}, {}
    shape = lambda t: (len(t) // 8, frozenset("a" if c.isalpha() else "0" if c.isdigit() else c for c in t))
    for text in texts:
        base = pii.base_spans(text)
        tokens = pii._tokens(text.lower())
        words = [re.sub("[0-9]+", "0", w) for _, _, w in tokens]
        places = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b, w in tokens if len(w) >= 6 and re.search("[0-9@]", w) and not any(x < b and a < y for x, _, y in base)]
        for a, b, is_base in places:
            left = [w for w, (_, end, _) in zip(words, tokens) if end <= a][-2:]
            right = [w for w, (start, _, _) in zip(words, tokens) if start >= b][:1]
            found = [" ".join([*left[-1:], "<>"])] * bool(left) + [" ".join([*left, "<>"])] * (len(left) > 1) + [" ".join([*left[-1:], "<>", *right])] * bool(left and right)
            token = text[a:b].lower()
            seed = is_base or bool(re.fullmatch("[0-9a-z+/_-]{32,}", token)) and not token.isdigit() and sum(c.isdigit() for c in token) >= 4
            for p in found:
                n, s = edges.get((p, token), (0, False))
                edges[p, token] = n + 1, s or seed
        for i in range(1, len(words)):
            for p in [f"{words[i - 1]} <>"] + [f"{words[i - 2]} {words[i - 1]} <>"] * (i > 1) + [f"{words[i - 1]} <> {words[i + 1]}" for _ in range(i + 1 < len(words))]:
                follow[p] = follow.get(p, 0) + 1
    by = {}
    for (p, token), (n, seed) in edges.items():
        by.setdefault(p, []).append((token, n, seed))
    worth = {t: 1.0 for (_, t), (_, seed) in edges.items() if seed}
    for turn in range(pii.ROUNDS):
        scores = {}
        for p, found in by.items():
            ids = sum(n for _, n, _ in found)
            share = ids / max(ids, follow.get(p, 0))
            trust = sum(worth.get(t, 0) for t, _, _ in found)
            alike = {shape(t) for t, _, _ in found if worth.get(t, 0) >= 0.7}
            against = sum((1 - worth.get(t, 0)) * (0.03 if shape(t) in alike else 1) for t, _, _ in found)
            score = share * trust / (trust + against) if trust else 0
            if share >= 0.7 and len(found) >= 5 and sum(worth.get(t, 0) >= 0.7 for t, _, _ in found) >= 5 and score >= (0.7 if len(p.split()) > 2 else 0.95):
                scores[p] = score
        worth = {}
        for (p, t), (_, seed) in edges.items():
            worth[t] = 1.0 if seed or worth.get(t) == 1.0 else 1 - (1 - worth.get(t, 0)) * (1 - min(scores.get(p, 0), 0.999999))
    return scores


def test_planted_identifiers_are_discovered_and_scores_are_those_of_plain_loops(spark):
    texts, planted = planted_identifiers(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    pairs = pii.pattern_instances(docs).cache()
    candidates = sorted(r[0] for r in pairs.groupBy("pattern").count().where("count >= 5").collect())
    got = {r.pattern: r.score for r in pii.score_patterns(pairs, pii.followers(docs, candidates)).collect()}
    want = brute_patterns(texts)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    assert "account number <>" in got
    spans = {(r.doc_id, *map(int, x.split(":")[1:])) for r in pii.find(docs, pii.learn_patterns(docs)).collect() for x in r.spans.split(",") if x.startswith("id:")}
    texts_of = lambda found: {(i, texts[i][a:b]) for i, a, b in found}
    assert len(texts_of(planted) & texts_of(spans)) >= 0.9 * len(planted)
    assert not any(re.fullmatch("[0-9a-f]{40}", x) for _, x in texts_of(spans))  # seeds by their shape count as secrets
    assert len(texts_of(planted) & texts_of(spans)) >= 0.9 * len(texts_of(spans))


@pytest.mark.parametrize("half", [0, 1])
def test_hidden_secrets_of_the_given_texts_are_discovered(spark, half):
    """Every second secret of the given documents is no seed: patterns learned from the others find it, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    secrets = sorted({w for t in texts.values() for _, _, w in pii._tokens(t.lower()) if pii._looks_random(w)})
    known = set(secrets[half::2]).__contains__
    hidden = {(i, a, b) for i, t in texts.items() for a, b, w in pii._tokens(t.lower()) if pii._looks_random(w) and not known(w)}
    found = {(r.doc_id, *map(int, x.split(":")[1:])) for r in pii.find(docs, pii.learn_patterns(docs, known), known).collect() for x in r.spans.split(",") if x.startswith("id:")}
    assert len(hidden) >= 5 and len(hidden & found) >= 0.9 * len(hidden) and len(hidden & found) >= 0.9 * len(found)


def test_discovered_instances_induce_patterns(spark):
    texts = [f"write to me at user{i}@mail.example.com thanks" for i in range(30)]
    texts += [f"write to me at id-{name(i)}7 thanks" for i in range(8)] + [f"badge id-{name(i)}7 shown" for i in range(8)] + ["badge id-zzzzz9 shown", "badge of honour", "room 1234567 shown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = pii.learn_patterns(docs)
    assert "badge <> shown" in patterns and "room <> shown" not in patterns
    got = {r.doc_id: r.spans for r in pii.find(docs, patterns).collect()}
    assert [got[len(texts) - k] for k in (3, 2, 1)] == ["id:6:15", "", ""]


def test_broadcast_and_joined_patterns_agree(spark, monkeypatch):
    url = "http://host/" + "path" * 50
    seen = [(i, f"reach me at user{i}@mail.example.com thanks. See {url} for user{i}@b.example.org") for i in range(12)]
    docs = spark.createDataFrame([*seen, (100, "reach me at user77(at)mail today"), (100, "reach me at user77(at)mail today"), (101, f"See {url} for user88(at)mail"), (102, None)], "doc_id long, text string")
    one = sorted(map(tuple, pii.find(docs, pii.learn_patterns(docs)).collect()))
    assert [r[-1] for r in one if r[0] == 101] == [f"id:{9 + len(url)}:{23 + len(url)}"]
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    patterns = pii.learn_patterns(docs)
    assert not isinstance(patterns, list) and sorted(map(tuple, pii.find(docs, patterns).collect())) == one
    assert {r.text for r in pii.redact(docs, patterns).where("doc_id = 100").collect()} == {"reach me at [ID] today"}


def test_pii_keeps_columns_and_rows(docs, no_docs):
    assert pii.learn_patterns(docs) == []
    out = pii.redact(docs, [])
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "@" not in "".join(r.text or "" for r in out.where("doc_id = 12").collect())
    assert pii.find(no_docs, []).count() == 0 and pii.learn_patterns(no_docs) == []
