"""Near-duplicates, decontamination, WARC archives, language-model scores and the pipeline against brute force."""

import gzip
import hashlib
import io
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cytolake.llm import decontaminate, lm, quality, simhash, warc


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, f in zip(ids, fps):
            for j, g in zip(ids, fps):
                if bin(f ^ g).count("1") <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_near_duplicates_of_odd_documents(docs, odd_texts, no_docs):
    fps = [brute_fingerprint(t) for t in odd_texts]
    want = brute_components(range(len(fps)), fps)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.near_duplicates(no_docs).count() == 0


def dense(seed, size, centres=1):
    """Fingerprints in chains of near ones around some centres, and some far from all."""
    rng = np.random.default_rng(seed)
    fps = {int(x) for x in rng.integers(0, 2**63, centres)}
    while len(fps) < size:
        f = list(fps)[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            f ^= 1 << int(b)
        fps.add(f)
    return sorted(fps | {int(x) for x in rng.integers(0, 2**63, size // 4)})


@pytest.mark.parametrize("partitions", [1, 3, 25])
def test_links_of_dense_groups_over_partitions(spark, partitions):
    fps = dense(2, 150, 3)
    nodes = spark.createDataFrame([(i, simhash._long(f)) for i, f in enumerate(fps)], "id long, fp long")
    got = dict(map(tuple, simhash.components(simhash.links(nodes, partitions)).collect()))
    want = brute_components(range(len(fps)), fps)
    assert {i: got.get(i, i) for i in want} == want


def test_one_order_finds_all_links_of_its_leading_half():
    """Rows and visitors of a partition: everything with two differing bits at most in the leading half, and no two that aren't linked."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres ^ bit() ^ bit() for _ in range(40)]))
    rng.shuffle(fps)
    here = simhash.Partition(np.arange(500), fps[:500])
    here.search_own()
    visitors = fps[500:]
    roots = here.visit(visitors)
    near = np.bitwise_count(visitors[:, None] ^ here.fps[None, :]) <= 4
    lead = np.bitwise_count((visitors[:, None] ^ here.fps[None, :]) & simhash.LEADING) <= 2
    final = simhash._roots(here.parent)
    for v in range(len(visitors)):
        rows = np.flatnonzero(near[v] & lead[v])
        assert {final[r] for r in rows} <= {final[roots[v]]} if len(rows) else roots[v] < 0 or near[v].any()
    labels = brute_components(range(len(fps)), [int(x) for x in np.r_[here.fps, visitors]])
    assert all(labels[i] == labels[int(r)] for i, r in enumerate(final)) and all(labels[500 + v] == labels[int(r)] for v, r in enumerate(roots) if r >= 0)


def test_sums_of_differences_prune_most_of_the_index():
    """No block has to be equal: of 20,000 unrelated fingerprints, sums alone keep a search away from all but a few leaves."""
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    index = simhash.Hierarchy.of(fps)
    q, leaf = index.descend(fps[:300])
    assert len(index.levels) >= 4 and index.by_settled == 0
    assert index.by_sums > 0.5 * index.visited and len(q) < 0.05 * 300 * len(index.levels[0][0])
    assert {(i, i // simhash.LEAF) for i in range(300)} <= {*zip(q.tolist(), leaf.tolist())}
    groups = np.unique(np.concatenate([fps[:40] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60)]))
    here = simhash.Partition(np.arange(len(groups)), groups)
    here.search_own()
    before = here.index.by_settled
    here.search_own()
    assert here.index.by_settled > before  # what is connected already isn't gone through again


BENCH = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong tea for nobody at all today"


def brute_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination(spark, docs, odd_texts, no_docs):
    items = [(2, BENCH), (10, BENCH), (3, "short one here"), (4, None), (5, "don't"), (7, " ".join(odd_texts[4].split()[50:80]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    words = BENCH.upper().split()
    more = {100: "x y " + ", ".join(words[2:15]) + " z", 101: " ".join(words[:12]), 102: "a short one here short one here", 103: BENCH + " " + BENCH, 104: "don t!"}
    texts = dict(enumerate(odd_texts)) | more
    rows = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(i, t, 1) for i, t in more.items()], "doc_id long, text string, n_words long"))
    for r in decontaminate.report(rows, bench).collect():
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found)), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    clean = decontaminate.remove_contaminated(rows, bench)
    assert clean.columns == rows.columns and {r.doc_id for r in clean.collect()} == {i for i, t in texts.items() if not (brute_hits(t, items)[1] and 20 * brute_hits(t, items)[1] >= brute_hits(t, items)[0])}
    left = {r.doc_id: r.words for r in decontaminate.remove_spans(rows, bench).collect()}
    assert left[100] == ["x", "y", "z"] and left[102] == ["a", "short", "one", "here"][:1]
    assert decontaminate.report(no_docs, bench).count() == 0
    assert decontaminate.report(rows, bench.where("FALSE")).where("n_hit > 0").count() == 0


def test_decontamination_by_a_shuffled_join(spark, monkeypatch):
    items = [(i, BENCH) for i in range(1000)] + [(1000, BENCH.split("dog")[0]), (1001, "short one"), (1002, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [BENCH, "nothing of the kind", None, "a short one " + BENCH + " short one", "the quick brown fox jumps over the lazy", BENCH]
    rows = spark.createDataFrame([(min(i, 4), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted((min(i, 4), *brute_hits(t, items)[:2], len(brute_hits(t, items)[2]), hashlib.sha256(",".join(brute_hits(t, items)[2]).encode()).hexdigest()) for i, t in enumerate(texts))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    broadcast = sorted(map(tuple, decontaminate.report(rows, bench).select(columns).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.report(rows, bench).select(columns).collect())) == broadcast == want
    left = sorted((r.doc_id, r.words) for r in decontaminate.remove_spans(rows, bench).collect())
    assert left == [(0, []), (1, ["nothing", "of", "the", "kind"]), (2, []), (3, ["a"]), (4, []), (4, [])]


def test_warc_revisits(spark):
    long = "<p>" + "é" * 80 + "</p>"
    pages = [(3, "http://a/ b", long), (1, None, long), (2, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "WARC/1.1\r\n\r\n" * 20), (8, "u", "x" * 100_000), (9, "u", "x" * 100_000)]
    table = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, payload_digest string")
    got = {r.page_id: r for r in warc.write_and_read(table).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        body = (html or "").encode()
        first = min(p for p, _, h in pages if h == html) if len(body) >= 100 else page
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))
    assert warc.write_and_read(table.where("FALSE")).count() == 0


def test_warc_rows_that_repeat_or_lack_their_page(spark):
    a, b = "a" * 200, "b" * 200
    rows = [(1, "u", a), (1, "u", b), (2, "u", b), (3, "u", a), (3, "u", a), (None, "u", a), (None, "u", None), (4, None, b), (1, "u", "short")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda x: tuple(str(v) for v in x)
    first = {a: 1, b: 1}
    want = [(p, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", first[h]) if p and len(h or "") >= 100 and p != first[h] else ("response", None))) for p, _, h in rows]
    got = warc.write_and_read(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_warc_files_are_plain_archives(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "a" * 200), (2, "v", "a" * 200)], "page_id long, url string, html string")
    warc.write(table.coalesce(1), f"file://{tmp_path}/w")
    seen = []
    for file in (tmp_path / "w").glob("part-*.gz"):
        with gzip.open(io.BytesIO(file.read_bytes())) as stream:
            seen += [(f["warc-type"], len(warc.http_payload(b)[1])) for f, b in warc.parse(stream)]
    assert sorted(seen) == [("response", 200), ("revisit", 0)]


def brute_backoff(texts):
    """Mean log score of each text by the counts of all others."""
    cut = [(t or "").encode().lower().split() for t in texts]
    words, pairs = Counter(w for x in cut for w in x), Counter(p for x in cut for p in zip(x, x[1:]))
    total, out = sum(words.values()), []
    for x in cut:
        own, own_pairs, value = Counter(x), Counter(zip(x, x[1:])), 0.0
        alone = lambda w: math.log((words[w] - own[w] or 0.5) / total)
        for i, w in enumerate(x):
            p = (x[i - 1], w)
            rest = pairs[p] - own_pairs[p] if i else 0
            value += math.log(rest / (words[p[0]] - own[p[0]])) if rest else alone(w) + (math.log(0.4) if i else 0)
        out.append(value / len(x) if x else None)
    return out


@pytest.mark.parametrize("hot, frequent", [(0, 0), (20, 0), (20, 3), (20, 10_000), (65_535, 10)])
def test_stupid_backoff(docs, odd_texts, hot, frequent):
    texts = [*odd_texts, odd_texts[4]]
    want = sorted(((i if i < len(odd_texts) else 4), len((t or "").encode().lower().split()), s is not None, s or 0) for i, (t, s) in enumerate(zip(texts, brute_backoff(texts))))
    got = sorted((r.doc_id, r.n_words, r.score is not None, r.score or 0) for r in lm.score(docs, frequent=frequent, hot=hot).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, want))


def test_stupid_backoff_counts_every_word_and_tells_repeated_texts_apart(spark):
    rare = [f"w{i}" for i in range(70_000)]
    texts = [" ".join(rare + rare[::-1] + ["w3 w4 w5"] * 3), " ".join(rare[-900:-600] + rare[-50:]), "new w69999 w3 w4"]
    rng = np.random.default_rng(6)
    fresh = [" ".join(f"x{j}" for j in rng.integers(0, 4000, 80)) for _ in range(60)]
    texts += fresh + fresh[:20]  # the first twenty occur twice
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert all(abs(got[i] - s) < 1e-5 for i, s in enumerate(brute_backoff(texts)))
    twice, once = [got[i] for i in [*range(3, 23), *range(63, 83)]], [got[i] for i in range(23, 63)]
    assert min(twice) > max(once)


def test_stupid_backoff_of_nothing(no_docs):
    assert lm.score(no_docs).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path, odd_texts):
    """Each stage by its own brute-force rule, on its own input."""
    from tests.llm.conftest import prose

    texts = [prose(i + 50, 60) for i in range(8)]
    texts += [texts[0], texts[1] + " tail", "too short", "na " * 60, prose(77, 40) + " " + BENCH, prose(78, 30) + " mail a.b@mail.example.com end", odd_texts[8]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, BENCH)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {i: t for i, t in enumerate(texts) if not (len(t.split()) < 20 or 100 * quality.repeat_words(t.encode().split()) > 30 * len(t.split()))}
    component = brute_components(list(kept), [brute_fingerprint(t) for t in kept.values()])
    kept = {i: t for i, t in kept.items() if component[i] == i}
    kept = {i: t for i, t in kept.items() if not (lambda n, h, _: h and 20 * h >= n)(*brute_hits(t, [(1, BENCH)]))}
    kept = {i: t.replace("a.b@mail.example.com", "[EMAIL]") for i, t in kept.items()}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert 8 not in got and 10 not in got and 11 not in got and 12 not in got and 13 in got


SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def written(spark, folder, **tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_of_empty_tables_and_null_texts(spark, tmp_path):
    from tests.llm.conftest import prose

    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none")).count() == 0
    texts = [None, "", " ", prose(900, 40), prose(901, 40), None]
    docs = [(i if i < 5 else None, t, None, None, None) for i, t in enumerate(texts)]
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "nulls", documents=docs)).collect()
    assert sorted(r.doc_id for r in got) == [3, 4]


def test_pipeline_applies_learned_rules(spark, tmp_path):
    from tests.llm.conftest import prose

    texts = [prose(i, 60) if i % 2 else " ".join(w + "$$$" for w in prose(i, 60).split()) for i in range(1000, 1240)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, i % 2, 0) for i in range(160)]
    folder = written(spark, tmp_path / "rules", documents=docs, labels=labels)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {i for i in range(240) if i % 2}


def test_archives_of_long_pages_stay_small(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 10)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = [(i, f"http://h/{i}", "x" * n + str(i % 7)) for i, n in enumerate([50] * 40 + [1_900] * 12 + [9_000] * 9 + [70_000] * 3)] + [(100, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = warc.new_path(spark, "long")
    warc.write(df, path)
    sizes = [(len(records), sum(len(warc.http_payload(b)[1]) for _, b in records)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() if (records := list(warc.parse(gzip.open(io.BytesIO(r.content)))))]
    assert sum(n for n, _ in sizes) == len(pages) and all(n <= 10 and (n == 1 or size <= 20_000) for n, size in sizes)
    found = {r.page_id: r.payload_bytes for r in warc.resolved(warc.read(spark, path)).collect()}
    assert found == {i: len(h or "") for i, _, h in pages}
