"""The manifest against plain loops over whole trees."""

import hashlib
import random
import zlib

from cytolake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx long, tree string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return h("".join(part(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            now = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                now["text"] = r["text"].replace("\n", "")
            cur, siblings, copied = leaf(now), "", [leaf(now)]
            for tree, place in ((trees[s], i), (top, k)):
                for nodes in tree[:-1]:
                    run = nodes[place - place % 3 : place - place % 3 + 3]
                    siblings += "".join(x for q, x in enumerate(run) if q != place % 3)
                    run[place % 3] = cur
                    cur = h("".join(run))
                    copied.append(cur)
                    place //= 3
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], h(siblings), cur, cur == top[-1][0], copied if leaf(now) != leaf(r) else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "x", 7, "y") for r in rows], SCHEMA).repartition(3)


def made(seed, n, sources):
    rng = random.Random(seed)
    return [dict(doc_id=i, source=rng.choice(sources), lang=rng.choice(["en", None]), n_chars=rng.choice([1, None, 77]), text=rng.choice(["x\ny", "", None, "é\n日本", "\n"])) for i in range(n)]


def test_trees_of_several_levels_of_blocks(spark):
    """Blocks of nine leaves: the hot source has four levels of them; also many sources, repeated rows, a null doc_id."""
    rows = made(1, 1500, [None, "a", "b", "", "é", *["hot"] * 8])
    rows += [dict(rows[3])] * 3 + [dict(doc_id=None, source="one", lang=None, n_chars=None, text="a\nb")]
    rows += [dict(doc_id=5000 + k, source=f"s{k}", lang="x", n_chars=1, text="t\n") for k in range(40)]
    assert rows_of(merkle.manifest(frame(spark, rows), 2)) == brute(rows)


def test_full_and_nearly_full_trees(spark):
    """Sizes at and beside powers of three, where a last run is whole or of one node."""
    rows = [dict(doc_id=i, source=f"n{n}", lang="en", n_chars=1, text=f"t{i}\n") for n in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82) for i in range(n)]
    assert rows_of(merkle.manifest(frame(spark, rows), 2)) == brute(rows)


def test_blocks_change_no_digest(spark):
    rows = made(2, 300, ["a", "b"])
    assert rows_of(merkle.manifest(frame(spark, rows), 1)) == rows_of(merkle.manifest(frame(spark, rows)))


def test_one_row_and_none(spark):
    rows = made(3, 1, ["a"])
    found = merkle.manifest(frame(spark, rows)).collect()
    assert len(found) == 1 and found[0].leaf == found[0].subroot == found[0].root and found[0].proof_sha256 == h("")
    assert merkle.manifest(frame(spark, rows).limit(0)).count() == 0


def test_odd_documents(docs, odd_texts):
    found = merkle.manifest(docs.drop("n_words", "r", "row_id", "_stats")).collect()
    assert len(found) == len(odd_texts) + 1 and len({r.root for r in found}) == 1
    assert all(r.verified == (r.copied is None) for r in found)
