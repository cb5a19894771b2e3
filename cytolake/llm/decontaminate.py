"""Benchmark decontamination with built-in functions only.

Normalised benchmark windows (13 consecutive words; a shorter item is one window) are indexed by the
hash of a seed, a run of words at a known offset inside the window. Every window is hit by a seed at
one of the document positions 0, STRIDE, 2 * STRIDE ..., so only those are hashed. The hashed seeds
meet the benchmark seeds in a hash join (broadcast while the seed table is under BROADCAST_ROWS rows,
shuffled beyond it), each hit compares the window's words themselves, and the covered words of
each document are the union of its verified windows.

One pass over the documents while the seeds are broadcast: each document emits its seeds together with the
words around them, and one row for itself, so nothing is read or joined twice. Beyond that, a first pass
shuffles hashes alone and finds the rows that hold any seed; only these are looked at closer. Windows are
distinct, and those of equal sets of items share one entry, so passages in many items cost no more.

Null text has no words. Each input row gives one result row, also when a doc_id repeats; an empty benchmark
leaves all documents clean, and items without words are never found. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cytolake.llm.common import free_name, materialise

WINDOW = 13
#: Windows of WINDOW words hold a seed of SEED words at some multiple of STRIDE = WINDOW - SEED + 1 positions.
SEED = 8
STRIDE = WINDOW - SEED + 1
#: Seeds are broadcast up to this many (about 200 bytes each), joined by a shuffle beyond.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _joined(array: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(array, start, length), " ")


def windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: window (words joined by blanks), length, and the sorted ids of its items as strings."""
    w = F.col("w")
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(n > 0)
    exploded = items.select("item", F.least(n, F.lit(WINDOW)).alias("length"), F.explode(F.transform(starts, lambda i: _joined(w, i, WINDOW))).alias("window"))
    return exploded.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def seeds(found: DataFrame) -> DataFrame:
    """Each window by the hash of each seed that can find it: (key, before, length, window, items).

    Windows of WINDOW words have STRIDE seeds of SEED words; a shorter window is its own seed and is
    looked for at every position (before = 0). items is the hash of the window's items, the key of item_sets.
    """
    w = F.split("window", " ")
    full = F.col("length") == WINDOW
    before = F.when(full, F.sequence(F.lit(0), F.lit(STRIDE - 1))).otherwise(F.array(F.lit(0)))
    each = found.select("length", "window", F.xxhash64("items").alias("items"), F.explode(before).alias("before"))
    size = F.when(full, F.lit(SEED)).otherwise(F.col("length"))
    return each.select(F.xxhash64(size, _joined(w, F.col("before") + 1, size)).alias("key"), "before", "length", "window", "items")


def item_sets(found: DataFrame) -> DataFrame:
    """(items, ids) of each distinct set of items that share a window."""
    return found.select(F.xxhash64("items").alias("items"), F.col("items").alias("ids")).distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """row_id, doc_id and text of each row of docs."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")


def _from_zero(last: Column, step: int) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _places(short: list[int]) -> list[tuple[Column, int, int]]:
    """Where documents are looked up: 0-based positions, size of the seed, and the words needed on either side."""
    n = F.col("n_words")
    return [(_from_zero(n - SEED, STRIDE), SEED, STRIDE - 1), *[(_from_zero(n - m, 1), m, 0) for m in short]]


def _cut(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))


def _touched(rows: DataFrame, index: DataFrame, short: list[int]) -> DataFrame:
    """row_id of the rows that hold any seed; only hashes are shuffled."""

    def hashed(positions: Column, size: int, _) -> Column:
        return F.transform(positions, lambda p: F.xxhash64(F.lit(size), _joined(F.col("w"), p + 1, size)))

    keys = [hashed(*x) for x in _places(short)]
    seen = _cut(rows).select("row_id", F.explode(F.array_distinct(F.concat(*keys))).alias("key"))
    return seen.join(index.select("key").distinct(), "key", "left_semi").select("row_id").distinct()


def _met(rows: DataFrame, index: DataFrame, short: list[int]) -> DataFrame:
    """A row for each of rows (start null) and for each verified window in it: row_id, doc_id, n_words, start, length, items."""
    w = F.col("w")

    def at(positions: Column, size: int, around: int) -> Column:
        """Seeds: key, position and the `around` words on either side with the seed."""
        return F.transform(
            positions,
            lambda p: F.struct(
                F.xxhash64(F.lit(size), _joined(w, p + 1, size)).alias("key"),
                p.alias("position"),
                F.least(p, F.lit(around)).alias("lead"),
                F.slice(w, p + 1 - F.least(p, F.lit(around)), F.least(p, F.lit(around)) + size + around).alias("near"),
            ),
        )

    # The row itself is dealt out by its number; what that meets by chance is not a seed.
    itself = F.array(F.struct(F.col("row_id").alias("key"), F.lit(-1).alias("position"), F.lit(0).alias("lead"), F.array().cast("array<string>").alias("near")))
    seen = _cut(rows).select("row_id", "doc_id", "n_words", F.inline(F.concat(itself, *[at(*x) for x in _places(short)])))
    joined = seen.join(index, "key", "left")
    begin = F.col("lead") - F.col("before") + 1  # of the window inside `near`, from 1
    verified = (begin >= 1) & (_joined(F.col("near"), F.greatest(begin, F.lit(1)), F.col("length")) == F.col("window"))
    seed = F.col("position") >= 0
    kept = joined.where(~seed | verified)
    return kept.select("row_id", "doc_id", "n_words", *[F.when(seed, c).alias(name) for c, name in ((F.col("position") - F.col("before"), "start"), (F.col("length"), "length"), (F.col("items"), "items"))])


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, length) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        stop = x["start"] + x["length"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(stop - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, zero, add)["n"]


def _report(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = windows(benchmark)
    index = seeds(found)
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    short = sorted(r[0] for r in index.where(F.col("length") < WINDOW).select("length").distinct().collect())  # at most WINDOW - 1 values
    if few:
        met = _met(rows, F.broadcast(index), short)
    else:
        # Seeds travel with the words around them only for rows that hold some; row ids must be the same in all three places.
        rows = materialise(rows, "windows-rows")
        touched = materialise(_touched(rows, index, short), "windows-touched")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("items", "long"))]
        met = _met(rows.join(touched, "row_id", "left_semi"), index, short)
        met = met.unionByName(_cut(rows.join(touched, "row_id", "left_anti")).select("row_id", "doc_id", "n_words", *none))
    # The rows of a document come from one task, so this aggregates before the shuffle: one row a document moves.
    grouped = met.groupBy("row_id", "doc_id").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("spans"),
        F.collect_set("items").alias("sets"),
    )
    # Distinct sets of items, not windows, meet their ids; the partitioning stays.
    sets = item_sets(found)
    each = grouped.select("row_id", "doc_id", "n_words", "spans", F.explode_outer("sets").alias("items")).join(F.broadcast(sets) if few else sets, "items", "left")
    whole = each.groupBy("row_id", "doc_id").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    out = whole.select(
        "row_id",
        "doc_id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        "spans",
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the windows' spans for each row of docs."""
    return _report(numbered(docs), benchmark)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated; rows of one doc_id go together if any of them is."""
    gone = report(docs.select("doc_id", "text"), benchmark).where("contaminated").select("doc_id").distinct()
    key = free_name(docs, "_gone")
    gone = gone.withColumnRenamed("doc_id", key)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the normalised words of each row without the words inside benchmark windows, as column words."""
    rows = materialise(numbered(docs), "windows-numbered")
    spans = _report(rows, benchmark).select("row_id", "spans")
    cut = rows.select("row_id", "doc_id", words(F.col("text")).alias("w"))
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["length"]))
    return cut.join(spans, "row_id", "left").select("doc_id", F.when(F.size("spans") > 0, F.filter("w", lambda x, i: ~inside(i))).otherwise(F.col("w")).alias("words"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, length, array_to_string(w[i : i + length - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS length, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT length FROM win
), seen AS (
  SELECT doc_id, length, i, array_to_string(w[i : i + length - 1], ' ') AS win
  FROM (SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM d, lengths WHERE len(w) >= length)
), hit AS (SELECT seen.doc_id, seen.length, seen.i, win.item_id FROM seen JOIN win USING (length, win)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + length)) AS p FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
