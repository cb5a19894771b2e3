"""PII: seed entities by fixed rules, then bootstrapped contextual extraction.

Seeds are the matches of four base rules (email, ip, card, phone) and, for patterns alone, long random-looking
tokens (keys and digests). An instance is a seed or any token of identifier shape: MIN_CHARS characters or more
with a digit or @. Each instance induces three lexical patterns, where <> is its place:

    word <>    two words <>    word <> word

Words are lower-cased, digits in them are slots (0), and marks at their edges and = don't count. One pass
gathers the graph of distinct (pattern, instance) pairs of the whole corpus, a second one counts all that
follows patterns of SUPPORT instances or more. Then patterns and instances are scored in turns:

    pattern    share of instances among all that follows it, times T / (T + U + DOUBT * S) if SUPPORT of its distinct
               instances are trusted (worth of CONFIDENCE or more); T is the worth of all of them, U and S what they
               lack, S that of instances whose shape (length in eights, kinds of characters) a trusted one has
    instance   1 if a seed, else 1 - product of (1 - score) over its confident patterns

so what the patterns of one turn discover induces the patterns of the next. What nobody knows yet speaks against a
pattern, but hardly where it looks like what is trusted there, or nothing unseen would ever be found. Patterns of one word need ONE_WORD_CONFIDENCE, as fewer words say less. Patterns that are confident after the
last turn extract what stands in their place: as kind `secret` what is a seed by its shape, as kind `id` what no
rule knows. All such patterns are kept. Up to
BROADCAST_PATTERNS of them are broadcast; beyond that they stay a table, to which what stands in their place is
joined by a shuffle, with the same result (a bitmap of fixed size only saves rows that would not join).

Spans are half-open in code points; discovered spans never overlap base spans. Null text counts as empty, no
documents give no patterns, texts are read whole. Each input row gives one result row, also when a doc_id repeats.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cytolake.llm.common import free_name, materialise

KINDS = ("email", "ip", "card", "phone", "secret", "id")
SECRET, ID = 4, 5
SUPPORT, ROUNDS, BROADCAST_PATTERNS, MIN_CHARS = 5, 3, 20_000, 6
#: Confidence that patterns need, and those of one word; how much an unknown identifier speaks against a pattern.
CONFIDENCE, ONE_WORD_CONFIDENCE, DOUBT = 0.7, 0.95, 0.03
#: Bits of the bitmap of a table of patterns, and of a place's end in a pair of places.
BITMAP, END_BITS = 1 << 24, 32
#: Words of a pattern above this length stand as their digest.
LONGEST_WORD, PLACE = 64, "<>"

#: The base rules. Each begins where the rule's leftmost match begins, so no scan starts twice in a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")
_TOKEN = re.compile(r"[^\s=]+")
_IDENTIFIES = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
#: Seeds of patterns: 32 or more characters of a key or digest.
_RANDOM = re.compile(r"[0-9a-z+/_-]{32,}")
_EDGE = ".,;:!?()[]{}<>\"'*#$%&|="

RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            done = end
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by start, then kind; matches that fail their test are dropped."""
    if not _IDENTIFIES.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shown(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)])


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """Tokens between white space or = without marks at their edges: start, end and text, empty ones left out."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group()
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        if core:
            out.append((m.start() + left, m.start() + left + len(core), core))
    return out


def _looks_like_id(token: str) -> bool:
    return len(token) >= MIN_CHARS and _IDENTIFIES.search(token) is not None


def _looks_random(token: str) -> bool:
    return _RANDOM.fullmatch(token) is not None and 4 * sum("0" <= c <= "9" for c in token) >= len(token) // 2 and not token.isdigit()


def _lowered(text: str) -> str:
    """Lower-cased text with the places of the text."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(token: str) -> str:
    """A token as a word of a pattern."""
    word = _DIGITS.sub("0", token)
    return word if len(word) <= LONGEST_WORD else hashlib.sha256(word.encode("utf-8", "replace")).hexdigest()[:16]


def _contexts(words: list[str], left: int, right: int) -> list[str]:
    """The patterns of a place between the words `left` and `right`."""
    out = []
    if left >= 0:
        out.append(f"{_word(words[left])} {PLACE}")
        if left > 0:
            out.append(f"{_word(words[left - 1])} {out[0]}")
        if right < len(words):
            out.append(f"{out[0]} {_word(words[right])}")
    return out


class _Covered:
    """Places that spans cover."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in spans:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def instances(text: str, base: list[Span]) -> Iterator[tuple[int, int, bool, list[str]]]:
    """Place, whether it is a base seed, and patterns of each instance of a text with these base spans."""
    if not _IDENTIFIES.search(text):
        return
    lower = _lowered(text)
    places = _tokens(lower)
    starts, ends, words = [p[0] for p in places], [p[1] for p in places], [p[2] for p in places]
    for start, _, end in base:
        yield start, end, True, _contexts(words, bisect.bisect_right(ends, start) - 1, bisect.bisect_left(starts, end))
    covered = _Covered(base)
    for k, (start, end, token) in enumerate(places):
        if _looks_like_id(token) and not covered.meets(start, end):
            yield start, end, False, _contexts(words, k - 1, k + 1)


def _shape(token: str) -> str:
    """Length in eights and the kinds of characters: letters, digits, and each mark."""
    return f"{len(token) // 8}" + "".join(sorted({"a" if c.isalpha() else "0" if c.isdigit() else c for c in token}))


#: Whether a lower-cased token is a seed by its shape.
Seeded = Callable[[str], bool]


def pattern_instances(docs: DataFrame, seeded: Seeded = _looks_random) -> DataFrame:
    """(pattern, instance, seed, shape, n): the distinct pairs of the corpus, instances and shapes by a hash of 64 bits."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pattern", "instance", "seed", "shape", "n"]
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for start, end, base, patterns in instances(text or "", base_spans(text or "")):
                    token = text[start:end].lower()
                    name = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), 42) - (1 << 63)
                    seed = base or seeded(token)
                    shape = xxhash.xxh64_intdigest(_shape(token).encode("utf-8", "replace"), 42) - (1 << 63)
                    held.update((p, name, seed, shape) for p in patterns)
            columns = [*(list(zip(*held)) or [()] * 4), list(held.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=names)

    found = docs.select("text").mapInArrow(pairs, "pattern string, instance long, seed boolean, shape long, n long")
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("shape").alias("shape"), F.sum("n").alias("n"))


class _Bitmap:
    """Stands for a table of patterns where they are read: holds all of them and, by chance, some others."""

    def __init__(self, patterns: DataFrame):
        slot = (F.pmod(F.xxhash64("pattern"), F.lit(BITMAP)) + 1).alias("slot")
        rows = patterns.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        bits = bytearray(BITMAP // 8)
        for bucket, part in rows.toLocalIterator():  # rows of 4 KiB, BITMAP bits in all
            bits[(bucket - 1) * len(part) : bucket * len(part)] = part
        self.bits = bytes(bits)

    def __contains__(self, pattern: str) -> bool:
        slot = xxhash.xxh64_intdigest(pattern.encode("utf-8", "replace"), 42) % BITMAP
        return bool(self.bits[slot >> 3] >> (slot & 7) & 1)


Patterns = list[str] | DataFrame


def _small(patterns: DataFrame) -> Patterns:
    """The patterns as a sorted list where a broadcast may hold them, else the table."""
    if patterns.limit(BROADCAST_PATTERNS + 1).count() > BROADCAST_PATTERNS:
        return patterns.select("pattern")
    return sorted(r[0] for r in patterns.select("pattern").collect())


class _Sought:
    """Patterns by their kind, for counting what stands in their place."""

    def __init__(self, patterns: list[str]):
        cut = [p.split(" ") for p in patterns]
        self.one = {w[0] for w in cut if len(w) == 2}
        self.two = {(w[0], w[1]) for w in cut if len(w) == 3 and w[2] == PLACE}
        self.both = {(w[0], w[2]) for w in cut if len(w) == 3 and w[1] == PLACE}

    def count(self, words: list[str], held: Counter) -> None:
        held.update(f"{a} {PLACE}" for a in filter(self.one.__contains__, words[:-1]))
        held.update(f"{a} {b} {PLACE}" for a, b in filter(self.two.__contains__, zip(words, words[1:-1])))
        held.update(f"{a} {PLACE} {c}" for a, c in filter(self.both.__contains__, zip(words, words[2:])))


class _Mapped:
    """The same for a bitmap of patterns: these and, by chance, some others."""

    def __init__(self, bitmap: _Bitmap):
        self.bitmap = bitmap

    def count(self, words: list[str], held: Counter) -> None:
        held.update(filter(self.bitmap.__contains__, (f"{a} {PLACE}" for a in words[:-1])))
        held.update(filter(self.bitmap.__contains__, (f"{a} {b} {PLACE}" for a, b in zip(words, words[1:-1]))))
        held.update(filter(self.bitmap.__contains__, (f"{a} {PLACE} {c}" for a, c in zip(words, words[2:]))))


def _words(text: str) -> list[str]:
    """The words of all tokens of a text: those of _tokens(_lowered(text)), found at once."""
    words = [w for x in _DIGITS.sub("0", _lowered(text)).replace("=", " ").split() if (w := x.strip(_EDGE))]
    return [_word(w) for w in words] if max(map(len, words), default=0) > LONGEST_WORD else words


def followers(docs: DataFrame, patterns: Patterns) -> DataFrame:
    """(pattern, followers): how many tokens of the corpus stand in the place of each pattern."""
    exact = isinstance(patterns, list)
    sought = docs.sparkSession.sparkContext.broadcast(_Sought(patterns) if exact else _Mapped(_Bitmap(patterns)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column(0).to_pylist():
                sought.value.count(_words(text or ""), held)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pattern", "followers"])

    found = docs.select("text").mapInArrow(count, "pattern string, followers long").groupBy("pattern").agg(F.sum("followers").alias("followers"))
    return found if exact else found.join(patterns, "pattern", "left_semi")


def score_patterns(pairs: DataFrame, following: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) after `rounds` turns over the graph of pairs (pattern, instance, seed, shape, n)."""
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("size"), F.sum("n").alias("ids")).where(F.col("size") >= SUPPORT)
    sizes = sizes.join(following, "pattern", "left").select("pattern", (F.col("ids") / F.greatest("ids", F.coalesce("followers", F.lit(0)))).alias("share"))
    # A pattern of a smaller share never reaches CONFIDENCE.
    graph = materialise(pairs.join(sizes.where(F.col("share") >= CONFIDENCE), "pattern").select("pattern", "instance", "seed", "shape", "share"), "pii-graph")
    worth = graph.where("seed").select("instance", F.lit(1.0).alias("worth")).distinct()
    for turn in range(rounds):
        known = F.coalesce("worth", F.lit(0.0))
        shapes = graph.join(worth, "instance", "left").groupBy("pattern", "share", "shape").agg(F.sum(known).alias("sum"), F.sum(1 - known).alias("lack"), F.count_if(known >= CONFIDENCE).alias("trusted"))
        against = F.sum(F.col("lack") * F.when(F.col("trusted") > 0, DOUBT).otherwise(1.0))
        sums = shapes.groupBy("pattern", "share").agg(F.sum("sum").alias("sum"), against.alias("against"), F.sum("trusted").alias("trusted"))
        scores = sums.where(F.col("trusted") >= SUPPORT).select("pattern", (F.col("share") * F.col("sum") / (F.col("sum") + F.col("against"))).alias("score"))
        enough = F.when(F.size(F.split("pattern", " ")) > 2, CONFIDENCE).otherwise(ONE_WORD_CONFIDENCE)
        scores = materialise(scores.where(F.col("score") >= enough), "pii-scores")
        if turn + 1 < rounds:
            missing = graph.join(scores, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999999)))).alias("log_missing"))
            worth = missing.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("log_missing")).alias("worth")).where("worth > 0")
    return scores


def learn_patterns(docs: DataFrame, seeded: Seeded = _looks_random) -> Patterns:
    """Patterns of high confidence: a sorted list, or a table beyond BROADCAST_PATTERNS."""
    pairs = materialise(pattern_instances(docs, seeded), "pii-pairs")
    candidates = _small(materialise(pairs.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= SUPPORT).select("pattern"), "pii-candidates"))
    if isinstance(candidates, list) and not candidates:
        return []
    return _small(score_patterns(pairs, followers(docs, candidates)))


#: The patterns, or the pairs of places that they extract from this text (start and END_BITS of end).
Wanted = frozenset[str] | np.ndarray


def all_spans(text: str, wanted: Wanted, seeded: Seeded = _looks_random) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that stand in the place of a pattern."""
    base = base_spans(text)
    if not isinstance(wanted, frozenset):
        places = [(int(p) >> END_BITS, int(p) & ((1 << END_BITS) - 1)) for p in sorted(wanted)]
    elif wanted:
        places = [(start, end) for start, end, seed, patterns in instances(text, base) if not seed and not wanted.isdisjoint(patterns)]
    else:
        places = []
    return base, [(start, SECRET if seeded(text[start:end].lower()) else ID, end) for start, end in places]


def _placed(docs: DataFrame, patterns: Patterns) -> tuple[DataFrame, str]:
    """docs with a column of the pairs of places that patterns extract, by a shuffle; null where patterns are broadcast.

    Equal texts have equal places, so texts are known by their digests.
    """
    name = free_name(docs, "_places")
    if isinstance(patterns, list):
        return docs.withColumn(name, F.lit(None).cast("array<long>")), name
    wanted = docs.sparkSession.sparkContext.broadcast(_Bitmap(patterns))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                found = [(p, start << END_BITS | end) for start, end, seed, patterns in instances(text or "", base_spans(text or "")) if not seed for p in patterns if p in wanted.value]
                if found:
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    rows += [(digest, p, place) for p, place in found]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["digest", "pattern", "place"])

    digest = free_name(docs, "_digest")
    found = docs.select("text").mapInArrow(follow, "digest string, pattern string, place long").join(patterns, "pattern", "left_semi")
    found = found.groupBy(F.col("digest").alias(digest)).agg(F.collect_set("place").alias(name))
    joined = docs.withColumn(digest, F.sha2(F.col("text").cast("binary"), 256)).join(found, digest, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<long>"))).drop(digest), name


def _report(text: str | None, wanted: Wanted, seeded: Seeded) -> tuple:
    base, more = all_spans(text or "", wanted, seeded)
    kinds = Counter(k for _, k, _ in base)
    return kinds[0], kinds[1], kinds[2], kinds[3], hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more)


def find(docs: DataFrame, patterns: Patterns, seeded: Seeded = _looks_random) -> DataFrame:
    """doc_id and RESULT of each row of docs."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(patterns if isinstance(patterns, list) else ()))
    columns = [x.split()[0] for x in RESULT.split(", ")]

    @pandas_udf(RESULT)
    def report(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            yield pd.DataFrame([_report(t, wanted.value if p is None else p, seeded) for t, p in zip(texts, places)], columns=columns, dtype=object)

    placed, name = _placed(docs.select("doc_id", "text"), patterns)
    return placed.select("doc_id", report("text", name).alias("r")).select("doc_id", "r.*")


def mask(text: str | None, wanted: Wanted) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    base, more = all_spans(text, wanted)
    out, at = [], 0
    for start, kind, end in sorted(base + more):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, patterns: Patterns) -> DataFrame:
    """docs with personal data masked in text and, where there is such a column, n_chars counted anew."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(patterns if isinstance(patterns, list) else ()))

    @pandas_udf("string")
    def masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            yield pd.Series([mask(t, wanted.value if p is None else p) for t, p in zip(texts, places)], dtype=object)

    placed, places_name = _placed(docs, patterns)
    name = free_name(placed, "_masked")
    out = placed.withColumn(name, masked("text", places_name))

    def column(c: str) -> Column:
        if c == "text":
            return F.col(name).alias("text")
        if c == "n_chars":
            return F.when(F.col(name).isNull(), F.col(c)).otherwise(F.length(name).cast(dict(docs.dtypes)[c])).alias(c)
        return F.col(f"`{c}`")

    return out.select(*[column(c) for c in docs.columns])
