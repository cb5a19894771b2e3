"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule is a conjunction of thresholds that grows by FOIL
gain on two thirds of the labelled rows and is pruned on the rest; rows that it covers are taken out
and the next rule grows. The list becomes one ordered Spark expression (when ... when ... otherwise).

The statistics come from whole texts. Null text has no words and fails the base rule. Without labels
(or with one class only) the list is empty and the method keeps everything that the base rule keeps. Each
input row gives one result row, also when a doc_id repeats; columns of docs may have any names. No documents
give no rows and no rules; ties among statistics are broken by their values, then by name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.llm.common import free_name, text_udf

#: Bound on the labelled rows that the learner collects (the rows of smallest hash).
LABELLED_ROWS = 20_000
#: Share of rejected rows among those that a rule covers, on both parts of the labelled rows, and the least rows of each.
PRECISION, SUPPORT, MAX_RULES, MAX_CONDITIONS = 0.97, 5, 12, 8

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_chars long"
_SYMBOLS, _BLANKS, _MARKS = "#*$%&|<>", " \t\n\v\f\r", "!?"


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    scattered = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + (scattered[k : k + n] ^ (scattered[k : k + n] >> np.uint64(29)))
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Equal hashes exist: number the windows exactly, by doubling (1, 2, 4, 8 words).
    names, span = ids, 1
    while span < width:
        step = min(span, width - span)
        m = len(names) - step
        names = np.unique(names[:m] * (int(names.max()) + 1) + names[step : step + m], return_inverse=True)[1].astype(np.int64)
        span += step
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in (x.strip(_BLANKS) and x for x in text.split("\n")) if line]
    codes = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        int(((codes >= 65) & (codes <= 90)).sum()),
        sum(map(text.count, _MARKS)),
        len(text),
    )


def with_stats(docs: DataFrame, into: str) -> DataFrame:
    return docs.withColumn(into, text_udf(text_stats, STATS)("text"))


def features(stats: str) -> dict[str, Column]:
    """The ratios that rules speak of, from the statistics struct."""
    s = lambda name: F.col(f"`{stats}`.{name}")
    words, chars = F.greatest(s("n_words"), F.lit(1)), F.greatest(s("n_chars"), F.lit(1))
    return {
        "n_words": s("n_words").cast("double"),
        "chars_per_word": s("word_chars") / words,
        "symbols_per_word": s("n_symbols") / words,
        "dup_lines": s("n_dup_lines").cast("double"),
        "repeat_share": s("n_repeat_words") / words,
        "upper_share": s("n_upper") / chars,
        "marks_per_word": s("n_marks") / words,
    }


def base_failed(stats: str) -> Column:
    s = lambda name: F.col(f"`{stats}`.{name}")
    return (s("n_words") < 20) | (100 * s("n_repeat_words") > 30 * s("n_words"))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        out &= x[name] >= at if op == ">=" else x[name] <= at
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, first: str) -> Rule:
    """Adds the threshold of best FOIL gain, of the statistic `first` to begin with, until only rejected rows are covered or nothing gains."""
    rule: Rule = []
    held = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (held & ~bad).any():
        p0, n0 = int((held & bad).sum()), int((held & ~bad).sum())
        best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
        for name in sorted(x) if rule else [first]:
            order = np.argsort(x[name][held], kind="stable")
            values, hits = x[name][held][order], bad[held][order].astype(np.int64)
            ends = np.flatnonzero(np.r_[values[1:] != values[:-1], True])  # the last row of each value
            p_low, all_low = np.cumsum(hits)[ends], ends + 1
            # A threshold is the last value that it covers, so a rule claims no more than it has seen.
            for op, p, total, at in (("<=", p_low[:-1], all_low[:-1], values[ends[:-1]]), (">=", p0 - p_low[:-1], len(values) - all_low[:-1], values[ends[1:]])):
                if not len(p):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= SUPPORT, p * (np.log2(p / total) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, op, float(at[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        held = _covers(rule, x)
    return rule


def _precise(c: np.ndarray, bad: np.ndarray) -> bool:
    return (c & bad).sum() >= PRECISION * c.sum()


def _prune(rule: Rule, grow: tuple[dict[str, np.ndarray], np.ndarray], prune: tuple[dict[str, np.ndarray], np.ndarray]) -> tuple[float, Rule]:
    """Of the rule's prefixes that are precise on both parts and cover enough, the one of best (p - n) / (p + n) on the rows that it didn't grow from, the shortest of equals; with p - n."""
    best: tuple[float, float, Rule] = (-2.0, 0.0, [])
    for k in range(1, len(rule) + 1):
        grown, held_out = _covers(rule[:k], grow[0]), _covers(rule[:k], prune[0])
        if (grown & grow[1]).sum() < SUPPORT or not _precise(grown, grow[1]) or not _precise(held_out, prune[1]):
            continue
        p, n = int((held_out & prune[1]).sum()), int((held_out & ~prune[1]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, p - n, rule[:k])
    return best[1], best[2]


def learn_rules(rows: pd.DataFrame) -> list[Rule]:
    """rows: the features, quality (0 rejected) and part (0 and 1 grow, 2 prunes). Rules cover rows to reject."""
    names = [c for c in rows.columns if c not in ("quality", "part")]
    left, rules = rows, []
    for _ in range(MAX_RULES):
        parts = [(left[left["part"] != 2]), (left[left["part"] == 2])]
        grow, prune = [({c: p[c].to_numpy(float) for c in names}, p["quality"].to_numpy() == 0) for p in parts]
        if grow[1].sum() < SUPPORT or not (~grow[1]).any():
            break
        # One rule from each first statistic; the one that covers most held-out rejected rows is kept.
        rule = max((_prune(_grow(*grow, first), grow, prune) for first in sorted(names)), key=lambda r: (r[0], -len(r[1])))[1]
        if not rule:
            break
        rules.append(rule)
        left = left[~_covers(rule, {c: left[c].to_numpy(float) for c in names})]
    return rules


def rules_expression(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """Ordered conditions: the first rule that holds rejects (false), otherwise true."""
    out = None
    for rule in rules:
        held = F.lit(True)
        for name, op, at in rule:
            held = held & (columns[name] >= at if op == ">=" else columns[name] <= at)
        out = (F.when if out is None else out.when)(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Learns from at most `rows` labelled documents, those of smallest hash. Rows of labels whose quality is null count as unlabelled; conflicting labels of a doc_id both count."""
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").orderBy(spread, "doc_id", "quality").limit(rows)
    stats = with_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "_stats")
    shown = features("_stats")
    table = stats.select(*[c.alias(n) for n, c in shown.items()], "quality", F.pmod(spread, F.lit(3)).cast("int").alias("part"))
    # A doc_id that repeats in docs may give more rows than labels were chosen; the bound holds for them too.
    table = table.orderBy(F.xxhash64(*table.columns), *table.columns).limit(rows).toPandas()
    return learn_rules(table.sort_values(list(table.columns), ignore_index=True)) if len(table) else []


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for each row."""
    stats = with_stats(docs.select("doc_id", "text"), "_stats")
    failed = base_failed("_stats")
    return stats.select("doc_id", *[f"_stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & rules_expression(rules, features("_stats"))).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that the base rule and the list keep, with their own columns."""
    name = free_name(docs, "_stats")
    stats = with_stats(docs, name)
    return stats.where(~base_failed(name) & rules_expression(rules, features(name))).select(*[F.col(f"`{c}`") for c in docs.columns])
