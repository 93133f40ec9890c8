"""Quality rules: text statistics, and a decision list learned from labels that becomes one Spark expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import SPACE, U64, documents, fields, mix, trimmed, whole_row

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
#: Ratios that rules may test; each is a count over a count, 0 where that is 0.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
}
FEATURES = ("n_words", "n_dup_lines", *RATIOS)
#: The most labelled rows that a list is learned from; which ones follows from a hash of their ids.
MAX_TRAIN = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows found twice or more in the text. Hashes find candidates, the words themselves decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = mix(np.fromiter(map(hash, words), np.int64, len(words)).view(U64))
    h = np.zeros(n, U64)
    for i in range(WINDOW):
        h = h * U64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    starts = np.array([i for v in seen.values() if len(v) > 1 for i in v], int)
    if not len(starts):
        return 0
    delta = np.zeros(len(words) + 1, int)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + WINDOW, -1)
    return int((np.cumsum(delta) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    blank = len(raw) - len(raw.translate(None, SPACE))
    return (
        len(words),
        len(text) - blank,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, bytes(range(65, 91)))),
        raw.count(b"!") + raw.count(b"?"),
        len(raw) - len(raw.translate(None, b"0123456789")),
        len(set(words)),
    )


def statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of the input and COUNTS after them, in one pass without a shuffle. Null text counts as empty.

    Columns of the input that have the name of an added one are replaced.
    """
    names = [prefix + c for c in COUNTS]
    docs = docs.drop(*names)
    at = docs.columns.index(text)

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_counts(t or "") for t in b.column(at).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*b.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return docs.mapInArrow(trimmed(count_batches), schema)


def feature(name: str) -> Column:
    if name not in RATIOS:
        return F.col(name).cast("double")
    over, under = RATIOS[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ">=" or "<", threshold); a text that meets all of them is rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for name, op, value in self.tests:
            out = out & (feature(name) >= value if op == ">=" else feature(name) < value)
        return out

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, value in self.tests:
            out &= x[name] >= value if op == ">=" else x[name] < value
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    return np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1.0)


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int = 4) -> Rule:
    """Adds the test of the largest information gain until no good text is covered or no test helps."""
    tests: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most_tests and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best = (1e-9, None)
        for name in FEATURES:
            v, y = x[name][inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(cuts):
                continue
            p = np.cumsum(y)[cuts - 1]
            n = cuts - p
            gains = np.stack([_gain(p, n, p0, n0), _gain(p0 - p, n0 - n, p0, n0)], axis=1)
            at, side = divmod(int(gains.argmax()), 2)
            if gains[at, side] > best[0]:
                c = cuts[at]
                best = (float(gains[at, side]), (name, ("<", ">=")[side], float((v[c - 1] + v[c]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],)).matches(x)
    return Rule(tuple(tests))


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The shortest prefix of the tests that is worth most, (p - n) / (p + n), on rows that growing didn't see."""
    best = (rule, -1.0, 0)
    for k in range(1, len(rule.tests) + 1):
        hit = (r := Rule(rule.tests[:k])).matches(x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + n and (p - n) / (p + n) > best[1]:
            best = (r, (p - n) / (p + n), p)
    return best


def learn(rows: np.ndarray, bad: np.ndarray, most_rules: int = 12, least_worth: float = 0.8) -> list[Rule]:
    """Sequential covering. rows: COUNTS per row; bad: whether it is labelled low quality.

    Each rule is grown on two thirds of what no earlier rule covers and pruned on the rest; the list ends when a rule
    is right for less than nine in ten of the rows it covers there (worth 0.8), so that good texts are kept when in doubt.
    """
    counts = {c: rows[:, i].astype(float) for i, c in enumerate(COUNTS)}
    x = {f: counts[f] if f in counts else np.divide(counts[RATIOS[f][0]], counts[RATIOS[f][1]], out=np.zeros(len(rows)), where=counts[RATIOS[f][1]] > 0) for f in FEATURES}
    left, rules = np.ones(len(rows), bool), []
    part = np.arange(len(rows)) % 3 > 0
    while len(rules) < most_rules:
        g, t = left & part, left & ~part
        if (g & bad).sum() < 3 or not (t & bad).any():
            break
        rule = grow({f: v[g] for f, v in x.items()}, bad[g])
        if not rule.tests:
            break
        rule, worth, p = prune(rule, {f: v[t] for f, v in x.items()}, bad[t])
        if worth < least_worth or not p:
            break
        rules.append(rule)
        left &= ~rule.matches(x)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[Rule]:
    """The decision list, learned from at most max_train labelled ids, those of the least hashes, and as many rows of them.

    Only their texts are counted here; every cut between two values of a feature is tried. Rows that fail the base rules teach nothing. Labels with a null quality or id
    are left out; of an id that is labelled twice the lower quality counts. Without usable labels there are no rules.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train)
    texts = documents(docs).join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")
    order = ["doc_id", *COUNTS, "quality"]
    some_rows = statistics(texts).where(~base_failed()).select(*order).orderBy(F.xxhash64(*order), *order).limit(max_train)
    rows = some_rows.toPandas().sort_values(order).drop(columns="doc_id").to_numpy(dtype=np.int64)
    return learn(rows[:, :-1], rows[:, -1] == 0) if len(rows) else []


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a text meets, as one conditional expression; null if it meets none."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.expression(), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[DataFrame, list[Rule]]:
    """(one row per document with COUNTS, base_failed, rule and kept; the ordered rules).

    A text is kept unless it fails the base rules or meets a learned rule. Repeated rows are judged alike, each on its
    own; an empty table gives an empty result.
    """
    rules = fit(docs, labels, max_train)
    counted = statistics(documents(docs)).drop("text").withColumn("base_failed", base_failed())
    return counted.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows that judge() keeps, with the columns that they came with, whatever their names.

    Null and empty texts have fewer words than the base rules ask for, so they go; a null id changes nothing; repeated
    rows stay or go together; an empty table gives an empty result.
    """
    rules = fit(docs, labels, max_train)
    held = docs.select(whole_row(docs).alias("row"), docs["text"].cast("string").alias("text"))
    counted = statistics(held).where(~base_failed() & verdict(rules).isNull())
    return counted.select(*fields("row", docs.columns))
