"""Language-model scores from a probabilistic suffix tree, with a smoothed unigram model as base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, U64, arrow, documents, forget, stored

#: The longest context in bytes; with the next byte it must fit 64 bits.
DEPTH = 5
#: The most frequent words, whose base scores are broadcast; all others are joined.
HEAD = 1 << 17
#: The most frequent windows, whose scores are broadcast; all others are joined.
MEMO = 1_000_000
#: A context needs so many occurrences, and so much gain in nats for each next symbol that it has seen.
SUPPORT, GAIN_PER_SYMBOL = 2, 1.0
END = b"\n"


def tokens_of(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]


def symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (DEPTH bytes of context, then the symbol) at every symbol of the texts, and the symbols of each text.

    A text's symbols are the bytes of its words, a blank between them and the end after the last; ends fill the
    context before its start.
    """
    rows = [b" ".join(t) + END for t in texts]
    size = np.array([len(r) for r in rows], np.int64)
    buffer = np.frombuffer(b"".join(END * DEPTH + r for r in rows), np.uint8)
    n = len(buffer) - DEPTH
    w = np.zeros(max(0, n), U64)
    for i in range(DEPTH + 1):
        w |= buffer[i : i + n].astype(U64) << U64(8 * (DEPTH - i))
    keep = np.ones(n, bool)
    at = np.cumsum(size + DEPTH)[:-1]
    keep[(at[:, None] + np.arange(-DEPTH, 0)[None, :]).ravel()] = False
    return w[keep], size


class Windows:
    """Counts of windows in sorted arrays; handed on when they grow beyond a bound."""

    def __init__(self, most: int = 3_000_000) -> None:
        self.most, self.keys, self.counts, self.held, self.size = most, np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, w: np.ndarray) -> None:
        self.held.append(w)
        self.size += len(w)
        if self.size > 4_000_000:
            self.merge()

    def merge(self) -> None:
        if self.held:
            new = np.sort(np.concatenate(self.held))
            cut = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, int)
            keys, counts = new[cut], np.diff(np.append(cut, len(new)))
            both = np.concatenate([self.keys, keys])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([self.counts, counts])[order]
            cut = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
            self.keys, self.counts = both[cut], np.add.reduceat(n, cut) if len(cut) else n
            self.held, self.size = [], 0

    def take(self, force: bool) -> tuple[np.ndarray, np.ndarray] | None:
        if force:
            self.merge()
        if not len(self.keys) or not (force or len(self.keys) > self.most):
            return None
        out = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def gathered(docs: DataFrame) -> DataFrame:
    """Counts over the training rows, summed per task: (word, null, n) and (null, window, n)."""
    kinds = {"word": pa.binary(), "window": pa.int64(), "n": pa.int64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Counter(), Windows()

        def ready(force: bool) -> Iterator[pa.RecordBatch]:
            if words and (force or len(words) > 500_000):
                yield arrow({"word": list(words), "window": [None] * len(words), "n": list(words.values())}, kinds)
                words.clear()
            if found := windows.take(force):
                yield arrow({"word": [None] * len(found[0]), "window": found[0].view(np.int64), "n": found[1]}, kinds)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = tokens_of(b.column(1).slice(at, 256).to_pylist())
                for t in texts:
                    words.update(t)
                words[END] += len(texts)
                windows.add(symbols(texts)[0])
                yield from ready(False)
        yield from ready(True)

    return docs.mapInArrow(count, "word binary, window bigint, n bigint")


def frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, at most so many, by a threshold from the histogram of logarithms of the counts."""
    step = F.floor(F.log2(count) * 8)
    left, least = most, None
    for row in sorted(df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        left -= row.rows
        if left < 0:
            break
        least = row.step
    return df.where(F.lit(False) if least is None else step >= least)


def low(column: Column, size: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * size) - 1))


def fit(top: DataFrame) -> tuple[list[DataFrame], float]:
    """From the counts (key, n) of windows, for each context length k the rows (key, p, s, back), and the score of a symbol that never occurs.

    key is a context of k bytes and a symbol that follows it in the training rows, p the symbol's share there (not for
    k = DEPTH), s its log10 probability after the longest retained suffix of the context, and back the log10 weight of
    what a retained context hasn't seen (null for others). P(s | u) = (c + d P(s | suffix)) / (N + d), with d the
    number of symbols seen after u; the root mixes in one half of a count for each byte.

    A context is retained if its next symbols diverge from those after its suffix of k - 1 bytes: its occurrences
    times the divergence must reach GAIN_PER_SYMBOL for each symbol seen. All that do are kept, so the tree grows with
    the corpus; it stays a table. A context has at most 256 rows, which is all that one group holds.
    """
    counts = [top]
    for k in reversed(range(DEPTH)):
        counts.append(stored(counts[-1].groupBy(low(F.col("key"), k + 1).alias("key")).agg(F.sum("n").alias("n"))))
    counts.reverse()
    total = counts[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = F.col("n") / F.lit(float(max(total, 1)))
    root = counts[0].select("key", share.alias("p"), F.log10((F.col("n") + 0.5) / F.lit(total + 128.0)).alias("s"), F.lit(None).cast("double").alias("back"))
    levels = [stored(root)]
    for k in range(1, DEPTH + 1):
        below = levels[-1].select(F.col("key").alias("below"), F.log("p").alias("log_p"), F.col("s").alias("s_below"))
        group = Window.partitionBy("ctx")
        rows = counts[k].join(below, low(F.col("key"), k) == F.col("below")).select("key", "n", "log_p", "s_below", F.shiftrightunsigned("key", 8).alias("ctx"))
        rows = rows.withColumn("total", F.sum("n").over(group)).withColumn("kinds", F.count(F.lit(1)).over(group))
        rows = rows.withColumn("gain", F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.col("log_p"))).over(group))
        kept = (F.col("total") >= SUPPORT) & (F.col("gain") >= GAIN_PER_SYMBOL * F.col("kinds"))
        mixed = F.log10((F.col("n") + F.col("kinds") * F.pow(F.lit(10.0), "s_below")) / (F.col("total") + F.col("kinds")))
        made = {
            "p": F.col("n") / F.col("total"),
            "s": F.when(kept, mixed).otherwise(F.col("s_below")),
            "back": F.when(kept, F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))),
        }
        levels.append(stored(rows.select("key", *[c.alias(name) for name, c in made.items() if k < DEPTH or name != "p"])))
    forget(*counts[:-1])
    return levels, float(np.log10(0.5 / (total + 128)))


def unseen(windows: DataFrame, levels: list[DataFrame], never: float) -> DataFrame:
    """(window, s) for distinct windows outside the training rows.

    The score of the longest suffix seen, and the back weights of the retained contexts longer than that. Suffixes of
    two bytes, of which there are at most 65,536, are broadcast; longer ones are joined.
    """
    parts = [(k + 1, k, False) for k in range(DEPTH)] + [(k, k, True) for k in range(1, DEPTH + 1)]
    key = lambda k, ctx: low(F.shiftrightunsigned("window", 8), k) if ctx else low(F.col("window"), k + 1)

    def rows_of(short: bool) -> tuple[DataFrame, DataFrame]:
        asked, held = [], None
        for size, k, ctx in parts:
            if (size <= 2) == short:
                asked.append(F.struct(F.lit(k).alias("k"), F.lit(ctx).alias("is_ctx"), key(k, ctx).alias("key")))
                own = levels[k].where(F.col("back").isNotNull()).groupBy(F.shiftrightunsigned("key", 8).alias("key")).agg(F.first("back").alias("s")) if ctx else levels[k].select("key", "s")
                own = own.select(F.lit(k).alias("k"), F.lit(ctx).alias("is_ctx"), "key", "s")
                held = own if held is None else held.union(own)
        return windows.select("window", F.explode(F.array(*asked)).alias("e")).select("window", "e.*"), held

    (few_asked, few), (asked, held) = rows_of(True), rows_of(False)
    on = ["k", "is_ctx", "key"]
    found = few_asked.join(F.broadcast(few), on).union(asked.join(held, on))
    pair = F.struct("k", "s")
    by = found.groupBy("window").agg(F.max(F.when(~F.col("is_ctx"), pair)).alias("best"), F.collect_list(F.when(F.col("is_ctx"), pair)).alias("backs"))
    start = F.coalesce(F.col("best.s"), F.lit(never))
    longest = F.coalesce(F.col("best.k"), F.lit(-1))
    s = F.aggregate(F.array_sort(F.filter("backs", lambda x: x["k"] > longest)), start, lambda a, x: a + x["s"])
    return windows.join(by.select("window", s.alias("s")), "window", "left").select("window", F.coalesce("s", F.lit(never)).alias("s"))


class Table:
    """Open addressing over 64-bit keys in flat arrays: position of each key, or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.slot = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.slot[at[put]] = keys[left[put]], left[put]
            left, at = left[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


def score(docs: DataFrame, head: int = HEAD, memo: int = MEMO) -> DataFrame:
    """Scores every row; learns from the rows whose crc32 of the id as text isn't divisible by 10.

    The tree predicts the bytes of the lower-cased words, joined by blanks and closed by an end, which is the same
    as predicting the words: score is their log10 probability. Counts of all words and of all windows of the training
    rows are summed per task, then shuffled; the tree is a table of all retained contexts, of any number. The scores
    of at most ``head`` frequent words and ``memo`` frequent windows are broadcast; those of all others are joined,
    so the bounds change no result.

    Null text is empty and scores its end alone; a null id counts as empty text, so it is held out. Repeated rows
    are scored and counted as often as they occur. Without training rows every byte is equally likely, and base
    counts are 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    marked = documents(docs).withColumn("held_out", held)
    found = stored(gathered(marked.where(~held)))
    words = stored(found.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("c")))
    windows = stored(found.where(F.col("window").isNotNull()).groupBy(F.col("window").alias("key")).agg(F.sum("n").alias("n")))
    forget(found)
    levels, never = fit(windows)
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    norm = np.log10(total + 0.1 * (kinds + 1))
    top = frequent(words, "c", head).toArrow()
    heads = dict(zip(top["word"].to_pylist(), (np.log10(top["c"].to_numpy() + 0.1) - norm).tolist(), strict=True))
    often = frequent(windows, "n", memo).select("key").join(levels[DEPTH].select("key", "s"), "key").toArrow()
    model = spark.sparkContext.broadcast((Table(often["key"].to_numpy().view(U64)), often["s"].to_numpy()))
    known = spark.sparkContext.broadcast(heads)
    kinds_out = {
        "row": pa.int64(),
        "doc_id": pa.int64(),
        "held_out": pa.bool_(),
        "n": pa.int64(),
        "n_known": pa.int64(),
        "base_score": pa.float64(),
        "score": pa.float64(),
        "word": pa.binary(),
        "window": pa.int64(),
    }

    def only(size: int, **columns: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds_out.items()], names=list(kinds_out))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, get, (table, scores) = TaskContext.get().partitionId() << 40, known.value.get, model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                texts, held_out = tokens_of(b.column(1).to_pylist()), b.column(2).to_numpy(zero_copy_only=False)
                numbers = np.arange(row, row + b.num_rows)
                row += b.num_rows
                windows, size = symbols(texts)
                slot = table.find(windows)
                hit = slot >= 0
                each = np.zeros(len(windows))
                each[hit] = scores[slot[hit]]
                bases, n_known, words, of, n = [], [], [], [], []
                for number, tokens in zip(numbers.tolist(), texts, strict=True):
                    tokens.append(END)
                    base = list(map(get, tokens))
                    if None in base:
                        rare = Counter([w for w, v in zip(tokens, base, strict=True) if v is None])
                        base = [v for v in base if v is not None]
                        words += rare
                        of += [number] * len(rare)
                        n += rare.values()
                    bases.append(sum(base))
                    n_known.append(len(base))
                yield only(b.num_rows, row=numbers, doc_id=b.column(0), held_out=held_out, n=list(map(len, texts)), n_known=n_known, base_score=bases, score=np.add.reduceat(each, np.cumsum(size) - size))
                if words:
                    yield only(len(words), row=of, n=n, word=words)
                if not hit.all():
                    text, left = np.repeat(np.arange(b.num_rows), size)[~hit], windows[~hit]
                    order = np.lexsort((left, text))
                    text, left = text[order], left[order]
                    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (left[1:] != left[:-1])]))
                    yield only(len(cut), row=numbers[text[cut]], held_out=held_out[text[cut]], n=np.diff(np.append(cut, len(left))), window=left[cut].view(np.int64))

    rated = stored(marked.mapInArrow(rate, "row bigint, doc_id bigint, held_out boolean, n bigint, n_known bigint, base_score double, score double, word binary, window bigint"))
    c = F.coalesce(F.col("c"), F.lit(0))
    none = F.lit(0.0)
    of_words = (
        rated.where(F.col("word").isNotNull())
        .select("row", "word", "n")
        .join(words, "word", "left")
        .select(
            "row",
            F.when(c > 0, F.col("n")).otherwise(0).alias("known"),
            (F.col("n") * (F.log10(c + F.lit(0.1)) - F.lit(float(norm)))).alias("base"),
            none.alias("s"),
        )
    )
    rare = rated.where(F.col("window").isNotNull()).select("row", "held_out", "window", "n")
    seen = levels[DEPTH].select(F.col("key").alias("window"), "s")
    # Only held-out rows have windows that the tree's table lacks.
    fresh = stored(rare.where("held_out").select("window").distinct().join(seen, "window", "left_anti"))
    of_windows = rare.join(seen.union(unseen(fresh, levels, never)), "window").select("row", F.lit(0).cast("bigint").alias("known"), none.alias("base"), (F.col("n") * F.col("s")).alias("s"))
    rest = of_words.union(of_windows).groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("s").alias("s"))
    return rated.where(F.col("word").isNull() & F.col("window").isNull()).join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
