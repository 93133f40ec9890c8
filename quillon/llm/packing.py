"""Best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Cache, arrow, documents, stored, trimmed

CAPACITY = 2048
END = (0).to_bytes(4, "little")
PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}


@cache
def encoder(path: str):
    """word (bytes without ASCII white space) -> its ids as little-endian bytes.

    A pre-token never crosses white space, so words can be encoded one by one. Words of letters below U+0300 take a
    byte-pair encoder on bytes, with 0xFF (never in UTF-8) for the vocabulary's end-of-word mark; these need no
    composition and have simple lower case. All other words go to the tokenizer itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path) as f:
        model = json.load(f)["model"]
    suffix = model["end_of_word_suffix"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(back[c] for c in t.removesuffix(suffix)) + b"\xff" * t.endswith(suffix): i for t, i in model["vocab"].items() if not t.startswith("<|")}
    ranks.setdefault(b"\xff", len(model["vocab"]))
    pairs = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    letters = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
    numbers = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "N")
    cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
    plain = re.compile("[!-~¡-įĲ-˿]+")  # no white space, no dotted capital I

    def encode(word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if plain.fullmatch(text) and "<|" not in text and len(text) < 1000:
            ids = [i for t in cut.findall(text.lower()) for i in pairs.encode_single_piece(t.encode() + b"\xff")]
        else:
            ids = whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    return encode


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each row's ids and the end id 0: one row per piece, with its number among the equally long ones of its task.

    Null text is empty; equal ids give as many pieces as they have rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, seen = Cache(encoder(path), 250_000), TaskContext.get().partitionId(), {}
        for b in batches:
            out = {k: [] for k in PIECE}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = b"".join(map(words.__getitem__, (text or "").encode("utf-8", "surrogatepass").split())) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    for name, value in zip(PIECE, (doc, k, at // 4, n, zlib.crc32(own), part, rank), strict=True):
                        out[name].append(value)
            yield arrow(out, PIECE)

    return documents(docs).mapInArrow(trimmed(cut), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


class Tightest:
    """A segment tree over remaining capacities: which ones have open bins, and the least one that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, n: int) -> None:
        i = self.size + capacity
        while i:
            self.open[i] += n
            i >>= 1

    def at_least(self, need: int) -> int | None:
        """In logarithmic time: up until a sibling to the right holds something, then down its leftmost path."""
        i = self.size + need
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts of lengths; equal to placing the documents one by one.

    Pieces of a length are interchangeable, and a bin that was the tightest stays the tightest until it is too small.
    So runs of bins with one remaining capacity are filled together: a step says that the pieces of a length numbered
    from ``first`` go, ``per`` to a bin, into consecutive bins from ``bin``, beginning at ``offset``. The number of
    steps depends on the capacity, not on the number of documents.
    """
    tree, runs, bins = Tightest(capacity), {}, 0  # remaining -> runs [bin, bins in it]
    steps: dict[str, list[int]] = {k: [] for k in ("length", "first", "per", "bin", "offset")}

    def put(length: int, first: int, per: int, at: int, n: int, remaining: int) -> None:
        for k, v in zip(steps, (length, first, per, at, capacity - remaining), strict=True):
            steps[k].append(v)
        left = remaining - per * length
        if left:
            runs.setdefault(left, []).append([at, n])
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]
        while done < count:
            room = tree.at_least(length)
            if room is None:
                room, at, n = capacity, bins, -(-(count - done) // (capacity // length))
                bins += n
            else:
                at, n = runs[room].pop()
                tree.add(room, -n)
            per = room // length
            full = min(n, (count - done) // per)
            if full:
                put(length, done, per, at, full, room)
                done += full * per
            if full < n:
                rest = min(per, count - done)
                if rest:
                    put(length, done, rest, at + full, 1, room)
                    done += rest
                    full += 1
                if full < n:
                    runs.setdefault(room, []).append([at + full, n - full])
                    tree.add(room, n - full)
    return {k: np.array(v, np.int64) for k, v in steps.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs all rows by best fit in order of decreasing length; one row per piece with its sequence and offset.

    What reaches the driver is one count per length, at most ``capacity`` numbers, and the plan made of them, whose
    size depends on the capacity only. Pieces are numbered among equals by per-task counts and prefix sums over the
    tasks, so a length that a third of all pieces have needs no task of its own. Tokenised pieces are stored once,
    because their numbering must not change when a task runs again.
    """
    from pyspark.sql.window import Window

    pieces = stored(tokenised(docs, path, capacity))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(histogram, capacity)
    begin = {int(v): (int(i), int(j)) for v, i, j in zip(*(lambda u, s, c: (u, s, s + c))(*np.unique(-steps["length"], return_index=True, return_counts=True)), strict=True)} if len(steps["length"]) else {}
    spans = {-k: v for k, v in begin.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).select(*list(PIECE)[:5], (F.col("rank") + F.col("before")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            step = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = spans[int(n)]
                here = length == n
                step[here] = lo + np.searchsorted(steps["first"][lo:hi], number[here], "right") - 1
            along = number - steps["first"][step]
            sequence = steps["bin"][step] + along // steps["per"][step]
            offset = steps["offset"][step] + along % steps["per"][step] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*list(PIECE)[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(trimmed(place), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


