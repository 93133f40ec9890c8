"""What several operators share: shared-folder tables, Bloom filters, grouped Arrow streams and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the table that lower-cases A-Z alone.
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, as in tests, a local master, whose executors are the driver, gets a temporary folder; on a
    cluster that would lose what other machines write, so it is an error there.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder: lineage ends there, and a lost executor takes nothing with it.

    forget() removes the files; those of tables that a result still reads go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    fs, where = _files(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the files of stored tables that no later job reads."""
    for t in tables:
        fs, where = _files(t.sparkSession, t.stored_at)
        fs.delete(where, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns made beside it can't clash with any name; names may hold dots."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def fields(row: Column | str, names: list[str]) -> list[Column]:
    """The columns of whole_row() again."""
    row = F.col(row) if isinstance(row, str) else row
    return [row.getField(n).alias(n) for n in names]


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns under fixed names; further columns, whatever their names, stay outside."""
    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once, without an object per word.

    A word's hash is a polynomial of table values of its bytes, from prefix sums over the whole buffer, then mixed
    with its length. A-Z count as a-z; white space is that of ASCII.
    """

    BASE = U64(0x9E3779B97F4A7C15)

    def __init__(self) -> None:
        self.values = np.random.default_rng(20240229).integers(0, 1 << 64, 256, U64)[np.frombuffer(LOWER, np.uint8)]
        self.blank = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE, np.uint8))
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            inverse = U64(pow(int(self.BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, self.BASE)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, inverse)]), dtype=U64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in order, and where each text's begin (with the end of the last)."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        self._powers(len(buffer) + 1)
        blank = self.blank[buffer]
        edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.values[buffer] * self.up[: len(buffer)], dtype=U64)])
        h = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
        return h, np.searchsorted(starts, begin)


class Bloom:
    """A filter of 12 bits a key, of 128 KB at least and 16 MB at most; when it fills up, it only lets more pass.

    Bits come as an array of bytes whose length, a power of two, gives the mask.
    """

    LEAST, MOST, SHIFTS = 1 << 20, 1 << 27, (0, 18, 37)

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> np.ndarray:
        h = mix(keys.astype(U64))
        return np.stack([(h >> U64(s)) & U64(bits - 1) for s in Bloom.SHIFTS])

    @staticmethod
    def build(df: DataFrame, key: str) -> np.ndarray:
        """From a bigint column. Tasks send the slots that they set; slots of one byte are merged before the driver adds them.

        So no task makes a whole filter, and what arrives is at most one row for each 4 KB of the filter.
        """
        keys = stored(df.select(F.col(key).alias("key")).where(F.col(key).isNotNull()))
        bits = min(Bloom.MOST, max(Bloom.LEAST, 1 << (12 * keys.count()).bit_length()))
        page = 1 << 15

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = Bloom.slots(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64), bits).ravel().astype(np.int64)
                yield arrow({"page": at // page, "slot": at % page}, {"page": pa.int32(), "slot": pa.int32()})

        def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches, "page"):
                own = np.zeros(page, bool)
                own[t.column("slot").to_numpy()] = True
                yield arrow({"page": [t.column("page")[0].as_py()], "bits": [np.packbits(own).tobytes()]}, {"page": pa.int32(), "bits": pa.binary()})

        out = np.zeros(bits // 8, np.uint8)
        for row in by_key(keys.mapInArrow(slots, "page int, slot int"), "page").mapInArrow(pages, "page int, bits binary").toLocalIterator():
            at = row.page * page // 8
            out[at : at + page // 8] = np.frombuffer(bytes(row.bits), np.uint8)
        forget(keys)
        return out

    @staticmethod
    def maybe(raw: bytes, key: int) -> bool:
        """has() for one key, without arrays."""
        m = (1 << 64) - 1
        x = ((key ^ key >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        x ^= x >> 31
        last = 8 * len(raw) - 1
        for s in Bloom.SHIFTS:
            at = x >> s & last
            if not raw[at >> 3] >> (7 - (at & 7)) & 1:
                return False
        return True

    @staticmethod
    def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        s = Bloom.slots(keys, 8 * len(bits))
        return ((bits[s >> U64(3)] >> (U64(7) - (s & U64(7))).astype(np.uint8)) & 1).all(axis=0)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with an equal key as one table; batches must come sorted by the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in cuts:
            yield pa.Table.from_batches([*held, b.slice(at, c - at)])
            held, at = [], c
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Dealt out by the key into as many partitions as shuffles have, each sorted by key and order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order)


class Forest:
    """Union-find over 0..n-1; the smaller root wins."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        """The root of each, all paths made one step long."""
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up


#: A graph of so few edges, a few MB, is finished in one task.
FEW_EDGES = 200_000


def _priority(column: str | Column, level: int) -> Column:
    return F.struct(F.xxhash64(column, F.lit(level)).alias("h"), F.col(column).alias("id") if isinstance(column, str) else column.alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id, bigint or binary, in the edges (a, b); ids linked by any path have the same root, itself one of them.

    Contraction, until FEW_EDGES are left (which one executor's task finishes): each node moves to the neighbour (or
    itself) of least random priority; edges between the places of their ends make the next, smaller graph. Random
    priorities shrink chains by a constant factor a level, so the number of levels is logarithmic. Everything stays
    distributed; a hot node is aggregated before the shuffle, and joins on it are ones that Spark can split.
    """
    e = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while e.count() > FEW_EDGES:
        level = len(levels)
        both = e.union(e.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("id")).agg(F.min(_priority("b", level)).alias("m"))
        to = stored(nearest.select("id", F.least("m", _priority("id", level))["id"].alias("up")))
        levels.append(to)
        moved = e.join(to.select(F.col("id").alias("a"), F.col("up").alias("ua")), "a").join(to.select(F.col("id").alias("b"), F.col("up").alias("ub")), "b")
        moved = moved.where(F.col("ua") != F.col("ub")).select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        before, e = e, stored(moved.distinct())
        forget(before)
    kind = e.schema["a"].dataType.simpleString()
    root = e.coalesce(1).mapInArrow(_few, f"id {kind}, root {kind}")
    for to in reversed(levels):
        above = root.select(F.col("id").alias("up"), "root")
        root = to.join(above, "up", "left").select("id", F.coalesce("root", "up").alias("root"))
    return root


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of at most FEW_EDGES edges, in one task of known size."""
    held, kind = [], None
    for b in batches:
        if b.num_rows:
            kind = b.column(0).type
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[forest.roots()], kind)], names=["id", "root"])


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, after which the worker gives freed memory back: Spark keeps workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def arrow(rows: dict[str, list | np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))


class Cache(dict):
    """word -> value, made on first use; emptied when full, so a task's memory stays bounded."""

    def __init__(self, make: Callable, most: int = 300_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value
