"""Near-duplicate vectors by E8 lattice hashing with probing of neighbouring cells and exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, Forest, arrow, by_key, components, forget, grouped, mix, stored, trimmed

TABLES, BLOCKS, SCALE, SEED = 10, 2, 0.45, 7
#: A bucket's rows are compared in one task up to so many; larger ones block by block.
MOST_ROWS = 2000
#: Two vectors that meet in a cell are compared if at most so many of 64 random signs differ; at a cosine of 0.95 some
#: 6.5 do (deviation 2.4), at 0 some 32 (deviation 4).
SIGNS, MOST_SIGNS = 64, 18


@cache
def projections(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, dims x (TABLES * BLOCKS * 8), and shifts."""
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((dims, TABLES * BLOCKS * 8)) * SCALE, rng.random(TABLES * BLOCKS * 8)


def _even(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points with integer coordinates of even sum, and their squared distances."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near, ((y - near) ** 2).sum(axis=1)


def decode(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of E8 to each row, doubled to be integer, and the best point of the other coset.

    E8 is the union of the integer vectors of even sum and those shifted by one half in every coordinate.
    """
    whole, d = _even(y)
    half, e = _even(y - 0.5)
    half = half + 0.5
    first = (d <= e)[:, None]
    return (2 * np.where(first, whole, half)).astype(np.int64), (2 * np.where(first, half, whole)).astype(np.int64)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unit vectors: own cell per table, rows x TABLES, and probed neighbours, rows x TABLES x BLOCKS.

    A table's cell is a pair of lattice points; a probe takes the second best point in one of the two blocks.
    """
    directions, shifts = projections(x.shape[1])
    y = (x @ directions + shifts).reshape(len(x) * TABLES * BLOCKS, 8)
    best, second = decode(y)
    weights = np.random.default_rng(SEED + 1).integers(0, 1 << 64, 8, U64) | U64(1)
    key = lambda p: mix((p.view(U64) * weights).sum(axis=1, dtype=U64)).reshape(len(x), TABLES, BLOCKS)
    a, b = key(np.ascontiguousarray(best)), key(np.ascontiguousarray(second))
    number = np.arange(TABLES, dtype=U64)
    salt = mix(number + U64(99))
    own = mix(a[:, :, 0] * U64(3) + mix(a[:, :, 1]) + salt)
    probes = np.stack([mix(b[:, :, 0] * U64(3) + mix(a[:, :, 1]) + salt), mix(a[:, :, 0] * U64(3) + mix(b[:, :, 1]) + salt)], axis=2)
    return own, probes


def sketches(x: np.ndarray) -> np.ndarray:
    """The signs of SIGNS random projections of each row, as one 64-bit number."""
    signs = x @ np.random.default_rng(SEED + 2).standard_normal((x.shape[1], SIGNS)) > 0
    return np.packbits(signs, axis=1).view(U64).ravel()


def unit_rows(vectors: list[bytes], dims: int) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dims else np.float64) for v in vectors]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clean(values: pa.Array) -> tuple[list[bytes | None], list[int | None]]:
    """Each vector's components times a power of two, as bytes of floats where those hold them exactly, else of doubles, and
    their number; None for null, empty, zero or not fully finite vectors."""
    out, dims = [], []
    for v in values:
        x = None
        if v.is_valid and not v.values.null_count and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if np.isfinite(x).all() and top > 0:
                x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0
                short = x.astype(np.float32)
                x = short if (short == x).all() else x
            else:
                x = None
        out.append(None if x is None else x.tobytes())
        dims.append(None if x is None else len(x))
    return out, dims


def meeting(own_x: np.ndarray, probes_x: np.ndarray, own_y: np.ndarray, probes_y: np.ndarray) -> np.ndarray:
    """The cell at which a pair counts: of the first table in which the two meet, the own cell of x if y has it, else that of y."""
    at_x = (own_x == own_y) | (probes_y == own_x[:, :, None]).any(axis=2)
    at_y = (probes_x == own_y[:, :, None]).any(axis=2)
    first = (at_x | at_y).argmax(axis=1)
    row = np.arange(len(first))
    return np.where(at_x[row, first], own_x[row, first], own_y[row, first])


def dedup(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", value: str = "embedding", most_rows: int = MOST_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Equal vectors (and powers of two times one vector) are one class with a count, told apart by 128-bit hashes.
    Classes go to their own cell and its neighbours in every table, as numbers with a 64-bit sketch; only those that
    have another one of like signs in a bucket go there again as vectors. A bucket's cosines are one matrix product in
    double precision, and only counts per class and pairs that span the bucket leave the task. A pair counts at one of
    the cells at which it meets, which both sides' keys tell. Buckets above ``most_rows`` are split so that every two
    blocks meet in a task of their own.

    Null, empty, zero and not fully finite vectors link with nothing; vectors of other lengths are compared with their
    like. Repeated ids stay rows of their own; rows of a null id count as others' links, but name no component. Further
    columns, whatever their names, don't matter. An empty table gives an empty result.
    """
    base = vectors.select(vectors[key].cast("bigint").alias("vec_id"), vectors[value].cast("array<double>").alias("v"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            raw, dims = clean(b.column(1))
            full = [None if r is None else xxhash.xxh3_128_digest(r, seed=d) for r, d in zip(raw, dims, strict=True)]
            yield arrow({"vec_id": b.column(0), "fp": full, "dims": dims, "raw": raw}, {"vec_id": pa.int64(), "fp": pa.binary(), "dims": pa.int32(), "raw": pa.binary()})

    rows = stored(base.mapInArrow(read, "vec_id bigint, fp binary, dims int, raw binary"))
    found = rows.where(F.col("fp").isNotNull())
    classes = stored(found.groupBy("fp").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("dims").alias("dims"), F.first("raw").alias("raw")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"cell": pa.int64(), "own": pa.bool_(), "fp": pa.binary(), "sketch": pa.int64()}
        for b in batches:
            fp, length, raw = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_pylist()
            for dims in np.unique(length):
                at = np.flatnonzero(length == dims)
                x = unit_rows([raw[i] for i in at], int(dims))
                own, probes = cells(x)
                keys = np.concatenate([own[:, :, None], probes], axis=2).reshape(len(at), -1) ^ U64(int(dims) * 0x9E3779B9)
                per = keys.shape[1]
                role = np.tile(np.arange(per) % (BLOCKS + 1) == 0, len(at))
                yield arrow({"cell": keys.ravel().view(np.int64), "own": role, "fp": np.repeat(fp[at], per), "sketch": np.repeat(sketches(x).view(np.int64), per)}, kinds)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a unit that have another row of like signs there."""
        for t in grouped(batches, "unit"):
            sketch, side, own = t.column("sketch").to_numpy().view(U64), t.column("side").to_numpy(), t.column("own").to_numpy()
            alone, like = t.column("alone")[0].as_py(), np.zeros(len(sketch), bool)
            for at in range(0, len(sketch), 500):
                part = slice(at, at + 500)
                near = np.bitwise_count(sketch[part, None] ^ sketch[None, :]) <= MOST_SIGNS
                near &= (own[part, None] | own[None, :]) & (alone | (side[part, None] != side[None, :]))
                here = np.arange(len(sketch))[part]
                near[here - at, here] = False
                like[part] = near.any(axis=1)
            if like.any():
                yield from t.select(["unit", "cell", "own", "fp", "side", "alone"]).filter(pa.array(like)).combine_chunks().to_batches()

    entries = stored(classes.select("fp", "dims", "raw").mapInArrow(spread, "cell bigint, own boolean, fp binary, sketch bigint"))
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("own").cast("int")).alias("has"))
    crowded = sizes.where((F.col("n") > 1) & (F.col("has") == 1)).select("cell", F.ceil(F.col("n") / most_rows).cast("int").alias("blocks"))
    placed = entries.join(crowded, "cell").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.select("cell", "own", "fp", "sketch", "block", other.alias("other")).select(
        F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "cell", "own", "fp", "sketch", (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("alone"),
    )
    alike = stored(by_key(units, "unit").mapInArrow(trimmed(sift), "unit bigint, cell bigint, own boolean, fp binary, side int, alone boolean"))
    forget(entries)
    full = alike.join(classes.select("fp", "copies", "dims", "raw"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"fp": pa.binary(), "links": pa.int64(), "a": pa.binary(), "b": pa.binary()}
        for t in grouped(batches, "unit"):
            raw, length = t.column("raw").to_pylist(), t.column("dims").to_numpy()
            if len(raw) < 2 or (length != length[0]).any():
                continue
            dims = int(length[0])
            copies, side, own = (t.column(c).to_numpy() for c in ("copies", "side", "own"))
            fp, alone = t.column("fp").to_numpy(), t.column("alone")[0].as_py()
            x, number = unit_rows(raw, dims), np.unique(fp, return_inverse=True)[1]
            near = np.argwhere((x @ x.T >= cosine) & (own[:, None] | own[None, :]) & (number[:, None] < number[None, :]) & (alone | (side[:, None] != side[None, :])))
            if not len(near):
                continue
            mine, probes = cells(x)
            here = t.column("cell")[0].as_py()
            salt = U64(dims * 0x9E3779B9)
            counts, forest, pairs = np.zeros(len(raw), np.int64), Forest(len(raw)), []
            for s in range(0, len(near), 20_000):
                i, j = near[s : s + 20_000].T
                ok = (meeting(mine[i], probes[i], mine[j], probes[j]) ^ salt).view(np.int64) == here
                i, j = i[ok], j[ok]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                pairs += [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
            hit = np.flatnonzero(counts)
            none = [None] * len(hit)
            yield arrow({"fp": fp[hit], "links": counts[hit], "a": none, "b": none}, kinds)
            if pairs:
                p, q = zip(*pairs, strict=True)
                none = [None] * len(p)
                yield arrow({"fp": none, "links": none, "a": fp[list(p)], "b": fp[list(q)]}, kinds)

    linked = stored(by_key(full, "unit", "fp").mapInArrow(trimmed(compare), "fp binary, links bigint, a binary, b binary"))
    forget(alike)
    links = linked.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(linked.where(F.col("a").isNotNull()).select("a", "b"))
    named = classes.select("fp", "least", "copies").join(links, "fp", "left").join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = named.join(least, "root").select("fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        rows.select("vec_id", "fp")
        .join(whole, "fp", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


#: All pairs, so that the lattice's recall counts: the query's result must be whole on the tables that this is run on.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT reach.x, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN least ON v.r = least.x LEFT JOIN n ON v.r = n.x
"""
