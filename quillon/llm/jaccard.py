"""Exact n-gram Jaccard join: candidate clusters from runs of a global order, then prefix trees with length bounds."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, Bloom, Forest, WordHasher, arrow, by_key, components, documents, fields, forget, grouped, mix, stored, trimmed, whole_row

#: N-grams of the greatest document frequency that come last in the global order; a bound on what is broadcast.
LAST = 1 << 17
#: A task's trie holds at most so many documents and n-grams of each side; larger clusters are compared block by block.
MOST_DOCS, MOST_GRAMS = 1500, 1_500_000
#: Signatures that a task holds before it sends them; equal ones among them travel once.
MOST_SIGS = 2_000_000
#: Tables of so many narrow rows (some 20 MB) are broadcast; larger ones are joined.
FEW_ROWS = 500_000


def gram_sets(texts: list[str | None], n: int, hasher: WordHasher) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; of all its words as one if they are fewer; none without words."""
    h, begin = hasher(texts)
    grams = np.zeros(max(0, len(h) - n + 1), U64)
    for i in range(n):
        grams = mix(grams + h[i : i + len(grams)] * U64(2 * i + 0x9E3779B97F4A7C15))
    out = []
    for a, b in itertools.pairwise(begin.tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        else:
            out.append(np.array([hash_all(h[a:b])], U64) if b > a else np.zeros(0, U64))
    return out


def hash_all(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))


def fingerprint(grams: np.ndarray) -> bytes:
    """128 bits, so that different sets of any corpus have different ones."""
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def heads(fps: list[bytes]) -> np.ndarray:
    """The first 64 bits of fingerprints. Sets that share them by chance are candidates of each other, no more."""
    return np.frombuffer(b"".join(fps), ">i8")[::2].astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], n: int, most: int = 512, most_bytes: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches with their sets, of so many rows and text bytes (a longer text stands alone)."""
    hasher = WordHasher()
    for b in batches:
        texts, at, size = b.column(1).to_pylist(), 0, 0
        for i, t in enumerate([*texts, None]):
            size += len(t or "")
            if i > at and (i == len(texts) or i - at == most or size > most_bytes):
                yield b.slice(at, i - at), gram_sets(texts[at:i], n, hasher)
                at, size = i, len(t or "")


def described(docs: DataFrame, n: int) -> DataFrame:
    """A row per document: id, set size, fingerprint of the set (null if empty); and rows of n-grams that are frequent in a task."""
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "fp": pa.binary(), "gram": pa.int64(), "times": pa.int64()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def frequent() -> pa.RecordBatch:
            all_grams = np.sort(np.concatenate(held)) if held else np.zeros(0, U64)
            starts = np.flatnonzero(np.concatenate([[True], all_grams[1:] != all_grams[:-1]])) if held else np.zeros(0, int)
            c = np.diff(np.append(starts, len(all_grams)))
            g, c = all_grams[starts[c >= 4]].view(np.int64), c[c >= 4]
            none = [None] * len(g)
            return arrow({"doc_id": none, "text_hash": none, "n_shingles": none, "fp": none, "gram": g, "times": c}, kinds)

        for b, sets in slices(batches, n):
            fps = [fingerprint(s) if len(s) else None for s in sets]
            none = [None] * len(fps)
            yield arrow({"doc_id": b.column(0), "text_hash": b.column(2), "n_shingles": [len(s) for s in sets], "fp": fps, "gram": none, "times": none}, kinds)
            for fp, s in zip(fps, sets, strict=True):
                if fp is not None and fp not in seen:
                    seen.add(fp)
                    held.append(s)
                    size += len(s)
            if size > 3_000_000:
                yield frequent()
                held, size = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        yield frequent()

    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(trimmed(describe), "doc_id bigint, text_hash bigint, n_shingles bigint, fp binary, gram bigint, times bigint")


def ordered(grams: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: by hash, but the frequent n-grams at the end, by frequency."""
    if not len(last):
        return grams
    at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
    hot = last[at] == grams
    return np.concatenate([grams[~hot], grams[hot][np.argsort(rank[at[hot]])]])


def runs(grams: np.ndarray, last: np.ndarray, rank: np.ndarray, tenths: int) -> np.ndarray:
    """Signatures of which two sets of Jaccard similarity t = tenths/100 or more share one, unless they are equal.

    Let c be the size of the intersection and d of the symmetric difference: d <= c (1 - t) / t, so d <= n (1 - t) / t
    for a set of n, of which at most n (1 - t) lie outside the other. Walk the union in the global order up to common
    element number 2 (d + 1) + 1: d others cut these into at most d + 1 runs, so three common elements are neighbours in
    both sets. They lie within the first 2 (d + 1) + 1 + n (1 - t) elements; each three neighbours there are a signature.
    That many common elements exist but for pairs with d < 3 (1 - t) / (3 t - 2), which for t >= 0.75 have at most 8
    elements each; sets of that size also give pairs of neighbours, of which d + 2 common elements have one.
    """
    n = len(grams)
    d = n * (100 - tenths) // tenths
    if not d:
        return grams[:0]
    o = ordered(grams, last, rank)[: 2 * d + 3 + n * (100 - tenths) // 100]
    pairs = mix(o[:-1] * U64(0x9E3779B97F4A7C15) + o[1:])
    threes = mix(pairs[:-1] * U64(0xD6E8FEB86659FD93) + o[2:])
    return np.concatenate([pairs, threes]) if n <= 8 else threes


def neighbours(docs: DataFrame, n: int, tenths: int, hot: Broadcast) -> DataFrame:
    """(a, b): heads of sets that share a signature, each with one of them.

    A task sends a set once. Of equal signatures that it holds it sends one, and links the others' sets to that one's
    by a signature that these two alone have: so a signature that very many sets have comes as one row per task and
    bound, not as a row per set, and no task gets them all.
    """
    kinds = {"sig": pa.int64(), "fp": pa.int64()}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sigs, heads_, held = [], [], 0

        def combined() -> Iterator[pa.RecordBatch]:
            s, f = np.concatenate(sigs), np.repeat(np.array(heads_, np.int64), [len(x) for x in sigs])
            order = np.argsort(s)
            new = np.concatenate([[True], s[order[1:]] != s[order[:-1]]])[: len(s)]
            lead = f[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
            links = np.unique(np.stack([lead[~new], f[order[~new]]]), axis=1)
            links = links[:, links[0] != links[1]]
            sent = np.zeros(len(s), bool)
            sent[order[new]] = True  # in the order of arrival, which keeps a set's rows together
            own = mix(links[0].view(U64) + mix(links[1].view(U64) + U64(tenths)))
            yield arrow({"sig": np.concatenate([s[sent], own, own]).view(np.int64), "fp": np.concatenate([f[sent], *links])}, kinds)

        for _, sets in slices(batches, n):
            for s in sets:
                if len(s) and (fp := fingerprint(s)) not in seen:
                    seen.add(fp)
                    sigs.append(r := runs(s, *hot.value, tenths))
                    heads_.append(int(heads([fp])[0]))
                    held += len(r)
            if held > MOST_SIGS:
                yield from combined()
                sigs, heads_, held = [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield from combined()

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig = first = None
        for b in batches:
            if not b.num_rows:
                continue
            s, f = (b.column(i).to_numpy() for i in (0, 1))
            new = np.concatenate([[s[0] != sig], s[1:] != s[:-1]])
            starts = np.flatnonzero(new)
            lead = np.concatenate([[f[0] if new[0] else first], f[starts[starts > 0]]])
            owner = lead[np.cumsum(new) - int(new[0])]
            sig, first = s[-1], owner[-1]
            keep = owner != f
            both = np.unique(np.stack([owner[keep], f[keep]]), axis=1)
            yield arrow({"a": both[0], "b": both[1]}, {"a": pa.int64(), "b": pa.int64()})

    signed = docs.mapInArrow(trimmed(sign), "sig bigint, fp bigint")
    return by_key(signed, "sig", "fp").mapInArrow(trimmed(first_of_each), "a bigint, b bigint").distinct()


def trie_join(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, tenths: int) -> list[tuple[int, int]]:
    """Pairs (left, right) that span the components of all pairs with Jaccard similarity of tenths/100 or more.

    left and right are masks over sets; if they are the same, each pair is met once. Grams get ranks by descending
    frequency here, ties by value, and the right sets become a path-compressed trie over ranks. A depth-first walk
    carries, for all left sets at once, the overlap with the path so far: what right sets share is intersected once.
    A left set leaves a subtree when its overlap and what can still come (the lesser of what is left of both sides)
    can't reach the overlap that the smallest set below needs; a subtree that no left set outside its component can
    match is passed over.
    """
    same = np.array_equal(left, right)
    size = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    grams, inverse, count = np.unique(everything, return_inverse=True, return_counts=True)
    rank_of = np.empty(len(grams), np.int64)
    rank_of[np.argsort(-count, kind="stable")] = np.arange(len(grams))
    useful = count[inverse] > 1  # a gram of one set takes part in no overlap
    rank, owner = rank_of[inverse[useful]], owner[useful]
    by_doc = np.lexsort((rank, owner))
    rank, owner = rank[by_doc], owner[by_doc]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    paths = [rank[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    mine = left[owner]
    post_order = np.argsort(rank[mine], kind="stable")
    post_rank, post = rank[mine][post_order], owner[mine][post_order]
    ptr = np.searchsorted(post_rank, np.arange(int((count > 1).sum()) + 1))
    useful_size = np.diff(bounds)

    order = sorted(np.flatnonzero(right).tolist(), key=lambda i: paths[i].astype(">u4").tobytes())
    place = np.full(len(sets), -1)
    place[order] = np.arange(len(order))
    own_size, own_useful = size[order], useful_size[order]
    forest, links = Forest(len(sets)), []

    def overlap(segment: np.ndarray) -> np.ndarray:
        begin, end = ptr[segment], ptr[segment + 1]
        n = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.bincount(post[at], minlength=len(sets))

    start = np.flatnonzero(left)
    stack = [(0, len(order), 0, np.zeros(len(sets), np.int64), start)]
    while stack:
        lo, hi, depth, shared, alive = stack.pop()
        if same:
            alive = alive[place[alive] < hi - 1]
        first, last = paths[order[lo]], paths[order[hi - 1]]
        least, longest = int(own_size[lo:hi].min()), int(own_useful[lo:hi].max())
        need = tenths * (size[alive] + least)
        can = shared[alive] + np.minimum(useful_size[alive] - shared[alive], longest - depth)
        alive = alive[can * (100 + tenths) >= need]
        if not len(alive):
            continue
        roots = forest.roots()
        below = np.unique(roots[order[lo:hi]])
        if len(below) == 1 and (roots[alive] == below[0]).all():
            continue
        most = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + int(differ[0]) if len(differ) else most
        if end > depth:
            shared = shared + overlap(first[depth:end])
        at = lo
        while at < hi and len(paths[order[at]]) == end:  # sets that end at this node
            y = order[at]
            hits = alive[(shared[alive] * (100 + tenths) >= tenths * (size[alive] + size[y])) & (alive != y)]
            if same:
                hits = hits[place[hits] < at]
            for x in hits.tolist():
                if forest.join(x, y):
                    links.append((x, y))
            at += 1
        heads = np.array([paths[order[i]][end] for i in range(at, hi)])
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        edges = [at, *(at + cuts).tolist(), hi] if at < hi else []
        for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
            stack.append((a, b, end, shared, alive))
    return links


def linked(docs: DataFrame, clusters: DataFrame, classes: DataFrame, n: int, tenths: int, most_docs: int, most_grams: int, few: int) -> DataFrame:
    """(a, b): fingerprints of similar sets, enough of them to span every component.

    Sets go to their cluster's units in one shuffle where the clusters' table is small enough to be looked up in the
    tasks that make them, in two where it has to be joined.
    """
    sized = clusters.join(classes.select(F.col("head").alias("id"), "n_shingles"), "id")
    total = sized.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("grams"))
    blocks = total.where("docs > 1").select("root", F.greatest(F.ceil(F.col("docs") / most_docs), F.ceil(F.col("grams") / most_grams), F.lit(1)).cast("int").alias("blocks"))
    placed = stored(clusters.join(blocks, "root").select(F.col("id").alias("head"), "root", "blocks"))
    context = docs.sparkSession.sparkContext
    small = placed.count() <= few
    if small:
        t = placed.toArrow().sort_by("head")
        table = context.broadcast(tuple(t.column(c).to_numpy() for c in ("head", "root", "blocks")))
    else:
        bloom = context.broadcast(Bloom.build(placed, "head"))
    kinds = {"head": pa.int64(), "fp": pa.binary(), "grams": pa.binary()}

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, sets in slices(batches, n):
            fps = [fingerprint(s) for s in sets]
            head = heads(fps)
            if small:
                at = np.minimum(np.searchsorted(table.value[0], head), len(table.value[0]) - 1)
                wanted = table.value[0][at] == head if len(table.value[0]) else np.zeros(len(sets), bool)
            else:
                wanted = Bloom.has(bloom.value, head.view(U64))
            pick = [i for i in np.flatnonzero(wanted) if len(sets[i]) and fps[i] not in seen and not seen.add(fps[i])]
            if pick:
                b = arrow({"head": head[pick], "fp": [fps[i] for i in pick], "grams": [sets[i].tobytes() for i in pick]}, kinds)
                if small:
                    for name, column in zip(("root", "blocks"), table.value[1:], strict=True):
                        b = b.append_column(name, pa.array(column[at[pick]]))
                yield b
            if len(seen) > 1_000_000:
                seen.clear()

    made = "head bigint, fp binary, grams binary"
    sets = docs.mapInArrow(trimmed(sets_of), f"{made}, root bigint, blocks int") if small else docs.mapInArrow(trimmed(sets_of), made).join(placed, "head")
    block, other = F.pmod(F.xxhash64("fp"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sets.select("fp", "grams", "root", block.alias("block"), other.alias("other")).select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "fp",
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        (F.col("block") == F.col("other")).alias("alone"),
        "grams",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "unit"):
            at = list({fp: i for i, fp in enumerate(t.column("fp").to_pylist())}.values())
            if len(at) < 2:
                continue
            t = t.take(at)
            fps, side, alone = t.column("fp").to_pylist(), t.column("side").to_numpy(), t.column("alone")[0].as_py()
            sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("grams")]
            whole = np.ones(len(fps), bool)
            found = trie_join(sets, whole, whole, tenths) if alone else trie_join(sets, side == 0, side == 1, tenths)
            if found:
                yield arrow({"a": [fps[i] for i, _ in found], "b": [fps[j] for _, j in found]}, {"a": pa.binary(), "b": pa.binary()})

    links = stored(by_key(units, "unit", "fp").mapInArrow(trimmed(compare), "a binary, b binary"))
    forget(placed)
    return links


def join(docs: DataFrame, n: int = 3, tenths: int = 90, most_docs: int = MOST_DOCS, most_grams: int = MOST_GRAMS, few: int = FEW_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id for every row, by word n-gram sets whose Jaccard similarity is tenths/100 or more.

    1. One pass gives each row's set size and 128-bit fingerprint. Equal sets are one class from here on, so copies,
       however many, are compared once. 2. Classes that share a signature (see ``runs``) form candidate clusters: every
       linked pair lies in one. 3. Sets of clustered classes alone are read again and go to their cluster, where a
       prefix tree finds pairs that span the components. Clusters beyond a task's bound are split into blocks and every
       two blocks meet in a task of their own, so no cluster needs one task. 4. Links become components.

    Null and empty texts have no n-grams and link with nothing. Very long texts are sets like others. Repeated rows and
    ids stay rows of their own; a component is named by its smallest id (null ids aside; a component of null ids alone
    has no name). Ties need no rule: the components don't depend on the order. Other columns, whatever their names,
    don't matter. An empty table gives an empty result.
    """
    if tenths < 75:
        raise ValueError("similarities below 0.75 need longer signatures")
    return placed(docs, n, tenths, most_docs, most_grams, few).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, n: int = 5, tenths: int = 80, few: int = FEW_ROWS) -> DataFrame:
    """One row of each component, the one of the smallest id, with the columns that it came with, whatever their names.

    Rows are told apart by id and text, and of rows equal in both one stays. Rows with a null id stay, as do those with
    null or empty texts. An empty table gives an empty result. Rows that go are looked up in a broadcast table where
    they are few; else the documents are joined with them.
    """
    found = stored(placed(docs, n, tenths, MOST_DOCS, MOST_GRAMS, few))
    key = [F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")]
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(*key).distinct().select("*", F.lit(0).alias("n"))
    again = found.where(F.col("component_id") == F.col("doc_id")).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gone_id", "gone_hash", F.lit(1).alias("n"))
    marks = stored(gone.union(again))
    forget(found)
    keyed = docs.select(whole_row(docs).alias("row"), docs["doc_id"].cast("bigint").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("hash"))
    at = (F.col("id") == F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    marked = keyed.join(F.broadcast(marks) if marks.count() <= few else marks, at, "left")
    once = marked.where(F.col("n") == 1).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row")
    return marked.where(F.col("n").isNull()).select("row").union(once).select(*fields("row", docs.columns))


def placed(docs: DataFrame, n: int, tenths: int, most_docs: int, most_grams: int, few: int) -> DataFrame:
    """join() with text_hash, Spark's hash of the text, besides."""
    spark, docs = docs.sparkSession, documents(docs)
    found = stored(described(docs, n))
    rows = found.where(F.col("gram").isNull()).select("doc_id", "text_hash", "n_shingles", "fp")
    counts = found.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("times").alias("times"))
    top = counts.where("times >= 32").orderBy(F.desc("times"), "gram").limit(LAST).toArrow()
    last = top.column("gram").to_numpy().view(U64)
    rank = np.arange(len(last))[::-1]  # the most frequent at the very end
    by_value = np.argsort(last)
    hot = spark.sparkContext.broadcast((last[by_value], rank[by_value]))
    head = F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("bigint")
    classes = stored(rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles")).withColumn("head", head))
    clusters = stored(components(neighbours(docs, n, tenths, hot)))
    links = linked(docs, clusters, classes, n, tenths, most_docs, most_grams, few)
    forget(clusters)
    roots = stored(components(links))
    forget(links)
    named = classes.select("fp", "least").join(roots.withColumnRenamed("id", "fp"), "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    whole = roots.join(named, "root").select(F.col("id").alias("fp"), "component_id")
    alone = classes.select("fp", "least")
    whole = alone.join(whole, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(whole, "fp", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: join() of three words at 0.9, by an inverted index: all pairs that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
  FROM w),
u AS (SELECT r, len(g) AS n, unnest(g) AS g FROM s),
links AS (
  SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.g = b.g AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_id AS (SELECT reach.x, min(s.doc_id) AS c FROM reach JOIN s ON s.r = reach.y GROUP BY reach.x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM s LEFT JOIN least_id ON s.r = least_id.x
"""
