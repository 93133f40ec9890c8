"""Personal data: exact base spans, and terms that reveal a protected value by how the corpus uses them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import LOWER, U64, Bloom, Cache, arrow, documents, fields, stored, trimmed, whole_row

KINDS = ("email", "ip", "card", "phone")
#: A term must occur with a value on so many lines.
LINES = 3
#: The share of a value's information content that a term may reveal: pointwise mutual information over -log p(value).
DISCLOSURE = 0.9

# The stated patterns with possessive repeats and fixed starts, which match the same and stay linear on long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: So many revealing terms, a few MB, are broadcast.
FEW_TERMS = 50_000

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind; leftmost non-overlapping matches of each kind that pass its test."""
    out: list[tuple[int, int, int]] = []
    mail, digits = "@" in text, _DIGIT.search(text) is not None
    if not (mail or digits):
        return []
    if mail:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                last = m.end()
                out.append((start, 0, last))
    if not digits:
        return [(s, e, KINDS[k]) for s, k, e in out]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def term(word: bytes) -> bytes | None:
    """A word as a term: without punctuation at its ends, A-Z lower; None if short."""
    t = word.strip(_EDGE)
    return None if len(t) < 3 else t.translate(LOWER)


def entity(kind: str, value: str) -> str:
    """A value under one spelling: addresses in lower case, numbers without signs, zeros before an address' parts or blanks."""
    if kind == "email":
        return f"{kind}:{value.lower()}"
    return f"{kind}:" + (".".join(str(int(x)) for x in value.split(".")) if kind == "ip" else "".join(c for c in value if c in "0123456789"))


def lines_of(text: str, base: list[Span]) -> Iterator[tuple[str, list[Span], set[str]]]:
    """(line, base spans in the line, entities there) for every line that isn't blank. No base span has a line end in it."""
    at, k = 0, 0
    base = sorted(base)
    for line in text.split("\n"):
        end, own = at + len(line), []
        while k < len(base) and base[k][0] < end:
            own.append((base[k][0] - at, base[k][1] - at, base[k][2]))
            k += 1
        at = end + 1
        if _WORD.search(line):
            yield line, own, {entity(kind, line[s:e]) for s, e, kind in own}


def terms_of(line: str, base: list[Span]) -> set[str]:
    """The distinct terms among the words outside the base spans."""
    return {t for _, t in _outside(line, base)}


def _outside(text: str, base: list[Span]) -> Iterator[tuple[re.Match, str]]:
    """(word, its term) outside the base spans."""
    apart: list[list[int]] = []
    for start, end, _ in sorted(base):
        if apart and start < apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], end)
        else:
            apart.append([start, end])
    k = 0
    for m in _WORD.finditer(text):
        while k < len(apart) and apart[k][1] <= m.start():
            k += 1
        if k < len(apart) and apart[k][0] < m.end():
            continue
        if t := term(m[0].encode("utf-8", "surrogatepass")):
            yield m, t.decode("utf-8", "replace")


def maybe_in(bits: np.ndarray) -> Callable[[bytes], str | None]:
    """word -> its term, if a filter may hold that."""
    import xxhash

    raw = bits.tobytes()

    def look(word: bytes) -> str | None:
        t = term(word)
        return t.decode("utf-8", "replace") if t and Bloom.maybe(raw, xxhash.xxh3_64_intdigest(t)) else None

    return look


def revealing(docs: DataFrame, reach: float = DISCLOSURE, least: int = LINES) -> DataFrame:
    """(term): terms that reveal some protected value beyond the threshold.

    Every base value of the corpus, however spelt, is an entity. All counts are of lines, each as often as it occurs:
    c(e) of those with e, c(t) of those with t outside base spans, c(e, t) of those with both, N of all that aren't
    blank. Pointwise mutual information log(N c(e,t) / (c(e) c(t))) is how much t tells of e; the term is revealing if
    that is at least ``reach`` of e's information content log(N / c(e)) and c(e, t) is ``least`` or more.
    Pairs are made only of entities, and c(t) is taken only of terms, that a Bloom filter of those with ``least``
    lines may hold; both are exact after the joins.
    """
    context = docs.sparkSession.sparkContext

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text in b.column(1).to_pylist():
                if base := base_spans(text or ""):
                    for _, _, held in lines_of(text, base):
                        found.update(held)
            yield arrow({"entity": list(found), "n": list(found.values())}, {"entity": pa.string(), "n": pa.int64()})

    of_entity = stored(docs.mapInArrow(trimmed(entities), "entity string, n bigint").groupBy("entity").agg(F.sum("n").alias("n_entity")).where(F.col("n_entity") >= least))
    wanted = context.broadcast(Bloom.build(of_entity.select("entity").mapInArrow(_keyed, "key bigint"), "key"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = {"entity": pa.string(), "term": pa.string(), "n": pa.int64()}
        out: Counter = Counter()
        raw = wanted.value.tobytes()

        def ready() -> pa.RecordBatch:
            made = arrow({"entity": [e for e, _ in out], "term": [t for _, t in out], "n": list(out.values())}, kinds)
            out.clear()
            return made

        for b in batches:
            for text in b.column(1).to_pylist():
                if not (base := base_spans(text or "")):
                    continue
                for line, own, held in lines_of(text, base):
                    held = [e for e in held if Bloom.maybe(raw, xxhash.xxh3_64_intdigest(e.encode("utf-8", "surrogatepass")))]
                    terms = terms_of(line, own) if held else ()
                    for e in held:
                        out.update((e, t) for t in terms)
                        if len(out) > 200_000:
                            yield ready()
        yield ready()

    pairs = docs.mapInArrow(trimmed(near), "entity string, term string, n bigint").groupBy("entity", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    candidates = stored(pairs.join(of_entity, "entity"))
    bits = context.broadcast(Bloom.build(candidates.select("term").distinct().mapInArrow(_keyed, "key bigint"), "key"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(maybe_in(bits.value))
        for b in batches:
            terms: Counter = Counter()
            for text in b.column(1).to_pylist():
                text = text or ""
                if not any(map(known.__getitem__, text.encode("utf-8", "surrogatepass").split())):
                    terms[""] += sum(_WORD.search(x) is not None for x in text.split("\n"))
                    continue
                for line, own, _ in lines_of(text, base_spans(text)):
                    terms[""] += 1
                    if any(map(known.__getitem__, line.encode("utf-8", "surrogatepass").split())):
                        terms.update(t for t in terms_of(line, own) if known[t.encode("utf-8", "surrogatepass")])
            yield arrow({"term": list(terms), "n": list(terms.values())}, {"term": pa.string(), "n": pa.int64()})

    counts = stored(docs.mapInArrow(trimmed(totals), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term")))
    total = counts.where(F.col("term") == "").agg(F.sum("n_term")).first()[0] or 1
    pmi = F.log(F.lit(float(total)) * F.col("n") / (F.col("n_entity") * F.col("n_term")))
    content = F.log(F.lit(float(total)) / F.col("n_entity"))
    return stored(candidates.join(counts, "term").where((pmi > 0) & (pmi >= reach * content)).select("term").distinct())


def term_spans(text: str, base: list[Span], terms: set[str] | frozenset[str]) -> list[Span]:
    """Occurrences of terms outside the base spans."""
    out, edge = [], _EDGE.decode()
    for m, t in _outside(text, base):
        if t in terms:
            inner = m[0].strip(edge)
            start = m.start() + m[0].index(inner)
            out.append((start, start + len(inner), "term"))
    return out


def spans(docs: DataFrame, reach: float = DISCLOSURE, least: int = LINES, few: int = FEW_TERMS) -> DataFrame:
    """doc_id, text, the whole row as ``row`` and ``spans``, an array of (start, end, kind) in code points by start, for every row.

    Kinds are those of base_spans, and ``term`` for terms that reveal a protected value (see ``revealing``). Up to
    ``few`` terms are broadcast; of more, those that a text may hold by a Bloom filter are joined with the exact list,
    so that nothing of unbounded size is broadcast. Null text is empty and has no spans; repeated rows each keep
    theirs; an empty table gives none.
    """
    span = T.StructField("spans", T._parse_datatype_string("array<struct<start: bigint, end: bigint, kind: string>>"))
    return _found(docs, reach, least, few, lambda rest: T.StructType([*rest.fields, span]), lambda b, found: _with(b, 3, [_structs(f) for f in found]))


def _found(docs: DataFrame, reach: float, least: int, few: int, kind: Callable[[T.StructType], T.StructType], finish: Callable[[pa.RecordBatch, list[list[Span]]], pa.RecordBatch]) -> DataFrame:
    """What ``finish`` makes of batches of doc_id, text, row and of their texts' spans, in the worker that finds them; ``kind``: its columns."""
    others = docs.drop("text")
    narrow = [docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")]
    docs, rest = documents(docs), docs.select(*narrow, whole_row(others).alias("row"))
    made = kind(rest.schema)
    terms = revealing(docs, reach, least)
    context = docs.sparkSession.sparkContext
    if terms.count() <= few:
        exact = context.broadcast(frozenset(r.term for r in terms.collect()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def look(word: bytes) -> bool:
                t = term(word)
                return bool(t) and t.decode("utf-8", "replace") in exact.value

            known = Cache(look)
            for b in batches:
                found = []
                for t in b.column(1).to_pylist():
                    held = bool(exact.value) and any(map(known.__getitem__, (t or "").encode("utf-8", "surrogatepass").split()))
                    found.append(with_terms(t or "", base_spans(t or ""), exact.value if held else frozenset()))
                yield finish(b, found)

        return rest.mapInArrow(trimmed(mark), made)
    bits = context.broadcast(Bloom.build(terms.mapInArrow(_keyed, "key bigint"), "key"))

    def mark_maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, known = TaskContext.get().partitionId() << 40, Cache(maybe_in(bits.value))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            maybe = [sorted(set(filter(None, map(known.__getitem__, t.encode("utf-8", "surrogatepass").split())))) for t in texts]
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows), pa.array(maybe, pa.list_(pa.string()))], names=[*b.schema.names, "number", "maybe"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [with_terms(t or "", base_spans(t or ""), frozenset(x or ())) for t, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield finish(b, found)

    more = T.StructType([*rest.schema.fields, T.StructField("number", T.LongType()), T.StructField("maybe", T.ArrayType(T.StringType()))])
    marked = stored(rest.mapInArrow(mark_maybe, more))
    known = marked.select("number", F.explode("maybe").alias("term")).join(terms, "term", "left_semi").groupBy("number").agg(F.collect_set("term").alias("terms"))
    return marked.join(known, "number", "left").select("doc_id", "text", "row", "terms").mapInArrow(add, made)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        keys = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8")) for t in b.column(0).to_pylist()], U64)
        yield arrow({"key": keys.view(np.int64)}, {"key": pa.int64()})


def with_terms(text: str, base: list[Span], terms: frozenset[str]) -> list[Span]:
    if not terms:
        return base
    more = term_spans(text, base, terms)
    return sorted(base + more, key=lambda s: (s[0], (*KINDS, "term").index(s[2])))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _with(b: pa.RecordBatch, columns: int, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(found, _SPAN)], names=[*b.schema.names[:columns], "spans"])


def _structs(found: list[Span]) -> list[dict]:
    return [{"start": s, "end": e, "kind": k} for s, e, k in found]


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Of ``spans``: counts by kind, the hash of the base spans and all spans as text."""
    text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


def generalised(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, reach: float = DISCLOSURE, least: int = LINES, few: int = FEW_TERMS) -> DataFrame:
    """The rows as they came, whatever the names of their columns, but for spans generalised in ``text``.

    Null text stays null, empty text empty; repeated rows stay; an empty table gives an empty result. One worker a task
    finds the spans and replaces them: a second one would stay with the executor, as would the texts' way to it.
    """

    def replace(b: pa.RecordBatch, found: list[list[Span]]) -> pa.RecordBatch:
        texts = [None if t is None else generalised(t, f) for t, f in zip(b.column(1).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], names=["text", "row"])

    done = _found(docs, reach, least, few, lambda rest: T.StructType(rest.fields[1:]), replace)
    others = {n: c for n, c in zip(docs.columns, fields("row", docs.columns), strict=True) if n != "text"}
    return done.select(*[others.get(c, F.col("text")) for c in docs.columns])
