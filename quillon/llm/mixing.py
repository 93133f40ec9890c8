"""Sampling documents so that token weights meet source, language and topic marginals: iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillon.llm.common import fields, stored, whole_row

AXES = ("source", "lang", "topic")
ADDED = ("topic", "n_tokens", "weight", "probability")
#: Distinct (source, lang, topic) triples, which are fitted in one row; and how many of them are broadcast to the documents.
MOST_CELLS, FEW_CELLS = 1_000_000, 100_000

Targets = dict[str, dict[str, float]]


def occurrences(text: Column, mark: str) -> Column:
    """How often an ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def topic_of(text: Column, lang: Column) -> Column:
    """The production topic: the register of a text by its layout, found by built-in functions only.

    table: at least 5 vertical bars; list: at least 20 lines; short: under 600 bytes; long: over 6,000; else prose.
    """
    lines, bars = occurrences(text, "\n"), occurrences(text, "|")
    size = F.octet_length(text)
    return F.when(bars >= 5, "table").when(lines >= 20, "list").when(size < 600, "short").when(size > 6000, "long").otherwise("prose")


def _marked(docs: DataFrame, topic: Column | None, tokens: Column | None) -> DataFrame:
    """row, id, the three axes and tokens: names of the input stay inside row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    axes = [docs["source"], docs["lang"], topic if topic is not None else topic_of(text, docs["lang"])]
    count = tokens if tokens is not None else occurrences(text, " ") + occurrences(text, "\n") + 1
    return docs.select(
        whole_row(docs).alias("row"),
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"),
        *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(a) for c, a in zip(axes, AXES, strict=True)],
        F.greatest(F.coalesce(count.cast("bigint"), F.lit(1)), F.lit(1)).alias("tokens"),
    )


def _goal(axis: str, targets: Targets, temper: float) -> Column:
    """The unnormalised target of a value: as given; what a given axis leaves open goes to its other values by tokens."""
    given = targets.get(axis)
    if given is None:
        return F.pow("natural", F.lit(temper))
    if min(given.values(), default=0) < 0 or sum(given.values()) > 1 + 1e-9:
        raise ValueError(f"targets of {axis} must be shares of 1")
    known = F.create_map(*[F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))]) if given else F.lit(None).cast("map<string,double>")
    mine = F.element_at(known, F.col(axis)) if given else F.lit(None).cast("double")
    others = F.sum(F.when(mine.isNull(), F.col("natural"))).over(_everything())
    left = max(0.0, 1 - sum(given.values()))
    return F.coalesce(mine, F.lit(left) * F.col("natural") / others)


def _everything() -> WindowSpec:
    return Window.partitionBy()


def _one(df: DataFrame) -> DataFrame:
    """Stored rows in one partition, which grouping, windows and joins then needn't shuffle: values and cells only."""
    return stored(df).coalesce(1)


def _filled(goals: Column, budget: Column, most: Column) -> Column:
    """The factor c for which the sum of min(natural, c * goal) over (natural, goal) pairs is the budget: water filling.

    From 0 up, values that would pass their natural tokens are full, and c follows from the others; as c only grows,
    one step per value is enough.
    """

    def step(c: Column, _: Column) -> Column:
        full = F.aggregate(goals, F.lit(0.0), lambda s, g: s + F.when(c * g["goal"] >= g["natural"], g["natural"]).otherwise(0.0))
        rest = F.aggregate(goals, F.lit(0.0), lambda s, g: s + F.when(c * g["goal"] >= g["natural"], 0.0).otherwise(g["goal"]))
        return F.when(rest > 0, F.greatest(c, (budget - full) / rest)).otherwise(c)

    return F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), step)


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _fitted(by_axis: Column, cap: float, sweeps: int) -> Column:
    """Factors per axis and value for which the sums of tokens * min(cap, product of the factors) meet the goals.

    One step sets the factors of one axis: what a value lacks beside its capped cells, over what its other cells give.
    """

    def share(f: Column, c: Column) -> Column:
        at = lambda axis: F.element_at(F.element_at(f, axis + 1), c["at"][axis] + 1)
        return at(0) * at(1) * at(2)

    def values(f: Column, axis: Column) -> Column:
        def factor(group: Column, i: Column) -> Column:
            each = F.transform(group["cells"], lambda c: F.struct(c["tokens"].alias("tokens"), share(f, c).alias("share")))
            capped = lambda c: c["share"] >= cap
            add = lambda s, c: F.struct(
                (s["full"] + F.when(capped(c), c["tokens"]).otherwise(0.0)).alias("full"),
                (s["part"] + F.when(capped(c), 0.0).otherwise(c["tokens"] * c["share"])).alias("part"),
            )
            sums = F.aggregate(each, F.struct(F.lit(0.0).alias("full"), F.lit(0.0).alias("part")), add)
            return _let(sums, lambda s: scaled(F.element_at(F.element_at(f, axis + 1), i + 1), group["goal"], s["full"], s["part"]))

        # All capped and more than the goal: shrink in proportion, so that some are capped no longer.
        def scaled(old: Column, goal: Column, full: Column, part: Column) -> Column:
            return F.when(full > goal, old * goal / (full + part)).when(part > 0, old * (goal - full) / part).otherwise(old)

        return F.transform(F.element_at(by_axis, axis + 1), factor)

    start = F.transform(by_axis, lambda groups: F.transform(groups, lambda g: F.lit(1.0)))
    step = lambda f, k: F.transform(f, lambda old, axis: F.when(axis == F.pmod(k, F.lit(3)), values(f, axis)).otherwise(old))
    return F.aggregate(F.sequence(F.lit(0), F.lit(3 * sweeps - 1)), start, step)


def fit(cells: DataFrame, share: float = 0.8, temper: float = 0.7, sweeps: int = 20, targets: Targets | None = None) -> tuple[DataFrame, DataFrame]:
    """(weight and probability per cell, the report) for cells (source, lang, topic, tokens).

    Report: per axis and value the natural tokens, the goal (share of the sample), the share that can be reached, and
    that which the probabilities give in expectation.
    """
    targets = targets or {}
    if unknown := set(targets) - set(AXES):
        raise ValueError(f"no axis {sorted(unknown)}")
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    total, cells = F.sum("natural").over(_everything()), cells.coalesce(1)
    values = None
    for axis in AXES:
        own = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("natural")).withColumn("raw", _goal(axis, targets, temper))
        one = own.select(F.lit(axis).alias("axis"), F.col(axis).alias("value"), "natural", (F.col("raw") / F.sum("raw").over(_everything())).alias("goal"), total.alias("total"))
        values = one if values is None else values.union(one).coalesce(1)
    # All values of an axis meet in one row: at most MOST_CELLS, never documents.
    per_axis = values.groupBy("axis", "total").agg(F.sort_array(F.collect_list(F.struct("value", "natural", "goal"))).alias("values"))
    budget = F.lit(share) * F.col("total")
    pairs = F.transform("values", lambda v: F.struct(v["natural"].alias("natural"), (v["goal"] + 0.0).alias("goal")))
    per_axis = per_axis.withColumn("c", _filled(pairs, budget, F.size("values")))
    reach = lambda v: F.least(v["natural"], F.col("c") * v["goal"])
    listed = F.transform("values", lambda v: F.struct(v["value"].alias("value"), v["natural"].alias("natural"), v["goal"].alias("goal"), reach(v).alias("reach")))
    per_axis = _one(per_axis.select("axis", "total", listed.alias("values")))
    numbered = per_axis.select("axis", "total", F.posexplode("values").alias("i", "v")).select("axis", "total", "i", "v.*")
    placed = cells
    for axis in AXES:
        mine = numbered.where(F.col("axis") == axis).select(F.col("value").alias(axis), F.col("i").alias(f"at_{axis}"))
        placed = placed.join(mine, axis)
    placed = _one(placed.select(*AXES, F.col("tokens").cast("double").alias("tokens"), F.array(*[f"at_{a}" for a in AXES]).alias("at")))
    long = placed.select(F.posexplode(F.col("at")).alias("number", "i"), "tokens", "at")
    grouped = long.groupBy("number", "i").agg(F.collect_list(F.struct("tokens", "at")).alias("cells"))
    goals = numbered.select(F.array_position(F.array(*map(F.lit, AXES)), F.col("axis")).alias("number1"), F.col("i").alias("i1"), "reach", (F.col("goal") * F.col("total")).alias("want"))
    joined = grouped.join(goals, (F.col("number") + 1 == F.col("number1")) & (F.col("i") == F.col("i1")))
    rows = joined.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("i", "reach", "want", "cells"))).alias("groups"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("number", "groups"))).alias("axes"))
    by = lambda name: F.transform("axes", lambda a: F.transform(a["groups"], lambda g: F.struct(g[name].alias("goal"), g["cells"].alias("cells"))))
    whole = _one(whole.select(by("reach").alias("reach"), by("want").alias("want")))
    factors = _one(whole.select(_fitted(F.col("reach"), 1.0, sweeps).alias("bounded"), _fitted(F.col("want"), 1e300, sweeps).alias("free")))
    one_row = factors.select(F.posexplode("bounded").alias("number", "b"), "free").select(
        "number", F.posexplode(F.arrays_zip("b", F.element_at("free", F.col("number") + 1).alias("f"))).alias("i", "both")
    )
    one_row = _one(one_row.select("number", "i", F.col("both.b").alias("b"), F.col("both.f").alias("f")))
    p, w = F.lit(1.0), F.col("tokens")
    out = placed
    for k, axis in enumerate(AXES):
        mine = one_row.where(F.col("number") == k).select(F.col("i").alias(f"i_{axis}"), F.col("b").alias(f"b_{axis}"), F.col("f").alias(f"f_{axis}"))
        out = out.join(mine, F.col("at")[k] == F.col(f"i_{axis}"))
        p, w = p * F.col(f"b_{axis}"), w * F.col(f"f_{axis}")
    fitted = _one(out.select(*AXES, "tokens", (w / F.sum(w).over(_everything())).alias("weight"), F.least(F.lit(1.0), p).alias("p")))
    expected = F.stack(F.lit(3), *[x for a in AXES for x in (F.lit(a), F.col(a))]).alias("axis", "value")
    got = fitted.select(expected, (F.col("p") * F.col("tokens")).alias("e")).groupBy("axis", "value").agg(F.sum("e").alias("e"))
    report = numbered.join(got, ["axis", "value"]).select(
        "axis",
        "value",
        F.col("natural").cast("bigint").alias("natural"),
        "goal",
        (F.col("reach") / (F.col("total") * share)).alias("reachable"),
        (F.col("e") / (F.col("total") * share)).alias("expected"),
    )
    return fitted.select(*AXES, "weight", "p"), report


def mix(
    docs: DataFrame,
    share: float = 0.8,
    temper: float = 0.7,
    sweeps: int = 20,
    topic: Column | None = None,
    seed: int = 1,
    targets: Targets | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """Adds topic, n_tokens, weight and probability, and keeps each document with its probability.

    1. Token counts (``tokens``, or pieces of the text between blanks and line ends; at least 1) are summed per cell
       (source, lang, topic): one partially aggregated shuffle, so a source with a third of all rows moves as one row
       per task and cell.
    2. Goals are ``targets``, shares of the sample by axis and value (values that an axis doesn't name get what is left,
       by tokens; values without documents are left out), or the natural shares to the power ``temper``, made to sum
       to 1. Raking scales the cells' weights to each axis' goals in turn, ``sweeps`` times: ``weight``, which sums to 1.
    3. No document is repeated, so no cell can give more than its tokens. An axis value whose goal exceeds its own
       tokens has them all as its reachable share, and what it lacks goes to the others in proportion. Raking is
       repeated to these under the bound: a cell's probability is min(1, the product of its three axis factors).
       Expected tokens sum to ``share`` of all. ``report`` says what each value gets.
    4. A document is kept if a hash of its id and the seed is below its cell's probability, so the sample's shares
       scatter about the expected ones, the more the fewer documents a value has.

    Only DataFrame operations; cells, never documents, meet in one row, where built-in functions rake them. More than
    MOST_CELLS distinct triples are refused: an axis should be coarser. Nulls on an axis are the value ``unknown``; null
    and empty texts have one token. Equal ids have equal fates; repeated rows stay or go together. Columns of the input
    stay as they are, whatever their names, but for those with the four names added here, which are replaced. An empty
    table gives an empty result.
    """
    marked = _marked(docs, topic, tokens)
    cells = _cells(marked)
    fitted, _ = fit(cells, share, temper, sweeps, targets)
    fitted = F.broadcast(fitted) if cells.count() <= FEW_CELLS else fitted
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    kept = marked.join(fitted, list(AXES)).where(unit < F.col("p"))
    names = [n for n in docs.columns if n not in ADDED]
    return kept.select(*fields("row", names), "topic", F.col("tokens").alias("n_tokens"), "weight", F.col("p").alias("probability"))


def report(docs: DataFrame, share: float = 0.8, temper: float = 0.7, sweeps: int = 20, topic: Column | None = None, targets: Targets | None = None, tokens: Column | None = None) -> DataFrame:
    """axis, value, natural tokens, and shares of the sample: goal, reachable and expected. The shortfall is goal - expected."""
    return fit(_cells(_marked(docs, topic, tokens)), share, temper, sweeps, targets)[1]


def _cells(marked: DataFrame) -> DataFrame:
    cells = stored(marked.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    if (n := cells.count()) > MOST_CELLS:
        raise ValueError(f"{n} distinct (source, lang, topic) triples; at most {MOST_CELLS} can be raked")
    return cells
