"""Exact percentiles at any size, in one way for every size.

A mergeable quantile sketch of each group brackets every wanted rank; one more
scan counts what lies between the brackets and keeps only the values inside them,
counted by value, so a value that many rows share is one row; the rank is then
picked exactly.  Where the brackets would still hold too many rows, each is
narrowed first by a sketch of its own rows.  A rank that its bracket missed, which
the sketches' error makes next to impossible, is seen and looked for again in a
wider one.  No row is sorted but those in brackets, and none is collected.
Infinities are ordinary values, NaN is a missing one.  Groups stay DataFrames, so
there may be any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taufold.sources.stage import stage

#: Size parameter of the sketches for up to four shares; it grows with their number, so that all brackets together hold a small part.
SKETCH = 2000
#: A bracket reaches beyond its rank on both sides by so many times the sketch's error at 99 % confidence.
REACH = 4.0
#: Rows of one group's brackets that one task picks from; above it brackets are narrowed by one more scan.
PICK_ROWS = 4_000_000


@dataclass(frozen=True)
class _Plan:
    """``grid``: a sketch is asked for so many quantiles, and brackets end at them; ``margin``: reach of a bracket as a share of the rows."""

    shares: tuple[float, ...]
    sketch: int
    grid: int
    margin: float

    @property
    def known(self) -> str:
        """The shares as SQL text; expressions over all of them are text too, which Spark reads at once."""
        return f"array({', '.join(f'{s!r}D' for s in self.shares)})"

    @property
    def kept(self) -> float:
        """Share of the rows that one bracket may hold."""
        return 2 * (self.margin + 1 / self.grid)


def _plan(shares: Sequence[float]) -> _Plan:
    sketch = min(SKETCH * max(1, -(-len(shares) // 4)), 65_000)
    error = 2.296 / sketch**0.9723
    return _Plan(tuple(sorted({float(s) for s in shares})), sketch, max(8, sketch // 4), REACH * error)


def _same(one: DataFrame, other: DataFrame, names: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in names:
        found = found & one[c].eqNullSafe(other[c])
    return found


def _quantiles(sketch: str, grid: int) -> Column:
    """All quantiles a bracket may end at; Spark takes only constant ranks."""
    # Read from one text: thousands of literals would slow every rule of the optimizer.
    ranks = F.split(F.lit(" ".join(str(i / grid) for i in range(grid + 1))), " ").cast("array<double>")
    return F.kll_sketch_get_quantile_double(sketch, ranks)


def _point(quantiles: str, place: str, grid: int) -> str:
    return f"{quantiles}[cast(greatest(0, least({grid}, {place})) AS int)]"


def _held(state: DataFrame, groups: Sequence[str]) -> tuple[DataFrame | dict, int, int]:
    """The brackets as a written table, or as plain numbers where there is one group; the size of the largest group; the number of groups."""
    if groups:
        table = stage(state, "quantile-brackets")
        seen = table.agg(F.max("size").alias("largest"), F.count("*").alias("groups")).first()
        return table, seen["largest"] or 0, seen["groups"]
    found = state.first()
    return ({"size": 0, "lo": [], "hi": []}, 0, 0) if found is None else (found.asDict(), found["size"], 1)


def _beside(rows: DataFrame, held: DataFrame | dict, groups: Sequence[str]) -> DataFrame:
    """Each row with size, lo and hi of its group."""
    if isinstance(held, dict):
        ends = {c: F.array(*[F.lit(v) for v in held[c]]).cast("array<double>") for c in ("lo", "hi")}
        return rows.withColumns({"size": F.lit(held["size"]).cast("long"), **ends})
    joined = rows.join(held, _same(rows, held, groups))
    return joined.select(*[rows[g].alias(g) for g in groups], "x", "size", "lo", "hi")


def _first_brackets(rows: DataFrame, plan: _Plan, groups: Sequence[str]) -> DataFrame:
    seen = rows.groupBy(*groups).agg(F.count("x").alias("size"), F.kll_sketch_agg_double("x", plan.sketch).alias("sketch"))
    low = _point("quantiles", f"floor((floor(s * (size - 1)) / size - {plan.margin!r}D) * {plan.grid})", plan.grid)
    high = _point("quantiles", f"ceil(((ceil(s * (size - 1)) + 1) / size + {plan.margin!r}D) * {plan.grid})", plan.grid)
    ends = [F.expr(f"transform({plan.known}, s -> {end})").alias(c) for c, end in (("lo", low), ("hi", high))]
    return seen.filter("size > 0").withColumn("quantiles", _quantiles("sketch", plan.grid)).select(*groups, "size", *ends)


def _narrower(rows: DataFrame, held: DataFrame | dict, plan: _Plan, groups: Sequence[str]) -> DataFrame:
    """Brackets from sketches of what lies strictly inside the present ones.

    An end holds its own rows apart: a value that many rows share is soon an end,
    and the sketch of the rest goes on narrowing.
    """
    count = range(len(plan.shares))
    sums = []
    for j in count:
        inner = f"x > lo[{j}] AND x < hi[{j}]"
        sums += [f"count_if(x <= lo[{j}]) AS upto{j}", f"count_if({inner}) AS inner{j}"]
        sums.append(f"kll_sketch_agg_double(CASE WHEN {inner} THEN x END, {plan.sketch}) AS sketch{j}")
    seen = _beside(rows, held, groups).groupBy(*groups, "size", "lo", "hi").agg(*[F.expr(e) for e in sums])
    seen = seen.withColumns({f"quantiles{j}": F.when(F.col(f"inner{j}") > 0, _quantiles(f"sketch{j}", plan.grid)) for j in count})
    los, his = [], []
    for j, share in enumerate(plan.shares):
        low, high = f"floor({share!r}D * (size - 1))", f"ceil({share!r}D * (size - 1))"
        near = _point(f"quantiles{j}", f"floor((try_divide({low} - upto{j}, inner{j}) - {plan.margin!r}D) * {plan.grid})", plan.grid)
        far = _point(f"quantiles{j}", f"ceil((try_divide({high} + 1 - upto{j}, inner{j}) + {plan.margin!r}D) * {plan.grid})", plan.grid)
        ends = "CASE WHEN {0} < upto{1} THEN lo[{1}] WHEN {0} >= upto{1} + inner{1} THEN hi[{1}] ELSE {2} END"
        los.append(ends.format(low, j, near))
        his.append(ends.format(high, j, far))
    changed = seen.select(*groups, "size", F.expr(f"array({', '.join(los)})").alias("lo"), F.expr(f"array({', '.join(his)})").alias("hi"))
    # Both ends rise with the share, whatever the single sketches' errors: brackets only get wider by this.
    rising = [f"transform(lo, (v, j) -> array_min(slice(lo, j + 1, {len(count)}))) AS lo", "transform(hi, (v, j) -> array_max(slice(hi, 1, j + 1))) AS hi"]
    return changed.selectExpr(*groups, "size", *rising)


def _next_start(first: int, last: int) -> str:
    """Start of the first bracket that ends at x or later, found by halving."""
    if first == last:
        return f"lo[{first}]"
    middle = (first + last) // 2
    return f"CASE WHEN x <= hi[{middle}] THEN {_next_start(first, middle)} ELSE {_next_start(middle + 1, last)} END"


def _picked(rows: DataFrame, held: DataFrame | dict, plan: _Plan, groups: Sequence[str]) -> DataFrame:
    """(groups, size, j, a, b): the values at both ranks of share j; no row or a NULL where the bracket missed a rank."""
    last = len(plan.shares) - 1
    # NaN stands after all numbers: behind the last bracket.
    start = F.expr(f"CASE WHEN x <= hi[{last}] THEN {_next_start(0, last)} ELSE double('NaN') END")
    marked = _beside(rows, held, groups).select(*groups, "size", "x", start.alias("start"))
    # Rows between brackets count just before the start of the next one.
    inside = F.col("x") >= F.col("start")
    marked = marked.select(*groups, "size", F.when(inside, F.col("x")).otherwise(F.col("start")).alias("place"), inside.alias("inside"))
    counted = marked.groupBy(*groups, "size", "place", "inside").agg(F.count("*").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*groups, "size").orderBy("place", "inside")))
    ranks = f"transform({plan.known}, (s, j) -> named_struct('j', j, 'low', floor(s * (size - 1)), 'high', ceil(s * (size - 1))))"
    here = "t.{0} < upto AND t.{0} >= upto - n"
    low, high = here.format("low"), here.format("high")
    hits = counted.filter("inside").select(*groups, "size", "place", "upto", "n", F.expr(f"explode(filter({ranks}, t -> ({low}) OR ({high})))").alias("t"))
    ends = [F.expr(f"max(CASE WHEN {which} THEN place END) AS {name}") for which, name in ((low, "a"), (high, "b"))]
    return hits.groupBy(*groups, "size", F.col("t.j").alias("j")).agg(*ends)


def _located(rows: DataFrame, plan: _Plan, groups: Sequence[str]) -> DataFrame:
    while True:
        held, largest, known = _held(_first_brackets(rows, plan, groups), groups)
        still = largest * plan.kept * len(plan.shares)
        while still > PICK_ROWS and plan.kept < 0.5:
            held = _held(_narrower(rows, held, plan, groups), groups)[0]
            still *= plan.kept
        if isinstance(held, dict) and not known:
            held |= {c: [0.0] * len(plan.shares) for c in ("lo", "hi")}
        found = stage(_picked(rows, held, plan, groups), "quantile-picked")
        if found.filter("a IS NOT NULL AND b IS NOT NULL").count() == known * len(plan.shares):
            return found
        plan = replace(plan, margin=min(1.0, plan.margin * 8))


def quantile_table(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` as rows (by..., share, value).

    NULL and NaN are missing; groups without a value have no rows.  ``df`` is read
    twice, by the needed columns only: pass a table, a stage table or a cheap plan
    over one, whose rows are the same each time.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    named = df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)], F.col(f"`{value}`").cast("double").alias("x"))
    rows = named.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    plan = _plan(shares)
    found = _located(rows, plan, groups)
    share = F.expr(plan.known)[F.col("j")]
    at = share * (F.col("size") - 1)
    a, b = F.col("a"), F.col("b")
    between = F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at)))
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], share.alias("share"), between.alias("value"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, list[float]]:
    """The same as {group key: [one number per share]}, for callers whose groups are the arms of a study; () without groups."""
    found: dict[tuple, dict[float, float]] = {}
    for r in quantile_table(df, value, shares, by).collect():
        found.setdefault(tuple(r[c] for c in by), {})[r["share"]] = r["value"]
    return {key: [own[float(s)] for s in shares] for key, own in found.items()}
