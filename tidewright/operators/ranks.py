"""Exact running counts and quantiles of values, with no task that holds all values of a key.

Values are counted first: a distinct value of a key is one row. Its rows are dealt to
ranges of the value, whose cuts are approximate quantiles of all of them; each range is summed
up, the sums of the ranges below are its offset, and only a range is a window. So the numbers
are exact wherever the cuts lie; those decide how even the ranges are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should have, and how many ranges there are at most.
RANGE_ROWS = 100_000
RANGES = 4096
_SPLITS = 16


def place_among(value: Column, cuts: list[float]) -> Column:
    """How many of the rising cuts are not above the value; null and what is below all are 0. Two short looks instead of one at every cut."""
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if not groups:
        return F.lit(0)
    which = F.size(F.filter(F.lit([g[0] for g in groups]), lambda c: c <= value))
    inside = F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), which - 1), lambda c: c <= value))
    return F.when(value.isNull() | (which == 0), 0).otherwise((which - 1) * wide + inside)


def range_cuts(counts: DataFrame, value: str) -> list[float]:
    """Cuts for one range of each RANGE_ROWS rows: a number for each range on the driver."""
    known = counts.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    many = min(RANGES, -(-known.count() // RANGE_ROWS))
    if many < 2:
        return []
    found = known.agg(F.percentile_approx(F.col(value).cast("double"), [i / many for i in range(1, many)], 20 * many)).first()[0]
    return sorted(set(found or []))


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts``, a row for each distinct value of a key, with ``upto_`` each of ``sums``: its sum over the key's values up to and with this one."""
    placed = counts.withColumn("_range", place_among(F.col(value).cast("double"), range_cuts(counts, value)))
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_all_{s}") for s in sums])
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"), *[F.coalesce(F.sum(f"_all_{s}").over(below), F.lit(0)).alias(f"_below_{s}") for s in sums])
    same = placed["_range"] == offsets["_of_range"]
    for k in keys:
        same = same & placed[k].eqNullSafe(offsets[f"_of_{k}"])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.join(offsets, same)
    return local.select(*counts.columns, *[(F.sum(s).over(inside) + F.col(f"_below_{s}")).alias(f"upto_{s}") for s in sums])


def quantiles(long: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each named share): interpolated quantiles of a key's values, of which none is null."""
    if not keys:
        return quantiles(long.withColumn("_all", F.lit(0)), ["_all"], value, shares).drop("_all")
    counts = long.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running(counts, keys, value, ["n"])
    totals = counts.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
    same = F.lit(True)
    for k in keys:
        same = same & ranked[k].eqNullSafe(totals[f"_of_{k}"])
    placed = ranked.join(totals, same)
    cells = []
    for name, q in shares.items():
        at = (F.col("_total") - 1) * q
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: F.max(F.when((F.col("upto_n") > k) & (F.col("upto_n") - F.col("n") <= k), F.col(value)))
        cells.append((holds(low) + (holds(high) - holds(low)) * F.max(at - low)).alias(name))
    return placed.groupBy(*keys).agg(*cells)


def set_medians(counts: DataFrame, member: str, value: str, sets: list[frozenset]) -> list[float | None]:
    """The exact median of each set's values, from ``counts`` (member, value, n); a set is of members.

    All sets at once: values are counted by member and interval, which is what the driver gets,
    and each set's two middle values are in intervals that its members' counts tell; those intervals are parted
    again until each has one value. What a row costs does not depend on how many sets there are but by the
    logarithm of the number of cuts.
    """
    known = counts.where(F.col(value).isNotNull()).select(F.col(member).alias("m"), F.col(value).cast("double").alias("v"), "n").where(~F.isnan("v"))
    cuts = known.agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 10_000)).first()[0]
    if cuts is None:
        return [None] * len(sets)
    known_cuts = sorted(set(cuts))
    totals = {r["m"]: r["n"] for r in known.groupBy("m").agg(F.sum("n").alias("n")).collect()}
    wanted: dict[tuple[int, int], float | None] = {}
    for i, own in enumerate(sets):
        total = sum(totals.get(m, 0) for m in own)
        wanted |= {(i, k): None for k in {(total - 1) // 2, total // 2} if total}
    while True:
        held = known.groupBy("m", place_among(F.col("v"), known_cuts).alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        of: dict[int, dict] = {}
        for r in held:
            of.setdefault(r["m"], {})[r["part"]] = r
        more = set()
        for (i, k), found in wanted.items():
            if found is not None:
                continue
            below = 0
            for part in sorted({p for m in sets[i] for p in of.get(m, {})}):
                rows = [of[m][part] for m in sets[i] if part in of.get(m, {})]
                n = sum(r["n"] for r in rows)
                if below + n > k:
                    least, most = min(r["least"] for r in rows), max(r["most"] for r in rows)
                    if least == most:
                        wanted[i, k] = least
                    else:
                        # at least one cut parts them: the largest value is one
                        more |= {min(max(least + (most - least) * s / _SPLITS, least), most) for s in range(1, _SPLITS)} - {least} | {most}
                    break
                below += n
        if not more:
            break
        known_cuts = sorted({*known_cuts, *more})
    out = []
    for i, own in enumerate(sets):
        total = sum(totals.get(m, 0) for m in own)
        out.append((wanted[i, (total - 1) // 2] + wanted[i, total // 2]) / 2 if total else None)
    return out
