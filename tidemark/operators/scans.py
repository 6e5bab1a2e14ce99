"""Windows over one entity's rows, split by a coarse part of their order where an entity is too large for a task.

A bucket is a part of an entity's order: a month, a stretch of running counts. Windows run within (entity, bucket); a
row a bucket carries totals and the last rows (the halo) on to later buckets, and the first row back to earlier ones.
Entities that are not large are one bucket: they pay for a count of rows and for nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that any entity may have in one task, and the number of larger ones that are split: the largest. Of the rest each
#: has fewer than one row in LARGEST.
FEW, LARGEST = 1 << 20, 1024


def large_entities(rows: DataFrame, entity: str, few: int | None = None) -> Column | bool:
    """Whether a row's entity is one of the LARGEST that have more than `few` rows (FEW): False if none has.

    It counts at once, so that plans over tables without large entities have no part for them; LARGEST keys at most
    come to the driver.
    """
    few = FEW if few is None else few
    counts = rows.groupBy(F.col(entity).alias("_e")).agg(F.count("*").alias("_n")).where(F.col("_n") > few)
    found = [r["_e"] for r in counts.orderBy(F.desc("_n"), "_e").limit(LARGEST).collect()]
    if not found:
        return False
    known = F.coalesce(F.col(entity).isin([x for x in found if x is not None]), F.lit(False))
    return known | F.col(entity).isNull() if None in found else known


@dataclass(frozen=True)
class Scan:
    """What a scan adds. Column names are the keys; k counts rows.

    totals: sum over all rows before (0 before any, null values count 0). lags: value k rows before. leads: value of the
    next row. recent: of the last k rows before the row, a struct (mean of the known values or null, their total, their number n).
    """

    totals: dict[str, Column] = field(default_factory=dict)
    lags: dict[str, tuple[Column, int]] = field(default_factory=dict)
    leads: dict[str, Column] = field(default_factory=dict)
    recent: dict[str, tuple[Column, int]] = field(default_factory=dict)


def scanned(df: DataFrame, entity: list[str], bucket: Column, order: list[str | Column], scan: Scan, large: Column | bool = True, source: DataFrame | None = None) -> DataFrame:
    """df with the columns of scan. bucket must not fall along the order; a null one comes first, as do null orders.

    large says which rows' entities are split (by the entity alone): all, none, or as large_entities says. source has the
    rows of df with what bucket, order and scan read, where that is cheaper to make than df. Rows of an entity that its
    order does not tell apart are taken in any order. A null entity is one entity.
    """
    keys = [F.col(e) for e in entity]
    split = F.lit(large) if isinstance(large, bool) else large
    # Where nothing is split, rows are dealt by the entity alone, and what comes next by entity finds them so.
    marked = {} if large is False else {"_h": split.cast("int"), "_b": F.when(split, bucket)}
    part = Window.partitionBy(*keys, *marked).orderBy(*order)
    before, all_rows = part.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys, *marked)
    values = {**{o: v for o, (v, _) in scan.lags.items()}, **{o: v for o, (v, _) in scan.recent.items()}}
    longest = max([k for _, k in (*scan.lags.values(), *scan.recent.values())], default=0)

    own: dict[str, Column] = {"_pos": F.row_number().over(part)}
    own |= {f"_t_{o}": F.coalesce(F.sum(v).over(before), F.lit(0)) for o, v in scan.totals.items()}
    own |= {f"_l_{o}": F.lag(v, k).over(part) for o, (v, k) in scan.lags.items()}
    own |= {f"_f_{o}": F.lead(v).over(part) for o, v in scan.leads.items()}
    for o, (v, k) in scan.recent.items():
        near = part.rowsBetween(-k, -1)
        own |= {f"_s_{o}": F.coalesce(F.sum(v).over(near), F.lit(0)), f"_n_{o}": F.count(v).over(near)}
    if scan.leads:
        own["_size"] = F.count(F.lit(1)).over(all_rows)
    inside = df.withColumns(marked).select("*", *[c.alias(n) for n, c in own.items()])

    if large is False:
        none = {**{f"_c_{o}": "long" for o in scan.totals}}
        both = inside.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    else:
        rows = (df if source is None else source).where(split).withColumns(marked)
        both = _with_starts(inside, rows, entity, part, order, scan, values, longest)

    pos, out = F.col("_pos"), []
    for o in scan.totals:
        out.append((F.col(f"_t_{o}") + F.coalesce(F.col(f"_c_{o}"), F.lit(0))).alias(o))
    if large is False:
        out += [F.col(f"_l_{o}").alias(o) for o in scan.lags] + [F.col(f"_f_{o}").alias(o) for o in scan.leads]
        for o in scan.recent:
            total, n = F.col(f"_s_{o}").cast("double"), F.col(f"_n_{o}").cast("long")
            out.append(F.struct(F.try_divide(total, n.cast("double")).alias("mean"), total.alias("total"), n.alias("n")).alias(o))
        return both.select(*df.columns, *out)
    for o, (_, k) in scan.lags.items():
        out.append(F.when(pos > k, F.col(f"_l_{o}")).otherwise(F.get("_halo", F.lit(k) - pos)[o]).alias(o))
    for o in scan.leads:
        out.append(F.when(pos < F.col("_size"), F.col(f"_f_{o}")).otherwise(F.col("_next")[o]).alias(o))
    none = F.array().cast("array<double>")
    for o, (_, k) in scan.recent.items():
        lacks = F.greatest(F.lit(k + 1) - pos, F.lit(0))
        there = F.when((lacks > 0) & F.col("_halo").isNotNull(), F.filter(F.slice(F.col("_halo")[o], F.lit(1), lacks), lambda v: v.isNotNull()).cast("array<double>")).otherwise(none)
        n = (F.col(f"_n_{o}") + F.size(there)).cast("long")
        total = F.col(f"_s_{o}").cast("double") + F.aggregate(there, F.lit(0.0), lambda a, v: a + v)
        out.append(F.struct(F.try_divide(total, n.cast("double")).alias("mean"), total.alias("total"), n.alias("n")).alias(o))
    return both.select(*df.columns, *out)


def _with_starts(inside: DataFrame, rows: DataFrame, entity: list[str], part: Window, order: list[str | Column], scan: Scan, values: dict[str, Column], longest: int) -> DataFrame:
    """inside with what a row's earlier buckets carry on to it; rows are those of the entities that are split."""
    keys, all_rows = [F.col(e) for e in entity], Window.partitionBy(*entity, "_h", "_b")
    # A row a bucket: its totals, its last rows (newest last), its first row.
    ends: dict[str, Column] = {f"_t_{o}": F.coalesce(F.sum(v).over(all_rows), F.lit(0)) for o, v in scan.totals.items()}
    if longest:
        ends["_tail"] = F.collect_list(F.struct(*[v.alias(o) for o, v in values.items()])).over(part.rowsBetween(-(longest - 1), 0))
    if scan.leads:
        ends["_first"] = F.first(F.struct(*[v.alias(o) for o, v in scan.leads.items()])).over(part.rowsBetween(Window.unboundedPreceding, 0))
    last = rows.select(*keys, "_h", "_b", F.lead(F.lit(1)).over(part).alias("_more"), *[c.alias(n) for n, c in ends.items()]).where("_more is null")
    along = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first())
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = [F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_c_{o}") for o in scan.totals]
    if longest:
        tails = F.flatten(F.collect_list("_tail").over(along.rowsBetween(-longest, -1)))
        carried.append(F.slice(F.reverse(tails), 1, longest).alias("_halo"))  # newest first
    if scan.leads:
        carried.append(F.lead("_first").over(along).alias("_next"))
    starts = last.select(*[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)], F.col("_h").alias("_eh"), F.col("_b").alias("_eb"), *carried)
    on = F.col("_b").eqNullSafe(F.col("_eb")) & F.col("_h").eqNullSafe(F.col("_eh"))
    for i, e in enumerate(entity):
        on = F.col(e).eqNullSafe(F.col(f"_e{i}")) & on
    return inside.join(starts, on, "left")
