"""Running values, as-of lookups and range joins that stay parallel for a hot key.

A plain ``Window.partitionBy(video)`` puts a whole video in one task. Here every long scan runs in
two levels: rows are windowed inside ``(key, chunk)``; one small row per chunk is scanned across
the key and its result is joined back as the chunk's carry. A key with a third of all rows is thus
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS_PER_CHUNK = 4096
TILE_MS = 60_000


@dataclass(frozen=True)
class Scan:
    """One running value: ``sum``/``max``/``min`` over earlier rows, ``last`` non-null earlier
    value or ``first`` non-null later value. ``inclusive`` also looks at the current row."""

    kind: str
    value: Column
    inclusive: bool = False


def chunk_of(column: str, size: int) -> Column:
    return F.expr(f"`{column}` div {size}")


def chunk_in(words: DataFrame) -> Column:
    """The chunk of words: the column a stored table is bucketed by, or made from the position."""
    return F.col("chunk") if "chunk" in words.columns else chunk_of("pos", WORDS_PER_CHUNK)


def running(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, scans: dict[str, Scan]
) -> DataFrame:
    """Add the running values of ``scans`` over ``key`` in ``order``.

    ``chunk`` must never decrease along ``order``.
    """
    cell = [*key, "__chunk"]
    base = df.withColumn("__chunk", chunk)
    # Later values run backwards too: a frame to the end is evaluated afresh for every row.
    ahead = (Window.partitionBy(*cell).orderBy(*order), Window.partitionBy(*key).orderBy("__chunk"))
    behind = (Window.partitionBy(*cell).orderBy(*[F.desc(o) for o in order]),
              Window.partitionBy(*key).orderBy(F.desc("__chunk")))
    # A single number keeps the chunk totals in a hash aggregate.
    stamp = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    local, total, carry, final = {}, [], [], {}
    for name, s in scans.items():
        rows, chunks = behind if s.kind == "first" else ahead
        before = rows.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
        lc, tc, cc = f"__l_{name}", f"__t_{name}", f"__c_{name}"
        known = F.when(s.value.isNotNull(), stamp)
        if s.kind in ("sum", "max", "min"):
            agg = getattr(F, s.kind)
            local[lc] = agg(s.value).over(before)
            total.append(agg(s.value).alias(tc))
            carry.append(agg(tc).over(earlier).alias(cc))
            if s.kind == "sum":
                final[name] = F.coalesce(lc, F.lit(0)) + F.coalesce(cc, F.lit(0))
            else:
                pick = F.greatest if s.kind == "max" else F.least
                final[name] = pick(lc, cc)
        elif s.kind in ("last", "first"):
            pick = F.max_by if s.kind == "last" else F.min_by
            local[lc] = F.last(s.value, ignorenulls=True).over(before)
            total.append(pick(s.value, known).alias(tc))
            carry.append(F.last(tc, ignorenulls=True).over(earlier).alias(cc))
            final[name] = F.coalesce(lc, cc)
        else:
            raise ValueError(f"unknown scan kind {s.kind!r}")

    carries = base.groupBy(*cell).agg(*total).select(*cell, *carry)
    # Windows first: their (key, chunk) exchange also serves the join.
    out = base.select("*", *[c.alias(n) for n, c in local.items()]).join(carries, cell, "left")
    return out.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def asof(
    points: DataFrame,
    events: DataFrame,
    key: list[str],
    at: str,
    event_at: str,
    values: list[str],
    direction: str,
    tie: list[str],
    tile_ms: int = TILE_MS,
) -> DataFrame:
    """For every point the latest event with time <= point (``backward``) or the earliest with
    time >= point (``forward``); ``tie`` orders events of equal time. Unmatched points get NULL."""
    back = direction == "backward"
    packed = F.struct(*[F.col(v) for v in values])
    none = F.lit(None)
    ev = events.select(
        *key, F.col(event_at).alias("__t"), F.lit(0 if back else 1).alias("__src"),
        *[F.col(t).cast("long").alias(f"__tie{i}") for i, t in enumerate(tie)],
        packed.alias("__ev"), none.cast(_struct_of(points)).alias("__pt"),
    )
    pt = points.select(
        *key, F.col(at).alias("__t"), F.lit(1 if back else 0).alias("__src"),
        *[F.lit(0).cast("long").alias(f"__tie{i}") for i in range(len(tie))],
        none.cast(ev.schema["__ev"].dataType).alias("__ev"),
        F.struct(*[F.col(c) for c in points.columns]).alias("__pt"),
    )
    both = ev.unionByName(pt)
    order = ["__t", "__src", *[f"__tie{i}" for i in range(len(tie))]]
    found = running(both, key, order, F.expr(f"cast(floor(__t / {tile_ms}) as long)"),
                    {"__hit": Scan("last" if back else "first", F.col("__ev"))})
    return found.filter("__pt is not null").select(
        "__pt.*", *[F.col(f"__hit.{v}").alias(v) for v in values]
    )


def _struct_of(df: DataFrame):
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).schema["s"].dataType


def in_chunks(ranges: DataFrame, words: DataFrame, key: list[str], first: str, last: str, lo: Column, hi: Column,
              tile_ms: int = 600_000) -> DataFrame:
    """The ranges beside each ``chunk`` of stored words whose times they touch.

    Where the words of a chunk lie together, joining on it leaves them there; a range then meets the words of its chunks alone.
    """
    cells = words.groupBy(*key, "chunk").agg(F.min(first).alias("__from"), F.max(last).alias("__to"))
    spans = ranges.withColumns({"__lo": lo, "__hi": hi}).filter("__hi >= __lo")

    def tiles(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("__tile", F.explode(F.sequence(F.floor(F.col(a) / tile_ms), F.floor(F.col(b) / tile_ms))))

    met = tiles(spans, "__lo", "__hi").join(tiles(cells, "__from", "__to"), [*key, "__tile"])
    # Each pair once, in the tile of the later start.
    met = met.filter((F.col("__lo") <= F.col("__to")) & (F.col("__hi") >= F.col("__from"))
                     & (F.col("__tile") == F.floor(F.greatest("__lo", "__from") / tile_ms)))
    return met.drop("__tile", "__from", "__to")


def points_in_ranges(
    points: DataFrame,
    ranges: DataFrame,
    key: list[str],
    at: str,
    lo: Column,
    hi: Column,
    tile_ms: int = 10_000,
    how: str = "inner",
) -> DataFrame:
    """Join points to the ranges with ``lo <= at <= hi``: equi join on (key, time tile); stored words on their chunk."""
    if "chunk" in points.columns and "chunk" not in ranges.columns:
        near = in_chunks(ranges, points, key, at, at, lo, hi)
        cond = F.col(f"__p.{at}").between(F.col("__r.__lo"), F.col("__r.__hi")) & (F.col("__p.chunk") == F.col("__r.chunk"))
        for k in key:
            cond = cond & (F.col(f"__p.{k}") == F.col(f"__r.{k}"))
        joined = points.alias("__p").join(near.alias("__r"), cond, how)
        extra = [] if how in ("left_semi", "left_anti") else [c for c in ranges.columns if c not in points.columns]
        return joined.select(*[F.col(f"__p.{c}") for c in points.columns], *[F.col(f"__r.{c}") for c in extra])
    tiled = ranges.withColumn("__lo", lo).withColumn("__hi", hi).filter("__hi >= __lo")
    tiled = tiled.withColumn(
        "__tile",
        F.explode(F.sequence(F.floor(F.col("__lo") / tile_ms), F.floor(F.col("__hi") / tile_ms))),
    )
    pts = points.withColumn("__tile", F.floor(F.col(at) / tile_ms))
    hit = F.col(f"__p.{at}").between(F.col("__r.__lo"), F.col("__r.__hi"))
    cond = hit & (F.col("__p.__tile") == F.col("__r.__tile"))
    for k in key:
        cond = cond & (F.col(f"__p.{k}") == F.col(f"__r.{k}"))
    joined = pts.alias("__p").join(tiled.alias("__r"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"__p.{c}") for c in points.columns])
    extra = [c for c in ranges.columns if c not in points.columns]
    return joined.select(
        *[F.col(f"__p.{c}") for c in points.columns], *[F.col(f"__r.{c}") for c in extra]
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    tile_ms: int = 10_000,
    how: str = "inner",
) -> DataFrame:
    """Join half-open spans that overlap: ``left.end > right.start and left.start < right.end``.

    Both sides are tiled; the pair is kept only in the tile of the later start, so once.
    """
    (ls, le), (rs, re) = left_span, right_span

    def tiles(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.greatest(F.floor((F.col(e) - 1) / tile_ms), F.floor(F.col(s) / tile_ms))
        return df.withColumn("__tile", F.explode(F.sequence(F.floor(F.col(s) / tile_ms), last)))

    lt, rt = tiles(left, ls, le).alias("__a"), tiles(right, rs, re).alias("__b")
    a = {c: F.col(f"__a.{c}") for c in left.columns}
    b = {c: F.col(f"__b.{c}") for c in right.columns}
    cond = (F.col("__a.__tile") == F.col("__b.__tile")) & (a[le] > b[rs]) & (a[ls] < b[re])
    cond = cond & (F.col("__a.__tile") == F.floor(F.greatest(a[ls], b[rs]) / tile_ms))
    for k in key:
        cond = cond & (a[k] == b[k])
    joined = lt.join(rt, cond, "inner" if how == "left_semi" else how)
    if how == "left_semi":
        return joined.select(*a.values()).distinct()
    extra = [c for c in right.columns if c not in left.columns]
    return joined.select(*a.values(), *[b[c] for c in extra])


def sliding(df: DataFrame, key: list[str], at: str, reach: int, values: dict[str, callable],
            chunk: int = 4096) -> DataFrame:
    """Values over the rows ``at - reach .. at + reach`` (edges shrink), for a dense integer ``at``.

    Rows near a chunk edge are copied to the neighbouring chunk, so a long series is spread over
    many tasks. ``values`` maps a name to ``f(window) -> Column``; windows are row frames.
    """
    cells = F.array_distinct(F.array(
        F.floor((F.col(at) - reach) / chunk), F.floor(F.col(at) / chunk), F.floor((F.col(at) + reach) / chunk)))
    rows = df.withColumn("__cell", F.explode(cells))
    w = Window.partitionBy(*key, "__cell").orderBy(at)
    out = rows.select("*", *[f(w).alias(n) for n, f in values.items()])
    return out.filter(F.col("__cell") == F.floor(F.col(at) / chunk)).drop("__cell")


def numbered(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The number of each row's group among rows that have those of a group side by side."""
    fresh = np.zeros(rows.num_rows, bool)
    for k in keys:
        fresh[1:] |= pc.not_equal(rows[k][1:], rows[k][:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches dealt anew so that no group of ``keys``, whose rows are side by side, is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # What ends before the last group of the batch is whole; a group of many batches is put together once.
        last = int(np.searchsorted(group := numbered(b, keys), group[-1]))
        same = not held or all(held[-1][k][-1].equals(b[k][0]) for k in keys)
        if last == 0 and same:
            held.append(b)
            continue
        yield pa.concat_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.concat_batches(held)


def in_place(rows: DataFrame, asked: DataFrame, keys: list[str], order: str, look, schema: str) -> DataFrame:
    """What ``look`` makes of rows and of what is asked about them, for many groups of ``keys`` at once.

    The asked rows of a group are brought to its first row as one array, so rows that lie in their groups stay where they are. ``look`` is given
    the rows in the order of their groups and ``order``, the number of each row's group, the asked rows and theirs; it returns a record batch.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("__at", first).alias("__r")
    packed = asked.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in asked.columns if c not in keys])).alias("__asked")).alias("__a")
    cond = F.col("__r.__at") == 1
    for k in keys:
        cond = cond & (F.col(f"__r.{k}") == F.col(f"__a.{k}"))
    met = rows.join(packed, cond, "left").select("__r.*", "__a.__asked")

    def run(batches):
        for t in whole_groups(batches, keys):
            group = numbered(t, keys)
            named = {c: t[c] for c in t.schema.names if c != "__asked"}
            if (np.diff(group) == 0)[np.diff(t[order].to_numpy(zero_copy_only=False)) < 0].any():
                at = pa.array(np.lexsort((t[order].to_numpy(zero_copy_only=False), group)))
                named = {c: v.take(at) for c, v in named.items()}
            own = group[pc.list_parent_indices(t["__asked"]).to_numpy()]
            if len(own):
                said = t["__asked"].flatten()
                fields = {said.type.field(k).name: x for k, x in enumerate(said.flatten())}
                head = pa.array(np.searchsorted(group, own))
                fields |= {k: t[k].take(head) for k in keys}
                yield look(named, group, fields, own)

    return met.mapInArrow(run, schema)
