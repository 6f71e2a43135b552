"""As-of joins and neighbour rows over rows cut into even pieces, whatever their keys.

Rows are dealt by ranges of (key, time, tie), so a piece holds the same share of the rows whether these are of one key and one
instant or of many. Only the last key of a piece can go on in the next one: what crosses a border is one summary row a
piece, carried by a scan over the pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabmill.session import stage


def asof_slice(df: DataFrame, ts: str, as_of: Column, days: int | None = None) -> DataFrame:
    """Rows with ``as_of - days <= ts < as_of``; plain comparisons, so they push down."""
    out = df.where(F.col(ts) < as_of)
    if days is not None:
        out = out.where(F.col(ts) >= as_of - F.expr(f"interval {int(days)} days"))
    return out


def asof_slice_closed(df: DataFrame, ts: str, as_of: Column, days: int | None = None) -> DataFrame:
    """Rows with ``as_of - days <= ts <= as_of``."""
    out = df.where(F.col(ts) <= as_of)
    if days is not None:
        out = out.where(F.col(ts) >= as_of - F.expr(f"interval {int(days)} days"))
    return out


def even_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_piece``: contiguous ranges of (keys, order) of about one size, numbered in order; each is one task's.

    The borders come from the rows themselves, so a hot key, or one instant of it, is cut like any other range as far as ``order`` tells its rows
    apart. The numbered rows are stored, as every reader must see the same borders. Windows and aggregates by (``_piece``, ...) need no further exchange.
    """
    return gathered(numbered_pieces(df, keys, order))


def numbered_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The stored rows with ``_piece``, not yet each piece in one task."""
    pieces = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stage(df.repartitionByRange(pieces, *keys, *order).withColumn("_piece", F.spark_partition_id()), "pieces")


def gathered(ranged: DataFrame) -> DataFrame:
    return ranged.repartitionById(max(1, int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col("_piece"))


def _border_rows(pieces: DataFrame, keys: Sequence[str], last: bool, **values: Column) -> DataFrame:
    """One row a piece: its last (or first) key with aggregates of that key's rows; so few rows that a broadcast of them is bounded."""
    by_key = pieces.groupBy("_piece", *keys).agg(*[v.alias(k) for k, v in values.items()])
    pick = F.max_by if last else F.min_by
    row = by_key.groupBy("_piece").agg(pick(F.struct(*keys, *values), F.struct(*keys)).alias("_edge"))
    return row.select("_piece", "_edge.*")


def _met_at_border(pieces: DataFrame, borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pieces`` with the columns of the border row of their piece and key, where there is one."""
    on = F.col("l._piece") == F.col("b._piece")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}"))
    more = [F.col(f"b.{c}") for c in borders.columns if c not in ("_piece", *keys)]
    return pieces.alias("l").join(F.broadcast(borders).alias("b"), on, "left").select("l.*", *more)


def asof_join(
    left: DataFrame,
    rights: Sequence[tuple[DataFrame, str, Mapping[str, str]]],
    keys: Sequence[str],
    left_ts: str,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Add, per left row, the newest right row with ``right_ts <= left_ts``.

    ``rights`` lists (frame, timestamp column, {output: source column}); all of them are matched in one pass on the same keys. Of right rows
    at one time the one with the greatest output values counts. Only keys, times and ``row_id`` go through the ordered pass; the
    rest of a left row meets its result by ``row_id`` (columns that are unique and not NULL). Without one, ``left`` is stored with a number a row.
    NULL keys and times find nothing.
    """
    keys = list(keys)
    numbered = left
    if row_id is None:
        row_id, numbered = ["_row"], stage(left.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    row_id = list(row_id)
    payloads = [f"_p{i}" for i in range(len(rights))]
    found = [F.struct(*[F.col(src).alias(dst) for dst, src in cols.items()]) for _, _, cols in rights]
    types = [r.select(p.alias("p")).schema["p"].dataType for (r, _, _), p in zip(rights, found, strict=True)]
    ids = [f"_id{i}" for i in range(len(row_id))]
    known = numbered.where(F.col(left_ts).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    sides = known.select(
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.xxhash64(*row_id).alias("_tie"),
        *[F.col(c).alias(i) for c, i in zip(row_id, ids, strict=True)], *[F.lit(None).cast(t).alias(p) for p, t in zip(payloads, types, strict=True)],
    )
    for n, (right, ts, _) in enumerate(rights):
        newest = right.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_ts")).agg(F.max(found[n]).alias(payloads[n]))
        sides = sides.unionByName(
            newest.select(*keys, "_ts", F.lit(0).alias("_side"), F.lit(n).cast("long").alias("_tie"), payloads[n]), allowMissingColumns=True
        )
    pieces = even_pieces(sides, keys, ["_ts", "_side", "_tie"])
    within = Window.partitionBy("_piece", *keys).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = pieces.select("*", *[F.last(p, ignorenulls=True).over(within).alias(f"_l{p}") for p in payloads]).where("_side = 1").drop("_side", "_tie", "_ts", *payloads)
    latest = {f"_c{p}": F.max_by(p, F.when(F.col(p).isNotNull(), F.col("_ts"))) for p in payloads}
    ends = _border_rows(pieces, keys, True, **latest, _goes_on=F.lit(1))
    # The state at a piece's end holds for the pieces after it: a row for every border, filled from the ends before it.
    starts = _border_rows(pieces, keys, False, _start=F.lit(1))
    both = starts.select("_piece", *keys, F.lit(0).alias("_kind")).unionByName(ends.drop("_goes_on").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("_piece", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select("_piece", *keys, "_kind", *[F.last(f"_c{p}", ignorenulls=True).over(earlier).alias(f"_c{p}") for p in payloads]).where("_kind = 0").drop("_kind")
    matched = _met_at_border(local, carried, keys)
    outputs = []
    for p, (_, _, cols) in zip(payloads, rights, strict=True):
        best = F.coalesce(F.col(f"_l{p}"), F.col(f"_c{p}"))
        outputs += [best[dst].alias(dst) for dst in cols]
    results = matched.select(*[F.col(i).alias(c) for i, c in zip(ids, row_id, strict=True)], *outputs)
    own = [c for c in left.columns if c not in row_id]
    return numbered.join(results, row_id, "left").select(*[c for c in left.columns if c in row_id or c in own], *[dst for _, _, cols in rights for dst in cols])


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str], back: bool = False) -> DataFrame:
    """Add columns of the following row per key (``lead``); ``columns`` maps output name to source.

    ``order`` should tell a key's rows apart. ``back`` takes the preceding row instead (``lag``). NULL keys are one key.
    """
    keys, order = list(keys), list(order)
    payload = F.struct(*[F.col(src).alias(dst) for dst, src in columns.items()])
    stored = numbered_pieces(df, keys, order)
    shift = F.lag if back else F.lead
    local = gathered(stored).withColumn("_next", shift(payload).over(Window.partitionBy("_piece", *keys).orderBy(*order)))
    # A piece's border row is its first (or last) row of all, so it is found where rows are read: they are exchanged once.
    edge = (F.max_by if back else F.min_by)(F.struct(*keys, payload.alias("_after")), F.struct(*keys, *order))
    edges = stored.groupBy("_piece").agg(edge.alias("_edge")).select("_piece", "_edge.*")
    step = 1 if back else -1
    edges = edges.withColumn("_piece", F.col("_piece") + step)
    best = F.coalesce(F.col("_next"), F.col("_after"))
    return _met_at_border(local, edges, keys).select(*df.columns, *[best[dst].alias(dst) for dst in columns])


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Number the rows of each key in ``order``, which should tell them apart; earlier pieces contribute only their sizes."""
    keys, order = list(keys), list(order)
    pieces = even_pieces(df, keys, order)
    local = pieces.withColumn("_i", F.row_number().over(Window.partitionBy("_piece", *keys).orderBy(*order)))
    ends = _border_rows(pieces, keys, True, _n=F.count(F.lit(1)))
    starts = _border_rows(pieces, keys, False, _start=F.lit(1)).select("_piece", *keys, F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_piece", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = starts.unionByName(ends.withColumn("_kind", F.lit(1)))
    before = both.select("_piece", *keys, "_kind", F.sum("_n").over(earlier).alias("_before")).where("_kind = 0").drop("_kind")
    counted = _met_at_border(local, before, keys)
    return counted.withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_i")).select(*df.columns, out)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key with the greatest ``order``; combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key with the least ``order``, and of equals that with the least other columns; combines map-side and carries a column once."""
    rest = [c for c in df.columns if c not in keys]
    placed = [*dict.fromkeys(c for c in order if c in rest), *(c for c in rest if c not in order)]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*placed)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)
