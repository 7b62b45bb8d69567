"""Horizon-safe lag features and the per-horizon grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.roles import Roles


def lag_name(h: int) -> str:
    return f"last_{h}"


def series_window(roles: Roles):
    return Window.partitionBy(*roles.series_partition()).orderBy(F.col(roles.time))


def add_lags(df: DataFrame, roles: Roles, horizons: list[int], spread: bool = False) -> DataFrame:
    """Add ``last_h`` = target h rows earlier in the same series, for every h.

    All horizons share one window, so the plan has a single exchange on the
    series key and a single sort, whatever the number of horizons. A window
    partition is one series; set ``spread`` when a single series may be
    too large for one task (see ``ranged_shift``).
    """
    if spread and horizons:
        lagged = ranged_shift(df, roles, {lag_name(h): h for h in horizons}, roles.target)
        return lagged.withColumns({lag_name(h): F.col(lag_name(h)).cast("double") for h in horizons})
    w = series_window(roles)
    y = F.col(roles.target)
    return df.withColumns({lag_name(h): F.lag(y, h).over(w).cast("double") for h in horizons})


def lead_target(df: DataFrame, roles: Roles, horizon: int, name: str = "target", spread: bool = False) -> DataFrame:
    """Target h rows later in the same series."""
    if spread:
        led = ranged_shift(df, roles, {name: horizon}, roles.target, ahead=True)
        return led.withColumn(name, F.col(name).cast("double"))
    w = series_window(roles)
    return df.withColumn(name, F.lead(F.col(roles.target), horizon).over(w).cast("double"))


def horizon_grid(df: DataFrame, roles: Roles, horizons: list[int], spread: bool = False) -> DataFrame:
    """One row per (panel row, horizon) with that horizon's ``last``.

    The lags come from one window pass; ``inline`` then turns the lag columns
    into rows without any join.
    """
    lagged = add_lags(df, roles, horizons, spread)
    pairs = F.array(*[F.struct(F.lit(h).cast("bigint").alias("predict_horizon"),
                               F.col(lag_name(h)).alias("last")) for h in horizons])
    keep = [c for c in df.columns]
    return lagged.select(*keep, F.inline(pairs))


DONE, OPEN, TAIL = 0, 1, 2  # kinds of rows of a shifted partition


class _Shifter:
    """Shifts a value within the series of one sorted partition, batch by batch."""

    def __init__(self, id_col: str, time_col: str, value: str, shifts: list[int]):
        self.id_col, self.time_col, self.value, self.shifts = id_col, time_col, value, shifts
        self.most = max(shifts)
        self.carry = None       # the last rows read: id, time, value and whether they are open
        self.first, self.seen = True, 0  # whether the partition's first series goes on, and its rows so far

    def batch(self, batch: pa.RecordBatch) -> tuple[list[pa.Array], pa.Array]:
        """The shifted values of a batch, and the kind of each row: open if it stands so near
        the partition's start that an earlier partition may hold what it needs."""
        n = batch.num_rows
        rows = pa.table([batch.column(batch.schema.get_field_index(c)) for c in (self.id_col, self.time_col, self.value)],
                        names=["id", "time", "value"])
        before = self.carry.num_rows if self.carry is not None else 0
        joined = pa.concat_tables([self.carry.drop(["open"]), rows]) if before else rows
        ids, values = joined.column("id").combine_chunks(), joined.column("value").combine_chunks()
        series = np.concatenate([[0], np.cumsum(~_equal(ids[1:], ids[:-1]))])[:len(ids)]
        place = np.arange(before, before + n)
        out = []
        for h in self.shifts:
            source = place - h
            good = (source >= 0) & (series[np.maximum(source, 0)] == series[place])
            out.append(values.take(pa.array(source, mask=~good)))
        lead = 0
        if self.first and n:
            # the rows that go on with the first series: all of its number in this table
            lead = int(np.count_nonzero(series[place] == series[0]))
        is_open = np.zeros(n, bool)
        is_open[:max(0, min(lead, self.most - self.seen))] = True
        self.seen += lead
        self.first = self.first and lead == n
        flags = pa.array(is_open)
        old = self.carry.column("open").combine_chunks() if before else pa.array([], pa.bool_())
        joined = joined.append_column("open", pa.concat_arrays([old, flags]))
        last = joined.slice(max(0, joined.num_rows - self.most))
        own = last.column("id").combine_chunks()
        # of the last series only
        same = _equal(own, own.take(pa.array(np.full(len(own), len(own) - 1)))) if len(own) else np.zeros(0, bool)
        self.carry = last.filter(pa.array(same))
        return out, pa.array(np.where(is_open, OPEN, DONE).astype(np.int32))

    def tail(self) -> pa.Table | None:
        """The partition's last rows of its last series that are not open themselves."""
        if self.carry is None:
            return None
        return self.carry.filter(pc.invert(self.carry.column("open")))


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equality in which null equals null."""
    same = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def ranged_shift(df: DataFrame, roles: Roles, shifts: dict[str, int], value: str, ahead: bool = False,
                 partitions: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``shifts``: ``value`` so many rows earlier (``ahead``: later)
    in the same series, for panels where one series may be too large for one task.

    The panel is sorted by (id, time) in range partitions, as many as the session's shuffle
    partitions: a series may span several, a partition hold many. Values are shifted
    where the rows lie. Only the first rows of a partition's first series are
    open: they and the last rows of each partition, at most twice the largest shift a
    partition, meet in a small window by series. One shuffle of the panel; the
    shifted panel is written once to the shared folder.
    """
    from tidewise.session import write_scratch
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "_kind"
    while kind in df.columns:
        kind = "_" + kind
    time = F.col(roles.time).desc() if ahead else F.col(roles.time).asc()
    laid = df.repartitionByRange(n, F.col(roles.id), time).sortWithinPartitions(F.col(roles.id), time)
    of = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, t) for c, t in of.items()]
                          + [T.StructField(c, of[value]) for c in shifts] + [T.StructField(kind, T.IntegerType())])
    id_col, time_col, steps, names = roles.id, roles.time, list(shifts.values()), list(of)

    def run(batches):
        shifter, types = _Shifter(id_col, time_col, value, steps), None
        for batch in batches:
            if not batch.num_rows:
                continue
            shifted, kinds = shifter.batch(batch)
            types = [*batch.schema.types, *(x.type for x in shifted), kinds.type]
            yield pa.RecordBatch.from_arrays([*batch.columns, *shifted, kinds], names=schema.names)
        tail = shifter.tail()
        if tail is not None and tail.num_rows:
            known = {id_col: "id", time_col: "time", value: "value"}
            columns = [tail.column(known[c]).combine_chunks() if c in known and i < len(names)
                       else pa.array(np.full(tail.num_rows, TAIL, np.int32)) if c == kind
                       else pa.nulls(tail.num_rows, t) for i, (c, t) in enumerate(zip(schema.names, types))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = write_scratch(laid.mapInArrow(run, schema), "ranged", [kind])
    w = Window.partitionBy(roles.id).orderBy(time)
    edge = rows.filter(F.col(kind) != DONE).withColumns({c: F.lag(value, h).over(w) for c, h in shifts.items()})
    return rows.filter(F.col(kind) == DONE).unionByName(edge.filter(F.col(kind) == OPEN)).select(*names, *shifts)
