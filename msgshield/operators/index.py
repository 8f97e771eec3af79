"""Global positions without pulling rows into one task (O1–O6 helper).

``row_number()`` over an un-partitioned window moves every row to a single
task. Instead: range-partition sort the order key *and nothing else*,
materialise it to the reliable checkpoint folder (so the two passes below see
identical partitions even if executors are lost), count rows per partition,
turn the counts into offsets (one row per partition — a size bound that does
not grow with the data, hence safe to broadcast) and add each row's offset to
its position in its partition, which ``monotonically_increasing_id`` already
encodes. Callers that need whole records join the positions back by key, so
text and screenshots never pass the sort or the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1
MAX_BROADCAST_GROUPS = 10_000    # first positions of groups are broadcast up to here


def _cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def group_table(df: DataFrame, by, *aggs) -> DataFrame:
    """One row per group, as a small broadcast table when there are at most
    ``MAX_BROADCAST_GROUPS`` groups (checked), else as a plain aggregate."""
    grouped = df.groupBy(*by).agg(*aggs)
    some = grouped.limit(MAX_BROADCAST_GROUPS + 1).collect()
    if len(some) > MAX_BROADCAST_GROUPS:
        return grouped
    return F.broadcast(df.sparkSession.createDataFrame(some, grouped.schema))


def _same(left: DataFrame, right: DataFrame, cols):
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[f"_{c}"])
    return cond


def _join_groups(df: DataFrame, groups: DataFrame, by) -> DataFrame:
    """Null-safe join on ``by``; a null group is a group."""
    renamed = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    return df.join(renamed, _same(df, renamed, by)).drop(*[f"_{c}" for c in by])


def positions(df: DataFrame, order, by=None, keep=(), index_col: str = "idx",
              count_col: str | None = None) -> DataFrame:
    """``by``, ``keep`` and a 0-based position in ``order``; other columns are dropped.

    ``order`` (column names or expressions) must be unique for the positions
    to be repeatable. With ``by`` the position restarts in every group: the
    sort is by ``by`` first and each group's first global position is
    subtracted, so a group holding a third of all rows still spreads over many
    range partitions. ``count_col`` adds the group's size.
    """
    by = list(by or [])
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keep = [c for c in dict.fromkeys(keep) if c not in by]
    # The projection above the sort prunes every other column below it.
    tagged = (df.orderBy(*_cols(by), *_cols(order)).select(*by, *keep)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    per_part = (tagged.groupBy(F.shiftright("_mid", 33).alias("_pid"))
                      .agg(F.count(F.lit(1)).alias("_n")))
    # One row per partition: a plain window here is over a bounded, tiny frame.
    offsets = per_part.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    indexed = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
                     .join(F.broadcast(offsets), "_pid")
                     .withColumn(index_col, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
                     .drop("_pid", "_off", "_mid"))
    if not by:
        return indexed
    groups = group_table(indexed, by, F.min(index_col).alias("_first"), F.count(F.lit(1)).alias("_size"))
    placed = _join_groups(indexed, groups, by).withColumn(index_col, F.col(index_col) - F.col("_first"))
    return (placed.withColumnRenamed("_size", count_col) if count_col else placed.drop("_size")).drop("_first")


def _fresh(taken, n: int) -> list[str]:
    """Column names that no column of ``taken`` has."""
    taken, out, i = set(taken), [], 0
    while len(out) < n:
        if f"_c{i}" not in taken:
            out.append(f"_c{i}")
        i += 1
    return out


def _equal(names) -> Column:
    cond = F.lit(True)
    for left, right in names:
        cond = cond & F.col(left).eqNullSafe(F.col(right))
    return cond


def attach(df: DataFrame, placed: DataFrame, keys, cols) -> DataFrame:
    """Join ``cols`` of ``placed`` back to the records of ``df`` by ``keys`` (null-safe).

    Keys are meant to be unique; that is looked up on the narrow side. Only records
    whose key repeats (or is null more than once) go another way: each gets an occurrence number from
    :func:`positions`, as their rows of ``placed`` do, and the two meet on (key, occurrence). So every
    record gets a position of its own, none is lost or doubled, and a key that holds a third of
    all rows spreads over many tasks. No record passes a sort or a window.
    """
    keys, cols = list(keys), list(cols)
    names = _fresh([*df.columns, *placed.columns], len(keys) + len(cols) + 2)
    right, values, (uid, nth) = names[:len(keys)], names[len(keys):-2], names[-2:]
    side = placed.select(*[F.col(k).alias(r) for k, r in zip(keys, right)], *[F.col(c).alias(v) for c, v in zip(cols, values)])
    kept = [c for c in df.columns if c not in cols]
    result = [*kept, *[F.col(v).alias(c) for c, v in zip(cols, values)]]
    repeated = side.groupBy(*right).agg(F.count(F.lit(1)).alias(nth)).where(F.col(nth) > 1).select(*right)
    same = _equal(zip(keys, right))
    if repeated.isEmpty():
        return df.join(side, same).select(*result)

    repeated = repeated.checkpoint(eager=True)
    again = [f"{r}_" for r in right]
    single = side.join(repeated.toDF(*again), _equal(zip(right, again)), "left_anti")
    one = df.join(single, same).select(*result)
    many = df.join(repeated, same, "left_semi").withColumn(uid, F.monotonically_increasing_id()).checkpoint(eager=True)
    rows = positions(many.select(*keys, uid), [uid], by=keys, keep=[uid], index_col=nth)
    places = positions(side.join(repeated.toDF(*again), _equal(zip(right, again)), "left_semi"), values, by=right, keep=values,
                       index_col=f"{nth}_")
    numbered = rows.join(places, _equal([*zip(keys, right), (nth, f"{nth}_")])).select(F.col(uid).alias(f"{uid}_"), *values)
    return one.unionByName(many.join(numbered, F.col(uid) == F.col(f"{uid}_")).select(*result))


def global_index(df: DataFrame, order, by=None, index_col: str = "idx") -> DataFrame:
    """Positions next to every column of an already narrow frame."""
    return positions(df, order, by, keep=df.columns, index_col=index_col).select(*df.columns, index_col)
