"""Overlapping and gapped intervals: covered periods and gaps by one global sort and carried state.

The rows are range-sorted by entity and start, so an entity of any size spreads over many
partitions. Pass 1 gives one summary row a partition (its last entity, that entity's last island
start and maximum end). The summaries, one a partition, are prefix-combined; pass 2 reads the
sorted rows again, each partition starting with the state carried into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligaquery.session import cut

SUMMARY = "pid INT, first_a STRING, first_b STRING, last_a STRING, last_b STRING, island BIGINT, top BIGINT"
LOW = np.iinfo(np.int64).min


def _runs(b: pd.DataFrame) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(entity, starts, ends) of each stretch of rows of one entity in a sorted batch."""
    a, c = b.a.to_numpy(), b.b.to_numpy()
    edges = np.flatnonzero((a[1:] != a[:-1]) | (c[1:] != c[:-1])) + 1
    bounds = [0, *edges.tolist(), len(b)]
    s, e = b.s.to_numpy(np.int64), b.e.to_numpy(np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            yield a[lo], c[lo], s[lo:hi], e[lo:hi]


def _islands(starts: np.ndarray, ends: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows that open an island, the maximum end before each row, and the maximum end after all."""
    tops = np.maximum(np.maximum.accumulate(ends), top)
    before = np.concatenate(([top], tops[:-1]))
    opens = (before == LOW) | (starts - 1 > before)
    return np.flatnonzero(opens), before, int(tops[-1])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = last = pid = None
    island, top = LOW, LOW
    for b in batches:
        if len(b):
            pid = int(b.pid.iloc[0])
        for a, c, s, e in _runs(b):
            first = first or (a, c)
            if (a, c) != last:
                last, island, top = (a, c), LOW, LOW
            opens, _, top = _islands(s, e, top)
            if len(opens):
                island = int(s[opens[-1]])
    if last:
        yield pd.DataFrame([[pid, *first, *last, island, top]], columns=[x.split()[0] for x in SUMMARY.split(", ")])


def _prefix(rows: list) -> dict[int, tuple]:
    """By partition: the state carried into it, and the first entity of the next partition."""
    out, state = {}, None
    for i, r in enumerate(rows):
        out[r.pid] = (state, (rows[i + 1].first_a, rows[i + 1].first_b) if i + 1 < len(rows) else None)
        last = (r.last_a, r.last_b)
        if state and state[0] == last:
            state = (last, r.island if r.island - 1 > state[2] else state[1], max(r.top, state[2]))
        else:
            state = (last, r.island, r.top)
    return out


def _frame(parts: list[tuple]) -> pd.DataFrame:
    """One frame of parts (a, b, kind, starts, stops)."""
    n = [len(p[3]) for p in parts]
    named = {c: np.repeat(np.array([p[i] for p in parts], object), n) for i, c in enumerate(("a", "b", "kind"))}
    whole = lambda i: np.concatenate([np.asarray(p[i], np.int64) for p in parts]) if parts else np.empty(0, np.int64)
    return pd.DataFrame({**named, "strt": whole(3), "stop": whole(4)})


def _emit(carried: dict[int, tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ent, island, top, after, begun = None, LOW, LOW, None, False
        for b in batches:
            if not len(b):
                continue
            if not begun:
                state, after = carried[int(b.pid.iloc[0])]
                begun = True
                if state:
                    ent, island, top = state
                    if ent != (b.a.iloc[0], b.b.iloc[0]):
                        ent = None  # the partition before has closed it
            out: list[tuple] = []
            for a, c, s, e in _runs(b):
                if (a, c) != ent:
                    if ent is not None:
                        out.append((*ent, "period", [island], [top]))
                    ent, island, top = (a, c), LOW, LOW
                opens, before, top = _islands(s, e, top)
                begins = s[opens] if island == LOW else np.concatenate(([island], s[opens]))
                shut = opens[len(opens) + 1 - len(begins) :]  # the rows that end the island before them
                if len(shut):
                    out.append((a, c, "period", begins[:-1], before[shut]))
                    out.append((a, c, "gap", before[shut] + 1, s[shut] - 1))
                if len(begins):
                    island = int(begins[-1])
            yield _frame(out)
        if ent is not None and begun and after != ent:
            yield _frame([(*ent, "period", [island], [top])])

    return run


def periods_and_gaps(df: DataFrame, entity: tuple[str, str], start: str, end: str) -> DataFrame:
    """(entity columns, kind, strt, stop): the maximal covered runs and the gaps between them.

    Intervals are closed whole numbers; one that starts right after another ends continues it.
    Rows with a null in the entity, the start or the end, or a start after the end, do not count;
    repeated and nested rows change nothing; an empty table gives an empty result.
    """
    types = [df.schema[c].dataType for c in entity]
    rows = df.select(
        F.col(entity[0]).alias("x"), F.col(entity[1]).alias("y"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")
    ).where("x IS NOT NULL AND y IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND s <= e")
    ordered = rows.repartitionByRange("x", "y", "s").sortWithinPartitions("x", "y", "s")
    ordered = cut(ordered.select(F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b"), "s", "e", F.spark_partition_id().alias("pid")))
    heads = sorted(ordered.mapInPandas(_summaries, SUMMARY).collect(), key=lambda r: r.pid)
    out = ordered.mapInPandas(_emit(_prefix(heads)), "a STRING, b STRING, kind STRING, strt BIGINT, stop BIGINT")
    return out.select(F.col("a").cast(types[0]).alias(entity[0]), F.col("b").cast(types[1]).alias(entity[1]), "kind", "strt", "stop")
