"""What overlaps add up to, counted by sweeps over sorted cells: the pairs themselves are not listed, but by ``listed``, and never shuffled or sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of the smallest cells. An interval that is longer has a cell of twice, four times ... the width.
CELL = 32768
#: Up to so many cells, those in use are listed and rows go to no other ones.
CELLS = 10_000
#: A cell with more than a task's share of the features is dealt by samples, into so many parts at most.
PARTS = 16
#: The same where overlaps are listed, as a hot cell's rows are most of the work there.
LIST_PARTS = 64
#: Rows of a batch that a sweep gives out.
BATCH = 1 << 16
#: So many segments are listed together, 64 at most: those that a feature overlaps are the bits of a number.
BLOCK = 64
#: A row that is handed on becomes at most so many overlaps, as Spark holds them all before the first is written.
GROUP = 4096

CELL_KEY = ["ref", "lvl", "cell"]
SIDES = ["+", "-"]


def _ok(df: DataFrame) -> DataFrame:
    return df.where("ref IS NOT NULL AND strt IS NOT NULL AND stop IS NOT NULL AND strt <= stop")


def _one_cell(df: DataFrame) -> DataFrame:
    """Each row in the one cell that holds its start; its end is there or in the next one of that level."""
    over = F.expr(f"(stop - strt) div {CELL}")
    lvl = F.when(over == 0, 0).otherwise(F.length(F.bin(over)))
    return df.withColumn("lvl", lvl).withColumn("cell", F.floor(F.col("strt") / F.expr(f"shiftleft({CELL}L, lvl)")))


def _near_cells(df: DataFrame, own: DataFrame) -> DataFrame:
    """Each row in every cell that it may share with rows of ``own``, which are from ``_one_cell``.

    Up to ``CELLS``, only the cells that have such rows are taken; beyond that all cells of their levels, of which many may be idle.
    """
    width = F.expr(f"shiftleft({CELL}L, lvl)")
    at = F.sequence(F.floor(F.col("strt") / width) - 1, F.floor(F.col("stop") / width))
    used = own.select("lvl", F.xxhash64(*CELL_KEY).alias("h")).distinct().limit(CELLS + 1).collect()
    levels = {r.lvl for r in (used if len(used) <= CELLS else own.select("lvl").distinct().collect())}  # one for each doubling of the longest length
    near = df.withColumn("lvl", F.explode(F.array(*map(F.lit, sorted(levels) or [0])))).withColumn("cell", F.explode(at))
    if not 0 < len(used) <= CELLS:
        return near
    return near.where(f"xxhash64({', '.join(CELL_KEY)}) IN ({', '.join(str(r.h) for r in used)})")  # an idle cell of the same hash does no harm


def _parts(own: DataFrame, tasks: int, most: int, other: DataFrame | None = None) -> tuple[Column, Column]:
    """Into how many parts, ``most`` at most, the cell of a row is dealt, from the rows of ``own`` that it has, times those of ``other`` if given.

    Also gives the task of the first part: the parts of cells that are dealt lie in tasks one after another, other cells anywhere.
    """
    h = f"xxhash64({', '.join(CELL_KEY)})"
    per = own.groupBy(F.expr(h).alias("h")).count()
    if other is not None:
        per = per.join(other.groupBy(F.expr(h).alias("h")).agg(F.count("*").alias("n")), "h").select("h", (F.col("count") * F.col("n")).alias("count"))
    total = per.agg(F.sum("count")).first()[0] or 0
    by: dict[int, list[int]] = {}
    first, at = [], 0
    for r in sorted(per.where(F.col("count") * tasks > total).collect(), key=lambda r: (-r["count"], r.h)):  # fewer than there are tasks
        n = min(most, -(-r["count"] * tasks // total))
        by.setdefault(n, []).append(r.h)
        first.append(f"WHEN {r.h} THEN {at % tasks}")
        at += n
    any_task = f"pmod({h}, {tasks})"
    if not by:
        return F.lit(1), F.expr(any_task).cast("int")
    cases = " ".join(f"WHEN {h} IN ({', '.join(map(str, hs))}) THEN {n}" for n, hs in sorted(by.items()))
    return F.expr(f"CASE {cases} ELSE 1 END"), F.expr(f"CASE {h} {' '.join(first)} ELSE {any_task} END").cast("int")


def _differs(a: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null is a value."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    other = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
    return other | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(values of ``by``, rows) for each run of rows of a batch that are equal in them."""
    for b in batches:
        if b.num_rows:
            cut = np.zeros(b.num_rows - 1, dtype=bool)
            for c in by:
                cut |= _differs(b.column(c))
            at = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
            for i, j in zip(at, at[1:]):
                rows = b.slice(i, j - i)
                yield tuple(rows.column(c)[0].as_py() for c in by), rows


def _numbers(rows: list[pa.RecordBatch], col: str) -> np.ndarray:
    return np.concatenate([r.column(col).to_numpy(zero_copy_only=False) for r in rows])


class _Held:
    """Sorted bounds of the features of a cell, with running sums of their places."""

    def __init__(self, strt: np.ndarray, stop: np.ndarray, place: np.ndarray):
        a, b = np.argsort(strt, kind="stable"), np.argsort(stop, kind="stable")
        self.strt, self.stop = strt[a], stop[b]
        self.a, self.b = (np.concatenate(([0], np.cumsum(place[o]))) for o in (a, b))

    def met(self, strt: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval, how many features it overlaps, and the sum of their places: the only one's place, if it is one."""
        i, j = np.searchsorted(self.strt, stop, "right"), np.searchsorted(self.stop, strt, "left")
        return i - j, self.a[i] - self.b[j]


def _count(names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, sets = None, [], {}
        for (ref, lvl, at, streamed), rows in _runs(batches, [*CELL_KEY, "streamed"]):
            if (ref, lvl, at) != cell:
                cell, held, sets = (ref, lvl, at), [], {}
            if not streamed:
                held.append(rows)
                continue
            if not held:
                continue
            if not sets:
                strt, stop, n = _numbers(held, "strt"), _numbers(held, "stop"), sum(r.num_rows for r in held)
                strand = np.concatenate([r.column("strand").to_numpy(zero_copy_only=False) for r in held])
                every = pa.concat_arrays([r.column("feature") for r in held])
                sets = {x: _Held(strt[m], stop[m], np.flatnonzero(m)) for x in SIDES for m in [strand == x]} | {"": _Held(strt, stop, np.arange(n))}
            strt, stop = _numbers([rows], "strt"), _numbers([rows], "stop")
            strand = rows.column("strand").to_numpy(zero_copy_only=False)
            n, place = sets[""].met(strt, stop)
            s, s_place = np.zeros_like(n), np.zeros_like(place)
            for x in SIDES:
                m = strand == x
                s[m], s_place[m] = sets[x].met(strt[m], stop[m])
            keep = np.flatnonzero(n > 0)
            out = [rows.column(c).take(pa.array(keep)) for c in ("seg_no", "sample_idx", "ref", "strand", "strt", "stop")]
            out += [pa.array(s[keep]), pa.array((n - s)[keep])]
            if names:
                for k, p in ((s, s_place), (n - s, place - s_place)):
                    out.append(every.take(pa.array(np.where(k == 1, p, 0)[keep], mask=(k != 1)[keep])))
            yield pa.RecordBatch.from_arrays(out, [*COUNTED, *(("sense", "anti") if names else ())])

    return run


COUNTED = ["seg_no", "sample_idx", "ref", "strand", "strt", "stop", "s", "a"]


def counted(segments: DataFrame, features: DataFrame, names: bool = False) -> DataFrame:
    """Each segment that overlaps a feature with s and a, the features of its strand that it overlaps and the others; with ``names`` also sense and anti, the only one of each.

    ``segments`` are (seg_no, sample_idx, ref, strand, strt, stop) with strand + or -, ``features`` (feature, ref, strand, strt, stop)
    with any or no strand. A segment lies in one cell, together with every feature that it may overlap; the numbers are
    differences of ranks among the cell's sorted bounds. Rows with a null or a start after the end meet nothing.
    """
    own = _one_cell(_ok(segments)).withColumn("streamed", F.lit(True))
    other = _near_cells(_ok(features), own).withColumn("streamed", F.lit(False))
    rows = other.unionByName(own, allowMissingColumns=True).repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "streamed")
    kinds = {f.name: f.dataType.simpleString() for f in [*segments.schema, *features.schema]}
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in COUNTED) + (f", sense {kinds['feature']}, anti {kinds['feature']}" if names else "")
    return rows.mapInArrow(_count(names), schema)


def _sums(rows: list[pa.RecordBatch], side: str | None, strt: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the features are met by the segments of a strand (None: of any), and the sum of 1 / n of those that meet each."""
    a, b, n = (_numbers(rows, c) for c in ("strt", "stop", "n"))
    if side:
        m = np.concatenate([r.column("strand").to_numpy(zero_copy_only=False) for r in rows]) == side
        a, b, n = a[m], b[m], n[m]
    part = 1 / n.astype(np.longdouble)  # so that differences of running sums are as good as sums of doubles
    x, y = np.argsort(a), np.argsort(b)
    up, down = (np.concatenate((np.zeros(1, np.longdouble), np.cumsum(part[o]))) for o in (x, y))
    i, j = np.searchsorted(a[x], stop, "right"), np.searchsorted(b[y], strt, "left")
    hit = np.flatnonzero(i > j)
    return hit, (up[i[hit]] - down[j[hit]]).astype(np.float64)


def _share():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, sides, every, sample, mine = None, [], [], None, None, []
        ready: list[tuple] = []

        def close() -> None:
            for side, at, strt, stop, same in sides if mine else ():
                hit, f = _sums(mine, side, strt, stop)
                if len(hit):
                    ready.append((mine[0].column("sample_idx").slice(0, 1), same[hit], at[hit], f))
            mine.clear()

        def flush() -> pa.RecordBatch:
            who = pa.concat_arrays([s.take(pa.array(np.zeros(len(f), dtype=np.int64))) for s, _, _, f in ready])
            same, at, f = (np.concatenate([r[k] for r in ready]) for k in (1, 2, 3))
            ready.clear()
            return pa.RecordBatch.from_arrays([who, pa.array(same), every.take(pa.array(at)), pa.array(f)], ["sample_idx", "is_sense", "feature", "f"])

        for (*at, streamed, who), rows in _runs(batches, [*CELL_KEY, "part", "streamed", "sample_idx"]):
            fresh = at != cell
            if fresh or streamed and who != sample:
                close()
            if ready and (fresh or sum(len(r[3]) for r in ready) >= BATCH):
                yield flush()
            if fresh:
                cell, held, every = at, [], None
            if not streamed:
                held.append(rows)
            elif held:
                if every is None:
                    every, strt, stop = pa.concat_arrays([r.column("feature") for r in held]), _numbers(held, "strt"), _numbers(held, "stop")
                    strand = np.concatenate([r.column("strand").to_numpy(zero_copy_only=False) for r in held])
                    signed = np.isin(strand.astype(str), SIDES)
                    pick = lambda side, m: (side, np.flatnonzero(m), strt[m], stop[m], (strand[m] == side) & signed[m])
                    sides = [pick(x, signed) for x in SIDES if signed.any()] + [pick(None, ~signed)] * bool((~signed).any())
                mine.append(rows)
            sample = who
        close()
        if ready:
            yield flush()

    return run


def shares(segments: DataFrame, features: DataFrame, tasks: int) -> DataFrame:
    """(sample_idx, is_sense, feature, f): each segment gives 1 in all to the features it overlaps; is_sense: those of its strand.

    Tables as in ``counted``. A feature lies in one cell, together with every segment that it may overlap, so each row
    of the result is made whole by one task, from running sums over the segments of one sample. Only a ``feature``
    that is given more than once takes a shuffle of the result. A hot cell goes to several tasks, each with all its features and some of the samples.
    """
    met = counted(segments, features).select("seg_no", "sample_idx", "ref", "strand", "strt", "stop", F.sum(F.col("s") + F.col("a")).over(Window.partitionBy("seg_no")).alias("n"))
    own = _one_cell(_ok(features)).withColumn("streamed", F.lit(False))
    other = _near_cells(met, own).withColumn("streamed", F.lit(True)).drop("seg_no")
    (parts, _), key = _parts(own, tasks, PARTS), [*CELL_KEY, "part"]
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    other = other.withColumn("part", F.pmod(F.xxhash64("sample_idx"), parts).cast("int"))
    rows = own.unionByName(other, allowMissingColumns=True).repartition(tasks, *key).sortWithinPartitions(*key, "streamed", "sample_idx")
    kinds = {f.name: f.dataType.simpleString() for f in [*segments.schema, *features.schema]}
    out = rows.mapInArrow(_share(), f"sample_idx {kinds['sample_idx']}, is_sense boolean, feature {kinds['feature']}, f double")
    if features.groupBy("feature").count().where("count > 1").limit(1).count():
        out = out.groupBy("sample_idx", "is_sense", "feature").agg(F.sum("f").alias("f"))
    return out


def _blocks(strt: np.ndarray, stop: np.ndarray, s_strt: np.ndarray, s_stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The overlaps of a block of segments with features sorted by start, as groups in which each segment overlaps each feature.

    Gives (segments of a group, segments, features of a group, features), both as places: all groups after one another.
    """
    near = np.flatnonzero(stop[: np.searchsorted(strt, s_stop.max(), "right")] >= s_strt.min())
    every = (strt[near] <= s_stop.min()) & (stop[near] >= s_strt.max())
    if every.any():
        n = len(s_strt)
        yield np.array([n]), np.arange(n), np.array([np.count_nonzero(every)]), near[every]
    near = near[~every]
    if len(near):
        m = np.zeros((len(near), 64), dtype=bool)
        m[:, : len(s_strt)] = (strt[near, None] <= s_stop) & (stop[near, None] >= s_strt)
        near, m = near[m.any(axis=1)], m[m.any(axis=1)]
        _, first, kind, n = np.unique(np.packbits(m, axis=1).view(np.uint64)[:, 0], return_index=True, return_inverse=True, return_counts=True)
        yield m[first].sum(axis=1), np.nonzero(m[first])[1], n, near[np.argsort(kind, kind="stable")]


def _split(n_segs: np.ndarray, segs: np.ndarray, n_feats: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups of ``_blocks`` with the features of those of more than ``GROUP`` overlaps dealt to several of the same segments."""
    most = np.maximum(GROUP // n_segs, 1)
    parts = -(-n_feats // most)
    if (parts == 1).all():
        return n_segs, segs, n_feats, feats
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    size, first = np.repeat(n_segs, parts), np.repeat(np.cumsum(n_segs) - n_segs, parts)
    again = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    most = np.repeat(most, parts)
    return size, segs[again], np.minimum(np.repeat(n_feats, parts) - nth * most, most), feats


def _list():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, sides, every = None, [], {}, None
        ready: list[tuple] = []

        def lists(counts: list[np.ndarray], values: list[pa.Array]) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)), pa.concat_arrays(values))

        def flush() -> pa.RecordBatch:
            same = np.concatenate([np.full(len(r[1]), r[0]) for r in ready])
            out = [pa.array(same), lists([r[1] for r in ready], [r[2] for r in ready]), lists([r[3] for r in ready], [every.take(pa.array(np.concatenate([r[4] for r in ready])))])]
            ready.clear()
            return pa.RecordBatch.from_arrays(out, ["is_sense", "segs", "features"])

        for (*at, streamed, side), rows in _runs(batches, [*CELL_KEY, "part", "streamed", "strand"]):
            if at != cell:
                if ready:
                    yield flush()
                cell, held, sides, every = at, [], {}, None
            if not streamed:
                held.append((side, rows))
                continue
            if not held:
                continue
            if every is None:
                feats = [r for _, r in held]
                every, strt, stop = pa.concat_arrays([r.column("feature") for r in feats]), _numbers(feats, "strt"), _numbers(feats, "stop")
                strand = np.concatenate([np.full(r.num_rows, x, dtype=object) for x, r in held])
                order = np.argsort(strt, kind="stable")
            if side not in sides:
                same = strand[order] == side if side is not None else np.zeros(len(order), dtype=bool)
                sides[side] = [(bool(sense), o, strt[o], stop[o]) for sense in (True, False) for o in [order[same == sense]] if len(o)]
            no, s_strt, s_stop = rows.column("seg_no"), _numbers([rows], "strt"), _numbers([rows], "stop")
            for i in range(0, rows.num_rows, BLOCK):
                for sense, o, f_strt, f_stop in sides[side]:
                    for groups in _blocks(f_strt, f_stop, s_strt[i : i + BLOCK], s_stop[i : i + BLOCK]):
                        n_segs, segs, n_feats, feats = _split(*groups)
                        if len(segs):
                            ready.append((sense, n_segs, no.take(pa.array(segs + i)), n_feats, o[feats]))
                if sum(len(r[4]) for r in ready) >= BATCH:
                    yield flush()
        if ready:
            yield flush()

    return run


def listed(segments: DataFrame, features: DataFrame, tasks: int) -> DataFrame:
    """(seg_no, feature, is_sense): each overlap of a segment with a feature once; is_sense: on the same strand.

    Tables as in ``counted``. Segments lie in one cell, sorted by their start, and a hot cell's are dealt over several tasks.
    Blocks of them are handed on together with the features that they overlap, and become rows only where these are read.
    Rows that follow one another have the same feature and orientation, and segments in the same order as those before, so they are written in little space.
    """
    own = _one_cell(_ok(segments)).select("seg_no", *CELL_KEY, "strand", "strt", "stop").withColumn("streamed", F.lit(True))
    other = _near_cells(_ok(features), own).withColumn("streamed", F.lit(False))
    (parts, first), key = _parts(own, tasks, LIST_PARTS, other), [*CELL_KEY, "part"]
    own = own.withColumn("part", F.pmod(F.xxhash64("seg_no"), parts).cast("int"))
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = other.unionByName(own, allowMissingColumns=True).repartitionById(tasks, F.pmod(first + F.col("part"), F.lit(tasks))).sortWithinPartitions(*key, "streamed", "strand", "strt")
    kinds = {f.name: f.dataType.simpleString() for f in [*segments.schema, *features.schema]}
    met = rows.mapInArrow(_list(), f"is_sense boolean, segs array<{kinds['seg_no']}>, features array<{kinds['feature']}>")
    return met.select("segs", "is_sense", F.explode("features").alias("feature")).select(F.explode("segs").alias("seg_no"), "feature", "is_sense")


class _Edges:
    """Sorted intervals that tell the first start and the last end among those that meet an interval."""

    def __init__(self, strt: np.ndarray, stop: np.ndarray):
        a, b = np.argsort(strt, kind="stable"), np.argsort(-stop, kind="stable")
        self.strt, self.top = strt[a], np.maximum.accumulate(stop[a])
        self.stop, self.low = stop[b], -np.minimum.accumulate(strt[b])

    def met(self, strt: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the given intervals meet any, and for these the first start and the last end of those met."""
        i = np.searchsorted(self.top, strt, "left")  # the first of those that end late enough
        hit = np.flatnonzero(i < len(self.strt))
        hit = hit[self.strt[i[hit]] <= stop[hit]]
        return hit, self.strt[i[hit]], self.stop[np.searchsorted(self.low, -stop[hit], "left")]


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell, held, edges = None, [], None
    for (*at, streamed), rows in _runs(batches, [*CELL_KEY, "strand", "streamed"]):
        if at != cell:
            cell, held, edges = at, [], None
        if not streamed:
            held.append(rows)
        elif held:
            edges = edges or _Edges(_numbers(held, "strt"), _numbers(held, "stop"))
            hit, first, last = edges.met(_numbers([rows], "strt"), _numbers([rows], "stop"))
            yield pa.RecordBatch.from_arrays([rows.column("feature").take(pa.array(hit)), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["feature", "strt", "stop"])


def bounds_met(features: DataFrame, others: DataFrame) -> DataFrame:
    """(feature, strt, stop): the first start and the last end among the rows of ``others`` that overlap a feature on its strand.

    ``others`` are (ref, strand, strt, stop), ``features`` as in ``counted``. A feature lies in one cell, together with every
    row that it may overlap; one that overlaps none has no row, and one that is given twice has two. A null strand meets nothing.
    """
    own = _one_cell(_ok(features).where("strand IS NOT NULL")).withColumn("streamed", F.lit(True))
    near = _near_cells(_ok(others).where("strand IS NOT NULL"), own).withColumn("streamed", F.lit(False))
    key = [*CELL_KEY, "strand"]
    rows = near.unionByName(own, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "streamed")
    return rows.mapInArrow(_bound, f"feature {features.schema['feature'].dataType.simpleString()}, strt bigint, stop bigint")
