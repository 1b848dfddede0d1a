"""Time-left estimates from progress readings, and from what earlier runs took."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillwork.functions.num import half_up
from quillwork.stages import Stages

# --- fixed values -----------------------------------------------------------------------
MIN_PROGRESS = 0.06
MIN_ELAPSED_MS = 600
MIN_SHOWN_MS = 1500
SMOOTHING = 0.25
RISE = 0.18
FLOOR_MS = 200
CEILING_MS = 600_000
KEEP_RUNS = 8
MIN_RUNS = 2
# ----------------------------------------------------------------------------------------

PIECE = 10_000  # readings estimated at once, and of a staged block

READING = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("remaining_ms", T.DoubleType()),
    T.StructField("elapsed_ms", T.LongType()),
    T.StructField("confident", T.BooleanType()),
])
#: What a run carries from one stretch of readings to the next.
CARRIED = {"start": None, "mark_t": None, "mark_p": None, "rate": None, "shown": None, "shown_t": None, "known": False}
STATE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("mark_t", T.LongType()), T.StructField("mark_p", T.DoubleType()),
    T.StructField("rate", T.DoubleType()), T.StructField("shown", T.DoubleType()), T.StructField("shown_t", T.LongType()),
    T.StructField("known", T.BooleanType())])
IDLE_MS = 24 * 3600 * 1000  # a stream forgets a run this long after its last reading


def advances(ts: np.ndarray, ps: np.ndarray, mark: tuple) -> np.ndarray:
    """Places of the readings that are later and further than the one before them that was; ``mark`` is the last so far."""
    found, (t, p) = [], mark
    # nothing at or below the top of what was there can advance, so only new tops are looked at, and readings after a tie
    tops = np.fmax.accumulate(np.concatenate([[p], ps[:-1]]))
    tied = np.concatenate([[ts[0] == t], ts[1:] == ts[:-1]]).any()
    for i in range(len(ts)) if tied else np.flatnonzero(ps > tops):
        if ts[i] > t and ps[i] > p:
            t, p = ts[i], ps[i]
            found.append(i)
    return np.array(found, dtype=np.int64)


def begun(ts: np.ndarray, ps: np.ndarray, carried: dict) -> tuple[dict, int]:
    """The state a stretch is entered with, and how many readings it takes to start a run."""
    if carried["start"] is not None:
        return dict(carried), 0
    return dict(carried) | {"start": int(ts[0]), "mark_t": int(ts[0]), "mark_p": float(ps[0])}, 1


def speeds(ts: np.ndarray, ps: np.ndarray, state: dict, skip: int) -> tuple[np.ndarray, list]:
    """Places of the readings that move on, and the speed each of them was reached with."""
    at = advances(ts[skip:], ps[skip:], (state["mark_t"], state["mark_p"])) + skip if len(ts) > skip else np.zeros(0, np.int64)
    t, p = np.concatenate([[state["mark_t"]], ts[at]]), np.concatenate([[state["mark_p"]], ps[at]])
    return at, (np.diff(p) / np.diff(t)).tolist()


def paced(ts: np.ndarray, ps: np.ndarray, state: dict, skip: int) -> tuple[np.ndarray, dict, np.ndarray]:
    """The rate at each reading, a linear recurrence over speeds; the state after it; and the readings due an estimate."""
    n = len(ts)
    rates = np.full(n, np.nan if state["rate"] is None else state["rate"])
    at, told = speeds(ts, ps, state, skip)
    if len(at):
        before = told if state["rate"] is None else [state["rate"], *told]
        smooth = list(accumulate(before, lambda r, s: r + SMOOTHING * (s - r)))[-len(at):]
        rates[at[0]:] = np.repeat(smooth, np.diff(np.append(at, n)))
        state = state | {"mark_t": int(ts[at[-1]]), "mark_p": float(ps[at[-1]]), "rate": smooth[-1]}
    due = ~np.isnan(rates) & (ps >= MIN_PROGRESS) & (ts - state["start"] >= MIN_ELAPSED_MS) & (ps < 1)
    due[:skip] = False
    return rates, state, np.flatnonzero(due)


def stretch(ts: np.ndarray, ps: np.ndarray, carried: dict) -> tuple[dict, dict]:
    """Estimates for readings of one run in order, as columns, and what to carry on.

    Three passes: the readings that move on; the rate, a linear recurrence over their speeds, spread to all readings; and the
    shown time, a fold over the readings at which an estimate is due. It falls freely and takes up a part of any rise
    over what the last shown time has aged to.
    """
    ps = np.clip(ps.astype(float), 0.0, 1.0)
    state, skip = begun(ts, ps, carried)
    rates, got, places = paced(ts, ps, state, skip)

    def show(last: tuple, i: int) -> tuple:
        left = (1 - ps[i]) / rates[i]
        if last[0] is not None:
            aged = max(0.0, last[0] - (ts[i] - last[1]))
            left = min(left, aged + RISE * max(0.0, left - aged))
        return max(0.0, left), int(ts[i])

    shown = list(accumulate(places, show, initial=(got["shown"], got["shown_t"])))[1:]
    remaining, sure = np.full(len(ts), np.nan), np.zeros(len(ts), bool)
    if shown:
        values = np.array([v for v, _ in shown])
        remaining[places] = values
        sure[places] = got["known"] | np.logical_or.accumulate(values >= MIN_SHOWN_MS)
        got |= {"shown": float(values[-1]), "shown_t": shown[-1][1], "known": bool(sure[places[-1]])}
    return {"remaining_ms": remaining, "elapsed_ms": ts - got["start"], "confident": sure}, got


# --- a run over many tasks: each block of readings as maps from what it is entered with to what it leaves ----------------
#
# A mark is raised by steps, a rate by affine maps, a shown time by affine maps between two bounds. All three are closed under
# composition, so a block is summed up without knowing what came before it, and only those sums are gone through in order.


def mark_steps(ts: np.ndarray, ps: np.ndarray) -> list[tuple]:
    """The last mark of a block as a function of the mark it is entered with: rows of (below, progress, time) by rising ``below``.

    A mark under ``below`` (and not under the row before) ends at that progress and time; one above all rows stays. Without
    two readings in a millisecond this is one row, the first reading of the greatest progress.
    """
    good = ~np.isnan(ps)
    ts, ps = ts[good], ps[good]
    if not len(ts):
        return []
    if not (ts[1:] == ts[:-1]).any():
        top = int(ps.argmax())
        return [(float(ps[top]),  float(ps[top]), int(ts[top]))]
    steps: list[list] = []
    first = np.append(True, ts[1:] != ts[:-1]).nonzero()[0]
    for lo, hi in zip(first, [*first[1:], len(ts)]):
        tops = np.unique(np.maximum.accumulate(ps[lo:hi]))  # only a new top of its millisecond can be the first above a mark
        if steps and steps[0][1] >= tops[-1] and steps[-1][0] >= tops[-1]:
            continue
        t, after = int(ts[lo]), []
        for below, p, at in steps:
            if p < tops[-1]:
                p, at = float(tops[np.searchsorted(tops, p, side="right")]), t
            after.append([below, p, at])
        reach = steps[-1][0] if steps else -np.inf
        after += [[float(r), float(r), t] for r in tops if r > reach]
        steps = []
        for row in after:  # neighbours that end alike are one row
            if steps and steps[-1][1:] == row[1:]:
                steps[-1][0] = row[0]
            else:
                steps.append(row)
    return [tuple(s) for s in steps]


def mark_map(ts: np.ndarray, ps: np.ndarray, state: dict) -> list[float]:
    """First reading, steps of a block entered in the millisecond of the mark, steps of one entered later."""
    same = mark_steps(ts[ts != ts[0]], ps[ts != ts[0]])
    return [float(ts[0]), float(ps[0]), float(len(same)), *(x for s in same + mark_steps(ts, ps) for x in s)]


def mark_step(state: list | None, told: np.ndarray) -> list:
    start, t, p = state if state is not None else (told[0], told[0], told[1])
    rows, n = np.reshape(told[3:], (-1, 3)), int(told[2])
    rows = rows[:n] if t == told[0] else rows[n:]
    i = np.searchsorted(rows[:, 0], p, side="right")
    return [start, rows[i, 2], rows[i, 1]] if i < len(rows) else [start, t, p]


def rate_map(ts: np.ndarray, ps: np.ndarray, state: dict) -> list[float]:
    """(first speed, a, b) with a * rate + b as the last rate; a rate not known yet counts as the first speed."""
    state, skip = begun(ts, ps, state)
    told = speeds(ts, ps, state, skip)[1]
    if not told:
        return []
    last = list(accumulate(told, lambda b, s: b + SMOOTHING * (s - b), initial=0.0))[-1]
    return [told[0], (1 - SMOOTHING) ** len(told), last]


def rate_step(state: list | None, told: np.ndarray) -> list | None:
    return state if not len(told) else [told[1] * (told[0] if state is None else state[0]) + told[2]]


def shown_map(ts: np.ndarray, ps: np.ndarray, state: dict) -> list[float]:
    """(first and last time due, first time left, a, b, low, high, sure): a block's last shown time is a * x + b between two bounds,
    x being the shown time it is entered with less its age. From ``sure`` on, some time shown is long enough to be told."""
    state, skip = begun(ts, ps, state)
    rates, _, due = paced(ts, ps, state, skip)
    if not len(due):
        return []
    left, t = (1 - ps[due]) / rates[due], ts[due]
    a, b, low, high, sure = 1.0, 0.0, -np.inf, np.inf, np.inf
    for x, age in zip(left.tolist(), [0, *np.diff(t).tolist()]):
        def onward(v):
            return min(x, max(0.0, v - age) * (1 - RISE) + x * RISE)
        a, b, low, high = a * (1 - RISE), (b - age) * (1 - RISE) + x * RISE, onward(low), onward(high)
        if low >= MIN_SHOWN_MS:
            sure = -np.inf
        elif high >= MIN_SHOWN_MS and a > 0:
            sure = min(sure, (MIN_SHOWN_MS - b) / a)
    return [float(t[0]), float(t[-1]), float(left[0]), a, b, low, high, sure]


def shown_step(state: list | None, told: np.ndarray) -> list | None:
    if not len(told):
        return state
    first, last, left, a, b, low, high, sure = told
    x = left if state is None else state[0] - (first - state[1])
    known = state is not None and state[2] > 0 or x >= sure
    return [min(high, max(low, a * x + b)), last, float(known)]


def blocks(progress: DataFrame, size: int) -> DataFrame:
    """Readings in order, ``size`` at most a row, numbered (part, k); ``runs`` ends at ``ends`` in its arrays."""
    ordered = progress.select("run_id", "seq", "ts_ms", F.col("p").cast("double").alias("p")) \
        .repartitionByRange("run_id", "ts_ms").sortWithinPartitions("run_id", "ts_ms", "seq", "p")

    def pack(batches):
        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, len(whole), size):
                pdf = whole.iloc[at : at + size]
                run = pdf["run_id"].to_numpy(dtype=object)
                ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run))
                yield pd.DataFrame({"part": [part], "k": [k], "runs": [run[ends - 1]], "ends": [ends], **{
                    c: [pdf[c].to_numpy()] for c in ("seq", "ts_ms", "p")}})
                k += 1

    return ordered.mapInPandas(pack, "part int, k bigint, runs array<string>, ends array<int>, seq array<bigint>, ts_ms array<bigint>,"
                                     " p array<double>")


def entered(row) -> dict:
    """What is known so far of the state a block's first run is entered with."""
    state = dict(CARRIED)
    if getattr(row, "mark", None) is not None:
        state |= {"start": int(row.mark[0]), "mark_t": int(row.mark[1]), "mark_p": float(row.mark[2])}
    if getattr(row, "rate", None) is not None:
        state["rate"] = float(row.rate[0])
    if getattr(row, "shown", None) is not None:
        state |= {"shown": float(row.shown[0]), "shown_t": int(row.shown[1]), "known": row.shown[2] > 0}
    return state


def carry(held: DataFrame, name: str, sums: Callable, step: Callable) -> DataFrame:
    """``held`` with what each block's first run is entered with, as column ``name``.

    Every block gives the map of its last run, which is all the next block can need. The maps are gone through run by run in order,
    a row at a time: one number row for a block of readings. Blocks whose first run starts there meet no row.
    """
    def sum_up(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                one = len(row.runs) == 1
                lo = 0 if one else row.ends[-2]
                told = sums(row.ts_ms[lo:], np.clip(row.p[lo:], 0.0, 1.0), entered(row) if one else CARRIED)
                out += [] if one else [(row.runs[0], row.part, row.k, True, None)]
                out.append((row.runs[-1], row.part, row.k, one, told))
            yield pd.DataFrame(out, columns=["run_id", "part", "k", "takes", "told"])

    def go(batches):
        run, state, none = None, None, True
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if none or r.run_id != run:
                    run, state, none = r.run_id, None, False
                if r.takes and state is not None:
                    out.append((r.part, r.k, state))
                if r.told is not None:
                    state = step(state, r.told)
            yield pd.DataFrame(out, columns=["part", "k", name])

    maps = held.drop("seq").mapInPandas(sum_up, "run_id string, part int, k bigint, takes boolean, told array<double>")
    got = maps.repartition("run_id").sortWithinPartitions("run_id", "part", "k").mapInPandas(
        go, f"part int, k bigint, {name} array<double>")
    return held.join(got, ["part", "k"], "left")


def progress_eta(progress: DataFrame, size: int = PIECE) -> DataFrame:
    """E4 over stored readings (run_id, seq, ts_ms, p): a run's readings are on as many tasks as they fill.

    Readings are range-partitioned by run and time and staged in blocks of ``size``. Three times each block is summed up as a map and
    the maps are composed in order: the last mark, then the rate, then the shown time. With that in hand every block is told
    apart from the others. A run that lies in one block is worked out as in the stream, number for number; over several
    blocks rates and times agree to rounding. Readings without a time have no estimate; those without progress move nothing.
    The staged blocks stay in the shared folder, since the result reads them.
    """
    r = progress.select(F.col("run_id").cast("string").alias("run_id"), "seq", F.col("ts_ms").cast("long").alias("ts_ms"), "p")
    held = Stages(progress.sparkSession, "progress").put("blocks", lambda: blocks(r.where("ts_ms IS NOT NULL"), size))
    for name, sums, step in [("mark", mark_map, mark_step), ("rate", rate_map, rate_step), ("shown", shown_map, shown_step)]:
        held = carry(held, name, sums, step)

    def tell(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                parts, state = [], entered(row)
                for lo, hi in zip([0, *row.ends[:-1]], row.ends):
                    parts.append(stretch(row.ts_ms[lo:hi], row.p[lo:hi], state)[0])
                    state = CARRIED
                yield pd.DataFrame({
                    "run_id": np.repeat(np.array(row.runs, dtype=object), np.diff([0, *row.ends])), "seq": row.seq,
                    **{c: np.concatenate([q[c] for q in parts]) for c in parts[0]}})

    untimed = r.where("ts_ms IS NULL").selectExpr("run_id", "seq", "cast(NULL AS double) AS remaining_ms",
                                                  "cast(NULL AS bigint) AS elapsed_ms", "false AS confident")
    return held.mapInPandas(tell, READING).unionByName(untimed)


class ProgressEta(StatefulProcessor):
    """E4 as streaming state, forgotten ``idle_ms`` after a run's last reading."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        carried = dict(zip(CARRIED, self.state.get())) if self.state.exists() else CARRIED
        # a run's rows come in pieces in no order; three numbers a reading are held until the micro-batch's are together
        whole = pd.concat([pdf[["ts_ms", "seq", "p"]] for pdf in rows]).sort_values(["ts_ms", "seq"])
        for at in range(0, len(whole), PIECE):
            pdf = whole.iloc[at : at + PIECE]
            told, carried = stretch(pdf["ts_ms"].to_numpy(), pdf["p"].to_numpy(), carried)
            yield pd.DataFrame({"run_id": str(key[0]), "seq": pdf["seq"].to_numpy(), **told})
        self.state.update(tuple(carried.values()))

    def close(self) -> None:
        pass


def progress_eta_stream(progress: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """E4 on a stream. A micro-batch's readings of a run are taken in time order, however they are cut up; readings of a later
    micro-batch that are older than ones already taken do not move the rate."""
    return progress.groupBy("run_id").transformWithStateInPandas(
        ProgressEta(idle_ms), outputStructType=READING, outputMode="Append", timeMode="ProcessingTime")


def eta_text(ms: Column) -> Column:
    """E5: coarse words for a time left."""
    s = half_up(ms / 1000)
    half = half_up(s / 30) / 2
    n = F.when(half == F.floor(half), half.cast("bigint").cast("string")).otherwise(half.cast("string"))
    return (F.when(ms.isNull(), "")
            .when(s <= 1, "almost done")
            .when(s < 10, F.concat(F.lit("about "), s.cast("string"), F.lit(" seconds left")))
            .when(s < 60, F.concat(F.lit("about "), (half_up(s / 5) * 5).cast("string"), F.lit(" seconds left")))
            .when(half == 1, "about a minute left")
            .otherwise(F.concat(F.lit("about "), n, F.lit(" minutes left"))))


def wait_text(ms: Column) -> Column:
    s = F.ceil(ms / 1000)
    return (F.when(s <= 1, "a moment").when(s < 60, F.concat(s.cast("string"), F.lit(" seconds")))
            .otherwise("a minute"))


def op_estimate(runs: DataFrame, ops: list[str]) -> DataFrame:
    """Median of an operation's last eight believable runs; runs(op, o, ms).

    Ranking to eight is pruned before the shuffle, so a hot operation sends eight rows per task.
    """
    r = runs.where(F.col("op").isin(*ops) & F.col("ms").between(FLOOR_MS, CEILING_MS))
    r = r.select("op", "o", half_up(F.col("ms")).alias("ms"))
    k = F.row_number().over(W.partitionBy("op").orderBy(F.desc("o")))
    last = r.withColumn("k", k).where(F.col("k") <= KEEP_RUNS)
    return last.groupBy("op").agg(
        half_up(F.median("ms")).cast("bigint").alias("ms"), F.count("*").alias("samples")).where(
        F.col("samples") >= MIN_RUNS)


def remembered_eta(running: DataFrame, estimates: DataFrame) -> DataFrame:
    """Time left by memory; running(op, pct, elapsed_ms, ...). Blank below 1.5 s."""
    j = running.join(estimates, "op")
    left = F.col("ms") * (1 - F.least(F.col("pct"), F.lit(0.95))) - F.col("elapsed_ms")
    return j.withColumn("left_ms", left).where(F.col("left_ms") >= MIN_SHOWN_MS)
