"""Jobs that are polled until they end: a stream of polls to one row for each job, when it is known how it ended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How statuses end a job; any other, null included, leaves it open.
ENDS = {"completed": "done", "failed": "failed", "cancelled": "failed"}
OUTCOME = "state string, at timestamp, polls long"
#: The state of a group of jobs is one table, as Arrow writes it: a row a job, times in milliseconds.
STATE = "jobs binary"
COLUMNS = {"first": "int64", "last": "int64", "end": "int64", "number": "int64", "ends": "int8", "polls": "int64", "over": "bool"}
#: Types whose equal values are equal to Python too.
PLAIN = {"string", "binary", "boolean", "tinyint", "smallint", "int", "bigint", "date"}
LOW, HIGH = -(2**63), 2**63 - 1


class Jobs:
    """Jobs of a group by position, in arrays: first and last poll, the first poll that ends the job and how (its place among the
    names of ends from 1 on, or 0), number of polls, and whether the outcome is known."""

    def __init__(self, kept: bytes | None) -> None:
        table = pa.ipc.open_stream(kept).read_all().to_pandas() if kept else pd.DataFrame({"job": pd.Series([], dtype=object)} | {c: np.zeros(0, t) for c, t in COLUMNS.items()})
        self.job = table["job"]
        for c in COLUMNS:
            setattr(self, c, table[c].to_numpy(copy=True))

    def kept(self) -> bytes:
        table, out = pa.Table.from_pandas(pd.DataFrame({"job": self.job} | {c: getattr(self, c) for c in COLUMNS}), preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()

    def positions(self, job: pd.Series) -> np.ndarray:
        """Where each job is; new ones are added at the end."""
        had = len(self.job)
        known = pd.concat([self.job, job], ignore_index=True) if had else job.reset_index(drop=True)
        codes, _ = pd.factorize(known)
        more = int(codes.max()) + 1 - had
        if more:
            at = np.unique(codes, return_index=True)[1]
            self.job = known.iloc[at].reset_index(drop=True)
            for c, value in zip(COLUMNS, (HIGH, LOW, HIGH, HIGH, 0, 0, False), strict=True):
                setattr(self, c, np.concatenate([getattr(self, c), np.full(more, value, COLUMNS[c])]))
        return codes[had:]

    def add(self, polls: pd.DataFrame) -> None:
        """Folds polls in; those of jobs whose outcome is known are ignored."""
        at = self.positions(polls["job"])
        ms, number, ends = (polls[c].to_numpy() for c in ("ms", "number", "ends"))
        np.minimum.at(self.first, at, ms)
        np.maximum.at(self.last, at, ms)
        self.polls += np.where(self.over, 0, np.bincount(at, minlength=len(self.polls)))
        ended = np.flatnonzero(ends)
        ended = ended[np.lexsort((number[ended], ms[ended], at[ended]))]
        ended = ended[np.unique(at[ended], return_index=True)[1]]
        job = at[ended]
        sooner = (ms[ended] < self.end[job]) | (ms[ended] == self.end[job]) & (number[ended] < self.number[job]) | (self.ends[job] == 0)
        job, ended = job[sooner], ended[sooner]
        self.end[job], self.number[job], self.ends[job] = ms[ended], number[ended], ends[ended]

    def settle(self, wait: int, watermark: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of jobs whose outcome is known only now, and whether they ended in time."""
        limit = self.first + wait
        timely = (self.ends > 0) & (self.end <= limit)
        now = np.flatnonzero(~self.over & (timely | (self.last > limit) | (0 < watermark) & (limit < watermark)))
        self.over[now] = True
        return now, timely[now]


def outcomes(polls: DataFrame, job: str, at: str, number: str, status: str, patience: int, result: Column | None = None, late: str = "1 minute", groups: int = 1024) -> DataFrame:
    """job, state, at and polls of each job of a stream, once. Polls are in order of ``at`` and, where that ties, ``number``. A
    job is done or failed by its first poll that ends it; ``missing`` if that says completed and ``result`` is null; ``timed
    out`` at ``patience`` seconds after its first poll if none has ended it by then, be that known from a later poll of its own
    or from the watermark, which is ``late`` behind the newest poll of any job. polls counts those up to the batch that
    settled it. Jobs that are open give no row yet; polls of a job that has ended are ignored, so ended jobs are remembered.

    Jobs are dealt to ``groups`` groups by hash, and a batch is folded into the state of a group at once: a row of constant size
    for each job, whatever the number and order of its polls. So a batch costs by its polls and by the jobs of the groups that
    it meets, not a call for each job (but jobs named by other types than PLAIN and decimals are a group each). The number of groups belongs to the stream and stays as it is over restarts, as its state
    does. Polls without job or at are left out; a poll older than the watermark comes too late."""
    key, names = dict(polls.dtypes)[job], sorted({*ENDS.values(), "missing"})
    many = key in PLAIN or key.startswith("decimal")
    ends = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])[F.col(status)]
    if result is not None:
        ends = F.when((ends == "done") & result.isNull(), "missing").otherwise(ends)
    rows = polls.where(F.col(job).isNotNull() & F.col(at).isNotNull()).select(
        (F.pmod(F.xxhash64(job), F.lit(groups)) if many else F.col(job)).alias("group"), (F.col(job) if many else F.lit(0)).alias("job"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"),
        F.coalesce(F.col(number).cast("long"), F.lit(LOW)).alias("number"), F.coalesce(F.array_position(F.lit(names), ends), F.lit(0)).cast("tinyint").alias("ends"),
    )
    wait = patience * 1000

    def fold(group: tuple, batches: Iterator, state: GroupState) -> Iterator:
        jobs, watermark = Jobs(state.get[0] if state.exists else None), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for b in batches:
                if len(b):
                    jobs.add(b)
        now, timely = jobs.settle(wait, watermark)
        state.update((jobs.kept(),))
        if not jobs.over.all():
            state.setTimeoutTimestamp(max(int(jobs.first[~jobs.over].min()) + wait, watermark + 1))
        if len(now):
            how = np.where(timely, np.array(["", *names], object)[jobs.ends[now]], "timed out")
            when = np.where(timely, jobs.end[now], jobs.first[now] + wait)
            name = jobs.job.iloc[now].reset_index(drop=True) if many else [group[0]]
            yield pd.DataFrame({"job": name, "state": how, "at": pd.to_datetime(when, unit="ms", utc=True), "polls": jobs.polls[now]})

    stream = rows.withWatermark("at", late).groupBy("group")
    out = stream.applyInPandasWithState(fold, f"job {key}, {OUTCOME}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("job", job)
