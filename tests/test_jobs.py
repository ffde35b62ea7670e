"""Polled jobs: ends, missing results, time-outs by own polls and by the watermark, restarts."""

import datetime

import pytest

from kinelake.streaming import jobs

SCHEMA = "job string, at timestamp, n long, status string, result string"


@pytest.fixture
def run(spark, tmp_path):
    """Adds a file of polls, lets the stream read it, and gives the rows of all runs so far: job, state, second, polls."""
    number, day = [0], datetime.datetime(2026, 1, 1)

    def go(*polls):
        rows = [(j, None if s is None else day + datetime.timedelta(seconds=s), n, st, r) for j, s, n, st, r in polls]
        number[0] += 1
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"file://{tmp_path}/in/{number[0]}")
        from pyspark.sql import functions as F

        stream = spark.readStream.schema(SCHEMA).json(f"file://{tmp_path}/in/*")
        out = jobs.outcomes(stream, "job", "at", "n", "status", 100, F.col("result"), "1 second")
        put = lambda b, k: b.write.mode("overwrite").parquet(f"file://{tmp_path}/out/{number[0]}-{k}")
        out.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.job, r.state, (r.at - day).total_seconds(), r.polls) for r in spark.read.parquet(f"file://{tmp_path}/out/*").collect())

    return go


def test_outcomes(run):
    first = run(
        ("a", 5, 2, "completed", "x"), ("a", 0, 1, "queued", None), ("b", 0, 1, None, None), ("c", 1, 1, "completed", None), ("d", 2, 2, "failed", None), ("d", 2, 1, "cancelled", None),
        ("e", 0, 1, "running", None), ("e", 101, 2, "completed", "x"), ("f", 0, 1, "running", None), ("f", 100, 2, "completed", "x"), (None, 1, 1, "failed", None), ("g", None, 1, "failed", None), ("h", 90, 1, "running", None),
    )
    known = [("a", "done", 5.0, 2), ("c", "missing", 1.0, 1), ("d", "failed", 2.0, 2), ("e", "timed out", 100.0, 2), ("f", "done", 100.0, 2)]
    assert [r for r in first if r[0] != "b"] == known
    # state is there after a restart: h ends, a and e stay what they are, b is out by the watermark
    second = run(("h", 150, 2, "completed", "y"), ("a", 160, 3, "failed", None), ("e", 160, 3, "completed", "z"), ("i", 170, 1, "running", None))
    assert second == sorted([*known, ("b", "timed out", 100.0, 1), ("h", "done", 150.0, 2)])


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "double"])
def test_many_jobs_are_folded_by_the_group(spark, tmp_path, kind):
    """Three runs against a loop over polls; the state has a row for each group of jobs, not for each job."""
    import random

    from pyspark.sql import functions as F

    rng, n, wait = random.Random(5), 300 if kind != "double" else 20, 100
    runs = [[(rng.randrange(n), rng.randrange(200 * k, 200 * k + 200), rng.choice([None, 1, 2, 2**60, 2**60 + 1]), rng.choice(["queued", None, "completed", "failed"])) for _ in range(2 * n)] for k in range(3)]
    expected, state, watermark = [], {}, 0
    for k, polls in enumerate(runs):
        batch = {}
        for job, at, number, status in polls:
            batch.setdefault(job, []).append((at, -1 if number is None else number, {"completed": "done", "failed": "failed"}.get(status)))
        for job, rows in batch.items():
            if state.get(job) != "over":
                state[job] = [*state.get(job, []), *rows]
        watermark = max(watermark, max(p[1] for p in polls) - 1)
        for job, rows in state.items():
            if rows == "over":
                continue
            first, last, ends = min(r[0] for r in rows), max(r[0] for r in rows), sorted(r for r in rows if r[2])
            timely = ends and ends[0][0] <= first + wait
            # equal polls that end a job differently have no order
            if timely or last > first + wait or first + wait < watermark:
                how = {r[2] for r in ends if r[:2] == ends[0][:2]} if timely else {"timed out"}
                expected.append((job, how, ends[0][0] if timely else first + wait, len(rows)))
                state[job] = "over"
    day = datetime.datetime(2026, 1, 1)
    for k, polls in enumerate(runs):
        rows = [(job, day + datetime.timedelta(seconds=at), number, status) for job, at, number, status in polls]
        spark.createDataFrame(rows, "job long, at timestamp, n long, status string").withColumn("job", F.col("job").cast(kind)).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(f"job {kind}, at timestamp, n long, status string").parquet(f"file://{tmp_path}/in/*")
        put = lambda b, i, k=k: b.write.mode("overwrite").parquet(f"file://{tmp_path}/out/{k}-{i}")
        query = jobs.outcomes(stream, "job", "at", "n", "status", wait, late="1 second", groups=4).writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= (4 if kind != "double" else n)
    got = sorted((int(float(r.job)), r.state, (r.at - day).total_seconds(), r.polls) for r in spark.read.parquet(f"file://{tmp_path}/out/*").collect())
    assert len(got) == len(expected)
    for g, e in zip(got, sorted(expected, key=lambda x: x[0]), strict=True):
        assert (g[0], *g[2:]) == (e[0], *e[2:]) and g[1] in e[1]
