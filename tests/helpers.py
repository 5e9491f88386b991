"""Small profiles, and plain-Python answers to compare with."""

import json
import re


def node(address="10.0.0.1", port=45678, memory=1048576, enqueued=3):
    return {
        "endpoint": {"address": address, "fabricPort": port},
        "maxMemoryUsed": memory,
        "timeEnqueuedBeforeSubmitMs": enqueued,
    }


def scheduling(**changes):
    block = {
        "resourceSchedulingStart": 1010,
        "resourceSchedulingEnd": 1020,
        "queueName": "high",
        "ruleName": "rule",
        "schedulingProperties": {"queryCost": 2.5, "queryType": "UI"},
    }
    return without(block | changes)


def profile(states=((1, 1000), (8, 1130), (9, 1350)), nodes=(), **changes):
    """A complete profile; a change to ``...`` removes the key."""
    return without(
        {
            "user": "ann",
            "start": 1000,
            "end": 1400,
            "commandPoolWaitMillis": 1,
            "totalFragments": 7,
            "finishedFragments": 7,
            "planningStart": 1005,
            "planningEnd": 1009,
            "executionStart": 1130,
            "query": "SELECT 1",
            "resourceSchedulingProfile": scheduling(),
            "stateList": [{"state": c, "startTime": t} for c, t in states],
            "nodeProfile": list(nodes),
        }
        | changes
    )


def without(d):
    return {k: v for k, v in d.items() if v is not ...}


def lines_frame(spark, entries):
    """``entries`` are ``(query id, attempt, profile or text)``."""
    rows = [
        (f"profile_{q}.json", a, p if isinstance(p, str) else json.dumps(p)) for q, a, p in entries
    ]
    return spark.createDataFrame(rows, "file_name STRING, attempt BIGINT, line STRING")


def write_files(directory, files):
    """``files`` maps a name to raw text or to a list of profiles."""
    directory.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        if not isinstance(content, str):
            content = "".join(json.dumps(p) + "\n" for p in content)
        (directory / name).write_bytes(content.encode())
    return str(directory)


def expected_phases(entries):
    """``(state, start, end, duration)`` by state code, from ``(code, time)`` in file order."""
    last = dict(entries)
    top = max((c for c, _ in entries), default=0)
    seen = sorted((c, t) for c, t in last.items() if t > 0)
    out = []
    for i, (code, start) in enumerate(seen):
        if i + 1 == len(seen):
            end = last[top]
        elif code == 0:
            out.append((0, start, 0, 0))
            continue
        else:
            end = seen[i + 1][1]
        out.append((code, start, end, end - start))
    return out, top


def expected_ticks(entries, tick):
    phases, top = expected_phases(entries)
    return [
        (t * tick, code, duration)
        for code, start, end, duration in phases
        if code != top
        for t in range(start // tick, end // tick + 1)
    ]


def rows(df):
    """Rows as a sorted list of tuples; None sorts first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


def plan(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    """The physical plan with the columns that each step takes in."""
    spark = df.sparkSession
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def count_in_plan(df, pattern):
    return len(re.findall(pattern, plan(df)))
