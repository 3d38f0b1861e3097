"""Scores that lie on a limit, and sums that tie: the same rows as SQL, in whatever order rows arrive."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rostrum import catalogue
from rostrum.operators import delivery, report

SF = "/root/testdata/sf0.001"


def scores(seconds):
    """z-scores of a talk's slides by deviations summed up in this order."""
    mean, m2 = 0.0, 0.0
    for n, v in enumerate(seconds, 1):
        step = mean + (v - mean) / n
        m2 += (v - step) * (v - mean)
        mean = step
    return [(v - sum(seconds) / len(seconds)) / math.sqrt(m2 / len(seconds)) for v in seconds]


#: Words of the two slides of a talk: of these many pairs the shorter slide's z-score is -1 less the last bit, of many -1.
PAIRS = [(a, b) for a in range(3, 40) for b in range(2, 40, 3) if a != b]


def either_way(pair):
    """SQL doesn't say in which order its window sums up: whether both orders put the shorter slide on the same side of -1."""
    x = [(400 * pair[0] + 1200) / 1000.0, (400 * pair[1] - 100) / 1000.0]
    return (min(scores(x)) < -1) == (min(scores(x[::-1])) < -1)


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """Tables with talks of two slides each."""
    to = tmp_path_factory.mktemp("talks")
    for t in ("documents", "labels", "nation"):
        os.symlink(f"{SF}/{t}.parquet", to / f"{t}.parquet")
    rows = [(i, turn, "user", " ".join(["word"] * n)) for i, pair in enumerate(filter(either_way, PAIRS)) for turn, n in enumerate(pair)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(to / "conversations.parquet"))
    return str(to)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["issues", "severity", "highlights", "feedback_text", "compact_report", "report_snapshot", "snapshot_delta", "service_result", "calibration_snapshot"])
def test_talks_of_two_slides(spark, talks, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{talks}/{t}.parquet')")
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{talks}/conversations.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, talks)
    r = c.execute(catalogue.ORACLE[name])
    at = [[d[0] for d in r.description].index(x) for x in sorted(df.columns)]
    want = sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
    assert sorted(repr(tuple(x[k] for k in sorted(df.columns))) for x in df.collect()) == want


def test_dwell_does_not_depend_on_the_order_of_rows(spark):
    rows = [(s, k, 0, 400 * n + 1200) for s, pair in enumerate(PAIRS) for k, n in enumerate(pair, 1)]
    segments = spark.createDataFrame(rows, "session_id int, slide_id int, start_ms long, end_ms long")
    counts = segments.select("session_id", "slide_id", F.lit(3).alias("word_count"))
    want = {}
    for s, pair in enumerate(PAIRS):
        x = [(400 * n + 1200) / 1000.0 for n in pair]
        want |= {(s, k): z for k, z in enumerate(scores(x), 1)}
    for order in ("slide_id", F.desc("slide_id")):
        got = {(r.session_id, r.slide_id): r.dwell_z for r in delivery.dwell(segments.coalesce(1).sort(order), counts).collect()}
        assert got == want


def test_pitch_sums_that_tie(spark):
    """0.1 + 0.2 is no more than 0.3: the lower slide is taken."""
    changes = spark.createDataFrame([(1, 1, "pitch_shift", 0.3), (1, 2, "pitch_shift", 0.1), (1, 2, "pitch_shift", 0.2)], "session_id int, slide_id int, type string, magnitude double")
    counts = spark.createDataFrame([(1, 2)], "session_id int, n_slides int")
    assert [(r.slide_id, r.pitch_score) for r in report.pitch_slides(changes, counts).collect()] == [(1, 0.3)]
