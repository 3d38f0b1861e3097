"""Nested reports, templates and captions made once, on small rows."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from rostrum.operators import captions as cp
from rostrum.operators import nested as n

FULL = {
    "version": "1.2",
    "overall_scores": {"content_coverage": 61.5, "content_coverage_user": 74.25, "pacing_score": 70.0},
    "highlight_sections": [{"slide_id": 2, "severity": 0.7, "issues": ["content_gap"], "feedback": [{"template_id": "content_gap_low", "text": "say dwell", "severity": "low"}]}],
    "per_slide_detail": [{"slide_id": k, "slide_role": "content", "coverage": k / 20, "anomalies": ["dwell", "pitch"], "ae_probe": {"x": 0.5}, "change_points": [1.0, 2.5]} for k in range(1, 15)],
    "global_summary": {"total_slides": 14, "summary_text": "the dwell", "delivery_stability_components": {"silence": 80.0}},
    "alignment": {"mode": "auto", "warnings": ["low"], "confidence": 0.04},
    "transcript_segments": [{"slide_id": 1, "start_sec": 0.0, "end_sec": 2.0, "text": "dwell " * 300, "warning_flags": []}],
    "reliability": {"alignment_level": "low", "content_coverage_shown": False},
    "context": {"venue": {"floors": [1, 2]}, "dwell": "kept"},
    "tags": ["x"],
}


def rows(spark, *reports):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(reports)], "id int, value string")


def holds(a, b):
    """Everything that a has is in b."""
    if isinstance(a, dict):
        return all(k in b and holds(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(holds, a, b))
    return a == b


def test_round_trip_keeps_all_fields(spark):
    old = {"version": "0.9", "overall_scores": {"content_coverage": 40.0}}
    r = n.read_json(rows(spark, FULL, old, "{cut off", "[1]", None, {"version": 3, "overall_scores": "?"}))
    assert [x.malformed for x in r.orderBy("id").collect()][2:4] == ["{cut off", "[1]"]
    texts = {x.id: x.t for x in r.where("malformed IS NULL").select("id", n.write_json(r).alias("t")).collect()}
    again = json.loads(texts[0])
    assert holds(FULL, again)
    assert json.loads(texts[1]) == old
    x = r.where("id = 1").first()
    assert x.per_slide_detail is None and x.reliability is None and x.overall_scores == {"content_coverage": 40.0}
    assert r.where("id = 5").first().overall_scores is None
    twice = n.read_json(r.where("id = 0").select("id", n.write_json(r).alias("value")))
    assert json.loads(twice.select(n.write_json(twice).alias("t")).first().t) == again


def test_schema_of_all(spark):
    s = n.schema_of(rows(spark, {"a": 1}, {"b": ["x"]}, "{bad"))
    assert s.startswith("OBJECT<") and "a: BIGINT" in s and "b: ARRAY<STRING>" in s


def test_rewrite_reaches_every_text(spark):
    r = n.rewrite(n.read_json(rows(spark, FULL)).drop("extra", "malformed"), lambda x: F.replace(x, F.lit("dwell"), F.lit("time"))).first().asDict(True)
    assert r["highlight_sections"][0]["feedback"][0]["text"] == "say time" and r["per_slide_detail"][3]["anomalies"] == ["time", "pitch"]
    assert not re.search("dwell(?!_)", json.dumps(r)) and r["per_slide_detail"][0]["ae_probe"] == {"x": 0.5}
    df = spark.createDataFrame([({"dwell": ["dwell", None]}, None, 3)], "m map<string,array<string>>, s struct<a:string>, i int")
    assert tuple(n.rewrite(df, F.upper).first()) == ({"dwell": ["DWELL", None]}, None, 3)


def test_compact(spark):
    r = n.read_json(rows(spark, FULL, {"version": "0.9", "overall_scores": {"content_coverage": 90.0}}))
    x = [y.c.asDict(True) for y in r.orderBy("id").select(n.compact(r).alias("c")).collect()]
    assert x[0]["overall_scores"]["content_connection_score"] == 74.25 and x[0]["overall_scores"]["content_connection_label"] == "good"
    assert [s["slide_id"] for s in x[0]["per_slide_detail"]] == list(range(1, 13)) and "coverage" not in x[0]["per_slide_detail"][0]
    assert len(x[0]["transcript_segments"][0]["text"]) <= 900 and x[0]["transcript_segments"][0]["text"].endswith("…")
    assert x[0]["global_summary"]["avg_content_connection_label"] == "good" and x[0]["alignment"] == {"mode": "auto", "strategy_used": None, "warnings": ["low"]}
    assert x[1]["per_slide_detail"] == [] and x[1]["overall_scores"]["content_connection_score"] > 0


def test_render_is_format(spark):
    r = random.Random(3)
    for _ in range(30):
        words = [r.choice(["a", "it's", 'say "x"', "both ' and \"", "back\\slash", ""]) for _ in range(r.randrange(4))]
        template = "".join(r.choice(["{a}", "{list}", "{{", "}}", " text ", "{b} "]) for _ in range(8))
        payload = {"a": "{b}", "b": "ü", "list": words}
        got = spark.createDataFrame([(template, words)], "t string, w array<string>").select(n.render(F.col("t"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("ü"), F.lit("list"), n.listed(F.col("w")))).alias("x")).first().x
        assert got == template.format(**payload)
    assert spark.range(1).select(n.render(F.lit("{gone} {slide_id}"), F.create_map(F.lit("slide_id"), F.lit("4"))).alias("x")).first().x == "{gone} 4"


def test_unknown_is_an_anti_join_behind_a_filter(spark):
    r = random.Random(1)
    keys = [f"k{r.randrange(4000)}" for _ in range(3000)]
    have = [f"k{r.randrange(4000)}" for _ in range(900)]
    df, known = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int"), spark.createDataFrame([(k,) for k in have], "key string")
    for words in (1, 16, cp.WORDS):  # full, crowded and roomy filters
        got = cp.unknown(df, known, words=words)
        assert sorted(tuple(x) for x in got.collect()) == sorted((k, i) for i, k in enumerate(keys) if k not in set(have))
    assert cp.unknown(df, known.limit(0)).count() == len(keys)
    assert cp.bloom(known, words=64).count() <= 64
    plan = cp.unknown(df, known)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "LeftAnti" in plan


def test_captions_are_made_once(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"page {i % 6}" if i else None) for i in range(20)], "page int, html string").withColumn("key", cp.cache_key(F.col("html"), 110, "m", "v1"))
    pages = pages.withColumn("key", F.when(F.col("html").isNotNull(), F.col("key")))
    worked = []

    def work(new):
        worked.append(new.count())
        return new.withColumn("caption", F.when(F.col("html") != "page 3", F.upper("html")))

    def keep(made):
        made.write.mode("append").parquet(str(tmp_path / "cache"))
        return spark.read.parquet(str(tmp_path / "cache"))

    none = spark.createDataFrame([], "key string, caption string")
    every, _ = cp.caption(pages, none, work, keep)
    got = {x.page: x.caption for x in every.collect()}
    assert worked == [6] and got[1] == got[7] == "PAGE 1" and got[3] is None and got[0] is None and len(got) == 20
    cache = spark.read.parquet(str(tmp_path / "cache"))
    cp.caption(pages, cache, work, lambda made: made)
    assert worked == [6, 1]  # only the one whose caption came out null
    other = pages.withColumn("key", cp.cache_key(F.col("html"), 110, "m", "v2"))
    assert cp.unknown(other, cache).count() == 20
