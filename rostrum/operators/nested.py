"""Nested reports: JSON of any shape read and written by schema, texts rewritten at any depth, templates with slots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from rostrum.functions.score import score_map
from rostrum.functions.text import cut

# A report's fields.
SLIDE = "slide_id int, slide_role string, coverage_weight double, coverage double, missed array<string>, speech_rate double, silence_ratio double, filler_count int, word_count int, words_per_sec double, dwell_sec double, dwell_ratio double, delivery_stability double, trend string, change_points array<double>, anomalies array<string>, ae_probe map<string,double>"
REPORT = (
    "version string, overall_scores map<string,double>, highlight_sections array<struct<slide_id:int,severity:double,issues:array<string>,feedback:array<struct<template_id:string,text:string,severity:string>>>>, "
    f"per_slide_detail array<struct<{SLIDE.replace(' ', ':').replace(',:', ', ')}>>, "
    "global_summary struct<total_slides:int,content_scored_slide_count:int,mean_speech_rate:double,mean_silence_ratio:double,total_change_points:int,delivery_stability_components:map<string,double>,summary_text:string>, "
    "alignment struct<mode:string,strategy_used:string,warnings:array<string>,confidence:double>, transcript_segments array<struct<slide_id:int,start_sec:double,end_sec:double,text:string,warning_flags:array<string>>>, "
    "reliability struct<alignment_level:string,content_coverage_shown:boolean,warnings:array<string>,note:string>"
)
# From which score on content is said to be connected in which way.
CONNECTED = ((85.0, "strong"), (70.0, "good"), (50.0, "partial"))


def rewritten(x: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    """The value with every string in it changed, at any depth of structs, arrays and map values; keys stay. One expression, made by walking the type."""
    if isinstance(kind, StringType):
        return change(x)
    if isinstance(kind, ArrayType) and _has_text(kind.elementType):
        return F.transform(x, lambda e: rewritten(e, kind.elementType, change))
    if isinstance(kind, MapType) and _has_text(kind.valueType):
        return F.transform_values(x, lambda _, v: rewritten(v, kind.valueType, change))
    if isinstance(kind, StructType) and _has_text(kind):
        fields = F.struct(*[rewritten(x.getField(f.name), f.dataType, change).alias(f.name) for f in kind])
        return F.when(x.isNotNull(), fields)
    return x


def _has_text(kind: DataType) -> bool:
    inner = {ArrayType: lambda: [kind.elementType], MapType: lambda: [kind.valueType], StructType: lambda: [f.dataType for f in kind]}.get(type(kind), list)
    return isinstance(kind, StringType) or any(map(_has_text, inner()))


def rewrite(df: DataFrame, change: Callable[[Column], Column], columns: list[str] | None = None) -> DataFrame:
    """df with every string inside these columns (all of them) changed."""
    return df.withColumns({f.name: rewritten(F.col(f"`{f.name}`"), f.dataType, change) for f in df.schema if columns is None or f.name in columns})


def listed(x: Column) -> Column:
    """An array of strings as a list is written: ['a', "it's"]."""
    quote = lambda e: F.when(e.contains("'") & ~e.contains('"'), F.concat(F.lit('"'), e, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(e, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: F.coalesce(quote(e), F.lit("None"))), ", "), F.lit("]"))


def render(template: Column, payload: Column) -> Column:
    """The template with each {slot} replaced by the payload's (map of strings) value; a slot without one stays as it is. {{ and }} are braces.

    Slots are cut out once and put in side by side, so a value that looks like a slot is not filled again.
    """
    parts = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"), 1)
    name = lambda p: F.regexp_extract(p, r"^\{([^{}]*)\}$", 1)
    fill = lambda p: F.when(p == "{{", "{").when(p == "}}", "}").when(p.rlike(r"^\{[^{}]*\}$"), F.coalesce(F.try_element_at(payload, name(p)), p)).otherwise(p)
    return F.array_join(F.transform(parts, fill), "")


def read_json(df: DataFrame, column: str = "value", schema: str = REPORT) -> DataFrame:
    """Reports from JSON texts: other columns, a column a field of the schema, `extra` (a map of variants) with the fields it doesn't know, `malformed` with texts that are no JSON object.

    A field that is missing, as in reports of an older version, or of another type is null.
    """
    kinds = StructType.fromDDL(schema)
    v = df.withColumn("_v", F.try_parse_json(column)).withColumn("_m", F.try_variant_get("_v", "$", "map<string,variant>"))
    fields = [F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in kinds]
    extra = F.map_filter("_m", lambda k, _: ~k.isin(*kinds.names))
    return v.select(*[c for c in df.columns if c != column], *fields, extra.alias("extra"), F.when(F.col("_m").isNull(), F.col(column)).alias("malformed"))


def write_json(df: DataFrame, schema: str = REPORT) -> Column:
    """JSON text of a report in columns, its extra fields among the others; null fields are left out."""
    known = F.expr(f"variant_get(to_variant_object(struct({', '.join(f'`{n}`' for n in StructType.fromDDL(schema).names)})), '$', 'map<string,variant>')")
    every = F.map_concat(F.map_filter(known, lambda _, v: ~F.is_variant_null(v)), F.coalesce("extra", F.expr("cast(map() AS map<string,variant>)")))
    return F.to_json(every)


def schema_of(df: DataFrame, column: str = "value") -> str:
    """The schema that all JSON texts of a column fit, as DDL of a VARIANT's object."""
    return df.select(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]


def _connected(score: Column) -> Column:
    out = F.when(score >= CONNECTED[0][0], CONNECTED[0][1])
    for least, name in CONNECTED[1:]:
        out = out.when(score >= least, name)
    return F.when(score.isNotNull(), out.otherwise("check"))


def compact(df: DataFrame, most: int = 12, longest: int = 900) -> Column:
    """What a comment writer gets of a report in columns: one struct with scores and labels, and the first slides, sections and segments, their texts shortened."""
    score = lambda raw, user: F.coalesce(F.bround(F.try_element_at("overall_scores", F.lit(user)), 2), F.bround(score_map(F.try_element_at("overall_scores", F.lit(raw)) / 100.0), 2))
    content, content_all = score("content_coverage", "content_coverage_user"), score("content_coverage_all", "content_coverage_user_all")
    kept = lambda k: F.try_element_at("overall_scores", F.lit(k)).alias(k)
    scores = F.struct(content.alias("content_connection_score"), _connected(content).alias("content_connection_label"), content_all.alias("content_connection_score_all"), kept("content_scored_slide_count"), kept("delivery_stability"), kept("pacing_score"))
    gone = ("coverage", "missed", "change_points")
    names = [f.name for f in StructType.fromDDL(REPORT)["per_slide_detail"].dataType.elementType if f.name not in gone]
    percent = lambda c: F.when(c <= 1.0, c * 100.0).otherwise(c)
    slide = lambda x: F.struct(*[x.getField(n).alias(n) for n in names], _connected(score_map(percent(x["coverage"]) / 100.0)).alias("content_connection_label"))
    segment = lambda x: F.struct(x["slide_id"].alias("slide_id"), x["start_sec"].alias("start_sec"), x["end_sec"].alias("end_sec"), cut(x["text"], longest).alias("text"), x["warning_flags"].alias("warning_flags"))
    summary = F.struct(*[F.col(f"global_summary.{n}").alias(n) for n in StructType.fromDDL(REPORT)["global_summary"].dataType.names], content.alias("avg_content_connection_score"), _connected(content).alias("avg_content_connection_label"))
    way = F.struct(*[F.col(f"alignment.{n}").alias(n) for n in ("mode", "strategy_used", "warnings")])
    first = lambda c: F.slice(F.coalesce(c, F.array().cast(df.schema[c].dataType)), 1, most)
    return F.struct(scores.alias("overall_scores"), summary.alias("global_summary"), first("highlight_sections").alias("highlight_sections"), F.transform(first("per_slide_detail"), slide).alias("per_slide_detail"), F.transform(first("transcript_segments"), segment).alias("transcript_segments"), way.alias("alignment"), F.col("reliability").alias("reliability"))
