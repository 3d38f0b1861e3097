"""Slides from lines: titles, assembly, roles, keywords, tf-idf, keypoints, captions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rostrum.functions import text as t

# Importance of keypoints by source, in the order of preference.
IMPORTANCE = {"title": 1.0, "bullet": 0.8, "textrank": 0.6, "body": 0.4}
ROLES_OUT = ("cover", "section", "thanks")


def _slide() -> WindowSpec:
    return Window.partitionBy("deck", "slide")


def titles(lines: DataFrame, layout: bool = False, first: int = 8) -> DataFrame:
    """The best-scored of a slide's first lines, the earliest among equals.

    With layout, lines of 60 points or more by font and place come before all others.
    """
    x = F.trim("line")
    s = lines.where(F.col("line_idx") < first).where((x != "") & ~t.is_icon(x))
    score = t.title_score(x)
    rank = F.struct(F.lit(0).alias("a"), score.alias("b"), (-F.col("line_idx")).alias("c"), x.alias("title"))
    if layout:
        by_layout = t.layout_score(x, F.col("font_size"), F.col("y0"))
        rank = F.struct((by_layout >= 60).cast("int").alias("a"), F.when(by_layout >= 60, by_layout).otherwise(score).alias("b"), (-F.col("line_idx")).alias("c"), x.alias("title"))
    best = s.groupBy("deck", "slide").agg(F.max(rank).alias("r"))
    return best.select("deck", "slide", F.col("r.title").alias("title"), F.col("r.b").alias("score"))


def by_place(lines: DataFrame) -> DataFrame:
    """Lines numbered anew by their place on the page: from the top, then from the left (y0, x0), then as they come."""
    w = _slide().orderBy("y0", "x0", "line_idx")
    return lines.withColumn("line_idx", (F.row_number().over(w) - 1).cast(lines.schema["line_idx"].dataType))


def assemble(lines: DataFrame) -> DataFrame:
    """A slide's lines in order as one text, and its bullets in order."""
    clean = lines.withColumn("clean", t.content_line(F.col("line"))).withColumn("bullet", t.is_bullet(F.col("line")) & (F.col("clean") != ""))
    ordered = F.array_sort(F.collect_list(F.when(F.col("clean") != "", F.struct("line_idx", "clean", "bullet"))))
    s = clean.groupBy("deck", "slide").agg(ordered.alias("x"))
    return s.select("deck", "slide", F.array_join(F.transform("x", lambda r: r["clean"]), "\n").alias("text"), F.transform(F.filter("x", lambda r: r["bullet"]), lambda r: r["clean"]).alias("bullets"))


def roles(slides: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """cover, section, thanks or content: by caption where there is one, else by place and text.

    First: cover. Last with a word of thanks: thanks. No bullets, a title of at
    most 35 and lines of at most 45 characters: section.
    """
    deck = Window.partitionBy("deck")
    s = slides.withColumn("is_first", F.col("slide") == F.min("slide").over(deck)).withColumn("is_last", F.col("slide") == F.max("slide").over(deck))
    lines = F.split("text", "\n")
    short = (F.size("bullets") == 0) & (F.char_length("title") <= 35) & F.forall(lines, lambda x: F.char_length(x) <= 45)
    thanks = F.concat_ws(" ", "title", "text").rlike(t.THANKS)
    rule = F.when(F.col("is_first"), "cover").when(F.col("is_last") & thanks, "thanks").when(short, "section").otherwise("content")
    source = F.lit("heuristic")
    if captions is not None:
        s = s.join(captions.select("deck", "slide", "slide_type"), ["deck", "slide"], "left")
        named = F.when(F.col("slide_type") == "thanks", "thanks").when(F.col("slide_type") == "title", F.when(F.col("is_first"), "cover").otherwise("section")).when(F.col("slide_type") == "section_header", "section").otherwise("content")
        rule = F.when(F.col("slide_type").isNotNull(), named).otherwise(rule)
        source = F.when(F.col("slide_type").isNotNull(), "caption").otherwise(source)
    s = s.withColumn("role", rule)
    return s.select("deck", "slide", "role", source.alias("source"), F.when(F.col("role").isin(*ROLES_OUT), 0.0).otherwise(1.0).alias("coverage_weight"))


def keywords(lines: DataFrame, top: int = 10, pattern: str = t.NOUN) -> DataFrame:
    """A slide's most frequent nouns; among equals the one seen first. One exchange, of lines."""
    w = lines.repartition("deck", "slide").select("deck", "slide", "line_idx", F.posexplode(t.nouns(F.col("line"), pattern)).alias("pos", "term"))
    seen = F.min(F.col("line_idx").cast("long") * (1 << 32) + F.col("pos"))
    c = w.groupBy("deck", "slide", "term").agg(F.count("*").alias("n"), seen.alias("seen"))
    return c.withColumn("rank", F.row_number().over(_slide().orderBy(F.desc("n"), "seen"))).where(F.col("rank") <= top).select("deck", "slide", "rank", "term", "n")


def tfidf(lines: DataFrame) -> DataFrame:
    """Weights of a line's words among its slide's lines: ln((1+n)/(1+df))+1, at length 1.

    Lines are dealt by slide once; counts, document frequencies and norms follow without another exchange.
    """
    n_lines = F.count_if(F.trim("line") != "").over(_slide())
    x = lines.select("deck", "slide", "line_idx", "line").repartition("deck", "slide").withColumn("n_lines", n_lines)
    w = x.select("deck", "slide", "line_idx", "n_lines", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"(?U)\b(\w\w+)\b"), 1)).alias("term"))
    tf = w.groupBy("deck", "slide", "line_idx", "n_lines", "term").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy("deck", "slide", "term"))
    x = tf.withColumn("df", df).withColumn("w", F.col("tf") * (F.log((1 + F.col("n_lines")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("deck", "slide", "line_idx")))
    return x.select("deck", "slide", "line_idx", "term", "tf", (F.col("w") / norm).alias("weight"))


def textrank(weights: DataFrame, top: int = 3, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """A slide's leading lines: power iteration on line similarities, for a fixed number of rounds.

    The matrix of similarities is the product of lines x terms with itself, without its
    diagonal, so a round is a product with each of the two: it costs what the
    slide has of different words in lines, whatever they share, and no pair of lines is made.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lines, i = np.unique(table["line_idx"].to_numpy(), return_inverse=True)
        t = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        w = table["weight"].to_numpy()
        by_line = lambda x: np.bincount(i, x, len(lines))
        own = by_line(w * w)
        total = by_line(w * np.bincount(t, w)[t]) - own
        total = np.where(total > 1e-12, total, np.inf)  # a line that shares nothing passes nothing on
        score = np.ones(len(lines))
        for _ in range(rounds):
            z = score / total
            score = 1 - damping + damping * (by_line(w * np.bincount(t, w * z[i])[t]) - own * z)
        first = np.lexsort((lines, -np.round(score, 12)))[:top]
        n = len(first)
        return pa.table({"deck": pa.array([key[0].as_py()] * n, kind), "slide": pa.array([key[1].as_py()] * n, pa.int32()), "line_idx": pa.array(lines[first], pa.int32()), "score": pa.array(score[first], pa.float64()), "rank": pa.array(range(1, n + 1), pa.int32())})

    kind = to_arrow_type(weights.schema["deck"].dataType)
    w = weights.select("deck", F.col("slide").cast("int").alias("slide"), F.col("line_idx").cast("int").alias("line_idx"), "term", "weight")
    return w.groupBy("deck", "slide").applyInArrow(run, f"deck {weights.schema['deck'].dataType.simpleString()}, slide int, line_idx int, score double, rank int")


def keypoints(parts: DataFrame) -> DataFrame:
    """From (deck, slide, source, pos, text): each text once (any case), in its best source, first places first."""
    order = F.create_map(*[x for i, k in enumerate(IMPORTANCE) for x in (F.lit(k), F.lit(i))])
    weight = F.create_map(*[x for k, v in IMPORTANCE.items() for x in (F.lit(k), F.lit(v))])
    p = parts.where(F.trim("text") != "").withColumn("o", order[F.col("source")])
    first = Window.partitionBy("deck", "slide", F.lower(F.trim("text"))).orderBy("o", "pos")
    p = p.withColumn("r", F.row_number().over(first)).where("r = 1")
    return p.select("deck", "slide", (F.row_number().over(_slide().orderBy("o", "pos")) - 1).alias("kp_idx"), F.trim("text").alias("text"), "source", weight[F.col("source")].alias("importance"))


def dedupe_keep_max(parts: DataFrame) -> DataFrame:
    """Each text once at its greatest importance and its first place."""
    g = parts.groupBy("deck", "slide", "text").agg(F.max("importance").alias("importance"), F.min("pos").alias("pos"))
    return g.withColumn("kp_idx", F.row_number().over(_slide().orderBy("pos")) - 1)


def visual_captions(items: DataFrame, min_confidence: float = 0.3, longest: int = 80) -> DataFrame:
    """Text of visual items: sure OCR text (shortened), else a chart's type, else counts by type; each once."""
    sure = (F.coalesce("confidence", F.lit(0.0)) >= min_confidence) & (F.trim(F.coalesce("raw_text", F.lit(""))) != "")
    text = t.one_space(F.col("raw_text"))
    text = F.when(F.char_length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest)), F.lit("..."))).otherwise(text)
    named = items.where(sure | F.col("chart_type").isNotNull()).select("deck", "slide", "item", F.when(sure, text).otherwise(F.col("chart_type")).alias("caption"))
    rest = items.where(~sure & F.col("chart_type").isNull()).groupBy("deck", "slide", "type").agg(F.count("*").alias("n"), F.min("item").alias("item"))
    rest = rest.select("deck", "slide", (F.col("item") + 1_000_000).alias("item"), F.concat_ws(" x", "type", "n").alias("caption"))
    first = Window.partitionBy("deck", "slide", F.lower("caption")).orderBy("item")
    return named.unionByName(rest).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def validate_captions(c: DataFrame, types: tuple, default: str, longest: int = 120, most: int = 8) -> DataFrame:
    """Known types only, short claims, entities once in any case and at most so many, in order."""
    ents = F.filter(F.transform("entities", lambda x: F.substring(t.one_space(x), 1, longest)), lambda x: x != "")
    once = F.aggregate(ents, F.slice(ents, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))))
    kind = F.lower(F.trim("slide_type"))
    return c.select("deck", "slide", F.when(kind.isin(*types), kind).otherwise(default).alias("slide_type"), F.substring(t.one_space(F.col("main_claim")), 1, longest).alias("main_claim"), F.slice(once, 1, most).alias("entities"))


def deck_report(slides: DataFrame, sections: DataFrame) -> DataFrame:
    """Whether a deck's slides are numbered 1..n and its sections hold each exactly once."""
    s = slides.groupBy("deck").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("slide")).alias("found"))
    k = sections.groupBy("deck").agg(F.array_sort(F.flatten(F.collect_list("slides"))).alias("held"))
    want = F.sequence(F.lit(1), F.col("n").cast("int"))
    j = s.join(k, "deck", "left")
    return j.select("deck", "n", (F.col("found") == want).alias("numbered"), F.coalesce(F.col("held") == want, F.lit(False)).alias("sectioned"))


# Sources of key points made from captions, with their importance.
CAPTION_IMPORTANCE = {"vlm_slide_type": 0.25, "vlm_visual_kind": 0.2, "vlm_role": 0.75, "vlm_claim": 0.95, "vlm_visual": 0.75, "vlm_entity": 0.45, "vlm_keyword": 0.45, "vlm_core_term": 0.35}
#: Weight of a title beside other signals: of a short one, of others.
SHORT_TITLE, LONG_TITLE = 0.55, 0.35


def caption_keypoints(points: DataFrame, captions: DataFrame, terms: DataFrame) -> DataFrame:
    """Key points (deck, slide, source, text, importance) with those of captions and the deck's terms; each text once a source, in any case, at its greatest importance.

    captions: (deck, slide, slide_type, visual_kind, role_in_flow, main_claim, visual_summary, entities, keywords), one a slide; terms: (deck, terms).
    """
    one = lambda source, text: F.struct(F.lit(source).alias("source"), text.alias("text"), F.lit(CAPTION_IMPORTANCE[source]).alias("importance"))
    some = lambda source, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", one(source, F.col(c)))
    many = lambda source, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: one(source, x))
    singles = F.array(one("vlm_slide_type", F.col("slide_type")), one("vlm_visual_kind", F.col("visual_kind")), some("vlm_role", "role_in_flow"), some("vlm_claim", "main_claim"), some("vlm_visual", "visual_summary"))
    made = captions.select("deck", "slide", F.explode(F.concat(F.array_compact(singles), many("vlm_entity", "entities"), many("vlm_keyword", "keywords"))).alias("k"))
    deck_wide = points.select("deck", "slide").distinct().join(terms, "deck").select("deck", "slide", F.explode(many("vlm_core_term", "terms")).alias("k"))
    every = points.select("deck", "slide", "source", "text", "importance").unionByName(made.unionByName(deck_wide).select("deck", "slide", "k.*"))
    best = F.max_by(F.struct("text", "importance"), F.struct("importance", F.col("text").alias("t")))
    return every.groupBy("deck", "slide", "source", F.lower("text").alias("key")).agg(best.alias("b")).select("deck", "slide", "source", "b.text", "b.importance")


def slide_channels(points: DataFrame, pattern: str = t.NOUN) -> DataFrame:
    """What a slide is compared by: texts of its channels, its tokens, type and kind, whether a caption or a visual carries it, and its title's weight.

    points: (deck, slide, kp_idx, source, text, importance). Vectors of the channels are mean_vectors() of the same groups.
    """
    p = points.where(F.trim("text") != "")
    of = lambda *sources: F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isin(*sources), F.struct("kp_idx", "text")))), lambda x: x["text"])
    g = p.groupBy("deck", "slide").agg(of("title").alias("titles"), of("bullet", "textrank").alias("bodies"), of("body", "vlm_entity", "vlm_keyword", "vlm_core_term").alias("keywords"), of("visual").alias("visuals"), of("vlm_visual").alias("captions"), of("vlm_slide_type").alias("types"), of("vlm_visual_kind").alias("kinds"), F.count_if(F.col("source").isin("vlm_claim", "vlm_role", "vlm_visual", "vlm_slide_type", "vlm_visual_kind")).alias("n_vlm"))
    title = F.coalesce(F.try_element_at("titles", F.lit(1)), F.lit(""))
    body, visual, caption = (F.array_join(c, " ") for c in ("bodies", "visuals", "captions"))
    tokens = F.array_sort(F.array_distinct(F.concat(t.nouns(title, pattern), F.transform("keywords", F.lower), t.nouns(body, pattern), t.nouns(visual, pattern), t.nouns(caption, pattern))))
    kind = F.trim(F.try_element_at("kinds", F.lit(-1)))
    return g.select("deck", "slide", title.alias("title"), body.alias("body"), visual.alias("visual"), caption.alias("caption"), F.array_sort(F.array_distinct(t.nouns(title, pattern))).alias("title_tokens"), tokens.alias("tokens"), F.trim(F.try_element_at("types", F.lit(-1))).alias("slide_type"), kind.alias("visual_kind"), (F.col("n_vlm") > 0).alias("has_vlm"), F.coalesce((kind != "") & (kind != "none"), F.lit(False)).alias("visual_heavy"), F.when(t.short_title(title), SHORT_TITLE).otherwise(LONG_TITLE).alias("title_weight"))
