"""Queries on text vectors and the delivery probe, with the same results in SQL where it can say them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions.score import edge
from rostrum.operators import evaluate as ev
from rostrum.operators import prepare as p
from rostrum.operators import probe
from rostrum.operators.vectors import dot
from rostrum.sources import adapters as a

#: Letters of any script, in both engines.
WORD = r"\p{L}{2,}"


def text_similarity(spark, sf):
    """How much a turn shares with the next one."""
    v = probe.encode(a.table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], pattern=WORD)
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = v.withColumn("next", F.lead("v").over(w)).where("next IS NOT NULL")
    return x.select("conv_id", "turn", edge(dot("v", "next"), 5).alias("similarity"))


def _embedded(spark, sf):
    return a.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def probe_scores(spark, sf):
    """A probe of four hidden places whose weights follow a rule."""
    x = _embedded(spark, sf)
    dim = len(x.select("v").first()["v"])
    h, i, o = np.arange(4)[:, None], np.arange(dim), np.arange(5)[:, None]
    model = probe.Probe(((o * 5 + np.arange(4) * 2) % 7 - 3) / 2, np.arange(5) / 10, ((h * 7 + i * 3) % 11 - 5) / 5, np.arange(4) / 20)
    s = probe.score(x, model)
    return s.select("vec_id", *[edge(F.col(c), 5).alias(c) for c in ("speech_rate", "silence_ratio", "overall_delivery", "energy_drop_prob", "pitch_shift_prob")], "energy_drop", "pitch_shift")


def probe_fit(spark, sf):
    """Heads fitted on four of five vectors, evaluated on the others against a probe of zeros; a row if it is no worse."""
    y = lambda k: F.element_at("v", k)
    rows = _embedded(spark, sf).withColumns({"speech_rate": 2 + y(1) - y(2), "silence_ratio": 0.2 + F.col("label") % 5 / 20, "energy_drop": (y(3) > 0).cast("int"), "pitch_shift": (F.col("label") % 2).cast("int")})
    rows = p.targets(rows)
    m = probe.evaluate(rows.where("vec_id % 5 = 4"), probe.fit(rows.where("vec_id % 5 < 4")))
    return ev.quality_gate(m, 0.0).select("n", edge(F.col("loss"), 4).alias("loss"), edge(F.col("baseline"), 4).alias("baseline"), edge(F.col("improvement_pct"), 2).alias("improvement_pct"), "status")


QUERIES = {f.__name__: f for f in (text_similarity, probe_scores, probe_fit)}

ORACLE = {
    "text_similarity": """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\\pL{2,}')) AS w FROM conversations),
c AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS i, count(*)::DOUBLE AS n FROM t GROUP BY ALL), m AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL),
s AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
d AS (SELECT s.conv_id, s.turn, sum(x.n * y.n) AS d FROM s JOIN c x ON x.conv_id = s.conv_id AND x.turn = s.turn JOIN c y ON y.conv_id = s.conv_id AND y.turn = s.nx AND y.i = x.i GROUP BY ALL)
SELECT s.conv_id, s.turn, round_even(coalesce(d / (a.norm * b.norm), 0), 5) AS similarity FROM s LEFT JOIN d USING (conv_id, turn) LEFT JOIN m a ON a.conv_id = s.conv_id AND a.turn = s.turn LEFT JOIN m b ON b.conv_id = s.conv_id AND b.turn = s.nx WHERE nx IS NOT NULL""",
    "probe_scores": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
hid AS (SELECT vec_id, k, greatest(0, sum(x * ((k * 7 + i * 3) % 11 - 5) / 5) + max(k) / 20) AS y FROM e, range(0, 4) r(k) GROUP BY vec_id, k),
o AS (SELECT vec_id, o, sum(y * ((o * 5 + k * 2) % 7 - 3) / 2) + max(o) / 10 AS z FROM hid, range(0, 5) r(o) GROUP BY vec_id, o),
p AS (SELECT vec_id, max(z) FILTER (o = 0) AS a, max(z) FILTER (o = 1) AS b, 1 / (1 + exp(-max(z) FILTER (o = 2))) AS c, 1 / (1 + exp(-max(z) FILTER (o = 3))) AS d, max(z) FILTER (o = 4) AS f FROM o GROUP BY 1)
SELECT vec_id, round_even(a, 5) AS speech_rate, round_even(greatest(0, least(1, b)), 5) AS silence_ratio, round_even(greatest(0, least(1, f)), 5) AS overall_delivery, round_even(c, 5) AS energy_drop_prob, round_even(d, 5) AS pitch_shift_prob, (c >= .5)::INT AS energy_drop, (d >= .5)::INT AS pitch_shift FROM p""",
}
