"""The timing run end to end: hits -> pulses -> selection -> delay model -> match -> width.

Every stage is a DataFrame over the one before; what a stage fits is one row per side, met by
key. ``run_events`` applies it to the driver's ``events`` as hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histogram, matching, robust
from ..operators.scratch import stored
from .registry import register
from .tables import hits, rounded

DAY = 86_400_000_000


@dataclass(frozen=True)
class RunSettings:
    window: int = DAY
    shortest: int = 3_600_000_000
    longest: int = 5 * DAY
    zlimit: float = 4.0
    bin_width: float = 3_600_000_000.0


def match_run(edges: DataFrame, s: RunSettings) -> dict[str, DataFrame]:
    """``edges``: board, channel (lead, trail, timing), toa, hit_id. Returns every stage's relation; candidates are counted, a row an event."""
    kind = F.when(F.col("channel") == "lead", 0).when(F.col("channel") == "trail", 1)
    # stored: each is read several times, and each time would be the whole way from the hits
    pulses = stored(matching.longest_valid_pulses(edges, ["board"], kind, "toa", s.shortest, s.longest))
    energy = pulses.select("board", F.col("lead").alias("energy"), (F.col("trail") - F.col("lead")).alias("duration"))
    selected = stored(robust.mad_filter(energy, "duration", [], s.zlimit))
    timing = edges.where("channel = 'timing'").select("board", F.col("toa").alias("timing"))
    beside = (selected, timing, ["board"], "energy", "timing", s.window)
    candidates = stored(matching.window_counts(*beside))
    alone = candidates.where("pairs = 1").select("board", "energy", (F.col("energy") - F.col("latest")).alias("delay"))
    model = stored(robust.clipped_mean(alone, "delay", [], s.zlimit, rounds=3))
    mean = F.lit(model.agg(F.max("mean")).first()[0]).cast("double")
    matched = stored(matching.nearest_in_window(*beside, mean).withColumn("residual", F.col("energy") - F.col("timing") - mean))
    kept = stored(robust.mad_filter(matched, "residual", [], s.zlimit))
    width = histogram.fwhm(kept, "residual", [], s.bin_width)
    return {"pulses": pulses, "selected": selected, "candidates": candidates, "training": alone, "model": model, "matched": matched, "kept": kept, "width": width}


def run_events(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = hits(spark, sf_dir).withColumn("channel", F.when(F.col("channel") == "view", "lead").when(F.col("channel") == "purchase", "trail").when(F.col("channel") == "click", "timing"))
    return match_run(e.where("channel is not null"), RunSettings())


@register("pipe_tdc_run")
def pipe_tdc_run(spark, sf_dir):
    """How many events every stage keeps, and the width at the end."""
    stages = run_events(spark, sf_dir)
    many = {"candidates": F.coalesce(F.sum("pairs"), F.lit(0))}
    counts = [stages[k].agg(many.get(k, F.count("*"))).scalar().alias(k) for k in ("pulses", "selected", "candidates", "training", "matched", "kept")]
    width = stages["width"]
    return rounded(spark.range(1).select(*counts, width.select("fwhm").scalar().alias("fwhm"), width.select("success").scalar().alias("success")))
