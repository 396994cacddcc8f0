"""Media planning on rows, not pixels.

Decoding, re-encoding and trimming are codec work and are not built; these
operators compute the plans: which clip interval to keep, which frames to
sample, how many payload bytes a request carries and how far frames must be
shrunk to fit a cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.config import MAX_FRAMES, PAYLOAD_CAP_BYTES, REQUEST_STRIDE

# --- trimming (M1-M4) --------------------------------------------------------


def trim_plan(trims: DataFrame, duration_col: str = "duration", folder: str = "raw_video", out_folder: str = "downloads") -> DataFrame:
    """Clip interval per trim instruction.

    M1 rows without a time are dropped; M2 the sign of ``time`` picks the
    kind: > 0 an ad at the end (keep ``[0, duration - t]``), < 0 an ad at the
    beginning (keep ``[-t, duration]``), 0 copy as is; M3 an empty or
    reversed interval is flagged ``valid = false``; M4 input/output paths.
    One projection, no split into three scans.
    """
    t = F.col("time")
    dur = F.col(duration_col).cast("double")
    kind = F.when(t > 0, F.lit("end")).when(t < 0, F.lit("begin")).otherwise(F.lit("none"))
    start = F.when(t < 0, -t).otherwise(F.lit(0.0))
    end = F.when(t > 0, dur - t).otherwise(dur)
    name = F.concat(F.col("title"), F.lit(".mp4"))
    return (
        trims.dropna(subset=["time"])
        .withColumn("trim_kind", kind)
        .withColumn("start_s", start.cast("double"))
        .withColumn("end_s", end.cast("double"))
        .withColumn("valid", F.col("end_s") > F.col("start_s"))
        .withColumn("input_path", F.concat_ws("/", F.lit(folder), name))
        .withColumn("output_path", F.concat_ws("/", F.lit(out_folder), name))
    )


def media_status(plan: DataFrame, inventory: DataFrame, plan_key: str = "title", inv_key: str = "title") -> DataFrame:
    """M5: mark each planned item found / missing in the inventory.

    Semi and anti join in one pass: a left join against the distinct
    inventory keys (the planner broadcasts them only under its size limit).
    """
    inv = inventory.select(F.col(inv_key).alias("_ms_key")).distinct().withColumn("found", F.lit(True))
    j = plan.join(inv, plan[plan_key] == inv["_ms_key"], "left").drop("_ms_key")
    return j.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def present(plan: DataFrame, inventory: DataFrame, key: str = "title") -> DataFrame:
    """M5 work list: planned items that exist (left semi join)."""
    return plan.join(inventory.select(key), key, "left_semi")


def missing(plan: DataFrame, inventory: DataFrame, key: str = "title") -> DataFrame:
    """M5 report: planned items that do not exist (left anti join)."""
    return plan.join(inventory.select(key), key, "left_anti")


# --- frame sampling (M6, M9, M10) -------------------------------------------


def sample_interval(n_frames: Column, max_frames: int = MAX_FRAMES) -> Column:
    """``max(n // max_frames, 1)``: floor division makes the sample favour the front."""
    return F.greatest(F.floor(n_frames / F.lit(max_frames)).cast("long"), F.lit(1).cast("long"))


def uniform_sample_indices(n_frames: Column, max_frames: int = MAX_FRAMES) -> Column:
    """M6 without a frames table: the sampled frame indices as an array.

    Generates at most ``max_frames`` elements per video, never the whole
    frame range.
    """
    iv = sample_interval(n_frames, max_frames)
    last = F.least(n_frames - 1, iv * (max_frames - 1))
    return F.when(n_frames > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), iv)).otherwise(
        F.array().cast("array<long>")
    )


def uniform_sample(videos: DataFrame, n_col: str = "n_frames", max_frames: int = MAX_FRAMES, stride: int = REQUEST_STRIDE) -> DataFrame:
    """M6 + M10: one row per sampled frame with its rank and request flag.

    ``in_request`` marks every ``stride``-th sampled frame (M10); after a
    20-frame sample a stride of 50 keeps only the first frame.
    """
    n = F.col(n_col)
    out = videos.withColumn("interval", sample_interval(n, max_frames)).select(
        "*", F.posexplode(uniform_sample_indices(n, max_frames)).alias("sample_rank", "frame_idx")
    )
    return out.withColumn("in_request", F.col("sample_rank") % F.lit(stride) == 0)


def sample_frames(frames: DataFrame, counts: DataFrame | None = None, video_col: str = "video", idx_col: str = "frame_idx",
                  max_frames: int = MAX_FRAMES) -> DataFrame:
    """M6 on a frames table: keep ``frame_idx % interval = 0`` and the first 20.

    The per-video frame count comes from ``counts`` (video, n_frames) or a
    grouped count (partial aggregation, so a hot video is no problem). The
    sample is a pure filter, so every video keeps at most ``max_frames``
    rows before any window runs over it.
    """
    if counts is None:
        counts = frames.groupBy(video_col).agg(F.count(F.lit(1)).alias("n_frames"))
    counts = counts.withColumn("interval", sample_interval(F.col("n_frames"), max_frames))
    j = frames.join(counts, video_col)
    iv = F.col("interval")
    return j.where((F.col(idx_col) % iv == 0) & (F.col(idx_col) < iv * max_frames)).withColumn(
        "sample_rank", (F.col(idx_col) / iv).cast("long")
    )


def keep_all_frames(frames: DataFrame, idx_col: str = "frame_idx") -> DataFrame:
    """M9: every frame is encoded (identity with a rank)."""
    return frames.withColumn("sample_rank", F.col(idx_col).cast("long"))


def request_stride(sampled: DataFrame, stride: int = REQUEST_STRIDE, rank_col: str = "sample_rank") -> DataFrame:
    """Keep every ``stride``-th encoded frame."""
    return sampled.where(F.col(rank_col) % stride == 0)


# --- payload (M7, M8, M11, A13) ---------------------------------------------


def base64_size(n_bytes: Column) -> Column:
    """base64 text length of ``n_bytes`` raw bytes, without encoding."""
    return (F.lit(4) * F.ceil(n_bytes / F.lit(3))).cast("long")


def base64_text(payload: Column) -> Column:
    """base64 text of binary data, without MIME line breaks."""
    return F.translate(F.base64(payload), "\r\n", "")


def payload_cap(sampled: DataFrame, cap: int = PAYLOAD_CAP_BYTES, video_col: str = "video", rank_col: str = "sample_rank",
                bytes_col: str = "payload_bytes", max_frames: int = MAX_FRAMES) -> DataFrame:
    """M7 + A13: running payload per video; stop after the frame that crosses the cap.

    Run after sampling, so the window sorts at most ``max_frames`` rows per
    video. ``kept`` is true while the total *before* the frame is within the
    cap (the crossing frame is kept) and the frame is among the first 20.
    """
    w = Window.partitionBy(video_col).orderBy(rank_col)
    before = F.sum(bytes_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = sampled.withColumn("bytes_before", F.coalesce(before, F.lit(0)).cast("long"))
    out = out.withColumn("running_bytes", F.col("bytes_before") + F.col(bytes_col))
    return out.withColumn("kept", (F.col("bytes_before") <= F.lit(cap)) & (F.col(rank_col) < F.lit(max_frames)))


def resize_plan(capped: DataFrame, cap: int = PAYLOAD_CAP_BYTES, video_col: str = "video", bytes_col: str = "payload_bytes",
                width_col: str = "width", height_col: str = "height") -> DataFrame:
    """M8: per video, the shrink factor and new frame size when over the cap.

    ``total`` counts the kept frames only (up to the crossing one). When it
    exceeds the cap: ``factor = sqrt(cap / total)``, new sizes are truncated
    ``dim * factor``.
    """
    kept = capped.where(F.col("kept"))
    agg = kept.groupBy(video_col).agg(
        F.count(F.lit(1)).alias("frames_kept"),
        F.sum(bytes_col).cast("long").alias("total_bytes"),
        F.max(width_col).alias("width"),
        F.max(height_col).alias("height"),
    )
    over = F.col("total_bytes") > F.lit(cap)
    factor = F.when(over, F.sqrt(F.lit(float(cap)) / F.col("total_bytes").cast("double"))).otherwise(F.lit(1.0))
    return (
        agg.withColumn("needs_resize", over)
        .withColumn("factor", factor)
        .withColumn("new_width", F.floor(F.col("width") * F.col("factor")).cast("int"))
        .withColumn("new_height", F.floor(F.col("height") * F.col("factor")).cast("int"))
    )
