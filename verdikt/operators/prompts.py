"""Prompt and request building (P1-P7) as projections.

The wording below is this library's own; only the slots follow the
evaluation protocol: zero-shot asks for ``result``; few-shot, chain of
thought and in-context ask for ``video_description``, ``reasoning`` and
``anomaly``; the second chain pass asks for ``Rule_Reasoning`` and
``updated_anomaly``. The rules of the second pass and the category guide of the
in-context prompt come from the caller (a rules file, a guide table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a category guide: it is repeated in every prompt.
MAX_GUIDE_ROWS = 1000

ZERO_SHOT = (
    "Watch the {media} and decide whether it shows an anomaly a home owner should know about. "
    'Reply with JSON only: {{"result": 1}} for an anomaly, {{"result": 0}} otherwise.'
)
FEW_SHOT_HEAD = (
    "You review home camera {media} for unusual events. Three solved examples follow; answer the new one the same way, "
    'as JSON with the keys "video_description", "reasoning" and "anomaly" (0 or 1).'
)
FEW_SHOT_EXAMPLES = [
    'Example: a parcel is left at the door and the courier walks away. -> {"video_description": "delivery", '
    '"reasoning": "routine delivery", "anomaly": 0}',
    'Example: a person tries several car doors at night. -> {"video_description": "person testing car doors", '
    '"reasoning": "possible theft attempt", "anomaly": 1}',
    'Example: a dog sleeps on the sofa. -> {"video_description": "dog resting", "reasoning": "nothing unusual", '
    '"anomaly": 0}',
]
CHAIN_OF_THOUGHT = (
    "You review home camera {media}. First describe what happens, then reason step by step about whether it is "
    'unusual, then answer as JSON with the keys "video_description", "reasoning" and "anomaly" (0 or 1).'
)
IN_CONTEXT_HEAD = (
    "You review home camera {media}. Use the category guide below, then answer as JSON with the keys "
    '"video_description", "reasoning" and "anomaly" (0 or 1).'
)
TEMPLATE_ROWS = [
    ("zeroshot", "video", ZERO_SHOT.format(media="video")),
    ("zeroshot", "frames", ZERO_SHOT.format(media="frames")),
    ("fewshot", "video", FEW_SHOT_HEAD.format(media="video") + "\n" + "\n".join(FEW_SHOT_EXAMPLES)),
    ("fewshot", "frames", FEW_SHOT_HEAD.format(media="frames") + "\n" + "\n".join(FEW_SHOT_EXAMPLES)),
    ("cot", "video", CHAIN_OF_THOUGHT.format(media="video")),
    ("cot", "frames", CHAIN_OF_THOUGHT.format(media="frames")),
    ("chain", "video", CHAIN_OF_THOUGHT.format(media="video")),
    ("chain", "frames", CHAIN_OF_THOUGHT.format(media="frames")),
]


def taxonomy_text(taxonomy: DataFrame) -> str:
    """The category guide as one block, from rows (category, kind, rule).
    The guide goes whole into each prompt, so the table is a short one: it is
    collected, at most ``MAX_GUIDE_ROWS`` rows (checked)."""
    rows = taxonomy.select("category", "kind", "rule").orderBy("category", "kind", "rule").limit(MAX_GUIDE_ROWS + 1).collect()
    if len(rows) > MAX_GUIDE_ROWS:
        raise ValueError(f"a category guide of more than {MAX_GUIDE_ROWS} rows")
    lines = []
    for c in dict.fromkeys(r["category"] for r in rows):
        parts = [f"{k} - " + "; ".join(r["rule"] for r in rows if r["category"] == c and r["kind"] == k) for k in dict.fromkeys(r["kind"] for r in rows if r["category"] == c)]
        lines.append(f"{c}: " + "; ".join(parts))
    return "\n".join(lines)


def template_rows(guide: str = "") -> list[tuple[str, str, str]]:
    """(method, modality, template) of P1-P4; ``guide`` is the category guide."""
    return [*TEMPLATE_ROWS, *[("icl", media, IN_CONTEXT_HEAD.format(media=media) + "\n" + guide) for media in ("video", "frames")]]


def prompt_text(method: str, modality: str, guide: str = "") -> Column:
    """The prompt of one method and modality as a literal."""
    return F.lit({(m, mo): t for m, mo, t in template_rows(guide)}[method, modality])


def with_prompt(df: DataFrame, method_col: str = "method", modality_col: str = "modality", guide: str = "") -> DataFrame:
    """Attach the prompt text for each row's (method, modality). The
    ten templates are literals of the expression, so no join is planned."""
    prompt = F.lit(None).cast("string")
    for m, mo, t in template_rows(guide):
        prompt = F.when((F.col(method_col) == m) & (F.col(modality_col) == mo), F.lit(t)).otherwise(prompt)
    return df.withColumn("prompt", prompt)


def rules_text(rules: Sequence[str]) -> Column:
    """P5: the rule block (rules joined by newlines) as a literal."""
    return F.lit("\n".join(rules))


# The second-pass template cut at its four slots (description, reasoning,
# anomaly, rules).
SECOND_PASS_PARTS = [
    'A first review of a home camera clip gave this result:\n{"video_description": "',
    '", "reasoning": "',
    '", "anomaly": ',
    "}\nCheck it against the rules below. If a rule applies, name it and update the verdict; otherwise keep it.\nRules:\n",
    '\nAnswer as JSON with the keys "Rule_Reasoning" and "updated_anomaly" (0 or 1).',
]

def second_pass_prompt(description: Column, reasoning: Column, anomaly: Column, rules: Column) -> Column:
    """The second-pass prompt. Values are inserted as they are (no
    escaping), a NULL value as ``null``."""
    a, b, c, d, e = SECOND_PASS_PARTS
    x, y, z = (F.coalesce(v, F.lit("null")) for v in (description, reasoning, anomaly))
    return F.concat(F.lit(a), x, F.lit(b), y, F.lit(c), z, F.lit(d), rules, F.lit(e))


def frame_parts(frames: DataFrame, group_cols: Sequence[str], rank_col: str = "sample_rank", payload_col: str = "payload") -> DataFrame:
    """P7 helper: the frames of each request as an ordered array.

    Call on sampled frames (at most 20 per video), so each group is bounded.
    """
    return frames.groupBy(*group_cols).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("idx"), F.col(payload_col).alias("data")))),
            lambda x: x.getField("data"),
        ).alias("frames"),
        F.count(F.lit(1)).alias("n_frames"),
    )


REQUEST_SHAPES = ("uri", "images", "blocks")


def request_json(model: Column, prompt: Column, media: Column, max_tokens: int = 4096, temperature: float = 0.0,
                 system: Column | None = None, shape: str = "images") -> Column:
    """One request document, in the shape a vendor family takes.

    ``uri``     the text and one file part; ``media`` is the video's address
    ``images``  the text part first, then one image part per frame
    ``blocks``  one block with base64 source per frame, then the text block

    ``media`` is the ordered array of encoded frames for the last two.
    ``system`` adds a system message before the user's.
    """
    if shape not in REQUEST_SHAPES:
        raise ValueError(f"shape={shape!r}")
    none = F.lit(None).cast("string")
    if shape == "uri":
        parts = F.array(
            F.struct(F.lit("text").alias("type"), prompt.alias("text"), none.alias("uri")),
            F.struct(F.lit("file").alias("type"), none.alias("text"), media.alias("uri")),
        )
    elif shape == "images":
        text = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text"), none.alias("data")))
        parts = F.concat(text, F.transform(media, lambda f: F.struct(F.lit("image").alias("type"), none.alias("text"), f.alias("data"))))
    else:
        source = lambda f: F.struct(F.lit("base64").alias("type"), F.lit("image/jpeg").alias("media_type"), f.alias("data"))
        text = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<type:string,media_type:string,data:string>").alias("source")))
        parts = F.concat(F.transform(media, lambda f: F.struct(F.lit("image").alias("type"), none.alias("text"), source(f).alias("source"))), text)
    user = F.to_json(F.struct(F.lit("user").alias("role"), parts.alias("content")), {"ignoreNullFields": "false"})
    messages = [user]
    if system is not None:
        messages.insert(0, F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content"))))
    head = F.to_json(F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")))
    # The messages differ in shape, so they are put together as JSON text.
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"messages":['), F.concat_ws(",", *messages), F.lit("]}"))
