"""Chat formatting by quotation linking.

Lines of a message that start with ``>`` are quotes; the number of markers
(``>>`` or ``> >``) is their level. Lines of one level that follow each
other are unwrapped and cut into passages (sentences); a passage is normalised
(letters and digits, lower case) and hashed. A message's own text, without
quotes and without the sentences that introduce them ("... wrote:" at the end of
the line before a quote, whatever their length), is cut the same way. Quoted passages are joined to the earliest message of the conversation
that holds the passage as its own text and comes before the quoting one.

A message replies to the original that its outermost found level quotes most
(in words; of equals the latest). Messages that quote nothing found start a
thread. Threads are found by pointer doubling, and a conversation is put in
reply order: threads by their first message, messages of a thread by turn, so a
reply comes after what it answers. The text of a message is its own text.

Scale: passages are grouped by (conversation, hash) before the join, which is
many-to-one, so a passage quoted everywhere makes no pairs. Places in a
conversation are counted with one global range sort and the sizes of its
partitions, never in a task per conversation.

Defined cases: a null or empty text has no passages and an empty body. Rows
that repeat a (conversation, turn) are ordered by role and text, reply to the
same message and are each kept. Null conversations are one conversation; a
message with a null turn comes first, quotes nothing and is never quoted.
An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import arrow_udf, col, prepare, salted_lookup, saved, table

MIN_WORDS = 3
MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
INTRODUCED = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*\Z", re.I)
# The end of a sentence: four letters, none a capital, tell it from initials, titles and ordinals.
ENDED = re.compile(r"(?<=[^\W\d_A-Z]{4})[.!?…]\s+")
WORD = re.compile(r"[^\W_]+")


def passages(*paragraphs: str) -> list[tuple[int, int]]:
    """(hash, words) of the passages of unwrapped paragraphs; short ones only
    if they are all there is."""
    parts = [w for w in (WORD.findall(s.lower()) for p in paragraphs for s in SENTENCE.split(p)) if w]
    long = [w for w in parts if len(w) >= MIN_WORDS]
    if not long and parts:
        long = [[w for p in parts for w in p]]
    return [(xxhash.xxh64_intdigest(" ".join(w), 7) - (1 << 63), len(w)) for w in long]


def before_introduction(line: str) -> str | None:
    """What stands before the introduction of a quotation that ``line`` ends
    with (its last sentence, of any length); None if it ends with none."""
    m = INTRODUCED.search(line)
    if not m:
        return None
    end = max((s.end() for s in ENDED.finditer(line, 0, m.start())), default=0)
    return line[:end].rstrip()


def parse(text: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(own text, own passages, quoted passages with their level)."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []  # level 0: own lines
    for line in text.split("\n"):
        m = MARK.fullmatch(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if level and runs and not runs[-1][0] and (left := before_introduction(runs[-1][1][-1])) is not None:
            own[-1:] = runs[-1][1][-1:] = [left] if left else []
        if not level:
            own.append(line)
        if not runs or runs[-1][0] != level or not rest.strip():
            runs.append((level, []))
        runs[-1][1].append(rest)
    # An attribution quoted one level up introduces a deeper quote.
    paragraphs: dict[int, list[str]] = {}
    for k, (level, lines) in enumerate(runs):
        if level and lines and k + 1 < len(runs) and runs[k + 1][0] > level and (left := before_introduction(lines[-1])) is not None:
            lines = [*lines[:-1], left]
        paragraphs.setdefault(level, []).append(" ".join(lines))
    said = passages(*paragraphs.pop(0, []))
    quoted = [(level, *p) for level, parts in paragraphs.items() for p in passages(*parts)]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    return body, said, quoted


PARSED = (
    T.StructType()
    .add("body", "string")
    .add("said", T.ArrayType(T.StructType().add("hash", "long").add("words", "long")))
    .add("quoted", T.ArrayType(T.StructType().add("level", "integer").add("hash", "long").add("words", "long")))
)


def parse_udf():
    said = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
    quoted = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int64())]))

    def run(texts: pa.Array) -> pa.Array:
        rows = [parse(x or "") for x in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([[{"hash": h, "words": n} for h, n in r[1]] for r in rows], said),
                pa.array([[{"level": v, "hash": h, "words": n} for v, h, n in r[2]] for r in rows], quoted),
            ],
            names=["body", "said", "quoted"],
        )

    return arrow_udf(run, PARSED)


def parents(parsed: DataFrame) -> DataFrame:
    """(conv, turn, parent): the message each quoting message replies to."""
    said = parsed.select("conv", "turn", F.explode("m.said").alias("p")).select("conv", "turn", "p.hash")
    quoted = parsed.select("conv", "turn", F.explode("m.quoted").alias("p")).select("conv", "turn", "p.*")
    quoted = quoted.groupBy("conv", "turn", "level", "hash").agg(F.max("words").alias("words"))
    first = said.groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    links = salted_lookup(quoted, first, ["conv", "hash"]).where("origin < turn")
    votes = links.groupBy("conv", "turn", "level", "origin").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "words", "origin")).alias("best"))
    return best.select("conv", "turn", F.col("best.origin").alias("parent"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of the replies by pointer doubling: each round
    doubles the steps a message looks back, so a chain of n takes log n rounds."""
    x = saved(replies.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = x.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        y = salted_lookup(x, up, ["conv", "root"])
        y = y.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        y = saved(y, "threads")
        x = y.drop("moved")
        if not y.where("moved").limit(1).count():
            return x


def places(x: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``x`` with ``place``, counted from 0 in each group of ``keys`` in the
    given order, by one range sort: a group may spread over many tasks."""
    s = saved(x.orderBy(*order).withColumn("_n", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_n", 33)
    sizes = s.groupBy(part.alias("_p")).agg(F.count("*").alias("rows"), F.min("_n").alias("low"))
    # A row per partition.
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "low", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    s = s.withColumn("_p", part).join(F.broadcast(starts), "_p")
    s = s.withColumn("_at", F.col("before") + F.col("_n") - F.col("low")).drop("_p", "low", "before", "_n")
    begin = s.groupBy(*keys).agg(F.min("_at").alias("_begin"))
    return salted_lookup(s, begin, keys).withColumn("place", F.col("_at") - F.col("_begin")).drop("_at", "_begin")


def link_quotes(chat: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, place in reply order, turn, role, body (its
    own text), parent, root and depth of its thread."""
    prepare(chat.sparkSession)
    # Keys of the joins are not null: a flag tells a missing conversation from 0.
    key = F.struct(col(conv).isNull().alias("none"), F.coalesce(col(conv).cast("long"), F.lit(0)).alias("id"))
    x = chat.select(key.alias("conv"), col(turn).cast("long").alias("turn"), col(role).cast("string").alias("role"), parse_udf()(col(text)).alias("m"))
    x = saved(x, "parsed")
    replies = saved(parents(x.where("turn is not null")), "replies")
    found = threads(replies)
    info = replies.join(found, ["conv", "turn"]).select("conv", "turn", "parent", "root", "depth")
    y = salted_lookup(x.select("conv", "turn", "role", F.col("m.body").alias("body"), F.size("m.quoted").alias("quoted")), info, ["conv", "turn"])
    y = y.withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    y = places(y, ["conv"], ["conv", F.col("root").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "body"])
    return y.select(F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv"), "place", "turn", "role", "body", "parent", "root", "depth", "quoted")


def chat_markup(linked: DataFrame) -> DataFrame:
    """Adds ``formatted``: the message in a plain chat mark-up."""
    return linked.withColumn("formatted", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n<|end|>")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = chat_markup(link_quotes(table(spark, sf_dir, "conversations")))
    return x.select(F.col("conv").alias("conv_id"), "place", "turn", "role", "parent", "root", "depth", "formatted")
