"""Fixed values and the run matrix.

Everything here is data: the category list, the label mapping, the answer key
of each prompting method and the dialect that evaluates each (model, method)
run. Callers may pass their own tables; these are the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the reference's for matching results) --------
# Category slices, in report order. Membership is a substring test, so a video
# annotated "Security, Pet Monitoring" falls into both slices.
CATEGORIES = [
    "Baby Monitoring",
    "Wildlife",
    "Security",
    "Pet Monitoring",
    "Senior Care",
    "Kid Monitoring",
    "Other Category",
]
# Ground-truth label text -> binary truth. Anything else is unlabelled.
LABEL_MAP = {"Normal": 0, "Abnormal": 1, "Vague Abnormal": 1}
CLEAR_LABELS = ["Normal", "Abnormal"]
VAGUE_LABELS = ["Vague Abnormal"]
# Answer key per prompting method.
METHOD_KEYS = {
    "zeroshot": "result",
    "fewshot": "anomaly",
    "cot": "anomaly",
    "icl": "anomaly",
    "chain": "updated_anomaly",
}
# Media planning constants.
MAX_FRAMES = 20
PAYLOAD_CAP_BYTES = 27 * 1024 * 1024
REQUEST_STRIDE = 50
MEDIA_SUFFIXES = [".mp4", ".avi", ".mov"]
# Default values of a chain record when the first-pass answer cannot be read.
CHAIN_DEFAULT_TEXT = "NAN"
CHAIN_DEFAULT_ANOMALY = 0
# First key of an undecoded log line; the quotes may still be escaped. Part of
# the log format.
LINE_KEY_PATTERN = r'^\{\\?"([^"]+)"\\?\s*:'

# Dialects (see verdikt.functions.dialects):
#   greedy       block first '{' .. last '}', '//' comments removed, strict JSON
#   greedy_raw   same without comment removal
#   regex        first  "anomaly": "<digits>"  (quotes optional)
#   flat         newlines flattened, first '{' .. first '}', comments removed
#   repair       commas added after quotes before newlines, first block
#   rawline      regex on the still-escaped JSONL line
#   strict       whole text must be one JSON object
#   loose        like regex, no quote before the digits
# Policies: 'wrong' = an invalid answer is counted wrong; 'negative' = an
# invalid answer is read as label 0 (normal).
RUN_MATRIX = [
    # model,     method,     dialect,       coerce, policy
    ("Flash", "zeroshot", "greedy", False, "wrong"),
    ("Flash", "fewshot", "greedy", False, "wrong"),
    ("Flash", "cot", "regex", False, "wrong"),
    ("Flash", "icl", "rawline", False, "wrong"),
    ("Flash", "chain", "greedy", True, "wrong"),
    ("Pro", "zeroshot", "greedy", False, "wrong"),
    ("Pro", "fewshot", "greedy", False, "wrong"),
    ("Pro", "cot", "regex", False, "wrong"),
    ("Pro", "icl", "rawline", False, "wrong"),
    ("Pro", "chain", "rawline", True, "wrong"),
    ("GPT", "zeroshot", "greedy", False, "wrong"),
    ("GPT", "fewshot", "greedy", False, "wrong"),
    ("GPT", "cot", "greedy", False, "wrong"),
    ("GPT", "icl", "greedy", False, "wrong"),
    ("GPT", "chain", "flat", True, "negative"),
    ("GPTmini", "zeroshot", "greedy", False, "wrong"),
    ("GPTmini", "fewshot", "greedy", False, "wrong"),
    ("GPTmini", "cot", "greedy", False, "wrong"),
    ("GPTmini", "icl", "greedy", False, "wrong"),
    ("GPTmini", "chain", "repair", True, "wrong"),
    ("Claude", "zeroshot", "greedy_raw", False, "wrong"),
    ("Claude", "fewshot", "greedy", False, "wrong"),
    ("Claude", "cot", "greedy", True, "wrong"),
    ("Claude", "icl", "greedy", False, "wrong"),
    ("Claude", "chain", "rawline", True, "wrong"),
    ("VILA", "zeroshot", "strict", False, "wrong"),
    ("VILA", "fewshot", "loose", False, "wrong"),
    ("VILA", "cot", "loose", False, "wrong"),
    ("VILA", "icl", "loose", False, "wrong"),
]
# --- end of fixed values -----------------------------------------------------

# Slice names produced by the sliced-metrics operator, in order.
FIXED_SLICES = ["all", "clear", "vague"]
ALL_SLICES = FIXED_SLICES + CATEGORIES

# How a run's log lines are read (see verdikt.sources.logs.parse_lines).
SCANS = ("keyed", "raw", "idpred", "idpred_drop")


def default_scan(model: str, method: str, dialect: str) -> str:
    """Raw-line runs aren't decoded; the open model logs id/pred objects, and
    all its methods but zero-shot drop lines with an empty id or pred."""
    if dialect == "rawline":
        return "raw"
    if model == "VILA":
        return "idpred" if method == "zeroshot" else "idpred_drop"
    return "keyed"


RUN_MATRIX_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("dialect", T.StringType(), False),
        T.StructField("coerce", T.BooleanType(), False),
        T.StructField("policy", T.StringType(), False),
        T.StructField("answer_key", T.StringType(), False),
        T.StructField("scan", T.StringType(), False),
    ]
)


def run_matrix(spark: SparkSession, rows=None) -> DataFrame:
    """The (model, method) -> (dialect, coerce, policy, key, scan) table.

    29 rows by default: a fixed, proven-small dimension that is safe to
    broadcast.
    """
    rows = rows or RUN_MATRIX
    data = [(m, me, d, c, p, METHOD_KEYS[me], default_scan(m, me, d)) for (m, me, d, c, p) in rows]
    return spark.createDataFrame(data, RUN_MATRIX_SCHEMA)
