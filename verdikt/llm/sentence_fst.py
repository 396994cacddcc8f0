"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled to one automaton of characters, composed of three:

* the normaliser: white-space rules of the model and the space symbol;
* the pieces: a path per piece, from text to id. In a unigram model an arc
  weighs the piece's negative score. In a byte-pair model pieces weigh nothing
  but two pieces may only follow each other if merging their joined text by the
  model's priorities gives just these two, else the step weighs infinity; a
  sequence is what the merges of the whole text give if and only if all its
  neighbours pass, so exactly one path of finite weight is left;
* byte fallback: a character that no piece covers becomes its UTF-8 bytes (or
  the unknown id if the model has no byte pieces).

Composing a text with them is a lattice over its characters, and the encoding
is the shortest path in the tropical semiring (weights add along a path, the
least weight wins). In a unigram model it is found place by place. In a
byte-pair model any path of finite weight is the shortest, so the lattice is
searched depth first, longest arcs first; every prefix of a text has one
encoding, so a place that leads nowhere is visited once.

Where no piece can cross a place (before a space symbol that follows another
character, or beside a line break that is in no piece) the composition falls
apart into independent units; units are encoded once per worker and remembered
(at most ``REMEMBER`` of them).

Defined cases: a null or empty text has no ids and decodes to the empty text.
Models with a compiled character map are refused (none of the public ones here
has one). A text that itself holds the space symbol decodes to a space there.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from verdikt.llm.common import arrow_udf, col, prepare, table

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBER = 600_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            value |= (buf[i] & 127) << shift
            shift += 7
            i += 1
            if buf[i - 1] < 128:
                return value, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if n == 4 else "<d", buf[i : i + n])[0], i + n
        yield key >> 3, value


class Transducer:
    """The compiled model; ``encode`` composes a text with it."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        for number, value in fields(model):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                n = dict(fields(value))
                if n.get(2):
                    raise NotImplementedError("models with a compiled character map")
                self.prefix, self.squeeze, self.escape = (bool(n.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise NotImplementedError("only unigram and byte-pair models")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.lowest = min(self.score.values(), default=0.0)
        self.units = self._units()
        self.text = {i: p for p, i in self.ids.items()}
        self.size = [len(p) for p, _, _ in self.pieces]
        self.root = self._compile()
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.outputs = [self._output(p, kind) for p, _, kind in self.pieces]

    def _compile(self) -> dict:
        """The pieces as one automaton: a state is a dict of its arcs by
        character, and under the empty text the piece that ends there. The
        normaliser is composed in: a space takes the arc of the space symbol."""
        root: dict = {}
        for piece, i in self.ids.items():
            state = root
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = i
        if self.escape and SPACE in root:
            todo = [root]
            while todo:
                state = todo.pop()
                if SPACE in state:
                    state.setdefault(" ", state[SPACE])
                todo += [v for k, v in state.items() if k and k != " "]
        return root

    def _units(self) -> re.Pattern:
        """A pattern that cuts a text at places no piece crosses."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r".+", re.S)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        return re.compile((r"\n+|" if line else "") + rf"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+")

    def _output(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """What merging neighbours by priority makes of a short text."""
        parts, none = list(text), -math.inf
        ranks = [self.score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.score.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = self.score.get(parts[i] + parts[i + 1], none)
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Does the step from piece ``a`` to ``b`` weigh 0?"""
        if len(self.follows) >= 4 * REMEMBER:
            self.follows.clear()
        x, y = (self.text[i] if i >= 0 else chr(-1 - i) for i in (a, b))
        found = self.follows[a << 32 ^ b] = self.merged(x + y) == [x, y]
        return found

    def shortest(self, unit: str) -> list[int]:
        """The arcs of the shortest path through the lattice of a unit: pieces,
        or -1 - code point for a character outside them (the fallback)."""
        return self._search(unit) if self.kind == BPE else self._lightest(unit)

    def _arcs(self, unit: str, at: int) -> list[int]:
        """The composed arcs that leave a place, longest last."""
        state, out = self.root.get(unit[at]), []
        if state is None or "" not in state:
            out.append(-1 - ord(unit[at]))
        while state is not None:
            if "" in state:
                out.append(state[""])
            at += 1
            if at == len(unit):
                break
            state = state.get(unit[at])
        return out

    def _search(self, unit: str) -> list[int]:
        """The one path whose steps all weigh 0, depth first."""
        end, at, last = len(unit), 0, None
        size, follows = self.size, self.follows
        path: list[int] = []
        left: list[tuple[int, list[int]]] = []  # places passed, with the arcs not yet tried
        dead: set[int] = set()
        arcs = self._arcs(unit, 0)
        while True:
            while arcs:
                i = arcs.pop()
                to = at + (size[i] if i >= 0 else 1)
                if to in dead:
                    continue
                if last is not None:
                    passes = follows.get(last << 32 ^ i)
                    if not (self.may_follow(last, i) if passes is None else passes):
                        continue
                path.append(i)
                if to == end:
                    return path
                left.append((at, arcs))
                at, last, arcs = to, i, self._arcs(unit, to)
            dead.add(at)
            path.pop()
            at, arcs = left.pop()
            last = path[-1] if path else None

    def _lightest(self, unit: str) -> list[int]:
        """The path of least weight, place by place."""
        n = len(unit)
        weight = [0.0] + [math.inf] * n
        arc = [0] * (n + 1)
        fallback = 10.0 - self.lowest
        for start in range(n):
            for i in self._arcs(unit, start):
                to = start + (self.size[i] if i >= 0 else 1)
                w = weight[start] + (-self.pieces[i][1] if i >= 0 else fallback)
                if w < weight[to]:
                    weight[to], arc[to] = w, i
        path = []
        while n:
            path.append(arc[n])
            n -= self.size[arc[n]] if arc[n] >= 0 else 1
        return path[::-1]

    def unit_ids(self, unit: str) -> bytes:
        ids: list[int] = []
        for i in self.shortest(unit):
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        known, out = self.known, []
        for unit in self.units.findall(self.normalise(text)):
            ids = known.get(unit)
            if ids is None:
                ids = self.unit_ids(unit)
                if len(unit) <= 64:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The inverse transducer: ids to text, without the prefix space."""
        text = b"".join(map(self.outputs.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_COMPILED: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer a worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def model_bytes(spark: SparkSession, path: str):
    """The model file, read once on the driver and sent to the executors (a
    model is some hundred kilobytes, whatever the input)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_udf(spark: SparkSession, model: str = MODEL):
    """text -> array of ids."""
    sent = model_bytes(spark, model)

    def encode(texts: pa.Array) -> pa.Array:
        t = compiled(sent.value)
        ids = [t.encode(x or "") for x in texts.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return arrow_udf(encode, T.ArrayType(T.IntegerType()))


def decode_udf(spark: SparkSession, model: str = MODEL):
    """array of ids -> text."""
    sent = model_bytes(spark, model)

    def decode(ids: pa.Array) -> pa.Array:
        t = compiled(sent.value)
        return pa.array([t.decode(np.array(x.values if x.is_valid else [], "<i4").tobytes()) for x in ids], pa.string())

    return arrow_udf(decode, "string")


def op6(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Digest columns of the encoding, and whether decoding gives the text back.
    Ids and decoded texts stay in the task that makes them."""
    prepare(spark)
    sent = model_bytes(spark, model)
    kind = pa.struct([("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def digest(texts: pa.Array) -> pa.Array:
        t = compiled(sent.value)
        low = np.zeros(len(t.pieces), bool)
        low[list(t.byte_ids.values())] = True
        rows = []
        for x in texts.to_pylist():
            ids = t.encode(x or "")
            back = t.decode(ids)
            rows.append((len(ids) // 4, int(low[np.frombuffer(ids, "<i4")].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (x or "")))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))

    out = T.StructType().add("n_ids", "long").add("n_bytes", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("round_trip", "boolean")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", arrow_udf(digest, out)(col("text")).alias("d")).select("doc_id", "d.*")
