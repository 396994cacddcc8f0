"""Repair of conversation structure by a grammar-compressed dynamic program.

Every row is one symbol: the initial of its role, whether its text is cut off,
or that it must go (blank, or seen before). An edit of a row is Keep (0), Rerole
to user or assistant (1), Delete (2); an Insert adds an empty turn (5); a row cut
off that stays adds 5. What stays must read ``(s?(ua)+)?``, so four states do:
nothing yet, after a system row, after a user row, after an assistant row.

1. A symbol's transfer matrix holds, for each pair of states, the least cost and
   the ASCII-least audit (initials of the edits) that reaches it. The product of
   two matrices, with sums for products and least for sums, is that of their
   symbols in a row. Entries of equal cost and states never have an audit that
   begins the other, so least audits stay least when extended.
2. Audits are ropes: a product makes one node, which shares its parts; texts are
   compared by hashes of their parts, down to the first difference.
3. A batch of symbol sequences is compressed by Re-Pair: the most frequent pair
   becomes a rule until no pair occurs twice. Each rule's matrix is one product,
   made bottom-up and used in all conversations of the batch.
4. Rows are sorted by conversation and turn over all tasks, so a long
   conversation lies in many; pieces of at most ``PIECE`` rows become sequences.
   Equal sequences are solved once. Pieces of a conversation are multiplied.
5. The repaired text is hashed by a task that reads the conversation in order,
   a row at a time: SHA-256 has no other way. That is the one step in which a
   conversation isn't split, and it holds no more than its audit.

Defined cases: null roles and texts count as one space, a null conversation is
one of its own, null turns come first. An empty role has a space for initial.
Rows of one turn are ordered by role, then by a digest of the text. Equal rows
of one turn are duplicates of each other. Other columns play no part. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import arrow_udf, col, discard, partitions, prepare, salted_lookup, saved, table

PIECE = 4096
# Symbols compressed by one grammar.
GRAMMAR = 200_000
RULES_SPACE = "[ \\t\\n\\x0B\\f\\r]"

# --- ropes and transfer matrices -------------------------------------------------

_M, _B = (1 << 61) - 1, 1_000_003


class Rope:
    """A text as a shared binary tree, with its length and hash."""

    __slots__ = ("hash", "left", "power", "right", "size", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.size = left.size + right.size
            self.hash = (left.hash * right.power + right.hash) % _M
            self.power = left.power * right.power % _M
        else:
            self.size, self.hash, self.power = len(text), 0, pow(_B, len(text), _M)
            for c in text:
                self.hash = (self.hash * _B + ord(c)) % _M

    def __add__(self, other: Rope) -> Rope:
        if not other.size or not self.size:
            return self if not other.size else other
        return Rope(None, self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.text is None:
                todo += [r.right, r.left]
            else:
                out.append(r.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """ASCII order. Equal parts are skipped whole, by length and hash."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.size >= y.size and x.text is None:
                a += [x.right, x.left]
                b.append(y)
            elif y.text is None:
                b += [y.right, y.left]
                a.append(x)
            elif x.text is None:
                a += [x.right, x.left]
                b.append(y)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                if y.size > n:
                    b.append(Rope(y.text[n:]))
        return bool(b)


START, SYSTEM, USER, ASSISTANT = range(4)
INSERT, DELETE, REROLE, CUT_OFF = 5, 2, 1, 5
GONE = "D"  # the symbol of a row that must go
Matrix = list  # 4 x 4 of (cost, Rope) or None


def symbol(initial: str, cut_off: bool) -> str:
    s = initial if initial in ("s", "u", "a") else "o"
    return s.upper() if cut_off else s


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for row in x:
        line = []
        for j in range(4):
            best = None
            for a, other in zip(row, y):
                b = other[j]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost < best[0]:
                    best = cost, a[1] + b[1]
                elif cost == best[0]:
                    rope = a[1] + b[1]
                    if rope < best[1]:
                        best = cost, rope
            line.append(best)
        out.append(line)
    return out


def _steps() -> dict[str, Matrix]:
    def matrix(entries: dict) -> Matrix:
        return [[(entries[i, j][0], Rope(entries[i, j][1])) if (i, j) in entries else None for j in range(4)] for i in range(4)]

    stay = {(i, i): (0, "") for i in range(4)}
    inserts = stay | {(START, USER): (INSERT, "I"), (SYSTEM, USER): (INSERT, "I"), (ASSISTANT, USER): (INSERT, "I"), (USER, ASSISTANT): (INSERT, "I")}
    inserts |= {(START, ASSISTANT): (2 * INSERT, "II"), (SYSTEM, ASSISTANT): (2 * INSERT, "II")}
    before = matrix(inserts)
    out = {"": before}
    for s in (GONE, *"suaoSUAO"):
        moves = {(i, i): (DELETE, "D") for i in range(4)}
        if s != GONE:
            more = CUT_OFF if s.isupper() else 0
            to = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
            for i, j in to.items():
                keep = s.lower() == ("a" if j == ASSISTANT else "u")
                moves[i, j] = (more, "K") if keep else (more + REROLE, "R")
            if s.lower() == "s":
                moves[START, SYSTEM] = (more, "K")
        out[s] = product(before, matrix(moves))
    return out


STEPS = _steps()  # "" is the insertions that may end a conversation


# --- Re-Pair ----------------------------------------------------------------------


def repair_grammar(sequences: list[str]) -> tuple[list[list], dict[int, tuple]]:
    """The sequences with their frequent pairs replaced, and the rules
    (number -> pair): the most frequent pair (first in order, of equals) is
    replaced until none occurs twice."""
    seqs: list[list] = [list(s) for s in sequences]
    rules: dict[int, tuple] = {}

    def pairs(s: list) -> Counter:
        out: Counter = Counter()
        i = 0
        while i + 1 < len(s):
            p = s[i], s[i + 1]
            out[p] += 1
            # Of a run of equal symbols only disjoint pairs count.
            i += 2 if i + 2 < len(s) and s[i] == s[i + 1] == s[i + 2] else 1
        return out

    count: Counter = Counter()
    held: dict[tuple, set] = defaultdict(set)
    for k, s in enumerate(seqs):
        for p, n in pairs(s).items():
            count[p] += n
            held[p].add(k)
    heap = [(-n, str(p), p) for p, n in count.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, _, p = heapq.heappop(heap)
        if count[p] != -n or -n < 2:
            continue
        rule = len(rules)
        rules[rule] = p
        for k in held.pop(p):
            s = seqs[k]
            old = pairs(s)
            if p not in old:
                continue
            new, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == p:
                    new.append(rule)
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            seqs[k] = new
            now = pairs(new)
            for q in old.keys() | now.keys():
                if old[q] != now[q]:
                    count[q] += now[q] - old[q]
                    if now[q]:
                        held[q].add(k)
                    if count[q] > 1:
                        heapq.heappush(heap, (-count[q], str(q), q))
    return seqs, rules


def matrices(sequences: list[str]) -> list[Matrix]:
    """The transfer matrix of every sequence, by one grammar for all."""
    seqs, rules = repair_grammar(sequences)
    of: dict = dict(STEPS)
    for rule, (left, right) in rules.items():  # a rule only refers to earlier ones
        of[rule] = product(of[left], of[right])
    out = []
    for s in seqs:
        m = None
        for x in s:
            m = of[x] if m is None else product(m, of[x])
        out.append(m)
    return out


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation with transfer matrix ``m``."""
    last = product([m[START]], STEPS[""])[0]
    cost, rope = min((last[START], last[ASSISTANT]), key=lambda e: (e is None, e or ()))
    return cost, str(rope)


# --- Spark jobs --------------------------------------------------------------------

PIECES = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("symbols", pa.string()), ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
)
LEGAL = {"su", "ua", "au"}


def cut_pieces(piece: int, conv_type: pa.DataType, turn_type: pa.DataType):
    """Rows sorted by conversation and turn -> pieces with their symbols and counts."""
    schema = pa.schema([("conv", conv_type), *PIECES, ("low", turn_type), ("high", turn_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = None  # the open piece
        before = None  # the row before, of the same conversation
        seq = 0
        for b in batches:
            done = []
            names = ("conv", "turn", "role", "d1", "d2", "blank", "cut_off", "later")
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                conv, turn, role, d1, d2, blank, cut_off, later = row
                if state is None or conv != state["conv"] or len(state["symbols"]) >= piece:
                    if state is not None:
                        done.append(state | {"symbols": "".join(state["symbols"])})
                        if conv != state["conv"]:
                            before = None
                    state = dict(conv=conv, part=part, seq=seq, symbols=[], first=None, last=None, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None)
                    seq += 1
                initial = role[:1] or " "
                duplicate = not blank and (later or before is not None and before[1:5] == row[1:5])
                fault = "blank" if blank else "duplicate" if duplicate else "truncated" if cut_off else None
                if fault:
                    state[fault] += 1
                state["symbols"].append(GONE if blank or duplicate else symbol(initial, cut_off))
                if state["last"] is None:
                    state["first"] = initial
                elif state["last"] + initial not in LEGAL:
                    state["illegal"] += 1
                state["last"] = initial
                if turn is not None:
                    state["turns"] += before is None or before[1] != turn
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                before = row
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state | {"symbols": "".join(state["symbols"])}], schema=schema)

    return run


SOLVED = pa.schema([("symbols", pa.string()), ("whole", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (symbols, whole): one cost and audit of a whole conversation,
    or the 16 of a piece's matrix (null where a state can't be reached)."""

    def flush(todo: list[tuple[str, bool]]) -> pa.RecordBatch:
        rows = []
        for (symbols, whole), m in zip(todo, matrices([t[0] for t in todo])):
            if whole:
                cost, audit = cheapest(m)
                rows.append((symbols, whole, [cost], [audit]))
            else:
                cells = [e for line in m for e in line]
                rows.append((symbols, whole, [e and e[0] for e in cells], [e and str(e[1]) for e in cells]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SOLVED)], schema=SOLVED)

    todo, size = [], 0
    for b in batches:
        for item in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            todo.append(item)
            size += len(item[0])
            if size >= GRAMMAR:
                yield flush(todo)
                todo, size = [], 0
    if todo:
        yield flush(todo)


def joined():
    """Pieces of a conversation (any order) -> counts, cost and audit."""
    kind = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"

    def run(lists: pa.Array) -> pa.Array:
        out = []
        for pieces in lists.to_pylist():
            pieces = sorted(pieces or [], key=lambda p: (p["part"], p["seq"]))
            r = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
            r["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(pieces, pieces[1:]))
            low = [p["low"] for p in pieces if p["low"] is not None]
            high = [p["high"] for p in pieces if p["high"] is not None]
            r["gaps"] = int(max(high) - min(low) + 1) - sum(p["turns"] for p in pieces) if low else 0
            if not pieces:
                r |= {"cost": 0, "audit": ""}
            elif len(pieces) == 1:
                r |= {"cost": pieces[0]["costs"][0], "audit": pieces[0]["audits"][0]}
            else:
                m = None
                for p in pieces:
                    cells = [None if c is None else (c, Rope(a)) for c, a in zip(p["costs"], p["audits"])]
                    x = [cells[i : i + 4] for i in range(0, 16, 4)]
                    m = x if m is None else product(m, x)
                r["cost"], r["audit"] = cheapest(m)
            out.append(r)
        return pa.array(out, pa.struct([(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")] + [("audit", pa.string())]))

    return arrow_udf(run, kind)


class Repaired:
    """The hash of a conversation's repaired lines, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.any = hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def role(self) -> str:
        """The role that the next state asks for."""
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(self.role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K" and self.state == START and role[:1] == "s":
            self.state = SYSTEM
            self.line(role, text)
        elif edit != "D":
            new = self.role()
            self.line(role if edit == "K" else new, text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def hash_repaired(conv_type: pa.DataType):
    """Sorted rows, each conversation led by its audit -> (conv, repaired_sha256)."""
    schema = pa.schema([("conv", conv_type), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_conv = None, None
        for b in batches:
            done = []
            for conv, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "audit", "role", "text"))):
                if audit is not None:
                    if now is not None:
                        done.append({"conv": open_conv, "repaired_sha256": now.digest()})
                    now, open_conv = Repaired(audit), conv
                else:
                    now.row(role, text)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv": open_conv, "repaired_sha256": now.digest()}], schema=schema)

    return run


def keyed(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with the digests that order rows of a turn."""
    return rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))}).withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64("text", F.lit(1))})


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", convs: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, gaps, cost, audit,
    repaired_sha256) for every conversation of ``rows``, and of ``convs`` (one
    column) if that names others."""
    spark = prepare(rows.sparkSession)
    named = rows.select(col(conv).alias("conv"), col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"))
    x = keyed(named)
    conv_type, turn_type = (pa.array([], _arrow(x.schema[c].dataType)).type for c in ("conv", "turn"))
    solid = F.regexp_replace("text", RULES_SPACE + "+$", "")
    narrow = x.select("conv", "turn", "role", "d1", "d2", (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut_off"))

    # Where a role and text come first, added up before it is sent.
    seen = narrow.where("not blank").groupBy("conv", "role", "d1", "d2").agg(F.min(F.struct("turn")).alias("at"), F.count("*").alias("n"))
    seen = seen.where("n > 1").select("conv", F.col("conv").isNull().alias("_c"), "role", "d1", "d2", F.col("at.turn").alias("first"), F.lit(True).alias("again"))
    keys = ["_k", "role", "d1", "d2"]
    key = lambda df: df.withColumn("_k", F.xxhash64("conv", F.col("conv").isNull()))
    marked = salted_lookup(key(narrow), saved(key(seen).drop("conv", "_c"), "seen"), keys)
    marked = marked.withColumn("later", F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first")) & ~F.col("blank"))

    # Symbols, over tasks that split long conversations between turns.
    order = ["conv", "turn", "role", "d1", "d2"]
    ranged = marked.select(*order, "blank", "cut_off", "later").repartitionByRange(partitions(spark), "conv", "turn").sortWithinPartitions(*order)
    conv_sql, turn_sql = x.schema["conv"].dataType.simpleString(), x.schema["turn"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal", "turns"))
    kind = f"conv {conv_sql}, part long, seq long, symbols string, first string, last string, {counts}, low {turn_sql}, high {turn_sql}"
    pieces = saved(ranged.mapInArrow(cut_pieces(piece, conv_type, turn_type), kind), "pieces")

    # Equal sequences are solved once.
    many = pieces.groupBy("conv").agg((F.count("*") == 1).alias("whole"))
    same = F.col("p.conv").eqNullSafe(F.col("m.conv"))
    pieces_w = pieces.alias("p").join(many.alias("m").hint("shuffle_hash"), same).select("p.*", "m.whole")
    answers = saved(pieces_w.select("symbols", "whole").distinct().mapInArrow(solve, "symbols string, whole boolean, costs array<long>, audits array<string>"), "answers")
    solved = salted_lookup(pieces_w, answers, ["symbols", "whole"])
    fields = ["part", "seq", "first", "last", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "costs", "audits"]
    solved = solved.select("conv", F.struct(*fields).alias("piece"))
    names = (named if convs is None else convs.select(col(convs.columns[0]).alias("conv")).unionByName(named.select("conv"))).select("conv").distinct()
    empty = names.select("conv", F.lit(None).cast(solved.schema["piece"].dataType).alias("piece"))
    folded = solved.unionByName(empty).groupBy("conv").agg(F.collect_list("piece").alias("pieces"))
    result = saved(folded.select("conv", joined()(F.col("pieces")).alias("_r")).select("conv", "_r.*"), "result")
    discard(pieces, answers)

    head = result.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(turn_sql).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "audit")
    body = x.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "d1", "d2", F.lit(None).cast("string").alias("audit"))
    lines = head.unionByName(body).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "kind", "turn", "role", "d1", "d2")
    hashes = lines.select("conv", "audit", "role", "text").mapInArrow(hash_repaired(conv_type), f"conv {conv_sql}, repaired_sha256 string")
    same = F.col("r.conv").eqNullSafe(F.col("h.conv"))
    return result.alias("r").join(hashes.alias("h").hint("shuffle_hash"), same).select("r.*", "h.repaired_sha256")


def _arrow(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the faults that each row's checksum says."""
    space = F.lit(" ")
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    x = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return x.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    x = repair(damaged(rows), convs=rows.select("conv_id"))
    return x.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
