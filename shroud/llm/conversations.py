"""Conversation structure repair (13): square-root checkpointed dynamic programming.

A conversation is repaired by the cheapest edits after which its role initials read
``(s?(ua)+)?``; of equally cheap ones the ASCII-least audit string wins.  Four states
(nothing yet, after s, after u, after a) and the edits Delete, Insert, Keep, Rerole
give a cost-to-go vector of four numbers before every row, computed backward.

1. Rows are dealt by ranges of (conv_id, turn, role, text) and sorted, so one long
   conversation spreads over as many partitions as its rows fill.
2. A conversation inside one partition, of at most ``run_rows`` rows and
   ``run_bytes``, is repaired at once: the backward vectors are kept only at
   checkpoints, every sqrt(m) rows; walking forward, the block behind each checkpoint
   is recomputed and the least tight edit taken.
3. What may reach over a boundary is cut into segments of that size.  Each segment has
   a 4 x 4 (min, +) matrix; a scan over the matrices of a conversation, last segment
   first, gives the vector behind each segment: checkpoints again, one a segment.  With
   it every segment is walked for each state in which it may be entered, a scan of
   these outcomes gives the true one, and the segment is walked once more for its
   edits.  The scans read one row a segment.

Rows of a conversation stand by turn (null first); rows that share a turn by role and
text, in code points.  Null roles and texts are read as one space; a null conv_id is a
conversation of its own.  An empty role has no initial, so it can't be kept, and a pair
with it is illegal.  Rows equal in conversation, turn, role and text stand together in
one task.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table

Vector = tuple[int, int, int, int]

BLANKS = " \t\n\x0b\x0c\r"
CLASS = {"s": 1, "u": 2, "a": 3}
ROLE = {2: "user", 3: "assistant"}
#: the state that an inserted or reroled row leads to: 0 nothing yet, 1 after s, 2 after u, 3 after a
NEXT = (2, 2, 3, 2)
#: (state, class of the row's initial) to the state after keeping it
KEEP = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
#: cost-to-go where no row is left: inserts up to a full pair
END: Vector = (0, 4, 2, 0)
FAR = 1 << 50
#: bits of a row's code: class of the initial (2 bits), must go, truncated
GOES, CUT = 4, 8


def back(code: int, c: Vector) -> Vector:
    """The vector before a row of this code, from the one behind it."""
    c0, c1, c2, c3 = c
    b0, b1, b2, b3 = c0 + 3, c1 + 3, c2 + 3, c3 + 3
    if not code & GOES:
        t = code >> 3
        u, a, kind = c2 + 2 + t, c3 + 2 + t, code & 3
        if kind == 1:
            b0 = min(b0, c1 + t)
        elif kind == 2:
            u -= 2
        elif kind == 3:
            a -= 2
        b0, b1, b2, b3 = min(b0, u), min(b1, u), min(b2, a), min(b3, u)
    n2, n3 = min(b2, b3 + 2), min(b3, b2 + 2)
    return min(b0, n2 + 2), min(b1, n2 + 2), n2, n3


def walk(codes: bytes, state: int, end: Vector, last: bool) -> Iterator[tuple[str, int, int]]:
    """The least cheapest edits from ``state`` on, with ``end`` behind the rows: (initial, row, new state).

    Vectors are stored at every sqrt(m)-th row only; each block is recomputed from the
    checkpoint behind it.  With ``last`` the inserts after the last row follow.
    """
    m = len(codes)
    block = isqrt(m) + 1
    marks, c = {m: end}, end
    for i in range(m - 1, -1, -1):
        c = back(codes[i], c)
        if i % block == 0:
            marks[i] = c
    for lo in range(0, m, block):
        hi = min(lo + block, m)
        vectors = [marks[hi]]
        for i in range(hi - 1, lo - 1, -1):
            vectors.append(back(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(lo, hi):
            here, after, code = vectors[i - lo], vectors[i - lo + 1], codes[i]
            while True:
                cost = here[state]
                if after[state] + 3 == cost:
                    yield "D", i, state
                    break
                if here[NEXT[state]] + 2 == cost:
                    state = NEXT[state]
                    yield "I", i, state
                    continue
                kept = KEEP.get((state, code & 3))
                if kept is not None and after[kept] + (code >> 3) == cost:
                    state = kept
                    yield "K", i, state
                else:
                    state = NEXT[state]
                    yield "R", i, state
                break
    if last:
        while END[state]:
            state = NEXT[state]
            yield "I", m, state


def outcomes(codes: bytes, end: Vector) -> list[int]:
    """For each state in which the rows may be entered, the one in which they are left."""
    out = []
    for state in range(4):
        for _, _, state in walk(codes, state, end, False):
            pass
        out.append(state)
    return out


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before the rows to each behind them, row by row."""
    cols = []
    for to in range(4):
        c: Vector = tuple(0 if s == to else FAR for s in range(4))
        for code in reversed(codes):
            c = back(code, c)
        cols.append(c)
    return [cols[to][s] for s in range(4) for to in range(4)]


def apply_matrix(m: list[int], c: Vector) -> Vector:
    return tuple(min(m[4 * s + to] + c[to] for to in range(4)) for s in range(4))


def edits(codes: bytes, roles: list[str], texts: list[str], state: int, end: Vector, last: bool) -> tuple[str, int, list[dict]]:
    """(audit, cost, repaired rows) of one piece."""
    audit, cost, rows = [], 0, []
    for edit, i, to in walk(codes, state, end, last):
        audit.append(edit)
        cost += {"D": 3, "I": 2, "K": 0, "R": 2}[edit]
        if edit in "KR":
            cost += codes[i] >> 3
        if edit != "D":
            rows.append({"role": roles[i] if edit == "K" else ROLE[to], "text": "" if edit == "I" else texts[i]})
    return "".join(audit), cost, rows


# ---- facts of a run of rows, which add up over segments ----------------------


def no_facts() -> list:
    """blank, duplicate, truncated, illegal, distinct turns, first turn, last turn, first class, last class."""
    return [0, 0, 0, 0, 0, None, None, None, None]


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((1, 2), (2, 3), (3, 2))


def add_facts(a: list, b: list) -> list:
    """Facts of a's rows followed by b's."""
    out = [x + y for x, y in zip(a[:5], b[:5])]
    if a[8] is not None and b[7] is not None and not _legal(a[8], b[7]):
        out[3] += 1
    if a[6] is not None and a[6] == b[5]:
        out[4] -= 1
    return [*out, *(x if x is not None else y for x, y in ((a[5], b[5]), (b[6], a[6]), (a[7], b[7]), (b[8], a[8])))]


def digest_facts(f: list) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal."""
    gaps = 0 if f[5] is None else f[6] - f[5] + 1 - f[4]
    return [gaps, *f[:4]]


PIECE = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("part", pa.int64()), ("seg", pa.int64()), ("idx", pa.int64()), ("code", pa.int32()), ("role", pa.string()),
    ("text", pa.string()), ("matrix", pa.list_(pa.int64())), ("facts", pa.list_(pa.int64())), ("audit", pa.string()), ("cost", pa.int64()),
    ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
PIECE_DDL = ("kind string, conv_id long, part long, seg long, idx long, code int, role string, text string, matrix array<long>, facts array<long>, "
             "audit string, cost long, repaired array<struct<role:string,text:string>>")


class _Out:
    """Rows of a schema as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, size: int = 0, **row) -> None:
        self.rows.append(row)
        self.size += size + 100

    def ready(self) -> bool:
        return self.size > 4 << 20

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema], schema=self.schema)
        self.rows, self.size = [], 0
        return batch


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _runs(run_rows: int, run_bytes: int):
    """Sorted rows (conv_id, turn, role, text, blank, seen, open) to repaired conversations and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, seg = _Out(PIECE), 0
        conv = before = None
        codes, roles, texts, size, facts = bytearray(), [], [], 0, no_facts()
        at_edge = True  # the first run of a partition may have begun in the one before

        def close(whole: bool) -> None:
            """Hand on the rows held: as a repaired conversation, or as one segment."""
            nonlocal codes, roles, texts, size, facts, seg
            if whole:
                audit, cost, rows = edits(bytes(codes), roles, texts, 0, END, True)
                out.put(2 * size, kind="done", conv_id=conv, part=part, seg=seg, facts=facts, audit=audit, cost=cost, repaired=rows)
            else:
                out.put(kind="seg", conv_id=conv, part=part, seg=seg, matrix=matrix(codes), facts=facts)
                for i, (code, role, text) in enumerate(zip(codes, roles, texts)):
                    out.put(len(role) + len(text), kind="row", conv_id=conv, part=part, seg=seg, idx=i, code=code, role=role, text=text)
            seg += 1
            codes, roles, texts, size, facts = bytearray(), [], [], 0, no_facts()

        for conv_id, turn, role, text, blank, seen, cut in _tuples(batches):
            if before is None or conv_id != conv:
                if before is not None:
                    close(not at_edge)
                    at_edge = False
                conv, before = conv_id, ()
            elif len(codes) >= run_rows or size >= run_bytes:
                close(False)
                at_edge = True  # of a segment
            fault = [blank, not blank and (seen or before == (turn, role, text))]
            fault.append(cut and not any(fault))
            before = (turn, role, text)
            kind = CLASS.get(role[:1], 0)
            codes.append(kind | GOES * (fault[0] or fault[1]) | CUT * fault[2])
            roles.append(role)
            texts.append(text)
            size += len(role) + len(text)
            facts = add_facts(facts, [*map(int, fault), 0, int(turn is not None), turn, turn, kind, kind])
            if out.ready():
                yield out.take()
        if codes:
            close(False)
        yield out.take()

    return run


ENDS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seg", pa.int64()), ("vector", pa.list_(pa.int64())), ("last", pa.bool_())])
ENDS_DDL = "conv_id long, part long, seg long, vector array<long>, last boolean"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (conv_id, part, seg, matrix), each conversation's last one first, to the vectors behind them."""
    out, conv, vector, started = _Out(ENDS), None, END, False
    for conv_id, part, seg, m in _tuples(batches):
        last = not started or conv_id != conv
        if last:
            conv, vector, started = conv_id, END, True
        out.put(conv_id=conv_id, part=part, seg=seg, vector=list(vector), last=last)
        vector = apply_matrix(m, vector)
        if out.ready():
            yield out.take()
    yield out.take()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, list[str], list[str]]]:
    """Sorted rows (part, seg, idx, code, role, text, ...), a head with null idx before each segment's rows, segment by segment."""
    head, codes, roles, texts = None, bytearray(), [], []
    for row in _tuples(batches):
        if row[2] is None:
            if head:
                yield head, bytes(codes), roles, texts
            head, codes, roles, texts = row, bytearray(), [], []
        else:
            codes.append(row[3])
            roles.append(row[4])
            texts.append(row[5])
    if head:
        yield head, bytes(codes), roles, texts


LEFT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seg", pa.int64()), ("vector", pa.list_(pa.int64())), ("last", pa.bool_()), ("left", pa.list_(pa.int64()))])
LEFT_DDL = ENDS_DDL + ", left array<long>"


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(LEFT)
    for (part, seg, _, _, _, _, conv_id, vector, last), codes, _, _ in _segments(batches):
        out.put(conv_id=conv_id, part=part, seg=seg, vector=vector, last=last, left=outcomes(codes, tuple(vector)))
        if out.ready():
            yield out.take()
    yield out.take()


ENTRY = pa.schema([*ENDS, ("state", pa.int64())])
ENTRY_DDL = ENDS_DDL + ", state long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes in order to the state in which each segment is entered."""
    out, conv, state, started = _Out(ENTRY), None, 0, False
    for conv_id, part, seg, vector, last, left in _tuples(batches):
        if not started or conv_id != conv:
            conv, state, started = conv_id, 0, True
        out.put(conv_id=conv_id, part=part, seg=seg, vector=vector, last=last, state=state)
        state = left[state]
        if out.ready():
            yield out.take()
    yield out.take()


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with vector and state to their edits."""
    out = _Out(PIECE)
    for (part, seg, _, _, _, _, conv_id, vector, last, state), codes, roles, texts in _segments(batches):
        audit, cost, rows = edits(codes, roles, texts, state, tuple(vector), last)
        out.put(2 * sum(map(len, texts)), kind="piece", conv_id=conv_id, part=part, seg=seg, audit=audit, cost=cost, repaired=rows)
        if out.ready():
            yield out.take()
    yield out.take()


def _ordered(df: DataFrame, *order) -> DataFrame:
    """Segments of a conversation in one task, in order: one row a segment."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _with_heads(rows: DataFrame, heads: DataFrame, *names: str) -> DataFrame:
    """Rows of segments behind their heads, each segment in one task."""
    blank = [F.lit(None).cast(heads.schema[n].dataType).alias(n) for n in names]
    rows = rows.select("part", "seg", "idx", "code", "role", "text", "conv_id", *blank)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("idx", "long"), ("code", "int"), ("role", "string"), ("text", "string"))]
    heads = heads.select("part", "seg", *none, "conv_id", *names)
    return rows.unionByName(heads).repartition("part", "seg").sortWithinPartitions("part", "seg", F.asc_nulls_first("idx"))


def mark_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, blank, seen, cut); ``seen``: the role and text stand at a smaller turn, too."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    rows = turns.select("conv_id", "turn", "role", "text", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
                        F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at")).alias("when"),
                        F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.hex("role"), F.lit(":"), "text"), 256).alias("key"))
    first = rows.where(~F.col("blank")).groupBy("key").agg(F.min("when").alias("first"), F.max("when").alias("latest"))
    first = first.where(F.col("first") < F.col("latest")).select("key", "first")
    rows = rows.join(first, "key", "left")
    return rows.select("conv_id", "turn", "role", "text", "blank", F.coalesce(F.col("when") > F.col("first"), F.lit(False)).alias("seen"), "cut")


def repair(turns: DataFrame, run_rows: int = 1 << 16, run_bytes: int = 16 << 20) -> DataFrame:
    """Pieces of repaired conversations: (kind, conv_id, part, seg, facts, audit, cost, repaired).

    ``turns`` has conv_id, turn, role and text.  A conversation is the pieces of its id in
    the order of (part, seg): one of kind ``done``, or several of kind ``piece``.
    ``repaired`` holds the roles and texts, ``facts`` what :func:`add_facts` adds up.
    """
    scratch = Scratch(turns.sparkSession, "conversations")
    turns = project(turns, conv_id=F.col("conv_id").cast("long"), turn=F.col("turn").cast("long"), role=F.coalesce("role", F.lit(" ")), text=F.coalesce("text", F.lit(" ")))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    rows = mark_faults(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    first = scratch.write(rows.mapInArrow(_runs(run_rows, run_bytes), PIECE_DDL), "first")
    whole, heads, cut = (first.where(F.col("kind") == k) for k in ("done", "seg", "row"))
    ends = _ordered(heads, F.desc("part"), F.desc("seg")).select("conv_id", "part", "seg", "matrix").mapInArrow(_ends, ENDS_DDL)
    ends = scratch.write(ends, "ends")
    narrow = cut.select("part", "seg", "idx", "code", F.lit("").alias("role"), F.lit("").alias("text"), "conv_id")
    left = _with_heads(narrow, ends, "vector", "last").mapInArrow(_outcomes, LEFT_DDL)
    entry = scratch.write(_ordered(left, "part", "seg").mapInArrow(_entries, ENTRY_DDL), "entry")
    pieces = _with_heads(cut, entry, "vector", "last", "state").mapInArrow(_walks, PIECE_DDL).drop("facts")
    pieces = pieces.join(heads.select("part", "seg", "facts"), ["part", "seg"])
    names = ["kind", "conv_id", "part", "seg", "facts", "audit", "cost", "repaired"]
    return whole.select(*names).unionByName(pieces.select(*names))


DIGEST = pa.schema([("conv_id", pa.int64()), ("facts", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
DIGEST_DDL = "conv_id long, facts array<long>, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (conv_id, facts, audit, cost, lines) in order to one row a conversation; lines are hashed as they come."""
    out, conv, held = _Out(DIGEST), None, None

    def row() -> dict:
        facts, audit, cost, sha, _ = held
        return {"conv_id": conv, "facts": digest_facts(facts), "cost": cost, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    for conv_id, facts, audit, cost, lines in _tuples(batches):
        if held is None or conv_id != conv:
            if held is not None:
                out.put(**row())
                if out.ready():
                    yield out.take()
            conv, held = conv_id, [no_facts(), [], 0, hashlib.sha256(), False]
        held[0], held[2] = add_facts(held[0], facts), held[2] + cost
        held[1].append(audit)
        if lines is not None:
            held[3].update(("\n" * held[4] + lines).encode())
            held[4] = True
    if held is not None:
        out.put(**row())
    yield out.take()


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    lines = F.when(F.size("repaired") > 0, lines)
    f = F.col("facts")
    gaps = F.when(f[5].isNull(), 0).otherwise(f[6] - f[5] + 1 - f[4])
    one = pieces.where(F.col("kind") == "done").select("conv_id", F.array(gaps, *(f[i] for i in range(4))).alias("facts"), "cost", "audit",
                                                       F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256"))
    many = pieces.where(F.col("kind") == "piece").withColumn("lines", lines)
    many = _ordered(many.select("conv_id", "part", "seg", "facts", "audit", "cost", "lines"), "part", "seg")
    many = many.select("conv_id", "facts", "audit", "cost", "lines").mapInArrow(_joined, DIGEST_DDL)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    return one.unionByName(many).select("conv_id", *(f[i].alias(n) for i, n in enumerate(names)), "cost", "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, loses [.!?], is repeated or becomes a user's."""
    c = project(turns, conv_id=F.col("conv_id").cast("long"), turn=F.col("turn").cast("long"), role=F.coalesce("role", F.lit(" ")), text=F.coalesce("text", F.lit(" ")))
    part = [F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")]
    c = c.withColumn("how", F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(turns: DataFrame, **limits) -> DataFrame:
    """The contract's row for every original conversation, after :func:`damage`."""
    found = digests(repair(damage(turns), **limits)).withColumnRenamed("conv_id", "c")
    ids = turns.select(F.col("`conv_id`").cast("long").alias("conv_id")).distinct()
    rows = ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left").drop("c")
    zeros = dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0)
    return rows.fillna(zeros | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its faults and its cheapest repair."""
    return repair_report(read_table(spark, sf_dir, "conversations"))
