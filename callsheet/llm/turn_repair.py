"""Repair of damaged conversations by a cheapest list of edits.

A conversation is sound if its roles read as an optional system turn and pairs of user and
assistant. A path of edits runs through four states (nothing yet, after a system, a user
and an assistant turn). Hirschberg's divide and conquer finds it in linear space: a forward
and a backward vector of four costs meet in the middle, the crossing is the optimal state
with the least audit so far, and either half is solved likewise. All audits up to a row
have an edit of that row as their last letter, so none is the beginning of another, and
the order of the four best audits is all that a forward vector has to carry.

Rows take part as a code of one byte each. Spark sorts them by conversation and turn into
ranges, so that a hot conversation spreads over many tasks, and cuts them into segments of a
bounded length. A segment is known by what it does to a vector; vectors that cross the
segments of a conversation meet at their borders, and then each is solved on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import stored, with_small_batches

#: Rows of a conversation that are solved at a time.
SEGMENT_ROWS = 32_768
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

#: A row's code: its role (0 system, 1 user, 2 assistant, 3 other) and these flags.
BLANK, DUPLICATE, CUT_OFF = 4, 8, 16

_NEVER = 1 << 20
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_KEEP = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
#: The state after a turn with the role that is due.
_DUE = (2, 2, 3, 2)
#: Cost of the inserts that end a conversation soundly.
_END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[tuple[int, ...], tuple[int, ...]]


@cache
def row_steps(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of a row from state to state: cost and audit, inserts before it included."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    late = TRUNCATED if code & CUT_OFF else 0
    for start in range(4):
        state, spent, audit = start, 0, ""
        # A third insert leads where the first does.
        for _ in range(3):
            edits = [(state, DELETE, "D")]
            if not code & (BLANK | DUPLICATE):
                edits.append((_DUE[state], REROLE + late, "R"))
                if state in _KEEP[code & 3]:
                    edits.append((_KEEP[code & 3][state], late, "K"))
            for to, cost, letter in edits:
                new = spent + cost, audit + letter
                found[start, to] = min(found.get((start, to), new), new)
            state, spent, audit = _DUE[state], spent + INSERT, audit + "I"
    return found


@cache
def _forward(vector: Vector, code: int) -> tuple[Vector, int]:
    """The vector behind a row, least cost 0, and what was taken off its costs."""
    costs, ranks = vector
    best: dict[int, tuple[int, int, str]] = {}
    for (start, to), (cost, audit) in row_steps(code).items():
        if costs[start] < _NEVER:
            new = costs[start] + cost, ranks[start], audit
            best[to] = min(best.get(to, new), new)
    order = sorted(best, key=lambda to: best[to][1:])
    least = min(x[0] for x in best.values())
    return (
        tuple(best[q][0] - least if q in best else _NEVER for q in range(4)),
        tuple(order.index(q) if q in best else 4 for q in range(4)),
    ), least


@cache
def _backward(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    """The costs from before a row to the end, least cost 0."""
    best = [_NEVER] * 4
    for (start, to), (cost, _) in row_steps(code).items():
        best[start] = min(best[start], costs[to] + cost)
    least = min(best)
    return tuple(min(x - least, _NEVER) for x in best)


def _from(state: int) -> Vector:
    return tuple(0 if q == state else _NEVER for q in range(4)), (0, 1, 2, 3)


def forward(codes: bytes, vector: Vector) -> tuple[Vector, int]:
    cost = 0
    for code in codes:
        vector, more = _forward(vector, code)
        cost += more
    return vector, cost


def backward(codes: bytes, costs: tuple[int, ...]) -> tuple[int, ...]:
    for code in reversed(codes):
        costs = _backward(costs, code)
    return costs


def crossing(vector: Vector, costs: tuple[int, ...]) -> int:
    """The state of an optimal path with the least audit where two vectors meet."""
    total = [a + b for a, b in zip(vector[0], costs)]
    return min((q for q in range(4) if total[q] == min(total)), key=lambda q: vector[1][q])


def solve(codes: bytes, start: int, end: int) -> list[str]:
    """The edits of every row, inserts before it included, of the best path between two states."""
    out: list[str] = []
    left = [(0, len(codes), start, end)] if codes else []
    while left:
        lo, hi, p, q = left.pop()
        if hi - lo == 1:
            out.append(row_steps(codes[lo])[p, q][1])
            continue
        mid = (lo + hi) // 2
        vector, _ = forward(codes[lo:mid], _from(p))
        meet = crossing(vector, backward(codes[mid:hi], _from(q)[0]))
        left += [(mid, hi, meet, q), (lo, mid, p, meet)]
    return out


def repair_roles(codes: bytes) -> tuple[int, list[str]]:
    """Cost and edits of a whole conversation; the last item has the inserts at its end."""
    vector, cost = forward(codes, _from(0))
    end = crossing(vector, _END)
    return cost + vector[0][end] + _END[end], [*solve(codes, 0, end), "I" * (_END[end] // INSERT)]


def coded_rows(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """`id`, `turn`, `role`, `text`, `digest` (of role and text) and `code` of every row.

    Null roles and texts count as empty. The code has no DUPLICATE yet.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = turns.select(
        F.col(id_column).alias("id"),
        F.col(turn_column).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_off = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    flags = F.when(blank, F.lit(BLANK)).when(cut_off, F.lit(CUT_OFF)).otherwise(0)
    return rows.withColumns({"digest": _digest(), "code": (kind + flags).cast("int")})


def _digest() -> Column:
    # The length keeps role and text apart.
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[f"r_{name}"])
    return found


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({name: f"r_{name}" for name in names})


class Repair:
    """The repair of all conversations of a table.

    `rows` has the repaired turns, `conversations` a row per conversation with turns.
    Rows are in the order of their turns, null turns first; those of equal turns in the
    order of their digests, equal rows side by side. Rows with a null id are one
    conversation. An empty table gives no rows.
    """

    def __init__(self, turns: DataFrame, segment_rows: int = SEGMENT_ROWS, **columns: str):
        coded = coded_rows(turns, **columns)
        # Equal rows become one with a count before anything is shuffled.
        folded = stored(
            coded.groupBy("id", "turn", "digest").agg(F.count("*").alias("n"), F.max("code").alias("code"))
        )
        # Stored, so that adaptive execution can split a hot id and digest in the join.
        repeated = stored(
            folded.groupBy("id", "digest")
            .agg(F.min("turn").alias("first"), F.count("turn").alias("known"), F.count("*").alias("places"))
            .where("places > 1")
        )
        other = _renamed(repeated, "id", "digest")
        # The first is that with a null turn, or else that with the smallest.
        later = F.col("turn").isNotNull() & ((F.col("known") < F.col("places")) | (F.col("turn") > F.col("first")))
        flagged = stored(
            folded.join(other, _same(folded, other, "id", "digest"), "left").select(
                "id", "turn", "digest", "n",
                (F.col("code") + F.when(later & (F.col("code").bitwiseAND(BLANK) == 0), DUPLICATE).otherwise(0)).alias("code"),
            )
        )
        self.id_type = coded.schema["id"].dataType.simpleString()
        order = ["id", "turn", "digest"]
        self.segments = stored(
            flagged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
                _segments(segment_rows),
                f"id {self.id_type}, part int, seq int, start long, turns array<long>, digests binary,"
                " codes binary, copies array<long>, costs array<long>, ranks array<long>,"
                " spare long, blank long, duplicate long, truncated long, illegal long",
            )
        )
        self.coded = coded
        self.crossed = stored(self._crossed())
        self.solved = stored(self._solved())

    def _crossed(self) -> DataFrame:
        """A row per conversation: its figures and the states at the borders of its segments."""
        edge = "part seq costs ranks spare blank duplicate truncated illegal".split()
        parts = self.segments.select(
            "id",
            F.struct(
                *edge,
                F.substring("codes", 1, 1).alias("head"),
                F.expr("substring(codes, -1, 1)").alias("tail"),
                F.expr("filter(turns, x -> x IS NOT NULL)").alias("known"),
            ).alias("x"),
        ).select(
            "id",
            F.struct(
                *[F.col(f"x.{c}").alias(c) for c in (*edge, "head", "tail")],
                F.array_min("x.known").alias("low"),
                F.array_max("x.known").alias("high"),
                F.size(F.array_distinct("x.known")).cast("long").alias("distinct"),
            ).alias("x"),
        )
        # A conversation has a segment, of a few dozen numbers here, per SEGMENT_ROWS rows.
        return (
            parts.groupBy("id")
            .agg(F.array_sort(F.collect_list("x")).alias("parts"))
            .mapInArrow(
                _cross,
                f"id {self.id_type}, gaps long, blank long, duplicate long, truncated long, illegal long,"
                " cost long, borders array<struct<part:int,seq:int,start_state:int,end_state:int,tail:string>>",
            )
        )

    def _solved(self) -> DataFrame:
        borders = self.crossed.select(F.explode("borders").alias("b")).select(
            F.col("b.part").alias("r_part"), F.col("b.seq").alias("r_seq"),
            "b.start_state", "b.end_state", "b.tail",
        )
        rows = self.segments.select("id", "part", "seq", "start", "turns", "digests", "codes", "copies")
        joined = rows.join(borders, _same(rows, borders, "part", "seq")).drop("r_part", "r_seq")
        return with_small_batches(joined).mapInArrow(
            _solve,
            f"id {self.id_type}, part int, seq int, audit string,"
            " edits array<struct<place:long,turn:long,digest:binary,role:string>>",
        )

    @property
    def conversations(self) -> DataFrame:
        """`id`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost` and `audit`.

        A row's first fault counts; `illegal` counts neighbours whose roles may not follow
        each other; `gaps` the numbers missing between the least and the greatest turn.
        """
        audits = (
            self.solved.groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))).alias("parts"))
            .select(F.col("id").alias("r_id"), F.array_join("parts.audit", "").alias("audit"))
        )
        rows = self.crossed.drop("borders")
        return rows.join(audits, _same(rows, audits, "id")).drop("r_id")

    @property
    def rows(self) -> DataFrame:
        """`id`, `place` (rising), `role` and `text` of the repaired turns."""
        edits = self.solved.select("id", F.explode("edits").alias("e")).select("id", "e.*")
        made = edits.where("digest IS NULL").select("id", "place", "role", F.lit("").alias("text"))
        texts = _renamed(
            self.coded.select("id", "turn", "digest", "role", "text").dropDuplicates(["id", "turn", "digest"]),
            "id", "turn", "digest", "role",
        )
        kept = edits.where("digest IS NOT NULL")
        return kept.join(texts, _same(kept, texts, "id", "turn", "digest")).select(
            "id", "place", F.coalesce("role", "r_role").alias("role"), "text"
        ).unionByName(made)


def text_digests(rows: DataFrame) -> DataFrame:
    """`id` and `sha256` of the `role:text` of `Repair.rows`, joined by line feeds.

    A digest takes its conversation in order, so one task reads it; it holds a batch.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    return (
        rows.repartition("id")
        .sortWithinPartitions("id", "place")
        .select("id", F.concat_ws(":", "role", "text").alias("line"))
        .mapInArrow(_digests, f"id {id_type}, sha256 string")
    )


def _segments(most: int):
    names = (
        "id part seq start turns digests codes copies costs ranks spare blank duplicate truncated illegal"
    ).split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        out: list[tuple] = []
        kinds = None

        def close() -> None:
            nonlocal seq, start
            codes = bytes(r[4] for r in rows)
            copies = [(k, r[3]) for k, r in enumerate(rows) if r[3] > 1]
            whole = [forward(codes, _from(q)) for q in range(4)]
            faults = [0, 0, 0]
            for _, _, _, n, code in rows:
                kind = 0 if code & BLANK else 1 if code & DUPLICATE else 2 if code & CUT_OFF else None
                if kind is not None:
                    faults[kind] += 1
                # All copies but the first are duplicates, of a blank row they are blank.
                faults[0 if kind == 0 else 1] += n - 1
            bare = [c & 3 for c in codes]
            illegal = sum(n - 1 for _, n in copies) + sum(not _legal(a, b) for a, b in zip(bare, bare[1:]))
            out.append((
                rows[0][0], part, seq, start, [r[1] for r in rows], b"".join(r[2] for r in rows), codes,
                [x for pair in copies for x in pair],
                [c + extra if c < _NEVER else _NEVER for vector, extra in whole for c in vector[0]],
                [r for vector, _ in whole for r in vector[1]],
                DELETE * sum(n - 1 for _, n in copies), *faults, illegal,
            ))
            seq, start = seq + 1, start + len(rows)
            rows.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        held = 0
        for batch in batches:
            kinds = kinds or [
                batch.schema.field("id").type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * 5,
            ]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and (row[0] != rows[0][0] or len(rows) >= most):
                    held += len(rows)
                    close()
                    if held >= SEGMENT_ROWS:
                        yield flush()
                        held = 0
                rows.append(row)
        if rows:
            close()
        if out:
            yield flush()

    return run


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = "id gaps blank duplicate truncated illegal cost borders".split()
    border = pa.list_(
        pa.struct([(n, pa.int32()) for n in ("part", "seq", "start_state", "end_state")] + [("tail", pa.string())])
    )
    for batch in batches:
        out = [_crossing(parts) for parts in batch.column(1).to_pylist()]
        columns = list(zip(*out)) or [()] * 7
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], border)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)


def _crossing(parts: list[dict]) -> tuple:
    """Figures of a conversation and the states at the borders of its segments."""
    vectors, cost = [_from(0)], 0
    for x in parts:
        costs, ranks = vectors[-1]
        best: dict[int, tuple[int, int, int]] = {}
        for p in range(4):
            for q in range(4):
                step = x["costs"][4 * p + q]
                if costs[p] < _NEVER and step < _NEVER:
                    new = costs[p] + step, ranks[p], x["ranks"][4 * p + q]
                    best[q] = min(best.get(q, new), new)
        least, order = min(b[0] for b in best.values()), sorted(best, key=lambda q: best[q][1:])
        cost += least + x["spare"]
        vectors.append((
            tuple(best[q][0] - least if q in best else _NEVER for q in range(4)),
            tuple(order.index(q) if q in best else 4 for q in range(4)),
        ))
    states, costs = [crossing(vectors[-1], _END)], _END
    cost += vectors[-1][0][states[0]] + _END[states[0]]
    for vector, x in zip(vectors[-2::-1], parts[::-1]):
        costs = tuple(
            min(min(x["costs"][4 * p + q] + costs[q] for q in range(4)), _NEVER) for p in range(4)
        )
        states.insert(0, crossing(vector, costs))
    borders = [
        (x["part"], x["seq"], p, q, "") for x, p, q in zip(parts, states, states[1:])
    ]
    borders[-1] = (*borders[-1][:4], "I" * (_END[states[-1]] // INSERT))
    figures = [sum(x[c] for x in parts) for c in ("blank", "duplicate", "truncated", "illegal")]
    figures[3] += sum(not _legal(a["tail"][0] & 3, b["head"][0] & 3) for a, b in zip(parts, parts[1:]))
    known = [x for x in parts if x["low"] is not None]
    gaps = 0
    if known:
        # Segments that share a turn count it once.
        shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(x["distinct"] for x in known) + shared
    return gaps, *figures, cost, borders


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "part", "seq", "audit", "edits"]
    edit = pa.list_(
        pa.struct([("place", pa.int64()), ("turn", pa.int64()), ("digest", pa.binary()), ("role", pa.string())])
    )
    for batch in batches:
        audits, edits = [], []
        for row in batch.to_pylist():
            audit, made = _edits(row)
            audits.append(audit)
            edits.append(made)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names[:3]), pa.array(audits, pa.string()), pa.array(edits, edit)], names
        )


def _edits(row: dict) -> tuple[str, list[dict]]:
    """The audit of a segment and the turns that it leaves or makes.

    A turn that stays has its digest, and a role if that is new; a made one has no digest.
    """
    codes, state = row["codes"], row["start_state"]
    copies = dict(zip(row["copies"][::2], row["copies"][1::2]))
    audit, made = [], []
    base = (row["part"] << 40) + 4 * row["start"]
    for k, letters in enumerate([*solve(codes, state, row["end_state"]), row["tail"]]):
        audit.append(letters + "D" * (copies.get(k, 1) - 1))
        for step, letter in enumerate(letters):
            place = base + 4 * k + step
            if letter == "D":
                continue
            if letter == "K":
                state, role = _KEEP[codes[k] & 3][state], None
            else:
                state = _DUE[state]
                role = "user" if state == 2 else "assistant"
            own = letter != "I"
            made.append({
                "place": place, "turn": row["turns"][k] if own else None,
                "digest": row["digests"][16 * k : 16 * k + 16] if own else None, "role": role,
            })
    return "".join(audit), made


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("id").type
        ids, found = [], []
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is not None and key == current:
                digest.update(b"\n" + line.encode())
                continue
            if digest is not None:
                ids.append(current)
                found.append(digest.hexdigest())
            current, digest = key, hashlib.sha256(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string())], ["id", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([current], kind), pa.array([digest.hexdigest()])], ["id", "sha256"]
        )
