"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms; the coordinate of the
largest size, with its sign, is one hash value, and a bucket of a table is HASHES of
them. Vectors lie in the bucket of their best values and also look into those of their
next best ones (multiprobe). What meets in a bucket is verified with the cosine in
double precision.

A pair may meet in several buckets. It counts in the first table in which it meets,
which both sides can tell from the buckets that every vector carries, so links are
counted without writing pairs: a task returns, per vector, the links it has counted,
and links enough to keep what it found connected. Equal vectors are folded into one with a
count before they are hashed, so a group of copies costs as much as one of them. Large buckets are cut into chunks of
residents and chunks of visitors, each pair of chunks a cell that may be a task of its
own; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import components, stored

THRESHOLD = 0.95
TABLES = 8
HASHES = 3
#: Buckets that a vector looks into in each table, its own included.
PROBES = 8
#: Residents and visitors of a bucket in a cell, about.
CHUNK = 512
SEED = 12


class Rotations:
    """Pseudo-random rotations of a padded dimension, HASHES of them for each table."""

    def __init__(self, dimension: int, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED):
        self.size = 1 << max(dimension - 1, 1).bit_length()
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def buckets(self, vectors: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """Bucket numbers (vector, table, probe), the best first."""
        n = len(vectors)
        out = np.empty((n, len(self.signs), probes), np.int64)
        padded = np.zeros((n, self.size))
        padded[:, : vectors.shape[1]] = vectors
        # So many values of each hash give combinations enough.
        each = max(2, int(np.ceil(probes ** (1 / self.signs.shape[1]))) + 1)
        for t, hashes in enumerate(self.signs):
            number, short = np.zeros((n, 1), np.int64), np.zeros((n, 1))
            for signs in hashes:
                turned = padded
                for flip in signs:
                    turned = hadamard(turned * flip)
                # The largest coordinates first; a value is a coordinate and its sign.
                best = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :each]
                size = np.take_along_axis(turned, best, axis=1)
                value, size = 2 * best + (size < 0), np.abs(size)
                number = (number[:, :, None] * (2 * self.size) + value[:, None, :]).reshape(n, -1)
                # How far the combination falls short of the best one.
                short = (short[:, :, None] + ((size[:, :1] - size) ** 2)[:, None, :]).reshape(n, -1)
            order = np.argsort(short, axis=1, kind="stable")[:, :probes]
            out[:, t] = np.take_along_axis(number, order, axis=1)
        return out


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, size = rows.shape
    step = 1
    while step < size:
        parts = rows.reshape(n, size // (2 * step), 2, step)
        rows = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2)
        rows = rows.reshape(n, size)
        step *= 2
    return rows / np.sqrt(size)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """The rows in double precision, scaled to length one without overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    probes: int = PROBES,
    chunk: int = CHUNK,
) -> DataFrame:
    """`id`, `n_links`, `component_id` and `kept` of every row.

    Rows link when their buckets meet and their cosine is at least `threshold`. Vectors
    that are null, empty, zero or hold a null or non-finite component link with
    nothing; vectors of different dimensions do not link with each other.
    `component_id` is the smallest id that links reach, the row's own included, and a
    row is kept if that is its own. Rows are told apart by a number, so equal rows and
    rows with a null id are rows each and link with each other; null ids count for
    nothing in `component_id`.
    """
    id_type = vectors.schema[id_column].dataType.simpleString()
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    precision = "float" if single else "double"
    numbers = np.float32 if single else np.float64
    rows = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("id"),
            F.col(vector_column).cast(f"array<{precision}>").alias("vector"),
        )
    )
    usable = rows.mapInArrow(
        _usable(numbers), f"row long, id {id_type}, dimension int, vector binary"
    ).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    # Equal vectors are one with a count: a group of copies is hashed and verified once.
    same = ["dimension", "h1", "h2"]
    classes = stored(
        usable.groupBy(*same, "vector").agg(
            F.min("row").alias("row"), F.count("*").alias("members"), F.min("id").alias("smallest")
        )
    )
    hashed = stored(
        classes.select("row", "members", "dimension", "vector").mapInArrow(
            _hash(numbers, tables, probes),
            "row long, members long, dimension int, vector binary, buckets binary, tables array<int>,"
            " keys array<long>, probe array<int>",
        )
    )
    visits = hashed.select(
        "row", "dimension", F.explode(F.arrays_zip("tables", "keys", "probe")).alias("v")
    ).select(
        "row", "dimension", F.col("v.tables").alias("table"), F.col("v.keys").alias("bucket"),
        (F.col("v.probe") == 0).alias("resident"),
    )
    key = ["dimension", "table", "bucket"]
    sizes = visits.groupBy(*key).agg(
        F.count(F.when(F.col("resident"), 1)).alias("residents"), F.count("*").alias("n")
    )
    busy = stored(sizes.where("residents > 0 AND n > 1"))
    # A cell is a chunk of a bucket's residents and a chunk of what visits them. A resident
    # is in all cells of its chunk, and it visits the chunks after its own; the other
    # visitors visit all chunks.
    n_resident = F.ceil(F.col("residents") / chunk).cast("int")
    n_visiting = F.ceil(F.col("n") / chunk).cast("int")
    own = F.when(F.col("resident"), F.pmod(F.xxhash64("row"), n_resident).cast("int"))
    side = F.pmod(F.xxhash64("row", F.lit(1)), n_visiting).cast("int")
    first = F.coalesce(F.col("own") + 1, F.lit(0))
    at = lambda chunk, side, resident: F.struct(
        chunk.alias("chunk"), side.alias("side"), F.lit(resident).alias("resident")
    )
    nowhere = F.array(at(F.lit(0), F.lit(0), False)).cast("array<struct<chunk:int,side:int,resident:boolean>>")
    living = F.when(
        F.col("resident"),
        F.transform(F.sequence(F.lit(0), n_visiting - 1), lambda v: at(F.col("own"), v, True)),
    )
    visiting = F.when(
        first < n_resident,
        F.transform(F.sequence(first, n_resident - 1), lambda c: at(c, F.col("side"), False)),
    )
    none = F.slice(nowhere, 1, 0)
    met = visits.join(busy, key).withColumns({"own": own, "side": side})
    spread = met.select(
        "row", *key,
        F.explode(F.concat(F.coalesce(living, none), F.coalesce(visiting, none))).alias("at"),
    ).select("row", *key, "at.chunk", "at.side", "at.resident")
    cell = [*key, "chunk", "side"]
    ready = (
        spread.join(hashed.select("row", "members", "vector", "buckets"), "row")
        .repartition(*cell)
        .sortWithinPartitions(*cell, F.col("resident").desc(), "row")
        .select("row", *cell, "resident", "members", "vector", "buckets")
    )
    found = stored(
        ready.mapInArrow(_verify(numbers, threshold, tables, probes), "a long, b long, n long")
    )
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("others"))
    joined = components(found.where("b IS NOT NULL")).withColumnRenamed("node", "row")
    linked = joined.join(classes.select("row", "smallest"), "row")
    # Stored, so that the joins can split a component or a class with very many members.
    lowest = stored(linked.groupBy("root").agg(F.min("smallest").alias("lowest")))
    named = linked.join(lowest, "root").select("row", "lowest")
    described = stored(
        classes.join(counts, "row", "left")
        .join(named, "row", "left")
        .select(
            *same,
            (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("lowest", "smallest").alias("component_id"),
        )
    )
    member_of = usable.select("row", *same).join(described, same).select("row", "n_links", "component_id")
    return (
        rows.select("row", "id")
        .join(member_of, "row", "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def _usable(numbers: type):
    """The vectors that may link, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes, parts = [], [], []
            for i, vector in enumerate(batch.column(2).to_pylist()):
                if not vector or None in vector:
                    continue
                row = np.array(vector, numbers)
                if np.isfinite(row).all() and row.any():
                    places.append(i)
                    sizes.append(len(row))
                    # Adding zero turns a negative zero into zero.
                    parts.append((row + 0).tobytes())
            take = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())],
                ["row", "id", "dimension", "vector"],
            )

    return run


def _hash(numbers: type, tables: int, probes: int):
    names = ["row", "members", "dimension", "vector", "buckets", "tables", "keys", "probe"]
    which = np.repeat(np.arange(tables, dtype=np.int32), probes)
    probe = np.tile(np.arange(probes, dtype=np.int32), tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, Rotations] = {}
        for batch in batches:
            vectors, sizes = batch.column(3), batch.column(2).to_numpy()
            for dimension in np.unique(sizes).tolist():
                if dimension not in rotations:
                    rotations[dimension] = Rotations(dimension, tables)
                places = np.flatnonzero(sizes == dimension)
                for at in range(0, len(places), 1024):
                    take = pa.array(places[at : at + 1024])
                    n = len(take)
                    block = np.frombuffer(b"".join(vectors.take(take).to_pylist()), numbers).reshape(n, -1)
                    flat = rotations[dimension].buckets(unit_rows(block), probes).reshape(n, -1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(column.take(take) for column in batch.columns),
                            pa.array([b.tobytes() for b in flat], pa.binary()),
                            pa.array([which] * n, pa.list_(pa.int32())),
                            pa.array(list(flat), pa.list_(pa.int64())),
                            pa.array([probe] * n, pa.list_(pa.int32())),
                        ],
                        names,
                    )

    return run


def _verify(numbers: type, threshold: float, tables: int, probes: int):
    """Counts links of each cell's residents with its visitors.

    In the first cell of a chunk of residents these meet each other, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, residents = None, None
        held: list[tuple] = []

        def of(rows: list[tuple]):
            ids = np.array([r[0] for r in rows], np.int64)
            members = np.array([r[4] for r in rows], np.int64)
            vectors = np.frombuffer(b"".join(r[1] for r in rows), numbers).reshape(len(rows), -1)
            buckets = np.frombuffer(b"".join(r[2] for r in rows), np.int64)
            return ids, unit_rows(vectors), buckets.reshape(len(rows), tables, probes), members

        def meet(table: int, left, right, same: bool):
            """Links between two blocks, those that meet in an earlier table apart."""
            at, to = np.nonzero(left[1] @ right[1].T >= threshold)
            if same:
                at, to = at[at < to], to[at < to]
            else:
                other = left[0][at] != right[0][to]
                at, to = at[other], to[other]
            if not len(at):
                return None
            first = np.ones(len(at), bool)
            for t in range(table):
                p, q = left[2][at, t], right[2][to, t]
                first &= ~((p[:, :1] == q).any(axis=1) | (q[:, :1] == p).any(axis=1))
            if not same:
                # A pair of residents of this bucket meets as residents; a pair in which
                # both look into each other's bucket meets at the smaller bucket.
                mine, yours = left[2][at, table], right[2][to, table]
                mutual = (yours[:, :1] != mine[:, :1])[:, 0] & (mine == yours[:, :1]).any(axis=1)
                first &= ~(mutual & (yours[:, 0] < mine[:, 0]))
            a, b = left[0][at], right[0][to]
            rows, place = np.unique(np.concatenate([a[first], b[first]]), return_inverse=True)
            n = np.zeros(len(rows), np.int64)
            # Each gets as many links as the other's class has members.
            np.add.at(n, place, np.concatenate([right[3][to][first], left[3][at][first]]))
            return rows, n, _forest(a, b)

        def out(met):
            if met is None:
                return None
            rows, n, (a, b) = met
            none = np.zeros(len(a), np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, a])),
                    pa.array(np.concatenate([rows, b]), mask=np.arange(len(rows) + len(a)) < len(rows)),
                    pa.array(np.concatenate([n, none])),
                ],
                ["a", "b", "n"],
            )

        def flush():
            """Residents come first; visitors meet them in blocks."""
            nonlocal residents, held
            made = []
            if not held:
                return made
            table = cell[1]
            inside = [r for r in held if r[3]]
            outside = [r for r in held if not r[3]]
            if inside:
                block = of(inside)
                if residents is not None:
                    if cell[4] == 0:
                        made.append(meet(table, residents, block, False))
                    residents = tuple(np.concatenate([x, y]) for x, y in zip(residents, block))
                else:
                    residents = block
                if cell[4] == 0:
                    made.append(meet(table, block, block, True))
            if outside and residents is not None:
                made.append(meet(table, residents, of(outside), False))
            held = []
            return [b for b in map(out, made) if b is not None]

        for batch in batches:
            row, *where, resident, members, vector, buckets = (c.to_pylist() for c in batch.columns)
            for here, r, u, b, res, m in zip(zip(*where), row, vector, buckets, resident, members):
                if here != cell:
                    yield from flush()
                    cell, residents = here, None
                held.append((r, u, b, res, m))
                if len(held) >= 1024:
                    yield from flush()
        yield from flush()

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect, at most one less than their ends."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    both = np.array(kept, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]
