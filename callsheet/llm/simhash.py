"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected components.

Method: distinct fingerprints go into BK-trees, whose children are keyed by their
Hamming distance to the parent; a search follows only edges within the radius of the
distance it has measured. One tree over all fingerprints would have to travel to
every task and be walked by every fingerprint, so the trees are cut into shards:
fingerprints that differ in at most r bits agree on at least one of r + 1 bands of
their bits, hence a tree per band value, met by the fingerprints with that value only,
finds every link. A shard with too many fingerprints is cut again by bands of the bits
that it does not share. Fingerprints in a shard are distinct, so this ends; no shard
is capped and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import components, stored, with_small_batches

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: A tree of more fingerprints is cut into shards again.
SHARD_SIZE = 1024
BITS = 64


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of a text's shingle hashes; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(words_each, len(words))
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    step = 1 << 18  # shingles held as bits at a time
    for at in range(0, len(starts), step):
        hashes = np.array(
            [
                xxhash.xxh64_intdigest(line[a:b], SEED)
                for a, b in zip(starts[at : at + step], stops[at : at + step])
            ],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


class Tree:
    """A BK-tree of 64-bit integers under the Hamming distance."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int) -> list[int]:
        """Places of the values within the radius."""
        found, todo, radius = [], [0] if self.values else [], self.radius
        while todo:
            place = todo.pop()
            distance = (self.values[place] ^ value).bit_count()
            if distance <= radius:
                found.append(place)
            edges = self.children[place]
            if edges:
                for edge in range(distance - radius, distance + radius + 1):
                    if edge in edges:
                        todo.append(edges[edge])
        return found

    def add(self, value: int) -> None:
        """Adds a value that the tree does not hold."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        place = 0
        while place != new:
            place = self.children[place].setdefault((self.values[place] ^ value).bit_count(), new)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what links within the radius connect, at most one less than values."""
    tree, parent, links = Tree(radius), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.search(value):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((value, values[j]))
        tree.add(value)
    return links


def fingerprints(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words_each: int = SHINGLE_WORDS,
    text_hash: Column | None = None,
) -> DataFrame:
    """`id`, `fingerprint` (long, two's complement) and `text_hash`, if asked for, of every row.

    Null texts count as empty. Shingles repeat as often as they occur; a text of fewer
    words than a shingle is one shingle.
    """
    rows = with_small_batches(docs).select(
        F.col(text_column).cast("string").alias("text"),
        F.col(id_column).alias("id"),
        *([] if text_hash is None else [text_hash.alias("text_hash")]),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    more = "" if text_hash is None else ", text_hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words_each) for t in batch.column(0).to_pylist()]
            found = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], found], [*batch.schema.names[1:], "fingerprint"]
            )

    return rows.mapInArrow(run, f"id {id_type}{more}, fingerprint long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links `a`, `b` that connect all fingerprints within `max_bits` of each other.

    `distinct` has a column `fingerprint` without repeats or nulls. Pairs that other
    links connect already may be left out, so a group of n gives at most about
    n links per shard and never all its pairs.
    """
    # So few fingerprints may always share all but max_bits + 1 bits.
    shard_size = max(shard_size, 2 ** (max_bits + 1))
    masks = _bands(0, max_bits + 1)
    rows = distinct.select(
        "fingerprint", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    )
    found = None
    while True:
        rows = rows.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
        large = stored(
            rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard_size)
        )
        kinds = [r["mask"] for r in large.select("mask").distinct().collect()]  # a few masks
        small = rows.join(large, ["mask", "value"], "left_anti") if kinds else rows
        part = (
            small.repartition("mask", "value")
            .sortWithinPartitions("mask", "value")
            .select("mask", "value", "fingerprint")
            .mapInArrow(_tree_links(max_bits), "a long, b long")
        )
        found = part if found is None else found.unionByName(part)
        if not kinds:
            return found
        # At most (max_bits + 1) to the power of the level rows.
        finer = distinct.sparkSession.createDataFrame(
            [(m, b) for m in kinds for b in _bands(m, max_bits + 1)], "mask long, finer long"
        )
        rows = stored(
            rows.join(large.drop("n"), ["mask", "value"])
            .join(F.broadcast(finer), "mask")
            .select("fingerprint", F.col("finer").alias("mask"))
        )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words_each: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """`id`, `fingerprint` (16 hex digits) and `component_id` of every row.

    Fingerprints link when they differ in at most `max_bits` bits. `component_id` is
    the smallest id that links reach, the row's own included; null ids count for
    nothing, so a group of null ids has a null component. Equal rows and equal ids give
    a row each. Texts without words share fingerprint zero and link like any others.
    """
    prints = stored(fingerprints(docs, id_column, text_column, words_each))
    # Read from its own files, so that both sides are shuffled for this join alone and
    # adaptive execution can split a fingerprint that very many rows have.
    classes = stored(_classes(prints, max_bits))
    return prints.join(classes, "fingerprint").select(
        "id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words_each: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of `docs`, one of each group of near duplicates.

    The row with the smallest id stays; null ids come last, and of rows with that id
    the one with the smallest text hash. Of rows equal in id and text one stays.
    """
    text_hash = F.xxhash64(F.col(text_column).cast("string"))
    prints = stored(fingerprints(docs, id_column, text_column, words_each, text_hash))
    # Copies are counted on narrow rows, so that only rows that have some meet as texts.
    copies = prints.groupBy("fingerprint", "id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "n"))
    kept = stored(
        copies.groupBy("fingerprint")
        .agg(first.alias("first"))
        .join(_classes(prints, max_bits).select("fingerprint", "root"), "fingerprint")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(
            F.col("first.id").alias("k_id"), F.col("first.text_hash").alias("k_hash"), F.col("first.n").alias("n")
        )
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_column).alias("r_id"), text_hash.alias("r_hash")
    )

    def those(ids: DataFrame) -> DataFrame:
        # Kept ids and hashes are narrow: hashing them spares a sort of whole texts.
        return rows.join(
            ids.hint("shuffle_hash"),
            F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_hash") == F.col("k_hash")),
            "left_semi",
        )

    single = those(kept.where(F.col("n") == 1))
    several = those(kept.where(F.col("n") > 1)).dropDuplicates(["r_id", "r_hash"])
    return single.unionByName(several).select("row.*")


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """`fingerprint`, `root` (of its component) and `component_id`, a row per fingerprint."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("smallest")))
    joined = components(links(distinct.select("fingerprint"), max_bits)).withColumnRenamed(
        "node", "fingerprint"
    )
    linked = distinct.join(joined, "fingerprint")
    # Stored, so that the join can split a component with very many members.
    lowest = stored(linked.groupBy("root").agg(F.min("smallest").alias("component_id")))
    named = linked.join(lowest, "root").select("fingerprint", "root", "component_id")
    return distinct.join(named, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("root"),
        F.coalesce("component_id", "smallest").alias("component_id"),
    )


def _bands(mask: int, parts: int) -> list[int]:
    """The mask's bits plus one of `parts` equal shares of the other bits, for each share."""
    free = [b for b in range(BITS) if not (mask & 0xFFFF_FFFF_FFFF_FFFF) >> b & 1]
    cuts = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [
        int(np.array(mask, np.int64) | np.array(sum(1 << b for b in free[i:j]), np.uint64).view(np.int64))
        for i, j in zip(cuts, cuts[1:])
    ]


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def batch_of(pairs):
            both = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"]
            )

        for batch in batches:
            mask, value, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            prints = prints.view(np.uint64)
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            starts, pairs = [0, *change.tolist()], []
            for a, b in zip(starts, [*starts[1:], len(prints)]):
                if a == b:
                    continue
                here = (mask[a], value[a])
                if here != key:
                    if len(held) > 1:
                        pairs += forest(held, radius)
                    key, held = here, []
                held += prints[a:b].tolist()
            if pairs:
                yield batch_of(pairs)
        if len(held) > 1 and (pairs := forest(held, radius)):
            yield batch_of(pairs)

    return run
