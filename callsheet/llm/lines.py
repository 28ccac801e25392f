"""Line de-duplication: repeated lines stay in one document only.

Method: every document gives one row per distinct long line, with the line's hash.
The rows are range-partitioned by hash and document, so that a hot line spreads over
as many tasks as its rows need, and sorted by hash, document and position. One pass
streams the runs: the first document of a run keeps the line, the others drop it. A
run that touches the edge of its partition may go on in the next one; its rows wait
for the sum of the parts, of which there are at most two a partition. What comes back
is a compressed bitmap per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import stored, with_small_batches

#: What counts as white space at the ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Rows that a task keeps of a line, and texts that it knows again.
_HELD = 10_000
_SEEN = 100_000
MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_key(line: str) -> str:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(BLANK).encode().lower().decode()


def keep_bitmaps(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """One row per distinct (id, text) that loses lines.

    Columns: `id`, `text_hash` (xxhash64 of the text, null texts as empty), `n_lines`,
    `n_dropped`, `keep` (zlib-compressed bitmap, one bit per line, first line in the
    highest bit of the first byte; 1 keeps).

    A line of at least `min_chars` code points whose key occurs in at least
    `min_documents` ids is dropped everywhere but in the largest of those ids. Rows
    that share an id count as one document; a null id is one document, smaller than
    all others. Documents that lose nothing, null and empty texts have no row. Equal
    rows share a bitmap.
    """
    rows = with_small_batches(docs).select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    occurrences = rows.select(
        "id", "text", text_hash(F.col("text")).alias("text_hash")
    ).mapInArrow(
        _occurrences(min_chars),
        f"id {id_type}, text_hash long, n_lines int, positions binary, line_hash binary",
    )
    # Ranges are drawn from a sample of the rows, so the rows are made once and kept.
    dealt = (
        stored(occurrences)
        .repartitionByRange("line_hash", F.col("id").desc())
        .sortWithinPartitions("line_hash", F.col("id").desc(), "text_hash", "positions")
    )
    streamed = stored(
        dealt.mapInArrow(
            _stream(min_documents),
            f"kind string, id {id_type}, text_hash long, n_lines int, positions binary,"
            f" line_hash binary, n_ids long, first_id {id_type}",
        )
    )
    # Equal hash and id stand in one partition, so the parts of a run share no id.
    whole = (
        streamed.where("kind = 'part'")
        .groupBy("line_hash")
        .agg(F.sum("n_ids").alias("n_ids"), F.max("first_id").alias("keeper"))
        .where(F.col("n_ids") >= min_documents)
        .select("line_hash", "keeper")
    )
    late = (
        streamed.where("kind = 'wait'")
        .select("id", "text_hash", "n_lines", "positions", "line_hash")
        # At most two runs a partition touch its edges and few wait with _HELD rows each, so
        # `whole` is small.
        .join(F.broadcast(whole), "line_hash")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .select("id", "text_hash", "n_lines", "positions")
    )
    dropped = streamed.where("kind = 'drop'").select("id", "text_hash", "n_lines", "positions")
    return (
        dropped.unionByName(late)
        .groupBy("id", "text_hash", "n_lines")
        .agg(F.collect_list("positions").alias("positions"))
        .mapInArrow(
            _bitmaps, f"id {id_type}, text_hash long, n_lines int, n_dropped int, keep binary"
        )
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents with the lines that their bitmaps keep.

    Adds `kept_text`, `n_lines` and `n_dropped`. A null or empty text counts as one
    empty line and gives an empty `kept_text`, as does a document that loses every
    line. The columns of `docs` are left as they are; if one has a name of the added
    columns, that is an error.
    """
    clash = {"kept_text", "n_lines", "n_dropped"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kept = with_kept_lines(docs, bitmaps, id_column, text_column)
    return kept.select("row.*", "kept_text", "n_lines", "n_dropped")


def with_kept_lines(
    docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`row` (a struct of all columns), and the columns that `apply_bitmaps` adds."""
    # One struct carries all input columns, so that none can clash with the join's.
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    left = with_small_batches(docs).select(
        F.struct("*").alias("row"), F.col(id_column).alias("l_id"), text_hash(text).alias("l_hash")
    )
    # The bitmaps are the small side; hashing them spares a sort of whole texts.
    joined = left.join(
        bitmaps.select("id", "text_hash", "n_dropped", "keep").hint("shuffle_hash"),
        F.col("l_id").eqNullSafe(F.col("id")) & (F.col("l_hash") == F.col("text_hash")),
        "left",
    ).select("row", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
    # Read from the row each time: a column of its own would send every text twice past Python.
    text = F.coalesce(F.col("row")[text_column].cast("string"), F.lit(""))
    affected = F.col("keep").isNotNull()
    # Only texts that lose a line go through Python.
    kept = _kept()(F.when(affected, text), F.col("keep"))
    return joined.select(
        "row",
        F.when(affected, kept).otherwise(text).alias("kept_text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        .cast("long")
        .alias("n_lines"),
        "n_dropped",
    )


def _occurrences(min_chars: int):
    """One row per document and distinct long line: hash and packed positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            ids, index, lines_of, positions, hashes = batch.column(0), [], [], [], []
            if len(seen) > _SEEN:
                seen.clear()
            keys = zip(ids.to_pylist(), batch.column(2).to_pylist())
            for i, (key, text) in enumerate(zip(keys, batch.column(1).to_pylist())):
                # Equal rows give equal lines; most copies go before the shuffle.
                if key in seen:
                    continue
                seen.add(key)
                lines, found = text.split("\n"), {}
                for at, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line.strip(BLANK)) >= min_chars:
                        digest = xxhash.xxh3_128_digest(key.encode().lower())
                        found.setdefault(digest, []).append(at)
                for digest, places in found.items():
                    index.append(i)
                    lines_of.append(len(lines))
                    positions.append(np.asarray(places, ">u4").tobytes())
                    hashes.append(digest)
            take = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take),
                    batch.column(2).take(take),
                    pa.array(lines_of, pa.int32()),
                    pa.array(positions, pa.binary()),
                    pa.array(hashes, pa.binary()),
                ],
                ["id", "text_hash", "n_lines", "positions", "line_hash"],
            )

    return run


def _stream(min_documents: int):
    """Streams runs of equal hashes; keeps at most _HELD rows, the output and the batch.

    A run that has rows of the largest id and of too few others so far keeps the others'.
    If they become too many, as when rows without an id share a line, it waits for its sum
    like a run at the edge of the partition. Equal rows follow each other and count once.
    """
    names = "kind id text_hash n_lines positions line_hash n_ids first_id".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = out = None
        current, last, count, first_id, last_id = None, None, 0, None, None
        waiting = True  # the first run's first rows may stand in the partition before
        held: list[tuple] = []  # rows of the current run while it has too few ids

        def emit(kind, rows):
            for row in rows:
                out.append((kind, *row, None, None))

        def part():
            out.append(("part", None, None, None, None, current, count, first_id))

        def flush():
            columns = list(zip(*out)) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, schema)], names
            )
            out.clear()
            return batch

        for batch in batches:
            if schema is None:
                types = {f.name: f.type for f in batch.schema}
                schema = [
                    pa.string(), types["id"], pa.int64(), pa.int32(), pa.binary(), pa.binary(),
                    pa.int64(), types["id"],
                ]
                out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row == last:
                    continue
                key, last = row[4], row
                if key != current:
                    if waiting and current is not None:
                        part()
                    waiting = waiting and current is None
                    current, count, first_id, held = key, 0, row[0], []
                if not count or row[0] != last_id:
                    count, last_id = count + 1, row[0]
                if waiting:
                    emit("wait", [row])
                elif row[0] != first_id:
                    held.append(row)
                    if count >= min_documents:
                        emit("drop", held)
                        held = []
                    elif len(held) > _HELD:
                        emit("wait", held)
                        held, waiting = [], True
                if len(out) >= 20_000:
                    yield flush()
        if current is None:
            return
        # The last run may go on in the next partition. What it has dropped is dropped
        # for good, since its first id is the run's first; what it holds back waits.
        emit("wait", held)
        part()
        yield flush()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, bitmaps = [], []
        for n, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            places = np.unique(np.frombuffer(b"".join(parts), ">u4"))
            keep = np.ones(n, bool)
            keep[places] = False
            dropped.append(len(places))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(dropped, pa.int32()), pa.array(bitmaps, pa.binary())],
            ["id", "text_hash", "n_lines", "n_dropped", "keep"],
        )


def kept_lines(text: str, keep: bytes | None) -> str:
    """The lines of a text that a compressed bitmap keeps; no bitmap keeps all."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([line for line, bit in zip(lines, bits) if bit])


def _kept():
    # Arrow arrays, so that no worker needs pandas for it, which takes some 45 MB in each.
    @F.arrow_udf("string")
    def kept(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), keeps.to_pylist())
        return pa.array([kept_lines(t, k) if k is not None else None for t, k in pairs], pa.string())

    return kept
