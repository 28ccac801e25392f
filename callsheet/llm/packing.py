"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of equal length are interchangeable, so the plan is made from the number of
pieces of each length, at most `max_tokens` numbers however many documents there are.
Lengths are placed from the longest down; a segment tree over the remaining
capacities finds the tightest open sequence in logarithmic time. Sequences with the
same remaining capacity form intervals of sequence numbers, and a run of equal pieces
fills an interval at a time, which gives the packing that placing piece by piece
would. Spark numbers the pieces of each length and looks their places up in the plan.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.common import shipped, stored, with_small_batches

MAX_TOKENS = 2048
END_ID = 0


class Capacities:
    """Segment tree over remaining capacities 0..n: which ones have open sequences."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least `need`."""
        at = need + self.size
        while not self.open[at]:
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[int, ...]]:
    """Runs of equal pieces: length, first rank, first sequence, pieces a sequence, offset.

    The run's k-th piece stands in sequence first + k // pieces, at offset + (k % pieces)
    * length. `counts` has the number of pieces by length, each of 1 to `capacity`. The
    plan has a number of runs bounded by the lengths, whatever the counts.
    """
    tree, groups, runs, used = Capacities(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, n = used, -(-left // (capacity // length))
                used += n
            else:
                first, n = groups[room].pop()
                if not groups[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left:
                # Fewer pieces than fill a sequence are left.
                runs.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            put(room, first + full, rest)
    return runs


def encoder(path: str, special: bool = False):
    """Function from text to ids as the tokenizer file gives them.

    Special strings are text; with `special` they get their own ids, as in the default
    call of tokenizers.

    A byte-level BPE file of the usual kind, without normaliser and with ids in the
    order of its merges, is encoded by tiktoken, which gives the same ids several times
    faster; any other file by tokenizers, as is a text that holds an added token and one
    that tiktoken refuses: its pattern overflows on about a million white-space characters
    in a row.
    """
    held = []

    def slow(text: str) -> np.ndarray:
        if not held:
            import tokenizers

            held.append(tokenizers.Tokenizer.from_file(path))
            held[0].encode_special_tokens = not special
        return np.array(held[0].encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _ranks(spec)
    if ranks is None:
        return slow
    import tiktoken

    # The byte-level pre-tokenizer's own pattern (a fixed value).
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=words, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]

    def encode(text: str) -> np.ndarray:
        if any(token in text for token in added):
            return slow(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        except ValueError:
            return slow(text)

    return encode


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings to ids, if merging by id is what the file says; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
    if not plain or not byte_level or not before.get("use_regex", True) or spec.get("normalizer"):
        return None
    # Byte-level files write a byte as the character of that number if it is printable,
    # else as one of those from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    last = -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        number = vocabulary.get(left + right, -1)
        if number <= last:
            return None
        last = number
    ranks = {
        bytes(byte[c] for c in token): number
        for token, number in vocabulary.items()
        if token not in special
    }
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most `max_tokens` ids of every document, its end id included.

    Columns: `id`, `piece` (from 0), `start` (ids of the document before it), `length`,
    `ids_crc32` (of little-endian unsigned 32-bit ids), and `ids` on request. Null
    texts count as empty, so every row gives at least its end id. A longer document is
    cut so that all pieces but the first are full. `tokenizer` is the file's path on
    the executors; the ids are those of its default call, in which an added token that
    stands in a text, such as `<|endoftext|>`, is one id.
    """
    rows = with_small_batches(docs).select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special=True)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            index, numbers, starts, lengths, sums, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text), end])
                stop = len(ids) % max_tokens or max_tokens
                start = number = 0
                while start < len(ids):
                    part = ids[start:stop]
                    index.append(i)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if with_ids:
                        parts.append(part.astype(np.int32))
                    start, stop, number = stop, stop + max_tokens, number + 1
            columns = [
                batch.column(0).take(pa.array(index, pa.int32())),
                pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: best-fit decreasing over all of them.

    Needs the columns of `pieces`. Pieces of a length are numbered by bucket and within
    the bucket, a bucket being a hash share of all pieces, so no task holds all pieces
    of a frequent length. Equal pieces are in any order.
    """
    cut = stored(cut)
    buckets = 4 * max(cut.rdd.getNumPartitions(), 1)
    order = ["id", "piece", "start", "ids_crc32"]
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = stored(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    before = counts.select(
        "length",
        "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    # One number for each length, at most max_tokens.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_plan(totals, max_tokens)), np.int64).reshape(-1, 5)
    plan = shipped(cut.sparkSession, runs)
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    shift = np.int64(62 - max_tokens.bit_length())

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        runs = plan()
        keys = (runs[:, 0] << shift) + runs[:, 1]
        length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        run = runs[np.searchsorted(keys, (length << shift) + rank, side="right") - 1]
        k = rank - run[:, 1]
        return pd.DataFrame(
            {"sequence_id": run[:, 2] + k // run[:, 3], "offset": run[:, 4] + k % run[:, 3] * length}
        )

    return ranked.select(*cut.columns, place("length", "rank").alias("at")).select(
        *cut.columns, "at.sequence_id", "at.offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id` and the `ids` of each sequence, from packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
