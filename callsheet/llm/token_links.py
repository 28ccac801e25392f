"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both token sequences of a text spell the same bytes, so each is its array of end
offsets. Diagonal run skipping walks the two arrays: while the ends agree at the
current index shift, probes of doubling width jump the one-to-one stretch; where they
part, the irregular group is resolved end by end up to the next common end, which sets
the new shift. Groups are the stretches between common ends; two tokens are linked if
their byte ranges overlap. Spark counts for every pair of ids the documents that hold
it linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.common import new_folder, with_small_batches
from callsheet.llm.packing import encoder

#: Pairs that may be broadcast, of some 60 bytes each; beyond them the join is shuffled.
BROADCAST_PAIRS = 1_000_000
#: Groups whose text is made at a time.
_CHUNK = 8192
#: Tokens of A whose ends are compared at a time.
_BLOCK = 1 << 16
#: One-to-one tokens that are walked one by one before their stretch is probed; a power of
#: two. Most stretches are short, and a step is cheaper than a probe.
_STEPS = 32


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of tokens of either side up to its end.

    Takes the two arrays of ends, which rise and have the same last end, in blocks that
    end in a common end.
    """
    of_a, of_b, i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
    while i < len(a):
        to, width = min(i + _BLOCK, len(a)) - 1, 64
        while not len(common := _common(a[to : to + width], b)):
            width *= 2
        i_end, j_end = to + int(common[0]) + 1, int(np.searchsorted(b, a[to + common[0]])) + 1
        ends = _numbers(*_runs(a[i:i_end].tolist(), b[j:j_end].tolist()))
        for found, numbers, before in zip((of_a, of_b), ends, (i, j)):
            found.append(numbers + before)
        i, j = i_end, j_end
    return np.concatenate(of_a), np.concatenate(of_b)


def _common(ends: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends)


def _runs(a: list[int], b: list[int]) -> tuple[int, list[int], list[int], list[int]]:
    """The number of groups of a block, and where the index shift changes.

    For each irregular group its number, and the tokens of either side, less one a group,
    up to its end. So a one-to-one token costs a comparison and no entry.
    """
    at, of_a, of_b = [], [], []
    add, add_a, add_b = at.append, of_a.append, of_b.append
    rest_a, rest_b = iter(a), iter(b)
    next_a, next_b = rest_a.__next__, rest_b.__next__
    n, m, group, more_a, more_b, probed = len(a), len(b), 0, 0, 0, _STEPS - 1
    while group + more_a < n:
        for group, (x, y) in enumerate(zip(rest_a, rest_b), group):
            if x != y:
                # An irregular group: up to the next common end, which sets the new shift.
                while x != y:
                    if x < y:
                        x = next_a()
                        more_a += 1
                    else:
                        y = next_b()
                        more_b += 1
                add(group)
                add_a(more_a)
                add_b(more_b)
                probed = group + _STEPS
            elif group == probed:
                break
        group += 1
        if group <= probed:
            break
        # A long one-to-one stretch: probes of doubling width, then of halving width to its end.
        i, j, width, start = group + more_a, group + more_b, _STEPS, group
        while i + width <= n and j + width <= m and a[i : i + width] == b[j : j + width]:
            i, j, width = i + width, j + width, 2 * width
        while width := width // 2:
            if i + width <= n and a[i : i + width] == b[j : j + width]:
                i, j = i + width, j + width
        group = i - more_a
        for rest in (rest_a, rest_b):
            next(islice(rest, group - start, group - start), None)
        probed = group + _STEPS
    return n - more_a, at, of_a, of_b


def _numbers(groups: int, at: list[int], of_a: list[int], of_b: list[int]) -> list[np.ndarray]:
    """For each group the number of tokens of either side up to its end, from :func:`_runs`."""
    stretches = np.diff(np.array([0, *at, groups], np.int64))
    each = np.arange(1, groups + 1)
    return [each + np.repeat(np.array([0, *more], np.int64), stretches) for more in (of_a, of_b)]


def _skip_runs(a: list[int], b: list[int]) -> list[list[int]]:
    """The group ends of a block, as lists."""
    return [numbers.tolist() for numbers in _numbers(*_runs(a, b))]


class GroupText:
    """Writes groups as `a1,a2|b1;a3|b2,b3`: each id with the sign that follows it."""

    def __init__(self, size_a: int, size_b: int):
        signs = ((size_a, ",|"), (size_b, ",;"))
        texts = [[f"{k}{sign}" for sign in two for k in range(size)] for size, two in signs]
        # Texts of one width, filled up with zero bytes that are left out at the end.
        width = max(8, *(len(text[-1]) for text in texts))
        self.a, self.b = (np.array(text, f"S{width}") for text in texts)
        self.size_a, self.size_b = size_a, size_b

    def parts(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[bytes]:
        """The text in parts of a bounded number of groups, each with a `;` at its end."""
        for at in range(0, len(of_a), _CHUNK):
            ends_a, ends_b = of_a[at : at + _CHUNK], of_b[at : at + _CHUNK]
            i, j = (of_a[at - 1], of_b[at - 1]) if at else (0, 0)
            sizes_a, sizes_b = np.diff(ends_a, prepend=i), np.diff(ends_b, prepend=j)
            out = np.empty(ends_a[-1] - i + ends_b[-1] - j, self.a.dtype)
            # A token stands behind all tokens before it, of both sides.
            place_a = np.arange(ends_a[-1] - i) + np.repeat(ends_b - sizes_b - j, sizes_a)
            place_b = np.arange(ends_b[-1] - j) + np.repeat(ends_a - i, sizes_b)
            last_a, last_b = np.zeros(len(place_a), bool), np.zeros(len(place_b), bool)
            last_a[ends_a - i - 1] = last_b[ends_b - j - 1] = True
            out[place_a] = self.a[a[i : ends_a[-1]] + last_a * self.size_a]
            out[place_b] = self.b[b[j : ends_b[-1]] + last_b * self.size_b]
            yield out.tobytes().translate(None, b"\0")


def link_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of all links, in text order.

    The bytes up to each end of either side, from the end before, lie in one token of
    each: a link for every distinct end.
    """
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def byte_level_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file."""
    import tokenizers

    # Byte-level files write a byte as the character of that number if it is printable,
    # else as one of those from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(printable)]
    byte = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(others)}
    tokens = tokenizers.Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(tokens.values()) + 1)
    for token, number in tokens.items():
        table[number] = b"".join(bytes([byte[c]]) if c in byte else c.encode() for c in token)
    return table


def piece_bytes(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    return [
        bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
        for k in range(model.get_piece_size())
        for piece in (model.id_to_piece(k),)
    ]


def n_pieces(path: str) -> int:
    """The number of ids of a sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


class Pair:
    """The two tokenizers in a task: A a byte-level file, B a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.encode_a = encoder(a_path)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a, self.bytes_b = map(pa.array, (byte_level_bytes(a_path), piece_bytes(self.model)))
        self.sizes_a, self.sizes_b = (
            pc.binary_length(table).to_numpy().astype(np.int64) for table in (self.bytes_a, self.bytes_b)
        )

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if one of them does not spell a space and the text."""
        if not text:
            return None
        a = self.encode_a(" " + text).astype(np.int64)
        b = np.array(self.model.encode(text, num_threads=1), np.int64)
        want = pa.py_buffer((" " + text).encode())
        for table, ids in ((self.bytes_a, a), (self.bytes_b, b)):
            spelt = table.take(pa.array(ids)).buffers()[2]
            if spelt is None or not spelt.equals(want):
                return None
        return a, b

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum()


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_groups: bool = False,
) -> DataFrame:
    """Groups and links of every document, one row each.

    Columns: `id`, `n_a`, `n_b`, `n_groups`, `n_links`, `groups_sha256` (of the groups as
    `a1,a2|b1;a3|b2,b3`), `pairs` (distinct linked ids, a * size of B + b, rising), `times`
    (links of each pair), and `groups` (that text) on request. A is encoded with a space
    before the text, as B adds one; strings of special tokens are plain text. A text that
    is null, empty or not spelt by both has no tokens: zeros, empty hash and lists. Every
    row is a document, also equal rows and those that share an id or have none. The paths
    are those on the executors.
    """
    rows = with_small_batches(docs).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    names = "n_a n_b n_groups n_links groups_sha256 pairs times".split() + ["groups"] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(a_path, b_path)
        size_b, written = len(pair.bytes_b), GroupText(len(pair.bytes_a), len(pair.bytes_b))
        empty = (0, 0, 0, 0, "", [], []) + ("",) * with_groups

        def row(text: str | None) -> tuple:
            if not text or (tokens := pair.tokens(text)) is None:
                return empty
            a, b = tokens
            ends_a, ends_b = pair.ends(a, b)
            at_a, at_b = link_places(ends_a, ends_b)
            pairs, times = np.unique(a[at_a] * size_b + b[at_b], return_counts=True)
            of_a, of_b = group_ends(ends_a, ends_b)
            digest, kept, sign = hashlib.sha256(), [], b""
            for part in written.parts(a, b, of_a, of_b):
                digest.update(sign + part[:-1])
                kept += [sign + part[:-1]] * with_groups
                sign = b";"
            found = (len(a), len(b), len(of_a), len(at_a), digest.hexdigest(), pairs, times)
            return found + (b"".join(kept).decode(),) * with_groups

        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            columns = zip(*[row(text) for text in batch.column(1).to_pylist()])
            made = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", *names])

    schema = (
        f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " pairs array<long>, times array<int>" + ", groups string" * with_groups
    )
    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """`pair`, `n` (documents that hold it linked) and `best` (highest n of its id of A)."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # An id of A has no more pairs than B has ids.
    a = Window.partitionBy(F.col("pair") - F.col("pair") % size_b)
    return counted.select("pair", "n", F.max("n").over(a).alias("best"))


def with_counts(
    aligned: DataFrame, size_b: int, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """The rows of `align` with `n_best` and `count_sum` from the counts of all documents.

    `n_best` counts the links whose pair is in as many documents as any pair of its id of
    A, `count_sum` adds up the counts of all links. The rows are written to the shared
    folder first, since the counts need all of them. The counts are broadcast while there
    are at most `broadcast_pairs` of them and joined by a shuffle beyond that.
    """
    spark, path = aligned.sparkSession, new_folder(aligned.sparkSession, "links")
    aligned.withColumn("row_id", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    pair_counts(rows, size_b).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    small = counts.count() <= broadcast_pairs
    each = rows.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row_id", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times")
    )
    found = (
        each.join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
        .groupBy("row_id")
        .agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(found, "row_id", "left").select(
        *[c for c in rows.columns if c not in ("row_id", "pairs", "times")],
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
    )
