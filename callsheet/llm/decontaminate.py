"""Benchmark decontamination with a generalised suffix automaton.

One automaton holds the normalised words of all test items. Tasks stream the words of
a document through it and track the longest suffix that occurs in some item: where
that is at least a window long, the window's words are hit. Items shorter than a
window count as a window of their own. Items go to blocks of a bounded number of words.
One task builds the automaton of a block and writes its arrays to the shared folder,
where all tasks find it; the documents are read once, whatever the number of blocks.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.common import new_folder, shipped, stored, with_small_batches
from callsheet.llm.warc import _open

WINDOW = 10
#: Words of the items in one automaton; its arrays take some 60 bytes a word, its building 400.
BLOCK_WORDS = 1_000_000
#: Bytes of automata that a task holds at a time, but for one that is larger.
HELD_BYTES = 256 << 20
#: Bytes of texts that meet one automaton after the other, if not all can be held.
TEXT_BYTES = 32 << 20
#: For `remove_spans`: a document with a larger share of hit words goes.
MAX_COVERAGE = 0.5

#: Bytes to lower case if they belong to words, else to a blank. Bytes from 0x80 belong
#: to characters that are word characters, all of them.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of ASCII letters, digits and all other than ASCII characters."""
    return (text or "").encode().translate(_TABLE).split()


class Block:
    """Names and words of a block's items, read from the files that hold them."""

    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files

    def __iter__(self) -> Iterator[tuple[str, list[bytes]]]:
        system, root = _open(self.folder)
        for file in self.files:
            with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                rows = pa.ipc.open_stream(stream).read_all()
            for name, words in zip(rows["name"].to_pylist(), rows["words"].to_pylist()):
                yield name, words.split()


class _Building:
    """A suffix automaton that grows word by word, words being numbers.

    Nearly all states have one way on, which two arrays hold; `more` has the others.
    """

    def __init__(self):
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def step(self, state: int, word: int) -> int:
        """The state after a word, -1 if there is none."""
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(word, -1)

    def _put(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _new(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def extend(self, last: int, word: int) -> int:
        length, link = self.length, self.link
        q = self.step(last, word)
        if q >= 0:
            # Another item has been here: only a state of its own may be missing.
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = self._new(length[last] + 1, 0)
        p = last
        while p != -1 and (q := self.step(p, word)) < 0:
            self._put(p, word, new)
            p = link[p]
        if p != -1:
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p != -1 and self.step(p, word) == q:
            self._put(p, word, clone)
            p = self.link[p]
        return clone

    def transitions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each state's transitions start, their words in order, their targets."""
        word = np.frombuffer(self.word, np.int32)
        states = [np.flatnonzero(word >= 0).astype(np.int32)]
        words, to = [word[states[0]]], [np.frombuffer(self.to, np.int32)[states[0]]]
        owners, also, targets = array("i"), array("i"), array("i")
        for state, more in self.more.items():
            owners.extend([state] * len(more))
            also.extend(more.keys())
            targets.extend(more.values())
        for lists, numbers in ((states, owners), (words, also), (to, targets)):
            lists.append(np.array(numbers, np.int32))
        state, word = np.concatenate(states), np.concatenate(words)
        order = np.lexsort((word, state))
        starts = np.zeros(len(self.link) + 1, np.int32)
        np.cumsum(np.bincount(state, minlength=len(self.link)), out=starts[1:])
        return starts, word[order], np.concatenate(to)[order]


def _grouped(keys: Iterable[int], *values: Iterable[int]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, where their values start, the values (distinct rows)."""
    rows = np.array([keys, *values], np.int32).reshape(1 + len(values), -1).T
    rows = np.unique(rows, axis=0) if len(rows) else rows
    distinct, at = np.unique(rows[:, 0], return_index=True)
    return distinct, np.append(at, len(rows)).astype(np.int32), *rows[:, 1:].T.copy()


def arrays_of(items: Iterable[tuple[str, list[bytes]]], window: int) -> dict[str, np.ndarray | pa.Array]:
    """The automaton of the items (name, words) as flat arrays, see `Automaton`."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    sequences: list[tuple[int, array]] = []
    for name, words in items:
        numbers = array("i", [vocabulary.setdefault(w, len(vocabulary)) for w in words])
        sequences.append((names.setdefault(name, len(names)), numbers))
    made = _Building()
    for _, words in sequences:
        last = 0
        for word in words:
            last = made.extend(last, word)
    short: tuple[list[int], list[int], list[int]] = ([], [], [])  # states, lengths, names
    for name, words in sequences:
        if 0 < len(words) < window:
            state = 0
            for word in words:
                state = made.step(state, word)
            for values, value in zip(short, (state, len(words), name)):
                values.append(value)
    short_state, short_starts, short_size, short_name = _grouped(*short)
    group_of = {state: k for k, state in enumerate(short_state.tolist())}
    # For each state the one of its suffix of window length, and the next short item up.
    link, length = made.link, made.length
    above = np.full(len(link), -1, np.int32)
    short_at = np.full(len(link), -1, np.int32)
    short_up = np.full(len(short_state), -1, np.int32)
    above_, short_at_ = memoryview(above), memoryview(short_at)
    for state in np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist():
        up = link[state]
        if length[state] >= window:
            above_[state] = state if up < 0 or length[up] < window else above_[up]
        if up >= 0:
            short_at_[state] = short_at_[up]
        if state in group_of:
            short_up[group_of[state]] = short_at_[state]
            short_at_[state] = group_of[state]
    pairs: tuple[array, array] = (array("i"), array("i"))  # states of windows, names
    for name, words in sequences:
        state = 0
        for at, word in enumerate(words, 1):
            state = made.step(state, word)
            if at >= window:
                pairs[0].append(above_[state])
                pairs[1].append(name)
    held, item_starts, item_name = _grouped(*pairs)
    window_at = np.where(above >= 0, np.searchsorted(held, above), -1).astype(np.int32)
    starts, word, to = made.transitions()
    return {
        "starts": starts, "word": word, "to": to,
        "link": np.array(link, np.int32), "length": np.array(length, np.int32),
        "window_at": window_at, "item_starts": item_starts, "item_name": item_name,
        "short_at": short_at, "short_up": short_up, "short_starts": short_starts,
        "short_size": short_size, "short_name": short_name,
        "words": pa.array(list(vocabulary), pa.binary()), "names": pa.array(list(names), pa.string()),
    }


def _write_arrays(arrays: dict[str, np.ndarray | pa.Array], folder: str) -> str:
    """Writes the arrays, each as a table of its own; the name of the file."""
    system, root = _open(folder)
    file = f"{uuid.uuid4().hex}.automaton"
    with system.open_output_stream(f"{root}/{file}", compression=None) as out:
        for name, values in arrays.items():
            batch = pa.RecordBatch.from_arrays([pa.array(values)], [name])
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
    return file


def _read_arrays(folder: str, file: str) -> dict[str, np.ndarray | pa.Array]:
    """The arrays of a file; from a local folder they are mapped into memory."""
    system, root = _open(folder)
    local = isinstance(system, fs.LocalFileSystem)
    with pa.memory_map(f"{root}/{file}") if local else system.open_input_file(f"{root}/{file}") as source:
        arrays = {}
        while source.tell() < source.size():
            batch = pa.ipc.open_stream(source).read_next_batch()
            # The reader stops before the end mark, 8 bytes.
            source.seek(source.tell() + 8)
            values = batch.column(0)
            arrays[batch.schema.names[0]] = values.to_numpy() if pa.types.is_int32(values.type) else values
        return arrays


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window.

    States are numbers, 0 the empty sequence; words are numbers too, so that a state's
    transitions are a stretch of `word` in order, with their targets in `to`. The arrays
    are read from `file`, or made from the items, when they are first used: it travels
    as a name or as its items.
    """

    def __init__(
        self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW, file: str | None = None
    ):
        self.source, self.window, self.file = items, window, file
        self.size = 0  # bytes in memory
        self.number: dict[bytes, int] | None = None

    def __reduce__(self):
        return type(self), (self.source, self.window, self.file)

    def load(self) -> None:
        if self.number is not None:
            return
        arrays = (
            arrays_of(self.source, self.window)
            if self.file is None
            else _read_arrays(self.source.folder, self.file)
        )
        words = arrays.pop("words")
        self.names = arrays.pop("names")
        # Views give plain numbers, several times faster than elements of arrays.
        self.view = {name: memoryview(values) for name, values in arrays.items()}
        self.size = sum(v.nbytes for v in arrays.values()) + 120 * len(words) + self.names.nbytes
        self.number = {w: n for n, w in enumerate(words.to_pylist())}

    def drop(self) -> None:
        """Frees the arrays until the next use."""
        self.number = self.names = self.view = None
        self.size = 0

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest suffix that occurs."""
        self.load()
        starts, follows, to, link, lengths = (
            self.view[name] for name in ("starts", "word", "to", "link", "length")
        )
        state = length = 0
        for word in map(self.number.get, words):
            if word is None:
                state = length = 0
                yield 0, 0
                continue
            while state:
                at, end = starts[state], starts[state + 1]
                if end - at > 1:
                    at = bisect_left(follows, word, at, end)
                if at < end and follows[at] == word:
                    break
                state = link[state]
                length = lengths[state]
            else:
                at = word  # every word leads on from state 0, in order
            state, length = to[at], length + 1
            yield state, length

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (start, end), disjoint and in order, and the items found."""
        self.load()
        window, view = self.window, self.view
        window_at, short_at, short_up = view["window_at"], view["short_at"], view["short_up"]
        short_starts, short_size, short_name = view["short_starts"], view["short_size"], view["short_name"]
        has_short = len(short_up) > 0
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        names: set[int] = set()
        for at, (state, length) in enumerate(self.walk(words), 1):
            start = at
            if length >= window:
                windows.add(window_at[state])
                start = at - window
            if has_short and length:
                up = short_at[state]
                while up >= 0:
                    for k in range(short_starts[up], short_starts[up + 1]):
                        if short_size[k] <= length:
                            names.add(short_name[k])
                            start = min(start, at - short_size[k])
                    up = short_up[up]
            if start < at:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        item_starts, item_name = view["item_starts"], view["item_name"]
        for k in windows:
            names.update(item_name[item_starts[k] : item_starts[k + 1]])
        return spans, {self.names[n].as_py() for n in names}


class Blocks:
    """The automata of all blocks; a task holds as many of them as HELD_BYTES allow."""

    def __init__(self, blocks: Iterable[Automaton]):
        self.blocks = list(blocks) or [Automaton([])]

    def match(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text the number of its words, its hit spans and the items found in any block."""
        found: list[tuple[int, list[tuple[int, int]], set[str]]] = [(0, [], set())] * len(texts)
        for automaton in self.blocks:
            for k, text in enumerate(texts):
                words = words_of(text)
                here, items = automaton.match(words)
                _, spans, names = found[k]
                found[k] = (len(words), _union(spans + here) if spans else here, names | items)
            # The first ones stay, so that those that fit are read once.
            if sum(a.size for a in self.blocks) > HELD_BYTES and len(self.blocks) > 1:
                automaton.drop()
        return found

    def stretches(self, batches: Iterable[pd.Series]) -> Iterator[list[list[str | None]]]:
        """The batches, several together where they meet automata that are read anew."""
        together: list[list[str | None]] = []
        size = 0
        for batch in batches:
            together.append(batch.tolist())
            size += sum(len(text) for text in together[-1] if text)
            if all(a.size for a in self.blocks) or len(self.blocks) < 2 or size > TEXT_BYTES:
                yield together
                together, size = [], 0
        if together:
            yield together


def automata(
    items: DataFrame,
    id_column: str = "item_id",
    text_column: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> Iterator[Automaton]:
    """Automata of blocks of items, each of about `block_words` words at most.

    Items go to blocks by running word counts, worked out by Spark; an item of more
    words than an eighth of a block is cut into parts that overlap by a window less one
    word. Null texts have no words, a null id stands for the empty string. A task writes
    a block's words and its automaton to files in the shared folder; the driver gets
    their names.
    """
    spark = items.sparkSession
    folder = new_folder(spark, "benchmark")
    _open(folder)  # fails before the job if no task could
    # A block takes the parts that start within a stretch of `block_words` less one part.
    most = max(block_words // 8, window)
    stretch = max(block_words - most, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0  # words of the partition so far
        for batch in batches:
            index, starts, parts, sizes = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), most):
                    part = words[at : at + most + window - 1]
                    index.append(i)
                    starts.append(before)
                    parts.append(b" ".join(part))
                    sizes.append(len(part))
                    before += len(part)
            take = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(parts, pa.binary()),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                ["part", "name", "words", "start", "size"],
            )

    def build(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        # A task that runs again writes files of other names.
        system, root = _open(folder)
        file = f"{uuid.uuid4().hex}.arrow"
        with system.open_output_stream(f"{root}/{file}", compression=None) as out:
            with pa.ipc.new_stream(out, rows.schema) as stream:
                stream.write_table(rows)
        built = _write_arrays(arrays_of(Block(folder, [file]), window), folder)
        return pa.table({"block": [key[0].as_py()], "file": [file], "built": [built]})

    parts = stored(
        with_small_batches(items)
        .select(
            F.spark_partition_id().alias("part"),
            F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"),
            F.col(text_column).cast("string").alias("text"),
        )
        .mapInArrow(cut, "part int, name string, words binary, start long, size long")
    )
    # One row a partition.
    totals = parts.groupBy("part").agg(F.sum("size").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    block = F.floor((F.col("ahead") + F.col("start")) / F.lit(stretch)).cast("long")
    numbered = parts.join(F.broadcast(ahead), "part").select(block.alias("block"), "name", "words")
    files = numbered.groupBy("block").applyInArrow(build, "block long, file string, built string").collect()
    for row in sorted(files, key=lambda row: row["block"]):
        yield Automaton(Block(folder, [row["file"]]), window, row["built"])


def hits(
    docs: DataFrame,
    blocks: Iterable[Automaton],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`row` (a struct of all columns), `n_words`, `spans` and `items` of every document.

    `spans` lists start, end, start, end ... of the disjoint runs of hit words; `items`
    the ids, sorted as strings, of the items with a window in the document. A null text
    has no words. The documents are read once and nothing is shuffled, whatever the
    number of blocks.
    """
    docs = with_small_batches(docs)
    found = _find(docs, list(blocks))(F.col(text_column).cast("string"))
    return docs.select(F.struct("*").alias("row"), found.alias("found")).select("row", "found.*")


def n_hit(spans: Column) -> Column:
    """The number of words in `spans` of `hits`."""
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")),
        lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")),
        lambda a: a["n"],
    )


def remove_spans(
    docs: DataFrame,
    blocks: list[Automaton],
    id_column: str = "doc_id",
    text_column: str = "text",
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """The documents as `row` with `clean_text`, without the words that hit test items.

    A span is cut from its first word to its last; what then stands together is looked
    at again. A document of which more than `max_coverage` of the words are hit goes,
    as does one of whose words none is left. All others stay, those without words and
    null texts included.
    """
    found = hits(docs, blocks, id_column, text_column)
    share = n_hit(F.col("spans")) / F.greatest("n_words", F.lit(1))
    shared = shipped(docs.sparkSession, Blocks(blocks))  # names of files

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        texts = [t if t is None else cut_spans(t, s) for t, s in zip(texts.tolist(), spans.tolist())]
        # What a cut has brought together is looked at again.
        active = [k for k, t in enumerate(texts) if t]
        while active:
            found = shared().match([texts[k] for k in active])
            active = [k for k, (_, spans, _) in zip(active, found) if spans and _replace(texts, k, spans)]
        return pd.Series(texts, dtype=object)

    cut = cut.asNondeterministic()  # called once, although its result is filtered
    text = F.col("row")[text_column].cast("string")
    hit = F.size("spans") > 0
    return (
        found.where(share <= max_coverage)
        .select("row", "n_words", hit.alias("hit"), cut(F.when(hit, text), F.when(hit, F.col("spans"))).alias("cut"))
        .withColumn("clean_text", F.when(F.col("hit"), F.col("cut")).otherwise(text))
        .where(~F.col("hit") | F.col("clean_text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
        .select("row", "clean_text")
    )


def _replace(texts: list[str], k: int, spans: list[tuple[int, int]]) -> str:
    texts[k] = cut_spans(texts[k], [x for span in spans for x in span])
    return texts[k]


def cut_spans(text: str, spans: Iterable[int]) -> str:
    """The text without the words of the spans: start, end, start, end ..., in order."""
    raw = text.encode()
    flat = raw.translate(_TABLE)
    starts, ends, at = [], [], 0
    for word in flat.split():
        at = flat.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    keep, at = bytearray(), 0
    bounds = iter(spans)
    for first, last in zip(bounds, bounds):
        keep += raw[at : starts[first]]
        at = ends[last - 1]
    return (keep + raw[at:]).decode()


def without_spans(text: str, automaton: Automaton) -> str:
    """The text without its hit words, until no window is left."""
    while spans := automaton.match(words_of(text))[0]:
        text = cut_spans(text, [x for span in spans for x in span])
    return text


def _find(docs: DataFrame, blocks: list[Automaton]):
    shared = shipped(docs.sparkSession, Blocks(blocks))  # names of files

    @F.pandas_udf("n_words long, spans array<int>, items array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for together in shared().stretches(batches):
            found = iter(shared().match([text for texts in together for text in texts]))
            for texts in together:
                rows = [next(found) for _ in texts]
                yield pd.DataFrame(
                    [(n, [x for s in spans for x in s], sorted(names)) for n, spans, names in rows],
                    columns=["n_words", "spans", "items"],
                )

    # So that Spark does not copy the call into a filter on its result.
    return find.asNondeterministic()


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged
