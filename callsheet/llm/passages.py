"""Substring dedup by repeated-phrase automata: repeated passages stay in one document only.

A window is a fixed number of consecutive words. Windows that may recur are found by
anchors: the least hash of the phrases in a window, of half its length, depends on the
window's words alone, so equal windows have equal anchors, and a text has one anchor in a
dozen words. Anchors that two texts share give the candidates; their windows are counted by
hash, and those of two documents are confirmed. Runs of confirmed windows are passages.

Passages go to shards of a bounded number of windows. For each shard an Aho-Corasick
automaton is compiled from phrases of its passages, taken so that every window holds one.
All candidate stretches of all documents stream through the automaton of their shard, which
locates the phrases; the windows around them are compared word by word with the shard's
passages. A shard whose passages very many documents hold is compiled in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import new_folder, shipped, with_small_batches

WINDOW = 50
#: Confirmed windows of a shard; an automaton takes some 100 MB at most.
SHARD_WINDOWS = 1 << 17
#: Located windows that a task streams for one shard before the shard is given to more.
TASK_WINDOWS = 1 << 20
#: Anchors are dealt into this many buckets, buckets into shards.
_BUCKET_BITS = 20
#: Words whose hashes a task remembers.
_KNOWN = 500_000

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class _Hashes(dict):
    """Words in UTF-8 to 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 to the 64th."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 2 * n
            factors = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            factors[0][0] = factors[1][0] = 1
            self.up, self.down = (np.cumprod(f) for f in factors)
        return self.up[:n], self.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each number stirred, so that their order has nothing to do with the words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of the phrases and windows of a text, and the anchors of its windows."""

    def __init__(self, window: int):
        self.window, self.phrase = window, max(window // 2, 1)
        self.span = window - self.phrase + 1  # phrases in a window
        self.words, self.powers = _Hashes(), [_Powers(base) for base in _ODD]

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def _rolled(self, hashes: np.ndarray, size: int, k: int) -> np.ndarray:
        n = len(hashes)
        up, down = self.powers[k].to(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
        return _mixed((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1])

    def phrases(self, hashes: np.ndarray) -> np.ndarray:
        return self._rolled(hashes, self.phrase, 0)

    def windows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window, of 128 bits together."""
        return self._rolled(hashes, self.window, 0), self._rolled(_mixed(hashes), self.window, 1)

    def anchors(self, phrases: np.ndarray) -> np.ndarray:
        """For each window the place of its anchor, the first phrase of the least hash."""
        seen = np.lib.stride_tricks.sliding_window_view(phrases, self.span)
        return seen.argmin(axis=1) + np.arange(len(seen))


class Shards:
    """Which shard a window belongs to, by the bucket of its anchor.

    Buckets are dealt evenly. One with too many confirmed windows of its own is cut by the
    windows' hashes; `heavy` has these buckets, fewer than there are shards.
    """

    def __init__(self, n: int, heavy: dict[int, int]):
        self.n, self.buckets = n, np.array(sorted(heavy), np.int64)
        self.parts = np.array([heavy[b] for b in sorted(heavy)], np.int64)
        self.first = n + np.concatenate([[0], np.cumsum(self.parts)[:-1]]).astype(np.int64)

    def of(self, buckets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        shards = buckets * self.n >> _BUCKET_BITS
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
            part = (hashes % self.parts[at].astype(np.uint64)).astype(np.int64)
            shards = np.where(self.buckets[at] == buckets, self.first[at] + part, shards)
        return shards


def _bucket(anchors: np.ndarray) -> np.ndarray:
    # Not the leading bits: anchors are least hashes.
    return (_mixed(anchors) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


class Automaton:
    """Aho-Corasick automaton over the words of a shard's passages, with their windows.

    A word is one character of the automaton's own alphabet, any other word is the
    character 0.
    """

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.phrase = window, max(window // 2, 1)
        self.letters: dict[bytes, str] = {}
        self.first: dict[str, object] = {}
        self.phrases = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        self.ready = False

    def add(self, words: list[bytes], firsts: list) -> None:
        """A passage and, for each of its windows, the smallest document that has it."""
        letters = self.letters
        for word in words:
            if word not in letters:
                code = len(letters) + 1
                letters[word] = chr(code if code < 0xD800 else code + 0x800)
        text = "".join(map(letters.__getitem__, words))
        for at, first in enumerate(firsts):
            self.first[text[at : at + self.window]] = first
        # Of as many successive places as a window has phrases, one is a multiple of that.
        for at in range(0, len(words) - self.phrase + 1, self.window - self.phrase + 1):
            self.phrases.add_word(text[at : at + self.phrase])

    def located(self, words: list[bytes]) -> Iterator[tuple[int, object]]:
        """Places of the windows that stand in a passage, rising, and their smallest documents."""
        if not self.ready:
            self.phrases.make_automaton()
            self.ready = True
        if not self.first:
            return
        text = "".join([self.letters.get(word, "\0") for word in words])
        window, after = self.window, 0
        for last, _ in self.phrases.iter(text):
            start = last + 1 - self.phrase
            for at in range(max(after, last + 1 - window), min(start, len(text) - window) + 1):
                first = self.first.get(text[at : at + window])
                if first is not None:
                    yield at, first
            after = max(after, start + 1)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`id`, `text` (null as empty) and `d1`, `d2`, 128 bits that stand for the text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), text.alias("text"), *_digests(text))


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Written to the shared folder and read back: sizes are known, lost executors cost nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[f"r_{name}"])
    return found


def _right(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({name: f"r_{name}" for name in names})


def repeated_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    shard_windows: int = SHARD_WINDOWS,
    task_windows: int = TASK_WINDOWS,
) -> DataFrame:
    """The spans that documents lose: one row per distinct id and text that loses words.

    Columns: `id`, `d1`, `d2` (hashes of the text), `whole`, and `spans`, structs of `start`
    and `end` in words, which may overlap. A word goes if it stands in a window of `window`
    words that a smaller id has as well. Rows that share an id are one document, so they
    keep what only they share; a null id is larger than all others. Words are what stands
    between characters of `[\\x20\\x09-\\x0D]`; null and empty texts have none. A text that
    a smaller id has in full goes as a `whole` if it has a window.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "passages")
    texts = _keyed(with_small_batches(docs), id_column, text_column)
    id_type = texts.schema["id"].dataType.simpleString()
    key = ["d1", "d2"]

    # Equal texts are one text of the smallest id.
    copies = _kept(
        texts.groupBy(*key).agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("known"), F.count("*").alias("n")
        ),
        f"{folder}/copies",
    )
    anchors = _kept(
        texts.select("text", *key).mapInArrow(_anchors(window), "d1 long, d2 long, anchor long, place int"),
        f"{folder}/anchors",
    )
    shared = _kept(
        anchors.groupBy("anchor")
        .agg(*[f(c).alias(f"{f.__name__}_{c}") for c in key for f in (F.min, F.max)])
        .where("min_d1 <> max_d1 OR min_d2 <> max_d2")
        .select(F.col("anchor").alias("r_anchor")),
        f"{folder}/shared",
    )
    places = (
        anchors.join(shared, _same(anchors, shared, "anchor"))
        .groupBy(*key)
        .agg(F.collect_set("place").alias("places"))
        .join(copies.select(*key, "first"), key)
    )
    places = _right(_kept(places, f"{folder}/places"), *key)
    candidates = _kept(
        texts.join(places, _same(texts, places, *key) & texts["id"].eqNullSafe(places["first"]))
        .select("id", *key, "text", "places")
        .withColumn("row_id", F.monotonically_increasing_id()),
        f"{folder}/candidates",
    )

    counted = (
        with_small_batches(candidates.select("id", "row_id", "text", "places"))
        .mapInArrow(_windows(window), f"h1 long, h2 long, bucket int, id {id_type}, row_id long")
        .groupBy("h1", "h2", "bucket")
        .agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("known"),
            F.count("*").alias("n"), F.min("row_id").alias("r_row_id"),
        )
    )
    confirmed = _kept(
        counted.where("last > first OR known < n AND known > 0").select("h1", "h2", "bucket", "first", "r_row_id"),
        f"{folder}/confirmed",
    )
    n_shards = max(-(-confirmed.count() // shard_windows), 1)
    crowded = confirmed.groupBy("bucket").count().where(F.col("count") > shard_windows).collect()
    shards = Shards(n_shards, {r["bucket"]: -(-r["count"] // shard_windows) for r in crowded})

    of_text = confirmed.groupBy("r_row_id").agg(F.collect_list(F.struct("h1", "h2", "first")).alias("confirmed"))
    of_text = _kept(of_text, f"{folder}/of_text")
    pieces = candidates.join(of_text, _same(candidates, of_text, "row_id"), "left").select(
        "id", "row_id", "text", "places", "confirmed"
    )
    pieces = with_small_batches(pieces).mapInArrow(
        _pieces(window, shipped(spark, shards)),
        f"shard long, kind int, words binary, firsts array<{id_type}>, id {id_type}, row_id long, start int, load long",
    )
    pieces = _kept(pieces, f"{folder}/pieces")
    # A shard that is streamed very often is compiled by several tasks.
    tasks = (
        pieces.groupBy("shard").agg(F.ceil(F.sum("load") / task_windows).cast("int").alias("tasks"))
        .select(F.col("shard").alias("r_shard"), F.greatest("tasks", F.lit(1)).alias("tasks"))
    )
    own = F.array(F.pmod(F.xxhash64("row_id", "start"), F.col("tasks")).cast("int"))
    task = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(own)
    streamed = (
        pieces.join(tasks, _same(pieces, tasks, "shard"))
        .select("shard", F.explode(task).alias("task"), "kind", "words", "firsts", "id", "row_id", "start")
        .repartition("shard", "task")
        .sortWithinPartitions("shard", "task", "kind")
    )
    located = _right(
        with_small_batches(streamed).mapInArrow(_located(window), "row_id long, start int, end int"), "row_id"
    )
    names = candidates.select("id", *key, "row_id")
    spans = (
        names.join(located, _same(names, located, "row_id"))
        .groupBy("id", *key)
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )
    # The other ids of a text lose all of it.
    several = _right(copies.where("last > first OR known < n AND known > 0"), *key)
    gone = (
        texts.select("id", *key)
        .join(several, _same(texts, several, *key))
        .where("id IS NULL OR id > first")
        .select("id", *key)
        .distinct()
    )
    found = spans.select("id", *key, F.lit(False).alias("whole"), "spans").unionByName(
        gone.select("id", *key, F.lit(True).alias("whole")), allowMissingColumns=True
    )
    return _kept(found, f"{folder}/spans")


def without_spans(
    docs: DataFrame,
    spans: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """`row` (a struct of all columns), `n_words`, `n_removed` and `kept_text`.

    The kept text has the words that stay, joined by one space. `spans` are those of
    `repeated_spans` for the same documents and window.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = with_small_batches(docs).select(
        F.struct("*").alias("row"), F.col(id_column).alias("id"), text.alias("text"), *_digests(text)
    )
    other = _right(spans, "id", "d1", "d2")
    joined = keyed.join(other, _same(keyed, other, "id", "d1", "d2"), "left")
    cut = _cut(window)("text", "whole", "spans.start", "spans.end")
    return joined.select("row", cut.alias("cut")).select("row", "cut.*")


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    for k, text in enumerate(batch.column(column).to_pylist()):
        yield k, text.encode().split()


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window)
        for batch in batches:
            index, hashes, places = [], [], []
            for k, words in _texts(batch, 0):
                if len(words) < window:
                    continue
                phrases = hasher.phrases(hasher.hashed(words))
                found = np.unique(hasher.anchors(phrases))
                index.append(np.full(len(found), k, np.int32))
                hashes.append(phrases[found].view(np.int64))
                places.append(found.astype(np.int32))
            if index:
                take = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(take), batch.column(2).take(take),
                     pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))],
                    ["d1", "d2", "anchor", "place"],
                )

    return run


def _candidates(hasher: Hasher, words: list[bytes], places: list[int]) -> tuple[np.ndarray, ...]:
    """Windows whose anchor is shared: their places, two hashes each, and buckets."""
    hashes = hasher.hashed(words)
    phrases = hasher.phrases(hashes)
    anchors = hasher.anchors(phrases)
    found = np.flatnonzero(np.isin(anchors, np.array(places, np.int64)))
    h1, h2 = hasher.windows(hashes)
    return found, h1[found], h2[found], _bucket(phrases[anchors[found]])


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window)
        for batch in batches:
            shared = batch.column(3).to_pylist()
            for k, words in _texts(batch, 2):
                found, h1, h2, buckets = _candidates(hasher, words, shared[k])
                take = pa.array(np.full(len(found), k, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(buckets.astype(np.int32)),
                     batch.column(0).take(take), batch.column(1).take(take)],
                    ["h1", "h2", "bucket", "id", "row_id"],
                )

    return run


def _pieces(window: int, shards):
    """Passages (kind 0) and candidate stretches (kind 1) of each text, by shard."""

    def by_shard(places: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero((np.diff(of[order]) != 0) | (np.diff(places[order]) != 1)) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(of[part[0]]), part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dealt = Hasher(window), shards()
        for batch in batches:
            kind = batch.schema.field("id").type
            ids, numbers, _, shared, confirmed = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for k, words in _texts(batch, 2):
                found, h1, h2, buckets = _candidates(hasher, words, shared[k])
                of = dealt.of(buckets, h1)
                for shard, part in by_shard(found, of):
                    lo, hi = found[part[0]], found[part[-1]] + window
                    out.append((shard, 1, b" ".join(words[lo:hi]), None, ids[k], numbers[k], lo, len(part)))
                if not confirmed[k]:
                    continue
                firsts = {(x["h1"], x["h2"]): x["first"] for x in confirmed[k]}
                # Each window once, where it first stands.
                taken, own = [], []
                for at, pair in enumerate(zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist())):
                    if pair in firsts:
                        taken.append(at)
                        own.append(firsts.pop(pair))
                taken = np.array(taken, np.int64)
                for shard, part in by_shard(found[taken], of[taken]):
                    lo, hi = found[taken[part[0]]], found[taken[part[-1]]] + window
                    out.append((shard, 0, b" ".join(words[lo:hi]), [own[x] for x in part], None, None, lo, 0))
            names = "shard kind words firsts id row_id start load".split()
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(kind), kind, pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def _located(window: int):
    """Spans of the windows that a smaller document has; holds one automaton at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, automaton = None, None
        for batch in batches:
            out: list[tuple] = []
            for shard, task, kind, words, firsts, doc, number, start in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, task) != cell:
                    cell, automaton = (shard, task), Automaton(window)
                if kind == 0:
                    automaton.add(words.split(b" "), firsts)
                    continue
                lo = hi = None
                for at, first in automaton.located(words.split(b" ")):
                    if doc is not None and not first < doc:
                        continue
                    if hi is not None and at <= hi:
                        hi = at + window
                        continue
                    if hi is not None:
                        out.append((number, start + lo, start + hi))
                    lo, hi = at, at + window
                if hi is not None:
                    out.append((number, start + lo, start + hi))
            columns = list(zip(*out)) or [()] * 3
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["row_id", "start", "end"]
            )

    return run


def kept_words(words: list[bytes], whole: bool, starts, ends, window: int = WINDOW) -> list[bytes]:
    """The words outside of the spans; none if the whole text goes and has a window."""
    if whole:
        return [] if len(words) >= window else words
    if starts is None:
        return words
    keep = np.ones(len(words), bool)
    for start, end in zip(starts, ends):
        keep[start:end] = False
    return [words[k] for k in np.flatnonzero(keep)]


def _cut(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, wholes: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, whole, start, end in zip(texts, wholes, starts, ends):
            words = text.encode().split()
            kept = kept_words(words, whole is not None and bool(whole), start, end, window)
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    return cut
