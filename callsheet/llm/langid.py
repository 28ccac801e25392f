"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every task turns texts into sparse counts of hashed n-grams with numpy. Training sums
them by language and bucket in a Spark aggregation over all training rows; the
log-probabilities of the few languages travel to all tasks as one matrix of bounded
size, and a batch of texts is scored by adding the matrix rows of its n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import shipped, with_small_batches

ORDERS = (1, 2, 3)
MAX_BUCKETS = 1 << 15
#: Bytes of the log-probability matrix. With many languages it has fewer buckets.
MATRIX_BYTES = 32 << 20
UNKNOWN = "und"
#: Letters, and numbers other than decimal digits.
_WORD_CHARACTER = re.compile(r"[^\W\d_]")
#: Characters whose n-grams are held at a time.
_STEP = 1 << 18
#: Log-probabilities that are held at a time.
_CELLS = 1 << 22


class Model:
    """Languages, `log_prior` and `log_prob` (bucket by language)."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_prob: np.ndarray, orders):
        self.languages, self.log_prior, self.log_prob = languages, log_prior, log_prob
        self.orders = tuple(orders)

    @property
    def buckets(self) -> int:
        return len(self.log_prob)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability.

        The n-grams of many texts are one sparse matrix: a row of bucket numbers per text,
        multiplied with the log-probabilities a stretch at a time.
        """
        known = [k for k, t in enumerate(texts) if self.languages and t is not None and has_letter(t)]
        log = np.tile(self.log_prior, (len(known), 1))
        step = max(_CELLS // (max(len(self.languages), 1) * len(self.orders)), 1)
        for found, owners in ngrams([texts[k] for k in known], self.buckets, self.orders, min(step, _STEP)):
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            log[owners[starts]] += np.add.reduceat(self.log_prob[found], starts, axis=0)
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k, row in zip(known, log):
            best = int(np.argmax(row))
            languages[k] = self.languages[best]
            scores[k] = float(1 / np.exp(row - row[best]).sum())
        return languages, scores


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; digits of any kind, as in `²`, are none."""
    return any(found[0].isalpha() for found in _WORD_CHARACTER.finditer(text))


def ngrams(
    texts: list[str], buckets: int, orders=ORDERS, step: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of all n-grams with the numbers of their texts, rising, in parts.

    Texts are lower-cased and framed by blanks. A part has the n-grams of one order that
    start in `step` successive characters of the texts, of which a long one is read in
    overlapping pieces, so the memory in use does not grow with the texts.
    """
    step, longest = step or _STEP, max(orders)
    pieces: list[tuple[int, str, int]] = []  # text, characters, how many n-grams may start
    held = 0
    for owner, text in enumerate(texts):
        framed = f" {text.lower()} "
        for at in range(0, len(framed), step):
            piece = framed[at : at + step + longest - 1]
            pieces.append((owner, piece, min(step, len(piece))))
            held += len(piece)
            if held >= step:
                yield from _hashed(pieces, buckets, orders)
                pieces, held = [], 0
    if pieces:
        yield from _hashed(pieces, buckets, orders)


def _hashed(pieces: list[tuple[int, str, int]], buckets: int, orders) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(piece) for _, piece, _ in pieces])
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owners = np.repeat([owner for owner, _, _ in pieces], sizes)
    # The characters from each place to the end of its piece, and whether n-grams start there.
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    starts = left > np.repeat(sizes - [n for _, _, n in pieces], sizes)
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        # Built on the n-grams that are one character shorter.
        size = len(codes) - n + 1
        if size <= 0:
            break
        hashed = (hashed[:size] * np.uint64(0x100000001B3)) ^ codes[n - 1 :]
        if n in orders:
            within = starts[:size] & (left[:size] >= n)
            if within.any():
                mixed = (hashed[within] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                yield (mixed >> np.uint64(40)).astype(np.int64) % buckets, owners[:size][within]


def ngram_counts(text: str, buckets: int, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets that the text's n-grams fall into, with counts, over the whole text."""
    total = np.zeros(buckets, np.int64)
    for found, _ in ngrams([text], buckets, orders):
        total += np.bincount(found, minlength=buckets)
    found = np.flatnonzero(total)
    return found, total[found].astype(np.float64)


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows of the held-out fold: CRC-32 of the id as text, modulo the folds. Null ids are not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(
    docs: DataFrame,
    text_column: str = "text",
    language_column: str = "lang",
    orders=ORDERS,
    max_buckets: int = MAX_BUCKETS,
) -> Model:
    """Counts n-grams of all rows that have a text with a letter and a language.

    The matrix keeps within MATRIX_BYTES, 32 MB: up to 128 languages have `max_buckets`
    buckets, and twice as many languages have half of them, so that n-grams share a
    bucket more often; more than 16,384 languages are an error. Without any row the model
    knows no language.
    """
    rows = with_small_batches(docs).select(
        F.col(language_column).cast("string").alias("language"),
        F.col(text_column).cast("string").alias("text"),
    ).where("language IS NOT NULL AND text IS NOT NULL")
    n_languages = rows.select("language").distinct().count()
    buckets = max_buckets
    while buckets > 256 and buckets * max(n_languages, 1) * 8 > MATRIX_BYTES:
        buckets //= 2
    if buckets * n_languages * 8 > MATRIX_BYTES:
        raise ValueError(f"{n_languages} languages: this column holds something else")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            kept = [(language, text) for language, text in named if has_letter(text)]
            for language, _ in kept:
                if language not in totals:
                    totals[language], documents[language] = np.zeros(buckets, np.int64), 0
                documents[language] += 1
            order = sorted(kept)  # texts of a language side by side
            for found, owners in ngrams([text for _, text in order], buckets, orders):
                cuts = np.flatnonzero(np.diff(owners, prepend=-1))
                for k, part in zip(owners[cuts], np.split(found, cuts[1:])):
                    np.add.at(totals[order[k][0]], part, 1)
        for language, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {
                    "language": [language] * (len(found) + 1),
                    "bucket": pa.array(np.append(found, -1).astype(np.int32)),
                    "n": pa.array(np.append(total[found], documents[language]).astype(np.int64)),
                }
            )

    # As large as the matrix, whatever the number of rows.
    sums = (
        rows.mapInArrow(count, "language string, bucket int, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(sums["language"].unique())
    counts = np.zeros((buckets, len(languages)))
    place = sums["language"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    grams = (sums["bucket"] >= 0).to_numpy(bool)
    counts[sums["bucket"].to_numpy()[grams], place[grams]] = sums["n"].to_numpy()[grams]
    documents = np.zeros(len(languages))
    documents[place[~grams]] = sums["n"].to_numpy()[~grams]
    smooth = counts + 0.5
    log_prior = np.log(documents / documents.sum()) if languages else documents
    return Model(languages, log_prior, np.log(smooth / smooth.sum(axis=0)), orders)


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows with `lang_pred` and `score` (0 to 1).

    `lang_pred` is UNKNOWN, with score 0, for a null text and one without a letter, and
    for every text if the model knows no language. A column of `docs` that has one of
    the two names is an error; no other name can clash.
    """
    clash = {"lang_pred", "score"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return scored(docs, model, text_column).select("row.*", "lang_pred", "score")


def scored(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """`row` (a struct of all columns), and `lang_pred` and `score` as in `predict`."""
    shared = shipped(docs.sparkSession, model)  # within MATRIX_BYTES

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        languages, scores = shared().predict(texts.tolist())
        return pd.DataFrame({"lang_pred": languages, "score": scores})

    rows = with_small_batches(docs).select(
        F.struct("*").alias("row"), score(F.col(text_column).cast("string")).alias("found")
    )
    return rows.select("row", "found.lang_pred", "found.score")
