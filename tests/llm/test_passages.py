import random
from collections import Counter

import numpy as np
import pytest

from callsheet.llm.passages import Automaton, Hasher, Shards, repeated_spans, without_spans

WINDOW = 6


def brute(rows, window=WINDOW):
    """Windows compared as tuples of words; null ids are larger than all others."""
    order = lambda d: (d is None, d or 0)
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    first = {}
    for doc, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, order(doc)), order(doc))
    out = []
    for doc, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < order(doc):
                gone |= set(range(at, at + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((doc, len(words), len(gone), kept))
    return Counter(out)


def check(docs, rows, parts=3, window=WINDOW, **options):
    df = docs(*rows, parts=parts)
    kept = without_spans(df, repeated_spans(df, window=window, **options), window=window)
    got = Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in kept.collect())
    assert got == brute(rows, window)
    return got


def made(n, seed, pool=9):
    """Texts of shared passages, whole or in part, between words of their own."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "é", "日", " x", "long-word", "\x1c"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(4, 40))] for _ in range(pool)]
    rows = []
    for doc in rng.sample(range(10 * n), n):
        words = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(passages)
            lo = rng.randrange(len(passage))
            words += rng.choice([passage, passage[lo:], passage[: lo + 1], [word() for _ in range(9)]])
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = word()
        rows.append((doc, "".join(w + rng.choice([" ", "  ", "\n", "\t\r"]) for w in words)))
    return rows + rows[::7] + [(1_000_000 + k, text) for k, (_, text) in enumerate(rows[::5])]


@pytest.mark.parametrize("options", [{}, {"shard_windows": 4, "task_windows": 10}])
@pytest.mark.parametrize("window", [1, 6, 11])
def test_equals_brute_force_with_one_shard_or_many(docs, window, options):
    check(docs, made(120, seed=window), window=window, **options)


def test_a_passage_in_a_third_of_all_documents_between_others(docs):
    rng, shared = random.Random(8), " ".join(f"w{k}" for k in range(30))
    rows = [(n, f"own{n} {shared} end{n}" if n % 3 == 0 else f"only {n} " * 5) for n in range(600)]
    rows += [(1000 + n, f"{shared[: rng.randrange(100)]} x{n % 4} {shared}") for n in range(100)]
    check(docs, rows, parts=8, shard_windows=8, task_windows=50)


def test_words_that_repeat(docs):
    check(docs, [(1, "a " * 200), (2, "a " * 90 + "b " + "a " * 3), (3, "a b " * 40), (4, "b a " * 50), (0, "a " * 5)])


def test_nulls_empty_texts_equal_rows_and_shared_ids(docs):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, text), (3, text), (3, f"{text} more"), (None, text), (None, f"{text} eight"),
            (None, None), (4, "too short"), (5, "too short"), (7, f"zero {text}"), (None, "p q r s t u v"), (None, "p q r s t u v")]
    got = check(docs, rows)
    assert got[None, 7, 0, "p q r s t u v"] == 2 and got[3, 7, 0, text] == 2


def test_many_equal_rows_and_a_very_long_text(docs):
    long = " ".join(f"w{k % 977}x{k % 1009}" for k in range(120_000))
    check(docs, [(1, long), (2, f"{long} and more")] + [(3, "one two three four five six")] * 3000 + [(4, "x one two three four five six")])


def test_empty_table_and_clashing_names(docs):
    df = docs((1, "a b c d e f g"), (2, "a b c d e f g")).selectExpr("*", "1 AS id", "2 AS row", "3 AS whole", "4 AS d1", "5 AS cut")
    kept = without_spans(df, repeated_spans(df, window=WINDOW), window=WINDOW).collect()
    assert {(r["row"]["doc_id"], r["row"]["id"], r["kept_text"]) for r in kept} == {(1, 1, "a b c d e f g"), (2, 1, "")}
    empty = df.limit(0)
    assert without_spans(empty, repeated_spans(empty)).collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "a b c d e f"), ("B", "a b c d e f"), ("é", "x a b c d e f")], "doc_id string, text string")
    kept = without_spans(df, repeated_spans(df, window=WINDOW), window=WINDOW)
    assert {(r["row"]["doc_id"], r["kept_text"]) for r in kept.collect()} == {("B", "a b c d e f"), ("b", ""), ("é", "x")}


def test_equal_windows_have_equal_anchors_and_hashes():
    hasher, rng = Hasher(10), random.Random(1)
    shared = [f"{rng.random()}".encode() for _ in range(40)]
    seen = []
    for _ in range(2):
        own = [f"{rng.random()}".encode() for _ in range(rng.randrange(5, 30))]
        hashes = hasher.hashed(own + shared)
        phrases = hasher.phrases(hashes)
        h1, h2 = hasher.windows(hashes)
        n = len(own)
        seen.append((phrases[hasher.anchors(phrases)][n:].tolist(), h1[n:].tolist(), h2[n:].tolist()))
    assert seen[0] == seen[1] and len(set(seen[0][1])) == len(seen[0][1])
    assert len(set(seen[0][0])) < len(seen[0][0])


def test_crowded_buckets_are_cut():
    buckets = np.array([5, 5, 9, 1 << 19], np.int64)
    shards = Shards(4, {5: 3}).of(buckets, np.array([0, 2, 1, 7], np.uint64))
    assert shards.tolist() == [4, 6, 0, 2]


def test_automaton_takes_only_whole_windows():
    automaton = Automaton(4)
    automaton.add([b"a", b"b", b"c", b"d", b"e"], [1, 2])
    assert list(automaton.located(b"x a b c d e a b c".split())) == [(1, 1), (2, 2)]
    assert list(automaton.located(b"b c d".split())) == [] == list(Automaton(4).located([b"a"] * 9))
