import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.llm import token_links
from callsheet.llm.queries import OTHER_TOKENIZER, TOKENIZER, op12_token_alignment
from callsheet.llm.token_links import Pair, align, group_ends, link_places, n_pieces, with_counts
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def plain():
    """Tokens of both with their bytes, by the libraries' own calls."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=OTHER_TOKENIZER)
    keys = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in keys}
    byte |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in set(keys))}

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
        names = [b.id_to_piece(k) for k in ids_b]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in zip(ids_b, names)
        ]
        return ids_a, bytes_a, ids_b, bytes_b

    return tokens


def ranges(parts):
    out, at = [], 0
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def brute(plain, rows):
    """Every pair of tokens compared, byte ranges and all."""
    found = []
    for doc, text in rows:
        ids_a, bytes_a, ids_b, bytes_b = plain(text) if text else ([], [], [], [])
        want = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a, bytes_a, ids_b, bytes_b = [], [], [], []
        a, b = ranges(bytes_a), ranges(bytes_b)
        links = Counter(
            (ids_a[i], ids_b[j])
            for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e
        )
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = [
            ",".join(str(k) for k, (_, e) in zip(ids_a, a) if lo < e <= hi) + "|"
            + ",".join(str(k) for k, (_, e) in zip(ids_b, b) if lo < e <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        ]
        found.append((doc, ids_a, ids_b, groups, links))
    counts = Counter(pair for *_, links in found for pair in links)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return Counter(
        (doc, len(a), len(b), len(groups), sum(links.values()),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
         sum(n for p, n in links.items() if counts[p] == best[p[0]]),
         sum(n * counts[p] for p, n in links.items()))
        for doc, a, b, groups, links in found
    )


COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def check(docs, plain, rows, parts=3, **options):
    aligned = align(docs(*rows, parts=parts), TOKENIZER, OTHER_TOKENIZER)
    found = with_counts(aligned, n_pieces(OTHER_TOKENIZER), **options)
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == brute(plain, rows)


WORDS = ["the", "Hamburger", "naïve", "日本語", "🙂🙂", "don't", "1234567", "x", "  ", "\n\n", "\t", "</s>",
         "<|endoftext|>", "<0x41>", "\x00", "\x1c", "é", " ", "...", "Ａ", "\r\n", "tokenization", "a▁b"]


def texts(n, seed=5, words=WORDS):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("limit", [token_links.BROADCAST_PAIRS, 0])
def test_equals_brute_force_joined_either_way(docs, plain, limit):
    rows = [(n, t) for n, t in enumerate(texts(150))]
    check(docs, plain, rows, broadcast_pairs=limit)


def test_nulls_empty_equal_rows_and_unspelt_texts(docs, plain):
    rows = [(1, None), (2, ""), (None, "a tie"), (None, "a tie"), (3, "a tie"), (3, "other words"), (4, "a▁b"),
            (5, " "), (6, "   "), (None, None)]
    check(docs, plain, rows)


def test_empty_table_and_clashing_names(docs, spark):
    df = docs((1, "some words")).selectExpr("*", "5 AS id", "6 AS pairs", "7 AS row_id", "8 AS n")
    size = n_pieces(OTHER_TOKENIZER)
    assert [r["id"] for r in with_counts(align(df, TOKENIZER, OTHER_TOKENIZER), size).collect()] == [1]
    assert with_counts(align(df.limit(0), TOKENIZER, OTHER_TOKENIZER), size).collect() == []


def test_group_ends_at_every_shift_and_block():
    rng = random.Random(1)
    for _ in range(4000):
        n, share = rng.randrange(1, 60), rng.choice([0.2, 0.5, 0.9, 0.99])
        a, b = (np.array([*(i for i in range(1, n) if rng.random() < share), n]) for _ in range(2))
        if rng.random() < 0.2:
            b = a.copy()
        token_links._BLOCK = rng.choice([1, 3, 20, 1 << 16])
        try:
            of_a, of_b = group_ends(a, b)
        finally:
            token_links._BLOCK = 1 << 16
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[of_a - 1].tolist() == b[of_b - 1].tolist() == common
        links = {(i, j) for i in range(len(a)) for j in range(len(b))
                 if max(([0, *a])[i], ([0, *b])[j]) < min(a[i], b[j])}
        assert set(zip(*(x.tolist() for x in link_places(a, b)))) == links


def test_very_long_texts():
    pair = Pair(TOKENIZER, OTHER_TOKENIZER)
    for text in ("ab " * 400_000, " " * 1_200_000, "x" * 500_000):
        a, b = pair.tokens(text)
        of_a, of_b = group_ends(*pair.ends(a, b))
        assert (of_a[-1], of_b[-1]) == (len(a), len(b))


def test_groups_as_text(docs):
    row = align(docs((1, "Hamburger der Stadt")), TOKENIZER, OTHER_TOKENIZER, with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    assert len(row["groups"].split(";")) == row["n_groups"]
    assert sum(row["times"]) == row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


def test_query_over_the_whole_table(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("text"))
    rows = [tuple(r) for r in docs.collect() if len(r["text"] or "") < 1500]
    found = {r["doc_id"]: r for r in op12_token_alignment(spark, SMALL).collect()}
    assert len(found) == docs.count()
    # The counts need all documents; the rest of a row does not.
    want = {w[0]: w for w in brute(plain, rows)}
    for doc, w in want.items():
        assert tuple(found[doc][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == w[1:6]
        assert found[doc]["n_best"] <= w[4] and found[doc]["count_sum"] >= w[7]


def test_short_stretches_are_walked_and_long_ones_probed():
    class Ends(list):
        slices = 0

        def __getitem__(self, at):
            Ends.slices += isinstance(at, slice)
            return super().__getitem__(at)

    # Stretches of five common ends, each followed by one that only A has.
    short = [6 * n + k for n in range(200) for k in range(6)]
    a, b = Ends(short + [1200]), Ends([x for x in short if x % 6 != 5] + [1200])
    of_a, of_b = token_links._skip_runs(a, b)
    assert Ends.slices == 0
    assert [a[i - 1] for i in of_a] == [b[j - 1] for j in of_b] == list(b)
    of_a, of_b = token_links._skip_runs(Ends(range(5000)), Ends(range(5000)))
    assert 0 < Ends.slices < 60
    assert of_a == of_b == list(range(1, 5001))


def test_one_to_one_tokens_are_compared_and_no_more():
    class Ends(list):
        slices = 0

        def __getitem__(self, at):
            Ends.slices += isinstance(at, slice)
            return super().__getitem__(at)

    # Stretches of 20 common ends: neither probes nor an entry for each of their tokens.
    ends = [21 * n + k for n in range(100) for k in range(21)]
    a, b = Ends([*ends, 2100]), Ends([x for x in ends if x % 21 != 20] + [2100])
    groups, at, of_a, of_b = token_links._runs(a, b)
    assert (groups, len(at), of_a[-1], of_b[-1], Ends.slices) == (2001, 100, 100, 0, 0)


def test_stretches_of_any_length_beside_irregular_groups():
    rng = random.Random(7)
    for _ in range(1500):
        a, b, at = [], [], 0
        for _ in range(rng.randrange(1, 8)):
            for _ in range(rng.choice([0, 1, 30, 31, 32, 33, 63, 64, 65, rng.randrange(400)])):
                at += rng.randrange(1, 4)
                a.append(at), b.append(at)
            for side in (a, b):
                side += [at + x for x in range(1, 6) if rng.random() < 0.3]
            at += 6
        a.append(at), b.append(at)
        of_a, of_b = group_ends(np.array(a), np.array(b))
        assert [a[i - 1] for i in of_a] == [b[j - 1] for j in of_b] == sorted(set(a) & set(b))


def test_groups_as_text_in_parts():
    rng = np.random.default_rng(3)
    written, n = token_links.GroupText(500, 300), 20_000
    a, b = rng.integers(0, 500, 2 * n), rng.integers(0, 300, 3 * n)
    of_a, of_b = 2 * np.arange(1, n + 1), 3 * np.arange(1, n + 1)
    want = "".join(f"{','.join(map(str, x))}|{','.join(map(str, y))};" for x, y in zip(a.reshape(-1, 2), b.reshape(-1, 3)))
    assert b"".join(written.parts(a, b, of_a, of_b)).decode() == want
