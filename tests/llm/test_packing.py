import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from callsheet.llm.packing import best_fit_plan, encoder, pack, pieces, sequences
from callsheet.llm.queries import QUERIES, TOKENIZER
from tests.conftest import SMALL

SLOW = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SLOW.encode_special_tokens = True
FAST = encoder(TOKENIZER)


def ids_of(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids + [0]


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    used = defaultdict(list)
    counts = Counter(lengths)
    runs = best_fit_plan(counts, capacity)
    for length, n in counts.items():
        own = sorted(r for r in runs if r[0] == length)
        for rank in range(n):
            _, first_rank, first, each, offset = [r for r in own if r[1] <= rank][-1]
            k = rank - first_rank
            used[first + k // each].append((offset + k % each * length, length))
    rooms = []
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        rooms.append(capacity - at)
    assert sorted(rooms) == best_fit_one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    assert len(best_fit_plan({n: rng.randrange(10**12) for n in range(1, 2049)})) < 3 * 2048


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_special_strings_and_every_kind_of_character():
    texts = ["a <|endoftext|> b", "x" * 30000, " " * 5000 + "a", "\r\n\t a\x00"]
    texts += ["".join(f"{chr(c)} a{chr(c)}{chr(c)}" for c in range(at, at + 400) if not 0xD800 <= c < 0xE000)
              for at in range(0, 0x30000, 400)]
    for text in texts:
        assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_white_space_runs_that_tiktoken_refuses(docs):
    texts = {1: " " * 1_200_000, 2: "a" + "\n" * 1_200_000 + "b", 3: "c"}
    for text in texts.values():
        assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids
    check(pack(pieces(docs(*texts.items()), TOKENIZER)).collect(), texts, 2048)


def test_pieces_hold_the_ids_of_the_default_call(docs):
    default = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>" * 2, 3: "a <|endoftext| > b", 4: "plain"}
    got = {r["id"]: r["ids"] for r in pieces(docs(*texts.items()), TOKENIZER, with_ids=True).collect()}
    assert got == {n: default.encode(t, add_special_tokens=False).ids + [0] for n, t in texts.items()}
    assert got[1] == [64, 220, 50256, 275, 0]


def check(rows, texts, size):
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = ids_of(text)
        parts = sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(ids) // size)
        at = 0
        for p in parts:
            own = np.array(ids[at : at + p["length"]], "<u4")
            assert (p["start"], p["length"], p["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
            assert p["piece"] == 0 or p["length"] == size
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_pieces_and_sequences(docs):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "γδ", "\n"], k=rng.randrange(60))) for i in range(80)}
    texts |= {100: None, 101: "", 102: "long text " * 500}
    packed = pack(pieces(docs(*texts.items()), TOKENIZER, max_tokens=64, with_ids=True), 64)
    rows = packed.collect()
    n = check(rows, texts, 64)
    lengths = [r["length"] for r in rows]
    assert n == len(best_fit_one_by_one(lengths, 64))
    found = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in rows:
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_equal_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b", 5, 0)] * 3 + [(None, "c", 6, 0)] * 2 + [(1, "other", 7, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, piece int")
    packed = pack(pieces(df, TOKENIZER, max_tokens=8), 8).collect()
    assert Counter(r["id"] for r in packed) == {1: 4, None: 2}
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == 6


def test_empty_table(docs):
    assert pack(pieces(docs().limit(0), TOKENIZER)).collect() == []


def test_the_query_packs_all_documents(spark):
    rows = QUERIES["op1_best_fit_packing"](spark, SMALL).withColumnRenamed("doc_id", "id").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check(rows, texts, 2048) == len(best_fit_one_by_one([r["length"] for r in rows], 2048))
