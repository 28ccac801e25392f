import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from callsheet.llm import simhash
from callsheet.llm.common import components
from callsheet.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_common import brute as brute_components


def brute_print(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, bits=2):
    prints = [brute_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1) if (prints[i] ^ prints[j]).bit_count() <= bits]
    roots = {i: i for i in range(len(rows))} | brute_components(near)
    members = {}
    for i, r in roots.items():
        members.setdefault(r, []).append(rows[i][0])
    lowest = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return [(rows[i][0], f"{prints[i]:016x}", lowest[roots[i]]) for i in range(len(rows))], roots


def signed(x):
    return int(np.uint64(x).view(np.int64))


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b", "A b  c\td É ß\x0bq", "x " * 50, "é b   c d"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_a_long_text_is_read_in_steps():
    text = " ".join(random.Random(1).choices(["a", "b", "c", "dd", "eee"], k=300_000))
    assert simhash.fingerprint(text) == brute_print(text)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = simhash.Tree(2)
    for v in values:
        tree.add(v)
    for v in [*values[:50], *(rng.getrandbits(12) for _ in range(50))]:
        assert sorted(tree.search(v)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]


@pytest.mark.parametrize("size", [16, 1024])
def test_links_connect_what_is_near(spark, size):
    rng = random.Random(3)
    prints = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(30):
            prints.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    core = rng.getrandbits(64)
    for _ in range(150):
        # Many that share most bits: their shards are cut again.
        x = core
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long").repartition(4)
    got = {r["node"]: r["root"] for r in components(simhash.links(df, 2, size)).collect()}
    near = [(signed(a), signed(b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    assert got == brute_components(near)


ROWS = [(5, "one two three four five six seven"), (3, "one two three four five six seven"), (9, None), (8, ""),
        (4, "another text of words"), (None, "one two three four five six seven"), (None, "lonely words here"),
        (7, "one two three four five six seven"), (7, "one two three four five six seven"), (6, "w " * 20000)]


def test_near_duplicates(docs):
    got = simhash.near_duplicates(docs(*ROWS)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_groups(ROWS)[0])


def test_one_of_each_group_stays(docs):
    df = docs(*ROWS).selectExpr("*", "1 AS id", "2 AS fingerprint", "3 AS root", "4 AS row")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:5]) for r in kept.collect()) == [
        (-1, "lonel"), (3, "one t"), (4, "anoth"), (6, "w w w"), (8, "")]


def test_only_rows_with_copies_are_sorted_as_texts(docs):
    lonely = [(n, f"words of document {n} and nothing else {n * 7919}") for n in range(50)]
    kept = simhash.one_of_each(docs(*lonely, *[(100, "equal rows of one text " * 9)] * 2000, *[(None, None)] * 500))
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {100, None} <= set(ids)
    before, _, after = kept._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")
    assert "Aggregate" not in before and "(n#" in after and "> 1" in after and "Aggregate" not in after


def test_empty_table(docs):
    assert simhash.near_duplicates(docs(*ROWS).limit(0)).collect() == []
    assert simhash.one_of_each(docs(*ROWS).limit(0)).collect() == []


def test_the_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op8_simhash_near_dedup"](spark, SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_groups(rows)[0])
