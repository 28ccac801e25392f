import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from callsheet.llm import lines
from callsheet.llm.lines import apply_bitmaps, keep_bitmaps, kept_lines, line_key


def brute(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least_chars:
                holders[line_key(line)].add(doc)
    order = lambda d: (d is not None, d or 0)
    keeper = {k: max(h, key=order) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in keeper or keeper[line_key(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def check(docs, rows, parts=3):
    df = docs(*rows, parts=parts)
    kept = apply_bitmaps(df, keep_bitmaps(df))
    assert kept.columns == [*df.columns, "kept_text", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in kept.collect())
    assert got == brute(rows)


HOT = "a line that very many of the documents share"


def test_repeated_lines(docs):
    rng = random.Random(3)
    pool = [HOT, HOT.upper() + "  ", "\t" + HOT, "short", "", "É" * 20, "é" * 20, "x" * 19, "y" * 20, " " + "z" * 25]
    rows = []
    for doc in range(120):
        lines = rng.choices(pool, k=rng.randrange(6)) + [f"own line of the document number {doc}"] * rng.randrange(3)
        rng.shuffle(lines)
        rows.append((doc, "\n".join(lines)))
    check(docs, rows)


def test_a_hot_line_in_many_partitions(docs, spark):
    rows = [(n, f"{HOT}\nwords of {n}\n{HOT}") for n in range(700)] + [(n, "nothing") for n in range(700, 900)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(docs, rows, parts=8)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_nulls_empty_texts_equal_rows_and_shared_ids(docs):
    rows = [(1, None), (2, ""), (None, HOT), (None, HOT + "\nmore"), (3, HOT), (3, HOT), (3, HOT + "\nother"),
            (4, HOT), (5, "\n\n"), (None, None), (6, "w" * 300_000 + "\n" + HOT)]
    check(docs, rows)


def test_many_equal_rows_of_one_id_and_of_none(docs):
    rows = [(7, f"{HOT}\nsome other line of text, a long one")] * 30_000 + [(None, HOT)] * 30_000
    rows += [(8, HOT), (9, f"{HOT}\nx"), (None, None), (None, None)]
    check(docs, rows, parts=8)


@pytest.mark.parametrize("held", [3, 10_000])
def test_many_texts_without_an_id_share_a_line(docs, monkeypatch, held):
    monkeypatch.setattr(lines, "_HELD", held)
    several = "another line that the documents share"
    rows = [(None, f"{HOT}\nwords {n}") for n in range(400)] + [(5, f"a\n{HOT}"), (5, f"b\n{HOT}")]
    rows += [(None, f"{several}\n{n}") for n in range(40)] + [(n, f"{several}\n{n}") for n in (1, 2)]
    # One line in two ids only, which stays, and one in three.
    check(docs, rows, parts=8)


def test_two_ids_are_too_few(docs):
    check(docs, [(1, HOT), (1, HOT + "\na"), (2, HOT), (2, HOT)])


def test_empty_table(docs):
    df = docs((1, "a")).limit(0)
    assert apply_bitmaps(df, keep_bitmaps(df)).collect() == []


def test_extra_columns_may_have_any_name_but_the_added_ones(docs):
    df = docs((1, HOT), (2, HOT), (3, HOT)).selectExpr("*", "1 AS id", "2 AS keep", "3 AS text_hash", "4 AS row")
    kept = apply_bitmaps(df, keep_bitmaps(df)).collect()
    assert {(r["doc_id"], r["kept_text"], r["id"], r["keep"], r["text_hash"], r["row"]) for r in kept} == {
        (1, "", 1, 2, 3, 4), (2, "", 1, 2, 3, 4), (3, HOT, 1, 2, 3, 4)}
    with pytest.raises(ValueError, match="kept_text"):
        apply_bitmaps(df.withColumnRenamed("n_chars", "kept_text"), keep_bitmaps(df))


def test_bitmaps_have_a_bit_for_each_line(docs):
    rows = keep_bitmaps(docs((1, f"a\n{HOT}\nb"), (2, HOT), (3, HOT))).collect()
    assert {(r["id"], r["n_lines"], r["n_dropped"]) for r in rows} == {(1, 3, 1), (2, 1, 1)}
    assert {kept_lines(f"a\n{HOT}\nb", r["keep"]) for r in rows if r["id"] == 1} == {"a\nb"}
    assert np.unpackbits(np.frombuffer(__import__("zlib").decompress(rows[0]["keep"]), np.uint8)).sum() <= 2


def test_texts_pass_python_once(spark):
    docs = spark.createDataFrame([(n, "a line that is long enough\nb" + str(n)) for n in range(5)], "doc_id long, text string")
    kept = lines.with_kept_lines(docs, lines.keep_bitmaps(docs))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    (evaluated,) = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
    assert "row#" in evaluated and "text#" not in evaluated.replace("kept_text#", "")
    assert sorted(r["kept_text"] for r in kept.collect())[0] == "a line that is long enough\nb4"
