"""The pipeline against brute force, stage by stage on what the stage before kept."""

import random
from collections import Counter

import corpus_pipeline
from callsheet.llm.queries import TOKENIZER
from tests.conftest import SMALL
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import best_fit_one_by_one, check
from tests.llm.test_simhash import brute_groups

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_in_a_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns

    def step(name, docs):
        STAGES[name](spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best-fit packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        return out

    known = step("language ID", docs)
    assert sorted(rows_of(known)) == sorted(rows_of(docs))  # all of them have a language

    lines = step("line dedup", known)
    assert Counter(rows_of(lines)) == Counter((d, t) for d, t, _, _ in brute_lines(rows_of(known)).elements())

    single = step("SimHash near-dedup", lines)
    groups, _ = brute_groups(rows_of(lines))
    text_of = dict(rows_of(lines))
    assert sorted(rows_of(single)) == sorted((d, text_of[d]) for d, _, first in groups if d == first)

    clean = step("benchmark decontamination", single)
    text_of = dict(rows_of(clean))
    dirty = 0
    for doc, text in rows_of(single):
        n, hit, _ = brute_hits(text, items, 10)
        dirty += bool(hit)
        if not hit:
            assert text_of[doc] == text
        elif doc in text_of:
            assert not brute_hits(text_of[doc], items, 10)[1]
        else:
            assert len(hit) > n / 2
    assert dirty

    packed = step("best-fit packing", clean).withColumnRenamed("doc_id", "id").collect()
    n = check(packed, text_of, 2048)
    assert n == len(best_fit_one_by_one([r["length"] for r in packed], 2048))
    ran = corpus_pipeline.run(spark, SMALL)
    fields = ("piece", "start", "length", "ids_crc32")
    assert Counter((r["doc_id"], *[r[f] for f in fields]) for r in ran.collect()) == Counter(
        (r["id"], *[r[f] for f in fields]) for r in packed)


def test_one_copy_of_the_corpus_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    out = corpus_pipeline.run(spark, SMALL)
    assert [f.name for f in (tmp_path / "pipeline").iterdir()] == [str(len(corpus_pipeline.STAGES) - 2)]
    assert out.count() > 0


def test_language_stage_rejects_what_has_no_language(spark, docs):
    train = [(n, random.Random(n).choice(["the cat sat", "on the mat"])) for n in range(20)]
    df = docs(*train, (100, None), (101, "12 + 3"), (102, ""))
    assert {d for d, _ in rows_of(STAGES["language ID"](spark, df, SMALL))} == set(range(20))


def test_stages_keep_extra_columns_of_any_name(spark, docs):
    line = "A line that all three documents share with each other.\n"
    names = ["score", "lang_pred", "n_lines", "n_dropped", "kept_text", "clean_text", "row", "found", "id", "cut", "hit", "a.b"]
    plain = docs(*[(n, line + f"own words of document {n}") for n in range(3)])
    extra = plain.selectExpr("*", *[f"concat('{name} ', doc_id) AS `{name}`" for name in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, extra, SMALL)
        if name == "best-fit packing":
            fields = ("doc_id", "piece", "start", "length", "ids_crc32")
            assert {tuple(r[f] for f in fields) for r in out.collect()} == {
                tuple(r[f] for f in fields) for r in stage(spark, plain, SMALL).collect()}
            continue
        assert out.columns == extra.columns, name
        rows = out.collect()
        assert sorted(map(str, [r[:5] for r in rows])) == sorted(str(r[:]) for r in stage(spark, plain, SMALL).collect())
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names), name


def test_stages_take_nulls_equal_rows_and_empty_tables(spark, docs):
    rows = [(1, None), (1, None), (None, "some words of a document"), (2, ""), (3, "w " * 50_000), (3, "w " * 50_000)]
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs(*rows), docs(*rows).limit(0)):
            out = stage(spark, df, SMALL)
            n = out.count()
            assert (n == 0) if df.isEmpty() else (n > 0), name
            if name != "best-fit packing":
                assert out.columns == df.columns
    assert TOKENIZER.endswith(".json")
