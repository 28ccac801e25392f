import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.llm import langid
from callsheet.llm.queries import QUERIES


def test_ngram_counts_against_brute_force(monkeypatch):
    text = "Zwei ÄÖ wörter, 漢字 𝄞! " * 7

    def brute(orders, buckets):
        framed, counts = f" {text.lower()} ", defaultdict(int)
        mask = 2**64 - 1
        for n in orders:
            for at in range(len(framed) - n + 1):
                h = 0
                for c in framed[at : at + n]:
                    h = (h * 0x100000001B3 & mask) ^ ord(c)
                counts[((h + n) * 0x9E3779B97F4A7C15 & mask) >> 40] += 1
        found = defaultdict(float)
        for h, n in counts.items():
            found[h % buckets] += n
        return dict(found)

    for orders in ((1, 2, 3), (3,), (2, 4)):
        for step in (langid._STEP, 5):
            monkeypatch.setattr(langid, "_STEP", step)
            found, counts = langid.ngram_counts(text, 1 << 10, orders)
            assert dict(zip(found.tolist(), counts.tolist())) == brute(orders, 1 << 10)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.99


@pytest.fixture
def table(spark):
    def build(*rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    return build


TRAIN = [(1, "the cat sat on the mat", "en"), (2, "der Hund und die Katze", "de"), (3, None, "fr"), (4, "text", None),
         (5, "123", "xx"), (6, "the dog", "en"), (None, "die Maus", "de")]


def test_model_against_counts_by_hand(table):
    model = langid.fit(table(*TRAIN))
    assert model.languages == ["de", "en"]
    assert np.allclose(np.exp(model.log_prior), [0.5, 0.5])
    counts = np.zeros((model.buckets, 2))
    for _, text, lang in TRAIN:
        if lang in ("de", "en") and text:
            found, n = langid.ngram_counts(text, model.buckets)
            counts[found, ["de", "en"].index(lang)] += n
    assert np.allclose(np.exp(model.log_prob), (counts + 0.5) / (counts + 0.5).sum(axis=0))


def test_predictions_and_scores_against_brute_force(table, monkeypatch):
    rng = np.random.default_rng(3)
    model = langid.fit(table(*TRAIN, (7, "le chat et le chien", "fr")))
    letters = list("the der le chat ñ²½Ⅷ①٣ 12 漢_-\U0001d11e\n")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(200)] + ["the cat " * 300, "", None, "²½Ⅷ①", "٣ 4_"]

    def plain(text):
        if text is None or not any(c.isalpha() for c in text):
            return langid.UNKNOWN, 0.0
        log = model.log_prior.copy()
        framed = f" {text.lower()} "
        for n in (1, 2, 3):
            for at in range(len(framed) - n + 1):
                h = 0
                for c in framed[at : at + n]:
                    h = (h * 0x100000001B3 & (2**64 - 1)) ^ ord(c)
                log += model.log_prob[((h + n) * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 40 & (model.buckets - 1)]
        p = np.exp(log - log.max())
        return model.languages[int(np.argmax(log))], float((p / p.sum()).max())

    want = [plain(t) for t in texts]
    assert {lang for lang, _ in want} >= {"und", "en", "de", "fr"}
    for step, cells in ((langid._STEP, langid._CELLS), (5, langid._CELLS), (64, 40)):
        monkeypatch.setattr(langid, "_STEP", step)
        monkeypatch.setattr(langid, "_CELLS", cells)
        languages, scores = model.predict(texts)
        assert languages == [lang for lang, _ in want]
        assert np.allclose(scores, [score for _, score in want], atol=1e-9)


def test_numbers_are_no_letters():
    assert [langid.has_letter(t) for t in ("²", "½ Ⅷ ①", "٣", "a²", "1_", "漢", "ª", "")] == [
        False, False, False, True, False, True, True, False]


def test_predictions_for_nulls_empty_and_long_texts_and_equal_rows(table):
    model = langid.fit(table(*TRAIN))
    df = table((1, None, None), (2, "", "en"), (3, "12 ! 漢", "a"), (3, "12 ! _", "a"), (4, "the mat", None), (4, "the mat", None),
               (None, "die Katze und der Hund " * 50_000, None)).selectExpr("*", "1 AS row", "2 AS found")
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in langid.predict(df, model).collect())
    got.remove(("3", next(p for d, p in got if d == "3" and p != "und")))
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("None", "de")]
    with pytest.raises(ValueError, match="score"):
        langid.predict(df.withColumnRenamed("row", "score"), model)


def test_empty_tables(table):
    model = langid.fit(table(*TRAIN).limit(0))
    (row,) = langid.predict(table((1, "the cat", None)), model).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert langid.predict(table(*TRAIN).limit(0), langid.fit(table(*TRAIN))).collect() == []


def test_the_matrix_stays_within_its_bound(table, monkeypatch):
    rows = [(n, f"words of language {n}", f"l{n}") for n in range(40)]
    monkeypatch.setattr(langid, "MATRIX_BYTES", 40 * 8 * 512)
    model = langid.fit(table(*rows))
    assert model.log_prob.shape == (512, 40)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 1000)
    with pytest.raises(ValueError, match="40 languages"):
        langid.fit(table(*rows))


def test_null_ids_are_not_held_out(table):
    rows = table((None, "a", "en")).select(langid.held_out(F.col("doc_id")).alias("h")).collect()
    assert [r["h"] for r in rows] == [False]
