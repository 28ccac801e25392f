"""The registered queries: each operator over its whole table, in its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.llm import (
    chat,
    decontaminate,
    embeddings,
    html_blocks,
    langid,
    lines,
    packing,
    passages,
    secrets,
    simhash,
    token_links,
    turn_repair,
    warc,
)
from callsheet.llm.common import new_folder


#: Path on the executors; the file belongs to an installed package.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OTHER_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, TOKENIZER)).withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_blocks.extract(pages, html_blocks.fit(pages))
    return found.select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    written = warc.write_archives(warc.with_record_types(pages), folder)
    found = warc.read_records(warc.normalise(written, folder), folder)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts are control strings of another template.
    fixed = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    made = chat.examples(turns.unionByName(fixed))
    # Read back: the trainable text of each example, the turns of the longest one.
    loss = chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))
    read = made.select(
        "id",
        "target",
        F.length("text").cast("long").alias("chars"),
        loss.alias("loss"),
        F.when(F.col("is_last"), F.col("text")).alias("whole"),
    )
    each = read.groupBy("id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("target", "loss"))), lambda x: x["loss"]), ""
        ).alias("loss"),
        F.max("whole").alias("whole"),
    )
    back = each.withColumn("turns", chat.turns_of(F.col("whole")))
    lined = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lined, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs)
    number = lambda *kinds: F.size(
        F.filter("findings", lambda f: f["kind"].isin(*kinds))
    ).cast("long")
    base = F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE))
    live = F.size(F.filter("findings", lambda f: f["live"])).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"),
        live.alias("n_live"),
        (F.size("findings") - live).alias("n_copied"),
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = decontaminate.automata(table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit(F.col("spans"))
    return decontaminate.hits(docs, blocks).select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).withColumnRenamed("id", "doc_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = passages.without_spans(docs, passages.repeated_spans(docs))
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_links.align(docs, TOKENIZER, OTHER_TOKENIZER)
    size_b = token_links.n_pieces(OTHER_TOKENIZER)
    return token_links.with_counts(aligned, size_b).withColumnRenamed("id", "doc_id")


def _damaged(turns: DataFrame) -> DataFrame:
    """The conversations with the faults that the contract of op13 puts in; nulls are a space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(fault == 1, "").when(
        fault == 2, F.regexp_replace(as_text("text"), "[.!?]", "")
    ).otherwise(as_text("text"))
    return turns.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(as_text("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = turn_repair.Repair(_damaged(turns))
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = repair.conversations.select(F.col("id").alias("c_id"), *figures, "audit")
    digests = turn_repair.text_digests(repair.rows).select(F.col("id").alias("d_id"), "sha256")
    ids = turns.select("conv_id").distinct()
    return (
        ids.join(found, F.col("conv_id").eqNullSafe(F.col("c_id")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("d_id")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in figures],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_warc": op3_warc,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_secret_scans": op5_secret_scans,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
