"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.llm import convtrie, decontam, langid, linededup, lm, neardup, negatives, packing, quality, substrings, tokenfiles, urlfilter, warc
from seqcast.llm.common import table, written

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    judged = langid.predict(docs, model)
    return judged.select("doc_id", langid.held_out().alias("held_out"), F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_ids(table(spark, sf_dir, "documents"))
    return tokenfiles.read_ids(spark, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    counts, lexicon, weights = lm.fit(docs, ~held_out & F.col("doc_id").isNotNull())
    return lm.score_texts(docs, counts, lexicon, weights, held_out=held_out)


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(spark, archives, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    c = found.select("doc_id", F.col("contamination.n_words").alias("n_words"), decontam.contamination_digest("contamination").alias("d"))
    return c.select("doc_id", "n_words", "d.n_hit", "d.n_items", "d.items_sha256", (F.col("d.n_hit") > 0).alias("contaminated"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.line_clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_share")
    return judged.select("doc_id", *(f"quality.{n}" for n in names))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=linededup.MIN_WORDS)
    return judged.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("lines.kept_text", F.lit("")), 256).alias("kept_sha256"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.usable(vectors.withColumn("label", label)), F.col("id") % 100 == 0)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(convtrie.conversations_of(table(spark, sf_dir, "conversations")), "conversations")
    taken = F.crc32(F.col("conv").cast("string")) % 9
    # Conversation c begins with turns of conversation c - c % 5, which at most eight others begin with too.
    bases = own.where("conv % 5 = 0").select(F.col("conv").alias("base"), convtrie.turns_between(F.col("turns"), F.lit(0), F.lit(8)).alias("lent"))
    met = own.withColumn("base", F.expr("conv - conv % 5")).join(bases, "base", "left")
    begin = convtrie.turns_between(F.coalesce("lent", F.lit(b"")), F.lit(0), taken)
    rebuilt = met.select("conv", F.concat(begin, convtrie.turns_between(F.col("turns"), taken)).alias("turns"))
    return convtrie.prefix_trie(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.rules_of(spark, urlfilter.SITE_RULES + urlfilter.PATTERN_RULES)
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *(f"judged.{c}" for c in ("host", "path", "rule", "pattern", "verdict")))
