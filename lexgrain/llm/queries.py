"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm.bpe import loaded_bpe
from lexgrain.llm.conversations import conversation_report, repaired_pieces
from lexgrain.llm.decontaminate import contamination
from lexgrain.llm.exact_dedup import exact_groups
from lexgrain.llm.language_id import languages, train
from lexgrain.llm.licenses import known_licenses, license_scan
from lexgrain.llm.near_dedup import near_groups
from lexgrain.llm.packing import pack
from lexgrain.llm.run_detection import periodic_runs, strongest_run
from lexgrain.llm.secret_scan import secret_report
from lexgrain.llm.substring_dedup import repeated_passages
from lexgrain.llm.token_counts import token_counts
from lexgrain.llm.token_files import read_token_files, write_token_files
from lexgrain.llm.url_filter import url_verdicts
from lexgrain.session import new_scratch_path, ship_package


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"), keep="largest")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), partial(loaded_bpe, vocabulary_path()), end_id=0)


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(_table(spark, folder, "documents"), known_licenses(spark))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark, _table(spark, folder, "documents"), vocabulary_path())


#: Fixed by the contract: host, path and verdict of each rule.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(spark, _table(spark, folder, "pages"), rules)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return contamination(spark, documents, benchmark).drop("longest_match", "spans")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(spark, _table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return languages(spark, documents, train(spark, documents))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(_table(spark, folder, "documents"))


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(spark, _table(spark, folder, "documents"))


def _damaged(conversations: DataFrame) -> DataFrame:
    """Fixed by the contract: rows that are dropped, emptied, cut, repeated or given another role."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    damaged = rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return damaged.drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    report = conversation_report(repaired_pieces(_damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    joined = every.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_scratch_path(spark, "token-files")
    documents = _table(spark, folder, "documents")
    write_token_files(documents, path, partial(loaded_bpe, vocabulary_path()), end_id=0)
    ids = F.crc32("ids").alias("ids_crc32")
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", ids)


def _with_planted_runs(documents: DataFrame) -> DataFrame:
    """Fixed by the contract: words of one document in ten repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = documents.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("bigint")
    cut = cut.select("*", n.alias("n"), (F.col("g") % F.greatest(n, F.lit(1))).alias("a"))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
        lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")),
    )
    planted = F.array_join(F.transform(place, lambda i: F.get("w", i.cast("int"))), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(_with_planted_runs(_table(spark, folder, "documents")))
    found = found.withColumn("best", strongest_run(F.col("runs")))
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}
