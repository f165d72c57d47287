"""The pN_ queries: each reads whole tables and runs its problem's operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import duplicates, leakage, neighbours, packing, pairs, percentiles, sentences, splitting, turns
from brightloom.runtime import spread, table

PROBABILITIES = [0.5, 0.9, 0.95, 0.99]
LIMIT, OVERLAP = 1000, 100



def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- 1: pairs


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages, each once, with the question their metadata names.

    A message that names no request has a key of its own in the join, so that such messages are no hot group. After the
    join messages are dealt by their own id, in a stated number of parts, where their copies meet; so the tagging is
    spread evenly even if one request holds a great part of the messages. Of several rows of a request the earliest counts.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = F.get_json_object("metadata", "$.request_id")
    said = (
        table(spark, sf_dir, "messages")
        .where("role = 'assistant' and message_id is not null")
        .select("message_id", "content", F.coalesce(named, F.concat(F.lit("none of "), F.col("message_id"))).alias("request_id"))
    )
    asked = table(spark, sf_dir, "chat_requests").where("request_id is not null")
    asked = asked.groupBy("request_id").agg(F.min(F.struct("created_at", "query")).alias("first")).select("request_id", "first.query")
    return said.join(asked, "request_id", "left").repartition(parts, "message_id").dropDuplicates(["message_id"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(_answered(spark, sf_dir), "message_id", "query", "content").select("message_id", "defect")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with the share of each label in its response."""
    judged = pairs.broken_pairs(_answered(spark, sf_dir), "message_id", "query", "content", only_broken=False)
    return judged.select("message_id", "defect", *[F.round(label, 4).alias(label) for label in pairs.LABELS])


# ---------------------------------------------------------------- 2: neighbours


def p2_neighbours(spark: SparkSession, sf_dir: str, least: float = -1.0, rerank: int = 320) -> DataFrame:
    """The ten most similar chunks of every chunk and request, however far; p2_found takes those of at least 0.90."""
    return neighbours.most_similar(
        table(spark, sf_dir, "vector_records").select("chunk_id", "embedding"), "chunk_id", "embedding",
        table(spark, sf_dir, "retrieval_inputs").select("request_id", "query_vector"), "request_id", "query_vector",
        k=10, least=least, rerank=rerank,
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p2_neighbours(spark, sf_dir, 0.9, 48)
    of_chunk = ~F.col("is_query")
    return near.select(
        F.when(of_chunk, F.least("id", "neighbour")).otherwise(F.col("neighbour")).alias("key_a"),
        F.when(of_chunk, F.greatest("id", "neighbour")).otherwise(F.col("id")).alias("key_b"),
    ).distinct()


# ---------------------------------------------------------------- 3: speaker turns


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "meetings").select("meeting_id", "attendees", "meeting_transcript")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(_meetings(spark, sf_dir), "meeting_id", "meeting_transcript", "attendees").select(
        "meeting_id", "turn_no", "speaker"
    )


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(_meetings(spark, sf_dir), "meeting_id", "meeting_transcript", "attendees")


def p3_paused_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that also end at a pause of three times the meeting's usual step."""
    return turns.speaker_turns(_meetings(spark, sf_dir), "meeting_id", "meeting_transcript", "attendees", 3.0)


# ---------------------------------------------------------------- 4: duplicates


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_records(table(spark, sf_dir, "rerank_candidates"), "cand_id", ["content", "source"])


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with its copies."""
    counted = duplicates.count_copies(table(spark, sf_dir, "rerank_candidates"), "cand_id", ["content", "source"])
    return counted.select(F.hex("digest").alias("digest"), "rep_id", "copies", "collided")


# ---------------------------------------------------------------- 5: splitting


def _kb_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads repeated with the same doc_id are equal rows, so one of them stands for all."""
    return table(spark, sf_dir, "kb_documents").select("doc_id", "file_path", "content").dropDuplicates(["doc_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(_kb_contents(spark, sf_dir), "doc_id", "content", LIMIT, OVERLAP)
    return pieces.groupBy("doc_id").agg(F.max(F.when(F.col("cut") == "forced", 1).otherwise(0)).alias("forced"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_kb_contents(spark, sf_dir), "doc_id", "content", LIMIT, OVERLAP)


def p5_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_count per doc_id: 0 for no content, 1 within the limit, else the number of pieces."""
    parts = F.size(splitting.parts_of(F.col("content"), LIMIT, OVERLAP))
    n = F.length("content")
    count = F.when(n > LIMIT, parts).when(n > 0, 1).otherwise(0)
    return _kb_contents(spark, sf_dir).select("doc_id", "file_path", count.cast("int").alias("chunk_count"))


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: the pieces of every document put together again without their overlaps."""
    pieces = p5_pieces(spark, sf_dir)
    own = F.struct("piece_no", F.substr("piece", F.col("overlap") + 1).alias("own"))
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("parts"), F.max("n_chars").alias("longest"))
    text = F.array_join(F.transform("parts", lambda p: p["own"]), "")
    return whole.select("doc_id", F.md5(text).alias("digest"), (F.col("longest") <= LIMIT).alias("within_limit"))


# ---------------------------------------------------------------- 6: percentiles


def utc_day(stamp: Column) -> Column:
    """The UTC day of an ISO 8601 text, whatever the session's time zone; null where it can't be read."""
    seconds = F.unix_seconds(F.try_to_timestamp(stamp))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def _skill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "skill_metrics").select("id", "skill_name", "created_at", "elapsed_ms")
    return percentiles.measured(rows, "id", "elapsed_ms").withColumn("day", utc_day(F.col("created_at")).cast("string"))


def _llm_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model is compared without case; one row per measured value of elapsed_ms and total_tokens."""
    rows = table(spark, sf_dir, "llm_metrics").select("id", "model", "created_at", "elapsed_ms", "total_tokens")
    once = rows.where("id is not null").dropDuplicates(["id"])
    long = once.select(
        F.lower(F.trim("model")).alias("model"),
        utc_day(F.col("created_at")).cast("string").alias("day"),
        F.explode(
            F.create_map(
                F.lit("elapsed_ms"), F.col("elapsed_ms"), F.lit("total_tokens"), F.col("total_tokens").cast("double")
            )
        ).alias("metric", "value"),
    )
    return long.where((F.col("value") > 0) & ~F.isnan("value") & (F.col("value") < F.lit(float("inf"))))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measured columns in one run: elapsed_ms per skill and day, elapsed_ms and total_tokens per model and day."""
    skills = _skill_values(spark, sf_dir).select(F.lit("skill").alias("of"), F.col("skill_name").alias("name"), "day", F.lit("elapsed_ms").alias("metric"), F.col("elapsed_ms").alias("value"))
    models = _llm_values(spark, sf_dir).select(F.lit("model").alias("of"), F.col("model").alias("name"), "day", "metric", "value")
    return percentiles.bisect_percentiles(skills.unionByName(models), ["of", "name", "day", "metric"], "value", PROBABILITIES).withColumn(
        "percentile", F.round("percentile", 6)
    )


def p6_skill_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.bisect_percentiles(
        _skill_values(spark, sf_dir), ["skill_name", "day"], "elapsed_ms", PROBABILITIES
    ).withColumn("percentile", F.round("percentile", 6))


def p6_llm_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.bisect_percentiles(
        _llm_values(spark, sf_dir), ["model", "day", "metric"], "value", PROBABILITIES
    ).withColumn("percentile", F.round("percentile", 6))


def p6_combined_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per skill over all days, from the counts of each day."""
    daily = percentiles.rank_counts(_skill_values(spark, sf_dir), ["skill_name", "day"], "elapsed_ms")
    return percentiles.percentiles_of_counts(daily, ["skill_name"], PROBABILITIES).withColumn(
        "percentile", F.round("percentile", 6)
    )


# ---------------------------------------------------------------- 7: packing


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), "doc_id", "text")


def p7_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with what lies in it and how full it is."""
    placed = p7_containers(spark, sf_dir).groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("fill"))
    return placed.withColumn("unused", F.lit(1024) - F.col("fill"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_containers(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


# ---------------------------------------------------------------- 8: leakage


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.leaked_passages(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))
    return leaks.withColumn("share", F.round("share", 6))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


# ---------------------------------------------------------------- 9: sentences


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = sentences.sentence_units(_documents(spark, sf_dir), "doc_id", "text", with_text=False)
    return units.select("doc_id", "start_pos")


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(_documents(spark, sf_dir), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}
    # pN_found stands first among the queries of its problem
    return dict(sorted(found.items(), key=lambda x: (x[0].split("_")[0], not x[0].endswith("_found"))))
