"""Conversations: which messages are stored and what answers them; answers and their checks; records of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def route_messages(messages: DataFrame, key: str, order: str, closes: Column, manual: Column, missing_slots: Column, answerable: Column) -> DataFrame:
    """messages with stored and route: IGNORED in a closed conversation, else TRANSFER on demand, CLARIFY, ANSWER or TRANSFER.

    Closed is final.  A conversation that was transferred goes on being answered: transferred says
    whether it was before the message.  A message that is not ignored is stored, whatever its route.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(closes).over(before), F.lit(False))
    route = F.when(F.col("_closed"), "IGNORED").when(manual, "TRANSFER").when(missing_slots, "CLARIFY").when(answerable, "ANSWER").otherwise("TRANSFER")
    routed = messages.withColumn("_closed", closed).withColumn("route", route).withColumn("stored", ~F.col("_closed"))
    return routed.withColumn("transferred", F.coalesce(F.max(F.col("route") == "TRANSFER").over(before), F.lit(False))).drop("_closed")


def generate_and_verify(rows: DataFrame, key: str, generate: Callable[[Column], Column], verify: Callable[[Column, Column], Column], max_retry: int = 2) -> DataFrame:
    """rows with answer, attempts, claim_fail: an answer that verify accepts, in at most max_retry + 1 attempts, else null.

    generate(attempt) gives the text of an attempt (from 0), null if the model failed, which ends the
    row; verify(answer, attempt) tells whether all its claims are supported (null: it could not be
    read, a failed attempt).  Each round works on the rows that are still open.
    """
    state = rows.withColumns({"answer": F.lit(None).cast("string"), "attempts": F.lit(0), "_open": F.lit(True)})
    for attempt in range(max_retry + 1):
        n = F.lit(attempt)
        state = state.withColumn("_new", F.when(F.col("_open"), generate(n)))
        good = F.col("_open") & F.coalesce(verify(F.col("_new"), n), F.lit(False)) & F.col("_new").isNotNull()
        state = state.withColumn("_good", good).withColumns({"answer": F.when(F.col("_good"), F.col("_new")).otherwise(F.col("answer")), "attempts": F.col("attempts") + F.col("_open").cast("int"), "_open": F.col("_open") & ~F.col("_good") & F.col("_new").isNotNull()})
    return state.withColumn("claim_fail", F.col("answer").isNull()).drop("_open", "_new", "_good")


def _four_places(c: Column) -> Column:
    return F.coalesce(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).cast("decimal(20,12)").cast("decimal(5,4)")


def evaluation_records(evaluations: DataFrame) -> DataFrame:
    """One row per evaluation(trace_id, query, answerable, confidence, refusal_reason, evidence, conflicts, answer, claim_fail)."""
    short = lambda c: F.substring(c, 1, 500).alias(c)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    passed = F.col("answer").isNotNull() & ~F.coalesce("claim_fail", F.lit(False))
    return evaluations.select("trace_id", short("query"), F.coalesce(F.col("answerable").cast("int"), F.lit(0)).alias("answerable"), _four_places(F.col("confidence")).alias("confidence"), short("refusal_reason"), F.greatest(size("evidence"), F.lit(0)).alias("evidence_count"), F.greatest(size("conflicts"), F.lit(0)).alias("conflict_count"), "answer", passed.cast("int").alias("claim_pass"))


def evidence_records(evaluations: DataFrame) -> DataFrame:
    """One row per evidence of evaluations(trace_id, evidence: array<struct<chunk_id, score>>, conflicts: array<struct<a, b>>, claims: array<struct<evidence, verdict>>, answer).

    WARN if a conflict names it or no supported claim of an answer cites it, else SUPPORTED.
    """
    rows = evaluations.select("trace_id", "conflicts", "claims", "answer", F.posexplode("evidence").alias("i", "e"))
    in_conflict = F.coalesce(F.exists("conflicts", lambda c: (c["a"] == F.col("i")) | (c["b"] == F.col("i"))), F.lit(False))
    cited = F.coalesce(F.exists("claims", lambda c: (c["evidence"] == F.col("i")) & (c["verdict"] == "SUPPORTED")), F.lit(False))
    verdict = F.when(in_conflict, "WARN").when(F.col("answer").isNotNull() & cited, "SUPPORTED").otherwise("WARN")
    return rows.select("trace_id", F.col("i").alias("pos"), "e.chunk_id", _four_places(F.col("e.score")).alias("confidence"), verdict.alias("verdict"))


def audit_rows(calls: DataFrame) -> DataFrame:
    """Model calls as they are logged: the first attempt and zeros for what is missing, errors cut at 500 characters."""
    filled = {c: F.coalesce(F.col(c), F.lit(1 if c == "attempt" else 0)) for c in ("attempt", "prompt_chars", "completion_chars", "prompt_tokens", "completion_tokens", "elapsed_ms") if c in calls.columns}
    return calls.withColumns(filled | {"error_msg": F.substring("error_msg", 1, 500)})


def append(rows: DataFrame, path: str, batch: int = 1000) -> None:
    """Append rows to a table, at most ``batch`` in a file."""
    rows.write.mode("append").option("maxRecordsPerFile", batch).parquet(path)


def cases_from_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """feedback_id, question: a case for each thumb down, from its message's text; feedback without a message gives none."""
    down = feedback.where(F.upper("type") == "THUMB_DOWN").select("feedback_id", "message_id")
    return down.join(messages.select("message_id", F.col("content").alias("question")), "message_id").select("feedback_id", "question")


def accepted_cases(proposals: DataFrame, sampled: DataFrame, existing: DataFrame, most: int = 5) -> DataFrame:
    """kb_id, question, gold_answer, gold_chunks of proposed cases that count.

    A base with ``most`` cases gets no more.  Questions and answers are trimmed and must not be
    blank; of the gold ids only those of the base's sampled chunks count, and one is needed.
    """
    full = existing.groupBy("kb_id").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("kb_id")
    trimmed = proposals.withColumns({"question": F.trim(F.coalesce("question", F.lit(""))), "gold_answer": F.trim(F.coalesce("gold_answer", F.lit("")))}).where("question <> '' AND gold_answer <> ''")
    numbered = trimmed.join(full, "kb_id", "left_anti").select("kb_id", "proposal_id", "question", "gold_answer", F.posexplode("gold_chunks").alias("i", "chunk_id"))
    good = numbered.join(sampled.select("kb_id", "chunk_id").distinct(), ["kb_id", "chunk_id"], "left_semi")
    cases = good.groupBy("kb_id", "proposal_id", "question", "gold_answer").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk_id"))), lambda x: x["chunk_id"]).alias("gold_chunks"))
    return cases.select("kb_id", "proposal_id", F.substring("question", 1, 500).alias("question"), F.substring("gold_answer", 1, 2000).alias("gold_answer"), "gold_chunks")
