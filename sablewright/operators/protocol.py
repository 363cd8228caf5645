"""Checks of what models return: content blocks, whole JSON documents, decisions, and the turn contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that stored answers and callers use.
ROW_KEYS = ("candidates", "claims", "relations", "items", "decisions")
REASONING = ("reasoning", "thinking", "reasoning_content")
ROUTES = {"analyze": "direct", "rag": "retriever", "compare": "retriever", "search": "fetcher", "general": "END"}
CORRECTION = r"(?:研究方向)?(?:改为|是)\s*([^，。；;]+)"
CORRECTION_WORDS = ("改为", "研究方向")
# End of the fixed values.


def visible_text(blocks: Column) -> Column:
    """The text of content blocks (type, text), without reasoning blocks, one to a line."""
    shown = F.filter(blocks, lambda b: ~F.coalesce(b["type"], F.lit("")).isin(*REASONING) & b["text"].isNotNull())
    return F.trim(F.array_join(F.transform(shown, lambda b: b["text"]), "\n"))


def json_rows(content: Column, single: bool = False) -> Column:
    """(status, rows): the objects of a whole JSON document, as JSON strings.

    The document may stand in a code fence. Rows are the top list, or the list under a known key, or with ``single`` one
    object. Status is parsed, parsed_single_object, empty_array, llm_output_truncated or llm_invalid_json; a valid
    beginning is never taken for the whole.
    """
    text = F.trim(F.coalesce(content, F.lit("")))
    inner = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(inner != "", F.trim(inner)).otherwise(text)
    # the parser stops after the first value; within brackets, anything behind it is an error or a second element
    wrapped = F.concat(F.lit("["), body, F.lit("]"))
    valid = F.try_parse_json(wrapped).isNotNull() & (F.size(F.from_json(wrapped, "array<string>")) == 1)
    cut = (body.startswith("[") & ~body.endswith("]")) | (body.startswith("{") & ~body.endswith("}"))
    lists = F.coalesce(*(F.when(F.get_json_object(body, f"$.{k}").startswith("["), F.get_json_object(body, f"$.{k}")) for k in ROW_KEYS))
    top = F.when(body.startswith("["), body).when(body.startswith("{"), lists)
    rows = F.from_json(top, "array<string>")
    objects = rows.isNotNull() & ~F.exists(F.coalesce(rows, F.array().cast("array<string>")), lambda r: r.isNull() | ~r.startswith("{"))
    none = F.lit(None).cast("array<string>")

    def out(status: str, value: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), value.alias("rows"))

    one = valid & body.startswith("{") & lists.isNull() & F.lit(single)
    return (
        F.when(~valid & cut, out("llm_output_truncated", none))
        .when(~valid, out("llm_invalid_json", none))
        .when(one, out("parsed_single_object", F.array(body)))
        .when(~objects, out("llm_invalid_json", none))
        .when(F.size(rows) == 0, out("empty_array", rows))
        .otherwise(out("parsed", rows))
    )


def output_error(content: Column, finish_reason: Column) -> Column:
    """The kind of error of a model's answer that is empty or was cut off; null if it is neither."""
    return F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "llm_empty_response").when(finish_reason.isin("length", "max_tokens"), "llm_output_truncated")


def decisions(items: DataFrame, returned: DataFrame) -> DataFrame:
    """For each request: how many decisions are missing, repeated, unknown or not allowed, and whether all is well.

    ``items`` has (request_id, item_index, candidates), ``returned`` (request_id, item_index, decision, target_id). Every
    item needs exactly one decision, new or merge, and a merge must name one of the item's candidates.
    """
    per = returned.groupBy("request_id", "item_index").agg(F.count("*").alias("__n"), F.max(F.struct("decision", "target_id")).alias("__d"))
    j = items.withColumn("__item", F.lit(True)).join(per, ["request_id", "item_index"], "full")
    known, given = F.coalesce("__item", F.lit(False)), F.coalesce("__n", F.lit(0))
    allowed = (F.col("__d.decision") == "new") | ((F.col("__d.decision") == "merge") & F.coalesce(F.array_contains("candidates", F.col("__d.target_id")), F.lit(False)))
    out = j.groupBy("request_id").agg(
        F.count_if(known & (given == 0)).alias("missing"),
        F.sum(F.when(known & (given > 1), given - 1).otherwise(0)).alias("repeated"),
        F.sum(F.when(~known, given).otherwise(0)).alias("unknown"),
        F.count_if(known & (given > 0) & ~F.coalesce(allowed, F.lit(False))).alias("not_allowed"),
    )
    return out.withColumn("complete", (F.col("missing") + F.col("repeated") + F.col("unknown") + F.col("not_allowed")) == 0)


def turn(intent: Column, paper_id: Column, status: Column, search_value: Column) -> Column:
    """(intent, next_agent, error, allow_search) of a turn; errors end it."""
    known = F.when(intent.isin(*ROUTES), intent).otherwise("general")
    error = (
        F.when(status == "ambiguous", "PAPER_CONTEXT_AMBIGUOUS")
        .when((known == "analyze") & paper_id.isNull(), "NEED_PAPER_CONTEXT")
        .when((known == "search") & ((F.trim(F.coalesce(search_value, F.lit(""))) == "") | (F.length(search_value) > 200)), "INVALID_SEARCH_REQUEST")
    )
    route = F.lit("END")
    for k, v in ROUTES.items():
        route = F.when(known == k, v).otherwise(route)
    return F.struct(known.alias("intent"), F.when(error.isNull(), route).otherwise("END").alias("next_agent"), error.alias("error"), ((known == "search") & error.isNull()).alias("allow_search"))


def gate(verdict: Column, iteration: Column, most: int) -> Column:
    """retry while the evidence check asks for it and rounds are left, else pass."""
    return F.when((verdict == "retry") & (iteration < most), "retry").otherwise("pass")


def explicit_correction(message: Column) -> Column:
    """The research direction that a message states outright; null if it states none."""
    text = F.trim(message)
    found = F.trim(F.regexp_extract(text, CORRECTION, 1))
    says = F.lit(False)
    for w in CORRECTION_WORDS:
        says = says | F.contains(text, F.lit(w))
    return F.when(says & (found != ""), found)


def quota_finalised(jobs: DataFrame, kind: Column) -> DataFrame:
    """Jobs that wait although their error is no longer worth a retry have failed."""
    hit = (F.col("status") == "retry_wait") & (kind == "quota")
    return jobs.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error_kind": F.when(hit, "llm_quota_exhausted").otherwise(F.col("error_kind")), "next_attempt_at": F.when(hit, F.lit(None)).otherwise(F.col("next_attempt_at"))})


def rate_limit_revived(jobs: DataFrame, kind: Column, now: Column, version: int) -> DataFrame:
    """Jobs that rate limits used up run again, with the attempts given back; each once for a version.

    ``attempt_history`` holds (run_number, error_kind, attempt_refunded) entries.
    """
    hit = F.col("status").isin("failed", "retry_wait") & ~F.col("recovery_version").eqNullSafe(F.lit(version)) & ((F.col("error_kind") == "llm_rate_limited") | (kind == "rate_limit"))
    hit = F.coalesce(hit, F.lit(False))
    spent = F.size(F.filter(F.coalesce("attempt_history", F.array()), lambda h: (h["run_number"] == F.col("run_number")) & (h["error_kind"] == "llm_rate_limited") & ~F.coalesce(h["attempt_refunded"], F.lit(False))))
    refund = F.greatest(F.lit(1), spent)
    return jobs.withColumns({
        "status": F.when(hit, "retry_wait").otherwise(F.col("status")),
        "attempt_count": F.when(hit, F.greatest(F.lit(0), F.col("attempt_count") - refund)).otherwise(F.col("attempt_count")),
        "next_attempt_at": F.when(hit, now).otherwise(F.col("next_attempt_at")),
        "recovery_version": F.when(hit, F.lit(version)).otherwise(F.col("recovery_version")),
    })
