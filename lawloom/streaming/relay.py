"""Token streams: from a model's event lines to deltas, and back to whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import sse

_CHUNK = "choices array<struct<delta:struct<content:string>,finish_reason:string>>, error struct<message:string>"


def deltas(lines: DataFrame) -> DataFrame:
    """conv_id, seq, event, data of lines (conv_id, seq, line): delta, error or done; other lines give nothing. For tables and streams."""
    body = F.substring("line", 7, 1 << 30)
    parsed = lines.where(F.col("line").startswith("data: ")).select("conv_id", "seq", body.alias("body"), F.from_json(body, _CHUNK).alias("x"))
    first = F.get("x.choices", F.lit(0))
    event = (
        F.when(F.trim("body") == "[DONE]", "done")
        .when(F.col("x.error").isNotNull() | (first["finish_reason"] == "content_filter"), "error")
        .when(F.length(first["delta"]["content"]) > 0, "delta")
    )
    text = F.when(event == "delta", first["delta"]["content"]).when(event == "error", F.coalesce("x.error.message", F.lit("The answer was filtered.")))
    return parsed.select("conv_id", "seq", event.alias("event"), text.alias("data")).where("event is not null")


def events(rows: DataFrame) -> DataFrame:
    """The server-sent event of each row."""
    data = F.coalesce(F.to_json(F.struct(F.col("data").alias("text"))), F.lit("{}"))
    out = F.when(F.col("event") == "delta", sse("delta", data)).when(F.col("event") == "error", sse("error", data)).otherwise(sse("done", F.lit("{}")))
    return rows.select("conv_id", "seq", out.alias("sse"))


def answers(rows: DataFrame) -> DataFrame:
    """conv_id, answer, done, error: deltas in order of seq, as a client joins them."""
    parts = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "data"))))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(parts, lambda p: p["data"]), "").alias("answer"),
        F.bool_or(F.col("event") == "done").alias("done"), F.min_by("data", F.when(F.col("event") == "error", F.col("seq"))).alias("error"),
    )


def parse_events(text: DataFrame) -> DataFrame:
    """conv_id, seq, event, data of whole streams (conv_id, stream) cut at blank lines."""
    each = text.select("conv_id", F.posexplode(F.split("stream", "\n\n")).alias("seq", "one")).where("trim(one) <> ''")
    return each.select("conv_id", "seq", F.regexp_extract("one", r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract("one", r"(?m)^data: (.*)$", 1).alias("data"))
