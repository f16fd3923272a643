"""What goes in and out of an assistant: checked payloads, works a reader may use, event streams, reports and map data, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.access import work_access

# Longest list and text of a payload, modes, kinds of evaluation cases that are reserved, keys whose values are never shown.
LIST, TEXT, MODES, RESERVED = 100, 300, ("popular", "scientific"), "all"
SENSITIVE = r"(?i)pass(word|wd)?|secret|token|api[_-]?key|authorization|credential|cookie"
ADDRESS = r"(?i)\b(?:https?|postgres(?:ql)?|sqlite|mysql)://\S+"
REDACTED = "[redacted]"


def _kind(payload: Column, key: str) -> Column:
    """JSON kind of a key's value: string, number, boolean, array, object, null, or SQL null where the key is missing."""
    raw = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    text = F.to_json(raw)
    return (
        F.when(raw.isNull(), None)
        .when(text == "null", "null")
        .when(text.rlike('^"'), "string")
        .when(text.rlike(r"^\["), "array")
        .when(text.rlike(r"^\{"), "object")
        .when(text.isin("true", "false"), "boolean")
        .otherwise("number")
    )


def payload_fault(payload: Column) -> Column:
    """The first fault of a request's JSON, or null: object, question, authors, works, mode, flags, conversation_id, in this order."""
    parsed = F.try_parse_json(payload)
    faults = [F.when(parsed.isNull() | ~F.ltrim(payload).startswith("{"), "object"), F.when(~F.coalesce(_kind(payload, "question"), F.lit("string")).isin("string"), "question")]
    for key in ("authors", "works"):
        held = F.try_variant_get(parsed, f"$.{key}", "array<variant>")
        plain = F.forall(F.coalesce(held, F.array().cast("array<variant>")), lambda v: F.coalesce(F.to_json(v).startswith('"') & (F.length(F.try_variant_get(v, "$", "string")) <= TEXT), F.lit(False)))
        faults.append(F.when(_kind(payload, key).isNotNull() & ((_kind(payload, key) != "array") | (F.coalesce(F.size(held), F.lit(0)) > LIST) | ~plain), key))
    mode = _kind(payload, "mode")
    faults.append(F.when(mode.isNotNull() & (mode != "null") & ~((mode == "string") & F.try_variant_get(parsed, "$.mode", "string").isin(*MODES)), "mode"))
    faults += [F.when(~F.coalesce(_kind(payload, k), F.lit("null")).isin("boolean", "null"), k) for k in ("personal_only", "include_patristics", "include_ane")]
    number = F.to_json(F.try_variant_get(parsed, "$.conversation_id", "variant"))
    whole = number.rlike(r"^[0-9]{1,19}$") & (number.try_cast("decimal(20,0)") > 0) & (number.try_cast("decimal(20,0)") <= F.lit(2**63 - 1).cast("decimal(20,0)"))
    faults.append(F.when(~F.coalesce(_kind(payload, "conversation_id"), F.lit("null")).isin("null") & ~F.coalesce(whole, F.lit(False)), "conversation_id"))
    return F.coalesce(*faults)


def case_fault(case: DataFrame, task: str = "answer") -> Column:
    """The fault of an evaluation case (id, q, type, relevant, mode), or null: q, type, relevant, mode, id."""
    kind = F.coalesce("type", F.lit("pl"))
    labels = F.forall(F.coalesce("relevant", F.array().cast("array<string>")), lambda x: x.rlike(r"^0*[1-9][0-9]*:[0-9]+$"))
    return F.coalesce(
        F.when(F.trim(F.coalesce("q", F.lit(""))) == "", "q"),
        F.when((F.trim(kind) == "") | (F.lower(F.trim(kind)) == RESERVED), "type"),
        F.when(~labels | (F.lit(task == "retrieval") & (F.coalesce(F.size("relevant"), F.lit(0)) <= 0)), "relevant"),
        F.when(F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES), "mode"),
        F.when(F.col("id").isNotNull() & (F.trim("id") == ""), "id"),
    )


def usable_works(works: DataFrame, codes: list[str] | None, levels: list[str] | None) -> DataFrame:
    """``works`` (code, kind, access, ..) that a reader may use, with place: originals first, then by code. ``codes`` of None are all, [] none; unknown or closed ones are left out."""
    seen = works.filter(work_access(F.col("access"), F.col("code"), levels))
    if codes is not None:
        seen = seen.filter(F.col("code").isin(codes))
    return seen.withColumn("place", F.row_number().over(Window.orderBy(F.col("kind") != "original", "code")))  # a dimension


def still_usable(asked: DataFrame, works: DataFrame, levels: list[str] | None) -> DataFrame:
    """``asked`` (code, place) that may be used now, by ``works`` as they are, in their own order."""
    now = works.filter(work_access(F.col("access"), F.col("code"), levels)).select("code")
    return asked.join(F.broadcast(now), "code", "left_semi").orderBy("place")


def echo(message: Column) -> Column:
    """The answer that stands in where there is no model: how many numbered sources the message has, and the first one's mark."""
    n = F.size(F.regexp_extract_all(message, F.lit(r"(?m)^\[[0-9]+\] "), F.lit(0)))
    return F.concat(F.lit("[echo, no model] Found "), n.cast("string"), F.lit(" passages of literature"), F.when(n > 0, " [1]").otherwise(""), F.lit(" and verses of the corpus."))


def answer_events(answers: DataFrame) -> DataFrame:
    """answer_id, seq, event, data of ``answers`` (answer_id, sources, text, error): sources, then a delta a word, then done, or error in place of what follows the sources."""
    words = F.transform(F.split("text", " "), lambda w: F.struct(F.lit("delta").alias("event"), F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("content"))).alias("data")))
    first = F.array(F.struct(F.lit("sources").alias("event"), F.coalesce("sources", F.lit("[]")).alias("data")))
    last = F.array(F.struct(F.lit("done").alias("event"), F.lit("{}").alias("data")))
    failed = F.array(F.struct(F.lit("error").alias("event"), F.to_json(F.struct(F.col("error").alias("detail"))).alias("data")))
    every = F.concat(first, F.when(F.col("error").isNotNull(), failed).otherwise(F.concat(F.coalesce(words, F.array().cast("array<struct<event:string,data:string>>")), last)))
    return answers.select("answer_id", F.posexplode(every).alias("seq", "e")).select("answer_id", "seq", "e.event", "e.data")


def frame(event: Column, data: Column) -> Column:
    """One event as a frame of a server-sent stream; each line of its data is a data line."""
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def stream_end(body: Column) -> Column:
    """How a stream of server-sent events ended: complete (a DONE or a finish_reason), error (an error event or record), or early."""
    blocks = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: *", "")), "\n"))
    fault = F.exists(blocks, lambda b: b.rlike(r"(?m)^event: *error\s*$")) | F.exists(data, lambda d: F.coalesce(F.get_json_object(d, "$.error").isNotNull(), F.lit(False)))
    done = F.exists(data, lambda d: F.trim(d) == "[DONE]") | F.exists(data, lambda d: F.coalesce(F.get_json_object(d, "$.choices[0].finish_reason").isNotNull(), F.lit(False)))
    return F.when(fault, "error").when(done, "complete").otherwise("early")


def redacted(values: Column) -> Column:
    """A map of texts without values of sensitive keys and without values that hold an address."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SENSITIVE) | F.coalesce(v.rlike(ADDRESS), F.lit(False)), REDACTED).otherwise(v))


def without_addresses(text: Column) -> Column:
    """``text`` with its addresses alone taken out."""
    return F.regexp_replace(text, ADDRESS, REDACTED)


def report_cases(results: DataFrame) -> DataFrame:
    """id, type, metric, value of the finite metrics of ``results`` (id, type, metrics, error), and ``all`` besides each type; a failed case has none."""
    each = results.filter("error IS NULL").select("id", "type", F.explode("metrics").alias("metric", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return each.unionByName(each.withColumn("type", F.lit(RESERVED)))


def report_means(cases: DataFrame) -> DataFrame:
    """type, metric, mean, n of what ``report_cases`` gives; types without a metric have no row, which is not zero."""
    return cases.groupBy("type", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def map_places(places: DataFrame, locations: DataFrame) -> DataFrame:
    """place_id, json of the ``places`` (place_id, name, label, kind) that have ``locations`` (place_id, ord, lon, lat, confidence), these in order inside."""
    own = locations.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("ord", "lon", "lat", "confidence"))).alias("locations"))  # five a place at most
    inside = F.transform("locations", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), x["confidence"].alias("confidence")))
    named = places.join(own, "place_id")
    return named.select("place_id", F.to_json(F.struct(F.col("place_id").alias("id"), F.coalesce(F.nullif("label", F.lit("")), "name").alias("name"), F.col("name").alias("name_en"), "kind", inside.alias("locations"))).alias("json"))
