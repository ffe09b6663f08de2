"""Reports on running pipelines: events, topology, logs, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import find_cuts, running_sum
from .staging import stage


def attribute_events(events: DataFrame, nodes: DataFrame, branch_nodes: DataFrame) -> DataFrame:
    """Bus events with their element's type, name and branch; events without an element stay."""
    known = nodes.select("element_id", "element_type", "name")
    return events.join(known, "element_id", "left").join(branch_nodes.select("element_id", "branch_id"), "element_id", "left")


def event_summary(events: DataFrame) -> DataFrame:
    """Per element: events by kind and the first error."""
    count = lambda k: F.count_if(F.col("event") == k).alias(f"n_{k.lower()}")
    return events.groupBy("element_id").agg(*map(count, ("Eos", "Error", "Dropped", "Seeked")), F.min(F.when(F.col("event") == "Error", F.col("at"))).alias("first_error_at"))


def topology_paths(nodes: DataFrame, edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(pipeline_id, path): every path from a root to a leaf as 'Type(name) - Type(name)'. A path
    visits no node twice, so cycles end; depth, not size, bounds the number of joins.

    Each depth is written and read back, so none is computed twice. Paths longer than ``most_depth``
    nodes, if that is set, are an error: none is left out.
    """
    n = nodes.select("pipeline_id", "id", F.concat("element_type", F.lit("("), "name", F.lit(")")).alias("text"))
    e = edges.select("pipeline_id", "from_id", "to_id").distinct()
    root = n.join(e.select("pipeline_id", F.col("to_id").alias("id")).distinct(), ["pipeline_id", "id"], "left_anti")
    inner = e.select("pipeline_id", F.col("from_id").alias("id")).distinct().withColumn("_inner", F.lit(True))
    known = stage(n.join(inner, ["pipeline_id", "id"], "left").select("pipeline_id", "id", "text", F.col("_inner").isNull().alias("leaf")), "nodes")
    steps = stage(e.join(known.withColumnsRenamed({"id": "to_id", "text": "to_text", "leaf": "to_leaf"}), ["pipeline_id", "to_id"]), "steps")
    now = stage(root.join(known.select("pipeline_id", "id", "leaf"), ["pipeline_id", "id"]).select("pipeline_id", "id", F.array("id").alias("seen"), "text", "leaf"), "paths")
    done, depth = now.where("leaf").select("pipeline_id", F.col("text").alias("path")), 1
    while not now.isEmpty():
        if most_depth is not None and depth > most_depth:
            raise ValueError(f"there are paths of more than {most_depth} nodes")
        grown = now.join(steps, (now["pipeline_id"] == steps["pipeline_id"]) & (now["id"] == steps["from_id"])).where(~F.array_contains("seen", F.col("to_id")))
        now = stage(grown.select(now["pipeline_id"], F.col("to_id").alias("id"), F.array_append("seen", F.col("to_id")).alias("seen"), F.concat_ws(" - ", "text", "to_text").alias("text"), F.col("to_leaf").alias("leaf")), "paths")
        done, depth = done.unionByName(now.where("leaf").select("pipeline_id", F.col("text").alias("path"))), depth + 1
    return done


_LINE = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}[+-]\d\d:\d\d) (\w+) \[thread=([^\]]*)\](?: \[pipeline_id=([^\]]*)\])? \[element=([^\]]*)\] \[name=([^\]]*)\] (.*)$"


def parse_logs(lines: DataFrame, most: int | None = None) -> DataFrame:
    """One row per record of log lines (file, line_no, line): its fields, and in body the lines that
    follow a header without one of their own (a topology drawing). Files of more than
    ``most`` lines are cut into pieces, which need not fit in one task. Lines before a file's first header
    belong to no record. A record's body is one text, so that it must fit in memory."""
    part = lambda i: F.regexp_extract("line", _LINE, i)
    rows = lines.withColumn("_h", F.col("line").rlike(_LINE)).withColumn("_one", F.col("_h").cast("bigint"))
    rows = running_sum(rows, "_one", ["file"], ["line_no"], "_rec", find_cuts(lines, ["file"], "line_no", most)).withColumn("_rec", F.col("_rec") + F.col("_one")).where("_rec > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "line"))))
    heads = rows.groupBy("file", "_rec").agg(F.max_by("line", "_h").alias("line"), F.min("line_no").alias("line_no"), F.concat_ws("\n", F.transform(body, lambda b: b["line"])).alias("body"))
    field = lambda name: F.nullif(F.regexp_extract("message", rf"(?:^| ){name}=(\S+)", 1), F.lit(""))
    parsed = heads.select("file", "line_no", F.to_timestamp(part(1), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("at"), part(2).alias("level"), part(3).alias("thread"), F.nullif(part(4), F.lit("")).alias("pipeline_id"), part(5).alias("element"), part(6).alias("name"), part(7).alias("message"), F.nullif("body", F.lit("")).alias("body"))
    return parsed.withColumns({c: field(c) for c in ("event", "control", "phase", "outcome", "error")})


def lifecycle(parsed: DataFrame) -> DataFrame:
    """Per file, element name and event or control: first received and completed, and the time
    between in ms; open where it never completed."""
    what = F.coalesce("control", "event")
    first = lambda p: F.min(F.when(F.col("phase") == p, F.unix_millis("at")))
    rows = parsed.where("event is not null").groupBy("file", "name", what.alias("what")).agg(first("received").alias("received"), first("completed").alias("completed"))
    took = F.when(F.col("completed") >= F.col("received"), F.col("completed") - F.col("received"))
    return rows.where("received is not null").withColumn("took_ms", took).withColumn("is_open", F.col("completed").isNull())


def trend_verdict(samples: DataFrame, warmup: int, limit: float) -> DataFrame:
    """Per label of a gauge (label, i from 1, value), after the warm-up: least-squares slope per
    step, its standard error, the growth that it can resolve, and the verdict."""
    s = samples.where(F.col("i") > warmup).withColumn("value", F.col("value").cast("double"))
    x, y = F.col("i").cast("double"), F.col("value")
    agg = s.groupBy("label").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    enough = F.col("n") >= 8
    se = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2)) / F.sqrt("sxx")
    out = agg.withColumn("standard_error", F.when(enough, se)).withColumn("slope", F.when(enough, F.col("slope")))
    out = out.withColumn("resolution", limit + 2 * F.col("standard_error"))
    verdict = F.when(~enough, "too_few").when(2 * F.col("standard_error") > limit, "too_noisy").when(F.col("slope") > limit, "growing").otherwise("flat")
    return out.select("label", "n", "slope", "standard_error", "resolution", verdict.alias("verdict"))
