"""Robots files: status policy, rules as rows, and the verdict for a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.operators.spread import left_join_spread

from crawlweave.functions.times import US_PER_S
from crawlweave.operators.ordered import newest_within
from crawlweave.options import DEFAULTS

_LINE = r"\A[ \t]*([a-zA-Z\-]+)[ \t]*:[ \t]*(.*?)[ \t]*\z"


def status_policy(status: Column) -> Column:
    """forbidden, rules or allow; a file that could not be had allows everything."""
    return (
        F.when(status.isin(401, 403), "forbidden")
        .when(status.between(200, 299), "rules")
        .otherwise("allow")
    )


def robots_status(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("policy", status_policy(F.col("status")))


def _group_lines(snapshots: DataFrame) -> DataFrame:
    """One row per user-agent, allow or disallow line, with its group and the group's agents.

    A window partition is one robots file.
    """
    lines = (
        snapshots.where(status_policy(F.col("status")) == "rules")
        .select("robots_id", "host_key", F.posexplode(F.split(F.col("body"), "\r\n|\n|\r")).alias("line_no", "_line"))
        .withColumn("_line", F.regexp_replace("_line", r"(?s)#.*\z", ""))
        .select(
            "robots_id", "host_key", "line_no",
            F.lower(F.regexp_extract("_line", _LINE, 1)).alias("kind"),
            F.regexp_extract("_line", _LINE, 2).alias("value"),
        )
        .where(F.col("kind").isin("user-agent", "allow", "disallow"))
    )
    in_file = Window.partitionBy("robots_id").orderBy("line_no")
    starts = (F.col("kind") == "user-agent") & (
        F.coalesce(F.lag("kind").over(in_file), F.lit("")) != "user-agent"
    )
    in_group = Window.partitionBy("robots_id", "group_no")
    agent = F.when(F.col("kind") == "user-agent", F.lower("value"))
    return (
        lines.withColumn("_starts", starts.cast("int"))
        .withColumn("group_no", F.sum("_starts").over(in_file))
        .where("group_no > 0")
        .withColumn("agents", F.array_sort(F.collect_set(agent).over(in_group)))
    )


def robots_rules(snapshots: DataFrame) -> DataFrame:
    """One row per rule: robots_id, host_key, group_no, agents, rule_no (its line), kind, pattern."""
    return (
        _group_lines(snapshots)
        .where("kind <> 'user-agent' AND value <> ''")
        .select("robots_id", "host_key", "group_no", "agents", F.col("line_no").alias("rule_no"), "kind",
                F.col("value").alias("pattern"))
    )


def agent_rules(snapshots: DataFrame, agent: str = DEFAULTS.user_agent) -> DataFrame:
    """One row per robots_id with the rules that bind ``agent``, as an array.

    The group with the longest agent token that starts the agent's name wins, else ``*``; a
    winning group without rules allows everything.
    """
    name = F.lit(agent.lower())
    fit = F.array_max(
        F.transform(
            F.col("agents"),
            lambda a: F.when(a == "*", 0).when((a != "") & name.startswith(a), F.length(a)).otherwise(-1),
        )
    )
    in_file = Window.partitionBy("robots_id")
    return (
        _group_lines(snapshots)
        .withColumn("_fit", fit)
        .withColumn("_best", F.max("_fit").over(in_file))
        .where("_fit = _best AND _best >= 0 AND kind <> 'user-agent' AND value <> ''")
        .groupBy("robots_id")
        .agg(F.collect_list(F.struct(F.col("kind"), F.col("value").alias("pattern"))).alias("rules"))
    )


def pattern_matches(pattern: Column, path: Column) -> Column:
    """Prefix match with ``*`` and a closing ``$``.

    The pieces between stars are looked up from left to right, which takes linear time where a
    regular expression could backtrack.
    """
    anchored = pattern.endswith("$")
    body = F.regexp_replace(pattern, r"\$\z", "")
    pieces = F.split(body, r"\*", -1)
    first = F.get(pieces, 0)
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    last = F.element_at(pieces, -1)

    def advance(pos: Column, piece: Column) -> Column:
        at = F.call_function("locate", piece, path, pos)
        return F.when((pos == 0) | ((at == 0) & (piece != "")), F.lit(0)).when(piece == "", pos).otherwise(at + F.length(piece))

    start = F.when(path.startswith(first), F.length(first) + 1).otherwise(F.lit(0))
    found = F.aggregate(rest, start, advance) > 0
    # with an end anchor the last piece has to close the path without reaching back
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    upto = F.aggregate(inner, start, advance)
    closed = F.when(F.size(pieces) == 1, path == first).otherwise(
        (upto > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= upto)
    )
    plain = ~pattern.contains("*") & ~anchored
    return F.when(plain, path.startswith(pattern)).when(anchored, closed).otherwise(found)


def _longest(rules: Column) -> Column:
    """len and ok of the rule that decides among matching ones: the longest, allow wins a tie."""
    return F.array_max(F.transform(rules, lambda r: F.struct(F.length(r["pattern"]).alias("len"), r["ok"].alias("ok"))))


def _literal(pattern: Column) -> Column:
    return ~pattern.contains("*") & ~pattern.endswith("$")


def rule_tables(snapshots: DataFrame, agent: str = DEFAULTS.user_agent) -> DataFrame:
    """One row per robots_id with the rules that bind ``agent``, made to be looked up: wild, lengths, buckets.

    Rules without ``*`` and ``$`` match the paths they begin. They lie in ``buckets``, as many as there are such rules, by the hash
    of their pattern, and ``lengths`` are the lengths that occur, so a path asks for its beginnings of those lengths only. The
    others, in ``wild``, have to be tried one by one. All is worked out on the partitioning that put the files together.
    """
    rule = lambda r: F.struct(r["pattern"].alias("pattern"), (r["kind"] == "allow").alias("ok"))
    files = agent_rules(snapshots, agent).select(
        "robots_id",
        F.transform(F.filter("rules", lambda r: ~_literal(r["pattern"])), rule).alias("wild"),
        F.transform(F.filter("rules", lambda r: _literal(r["pattern"])), rule).alias("_literals"),
    )
    n = F.size("_literals")
    placed = F.transform("_literals", lambda r: F.struct(
        F.pmod(F.xxhash64(r["pattern"]), n).cast("int").alias("bucket"), r["pattern"].alias("pattern"), r["ok"].alias("ok")))
    # every bucket has a row, so that their array has no gaps
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(
        i.alias("bucket"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("boolean").alias("ok")))
    lengths = F.array_distinct(F.transform("_literals", lambda r: F.length(r["pattern"])))
    return (
        files.select("robots_id", "wild", lengths.alias("lengths"), F.posexplode(F.concat(placed, every)).alias("_at", "_r"))
        # one row of a file carries what belongs to the whole file
        .withColumn("wild", F.when(F.col("_at") == 0, F.col("wild"))).withColumn("lengths", F.when(F.col("_at") == 0, F.col("lengths")))
        .groupBy("robots_id", F.col("_r.bucket").alias("_bucket"), F.col("_r.pattern").alias("pattern"))
        .agg(F.max("_r.ok").alias("ok"), F.first("wild", True).alias("wild"), F.first("lengths", True).alias("lengths"))
        .groupBy("robots_id", "_bucket")
        .agg(F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("pattern", "ok"))).alias("_rules"),
             F.first("wild", True).alias("wild"), F.first("lengths", True).alias("lengths"))
        .groupBy("robots_id")
        .agg(F.sort_array(F.collect_list(F.struct("_bucket", "_rules"))).alias("_buckets"),
             F.first("wild", True).alias("wild"), F.first("lengths", True).alias("lengths"))
        .select("robots_id", "wild", "lengths", F.transform("_buckets", lambda x: x["_rules"]).alias("buckets"))
    )


def rule_verdict(wild: Column, lengths: Column, buckets: Column, path: Column) -> Column:
    """allow or disallow, by the columns of ``rule_tables``: the longest matching pattern decides, allow wins a tie."""

    def beginning(length: Column) -> Column:
        start = F.left(path, length)
        bucket = F.get(buckets, F.pmod(F.xxhash64(start), F.size(buckets)).cast("int"))
        return F.filter(bucket, lambda r: r["pattern"] == start)

    literal = F.flatten(F.transform(F.filter(lengths, lambda x: x <= F.length(path)), beginning))
    best = F.greatest(_longest(literal), _longest(F.filter(wild, lambda r: pattern_matches(r["pattern"], path))))
    return F.when(F.coalesce(best["ok"], F.lit(True)), "allow").otherwise("disallow")


def robots_asof(requests: DataFrame, snapshots: DataFrame, ttl_s: int = DEFAULTS.robots_ttl_s,
                newest=newest_within) -> DataFrame:
    """Add ``robots_id`` of the newest snapshot of the request's host younger than the TTL."""
    return newest(
        requests, snapshots, key="host_key", probe_ts="ts", mark_ts="fetched_at", mark_id="robots_id",
        ttl_us=ttl_s * US_PER_S, strict=True,
    ).withColumnRenamed("age_us", "robots_age_us")


def robots_gate(requests: DataFrame, snapshots: DataFrame, agent: str = DEFAULTS.user_agent) -> DataFrame:
    """Add ``robots_verdict``: allowed, disallowed or forbidden.

    ``requests`` has ``robots_id`` (null: no file known), ``path`` and ``ignore_robots``. The rules of
    a file come as one row, so the join keeps one row per request; a path costs its length, however many rules without
    ``*`` and ``$`` the file has, and one step for each of the others.
    """
    files = (
        robots_status(snapshots).select("robots_id", "policy")
        .join(rule_tables(snapshots, agent), "robots_id", "left")
    )
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    verdict = (
        F.when(F.col("ignore_robots"), "allowed")
        .when(F.col("policy") == "forbidden", "forbidden")
        .when((F.col("policy") == "rules") & F.col("buckets").isNotNull()
              & (rule_verdict(F.col("wild"), F.col("lengths"), F.col("buckets"), path) == "disallow"), "disallowed")
        .otherwise("allowed")
    )
    joined = left_join_spread(requests, files, "robots_id") if "request_id" in requests.columns else requests.join(files, "robots_id", "left")
    return joined.select(*requests.columns, verdict.alias("robots_verdict"))
