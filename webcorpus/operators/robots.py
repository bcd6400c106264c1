"""Robots policies and the URLs they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.once import with_once
from ..functions.urls import robots_key, url_origin
from .skew import lookup_join

RULES = T.ArrayType(
    T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("prefix", T.StringType())])
)


def _quoted(path: Column) -> Column:
    """A rule's path, percent-decoded and re-encoded, as the keys are that it is compared with."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    encode = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    coded = F.transform(F.split(decoded, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9_.~/-]?$"), c).otherwise(encode(c)))
    return F.array_join(coded, "")


def _rules(body: Column) -> Column:
    """The rules of the first group that names agent ``*``, in file order.

    A fold over the lines. ``mode`` is 0 outside of groups, 1 among agents, 2
    among rules; an agent after rules, or a blank line after them, begins a new
    group; a blank line among agents drops them.
    """
    lines = F.split(F.coalesce(body, F.lit("")), "\r\n|\r|\n")
    none = F.array().cast(RULES)

    def step(state: Column, line: Column) -> Column:
        text = F.btrim(F.regexp_replace(line, "(?s)#.*", ""))
        name = F.lower(F.btrim(F.substring_index(text, ":", 1)))
        value = F.btrim(F.regexp_replace(text, "(?s)^[^:]*:", ""))
        named = F.contains(text, F.lit(":"))
        agent, rule = named & (name == "user-agent"), named & name.isin("allow", "disallow") & (state["mode"] > 0)
        timing = named & name.isin("crawl-delay", "request-rate") & (state["mode"] > 0)
        over = ((line == "") | agent) & (state["mode"] == 2)
        found = F.when(over & state["star"] & state["found"].isNull(), state["rules"]).otherwise(state["found"])
        reset = over | ((line == "") & (state["mode"] == 1))
        star = F.when(reset, F.lit(False)).otherwise(state["star"])
        one = F.struct(((name == "allow") | (value == "")).alias("allow"), _quoted(value).alias("prefix"))
        rules = F.when(reset, none).otherwise(state["rules"])
        return F.struct(
            F.when(agent, 1).when(rule | timing, 2).when(line == "", 0).otherwise(state["mode"]).alias("mode"),
            F.when(agent, star | (value == "*")).otherwise(star).alias("star"),
            F.when(rule, F.array_append(rules, one)).otherwise(rules).alias("rules"),
            found.alias("found"),
        )

    start = F.struct(F.lit(0).alias("mode"), F.lit(False).alias("star"), none.alias("rules"), F.lit(None).cast(RULES).alias("found"))
    last = lambda s: F.coalesce(s["found"], F.when((s["mode"] == 2) & s["star"], s["rules"]), none)
    return F.aggregate(lines, start, step, last)


def robots_policies(robots: DataFrame) -> DataFrame:
    """(origin, fetch_status, body) -> one policy per origin, for agent ``*``.

    ``deny_all`` for status 401, 403 and 5xx. No answer, or another 4xx, means
    no rules, which allows everything. The rules of one origin stay together in
    one row, in file order, so matching needs no aggregation.
    """
    status = F.col("fetch_status")
    return robots.select(
        "origin",
        F.coalesce(status.isin(401, 403) | (status >= 500), F.lit(False)).alias("deny_all"),
        F.when(status < 400, _rules(F.col("body"))).otherwise(F.lit(None).cast(RULES)).alias("rules"),
    )


def with_robots(urls: DataFrame, policies: DataFrame, url: str = "url", spread_by: str = "url") -> DataFrame:
    """Add ``allowed``: the first rule, in file order, whose prefix fits decides; none allows."""
    key = robots_key(F.col(url))
    matches = F.filter("rules", lambda r: (r["prefix"] == "*") | F.col("_key").startswith(r["prefix"]))
    joined = lookup_join(with_once(urls, origin=url_origin(F.col(url)), _key=key), policies, ["origin"], [spread_by])
    return joined.withColumn(
        "allowed",
        F.when(F.col("deny_all"), False).otherwise(F.coalesce(F.get(matches, F.lit(0))["allow"], F.lit(True))),
    ).drop("_key", "origin", "deny_all", "rules")
