"""URL filter: rules indexed by their rarest literal token.

A rule is a host and a path prefix written together, such as ``example.com/en/7``. It fits a URL whose host is
that host or a subdomain of it and whose path starts with that path; of several that fit, the longest decides.
A host label of a rule, and a path segment closed by ``/``, must stand as a whole token in every URL that the
rule fits. Each rule is therefore filed under the one of these tokens that is rarest in the URLs at hand, the
tokens of a URL fetch its candidate rules, and only those run their regular expressions.

Everything is DataFrame functions. Up to ``MAP_RULES`` rules travel as a literal map inside the projection (no
shuffle at all); more are joined by token.

Defined results: a rule without a path fits all paths of its host; a rule without a host, or a null one, fits no URL;
a null URL, or one without ``://``, has an empty host and path and gets ``default``; repeated
rows are judged each; an empty table gives an empty result; other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, salted_join, settle

#: Rules that are held in a map literal; above it they are joined by token.
MAP_RULES = 64
#: Bytes of rule tokens that may be broadcast while tokens are counted.
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels and path segments."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def _with_tokens(rules: DataFrame) -> DataFrame:
    """rule, verdict -> rule, verdict, regex, token: a row for each literal token of a rule."""
    host = ascii_lower(F.substring_index("rule", "/", 1))
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    closed = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 2, F.lit(0)))
    quoted = F.regexp_replace(F.concat(host, path), r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    tokens = F.concat(
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(closed, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)),
    )
    # Without a path, the host must end where the rule's does.
    closing = F.when(path == "", F.lit(r"(?:/|\z)")).otherwise(F.lit(""))
    regex = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted, closing)
    return rules.where((host != "") & F.array_contains(F.transform(F.split(host, r"\."), lambda x: x != ""), True)).select("rule", "verdict", regex.alias("regex"), F.explode(tokens).alias("token"))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """token, rule, verdict, regex: each rule once, under its rarest token in urls (host, path)."""
    each = _with_tokens(rules)
    wanted = each.select("token").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0))).first()[0]
    seen = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = seen.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "token", "left_semi").groupBy("token").count()
    best = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token"))
    return each.join(counts, "token", "left").groupBy("rule", "verdict", "regex").agg(best.alias("token"))


def _longest(rules: Column) -> Column:
    """Of an array of (rule, verdict), the longest rule; block before allow for the same rule."""
    ranked = F.transform(rules, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict for every row of pages. rules: rule string, verdict string."""
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    index = settle(rule_index(parsed, rules), "rule-index")
    held = index.select("token", "rule", "verdict", "regex").limit(MAP_RULES + 1).collect()  # a bounded peek; it decides the way, and drops nothing
    if len(held) <= MAP_RULES:
        decided = parsed.withColumn("won", _longest(_by_map(held)) if held else F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    else:
        decided = _by_join(parsed, index)
    return decided.select(
        F.col("page_id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )


def _by_map(held: list) -> Column:
    """Array of the rules that fit, for host and path, through a literal map from tokens to rules."""
    by: dict[str, list] = {}
    for r in sorted(held):
        by.setdefault(r["token"], []).append(F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["verdict"]).alias("verdict"), F.lit(r["regex"]).alias("regex")))
    index = F.create_map(*(x for token, rows in by.items() for x in (F.lit(token), F.array(*rows))))
    known = F.array(*(F.lit(t) for t in by))
    hits = F.array_intersect(url_tokens(F.col("host"), F.col("path")), known)
    candidates = F.flatten(F.transform(hits, lambda t: F.element_at(index, t)))
    return F.filter(candidates, lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))


def _by_join(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """The same for many rules: each different host and path once, joined to the rules by token; frequent tokens are salted."""
    keys = settle(parsed.select("host", "path").distinct(), "url-parts")
    met = keys.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(index.select("token").distinct(), "token", "left_semi")
    won = (
        salted_join(met, index, ["token"])
        .where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("won"))
    )
    return salted_join(parsed, won, ["host", "path"], "left")
