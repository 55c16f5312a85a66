"""robots.txt and sitemap operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
UNSUPPORTED = ["noindex", "nofollow", "noarchive"]
CHANGEFREQ = ["always", "hourly", "daily", "weekly", "monthly", "yearly", "never"]


def directives(robots: DataFrame) -> DataFrame:
    """``robots(host, text)`` -> ``(host, line, group_id, key, value)``; group 0 is before any user agent.

    Consecutive user-agent lines share a group; lines without a colon have the key ``syntax_error``.
    """
    lines = robots.select("host", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.select("host", (F.col("pos") + 1).alias("line"), F.trim("raw").alias("raw")).where("raw <> '' and not raw like '#%'")
    ok = F.instr("raw", ":") > 0
    d = lines.select("host", "line", F.when(ok, F.lower(F.trim(F.substring_index("raw", ":", 1)))).otherwise("syntax_error").alias("key"), F.when(ok, F.trim(F.expr("substring(raw, instr(raw, ':') + 1)"))).otherwise(F.col("raw")).alias("value"))
    w = Window.partitionBy("host").orderBy("line")
    valid = d.where("key <> 'syntax_error'")
    fresh = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    valid = valid.withColumn("fresh", fresh.cast("int")).withColumn("group_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = d.where("key = 'syntax_error'").withColumn("group_id", F.lit(None).cast("long"))
    return valid.select("host", "line", "group_id", "key", "value").unionByName(bad.select("host", "line", "group_id", "key", "value"))


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as a regular expression: ``*`` matches anything, a final ``$`` the end."""
    x = F.regexp_replace(pattern, r"([.+?()\[\]{}^|\\])", r"\\$1")
    x = F.regexp_replace(x, r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("^"), F.replace(x, F.lit("*"), F.lit(".*")))


def literal_head(pattern: Column) -> Column:
    """What stands before the first wildcard or end mark of a pattern."""
    return F.regexp_extract(pattern, r"^([^*$]*)", 1)


def under_heads(paths: DataFrame, heads: DataFrame) -> DataFrame:
    """``paths(host, path, ...)`` with ``head``: each prefix of a path that is as long as some head of its host.

    ``heads(host, head)`` are prefixes to be looked up by equality afterwards, so that no path meets all heads of its host. A
    host has few lengths of heads, whatever the number of its rules or paths.
    """
    lengths = heads.select("host", F.length("head").alias("n")).groupBy("host").agg(F.collect_set("n").alias("n"))
    fitting = F.explode(F.filter("n", lambda k: k <= F.length("path")))
    return paths.join(lengths, "host").select(*paths.columns, fitting.alias("n")).withColumn("head", F.expr("substring(path, 1, n)")).drop("n")


#: Bots that are asked for at once.
BOTS = 1000


def access(rules: DataFrame, bots: DataFrame, paths: DataFrame) -> DataFrame:
    """``(host, path, bot, allowed, rule)``: the group that fits the bot best, its longest matching pattern, allow on ties.

    ``bots(bot)`` is a list of BOTS at most. An empty disallow allows everything. Bots without a group may go anywhere. Rules are found
    by the literal beginning of their patterns, as in a prefix tree; only what follows a wildcard is matched as a pattern.
    """
    ua, bot = F.lower("value"), F.lower("bot")
    names = [r["bot"] for r in bots.select("bot").limit(BOTS + 1).collect()]
    if len(names) > BOTS:
        raise ValueError(f"more than {BOTS} bots")
    each = F.explode(F.array(*[F.lit(b) for b in names]).cast("array<string>"))
    agents = rules.where("key = 'user-agent' and value <> ''").select("host", "group_id", "value", each.alias("bot"))
    score = F.when(ua == "*", 1).when(ua == bot, 100 + F.length(ua)).when(F.contains(bot, ua), 60 + F.length(ua)).when(F.contains(ua, bot), 40 + F.length(bot))
    groups = agents.withColumn("score", score).where("score is not null").groupBy("host", "bot").agg(F.max_by("group_id", F.struct("score", -F.col("group_id"))).alias("group_id"))
    own = rules.where("key in ('allow', 'disallow') and value <> ''").select("host", "group_id", "key", "value", literal_head(F.col("value")).alias("head"), pattern_regex(F.col("value")).alias("rx"), F.length(F.replace("value", F.lit("*"), F.lit(""))).alias("n"))
    # A path is matched once with each rule that can fit, then given to the bots whose group has the rule.
    hits = under_heads(paths, own).join(own, ["host", "head"]).where((F.col("head") == F.col("value")) | F.expr("path rlike rx"))
    best = hits.groupBy("host", "path", "group_id").agg(F.max_by(F.struct("key", "value"), F.struct(F.col("n"), (F.col("key") == "allow"), "value")).alias("r"))
    best = best.join(groups, ["host", "group_id"]).select("host", "path", "bot", "r")
    every = paths.select("host", "path", each.alias("bot")).join(best, ["host", "path", "bot"], "left")
    return every.select("host", "path", "bot", (F.coalesce(F.col("r.key"), F.lit("allow")) == "allow").alias("allowed"), F.coalesce(F.concat_ws(" ", "r.key", "r.value"), F.lit("")).alias("rule"))


# Tokens that restrict what machines may do with a page, weights of visibility.
RESTRICTIVE = ["noindex", "none", "nosnippet", "max-snippet:0", "noai", "noimageai"]
MEASURED = {"gptbot": "gpt_chars", "chatgpt-user": "gpt_chars", "googlebot": "google_chars", "google-extended": "google_chars"}


def visibility(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(page_id, bot, access, directive_status, visibility, delta, risk)``.

    ``pages(page_id, host, path, robots, score, main_ratio, boilerplate, chars, js_risk, coverage, browser_chars, gpt_chars,
    google_chars)`` with ``allowed(host, path, bot, allowed)``. Robots rules block; restrictive tokens of the page leave it in
    part; what a bot of the ``MEASURED`` got of the text scales its visibility.
    """
    c = F.col
    base = c("score") * 0.45 + c("main_ratio") * 25.0 + (1.0 - F.least(F.lit(1.0), c("boilerplate"))) * 15.0 + F.least(F.lit(100.0), c("chars") / 18.0) * 0.15
    p = pages.withColumn("base", F.greatest(F.lit(0.0), F.least(F.lit(100.0), base)))
    tokens = F.lower("robots")
    p = p.withColumn("restricted", F.exists(F.array(*[F.lit(t) for t in RESTRICTIVE]), lambda t: F.contains(tokens, t)))
    j = p.join(allowed, ["host", "path"]).withColumn("name", F.lower("bot"))
    own = None
    for name, column in MEASURED.items():
        own = F.when(c("name") == name, c(column)) if own is None else own.when(c("name") == name, c(column))
    part = own / F.greatest(F.lit(1), c("browser_chars"), c("chars"))
    j = j.withColumn("ratio", F.when(own.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(1.2), part))))
    less = F.when(c("restricted"), 20.0).otherwise(0.0) + F.when(c("js_risk") == "high", 14.0).when(c("js_risk") == "medium", 7.0).otherwise(0.0)
    scale = F.coalesce("ratio", F.when(c("coverage") > 0, F.greatest(F.lit(0.6), F.least(F.lit(1.05), c("coverage") + 0.2))), F.lit(1.0))
    seen = F.when(~c("allowed"), 0.0).otherwise((c("base") - less) * scale)
    j = j.withColumn("visibility", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), seen)) * 100.0 + 0.5) / 100.0)
    return j.select(
        "page_id", "bot",
        F.when(~c("allowed"), "blocked").when(c("restricted"), "partial").otherwise("allowed").alias("access"),
        F.when(~c("allowed"), "blocked").when(c("restricted"), "restricted").otherwise("allowed").alias("directive_status"),
        "visibility",
        F.when(c("allowed") & c("ratio").isNotNull(), F.floor(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("ratio"))) * 10000.0 + 0.5) / 10000.0).alias("delta"),
        F.when(c("visibility") >= 75, "low").when(c("visibility") >= 45, "medium").otherwise("high").alias("risk"),
    )


# Parameters that a crawler leaves out by itself, characters of a rule.
TRACKING = ["ysclid", "yrclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "yclid", "gclid", "fbclid"]
RULE_CHARS = 500


def clean_params(rules: DataFrame) -> DataFrame:
    """``(host, line, raw, params, path)`` of the rules that name parameters without meaning; no path is the whole host."""
    raw = F.trim(F.regexp_replace("value", r"\s+", " "))
    r = rules.where("key = 'clean-param'").select("host", "line", raw.alias("raw")).where("raw <> ''")
    parts = F.split("raw", " ", 2)
    params = F.filter(F.split(parts[0], "&"), lambda p: p != "")
    return r.select("host", "line", "raw", params.alias("params"), F.coalesce(F.get(parts, 1), F.lit("")).alias("path"))


def clean_param_issues(rules: DataFrame) -> DataFrame:
    """``(host, line, code)``: what is wrong with a parameter rule; line 0 is the host as a whole."""
    r = clean_params(rules)
    copies = r.groupBy("host", "raw").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    odd = r"[?=/ &]"
    codes = [
        (F.length("raw") > RULE_CHARS, "too_long"),
        (F.size("params") == 0, "no_parameters"),
        (F.exists("params", lambda p: p.rlike(odd)), "invalid_parameter"),
        ((F.col("path") != "") & ~F.startswith("path", F.lit("/")), "path_without_slash"),
        (F.col("path").rlike("[?&]"), "path_with_query"),
        ((F.size("params") > 0) & F.forall("params", lambda p: F.lower(p).isin(*TRACKING)), "tracking_only"),
    ]
    each = r.select("host", "line", F.explode(F.array_compact(F.array(*[F.when(w, c) for w, c in codes]))).alias("code"))
    twice = copies.where("n > 1").select("host", "line", F.lit("duplicate").alias("code"))
    has = F.bool_or(F.col("key") == "clean-param")
    hosts = rules.groupBy("host").agg(
        has.alias("has"),
        F.bool_or((F.col("key") == "user-agent") & F.contains(F.lower("value"), F.lit("yandex"))).alias("yandex"),
        F.count_if((F.col("key") == "disallow") & F.col("value").rlike("[?=]")).alias("queries"),
    )
    code = F.when(F.col("has") & ~F.col("yandex"), "no_yandex_group").when(~F.col("has") & (F.col("queries") >= 3), "parameters_disallowed")
    return each.union(twice).union(hosts.select("host", F.lit(0).alias("line"), code.alias("code")).where("code is not null"))


def merged_params(rules: DataFrame) -> DataFrame:
    """``(host, path, rule, replaces)``: the fewest parameter rules that cover all of a host's, and the lines each replaces.

    Paths are prefixes. A parameter is folded upwards to the shortest of its paths that holds the path of a rule, and the
    parameters that come to one path make one rule, or several where one would be longer than a rule may be.
    """
    pairs = clean_params(rules).select("host", "line", "path", F.posexplode("params").alias("at", "param"))
    pairs = pairs.where(~F.col("param").rlike("[?=/ &]") & ((F.col("path") == "") | F.startswith("path", F.lit("/"))) & ~F.col("path").rlike("[?&]"))
    known = pairs.select("host", "param", F.col("path").alias("head")).distinct()
    up = under_heads(pairs, known.select("host", "head").distinct()).join(known, ["host", "param", "head"])
    up = up.groupBy("host", "line", "at", "param").agg(F.min_by("head", F.length("head")).alias("path"))
    g = up.groupBy("host", "path", "param").agg(F.min(F.struct("line", "at")).alias("first"), F.collect_set("line").alias("lines"))
    g = g.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("first", "param", "lines"))).alias("p"))
    room = RULE_CHARS - F.length("path") - 1
    empty = F.array().cast("array<struct<rule:string,lines:array<int>>>")
    start = F.struct(empty.alias("done"), F.lit("").alias("rule"), F.array().cast("array<int>").alias("lines"))

    def add(s: Column, x: Column) -> Column:
        more = F.when(s["rule"] == "", x["param"]).otherwise(F.concat(s["rule"], F.lit("&"), x["param"]))
        full = (s["rule"] != "") & (F.length(more) > room)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.struct(s["rule"].alias("rule"), s["lines"].alias("lines"))))).otherwise(s["done"]).alias("done"),
            F.when(full, x["param"]).otherwise(more).alias("rule"),
            F.when(full, x["lines"]).otherwise(F.array_union(s["lines"], x["lines"])).alias("lines"),
        )

    made = F.aggregate("p", start, add, lambda s: F.concat(s["done"], F.array(F.struct(s["rule"].alias("rule"), s["lines"].alias("lines")))))
    found = g.select("host", "path", F.explode(made).alias("r"))
    return found.select("host", "path", F.trim(F.concat_ws(" ", F.lit("Clean-param:"), "r.rule", "path")).alias("rule"), F.array_join(F.transform(F.array_sort("r.lines"), lambda x: x.cast("string")), ",").alias("replaces"))


def conflicts(rules: DataFrame) -> DataFrame:
    """Rules that stand twice for an agent, and paths both allowed and disallowed for it."""
    ua = rules.where("key = 'user-agent'").select("host", "group_id", F.lower("value").alias("agent"))
    r = rules.where("key in ('allow', 'disallow')").join(ua, ["host", "group_id"])
    g = r.groupBy("host", "agent", F.col("value").alias("path")).agg(F.count_if(F.col("key") == "allow").alias("allows"), F.count_if(F.col("key") == "disallow").alias("disallows"))
    kind = F.when((F.col("allows") > 0) & (F.col("disallows") > 0), "conflict").when((F.col("allows") > 1) | (F.col("disallows") > 1), "duplicate")
    return g.withColumn("kind", kind).where("kind is not null")


def lint(rules: DataFrame) -> DataFrame:
    """Per host: counts of what is wrong, and a score from 0 to 100."""
    c = F.col
    g = rules.groupBy("host").agg(
        F.count_if((c("key") == "disallow") & (c("value") == "/")).alias("global_blocks"),
        F.count_if(c("key") == "crawl-delay").alias("crawl_delays"),
        F.count_if(c("key").isin(*UNSUPPORTED)).alias("unsupported"),
        F.count_if(c("key") == "syntax_error").alias("syntax_errors"),
        F.count_if(c("key") == "sitemap").alias("sitemaps"),
        F.count_if(c("key").isin("allow", "disallow") & (c("value") != "") & ~c("value").startswith("/")).alias("bad_paths"),
    )
    score = 100 - 30 * F.least(c("global_blocks"), F.lit(1)) - 5 * c("crawl_delays") - 5 * c("unsupported") - 10 * c("syntax_errors") - F.when(c("sitemaps") == 0, 10).otherwise(0) - 5 * c("bad_paths")
    return g.withColumn("score", F.greatest(F.lit(0), score))


def sitemap_quality(urls: DataFrame, as_of: Column) -> DataFrame:
    """``urls(file, pos, loc, lastmod, changefreq, priority)`` -> defects per file and a score with capped penalties."""
    w = Window.partitionBy("loc")
    day = F.try_to_date(F.substring("lastmod", 1, 10), "yyyy-MM-dd")
    u = urls.withColumns({"copies": F.count("*").over(w), "day": day, "p": F.col("priority").try_cast("double")})
    c = F.col
    g = u.groupBy("file").agg(
        F.count("*").alias("urls"),
        F.count_if(~c("loc").rlike("^https?://")).alias("invalid"),
        F.count_if(c("copies") > 1).alias("duplicates"),
        F.count_if(F.coalesce(c("lastmod"), F.lit("")) == "").alias("missing_lastmod"),
        F.count_if((c("lastmod") != "") & c("day").isNull()).alias("bad_lastmod"),
        F.count_if(c("day") > as_of).alias("future"),
        F.count_if(F.datediff(as_of, c("day")) > 365).alias("stale"),
        F.count_if(~c("changefreq").isin(*CHANGEFREQ)).alias("bad_changefreq"),
        F.count_if(c("p").isNull() | (c("p") < 0) | (c("p") > 1)).alias("bad_priority"),
    )
    capped = sum([F.least(F.lit(20.0), c(x) / c("urls") * 100.0 * 0.5) for x in ("duplicates", "missing_lastmod", "bad_lastmod", "future", "bad_changefreq", "bad_priority")], F.least(F.lit(40.0), c("invalid") / c("urls") * 100.0))
    return g.withColumn("score", F.floor((100.0 - capped) * 10.0 + 0.5) / 10.0)


def first_file(urls: DataFrame) -> DataFrame:
    """The first file that holds each URL that stands in several places, and how many follow."""
    order = F.struct("file", "pos")
    g = urls.groupBy("loc").agg(F.min_by("file", order).alias("first_file"), (F.count("*") - 1).alias("later"))
    return g.where("later > 0")


def overlapping(rules: DataFrame) -> DataFrame:
    """``(host, agent, allow, disallow, allow_is_longer)``: paths of an agent of which one begins with the other."""
    ua = rules.where("key = 'user-agent'").select("host", "group_id", F.lower("value").alias("agent"))
    r = rules.where("key in ('allow', 'disallow') and value <> ''").join(ua, ["host", "group_id"])
    allow, disallow = (r.where(F.col("key") == k).select("host", "agent", F.col("value").alias(k)) for k in ("allow", "disallow"))
    j = allow.join(disallow, ["host", "agent"]).where("allow <> disallow and (startswith(disallow, allow) or startswith(allow, disallow))")
    return j.select("host", "agent", "allow", "disallow", F.startswith("allow", "disallow").alias("allow_is_longer")).distinct()


def missing_bots(rules: DataFrame, bots: list[str]) -> DataFrame:
    """``(host, bot)`` for bots that no user agent of a host names."""
    spoken = F.filter(F.array(*[F.lit(b) for b in bots]), lambda b: ~F.exists("agents", lambda a: F.contains(a, b)))
    g = rules.groupBy("host").agg(F.collect_set(F.when(F.col("key") == "user-agent", F.lower("value"))).alias("agents"))
    return g.select("host", F.explode(spoken).alias("bot"))


def uniform_lastmod(urls: DataFrame, least: int = 20, share: float = 0.9) -> DataFrame:
    """``(file, dated, most, uniform)``: how many urls of a file are dated, and how many by the most frequent date."""
    dated = urls.where(F.try_to_date(F.substring("lastmod", 1, 10), "yyyy-MM-dd").isNotNull()).groupBy("file", "lastmod").agg(F.count("*").alias("n"))
    g = dated.groupBy("file").agg(F.sum("n").alias("dated"), F.max("n").alias("most"))
    return g.withColumn("uniform", (F.col("dated") >= least) & (F.col("most") / F.col("dated") >= share))
