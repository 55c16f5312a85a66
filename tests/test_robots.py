"""Robots access by prefixes against all pairs, merged parameter rules."""

import random
import re

from crawlframe.operators import site_files as S


def test_access_equals_all_pairs(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice(["a", "b", "c.d", "x+y", "*", "", "$"])
    value = lambda: "/" + "/".join(piece() for _ in range(rng.randint(1, 4))) + rng.choice(["", "$", "*"])
    hosts = {}
    for h in range(6):
        lines = []
        for agent in ("*", "googlebot", "GPTBot/1.0"):
            lines += [f"User-agent: {agent}", *(f"{rng.choice(['Allow', 'Disallow'])}: {value()}" for _ in range(rng.randint(0, 6)))]
        hosts[f"h{h}"] = "\n".join(lines)
    rules = S.directives(spark.createDataFrame(list(hosts.items()), "host string, text string"))
    paths = sorted({(h, "/" + "/".join(rng.choice(["a", "b", "c.d", "cxd", "x+y", ""]) for _ in range(rng.randint(1, 4)))) for h in [*hosts, "none"] for _ in range(40)})
    got = {(r.host, r.path, r.bot): r.rule for r in S.access(rules, spark.createDataFrame([("GoogleBot",), ("gptbot",), ("other",)], "bot string"), spark.createDataFrame(paths, "host string, path string")).collect()}
    rows = rules.collect()

    def fits(pattern, path):
        end = pattern.endswith("$")
        parts = [re.escape(x) for x in (pattern[:-1] if end else pattern).split("*")]
        return re.match(".*".join(parts) + ("$" if end else ""), path) is not None

    for (host, path, bot), rule in got.items():
        best = {}
        for r in rows:
            if r.host == host and r.key == "user-agent":
                ua, b = r.value.lower(), bot.lower()
                score = 1 if ua == "*" else 100 + len(ua) if ua == b else 60 + len(ua) if ua in b else 40 + len(b) if b in ua else None
                if score:
                    best[r.group_id] = max(best.get(r.group_id, 0), score)
        group = max(best, key=lambda g: (best[g], -g)) if best else None
        hits = [(len(r.value.replace("*", "")), r.key == "allow", r.value, f"{r.key} {r.value}") for r in rows if r.host == host and r.group_id == group and r.key in ("allow", "disallow") and r.value and fits(r.value, path)]
        assert rule == (max(hits)[3] if hits else ""), (host, path, bot)
    assert len(got) == 3 * len(paths)


def test_merged_parameters_cover_all_and_are_few(spark):
    text = "User-agent: Yandex\nClean-param: a&b /x\nClean-param: a /x/y\nClean-param: c /x/y\nClean-param: a&d\nClean-param: d /q\nClean-param: e=1 /x\nClean-param: " + "&".join(f"long{i:03}" for i in range(70)) + " /z"
    rules = S.directives(spark.createDataFrame([("h", text)], "host string, text string"))
    got = {r.rule: r.replaces for r in S.merged_params(rules).collect()}
    short = {k: v for k, v in got.items() if "long" not in k}
    assert short == {"Clean-param: a&d": "2,3,5,6", "Clean-param: b /x": "2", "Clean-param: c /x/y": "4"}
    long = [k for k in got if "long" in k]
    assert len(long) == 2 and all(len(k) - len("Clean-param: ") <= 500 for k in long) and {p for k in long for p in k.split()[1].split("&")} == {f"long{i:03}" for i in range(70)}
    issues = {(r.line, r.code) for r in S.clean_param_issues(rules).collect()}
    assert issues == {(7, "invalid_parameter"), (8, "too_long")}


def test_parameter_issues(spark):
    text = "User-agent: *\nClean-param: utm_source&gclid\nClean-param: & /x\nClean-param: a x\nClean-param: a /x?y\nClean-param: b\nClean-param: b"
    other = "User-agent: *\nDisallow: /a?b\nDisallow: /c=\nDisallow: /d?"
    rules = S.directives(spark.createDataFrame([("h", text), ("o", other), ("n", "Disallow: /")], "host string, text string"))
    issues = {(r.host, r.line, r.code) for r in S.clean_param_issues(rules).collect()}
    assert issues == {("h", 2, "tracking_only"), ("h", 3, "no_parameters"), ("h", 4, "path_without_slash"), ("h", 5, "path_with_query"), ("h", 6, "duplicate"), ("h", 0, "no_yandex_group"), ("o", 0, "parameters_disallowed")}
