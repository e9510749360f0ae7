import random
import re
from datetime import datetime

from crawlweave.operators import robots


def verdicts(spark, body, paths, status=200, agent="Mozilla/5.0 test"):
    files = spark.createDataFrame([(1, "h", datetime(2024, 1, 1), status, body)],
                                  "robots_id long, host_key string, fetched_at timestamp_ntz, status int, body string")
    asks = spark.createDataFrame([(i, 1, p, False) for i, p in enumerate(paths)], "request_id int, robots_id long, path string, ignore_robots boolean")
    return [r.robots_verdict for r in robots.robots_gate(asks, files, agent).orderBy("request_id").collect()]


def test_plain_rules(spark):
    assert verdicts(spark, "User-agent: *\nDisallow: /private/", ["/page", "/private/secret", ""]) == ["allowed", "disallowed", "allowed"]


def test_status(spark):
    body = "User-agent: *\nDisallow: /"
    assert [verdicts(spark, body, ["/x"], status=s)[0] for s in (200, 404, 403, 401, 500, 301)] == [
        "disallowed", "allowed", "forbidden", "forbidden", "allowed", "allowed"]


def test_wildcards_and_length(spark):
    body = "User-agent: *\nDisallow: /*.html$\nDisallow: /a\nAllow: /a/b\nDisallow: /q*x*y$\nAllow: /t\nDisallow: /t"
    got = dict(zip(*(lambda p: (p, verdicts(spark, body, p)))(
        ["/i.html", "/i.html?x", "/a/c", "/a/b/c", "/q1x2y", "/q1x2yz", "/qxy", "/qx", "/t1", "/i.htmlx.html"])))
    assert got == {"/i.html": "disallowed", "/i.html?x": "allowed", "/a/c": "disallowed", "/a/b/c": "allowed", "/q1x2y": "disallowed",
                   "/q1x2yz": "allowed", "/qxy": "disallowed", "/qx": "allowed", "/t1": "allowed", "/i.htmlx.html": "disallowed"}


def test_agent_group(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: moz\nUser-agent: mozilla # longest\nDisallow: /m\n\nUser-agent: bot\nDisallow: /b"
    assert verdicts(spark, body, ["/x", "/m"]) == ["allowed", "disallowed"]
    assert verdicts(spark, body, ["/b", "/m"], agent="botty") == ["disallowed", "allowed"]
    assert verdicts(spark, body, ["/b"], agent="other") == ["disallowed"]
    # a winning group without rules allows everything
    assert verdicts(spark, "User-agent: *\nDisallow: /\nUser-agent: mozilla\nDisallow:", ["/x"]) == ["allowed"]


def test_many_stars_stay_cheap(spark):
    body = "User-agent: *\nDisallow: /" + "a*" * 40 + "b$"
    assert verdicts(spark, body, ["/" + "a" * 2000]) == ["allowed"]


def test_rules_rows(spark):
    files = spark.createDataFrame([(1, "h", 200, "Disallow: /0\r\nUser-Agent: A\r\nuser-agent: B\r\nALLOW: /x # c\r\nDisallow:\r\nUser-agent: C\r\nDisallow: /y")],
                                  "robots_id long, host_key string, status int, body string")
    rows = [(r.group_no, r.agents, r.rule_no, r.kind, r.pattern) for r in robots.robots_rules(files).orderBy("rule_no").collect()]
    assert rows == [(1, ["a", "b"], 3, "allow", "/x"), (2, ["c"], 6, "disallow", "/y")]


def plain_verdict(rules, path):
    """Every rule tried on the path."""
    best = (-1, True)
    for kind, pattern in rules:
        body, end = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
        if re.match(".*".join(re.escape(p) for p in body.split("*")) + end, path, re.S):
            best = max(best, (len(pattern), kind == "allow"))
    return "allowed" if best[1] else "disallowed"


def test_rule_tables_decide_as_all_rules_do(spark):
    rnd = random.Random(4)
    files = {0: [], 1: [("disallow", "/")], 2: [("disallow", "/a*c$"), ("allow", "/ab"), ("disallow", "/ab")]}
    for i in range(3, 40):
        files[i] = [(rnd.choice(["allow", "disallow"]), "/" + "".join(rnd.choice("ab/é*$" if i % 2 else "ab/é") for _ in range(rnd.randrange(6))))
                    for _ in range(rnd.choice([1, 5, 60]))]
    body = lambda rules: "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rules)
    snapshots = spark.createDataFrame([(i, f"h{i}", 200, body(r)) for i, r in files.items()], "robots_id long, host_key string, status int, body string")
    asked = [(n, i, "/" + "".join(rnd.choice("ab/é") for _ in range(rnd.randrange(8))), False) for n, i in enumerate(list(files) * 30)]
    asked += [(len(asked), 1, None, False), (len(asked) + 1, 1, "", False), (len(asked) + 2, None, "/", False)]
    requests = spark.createDataFrame(asked, "request_id long, robots_id long, path string, ignore_robots boolean")
    got = {r.request_id: r.robots_verdict for r in robots.robots_gate(requests, snapshots).collect()}
    for n, i, path, _ in asked:
        assert got[n] == ("allowed" if i is None or path is None else plain_verdict(files[i], path or "/")), (files.get(i), path)


def test_ten_thousand_rules_cost_a_path_its_length(spark):
    """The buckets of a large file hold a rule each on average, and repeated rules once."""
    rules = [f"Disallow: /p/{i:05d}" for i in range(10_000)] + ["Disallow: /same"] * 2_000
    snapshots = spark.createDataFrame([(1, "h", 200, "User-agent: *\n" + "\n".join(rules))], "robots_id long, host_key string, status int, body string")
    row = robots.rule_tables(snapshots).first()
    assert sorted(row.lengths) == [5, 8] and row.wild == []
    assert len(row.buckets) == 12_000 and sum(map(len, row.buckets)) == 10_001 and max(map(len, row.buckets)) < 12
