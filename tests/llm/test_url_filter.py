import random

from lattica.llm import url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/es/x"), ("allow", "a.example.org", "/e"), ("block", "com", "/de/"), ("allow", "com", "/de/"), (None, "net", "/"), ("block", "", "/z")]


def judge(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end], rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, h, p in RULES:
        if v and (host == h or host.endswith("." + h) and h) and path.startswith(p):
            key = (len(h) + len(p), len(h), v)
            best = max(best or key, key)
            if best == key:
                chosen = (h + p, v)
    return (host, path, *(chosen if best else (None, "allow")))


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SWEEP_URLS", 20)
    rng = random.Random(3)
    hosts = ["example.org", "A.example.ORG", "b.a.example.org", "notexample.org", "org", "x.com", "com", "net", "", "a..org", "." * 300 + "org", "münchen.org"]
    paths = ["", "/", "/es/", "/es/x1", "/es", "/de/1", "/de", "/z", "/é/ü", "/e", "/es/x" + "\U0010ffff"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#/de/'])}" for _ in range(600)]
    urls += [None, "", "org/es/", "://", "x://y", "https://example.org/es/"] + ["http://q.example.org/es/x"] * 40
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    none = url_filter.judge_urls(pages, rules.limit(0), default="block")
    assert none.where("verdict <> 'block' OR rule IS NOT NULL").count() == 0 and none.count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
