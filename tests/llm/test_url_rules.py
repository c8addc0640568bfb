from __future__ import annotations

import random

import pytest

from campaign_metrics.llm.queries import URL_RULES
from campaign_metrics.llm.url_rules import HostPathTrie, UrlRule, judge_urls


def plain(host, path, rules, default="allow"):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return None, default
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"))
    return best.host + best.path, best.verdict


@pytest.mark.parametrize("seed", range(5))
def test_trie_is_the_longest_rule(seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "y"]) for _ in range(rng.randint(0, 3)))
    rules = [UrlRule(host(), path(), rng.choice(["allow", "block"])) for _ in range(40)]
    trie = HostPathTrie(rules)
    for _ in range(400):
        h, p = host(), path()
        r = trie.find(h, p)
        assert (r and r.host + r.path, r.verdict if r else "allow") == plain(h, p, rules)


@pytest.mark.parametrize("shard", [1, 3, 1000])
def test_odd_urls_and_shards(spark, shard):
    urls = [None, "", "no scheme.net/", "http://", "http://A.Net", "http://a.net/?q", "https://www.EXAMPLE.net/en/x?y#z",
            "https://example.net/en", "https://badexample.net/en/", "x://y://net/", "http://example.com/de/a", "http://sub.org/fr/",
            "http://é.org/fr/ü", "https://" + "a." * 5000 + "net/" + "p/" * 5000, "http://a.net\n/x", "http://EXAMPLE.com/DE/"]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(0, None, "v"), (None, "http://a.net/", "v")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), URL_RULES, shard_rules=shard)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = []
    for i, u, _ in rows:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        p = rest[cut:].split("?")[0].split("#")[0]
        want.append((i, h, p, *plain(h, p, URL_RULES)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, r string"), [], "block").collect()} == {"block"}
