import random

from quarryline.llm.url_filter import RULES, RuleIndex, mine_rules, prune_rules, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url):
    i = (url or "").find("://")
    if i < 0:
        return "", "", None, None
    rest = url[i + 3 :]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut].translate(LOWER), rest[cut:]
    path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    name, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, name, verdict


def check(df):
    rows = sorted(url_filter(df).collect(), key=repr)
    assert len(rows) == df.count()
    want = {}
    for r in df.collect():
        want.setdefault(r.page_id, set()).add(brute(r.url))
    for r in rows:
        w = next(x for x in want[r.page_id] if x[:3] == (r.host, r.path, r.rule))
        assert r.verdict == w[3] or (w[3] is None and r.verdict in ("allow", "block"))
    return rows


def test_pages(spark, sf):
    rows = check(spark.read.parquet(f"{sf}/pages.parquet"))
    assert any(r.mined for r in rows)


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/", "https://www.example.com/en/x?y#z", "http://a.b.net/es/", "http://net/fr/", "http://x.net/es", "http://evilexample.com/en/", "http://example.com?x=/en/", "http://h.com#f/en/", "a://b://c.com/", "http://É.COM/x", "x?u=http://example.com/en/q", "http://xcom/", "http://u:p@example.com:80/en/"]
    schema = "page_id bigint, url string, host string, tokens int, verdict string"
    df = spark.createDataFrame([(i if i != 3 else None, u, "h", 1, "v") for i, u in enumerate(urls + urls[:4])], schema)
    check(df)
    assert url_filter(df.where("page_id > 999")).collect() == []


def test_mined_rules_equal_counts(spark):
    """Confidence and support of every mined rule, counted again."""
    rows = [(["a", "b"], "block"), (["a", "b"], "block"), (["a"], "block"), (["a", "c"], "allow"), (["c"], "allow"), (["c", "d"], "allow")] * 5
    rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.7)
    assert rules
    for tokens, verdict, confidence, support in rules:
        held = [v for t, v in rows if set(tokens) <= set(t)]
        assert abs(confidence - held.count(verdict) / len(held)) < 1e-9 and abs(support - held.count(verdict) / len(rows)) < 1e-9
    assert {(t, v) for t, v, _, _ in rules} == {(("a",), "block"), (("b",), "block"), (("c",), "allow"), (("d",), "allow")}


def test_pruning_and_index():
    rules = [(("a",), "block", 0.9, 0.5), (("a", "b"), "block", 0.9, 0.2), (("a", "b"), "allow", 0.95, 0.1), (("c", "d"), "block", 1.0, 0.1)]
    kept = prune_rules(rules)
    assert (("a", "b"), "block", 0.9, 0.2) not in kept and len(kept) == 3
    index = RuleIndex(kept)
    assert index.verdict(["a", "b"]) == "allow" and index.verdict(["a"]) == "block" and index.verdict(["c"]) is None and index.verdict(["d", "c"]) == "block"


def test_tokens_mined_as_one_give_the_rules_of_mining_them_apart(spark):
    from itertools import combinations

    rng = random.Random(3)
    rows = []
    for _ in range(300):
        t = set(rng.sample("abcdef", rng.randint(0, 4)))
        t |= {"g", "h"} if "a" in t else set()
        t |= {"i"} if "b" in t else set()
        rows.append((sorted(t), "block" if "b" in t and rng.random() < 0.9 else "allow"))
    rules = []
    every = sorted({t for ts, _ in rows for t in ts})
    for k in range(1, len(every) + 1):
        for c in combinations(every, k):
            holds = [v for ts, v in rows if set(c) <= set(ts)]
            for v in ("allow", "block"):
                if holds and holds.count(v) >= 0.02 * len(rows) and holds.count(v) / len(holds) >= 0.6:
                    rules.append((c, v, holds.count(v) / len(holds), holds.count(v) / len(rows)))
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.6)
    want = prune_rules(rules)
    assert [r[:2] for r in got] == [r[:2] for r in want] and any("g" in r[0] for r in got)
    assert all(abs(a[2] - b[2]) < 1e-9 and abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_a_template_of_many_tokens_is_mined(spark):
    rows = [([f"t{k}" for k in range(60)], "block")] * 20 + [(["x"], "allow")] * 80
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.8)
    assert sorted(r[0] for r in got) == sorted([("x",), *[(f"t{k}",) for k in range(60)]])
