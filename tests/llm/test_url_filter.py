import random
import re

from recollect.llm.url_filter import GlobAutomaton, split_url, url_filter

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_automaton_against_regex():
    rnd = random.Random(2)
    globs = ["*", "", "a", "*a", "a*", "*ab*", "a*b*c", "**b", "abc" * 30 + "*", "*b?a*", "*é*"]
    globs += ["".join(rnd.choice("ab*?") for _ in range(rnd.randint(1, 8))) for _ in range(40)]
    texts = ["", "a", "abc" * 31, "caféb", "x" * 500 + "ab"] + ["".join(rnd.choice("abc?") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    got = GlobAutomaton(globs).match([t.encode() for t in texts])
    for j, g in enumerate(globs):
        want = re.compile(".*".join(map(re.escape, g.split("*"))), re.S)
        assert [bool(want.fullmatch(t)) for t in texts] == got[:, j].tolist(), g


def test_split():
    assert split_url("http://Ex.COM/a/B?x#y") == ("ex.com", "/a/B")
    assert split_url("http://ex.com?x/y") == ("ex.com", "")
    assert split_url("http://ex.com#a?b") == ("ex.com", "")
    assert split_url("a://b://c/d") == ("b:", "//c/d")
    assert split_url(None) == split_url("ex.com/a") == split_url("") == ("", "")


def test_rules(spark):
    urls = {
        "http://a.example.net/en/1": ("example.net/en/", "allow"),
        "http://example.net/en/": ("example.net/en/", "allow"),
        "http://example.net/en": ("net/", "block"),
        "http://notexample.net/en/": ("net/", "block"),
        "http://example.net": (None, "allow"),
        "http://EXAMPLE.com/de/x": ("example.com/de/", "block"),
        "http://example.com/x/.example.net?/en/": (None, "allow"),
        "http://spam-farm.example.org/en/": (None, "block"),
        "http://spam-farm.example.org/fr/": ("org/fr/", "allow"),
        "http://org/fr/": ("org/fr/", "allow"),
        None: (None, "allow"),
        "": (None, "allow"),
        "http://a/" + "y" * 200_000 + "spam": (None, "block"),
    }
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(df, RULES, [("*spam*", "block")]).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter(df.limit(0), RULES, []).count() == 0


def test_repeated_rows_are_judged_alike(spark):
    df = spark.createDataFrame([(1, "http://x.net/a"), (1, "http://x.net/a"), (1, "http://x.org/a"), (None, None)], "page_id long, url string")
    got = sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in url_filter(df, RULES, []).collect())
    assert got == [(0, "", None, "allow"), (1, "x.net", "net/", "block"), (1, "x.net", "net/", "block"), (1, "x.org", None, "allow")]
