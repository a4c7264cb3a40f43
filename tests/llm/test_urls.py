from __future__ import annotations

import re

import numpy as np

from tierview.llm import queries, urls


def as_regex(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at])), at + 1
    return out


def test_automaton_agrees_with_regular_expressions():
    rng = np.random.default_rng(1)
    globs = ["".join(rng.choice(list("ab/.*?"), rng.integers(0, 12))) for _ in range(90)] + ["**", "*", "", "a" * 130 + "**"]
    texts = ["".join(rng.choice(list("ab/."), rng.integers(0, 14))) for _ in range(300)] + ["", "a" * 131]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = urls.Automaton(globs).matches(data, offsets)
    want = [[bool(re.fullmatch(as_regex(g), t, re.S)) for g in globs] for t in texts]
    assert got.tolist() == want


CASES = [
    (1, "http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://a.example.net/de?q=/en/", "a.example.net", "/de", "net/", "block"),
    (3, "https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    (4, "https://example.net", "example.net", "", None, "allow"),
    (5, "https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    (6, "https://x.org.com/a.net/", "x.org.com", "/a.net/", None, "allow"),
    (7, "https://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme/de/", "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "a://b://c.net/x", "b:", "//c.net/x", None, "allow"),
    (12, "http://ÄB.net/" + "é" * 5000, "Äb.net", "/" + "é" * 5000, "net/", "block"),
    (13, "http://m.casino-win.com/x", "m.casino-win.com", "/x", None, "block"),
]


def test_cases_and_clashing_names(spark):
    df = spark.createDataFrame([(c[0], c[1], "k", "r") for c in CASES] * 2, "page_id int, url string, k string, rule string")
    out = urls.judge_urls(df, "page_id", "url", queries.URL_RULES, queries.URL_GLOBS)
    got = sorted(tuple(r) for r in out.drop("glob").collect())
    assert got == sorted([c[:1] + c[2:] for c in CASES] * 2)
    assert urls.judge_urls(df.limit(0), "page_id", "url", queries.URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, "page_id", "url", []).collect()} == {"allow"}


