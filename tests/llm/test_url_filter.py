"""Urls, rules, splits of names and the classifier, against plain Python."""

import itertools
import math
import re
from collections import Counter

import pytest

from graphloom.llm import url_filter

SCHEMA = "page_id long, url string, html string, host int, verdict string"
HTML = "<html><p class='cheap'>cheap pills online and free games for the win</p> the spam farm of the year</html>"
ROWS = [
    (1, "https://www.CheapPills.example.com/en/1?x=1"), (2, "http://cheap-pills.example.com"), (3, "http://online.example.org/pills/7"), (4, "http://a.net/en/2"), (5, "http://b.example.net/en/3#x"),
    (6, "http://example.net/en"), (7, "http://xnet/q"), (8, "https://shop.example.com/de/1.html"), (9, "https://forexample.com/de/1"), (10, "http://u.org/fr/"), (11, None), (12, ""), (13, "no scheme"), (14, "://"),
    (15, "ftp://h?q/en/"), (16, "a://b://c/d"), (1, "https://www.CheapPills.example.com/en/1?x=1"), (None, "http://The-Year.example.com/en/ÜBER"), (18, "http://spamfarm.com/en/2"), (19, "http://freegames.com/en/3"), (20, "http://net/"), (21, "http://net"),
    (22, f"http://{'long' * 20}.com/{'deep/' * 5000}"), *((100 + i, f"http://theyear{i}.com/en/{i}") for i in range(40)),
]


def parsed(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [(r, v) for r, v in url_filter.RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def judged(rows):
    """The same model by loops; splits by trying all."""
    words = Counter(w for _, _, html in rows for w in re.findall(r"[^\W\d_]{2,}", re.sub("<[^>]*>", " ", html or "").lower())) + Counter(url_filter.SEEDS)
    total = sum(words.values())
    p = lambda w: math.log(words[w] / total) if w in words else math.log(10 / total) - len(w) * math.log(10)

    def split(run):
        if len(run) > 63:
            return [run]
        best = {0: (0.0, [])}
        for j in range(1, len(run) + 1):
            best[j] = max(((best[i][0] + p(run[i:j]), best[i][1] + [run[i:j]]) for i in range(max(0, j - 24), j)), key=lambda x: x[0])
        return best[len(run)][1]

    pages = []
    for i, url, _ in rows:
        host, path = parsed(url)
        w = [x for run in re.findall(r"[^\W\d_]+|[0-9]+", host) for x in (["0"] if run[0].isdigit() else split(run))]
        tokens = ["0" if x[0].isdigit() else x for x in re.findall(r"[^\W\d_]+|[0-9]+", path.lower())]
        pages.append((i, host, path, w, set(w + tokens), any(x in url_filter.SEEDS for x in w)))
    c = {x: Counter(t for *_, tokens, b in pages if b == x for t in tokens) for x in (True, False)}
    kinds, n = len(c[True] | c[False]), Counter(b for *_, b in pages)
    part = lambda t, x: math.log((c[x][t] + 0.1) / (sum(c[x].values()) + 0.1 * kinds))
    for i, host, path, w, tokens, _ in pages:
        odds = math.log((n[True] + 1) / (n[False] + 1)) + sum(part(t, True) - part(t, False) for t in tokens)
        rule, says = rule_of(host, path)
        yield i, host, path, rule, says or ("block" if odds > 0 and n[True] else "allow"), " ".join(w), round(odds, 6)


def test_best_split_against_all_splits():
    counts = {"the": 50.0, "he": 9.0, "rapist": 2.0, "therapist": 3.0, "t": 4.0, "rap": 5.0, "is": 30.0}
    total = 1000.0
    p = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
    for run in ("therapist", "theisthe", "xqz", "heist", "t", "rapistheis"):
        splits = []
        for cuts in itertools.product((0, 1), repeat=len(run) - 1):
            splits.append("".join(c + " " * k for c, k in zip(run, (*cuts, 0))).split())
        got = url_filter.best_split(run, counts, total)
        assert "".join(got) == run and sum(map(p, got)) == pytest.approx(max(sum(map(p, s)) for s in splits))


def test_verdicts(spark):
    rows = [(i, u, None if k == 5 else HTML) for k, (i, u) in enumerate(ROWS)]
    got = url_filter.judged_urls(spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA)).collect()
    want = list(judged(rows))
    assert sorted(repr((*list(r)[:6], round(r.log_odds, 6))) for r in got) == sorted(map(repr, want))
    verdict = {r.page_id: r.verdict for r in got}
    assert {verdict[i] for i in (1, 2, 18)} == {"block"} and {verdict[i] for i in (7, 9, 11, 12, 13, 19, 100, 139)} == {"allow"}
    assert "cheap pills" in next(r.host_words for r in got if r.page_id == 1)


def test_no_rows_and_no_seeds(spark):
    assert url_filter.judged_urls(spark.createDataFrame([], SCHEMA)).collect() == []
    got = url_filter.judged_urls(spark.createDataFrame([(1, "http://a.com/x", None, 1, "y"), (2, None, None, 1, "y")], SCHEMA)).collect()
    assert {r.verdict for r in got} == {"allow"}
