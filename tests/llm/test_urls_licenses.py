import math
import random
import time
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from meterloom.llm import licenses, urls


def plain_judgement(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for what, rule in urls.EXPLICIT:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best


def test_explicit_rules(spark):
    hosts = ["a.NET", "net", "x.example.net", "example.net", "example.com", "q.EXAMPLE.com", "notexample.com", "org", "w.org", "a.net:80", "É.net", ""]
    tails = ["", "/", "/en/", "/en", "/de/a?x#y", "/fr/1", "?q=/en/", "#/de/", "/en/\nx"]
    pages = [f"https://{h}{t}" for h in hosts for t in tails] + [None, "", "nourl", "a://b://c/d", "://x.net/"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(pages)], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in urls.url_filter(df, labels).collect():
        host, path, best = plain_judgement(pages[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((best[1], best[0]) if best else (None, "allow"))
    assert urls.url_filter(df.limit(0), labels).count() == 0


def test_mined_rules_block(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        host = f"{'casino' if bad and i % 2 else 'news' if rng.random() < 0.5 else 'blog'}.site{rng.randrange(40)}.info"
        path = f"/win/{i}" if bad and i % 2 == 0 else f"/read/{i}"
        if i % 7 == 3:
            path, host, bad = f"/win/{i}", f"sport.site{rng.randrange(40)}.info", False
        pages.append((i, f"http://{host}{path}"))
        if i < 1200:
            labels.append((i, 0 if bad else 1, 0))
    pages += [pages[0]] * 3
    out = {r["page_id"]: r for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i, u in pages:
        if "casino" in u:
            assert out[i]["verdict"] == "block"
        if "/read/" in u and "casino" not in u:
            assert out[i]["verdict"] == "allow"
        if "sport" in u:
            assert out[i]["verdict"] == "allow"


def plain_rules(rows, support, confidence, lift):
    """Every combination of tokens that a bad URL has."""
    total, bad = len(rows), [t for t, b in rows if b]
    rules = {}
    for x in {frozenset(c) for t in bad for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}:
        n, k = sum(x <= t for t, _ in rows), sum(x <= t for t in bad)
        p, z = k / n, 3.29
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if k >= max(support * total, urls.MIN_COUNT) - 0.5 and p >= confidence and low >= lift * len(bad) / total:
            rules[x] = p
    return {x: p for x, p in rules.items() if not any(y < x and q >= p for y, q in rules.items())}


def spelled(rules):
    """Each rule with each token of its classes."""
    return {frozenset(x): r["confidence"] for r in rules.collect() for x in product(*r["classes"])}


@pytest.mark.parametrize("share", [0.0, 0.1])
def test_tokens_that_go_together_equal_every_combination(spark, share):
    """Templates of several tokens, in good URLs too, or in bad ones only."""
    rng, rows = random.Random(4), []
    for i in range(400):
        kind = rng.random()
        if kind < 0.2:
            rows.append(("http://s.biz/win?a=1&b=2&c=3" + rng.choice(["&d=1", "", "&e=2"]), rng.random() >= share))
        else:
            rows.append((f"http://{rng.choice('xyz')}.org/{rng.choice(['read', 'now'])}" + ("/win" if kind > 0.9 else ""), rng.random() < 0.05))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = [(frozenset(r["t"]), r["bad"]) for r in df.select(urls.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    rules = urls.mined_rules(df)
    got, want = spelled(rules), plain_rules(tokens, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE, urls.MIN_LIFT)
    assert want and set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    more = spark.createDataFrame([("http://new.biz/x?c=9",), ("http://q.org/?b=1&d=2",), ("http://s.net/read",)], "url string")
    best = {r["url"]: r["confidence"] for r in urls.matched(more, rules).collect()}
    asked = [(r["url"], frozenset(r["t"])) for r in more.select("url", urls.tokens_of(F.col("url")).alias("t")).collect()]
    assert best == {u: pytest.approx(max(p for x, p in want.items() if x <= t)) for u, t in asked if any(x <= t for x in want)}


@pytest.mark.parametrize("good", [0, 4])
def test_a_campaign_of_many_tokens_ends(spark, good):
    template = "http://a.b.c.spam.biz/x/y/z?" + "&".join(f"k{chr(97 + i)}=1" for i in range(26))
    dropped = [template.replace(f"k{chr(97 + i % 26)}=1&", "") for i in range(60)] if not good else [template] * 60
    rows = [(u, True) for u in dropped] + [(template, False)] * good + [(f"http://ok.org/p{i}", False) for i in range(200)]
    began = time.time()
    rules = urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert time.time() - began < 60
    assert rules and all(len(r["tokens"]) == 1 for r in rules)
    assert sum(len(c) for r in rules for c in r["classes"]) >= 26


def test_mined_rules_equal_every_combination(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        host = rng.choice(["a.net", "b.net", "c.org"])
        path = "/".join(rng.sample(["x", "win", "play", "now", "read"], rng.randint(1, 4)))
        bad = rng.random() < (0.9 if "win" in path and "play" in path else 0.85 if host == "c.org" and "now" in path else 0.1)
        rows.append((f"http://{host}/{path}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = [(frozenset(r["t"]), r["bad"]) for r in df.select(urls.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    got = spelled(urls.mined_rules(df))
    want = plain_rules(tokens, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE, urls.MIN_LIFT)
    assert want and set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    best = {r["url"]: r["confidence"] for r in urls.matched(df, urls.mined_rules(df)).collect()}
    assert best == {u: pytest.approx(max(p for x, p in want.items() if x <= t)) for (u, _), (t, _) in zip(rows, tokens) if any(x <= t for x in want)}


EVERY = [(name, licenses.bigrams(licenses.words_of(x)), licenses.Template(name, x, 0.8, licenses.Counter())) for name, texts in licenses.TEMPLATES.items() for x in texts]


def brute_best(text, t=0.8):
    """The best stretch of lines of each template, every stretch tried."""
    lines = [licenses.words_of(x) for x in text.split("\n")]
    best = {}
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if lines[i] and lines[j]:
                words = [w for x in lines[i : j + 1] for w in x]
                own = licenses.bigrams(words)
                for name, b, template in EVERY:
                    d = licenses.dice(own, b)
                    if d >= t and template.fits(words):
                        best[name] = max(best.get(name, 0), d)
    return best


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [None, "", "license", "the MIT License", "K License"]
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = word()
            cut = sorted(rng.sample(range(1, len(w)), min(2, len(w) - 1)))
            lic = "\n".join(" ".join(p) for p in (w[: cut[0]], w[cut[0] : cut[-1]], w[cut[-1] :]) if p)
            texts.append("\n".join([" ".join(word() for _ in range(8)), "", lic.upper() if rng.random() < 0.3 else lic, " ".join(word() for _ in range(8))]))
    texts.append("Released under the MIT License.\n" + " ".join(word() for _ in range(30_000)) + "\nLicensed under CC BY-NC 4.0.")
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, dice double")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, t in enumerate(texts):
        want = brute_best(t or "")
        r = dict(zip(got[i]["licenses"], got[i]["dice"]))
        assert got[i]["n_licenses"] == len(r) and set(r) <= set(want)
        assert all(r[k] == pytest.approx(want[k]) for k in r)
        if want:
            assert max(r.values()) == pytest.approx(max(want.values()))
    assert got[len(texts) - 1]["licenses"] == ["CC-BY-NC-4.0", "MIT"]
    assert licenses.license_scan(df.limit(0)).count() == 0
