"""URL filters against regular expressions and plain loops."""

import random
import re

import pytest

from pagetide.llm import queries, urlfilter
from pagetide.llm.urlfilter import GLOBS, SITES, Automaton, Glob, Site

ODD = [
    None, "", "no scheme", "http://", "://", "http://ORG/", "http://org", "http://.org/", "http://x.org?y=/z.org/es/",
    "http://example.org/es/1", "http://A.Example.Org/es/", "http://example.org/en/12", "http://example.org/EN/1",
    "http://evil.net/x.example.org/es/", "http://sample.org/es/", "ftp://u@com:80/fr/", "http://a.com/fr", "http://a.com/de/#x",
    "http://a.com/fr/?q=http://b.com/de/", "http://a.net/print/about", "http://a.net/print/b", "http://a.net/jpeg.jpág",
    "http://ü.net/x.jp\U0001f600g", "http://a.net/a\nb/login", "http://spam.net/", "http://spam.net", "http://a.net/calendar/2024/x",
    "http://a.net/" + "x" * 5000 + ".pdf", "http://a.net/" + "y/" * 3000, "http://cheap-pills.net/x", "http://a.net/*/?", "http://a://b/login",
]


def expected(url, sites=SITES, globs=GLOBS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [s for s in sites if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
    if fits:
        best = min(fits, key=lambda s: (-len(s.name), s.name))
        return host, path, best.name, None, best.verdict
    regex = lambda g: "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|(?s:.)", g.pattern))
    hit = [g for g in globs if re.fullmatch(regex(g), host + path)]
    if not hit:
        return host, path, None, None, "allow"
    best = min(hit, key=lambda g: (-len(re.sub(r"[*?]", "", g.pattern)), g.pattern))
    return host, path, None, best.pattern, best.verdict


def judged(spark, urls, **rules):
    rows = [(i, u, "k", 1) for i, u in enumerate(urls)] + [(None, urls[0], "k", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, key string, verdict int").repartition(3)
    out = urlfilter.judge(frame, **rules)
    assert out.columns == ["page_id", "host", "path", "rule", "pattern", "verdict"]
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_odd_urls(spark):
    got = judged(spark, ODD)
    assert len(got) == len(ODD) + 1
    for i, url in enumerate(ODD):
        assert got[i] == expected(url), url
    empty = spark.createDataFrame([], "page_id string, url string")
    assert urlfilter.judge(empty).collect() == [] and urlfilter.judge(empty).schema["page_id"].dataType.simpleString() == "string"


def test_many_random_globs_in_several_words(spark):
    rng = random.Random(3)
    piece = lambda n: "".join(rng.choice("ab./") for _ in range(rng.randrange(1, n)))
    globs = tuple({Glob(rng.choice(["allow", "block"]), "".join(rng.choice(["*", "**", "?", piece(3), piece(5)]) for _ in range(rng.randrange(1, 6)))).pattern for _ in range(150)})
    globs = tuple(Glob(rng.choice(["allow", "block"]), p) for p in sorted(globs) if "***" not in p)
    sites = tuple(Site(v, h, p) for v, h, p in [("block", "a", "/"), ("allow", "b.a", "/b"), ("block", "a", "/b"), ("allow", "b", "")])
    assert Automaton((*sites, *globs)).words > 3
    urls = ["x://" + "".join(rng.choice("ab./?") for _ in range(rng.randrange(30))) for _ in range(400)]
    got = judged(spark, urls, sites=sites, globs=globs)
    for i, url in enumerate(urls):
        assert got[i] == expected(url, sites, globs), url


def test_long_and_short_urls_agree(monkeypatch):
    automaton = Automaton((*SITES, *GLOBS))
    texts = [("" if u is None else u.partition("://")[2]) for u in ODD]
    some = automaton.matches(texts)
    monkeypatch.setattr(urlfilter, "LONG", -1)
    assert (automaton.matches(texts) == some).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    out = queries.op13_url_filters(spark, f"/root/testdata/{sf}").collect()
    urls = {r[0]: r[1] for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").collect()}
    assert len(out) == len(urls)
    assert all(tuple(r)[1:] == expected(urls[r["page_id"]]) for r in out)
