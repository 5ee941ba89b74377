"""URL rules against brute force, and the model on words that its table doesn't hold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pulsegrid.llm import url_filter as uf
from pulsegrid.llm.queries import URL_RULES


def brute(url: str | None) -> tuple[str, str, str | None, str | None]:
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[:0:-1] if fits else (None, None)))


def test_rules_equal_brute_force_on_urls_of_all_shapes(spark):
    rng = random.Random(3)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "notexample.org", "x.com", "com", "org", "org.net", "", "ex.ORG.", "é.com"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/", "/de/x", "/DE/", "/fr"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/de/', '#x', '?', '/?a://b'])}" for _ in range(400)]
    urls += [None, "", "no url", "http:/x.com/de/", "http://x.com" + "/de/" * 100_000, "http://" + "a" * 200_000 + ".com/fr/"] + urls[:50]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *(F.lit("own").alias(c) for c in ("host", "path", "rule", "verdict", "score", "k0", "t")))
    got = {r.page_id: r for r in uf.judge(df, URL_RULES, ["page_id"]).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert verdict in (None, got[i].verdict) and got[i].verdict in ("allow", "block")


def test_words_that_the_table_does_not_hold():
    """Compounds of unwanted words, against ordinary words and names of no meaning."""
    model = uf.Regression.fit(uf.labelled_urls())
    score = lambda w: model.score(*uf.split_url(f"http://{w}.example.net/en/12".encode()))
    bad = ["mega-casino-bonus", "discount-viagra", "xxxvideos", "casinoroyal", "pokerstar", "sexchat", "pornhost", "malwarebox", "spammers", "payday-loans-fast", "online-gambling-tips", "buy-pills-now"]
    fine = ["heidelberg", "antarctica", "cathedral", "lighthouse", "orchestra", "zebra", "palabra", "montagne", "keyboard", "wednesday", "seventeen", "aqueduct", "porcelain", "umbrella", "thunder", "bundestag"]
    fine += uf.made_up_names(60, seed=99)
    assert not {*bad, *fine} & {*uf.UNWANTED, *uf.WANTED}
    assert sum(score(w) >= 0.5 for w in bad) >= 0.8 * len(bad)
    assert sum(score(w) < 0.5 for w in fine) >= 0.95 * len(fine)
