from hypothesis import given, settings, strategies as st

from msgshield.llm import urlrules


def plain(host, path, rules):
    fits = [(len(h) + len(p), a == "block", h + p, a) for h, p, a in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


label = st.sampled_from(["a", "b", "net", "x1"])
host = st.lists(label, min_size=1, max_size=4).map(".".join)
path = st.lists(st.sampled_from(["/", "a", "ab", "b", "/a/"]), max_size=5).map(lambda p: "/" + "".join(p))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(host | st.just(""), path, st.sampled_from(["allow", "block"])), max_size=8),
       st.lists(st.tuples(host, path | st.just("")), min_size=1, max_size=8))
def test_trie_equals_trying_every_rule(rules, urls):
    trie = urlrules.RuleTrie(rules)
    for h, p in urls:
        assert trie.match(h, p) == plain(h, p, rules)


def test_edges_and_several_tries(spark):
    urls = [None, "", "no scheme", "http://NET", "http://a.NET/", "https://www.example.net/en/1?x#y", "x://example.com/de/",
            "http://badexample.com/de/", "http://o.org/fr/a://b", "http://u@net:80/", "http://é.net/É", "a://b.org/fr", "://org/fr/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3] == ("net", "", None, "allow") and got[4] == ("a.net", "/", "net/", "block")
    assert got[5] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8] == ("o.org", "/fr/a://b", "org/fr/", "allow") and got[9][2:] == (None, "allow")
    assert got[10] == ("é.net", "/É", "net/", "block") and got[11][2] is None and got[12][2] == "org/fr/"
    split = urlrules.judge_urls(pages, max_rules=1).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in split] == got
    assert urlrules.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlrules.judge_urls(pages, rules=[]).collect()} == {"allow"}
