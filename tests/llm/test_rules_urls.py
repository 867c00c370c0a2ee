import re
from collections import Counter

from ridgeloom.llm import rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    words = WORD.findall(t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, places = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            places |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dups, len(places)


def test_measures_match_brute_force(spark):
    texts = [None, "", " ", "a", "a b a b a b a b", "x\x0by\x1cz w", "a b\n\na b\n \n \nc", "a b c a b c", "é#*ü |<>| é", "w " * 30000, "a b\ra b\ra b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'s' as source", "1 as n_words")
    got = {r.doc_id: tuple(r)[1:6] for r in rules.host_rules(docs).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "spam", "buy | now # " * 40) for i in range(40)] + [(100, "spam", good), (101, "fine", good), (102, None, good), (103, "fine", good)]
    rows += [(200 + i, "fine", good + f" tail{i}") for i in range(30)] + [(200, "fine", good)]
    got = rules.host_rules(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[100] and kept[101] and kept[102] and kept[200]


def test_rules_on_an_empty_table(spark):
    assert rules.host_rules(spark.createDataFrame([], "doc_id bigint, source string, text string")).collect() == []


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no-scheme.com/en/": ("", "", None),
        "http://A.COM/en/1": ("a.com", "/en/1", "com/en/"), "https://x.example.com/en/7?q=/es/": ("x.example.com", "/en/7", "example.com/en/7"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/"), "http://a.net/de/8#x": ("a.net", "/de/8", "net/de/"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8"), "ftp://org/es/": ("org", "/es/", "org/es/"),
        "http://a.org?/es/": ("a.org", "", None), "http://a.com\n/en/": ("a.com\n", "/en/", None), "http://É.com/x\ny?z": ("É.com", "/x\ny", None),
        "http://" + "a" * 5000: ("a" * 5000, "", None),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").selectExpr("*", "1 as host", "2 as rule")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))


def test_url_model_separates_unseen_urls(spark):
    bad = [f"https://{p}{h}.example.{t}/{la}/9{k}" for k, (p, h, t, la) in enumerate((p, h, t, la) for p in ("", "www.", "m.", "blog.") for h in ("casino-win", "spam-farm", "cheap-pills", "adult-x") for t, la in (("org", "de"), ("net", "fr")))]
    fine = [f"http://{p}{h}.example.{t}/fr/{k}" for k, (p, h, t) in enumerate((p, h, t) for p in ("", "www.", "m.", "blog.") for h in ("thering", "ththst", "tiontion", "thered") for t in ("org", "net"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + fine)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules=()).collect()}
    assert sum((got[i] == "block") == (i < len(bad)) for i in got) >= 0.95 * len(got)


def test_urls_repeated_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id bigint, url string")
    assert urls.judge(pages).count() == 3
    assert urls.judge(pages.limit(0)).collect() == []
