import math
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np

from tessera.llm import language_id as L
from tessera.llm import queries
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def test_pages_by_their_address(spark):
    urls = {r["page_id"]: r["url"] for r in table(spark, SF, "pages").collect()}
    rows = queries.op9_language_id(spark, SF).collect()
    assert len(rows) == len(urls)
    right = [r["lang"] == urls[r["page_id"]].split("/")[3] for r in rows]
    assert np.mean(right) >= 0.97
    assert all(0 < r["confidence"] <= 1 for r in rows)


DOCS = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de")] * 20)] + [(99, "x", None), (None, None, "fr")]


def test_against_plain_formula(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    rows = [(i, f"http://{h}/", f'<html lang="{d}"><p>{t}</p>') for i, (h, d, t) in enumerate([("a.x.de", "de", "der hund"), ("a.x.de", "de", "und die katze"), ("a.x.de", "en", ""), ("b.x.de", "", "the dog of"), ("c.com", "en", "the house"), ("c.com", "en", "und"), ("", "", "")])]
    rows += [(None, None, None), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "page_id long, url string, html string, lang string, confidence double")
    out = L.identify_languages(pages, docs).collect()
    model = L.fit_text(docs)
    assert model.languages == ["de", "en"]
    ev = []
    for k, url, page in rows:
        host = url.split("/")[2] if url else ""
        ll = model.likelihoods(L.visible_text(page))
        ev.append((k, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], L.declared_language(page) or "", ll, L._softmax(ll)))
    total = sum(e[6] for e in ev) + 1
    share = total / total.sum()
    s = L.SMOOTHING
    want = []
    for i, e in enumerate(ev):
        own = lambda k: sum((o[6] for j, o in enumerate(ev) if j != i and o[k] == e[k]), np.zeros(2))  # noqa: B023, E731
        domain = (own(2) + s * share) / (own(2).sum() + s)
        z = e[5] + np.log((own(1) + s * domain) / (own(1).sum() + s))
        for k in (3, 4):
            if e[k]:
                z = z + np.log((own(k) + s * share) / total)
        want.append((e[0], model.languages[int(z.argmax())], round(float(L._softmax(z).max()), 6)))
    assert sorted(((r["page_id"], r["lang"], round(r["confidence"], 6)) for r in out), key=str) == sorted(want, key=str)


def test_edges(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "u", "<html lang=en>x")], "page_id long, url string, html string")
    assert L.identify_languages(pages.limit(0), docs).count() == 0
    (r,) = L.identify_languages(pages, docs.limit(0)).collect()
    assert (r["lang"], r["confidence"], r["declared_lang"]) == (None, 0.0, "en")
    assert L.declared_language('<HTML class=a\nLANG = "de-AT">') == "de" and L.declared_language("<p lang=fr>") is None
    assert L.visible_text("<p>a&amp;b<script>x<y</script><!-- c --></p>").split() == ["a&b"]


def test_declared_after_a_preamble(spark):
    for preamble in ("<!-- " + "licence <html lang=fr> " * 400 + "-->", "\n" * 5000, "<!DOCTYPE html [" + "<!ENTITY a 'b'>" * 400 + "]>"):
        page = preamble + '<html class="a" lang="de-AT"><p>x'
        assert len(preamble) > 4096 and L.declared_language(page) == "de"
        (r,) = L.identify_languages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), spark.createDataFrame(DOCS, "doc_id long, text string, lang string")).collect()
        assert r["declared_lang"] == "de"
    assert L.declared_language("<!-- open <html lang=de>") is None and L.declared_language("<html><pre><html lang=de>") is None


def test_hostile_markup_takes_linear_time():
    for bit in ("<!--", "<", "<script", "<nav", "</nav", "<nav></nav", "&#", "&#" + "1" * 5000, "<a ", "-->", "<script><!--", "<html lang=" + " " * 1000, " lang", "<p", "<style></style "):
        page = "x" + bit * (1_000_000 // len(bit))
        start = time.perf_counter()
        L.visible_text(page)
        L.declared_language(page)
        assert time.perf_counter() - start < 5, bit
    assert L.visible_text("a<!-- b") == "a " and L.visible_text("a<nav>b") == "a b" and L.visible_text("a<script>b") == "a "
    assert L.visible_text("1 < 2 <b>c</b><") == "1 < 2  c <" and L.visible_text("a <b") == "a <b"
    assert L.visible_text("a<NAV x>b<i></i></NAV >c</nav><navy>d") == "a c  d"
    assert L.visible_text("&#" + "9" * 5000 + ";&#x41;&lt;") == "\ufffdA<"


class Page(HTMLParser):
    """Text and declared language by the standard library's parser."""

    HIDDEN = ("script", "style", "template", "noscript", "nav", "footer", "header", "aside")

    def __init__(self, page):
        super().__init__()
        self.within, self.data, self.lang, self.seen = None, [], None, False
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "html" and not self.seen:
            self.seen = True
            lang = dict(attrs).get("lang") or dict(attrs).get("xml:lang")
            self.lang = lang.strip().split("-")[0].lower() if lang and lang.strip() else None
        if self.within is None and tag in self.HIDDEN:
            self.within = tag
        self.data.append(" ")

    def handle_endtag(self, tag):
        if tag == self.within:
            self.within = None
        self.data.append(" ")

    def handle_comment(self, data):
        self.data.append(" ")

    def handle_data(self, data):
        if self.within is None:
            self.data.append(data)


def plain_trigrams(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = " " * letters.startswith(" ") + " ".join(letters.split()) + " " * letters.endswith(" ")
    wrap = (1 << 64) - 1
    mix = lambda a, b, c: ((a * 0x9E3779B97F4A7C15 & wrap) ^ (b * 0xC2B2AE3D27D4EB4F & wrap) ^ (c * 0x165667B19E3779F9 & wrap)) >> 40
    codes = list(map(ord, letters))
    return Counter(mix(*codes[i : i + 3]) % L.BUCKETS for i in range(len(codes) - 2))


def test_table_against_brute_force(spark):
    """All stages written again: parser, trigram model, counts and fusion."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["text"], r["lang"]) for r in table(spark, sf, "documents").collect() if r["lang"] is not None]
    langs = sorted({lang for _, lang in docs})
    sums = {lang: Counter() for lang in langs}
    for text, lang in docs:
        sums[lang].update(plain_trigrams(text or ""))
    rows = []
    for r in table(spark, sf, "pages").collect():
        page = Page(r["html"])
        grams = plain_trigrams("".join(page.data))
        n = sum(grams.values())
        ll = [sum(c * math.log((sums[x][g] + 0.5) / (sums[x].total() + 0.5 * L.BUCKETS)) for g, c in grams.items()) * min(1.0, L.EVIDENCE / n) if n else 0.0 for x in langs]
        top = max(ll)
        post = [math.exp(x - top) for x in ll]
        host = (r["url"] or "").partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower().rpartition("@")[2].partition(":")[0]
        rows.append((r["page_id"], host, ".".join(host.split(".")[-2:]), host.split(".")[-1], page.lang, ll, [p / sum(post) for p in post]))
    k = range(len(langs))
    total = [sum(r[6][i] for r in rows) + 1 for i in k]
    share = [x / sum(total) for x in total]
    by = [{}, {}, {}, {}]
    for r in rows:
        for j, value in enumerate(r[1:5]):
            mine = by[j].setdefault(value, [0.0] * len(langs))
            for i in k:
                mine[i] += r[6][i]
    want = {}
    for r in rows:
        host, domain, suffix, declared = ([max(0.0, by[j][v][i] - r[6][i]) for i in k] for j, v in enumerate(r[1:5]))
        s = L.SMOOTHING
        z = []
        for i in k:
            up = (domain[i] + s * share[i]) / (sum(domain) + s)
            z.append(r[5][i] + math.log((host[i] + s * up) / (sum(host) + s)) + (math.log((suffix[i] + s * share[i]) / total[i]) if r[3] else 0) + (math.log((declared[i] + s * share[i]) / total[i]) if r[4] else 0))
        want[r[0]] = (langs[max(k, key=lambda i: (z[i], -i))], 1 / sum(math.exp(x - max(z)) for x in z), r[4])
    got = {r["page_id"]: r for r in queries.op9_language_id(spark, sf).collect()}
    assert got.keys() == want.keys()
    for key, (lang, confidence, declared) in want.items():
        assert (got[key]["lang"], got[key]["declared_lang"]) == (lang, declared)
        assert abs(got[key]["confidence"] - confidence) < 1e-3
