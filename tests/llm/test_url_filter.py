import random
import re

from tessera.llm import queries
from tessera.llm.url_filter import DigestArray, judge_urls

from .duck import rows, same

SF = "/root/testdata/sf0.01"


def plain(url, rules, otherwise="allow"):
    m = re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*).*", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, otherwise)


def test_query_matches_sql(spark):
    assert same(queries.op10_url_filter(spark, SF).collect(), rows(queries.OP10_SQL, SF))


def test_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "www.a.com", "x.www.a.com", "aa.com", "net", "b.net", "", ".com", "a..com", "É.com", "A.COM:80", "u@b.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/é/y"]
    rules = [("allow", "com", "/"), ("block", "a.com", "/en/"), ("allow", "www.a.com", "/en/"), ("block", "net", ""), ("block", "b.net", "/é/"), ("allow", "b.net", "/é/y")]
    urls = [None, "", "no scheme", "://", "a://b://c/d"] + [f"{rng.choice(['http', 'S', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a/b', '#x?y', '?://z/'])}" for _ in range(400)] + ["http://" + "a." * 50_000 + "com/en/"]
    df = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    out = judge_urls(df, rules, otherwise="block").collect()
    assert {r["page_id"] or 0: tuple(r)[1:] for r in out} == {i: plain(u, rules, "block") for i, u in enumerate(urls)}
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(df, []).collect()} == {"allow"}


def test_collisions_are_told_apart(tmp_path):
    same_digest = lambda raw: len(raw)
    DigestArray.write(str(tmp_path / "a"), [("aa", 1), ("bb", 2), ("c", 3)], same_digest)
    array = DigestArray(str(tmp_path / "a"))
    assert array.find(["bb", "aa", "cc", "c", "d", ""], same_digest).tolist() == [2, 1, -1, 3, -1, -1]
    DigestArray.write(str(tmp_path / "b"), [])
    assert DigestArray(str(tmp_path / "b")).find(["x"]).tolist() == [-1]
