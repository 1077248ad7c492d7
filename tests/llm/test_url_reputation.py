from pyspark.sql import functions as F

from tidewire.llm import url_reputation
from tidewire.llm.queries import URL_RULES


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, bound int")


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int, n int")


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "x://example.org", "example.org", "", None, "allow"),
        (3, "x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (4, "x://badexample.org/en/1", "badexample.org", "/en/1", "org/", "allow"),
        (5, "x://a.com/de/?q", "a.com", "/de/", "com/de/", "block"),
        (6, "x://a.com/DE/", "a.com", "/DE/", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme/de/", "", "", None, "allow"),
        (9, "x://h?://b.com/de/", "h", "", None, "allow"),
        (10, "x://É.com#/de/", "É.com", "", None, "allow"),
        (None, "x://com/fr/", "com", "/fr/", "com/fr/", "allow"),
        (10, "://org/", "org", "/", "org/", "allow"),
    ]
    judged = url_reputation.judge(pages(spark, [r[:2] for r in rows]), labels(spark, []), URL_RULES)
    got = [tuple(r) for r in judged.select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=repr) == sorted(((i, h, p, r, v) for i, _, h, p, r, v in rows), key=repr)


def test_bad_hosts_are_blocked_and_others_shrunk(spark):
    rows, known = [], []
    for host, bad, good in (("bad.x.net", 40, 0), ("good.x.net", 0, 40), ("one.y.net", 1, 0), ("many.y.net", 0, 60), ("z.com", 0, 60)):
        for k in range(bad + good):
            rows.append((len(rows), f"http://{host}/{k}"))
            known.append((len(known), int(k >= bad), 0))
    rows.append((len(rows), "http://unseen.y.net/"))
    verdict = {r["host"]: r for r in url_reputation.judge(pages(spark, rows), labels(spark, known), []).collect()}
    assert verdict["bad.x.net"]["verdict"] == "block"
    assert all(verdict[h]["verdict"] == "allow" for h in ("good.x.net", "many.y.net", "z.com"))
    assert verdict["one.y.net"]["mean"] > verdict["bad.x.net"]["mean"] + 0.1
    assert verdict["unseen.y.net"]["bound"] < verdict["many.y.net"]["bound"]


def test_outcomes_of_the_document_that_a_page_holds(spark):
    """Page ids and document ids run apart: the number in the path names the labelled document."""
    rows = [(k, f"x://{'bad' if k < 40 else 'good'}.com/en/{79 - k}") for k in range(80)]
    known = labels(spark, [(79 - k, int(k >= 40), 0) for k in range(80)])
    number = F.regexp_extract("url", "/([0-9]+)$", 1).try_cast("long")
    found = {r["host"]: r["verdict"] for r in url_reputation.judge(pages(spark, rows), known, [], document=number).collect()}
    assert found == {"bad.com": "block", "good.com": "allow"}


def test_awkward_labels(spark):
    rows = [(1, "x://a/"), (2, "x://a/"), (3, "x://b/")]
    known = [(1, 1, None), (1, 0, 0), (2, None, 1), (None, 0, 1), (3, None, None), (7, 0, 0)]
    found = {r["page_id"]: r["good"] for r in url_reputation.outcomes(labels(spark, known)).collect()}
    assert found == {1: 0, 2: 0, 7: 0}
    assert url_reputation.judge(pages(spark, rows), labels(spark, known), []).count() == 3


def test_empty(spark):
    assert url_reputation.judge(pages(spark, []), labels(spark, []), URL_RULES).collect() == []


def test_no_python_in_the_plan(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    text = StringIO()
    with redirect_stdout(text):
        url_reputation.judge(pages(spark, [(1, "x://a/")]), labels(spark, [(1, 1, 0)]), URL_RULES).explain(True)
    assert not any(word in text.getvalue() for word in ("Python", "Arrow", "Pandas"))


def plain_reputation(counts, suffixes):
    """Mean and bound of each host from its (n, k), by dictionaries."""
    def names(host):
        name = host.rpartition("@")[2]
        head, colon, port = name.rpartition(":")
        name = head if colon and port.isdigit() or colon and not port else name
        digits = name.split(".")
        if name.startswith("[") or len(digits) == 4 and all(d.isdigit() for d in digits):
            return name, "[address]"
        suffix = max((s for s in suffixes if name == s or name.endswith("." + s)), key=len, default=name.rpartition(".")[2])
        rest = name[: -len(suffix)].rstrip(".") if name != suffix else ""
        return (rest.rpartition(".")[2] + "." + suffix if rest else name), suffix

    def shrunk(level, prior):
        spread = sum((k - n * prior[x]) ** 2 - n * prior[x] * (1 - prior[x]) for x, (n, k) in level.items() if n)
        room = sum(n * (n - 1) * prior[x] * (1 - prior[x]) for x, (n, k) in level.items() if n)
        share = spread / room if room else 0.5
        m = 1 / max(1 / 10001, min(0.5, share)) - 1
        return {x: ((k + m * prior[x]) / (n + m), n + m) for x, (n, k) in level.items()}

    def added(key):
        out = {}
        for host, (n, k) in counts.items():
            old = out.get(key(host), (0, 0))
            out[key(host)] = (old[0] + n, old[1] + k)
        return out

    everything = (sum(k for _, k in counts.values()) + 1) / (sum(n for n, _ in counts.values()) + 2)
    suffix_counts, domain_counts = added(lambda h: names(h)[1]), added(lambda h: names(h)[0])
    parent = dict(names(h) for h in counts)
    by_suffix = shrunk(suffix_counts, dict.fromkeys(suffix_counts, everything))
    by_domain = shrunk(domain_counts, {d: by_suffix[parent[d]][0] for d in domain_counts})
    by_host = shrunk(counts, {h: by_domain[names(h)[0]][0] for h in counts})
    return {h: (m, m - url_reputation.DEVIATIONS * (m * (1 - m) / (w + 1)) ** 0.5) for h, (m, w) in by_host.items()}


def test_mean_and_bound_against_plain_python(spark):
    import random

    draw = random.Random(5)
    hosts = ["a.x.co.uk", "b.x.co.uk", "x.co.uk", "y.co.uk", "co.uk", "me:pw@y.co.uk:80", "10.0.0.1", "10.0.0.1:8080", "[::1]:9", "10.0.0", "u.github.io", "v.github.io", "a.z.com", "b.z.com", "w.com", "fooco.uk", "localhost", ""]
    rows, known, counts = [], [], {}
    for host in hosts:
        share, size = draw.random(), draw.randrange(0, 30)
        good = [int(draw.random() < share) for _ in range(size)]
        counts[host] = (size, sum(good))
        for g in [*good, None]:
            rows.append((len(rows), f"x://{host}/{len(rows)}"))
            known += [] if g is None else [(rows[-1][0], g, 0)]
    found = {r["host"]: (r["mean"], r["bound"]) for r in url_reputation.judge(pages(spark, rows), labels(spark, known), []).collect()}
    wanted = plain_reputation(counts, url_reputation.SUFFIXES)
    assert found.keys() == wanted.keys()
    for host, (mean, bound) in wanted.items():
        assert abs(found[host][0] - mean) < 1e-9 and abs(found[host][1] - bound) < 1e-9, host


def test_suffixes_are_a_parameter():
    assert "edu[.]test" in url_reputation.reputation_sql(("edu.test",))
