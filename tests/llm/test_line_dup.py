from collections import Counter, defaultdict

from conftest_llm import ODD

from leafmill.llm import line_dup


def brute(rows, ratio, least):
    pages, holds = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        if host is not None:
            pages[host] += 1
            for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
                holds[host][line] += 1
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, host, 0))
            continue
        bad = {x for x, n in holds[host].items() if n >= least and n / pages[host] > ratio} if host is not None else set()
        keep = [x for x in text.split("\n") if not x.strip(" ") or x.strip(" ") not in bad]
        out.append((i, "\n".join(keep), host, len(text.split("\n")) - len(keep)))
    return sorted(out, key=repr)


def rows(prose):
    out = []
    for i in range(200):
        lines = [" ".join(prose(5, 7 * i + k)) for k in range(3)]
        if i % 5 == 0:
            lines.insert(i % 3, "  Home | About " if i % 2 else "Home | About")
        if i % 40 == 0:
            lines += ["rare line"]
        if i % 4 == 1:
            lines += ["site line", "", "site line"]
        out.append((i, "\n".join(lines), f"h{i % 2}" if i % 10 else "small"))
    return out + [(*x, "s")[:3] for x in ODD] + [(300, "Home | About", None), (301, "Home | About", "h0")]


def test_against_brute_force(make, prose):
    data = rows(prose)
    df = make(data)
    for ratio, least in ((line_dup.RATIO, line_dup.MIN_PAGES), (0.3, 2), (0.0, 1)):
        got = line_dup.drop_boilerplate(df, ratio=ratio, min_pages=least, count_col="n_dropped")
        assert got.columns == [*df.columns, "n_dropped"]
        assert sorted(((r.doc_id, r.text, r.source, r.n_dropped) for r in got.collect()), key=repr) == brute(data, ratio, least)


def test_joined_without_broadcast(make, prose, monkeypatch):
    monkeypatch.setattr(line_dup, "BROADCAST_BYTES", 0)
    data = rows(prose)
    got = line_dup.drop_boilerplate(make(data), count_col="n")
    assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=repr) == [x[:3] for x in brute(data, line_dup.RATIO, line_dup.MIN_PAGES)]


def test_empty_table(make):
    assert line_dup.drop_boilerplate(make([])).collect() == []


def test_hosts(spark):
    urls = {"https://U:p@WWW.Example.com:80/a?b#c": "www.example.com", "http://a.b": "a.b", "mailto:x": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    from pyspark.sql import functions as F

    assert {r.url: r.h for r in df.select("url", line_dup.host_of(F.col("url")).alias("h")).collect()} == urls


def test_very_long_texts(make):
    own = [f"line {i} of its own" for i in range(200_000)]
    data = [(0, "\n".join([*own, "Shared footer"] * 2), "h")] + [(i, f"text {i}\nShared footer", "h") for i in range(1, 12)]
    got = {r.doc_id: r.text for r in line_dup.drop_boilerplate(make(data)).collect()}
    assert got[0] == "\n".join(own * 2) and got[5] == "text 5"
