import re

import odd
import pytest

from panelforge.llm import url_filters as urls

ODD = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "https://a.Example.ORG/es/1?x=/y#z",
    "http://example.org/en/1", "http://example.org/en/2", "http://badexample.org/es/3",
    "http://x.com/de/4", "http://com/fr/5", "http://com.net/fr/6", "ftp://h/p#f?q", "://h/p",
    "http://h?q=1://z/", "http://a.b/c://d/e", "http://org//", "HTTP://É.example.COM/fr/É",
    "http://a.net/" + "9" * 5000, "http://x.com/fr", "http://h\nx/p\nq?r",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(url):
    host, path = parts(url)
    fits = [
        r
        for r in urls.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


def check(rows, pages):
    by_id = {}
    for r in rows:
        url = pages[r["page_id"]]
        rule = rule_of(url)
        assert (r["host"], r["path"]) == parts(url)
        assert r["rule"] == (rule.name if rule else None)
        assert r["verdict"] in ("allow", "block")
        if rule:
            assert r["verdict"] == rule.verdict
        by_id[r["page_id"]] = r["verdict"]
    assert by_id.keys() == pages.keys()
    return by_id


def test_odd_urls(spark):
    pages = dict(enumerate(ODD))
    rows = [(k, url, "x", 1, "y") for k, url in pages.items()]
    df = spark.createDataFrame(
        rows, "page_id long, url string, host string, label int, suffix string"
    )
    check(urls.judge(df).collect(), pages)


def test_corpus(spark):
    table = spark.read.parquet(f"{odd.SF}/pages.parquet")
    pages = {r["page_id"]: r["url"] for r in table.select("page_id", "url").collect()}
    got = urls.judge(table)
    check(got.collect(), pages)
    assert odd.ordered(got.collect()) == odd.ordered(urls.judge(table.repartition(5)).collect())


def test_nothing_to_learn_from(spark):
    rows = [(1, "http://a.net/x"), (2, "http://b.org/y")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    assert check(urls.judge(df).collect(), dict(rows)) == {1: "allow", 2: "allow"}
    assert urls.judge(df.limit(0)).collect() == []


def test_held_out_urls_are_recognised(spark):
    """Trees fitted on some ruled URLs find the verdicts of others."""
    rows = []
    for k in range(600):
        bad = k % 2
        host = f"{'x7-q' if bad else 'news'}{k}.example.{'biz' if k % 7 else 'net'}"
        path = f"/{'a1b2' * (k % 5 + 3) if bad else 'story'}/{k}"
        rows.append((k, f"http://{host}{path}{'?id=%d&s=9' % k if bad else ''}"))
    shown = [
        urls.Rule("block" if k % 2 else "allow", rows[k][1].split("/")[2], "/")
        for k in range(0, 600, 4)
    ] + [
        urls.Rule("block" if k % 2 else "allow", rows[k][1].split("/")[2], "/")
        for k in range(1, 600, 4)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    named = {rule.host for rule in shown}
    got = {r["page_id"]: r for r in judge_by(df, shown).collect()}
    held = [k for k, url in rows if url.split("/")[2] not in named]
    right = sum((got[k]["verdict"] == "block") == bool(k % 2) for k in held)
    assert len(held) >= 290
    assert right / len(held) > 0.95


def judge_by(df, rules):
    return urls.judge(df, rules)


@pytest.mark.parametrize("text", ["", "aaaa", "abab", "abcd"])
def test_entropy(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(urls._entropy(df["t"])).first()[0]
    assert got == pytest.approx({"": 0, "aaaa": 0, "abab": 1, "abcd": 2}[text])


def test_no_python_in_the_plan(spark):
    plan = urls.judge(spark.read.parquet(f"{odd.SF}/pages.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_a_hot_url_does_not_fill_the_sample(spark):
    """Repeats of the ruled URL that comes first by its hash leave room for the others."""
    rows = []
    for k in range(300):
        bad = k % 2
        path = f"/{'a1b2' * (k % 5 + 3) if bad else 'story'}/{k}"
        rows.append((k, f"http://{'x7-q' if bad else 'news'}{k}.example.biz{path}"))
    shown = [
        urls.Rule("block" if k % 2 else "allow", url.split("/")[2], "/") for k, url in rows[:200]
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    hot = df.where("page_id < 200").orderBy(urls.F.xxhash64("url")).first()["url"]
    repeats = spark.range(1000, 1300).select(urls.F.col("id").alias("page_id"), urls.F.lit(hot).alias("url"))
    got = urls.judge(df.unionByName(repeats), shown, fit_rows=100).collect()
    held = {r["page_id"]: r["verdict"] for r in got if 200 <= r["page_id"] < 300}
    right = sum((verdict == "block") == bool(k % 2) for k, verdict in held.items())
    assert len(held) == 100 and right > 95


def test_no_feature_restates_the_path_of_a_rule(spark):
    """URLs of the same letters in another first segment have the same features."""
    shown = [(1, "http://a.com/de/1"), (2, "http://a.com/fr/1")]
    asked = [(3, "http://a.net/de/1"), (4, "http://a.net/ed/1")]
    df = spark.createDataFrame(shown + asked, "page_id long, url string")
    host, path = urls.host_and_path(df["url"])
    ready = urls.lexical(df.withColumns({"host": host, "path": path}))
    ready = ready.withColumn("label", urls.F.expr("CASE page_id WHEN 1 THEN 1D WHEN 2 THEN 0D END"))
    got, _ = urls._features(ready, ready.where("label IS NOT NULL"))
    features = {r["page_id"]: tuple(r[f] for f in urls.FEATURES) for r in got.collect()}
    assert features[3] == features[4] and "f_head_rate" not in got.columns


def test_held_out_accuracy_on_pages(spark):
    """Trees and suffix rates of four fifths of the ruled URLs, judged on the last fifth."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = urls.host_and_path(table["url"])
    pages = table.withColumns({"host": host, "path": path})
    label = (urls.decided(urls.RULES, "verdict") == "block").cast("double")
    pages = urls.lexical(pages.withColumn("label", label)).where("label IS NOT NULL")
    held = urls.F.crc32(urls.F.col("url").cast("binary")) % 5 == 0
    ready, rate = urls._features(pages, pages.where(~held))
    ready = urls.VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(ready)
    model = urls.fit(ready.where(~held))
    judged = model.transform(ready.where(held)).select("label", "prediction").collect()
    right = sum(r["label"] == r["prediction"] for r in judged) / len(judged)
    common = max(rate, 1 - rate)
    print(f"held-out accuracy {right:.3f} of {len(judged)}, the more common verdict {common:.3f}")
    # The rules go by the first path segment, which is no feature: little can be learned here.
    assert len(judged) > 50 and right >= common - 0.1
