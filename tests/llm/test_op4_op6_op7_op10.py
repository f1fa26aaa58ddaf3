import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import host_rules, inner_products, mixing, url_filter
from llm_helpers import DOCS, frame, messy_rows, prose

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
         ("block", "a.example.org/"), ("block", "EXAMPLE.edu/x"), ("allow", "solo")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def brute_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        rh, slash, rp = rule.partition("/")
        rh, rp = rh.lower(), slash + rp
        if (host == rh or host.endswith("." + rh)) and host and path.startswith(rp):
            if best is None or len(rh + rp) >= len(best[0]):
                best = (rh + rp, verdict)
    return best


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://x.Example.NET/en/1?q=/de/", "a://b://net/",
        "http://example.net?x", "http://example.net/en", "http://example.com/de/#t", "http://com/de/", "http://notnet/",
        "http://b.a.example.org/fr/9", "http://é.org/fr/", "http://x.edu/x", "http://y.example.edu/xyz", "ftp://solo",
        "http://u@net:80/", "http://net/\nnew", "http://.net/", "http://a..net/en/", "http://" + "s." * 300 + "net/" + "p" * 9000]


@pytest.mark.parametrize("clash", [False, True])
def test_url_verdicts(spark, clash):
    rows = [(i if i else None, u) for i, u in enumerate(URLS)] + [(3, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    if clash:
        pages = pages.withColumns({"_id": F.lit("x"), "host": F.lit("y"), "rule": F.lit("z"), "verdict": F.lit("w")})
    got = [tuple(r) for r in url_filter.judge_urls(pages, RULES).collect()]
    want = []
    for i, u in rows:
        host, path = split_url(u)
        best = brute_rule(host, path, RULES)
        want.append((i, host, path, *(best or (None, "allow"))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    (tmp_path / "r").write_bytes(url_filter.layout([("block", f"h{i}.net/") for i in range(40)]))
    array = url_filter.DigestArray(str(tmp_path / "r"))
    asked = [f"h{i}.net/".encode() for i in range(60)]
    assert [array.text(k).decode() if k >= 0 else None for k in array.find(asked)] == \
        [f"h{i}.net/" if i < 40 else None for i in range(60)]


def test_no_rules_and_random_rules(tmp_path):
    (tmp_path / "none").write_bytes(url_filter.layout([]))
    assert url_filter.best_rules(url_filter.DigestArray(str(tmp_path / "none")), ["a.net"], ["/"]) == [-1]
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "ab", "net"])
    for _ in range(30):
        rules = list({f"{'.'.join(part() for _ in range(rng.randint(1, 3)))}/{part() if rng.random() < .5 else ''}": None
                      for _ in range(12)})
        rules = [(rng.choice(["block", "allow"]), r) for r in rules]
        (tmp_path / "rules").write_bytes(url_filter.layout(rules))
        array = url_filter.DigestArray(str(tmp_path / "rules"))
        hosts = [".".join(part() for _ in range(rng.randint(1, 4))) for _ in range(50)]
        paths = ["/" + part() * rng.randint(0, 2) for _ in range(50)]
        for h, p, k in zip(hosts, paths, url_filter.best_rules(array, hosts, paths)):
            best = brute_rule(h, p, rules)
            assert (array.text(k).decode() if k >= 0 else None) == (best and max(
                (r for _, r in rules if (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0]))
                 and p.startswith("/" + r.partition("/")[2])), key=lambda r: (len(r), len(r.partition("/")[0]))))


def vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.gamma(1.0, 1.0, (n, 1))
    x[50:120] = x[50]  # one common vector: ties everywhere
    rows = [(int(i), [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    rows[7] = (7, None)
    rows[8] = (8, [None] + rows[8][1][1:])
    rows[9] = (9, [float("nan")] + rows[9][1][1:])
    rows[100] = (100, [float("inf")] + rows[100][1][1:])
    return rows + [(None, rows[10][1]), (900, []), (-50, rows[3][1]), (1000, [1.0, 2.0]), (1001, [3.0, 4.0])]


def brute_top(rows, k, every):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_is_exact(spark, monkeypatch, small):
    if small:  # several blocks, short head
        for name, n in (("HEAD_ROWS", 8), ("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("SAMPLE_ROWS", 20)):
            monkeypatch.setattr(inner_products, name, n)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit("y")})
    assert sorted(tuple(r) for r in inner_products.top_k(df).collect()) == brute_top(rows, 5, 50)


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 120, [float(x) for x in rng.normal(size=6) * (1 + i % 7)]) for i in range(300)]
    rows += rows[:40]  # equal rows as well
    whole = [(i, np.floor(256 * np.array(np.float32(v), float))) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        scores = [(-int(x @ y), j) for i, x in whole if i == q for j, y in whole if j != q]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:5])]
    got = inner_products.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_short_blocks_are_left_out_before_they_are_sent():
    length, least = np.array([2.0, 4.0]), np.array([10.0, 10.0])
    assert 2.4 < inner_products._open_above(length, least) <= 2.5
    assert inner_products._open_above(length, np.array([10.0, -1.0])) == 0.0
    assert inner_products._open_above(np.array([0.0]), np.array([0.0])) == 0.0


def test_top_k_of_few_or_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert inner_products.top_k(spark.createDataFrame([], kind)).collect() == []
    few = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])]
    assert [tuple(r) for r in inner_products.top_k(spark.createDataFrame(few, kind)).collect()] == brute_top(few, 5, 50)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bad = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), bad)


@pytest.mark.parametrize("clash", [False, True])
def test_host_rules(spark, clash):
    rng = random.Random(2)
    rows = messy_rows()
    line = prose(rng, 9)
    rows += [(200, "\n".join([line] * 30 + [prose(rng, 20)]), "en", "d", 1), (201, "x # y | <z> $5 ** \n\n \n", "en", "d", 1),
             (202, " ".join(["same words here"] * 4000), "en", "d", 1), (203, line + "\n" + line + " ", "en", "d", 1)]
    rows += [(300 + i, prose(rng, 10), "en", "bad", 1) for i in range(30)] + [(340, prose(rng, 90), "en", "bad", 1)]
    got = {}
    out = host_rules.quality(frame(spark, rows, clash)).collect()
    assert len(out) == len(rows)
    by_host = collections.defaultdict(list)
    for r in rows:
        if r[3] is not None:
            by_host[r[3]].append(brute_quality(r[1])[-1])
    rate = {h: sum(v) / len(v) for h, v in by_host.items()}
    mean, var = np.mean(list(rate.values())), np.var(list(rate.values()), ddof=1)
    strength = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else np.mean([len(v) for v in by_host.values()])
    fails = {h: (sum(v) + strength * mean) / (len(v) + strength) > 0.5 for h, v in by_host.items()}
    assert fails["bad"] and not all(fails.values())
    want = sorted(((r[0], *brute_quality(r[1]), not brute_quality(r[1])[-1] and not fails.get(r[3], False)) for r in rows), key=str)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"], r["kept"]) for r in out), key=str)
    assert got == want
    kept = host_rules.keep(frame(spark, rows, clash))
    assert kept.columns == frame(spark, [], clash).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((w[0] for w in want if w[-1]), key=str)


def test_host_rules_of_nothing_and_without_hosts(spark):
    assert host_rules.quality(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, prose(random.Random(1), 80), "en", None, 1), (2, "short", "en", None, 1)]
    assert {r["doc_id"]: r["kept"] for r in host_rules.quality(frame(spark, rows)).collect()} == {1: True, 2: False}


def test_poisson_steps_follow_the_distribution():
    for rate in (0.01, 0.5, 3.0, 40.0, 900.0, 5000.0):
        low, steps = mixing.poisson_steps(rate)
        p = np.diff([0, *steps])
        k = low + np.arange(len(p))
        assert abs(p.sum() - 1) < 1e-9 and abs((p * k).sum() / rate - 1) < 1e-6
        assert abs((p * (k - rate) ** 2).sum() / rate - 1) < 1e-4
    assert mixing.poisson_steps(0) == (0, [2.0])


@pytest.mark.parametrize("clash", [False, True])
def test_mix_draws_by_hash(spark, clash):
    rows = messy_rows()
    docs = frame(spark, rows, clash)
    weights = {"a": 2.0, "b": 1.0, "c": 0.0}
    out = mixing.mix(docs, weights, size=600, seed=5, copy_col=None)
    assert out.columns == docs.columns
    n = collections.Counter(r[3] for r in rows)
    rate = {s: 600 * w / 3 / n[s] for s, w in weights.items()}
    pairs, seen, want = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect()), collections.Counter(), collections.Counter()
    for r in docs.collect():
        named = ["5", "" if r["doc_id"] is None else str(r["doc_id"]), hashlib.md5((r["text"] or "").encode()).hexdigest()]
        if pairs[r["doc_id"], r["text"] or ""] > 1:
            seen[tuple(r)] += 1
            named += [str(r[c]) for c in docs.columns if c not in ("doc_id", "text") and r[c] is not None] + [str(seen[tuple(r)])]
        u = int(hashlib.md5(":".join(named).encode()).hexdigest()[:13], 16) / 2**52
        p = math.exp(-rate.get(r["source"], 0.0))
        k, cum = 0, p
        while cum <= u and rate.get(r["source"], 0.0):
            k += 1
            p *= rate[r["source"]] / k
            cum += p
        want[r["doc_id"], r["source"]] += k
    got = collections.Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert got == +want
    assert mixing.mix(docs, weights, size=600, seed=5).groupBy("doc_id").agg(F.max("copy")).count() == len({k[0] for k in +want})


def test_mix_reaches_targets_and_spreads_copies(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 3 else "small", 1) for i in range(6000)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, {"big": 1, "small": 1})
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] / 3000 - 1) < 0.06 and abs(n["small"] / 3000 - 1) < 0.06
    ids = [r["doc_id"] for r in got.collect()]
    assert ids != sorted(ids) and sorted(ids) == sorted(r["doc_id"] for r in mixing.mix(docs.repartition(3), {"big": 1, "small": 1}).collect())
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.05


def test_mix_draws_for_each_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEAT_CHUNK", 100)
    rows = ([(None, "", "en", "a", 1)] * 3000 + [(None, None, "en", "b", 1)] * 500 + [(7, "same", "en", "a", n) for n in range(400)]
            + [(100 + i, f"text {i}", "de", "a", 1) for i in range(500)])
    for seed in (17, 18):
        docs = frame(spark, rows)
        out = mixing.mix(docs, power=1.0, seed=seed, copy_col=None)
        assert out.columns == docs.columns
        got = collections.Counter(tuple(r) for r in out.collect())
        assert set(got) <= set(rows)
        assert abs(got[rows[0]] / 3000 - 1) < 0.08 and abs(got[rows[3000]] / 500 - 1) < 0.2
        assert abs(sum(n for r, n in got.items() if r[0] == 7) / 400 - 1) < 0.2
        assert len({n for r, n in got.items() if r[0] == 7}) > 2  # draws of their own
        again = mixing.mix(docs.repartition(5), power=1.0, seed=seed, copy_col=None)
        assert collections.Counter(tuple(r) for r in again.collect()) == got


def test_mix_spreads_repeated_rows_over_partitions(spark):
    docs = frame(spark, [(None, "", "en", "a", 1)] * 20000)
    with_setting = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in mixing.mix(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_setting)
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes) and abs(sum(sizes) / 20000 - 1) < 0.05


def test_mix_of_nothing_and_too_much(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(Exception, match="repeat its documents"):
        mixing.mix(frame(spark, messy_rows()), {"a": 1.0}, size=10**9).count()
