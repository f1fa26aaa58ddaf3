"""Repeated strings, importance resampling and the filter audit against slow twins."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from chronoweave.llm import filter_audit, importance, repeated_text
from chronoweave.llm.suffix_groups import suffix_array
from chronoweave.llm.word_automaton import crc_joined, run_buckets
from chronoweave.llm.words import buffers
from llm_helpers import DOCS, frame, messy_rows, prose

import pyarrow as pa


def test_suffix_array_equals_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(1500):
        t = [rng.randint(1, rng.randint(1, 6)) for _ in range(rng.randint(0, 40))]
        if t and rng.random() < 0.4:
            t = (t[:max(1, len(t) // 4)] * 8)[:len(t)]
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute_repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def repeated_rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(20, 150)) for _ in range(15)]
    texts = ["a" * 900, "ab" * 400, "a" * 199, "a" * 200, "é" * 300, "x" * 100 + base[0][:100] + "y" * 60]
    for _ in range(60):
        x, y = rng.choice(base), rng.choice(base)
        if rng.random() < 0.4:
            words = x.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words))
        else:
            a = rng.randrange(len(x))
            texts.append(prose(rng, 20) + x[a:a + rng.randint(150, 420)] + prose(rng, 10) + y[:rng.randint(0, 300)])
    return messy_rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window,group,rows_sent", [(200, 8192, 200_000), (200, 1, 0), (50, 2, 200_000)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, window, group, rows_sent):
    monkeypatch.setattr(repeated_text, "GROUP", group)
    monkeypatch.setattr(repeated_text, "BROADCAST_ROWS", rows_sent)
    rows = repeated_rows()
    out = repeated_text.remove_repeats(frame(spark, rows, clash=True), window=window).drop("cuts").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], window))]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeated_text, "PIECE", 500)
    rows = repeated_rows()
    out = repeated_text.remove_repeats(frame(spark, rows)).drop("cuts").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200))]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_repeats_of_an_empty_table_and_of_none(spark):
    assert repeated_text.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    rng = random.Random(8)
    rows = [(i, prose(rng, 80), "en", "a", 1) for i in range(5)]
    assert all(r["n_removed"] == 0 and r["n_spans"] == 0 for r in repeated_text.remove_repeats(frame(spark, rows)).collect())


def test_parts_cover_each_window_once():
    rng = random.Random(2)
    for _ in range(200):
        left, right = bytes(rng.choices(b"ab", k=rng.randint(0, 31))), bytes(rng.choices(b"ab", k=31))
        right = right[:rng.randint(max(0, 31 - len(left)), 31)]
        parts = list(repeated_text.cut_part(b"core", left, right, 0, 32, 4))
        offsets = [r + i for _, l, t, r in parts for i in range(4 - 1 - len(t), len(l) + 1)]
        assert offsets == list(range(31 - len(right), len(left) + 1))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("longest", [1, 3])
def test_buckets_from_payloads_equal_direct_hashing(longest):
    texts = [r[1] for r in messy_rows()] + ["ÀB c0 -- d", "a", " a ", "x" * 5000 + " y"]
    got, counts = run_buckets(*buffers(pa.array(texts, pa.string())), longest, 997)
    for t, g, n in zip(texts, got, counts):
        w = words_of(t)
        want = [zlib.crc32(" ".join(w[i:i + k]).encode()) % 997 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        assert sorted(g.tolist()) == sorted(want) and n == len(w)


def test_crc_of_joined_parts():
    rng = random.Random(4)
    a, b = ([rng.randbytes(rng.randint(0, 300)) for _ in range(100)] for _ in range(2))
    crc = lambda x: np.array([zlib.crc32(v) for v in x], np.uint32)
    assert (crc_joined(crc(a), crc(b), np.array([len(v) for v in b])) == crc([x + y for x, y in zip(a, b)])).all()


def brute_resample(rows, target, min_words, percent, buckets=10_000):
    feats = [[zlib.crc32(w.encode()) % buckets for w in words_of(r[1])] for r in rows]
    s = collections.Counter(b for f in feats for b in f)
    t = collections.Counter(zlib.crc32(w.encode()) % buckets for x in target for w in words_of(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for r, f in zip(rows, feats):
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([r[0], len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((o for o in out if o[1] >= min_words), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for i, o in enumerate(able[:percent * len(able) // 100]):
        o[4] = i + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("percent", [10, 100])
def test_resampling_equals_the_slow_way(spark, percent):
    rows = messy_rows()
    target = [prose(random.Random(9), 200), None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = importance.resample(frame(spark, rows, clash=True), bench, percent=percent).collect()
    assert sorted(map(repr, map(tuple, out))) == brute_resample(rows, target, 20, percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, bench).count() == 0
    rows = messy_rows()
    got = importance.resample(frame(spark, rows), bench).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_resample(rows, [], 20, 10)


def brute_audit(rows, labels):
    first, facts = {}, []
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang, *_ in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        caps = sum("A" <= c <= "Z" for c in t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 3 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        mine = [l for l in labels if l[0] == i and i is not None]
        facts.append((lang or "", {k for k, v in f.items() if v}, any(l[1] == 1 for l in mine), any(l[2] == 1 for l in mine)))
    out, share = [], collections.Counter()
    for part in {f[0] for f in facts}:
        docs = [f for f in facts if f[0] == part]
        for p in itertools.permutations("ABCDE"):
            for s, x in enumerate(p):
                there = [d for d in docs if not d[1] & set(p[:s])]
                gone = [d for d in there if x in d[1]]
                share[part, x] += len(gone)
                out.append([part, "".join(p), s + 1, len(there) - len(gone), len(gone),
                            sum(x in d[1] for d in docs) - len(gone), sum(d[1] == {x} for d in docs),
                            sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*o, share[o[0], o[1][o[2] - 1]]) for o in out)


def test_audit_equals_walking_every_order(spark):
    rng = random.Random(6)
    rows = messy_rows() + [(200 + i, prose(rng, 220) + rng.choice(["", " #x", " ABC" * 30]), rng.choice(["en", "de", "", None]), "a", 1)
                           for i in range(30)]
    rows += [(300 + i, rows[40 + i % 5][1], "en", "a", 1) for i in range(10)] + [(None, rows[40][1], "en", "a", 1)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 320, 3)] + [(0, 0, 1), (200, 1, 1), (None, 1, 1), (5, None, None)]
    got = filter_audit.audit(frame(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
