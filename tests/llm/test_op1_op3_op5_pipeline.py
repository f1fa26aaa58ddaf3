import collections
import importlib
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import near_dup, suffix_tree, toxicity
from chronoweave.llm.common import Tables
from chronoweave.llm.words import shingle_sets, word_hashes
from chronoweave.session import checkpoint_dir
import lm_model
from llm_helpers import DOCS, crc_mod, frame, messy_rows, prose

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split()


# ---- words

def test_word_hashes_tell_words_apart():
    import pyarrow as pa
    texts = ["Aa\x0bbB\x0c ç\tÇ\r\n aa", None, "", "  ", "aa", "x" * 100_000, "b a", "a b", "ab"]
    h, off = word_hashes(pa.array(texts), piece_bytes=64)
    flat = [w for t in texts for w in words(t)]
    assert np.diff(off).tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    sliced = pa.array(["zz", *texts]).slice(1)
    assert (word_hashes(sliced)[0] == h).all()


# ---- near-duplicates

def sets_of(rows):
    out = []
    for r in rows:
        w = words(r[1])
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_classes(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                up[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        c = find(i)
        ids = [x for x in (first.get(c), r[0]) if x is not None]
        first[c] = min(ids) if ids else None
    return [(r[0], len(s), first[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


def edited(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split(" "))


def copies(seed):
    """A group of near copies of every degree around the threshold, a chain, and texts that share a passage."""
    rng = random.Random(seed)
    base, rows = prose(rng, 150), []
    for i in range(160):
        rows.append((100 + i, edited(rng, base, rng.uniform(0, 0.07)), "en", "a", 1))
    chain = prose(rng, 120).split(" ")
    for i in range(12):
        rows.append((400 + i, " ".join(chain), "en", "b", 1))
        chain = chain[8:] + prose(rng, 8).split(" ")
    shared = prose(rng, 60)
    for i in range(90):
        rows.append((500 + i, shared + " " + prose(rng, rng.randint(15, 60)), "en", "c", 1))
    rng.shuffle(rows)
    return rows


def test_classes_match_all_pairs(spark):
    rows = copies(1) + messy_rows()
    out = near_dup.near_duplicates(frame(spark, rows, clash=True)).collect()
    want = sorted(((i, n, c, i == c) for i, n, c in brute_classes(rows)), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 50


def test_thinning_changes_nothing(spark, monkeypatch):
    rows = copies(3)
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 2)
    monkeypatch.setattr(near_dup, "CHUNK_OUT", 3)
    monkeypatch.setattr(near_dup, "CHUNK_ALL", 7)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)
    out = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r)[:3] for r in out) == sorted(brute_classes(rows))


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(50)]
    links += [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(7, 7), (1, 0)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    key = lambda x: x.to_bytes(4, "big")
    df = spark.createDataFrame([(key(a), key(b)) for a, b in links], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["comp"]) for r in near_dup.components(df).collect()}
    linked = {x for p in links for x in p if p[0] != p[1]}
    assert got == {key(x): key(find(x)) for x in linked}


def test_keep_leaves_one_row_of_each_class(spark):
    rows = copies(5)[:150] + messy_rows() + [(100, "other text of the same id " + prose(random.Random(9), 30), "en", "a", 1)]
    docs = frame(spark, rows, clash=True)
    out = near_dup.keep(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert sum(got.values()) == len(class_texts(rows)) + sum(not s for s in sets_of(rows))
    assert all(any((r[0], r[1]) == k for r in rows) for k in got)


def class_texts(rows):
    """Per brute-force class of rows with words, by class and not by id: its (id, text) pairs."""
    sets, out = sets_of(rows), []
    for r, s in zip(rows, sets):
        near = [c for c in out if any(100 * len(s & t) >= 75 * len(s | t) for _, _, t in c)] if s else []
        if s:
            out = [c for c in out if not any(c is x for x in near)] + [[x for c in near for x in c] + [(r[0], r[1], s)]]
    return [{(i, t) for i, t, _ in c} for c in out]


def test_keep_counts_classes_not_ids(spark):
    rng = random.Random(31)
    twin = prose(rng, 40)
    rows = [(None, prose(rng, 40), "en", "a", 1) for _ in range(6)]  # unrelated, without ids
    rows += [(7, prose(rng, 40), "en", "a", 1) for _ in range(4)]  # unrelated, one id
    rows += [(None, twin, "en", "a", 1), (None, twin, "en", "a", 1), (None, twin + " end", "en", "a", 1)]
    rows += [(7, rows[0][1] + " end", "en", "a", 1), (9, rows[6][1] + " end", "en", "a", 1), (None, None, "en", "a", 1)]
    got = [(r["doc_id"], r["text"]) for r in near_dup.keep(frame(spark, rows)).collect()]
    classes = class_texts(rows)
    assert len(classes) == 11 and len(got) == 12 and (None, None) in got
    assert all(sum(k in c for k in got) == 1 for c in classes)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.keep(spark.createDataFrame([], DOCS)).count() == 0
    only = [(1, None, "en", "a", 1), (2, " ", "en", "a", 1)]
    assert sorted(tuple(r) for r in near_dup.near_duplicates(frame(spark, only)).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_similarity_exactly_at_the_threshold_links(spark):
    w, v, x = ([f"{c}{i}" for i in range(20)] for c in "wvx")
    # 5 of 7 under, 6 of 7 and 5 of 6 over the threshold: with the middle text a chain, without it two classes
    rows = [(1, w[:11]), (2, w[:9]), (3, w[:10]), (4, v[:11]), (5, v[:9])]
    rows += [(6, x[:16] + ["p", "q"]), (7, x[:16] + ["r", "s"])]  # 12 shingles in common of 16: exactly three quarters
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in rows]
    a, b = sets_of(rows)[-2:]
    assert len(a & b) * 100 == 75 * len(a | b)
    out = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}


# ---- language model

def brute_base(rows):
    train = [crc_mod(r[0], 7) != 2 for r in rows]
    count = collections.Counter(w for r, t in zip(rows, train) if t for w in [*words(r[1]), None])
    n, room = sum(count.values()), sum(count.values()) + len(count) + 1
    return [(r[0], not t, len(words(r[1])) + 1, sum(count[w] > 0 for w in [*words(r[1]), None]), n,
             sum(math.log10((count[w] + 1) / room) for w in [*words(r[1]), None])) for r, t in zip(rows, train)]


@pytest.mark.parametrize("share", [5e-7, 2e-3])  # every token frequent; most tokens rare
@pytest.mark.parametrize("clash", [False, True])
def test_base_scores(spark, share, clash):
    rows = messy_rows()
    out = suffix_tree.score(frame(spark, rows, clash), token_share=share).collect()
    got = sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in out), key=str)
    assert got == sorted(((*w[:5], round(w[5], 6)) for w in brute_base(rows)), key=str)
    assert all(r["score"] < 0 for r in out)


def test_distributions_sum_to_one_and_states_help(spark):
    rng = random.Random(6)
    follow = {w: rng.choices("abcdefgh", k=2) for w in "abcdefgh"}
    rows = []
    for i in range(300):
        t = ["a"]
        while len(t) < 60:
            t.append(rng.choice(follow[t[-1]]) if rng.random() < 0.9 else rng.choice("abcdefgh"))
        rows.append((i, " ".join(t), "en", "a", 1))
    df = frame(spark, rows).select(F.col("text").alias("_text"), F.lit(True).alias("_train"))
    model, counts, total = lm_model.train(df, 3, 10)
    assert len(model.depths) == 3 and len(model.depths[0]["next"]) > 8
    tokens = np.arange(len(model.base))
    unseen = 1 / model.room  # what the base leaves to all unseen tokens together
    assert abs((10 ** model.base).sum() + unseen - 1) < 1e-9
    for d in range(1, 4):
        states = np.arange(len(model.depths[d - 1]["grams"]))
        for s in states[:40]:
            p = 10 ** model.chance(d, np.full(len(tokens), s), tokens)
            rest = 0.0
            back, level = s, d
            while level:  # unseen tokens keep the base's share, rescaled on the way up
                rest += model.depths[level - 1]["rest_log"][back]
                back, level = model.depths[level - 1]["suffix"][back], level - 1
            assert abs(p.sum() + unseen * 10 ** rest - 1) < 1e-6
    out = [r for r in suffix_tree.score(frame(spark, rows), context_seen=10).collect() if r["held_out"]]
    assert len(out) > 20 and all(r["score"] > r["base_score"] + 5 for r in out)


def slow_score(model, text):
    """Log10 probability by walking each token's history, longest state first."""
    find = lambda k: int(model.lookup.find(np.array([k], np.uint64))[0])
    import pyarrow as pa
    keys = suffix_tree.tokens(pa.array([text]))[0]
    ids = [model.end, *map(find, keys)]
    total = 0.0
    for i in range(1, len(ids)):
        state, at = None, 0
        for d in range(1, len(model.depths) + 1):
            if i - d < 0:
                break
            gram = ids[i - d:i]
            s = -1
            for level, x in enumerate(gram):
                grams = model.depths[level]["grams"]
                key = x if level == 0 else s * model.size + x
                hit = np.flatnonzero(grams == key)
                s = int(hit[0]) if len(hit) and x >= 0 and (level == 0 or s >= 0) else -1
                if s < 0:
                    break
            if s < 0:
                break
            state, at = s, d
        if ids[i] >= 0:
            total += float(model.chance(at, np.array([state if at else -1]), np.array([ids[i]]))[0])
        else:
            assert ids[i] >= 0
    return total


def test_scores_match_a_slow_walk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    rows = docs.select(F.col("text").alias("_text"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).alias("_train"))
    model, _, _ = lm_model.train(rows, 3, 2)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, context_seen=2).collect()}
    for r in docs.where("doc_id < 8").collect():
        assert abs(got[r["doc_id"]] - slow_score(model, r["text"])) < 1e-6 * abs(got[r["doc_id"]])


def follow_rows(n, length, vocabulary, seed):
    """Texts in which each word has two likely successors of its own."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    follow = {w: rng.choices(names, k=2) for w in names}
    rows = []
    for i in range(n):
        t = [rng.choice(names)]
        while len(t) < length:
            t.append(rng.choice(follow[t[-1]]) if rng.random() < 0.9 else rng.choice(names))
        rows.append((i, " ".join(t), "en", "a", 1))
    return rows


def test_contexts_need_a_fixed_count_whatever_the_corpus(spark):
    # 300 words of about 170 occurrences each, far fewer than a share of a percent of the 51,000 tokens
    rows = follow_rows(300, 200, 300, 21)
    df = frame(spark, rows).select(F.col("text").alias("_text"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).alias("_train"))
    for part, least in (df, 250), (df.limit(60), 100):
        with Tables(spark) as tables:
            counts, _, total, distinct = suffix_tree.token_counts(part, tables)
            weights = suffix_tree.gram_weights(part, counts, total, total + distinct + 1, 3, tables)
            states = weights.join(counts.select("key", "t"), "key")
            assert states.count() > least and states.agg(F.min("t")).first()[0] >= suffix_tree.CONTEXT_SEEN
    out = [r for r in suffix_tree.score(frame(spark, rows)).collect() if r["held_out"]]
    assert all(r["score"] > r["base_score"] + 50 for r in out)


def test_lm_leaves_only_the_tables_its_result_reads(spark):
    names = lambda: {n for n in os.listdir(checkpoint_dir(spark)) if n.startswith("lm-")}
    before = names()
    out = suffix_tree.score(frame(spark, follow_rows(80, 60, 40, 22)))
    left = {n.rsplit("-", 1)[0] for n in names() - before}
    assert out.count() == 80 and left == {"lm-facts", "lm-parts", "lm-rare-0", "lm-rare-1"}


@pytest.mark.parametrize("share", [1e-9, 1.0])  # weights broadcast; all but the end token's joined
def test_joined_and_broadcast_weights_match_the_slow_walk(spark, share):
    rows = follow_rows(80, 60, 40, 22) + messy_rows()
    df = frame(spark, rows).select(F.col("text").alias("_text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).alias("_train"))
    model, _, _ = lm_model.train(df, 3, 4)
    assert all(len(level["next"]) for level in model.depths[:2])
    got = sorted((r["doc_id"], round(r["score"], 5)) for r in
                 suffix_tree.score(frame(spark, rows), context_seen=4, token_share=share).collect() if r["doc_id"] is not None)
    want = sorted((r[0], round(slow_score(model, r[1] or ""), 5)) for r in rows if r[0] is not None)
    assert len(got) == len(want) and all(i == j and abs(x - y) < 1e-3 for (i, x), (j, y) in zip(got, want))


def test_lm_shuffles_grams_as_arrays_by_bucket(spark, monkeypatch):
    # many buckets and flushes give the scores of the slow walk; a flush sends a row for each bucket, not for each gram
    for name, value in (("FLUSH_TOKENS", 500), ("GRAM_BUCKET", 300), ("RARE_BUCKET", 300)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = follow_rows(80, 60, 40, 22) + messy_rows()
    df = frame(spark, rows).select(F.col("text").alias("_text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).alias("_train"))
    model, counts, total = lm_model.train(df, 3, 4)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(frame(spark, rows), context_seen=4, token_share=1.0).collect()}
    for i, text, *_ in rows[:80]:
        assert abs(got[i] - slow_score(model, text or "")) < 1e-3
    bits = suffix_tree.bucket_bits(total, 300)
    shared = spark.sparkContext.broadcast((suffix_tree.key_map(counts), None))
    sent = df.where("_train").coalesce(1).mapInArrow(suffix_tree._gram_counts(shared, 1, bits, 10**6),
                                                     "bucket int, key binary, last binary, c binary").collect()
    grams = sum(len(r["key"]) // 8 for r in sent)
    assert 8 <= len(sent) <= 1 << bits and grams > 2 * len(sent)
    assert sum(np.frombuffer(r["c"], np.uint32).sum() for r in sent) == total


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_lm_keys_packed_by_difference_come_back(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    assert (suffix_tree._opened(suffix_tree._close(keys)) == keys).all()


def test_lm_key_map_has_every_key_and_few_others(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 5000)
    bits = suffix_tree.key_map(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3))
    assert len(bits) == 1 << (suffix_tree.MAP_BITS - 6)
    assert suffix_tree._mapped(bits, keys.view(np.uint64)).all()
    assert suffix_tree._mapped(bits, np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)).sum() < 10


def test_lm_of_nothing_and_without_training(spark):
    assert suffix_tree.score(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if crc_mod(i, 7) == 2)
    out = suffix_tree.score(frame(spark, [(held, "a b", "en", "a", 1)])).first()
    assert out["held_out"] and out["train_tokens"] == 0 and out["n_known"] == 0 and out["base_score"] == 0 == out["score"]


# ---- toxicity

def test_toxicity_learns_words_it_was_not_told(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        t, y = prose(rng, rng.randint(20, 200)).split(" "), int(rng.random() < 0.2)
        for _ in range(y * max(1, len(t) // 25)):
            t.insert(rng.randrange(len(t)), rng.choice(["zufferling", "quackwit", "Grotzig"]))
        rows.append((i, " ".join(t), "en", "a", 1))
        labels.append((i, 1, y))
    labels += [(i, 1, y) for i, _, y in labels[:20]] + [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    truth = {i: y for i, _, y in labels[:500]}
    rows += [r for r in messy_rows() if r[0] is None] + [(777, None, "en", "a", 1), (778, "", "en", "a", 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for clash in (False, True):
        out = toxicity.toxicity(frame(spark, rows, clash), lab).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert all(r["held_out"] == (crc_mod(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
        test = [r for r in out if r["held_out"] and r["doc_id"] in truth]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.95
    kept = toxicity.keep(frame(spark, rows, True), lab)
    assert kept.columns == frame(spark, [], True).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in out if not r["predicted"]), key=str)


def test_toxicity_does_not_look_at_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.9


def test_toxicity_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).count() == 0
    out = toxicity.toxicity(frame(spark, messy_rows()), none).collect()
    assert {r["predicted"] for r in out} == {0} and len(out) == len(messy_rows())


def test_toxicity_bound_counts_only_labels_of_rows_at_hand(spark, monkeypatch):
    rows = [(i, prose(random.Random(i), 20), "en", "a", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(2000)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda places, y, weight: seen.append((list(y), weight)))
    toxicity.train(frame(spark, rows), labels, rows=5)
    y, weight = seen[0]
    usable = [sum(i % 2 == c and crc_mod(i, 4) != 2 for i in range(60)) for c in (0, 1)]
    assert [y.count(c) for c in (0, 1)] == [5, 5] and [weight[c] * 5 for c in (0, 1)] == usable


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from chronoweave.llm.common import written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert set(ids["toxicity"]) < set(ids["quality_rules"])
    classes = brute_classes([tuple(r) for r in seen["toxicity"].select("doc_id", "text").collect()])
    assert sorted(ids["near_duplicates"]) == sorted(i for i, _, c in classes if i == c)
    assert set(ids["source_mix"]) <= set(ids["near_duplicates"]) and set(ids["packing"]) == set(ids["source_mix"])
    assert seen["packing"].where("piece = 0").count() == len(ids["source_mix"])


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as P
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__
    assert {"pipeline", "op5_min_max_near_duplicates"} <= set(__spark_entry__.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(__spark_entry__)
    assert not any(k.startswith("op") and k[2].isdigit() for k in __spark_entry__.queries())
    assert "pipeline" not in __spark_entry__.queries() and "clean_steps" in __spark_entry__.queries()
