import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import fit_packing, token_count, token_matrix
from llm_helpers import DOCS, TOKENIZER, frame, messy_rows

WHOLE = Tokenizer.from_file(TOKENIZER)


def ids(text, end=None):
    out = WHOLE.encode(text or "", add_special_tokens=False).ids
    return out if end is None else out + [end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def check_sequences(rows, key, size):
    seqs = defaultdict(list)
    for r in rows:
        seqs[tuple(r[k] for k in key)].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return seqs


@pytest.mark.parametrize("clash", [False, True])
def test_pack_loses_nothing(spark, clash):
    rows = messy_rows()
    out = [r.asDict() for r in fit_packing.pack(frame(spark, rows, clash), TOKENIZER, size=64).collect()]
    want = []
    for r in rows:
        full = ids(r[1], 2)
        cut = [full[:len(full) % 64 or 64], *(full[i:i + 64] for i in range(len(full) % 64 or 64, len(full), 64))]
        assert sum(map(len, cut)) == len(full)
        start = 0
        for k, p in enumerate(cut):
            want.append((r[0], k, start, len(p), crc(p)))
            start += len(p)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    seqs = check_sequences(out, ["sequence_id"], 64)
    assert len(seqs) <= sum(r["length"] for r in out) / 64 * 1.05 + 2


def test_pack_respects_every_capacity(spark):
    docs = frame(spark, messy_rows())
    for rule in ("norm", "dot"):
        out = [r.asDict() for r in fit_packing.pack(docs, TOKENIZER, size=128, max_documents=3, max_attention=128 * 128,
                                                    rule=rule, weights=(1, 0.5, 0.5)).collect()]
        assert max(map(len, check_sequences(out, ["sequence_id"], 128).values())) <= 3
    place, _ = fit_packing.best_fit(np.array([6, 6, 6, 6]), 100, 10, 72)
    assert np.bincount(place).max() == 2  # two pieces of 6 cost 72
    with pytest.raises(ValueError):
        fit_packing.best_fit(np.array([9]), 100, 10, 80)


def slow_best_fit(lengths, caps, rule, weights):
    """Bins as lists of piece numbers: every open bin tried for every piece, nothing cleared away."""
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, best = (lengths[i], 1, lengths[i] ** 2), None
        for b, pieces in enumerate(bins):
            used = (sum(lengths[j] for j in pieces), len(pieces), sum(lengths[j] ** 2 for j in pieces))
            rest = [c - u for c, u in zip(caps, used)]
            if all(r >= n for r, n in zip(rest, need)):
                share = [(r / c, n / c) for r, n, c in zip(rest, need, caps)]
                score = (sum(w * (r - n) ** 2 for w, (r, n) in zip(weights, share)) if rule == "norm"
                         else -sum(w * r * n for w, (r, n) in zip(weights, share)))
                if best is None or score < best[0] - 1e-12:
                    best = score, b
        if best is None:
            bins.append([i])
        else:
            bins[best[1]].append(i)
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_rules_follow_the_slow_twin(rule):
    rng = random.Random(4)
    bound = set()
    for trial in range(60):
        size, n = 128, rng.randint(0, 250)
        caps = (size, rng.choice([3, 7, size]), rng.choice([size * size // 2, size * size]))
        lengths = [rng.randint(1, 90) for _ in range(n)]
        weights = rng.choice([(1, 1, 1), (1, 0.25, 2), (0, 1, 1)])  # shares of these capacities are exact in binary or apart
        place, offset = fit_packing.best_fit(np.array(lengths, np.int64), *caps, rule, weights)
        slow = slow_best_fit(lengths, caps, rule, weights)
        want = {i: b for b, pieces in enumerate(slow) for i in pieces}
        assert place.tolist() == [want[i] for i in range(n)]
        for pieces in slow:
            assert offset[pieces].tolist() == [sum(lengths[j] for j in pieces[:k]) for k in range(len(pieces))]
            bound.add(len(pieces) == caps[1])
    assert bound == {True, False}


def test_all_three_residuals_choose_the_sequence():
    lengths = np.array([60, 40, 40, 20, 20, 20, 10, 10, 5, 5])
    assert (fit_packing.best_fit(lengths, 100, 100, 10_000)[0].tolist()
            == [{i: b for b, x in enumerate(slow_best_fit(lengths.tolist(), (100, 100, 10_000), "norm", (1, 1, 1))) for i in x}[i]
                for i in range(10)])


def test_best_fit_takes_the_tightest_sequence():
    place, offset = fit_packing.best_fit(np.array([7, 6, 3, 4, 3]), 10, 10, 100, weights=(1, 0, 0))
    assert place.tolist() == [0, 1, 0, 1, 2] and offset.tolist() == [0, 0, 7, 6, 0]


def test_pack_of_nothing(spark):
    assert fit_packing.pack(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


def test_capacity_tree_is_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([1, 2, 7, 16, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        row, offset, n = token_matrix.best_fit_decreasing(lengths, size)
        room = []
        for x in sorted(lengths, reverse=True):
            fits = [c for c in room if c >= x]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else size) - x)
        assert n == len(room)
        check_sequences([{"row": r, "offset": o, "length": x} for r, o, x in zip(row, offset, lengths)], ["row"], size)


@pytest.mark.parametrize("clash", [False, True])
def test_matrices_round_trip(spark, tmp_path, clash):
    rows = messy_rows()
    path = token_matrix.write_matrices(frame(spark, rows, clash), TOKENIZER, str(tmp_path / "m"), size=64)
    out = [r.asDict() for r in token_matrix.segments(spark, path).collect()]
    check_sequences(out, ["shard", "row"], 64)
    want = [(r[0], k, 64 * k, crc(full[64 * k:64 * k + 64])) for r in rows for full in [ids(r[1], 50256)]
            for k in range(-(-len(full) // 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    for s in spark.read.parquet(path).collect():
        cu, ends = np.frombuffer(s["cu_seqlens"], "<i4"), np.frombuffer(s["row_ends"], "<i4")
        pos = token_matrix.position_ids(np.frombuffer(s["resets"], "<i8"), s["n_rows"], 64)
        assert s["bits"] == 16 and len(s["ids"]) == s["n_rows"] * 64 * 2
        for r in range(s["n_rows"]):
            cut = cu[ends[r]:ends[r + 1]].tolist()
            assert cut[0] == 0
            for a, b in zip(cut, [*cut[1:], 64]):
                assert pos[r, a:b].tolist() == list(range(b - a))


def test_matrices_of_nothing(spark):
    assert token_matrix.packed(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


@pytest.mark.parametrize("clash", [False, True])
def test_counts_match_the_library(spark, clash):
    rows = messy_rows()
    out = token_count.token_counts(frame(spark, rows, clash), TOKENIZER, limit=100).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 100) for r in rows]
    assert sorted((tuple(r) for r in out), key=str) == sorted(want, key=str)


def test_cache_holds_distinct_texts_and_only_misses_are_added(spark, tmp_path):
    path, rows = str(tmp_path / "cache"), messy_rows()
    first = token_count.token_counts(frame(spark, rows), TOKENIZER, path).collect()
    stored = spark.read.parquet(path)
    assert stored.count() == len({r[1] or "" for r in rows}) == stored.select("digest").distinct().count()
    # a wrong stored count comes back, which shows that nothing stored is encoded again
    spark.createDataFrame([("other", bytes(32), 5)], stored.schema).write.mode("append").parquet(path)
    again = token_count.token_counts(frame(spark, [*rows, (99, "brand new text", "en", "a", 1)]), TOKENIZER, path)
    got = sorted((tuple(r) for r in again.collect() if r["doc_id"] != 99), key=str)
    assert got == sorted((tuple(r) for r in first), key=str)
    assert spark.read.parquet(path).count() == len({r[1] or "" for r in rows}) + 2
    wrong = stored.where(F.col("tokenizer") != "other").withColumn("n_tokens", F.lit(-7).cast("long"))
    wrong.write.parquet(str(tmp_path / "wrong"))
    assert {r["n_tokens"] for r in token_count.token_counts(frame(spark, rows), TOKENIZER, str(tmp_path / "wrong")).collect()} == {-7}


def test_counts_of_a_text_that_a_third_of_all_rows_repeat(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text number {i}", "en", "a", 1) for i in range(3000)]
    out = token_count.token_counts(frame(spark, rows), TOKENIZER)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == [(r[0], len(ids(r[1]))) for r in rows]


def test_counts_of_nothing(spark):
    assert token_count.token_counts(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


def test_full_pieces_stay_out_of_the_groups(spark):
    from llm_helpers import prose
    rows = [(i, prose(random.Random(i), 400), "en", "a", 1) for i in range(6)]
    out = fit_packing.pack(frame(spark, rows), TOKENIZER, size=64).collect()
    full = [r for r in out if r["length"] == 64]
    assert len(full) > 20 and all((r["sequence_id"] < 0) == (r["length"] == 64) for r in out)
    assert len({r["sequence_id"] for r in full}) == len(full) and {r["offset"] for r in full} == {0}
