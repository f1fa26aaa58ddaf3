"""Language-model scores from a probabilistic suffix tree (operator 3).

Tokens are lower-cased words and one end token per text; the end token also
stands before the first word, as its context.  A context of d words is a
candidate when it was seen ``CONTEXT_SEEN`` times in training, whatever the
size of the corpus.  Its next-token counts are gathered over the whole training corpus,
one depth after the other, and each next token seen ``NEXT_SEEN`` times is
named.  A candidate becomes a state when the log-likelihood gained over its
suffix beats half the log of its count per next token it names (divergence
test); next tokens it does not name keep the suffix's distribution, rescaled.
Named probabilities are smoothed towards the suffix, down to the add-one
unigram base.  A token is scored by the longest suffix of its history that is
a state.

Contexts, named next tokens and states grow with the corpus, so they are
written tables, joined on 64-bit gram keys and never held by one process.
What a state adds to a token's log probability depends on the gram of context
and token alone: a state's rescaling belongs to its own gram, and a named
token's difference from that to the gram one token longer.  A text's score is
therefore the sum of the weights of its grams.  Weights of grams that make up
a share of the corpus (at most 1/share of each length) are broadcast and
summed where the text is read, which also takes the hot keys out of the join;
the others are looked up in ``SLICES`` parts by key so that only one part's
shuffle is on disk at a time.  A bitmap of fixed size says which grams can be
in a table at all, and a gram can only be there if its context is; the lookups
decide.

Occurrences of grams are by far the most rows.  They are shuffled as arrays: a
task sends what it has for a bucket of keys as one row, and a bucket is made
so small, by its share of the corpus' tokens, that it fits a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.llm.common import Tables, batch_rows, bound_batches, crc_fold, freed_shuffles, written
from chronoweave.llm.words import mix, word_hashes

END = np.uint64(0x656E642D6F66646F)
FLUSH_TOKENS = 1_000_000
PRIOR = 20.0
CONTEXT_SEEN, NEXT_SEEN = 10, 2
SLICES = 2
MAP_BITS = 27
GRAM_BUCKET, RARE_BUCKET = 1 << 20, 1 << 21  # tokens of the corpus for each bucket of keys
BATCH_BUCKETS = 16
PIECE_BYTES = 1 << 16  # hashed at once: work arrays stay in the cache
_B = 0xD1342543DE82EF95
_B_INV = pow(_B, -1, 1 << 64)


class Lookup:
    """Positions of 64-bit keys in a sorted array, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(22, int(math.log2(len(keys) + 1)) + 1))
        self.start = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int32)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Position of each asked key, -1 if absent."""
        if not len(self.keys):
            return np.full(len(asked), -1, np.int64)
        at = self.start[asked >> np.uint64(64 - self.bits)].astype(np.int64)
        last = len(self.keys) - 1
        np.minimum(at, last, out=at)
        todo = np.flatnonzero(self.keys[at] < asked)
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[self.keys[at[todo]] < asked[todo]]
        np.minimum(at, last, out=at)
        at[self.keys[at] != asked] = -1
        return at


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, an end token after each row's words, and row offsets."""
    hashes, off = word_hashes(col, PIECE_BYTES)
    rows = len(off) - 1
    out = np.empty(len(hashes) + rows, np.uint64)
    ends = off[1:] + np.arange(rows)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = hashes, END
    return out, off + np.arange(rows + 1)


def _emit(keys: list[np.ndarray], train: list[np.ndarray]):
    """A batch of distinct keys in training and one of those outside, with their occurrences (and those in training)."""
    k, in_train = np.concatenate(keys), np.concatenate(train)
    for part, times in ((k[in_train], 1), (k[~in_train], 0)):
        u, c = _distinct(part)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(c * times)], ["key", "c", "t"])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k))).astype(np.int64)


def _unigrams(batches):
    keys, train, n = [], [], 0
    for b in batches:
        k, off = tokens(b.column("_text"))
        keys.append(k)
        train.append(np.repeat(b.column("_train").to_numpy(zero_copy_only=False).astype(bool), np.diff(off)))
        n += len(k)
        if n >= FLUSH_TOKENS:
            yield from _emit(keys, train)
            keys, train, n = [], [], 0
    if n:
        yield from _emit(keys, train)


def token_counts(rows: DataFrame, tables: Tables) -> tuple[DataFrame, int, int, int]:
    """(counts of all tokens (key, c, t), tokens, training tokens, distinct training tokens) from rows (_text, _train)."""
    counts = tables.written(rows.mapInArrow(_unigrams, "key long, c long, t long").repartition("key").groupBy("key")
                     .agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "token-counts")
    all_ = counts.agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum((F.col("t") > 0).cast("long")).alias("v")).first()
    return counts, all_["c"] or 0, all_["t"] or 0, all_["v"] or 0


def spread(keys: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens with the end token before each, and the row of each."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off) + 1)
    out = np.empty(len(row), np.uint64)
    first = off[:-1] + np.arange(rows)
    rest = np.ones(len(row), bool)
    rest[first] = False
    out[first], out[rest] = END, keys
    return out, row


def windows(ext: np.ndarray, row: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of each gram of ``m`` tokens within a row."""
    start = np.flatnonzero(row[:len(row) - m + 1] == row[m - 1:]) if len(row) >= m else np.zeros(0, np.int64)
    key = ext[start]
    for j in range(1, m):
        key = key * np.uint64(_B) + ext[start + j]
    return start, key


def _map_place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = mix(keys) >> np.uint64(64 - MAP_BITS)
    return (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)


def key_map(keys: DataFrame) -> np.ndarray:
    """Bitmap of the places of the table's ``key`` column: 2 ** MAP_BITS bits at any number of keys.

    A task sends the words that are not 0 of a bitmap of its own, as one row for each part of the bitmap.
    """
    words, parts = 1 << (MAP_BITS - 6), 16
    size = words // parts

    def run(batches):
        own = np.zeros(words, np.uint64)
        for b in batches:
            word, bit = _map_place(b.column("key").to_numpy().view(np.uint64))
            np.bitwise_or.at(own, word, np.uint64(1) << bit)
        for p in range(parts):
            some = np.flatnonzero(own[p * size:(p + 1) * size])
            if len(some):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "word": [some.astype(np.uint32).tobytes()],
                                                  "bits": [own[some + p * size].tobytes()]})

    def merged(part: pa.Table) -> pa.Table:
        own = np.zeros(size, np.uint64)
        for word, bits in zip(part["word"].to_pylist(), part["bits"].to_pylist()):
            own[np.frombuffer(word, np.uint32)] |= np.frombuffer(bits, np.uint64)
        return pa.table({"part": part["part"][:1], "bits": [own.tobytes()]})

    spark = keys.sparkSession
    with batch_rows(spark, 1 << 16), freed_shuffles(spark):
        got = (keys.select("key").mapInArrow(run, "part int, word binary, bits binary")
               .groupBy("part").applyInArrow(merged, "part int, bits binary").toArrow())
    out = np.zeros((parts, size), np.uint64)
    for p, bits in zip(got["part"].to_pylist(), got["bits"].to_pylist()):
        out[p] = np.frombuffer(bits, np.uint64)
    return out.reshape(-1)


def _mapped(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bit = _map_place(keys)
    return (bits[word] >> bit & np.uint64(1)).astype(bool)


def bucket_bits(tokens: int, each: int) -> int:
    """Leading bits of a key that name its bucket, for about ``each`` tokens of the corpus a bucket."""
    return max(1, min(24, round(math.log2(max(1, tokens) / each))))


def _buckets(key: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that sorted keys have."""
    of = (key >> np.uint64(64 - bits)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return list(zip(of[new].tolist(), new.tolist(), [*new[1:].tolist(), len(of)]))


def _unpacked(col: pa.ChunkedArray, kind) -> np.ndarray:
    """All values of a column of packed arrays."""
    return np.frombuffer(b"".join(col.to_pylist()), kind)


def _gram_counts(shared, d: int, bits: int, flush: int):
    """Counts of the grams of ``d`` + 1 tokens whose first ``d`` and last ``d`` can be in the tables of the shorter
    ones, with their last and, where their key does not tell it, first token: packed, a row for each bucket."""
    high = np.uint64(pow(_B, d, 1 << 64))

    def emit(keys, last, first):
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        c = np.diff(np.append(new, len(key))).astype(np.uint32)
        key, order = key[new], order[new]
        cols = [key, np.concatenate(last)[order], *([np.concatenate(first)[order]] if d > 1 else []), c]
        found = _buckets(key, bits)
        for at in range(0, len(found), BATCH_BUCKETS):
            some = found[at:at + BATCH_BUCKETS]
            side = [x + np.argsort(cols[1][x:y]) for _, x, y in some]  # equal tokens side by side compress
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some], pa.int32()), *(pa.array([v[i].tobytes() for i in side], pa.binary()) for v in cols)],
                ["bucket", "key", "last", *["first"] * (d > 1), "c"])

    def run(batches):
        (tops, suffixes), keys, last, first, n = shared.value, [], [], [], 0
        for b in batches:
            ext, row = spread(*tokens(b.column("_text")))
            start, key = windows(ext, row, d + 1)
            ok = _mapped(tops, (key - ext[start + d]) * np.uint64(_B_INV))
            start, key = start[ok], key[ok]
            if suffixes is not None:
                ok = _mapped(suffixes, key - ext[start] * high)
                start, key = start[ok], key[ok]
            keys.append(key)
            last.append(ext[start + d])
            if d > 1:
                first.append(ext[start])
            n += len(key)
            if n >= flush:
                yield from emit(keys, last, first)
                keys, last, first, n = [], [], [], 0
        if n:
            yield from emit(keys, last, first)
    return run


def _gram_sums(d: int):
    """A bucket's grams seen ``NEXT_SEEN`` times, with context (without the last token) and suffix (without the first)."""
    high = np.uint64(pow(_B, d, 1 << 64))

    def run(bucket: pa.Table) -> pa.Table:
        key = _unpacked(bucket["key"], np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.add.reduceat(_unpacked(bucket["c"], np.uint32)[order], new, dtype=np.int64)
        new, c = new[c >= NEXT_SEEN], c[c >= NEXT_SEEN]
        key, at = key[new], order[new]
        last = _unpacked(bucket["last"], np.uint64)[at]
        suf = last if d == 1 else key - _unpacked(bucket["first"], np.uint64)[at] * high
        return pa.table({"key": key.view(np.int64), "ctx": ((key - last) * np.uint64(_B_INV)).view(np.int64),
                         "suf": suf.view(np.int64), "ends": last == END, "c": c})
    return run


def _close(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, first bytes first: the leading ones are mostly 0 and compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _opened(packed: bytes | pa.Buffer) -> np.ndarray:
    """The keys that ``_close`` packed."""
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1))


def _rare_sums(bits: int):
    """What a bucket of the table holds for the keys asked for, summed by text: packed, a row for each row of keys."""
    shared = np.uint64(bits)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys = held["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        lookup = Lookup(keys[order] << shared)  # a bucket's keys share their leading bits
        values = {c: held[c].to_numpy()[order] for c in ("base", "w", "known")}
        out = {"row": [], "texts": [], **{c: [] for c in values}}
        for i, row in enumerate(asked["row"].to_pylist()):
            packed = [asked[c][i].as_buffer() for c in ("keys", "times", "texts")]
            at = np.repeat(lookup.find(_opened(packed[0]) << shared), np.frombuffer(packed[1], np.uint32))
            text = np.frombuffer(packed[2], np.uint16)
            text, at = text[at >= 0], at[at >= 0]
            some = np.flatnonzero(np.bincount(text))
            out["row"].append(row)
            out["texts"].append(some.astype(np.uint16).tobytes())
            for c, v in values.items():
                out[c].append(np.bincount(text, v[at])[some].astype(float).tobytes())
        return pa.table([pa.array(out["row"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in list(out)[1:])], names=list(out))
    return run


def _text_sums(flush: pa.Table) -> pa.Table:
    """Each text's sums over all buckets."""
    text = _unpacked(flush["texts"], np.uint16)
    some = np.flatnonzero(np.bincount(text))
    base, w, known = (np.bincount(text, _unpacked(flush[c], float))[some] for c in ("base", "w", "known"))
    return pa.table({"row": flush["row"][0].as_py() + some, "rare_base": base, "rare_w": w, "rare_known": known.astype(np.int64)})


def gram_weights(rows: DataFrame, counts: DataFrame, total: int, room: int, depth: int, tables: Tables,
                 context_seen: int = CONTEXT_SEEN) -> DataFrame:
    """(key, c, w): the states' grams with their training counts and what each adds to a log10 probability.

    Candidates that are no states are there with 0, so that every gram of the table has its context there too.

    A gram seen as often as a named next token or a context must be has a
    suffix seen as often, so one join on the suffix finds what the next
    shorter context says of the same token; for the same reason a gram whose
    context or suffix is in no table is left out before the shuffle.  Grams
    reach the shuffle counted and packed, and are added up bucket by bucket.
    What a depth no longer needs goes at its end, the result belongs to ``tables``.
    """
    spark = rows.sparkSession
    texts = rows.where("_train").select("_text")
    lower = counts.select("key", F.log10((F.col("t") + 1) / F.lit(float(room))).alias("chance"))
    contexts = counts.where(F.col("t") >= context_seen).select("key", F.col("t").alias("seen"))
    out, bits = None, bucket_bits(total, GRAM_BUCKET)
    for d in range(1, depth + 1):
        work = Tables(spark)
        shared = spark.sparkContext.broadcast((key_map(contexts), key_map(lower) if d > 1 else None))
        found = (texts.mapInArrow(_gram_counts(shared, d, bits, FLUSH_TOKENS), "bucket int, key binary, last binary, "
                                  + "first binary, " * (d > 1) + "c binary")
                 .groupBy("bucket").applyInArrow(_gram_sums(d), "key long, ctx long, suf long, ends boolean, c long"))
        up = lower.select(F.col("key").alias("suf"), F.col("chance").alias("up"))
        pairs = work.written(found.join(up, "suf").drop("suf"), f"lm-grams-{d}")
        shared.destroy()
        told = pairs.groupBy("ctx").agg(
            F.count(F.lit(1)).alias("named"), F.sum("c").alias("own"), F.sum(F.pow(F.lit(10.0), "up")).alias("suffix"),
            F.sum(F.col("c") * (F.log("c") - F.col("up") * math.log(10))).alias("gain"))
        left, seen = F.col("seen") - F.col("own"), F.col("seen").cast("double")
        left_up = F.greatest(1 - F.col("suffix"), F.lit(1e-12))
        gain = F.col("gain") - F.col("own") * F.log(seen) + F.when(left > 0, left * F.log(F.greatest(left, F.lit(1)) / seen / left_up)).otherwise(0.0)
        rest = F.greatest(1 - (F.col("own") + PRIOR * F.col("suffix")) / (seen + PRIOR), F.lit(1e-12)) / left_up
        states = work.written(told.join(contexts.withColumnRenamed("key", "ctx"), "ctx")
                         .where(gain > 0.5 * F.log(F.greatest(seen, F.lit(2.0))) * F.col("named"))
                         .select("ctx", "seen", F.log10(rest).alias("rest")), f"lm-states-{d}")
        smooth = F.log10((F.col("c") + PRIOR * F.pow(F.lit(10.0), "up")) / (F.col("seen") + PRIOR))
        weight = smooth - F.col("up") - F.col("rest")
        own = tables.written(contexts.join(states.select(F.col("ctx").alias("key"), "rest"), "key", "left")
                             .select("key", F.col("seen").alias("c"), F.coalesce("rest", F.lit(0.0)).alias("w")), f"lm-contexts-{d}")
        named = tables.written(pairs.join(states, "ctx", "left" if d < depth else "inner")
                               .select("key", "c", "ends", F.coalesce(smooth, "up").alias("chance"), weight.alias("w")), f"lm-named-{d}")
        here = own.unionAll(named.where("w is not null").select("key", "c", "w"))
        out = here if out is None else out.unionAll(here)
        lower = named.select("key", "chance")
        contexts = named.where((F.col("c") >= context_seen) & ~F.col("ends")).select("key", F.col("c").alias("seen"))
        work.drop()
    # a gram of 2 tokens or more can be both a named token's and a state's
    return out.groupBy("key").agg(F.max("c").alias("c"), F.sum("w").alias("w"))


def score(docs: DataFrame, depth: int = 3, context_seen: int = CONTEXT_SEEN, token_share: float = 5e-7, id_col: str = "doc_id",
          text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Rows whose crc32(id as text) modulo ``folds`` is ``held_out`` take no part
    in training (a null id counts as empty text).  n_known counts tokens seen
    in training, base_score is the add-one unigram log10 probability, score
    the suffix tree's.  A null or wordless text is its end token.  Repeated
    rows are trained on and scored as often as they occur; without training
    rows every probability is 1 over one, so scores are 0.  Weights of
    tokens and grams that make up ``token_share`` of all tokens are broadcast
    (2 million of each length at most by default), others joined; this
    changes no score.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       (crc_fold(id_col, folds) != held_out).alias("_train"))
    tables = Tables(spark)
    counts, every, total, distinct = token_counts(rows, tables)
    room = total + distinct + 1
    weights = gram_weights(rows, counts, total, room, depth, tables, context_seen)
    facts = written(
        counts.withColumnRenamed("c", "n").join(weights.select("key", F.col("c").alias("seen"), "w"), "key", "full").select(
            "key", F.coalesce("w", F.lit(0.0)).alias("w"), F.col("n").isNotNull().alias("token"), F.col("seen").isNotNull().alias("gram"),
            F.coalesce(F.log10((F.col("t") + 1) / F.lit(float(room))), F.lit(0.0)).alias("base"),
            F.coalesce((F.col("t") > 0).cast("long"), F.lit(0).cast("long")).alias("known"),
            (F.when(F.col("n").isNotNull(), F.col("n") >= max(1.0, token_share * every))
             .otherwise(F.col("seen") >= max(1.0, token_share * total))
             | (F.col("key") == F.lit(int(END)))).alias("hot")), "lm-facts")
    tables.drop()
    hot = facts.where("hot").select("key", "w", "base", "known", "gram").toArrow()
    order = np.argsort(hot["key"].to_numpy().view(np.uint64))
    held = {c: hot[c].to_numpy()[order] for c in ("key", "w", "base", "known", "gram")}
    cold = facts.where("not hot")
    shared = spark.sparkContext.broadcast((Lookup(held["key"].view(np.uint64)), held["w"], held["base"], held["known"], held["gram"],
                                           key_map(cold.where("gram"))))
    kind = rows.schema["_id"].dataType.simpleString()
    id_kind = to_arrow_type(rows.schema["_id"].dataType)
    bits, flush = bucket_bits(every, RARE_BUCKET), FLUSH_TOKENS
    names = ["_id", "_train", "n", "known", "base", "log", "row", "bucket", "keys", "times", "texts"]

    def emit(first, rare_row, rare):
        """The texts' rare keys, a row for each bucket: distinct keys, how often each occurs, and in which texts."""
        key, of = np.concatenate(rare), np.concatenate(rare_row)
        order = np.argsort(key)
        key, of = key[order], (of[order] - first).astype(np.uint16)
        for at in range(0, len(found := _buckets(key, bits)), BATCH_BUCKETS):
            some = found[at:at + BATCH_BUCKETS]
            sums = [_distinct(key[x:y]) for _, x, y in some]
            lone = lambda x: pa.nulls(len(some), x)
            yield pa.RecordBatch.from_arrays(
                [lone(id_kind), lone(pa.bool_()), lone(pa.int64()), lone(pa.int64()), lone(pa.float64()), lone(pa.float64()),
                 pa.array([first] * len(some), pa.int64()), pa.array([x[0] for x in some], pa.int32()),
                 pa.array([_close(k) for k, _ in sums], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in sums], pa.binary()),
                 pa.array([of[x:y].tobytes() for _, x, y in some], pa.binary())], names)

    def run(batches):
        lookup, w, base, known, gram, tops = shared.value
        # rows are numbered within their task
        first = here = TaskContext.get().partitionId() << 40
        all_row, all_rare, held = [], [], 0
        for b in batches:
            keys, off = tokens(b.column("_text"))
            n = len(b)
            per = lambda row, x: np.bincount(row, x, n).astype(float)
            ext, of = spread(keys, off)
            found = lookup.find(ext)
            # a word is a token and a context; the end token is one after the text and the other before it
            token = np.ones(len(ext), bool)
            token[off[:-1] + np.arange(n)] = False
            row, at = of[token], found[token]
            yes = at >= 0
            rare_row, rare = [row[~yes]], [ext[token][~yes]]
            row, at = row[yes], at[yes]
            sums = per(row, base[at])
            log, seen = sums + per(row, w[at]), per(row, known[at]).astype(np.int64)
            # a gram is in a table only if its context is
            may = np.zeros(len(ext), bool)
            may[found >= 0] = gram[found[found >= 0]]
            may[found < 0] = _mapped(tops, ext[found < 0])
            start = np.flatnonzero(may)
            key, end = ext[start], np.append(of, np.full(depth, -1))
            for m in range(1, depth + 1):
                ok = end[start + m] == of[start]
                start = start[ok]
                key = key[ok] * np.uint64(_B) + ext[start + m]
                at = lookup.find(key)
                yes = at >= 0
                log += per(of[start[yes]], w[at[yes]])
                cold_start, cold_key = start[~yes], key[~yes]
                ok = _mapped(tops, cold_key)
                cold_start, cold_key = cold_start[ok], cold_key[ok]
                rare_row.append(of[cold_start])
                rare.append(cold_key)
                start, key = np.concatenate([start[yes], cold_start]), np.concatenate([key[yes], cold_key])
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_train"), pa.array(np.diff(off)), pa.array(seen), pa.array(sums), pa.array(log),
                 pa.array(here + np.arange(n)), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], names)
            all_row += [here + x for x in rare_row]
            all_rare += rare
            held += sum(map(len, rare))
            here += n
            if held >= flush or here - first >= 1 << 15:  # texts of a flush are told apart by 16 bits
                yield from emit(first, all_row, all_rare)
                first, all_row, all_rare, held = here, [], [], 0
        if held:
            yield from emit(first, all_row, all_rare)

    every_part = written(rows.mapInArrow(run, f"_id {kind}, _train boolean, n long, known long, base double, log double, row long, "
                                              "bucket int, keys binary, times binary, texts binary"), "lm-parts")
    shared.destroy()
    parts = every_part.where("bucket is null")
    of_key = F.shiftrightunsigned("key", 64 - bits).cast("int")
    sums = None
    for i in range(SLICES):
        mine = F.col("bucket") % SLICES == i
        asked = every_part.where(mine).select("bucket", "row", "keys", "times", "texts")
        table = cold.select(of_key.alias("bucket"), "key", "w", "base", "known").where(mine)
        rare = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(
            _rare_sums(bits), "row long, texts binary, base binary, w binary, known binary")
        with batch_rows(spark, 1 << 16):
            some = written(rare.groupBy("row").applyInArrow(_text_sums, "row long, rare_base double, rare_w double, rare_known long"),
                           f"lm-rare-{i}")
        sums = some if sums is None else sums.unionAll(some)
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("rare_base", "rare_w", "rare_known")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return parts.join(sums, "row", "left").select(
        F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("log") + F.coalesce("rare_base", F.lit(0.0)) + F.coalesce("rare_w", F.lit(0.0))).alias("score"))
