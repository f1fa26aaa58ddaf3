"""Near-duplicate classes by min-max hashing (operator 5).

Each of 64 permutations of the 64-bit shingle hashes gives two signature
values, its minimum and its maximum, so 128 values cost 64 evaluations.  32
bands of two minima and two maxima (of four permutations) deal documents into
buckets; a pair of similarity 0.75 shares no bucket with probability
(1 - 0.75**4)**32, about 5 in a million.

Texts with equal shingle sets are one *node*.  Inside a bucket nothing is
paired with everything:

1. Each bucket picks as centre the node that meets most others over all
   bands, and its members are compared with the centre.
2. Links so far give components.  Only buckets that still hold several
   components go on, and there only pairs of different components.
3. In large buckets of that kind, shingles that no other node there has bound
   what a node can share: J <= m / (n + n' - m) with m its shared shingles.
   Nodes that cannot reach the threshold with the smallest member leave the
   bucket.  The others carry a bitmap of the centre's shingles they hold; two
   members share at most the common bits plus the smaller number of shared
   shingles outside the centre.
4. Members outside the largest component are compared with all members, in
   chunks: sizes, signatures and those bounds leave the pairs to confirm.

A signature estimate five deviations under the threshold drops a pair before
its sets are fetched; every link is confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Tables, batch_rows, bound_batches, written
from chronoweave.llm.words import mix, shingle_sets, word_hashes

PERMUTATIONS, BANDS = 64, 32
LARGE_BUCKET = 64        # members from which a mixed bucket is thinned before its pairs are formed
CHUNK_OUT, CHUNK_ALL = 64, 256
BROADCAST_ROWS = 1_000_000
_rng = np.random.default_rng(77)
_A = (_rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None]
_SEED = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation over a set: 2 * PERMUTATIONS values."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for s in range(0, len(shingles), 1024):
        h = shingles[None, s:s + 1024] * _A + _B
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band: two minima and two maxima, all of different permutations."""
    low, high = signatures[:, :PERMUTATIONS], np.roll(signatures[:, PERMUTATIONS:], -2, axis=1)
    key = np.broadcast_to(_SEED, (len(signatures), BANDS)).copy()
    for part in (low[:, 0::2], low[:, 1::2], high[:, 0::2], high[:, 1::2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


def _sketch(k: int):
    def run(batches):
        for b in batches:
            hashes, off = word_hashes(b.column("_text"))
            count, node, sig = [], [], np.zeros((len(b), 2 * PERMUTATIONS), np.uint64)
            for i, s in enumerate(shingle_sets(hashes, off, k)):
                count.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    sig[i] = min_max(s)
            keys = pa.array(band_keys(sig).view(np.int64).reshape(-1))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * BANDS), keys)
            small = [x.tobytes() for x in sig.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_text_key"), pa.array(count, pa.int64()), pa.array(node, pa.binary()),
                 bands, pa.array(small, pa.binary())], ["_id", "_text_key", "n", "node", "bands", "sig"])
    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            hashes, off = word_hashes(b.column("_text"))
            made = list(shingle_sets(hashes, off, k))
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in made]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int32)
            flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "set"])
    return run


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= limit else df


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b); comp is the component's smallest node.

    Every round each node takes the smallest of itself and its neighbours and
    that one's own choice, then links are redrawn between the choices.  Rounds
    end when no link joins two choices.  The rounds' tables go at the end;
    the result belongs to ``tables``.
    """
    with Tables(links.sparkSession) as work:
        total = _chosen(links, work)
        return (tables or Tables(links.sparkSession)).written(total, "components")


def _chosen(links: DataFrame, work: Tables) -> DataFrame:
    written = work.written
    edges = written(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    total = written(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("comp")), "comp")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b"))
                     .select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "up")
        next_ = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = written(up.join(next_, "up").select("node", F.col("top").alias("up")), "up")
        total = written(total.join(up.withColumnRenamed("node", "comp"), "comp", "left")
                        .select("node", F.coalesce("up", "comp").alias("comp")), "comp")
        for end in ("a", "b"):
            edges = (edges.join(up.withColumnRenamed("node", end), end)
                     .select(F.col("up").alias(end), "b" if end == "a" else "a"))
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where(F.col("a") != F.col("b")).distinct(), "edges")
    return total


class _Finder:
    """The steps over one table of documents.  ``tables`` owns what later steps read; a step's own tables go at its end."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, part: int, whole: int, tables: Tables):
        bound_batches(docs.sparkSession)
        self.tables = tables
        self.spark, self.k, self.part, self.whole = docs.sparkSession, k, part, whole
        j = part / whole
        self.estimate = j - 5 * math.sqrt(j * (1 - j) / (2 * PERMUTATIONS))
        self.rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        kind = self.rows.schema["_id"].dataType.simpleString()
        self.sketch = tables.written(
            self.rows.withColumn("_text_key", F.xxhash64("_text")).mapInArrow(
                _sketch(k), f"_id {kind}, _text_key long, n long, node binary, bands array<bigint>, sig binary"), "sketch")

    def sets(self, nodes: DataFrame, work: Tables) -> DataFrame:
        """Shingle sets of the listed nodes, computed in one pass over the texts."""
        made = self.rows.select("_text").mapInArrow(_sets(self.k), "node binary, set array<bigint>")
        return work.written(made.join(_small(nodes), "node", "left_semi").dropDuplicates(["node"]), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) whose full sets reach the threshold."""
        if not pairs.limit(1).count():
            return pairs
        with Tables(self.spark) as work:
            return self._confirmed(pairs, work)

    def _confirmed(self, pairs: DataFrame, work: Tables) -> DataFrame:
        part, whole = self.part, self.whole
        ends = work.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-ends")
        sets = self.sets(ends, work)

        def check(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column("sa"), b.column("sb")):
                    x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(whole * same >= part * (len(x) + len(y) - same))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = sets.join(_small(work.written(pairs.select(F.col("a").alias("node")).distinct(), "pair-left")), "node", "left_semi")
        full = (pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
                .join(left.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a"))
        with batch_rows(self.spark, 64):
            return self.tables.written(full.select("a", "b", "sa", "sb").mapInArrow(check, "a binary, b binary"), "links")

    def buckets(self) -> DataFrame:
        """(key, node, n, sig, size, meets) of the buckets with two nodes or more."""
        with Tables(self.spark) as work:
            nodes = work.written(self.sketch.where(F.col("node").isNotNull()).select("node", "n", "bands", "sig")
                            .dropDuplicates(["node"]), "nodes")
            dealt = nodes.select("node", F.explode("bands").alias("key"))
            shared = work.written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "keys")
            met = work.written(dealt.join(shared, "key"), "met")
            degree = work.written(met.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets")), "degree")
            facts = work.written(nodes.drop("bands").join(degree, "node"), "facts")
            return self.tables.written(met.join(facts, "node"), "buckets")

    def stars(self, buckets: DataFrame) -> DataFrame:
        """Pairs (a: centre, b: member) that sizes and signatures allow."""
        self.centre = self.tables.written(buckets.groupBy("key").agg(F.max(F.struct("meets", "node", "n", "sig")).alias("c")), "centres")
        pairs = (buckets.join(self.centre, "key").where(F.col("node") != F.col("c.node"))
                 .where(self.whole * F.least("n", "c.n") >= self.part * F.greatest("n", "c.n"))
                 .select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.sig").alias("sa"), F.col("sig").alias("sb")))
        least = self.estimate

        def close(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), -1) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

        return self.tables.written(pairs.mapInArrow(close, "a binary, b binary").distinct(), "star-pairs")

    def thin(self, mixed: DataFrame, work: Tables) -> DataFrame:
        """Large mixed buckets without the nodes that no other component there can reach; the rest with their
        bitmap over the bucket's centre (``bits``) and their shared shingles outside it (``extra``)."""
        mixed = work.written(mixed.drop("bits", "extra").join(
            self.centre.select("key", F.col("c.node").alias("centre")), "key"), "large-members")
        sets = self.sets(work.written(mixed.select(F.explode(F.array("node", "centre")).alias("node")).distinct(), "large-nodes"), work)
        alone = (sets.select("node", F.explode("set").alias("x")).groupBy("x")
                 .agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where(F.col("c") == 1)
                 .groupBy("node").agg(F.count(F.lit(1)).alias("own")))
        least = mixed.groupBy("key").agg(F.min("n").alias("least_n"))
        known = mixed.join(work.written(alone, "own-shingles"), "node", "left").join(work.written(least, "least"), "key")
        m = F.col("n") - F.coalesce("own", F.lit(0))
        # J >= part/whole with a set of n' shingles needs whole * m >= part * (n + n' - m)
        able = self.whole * m >= self.part * (F.col("n") + F.greatest("least_n", m) - m)
        known = work.written(known.withColumn("shared", m).where(able).drop("own", "least_n"), "able-members")
        pairs = known.select("centre", "node").distinct()
        full = (pairs.join(sets.select("node", F.col("set").alias("sb")), "node")
                .join(sets.select(F.col("node").alias("centre"), F.col("set").alias("sa")), "centre"))

        def overlap(batches):
            for b in batches:
                bits, same = [], []
                for x, y in zip(b.column("sa"), b.column("sb")):
                    hit = np.isin(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False),
                                  assume_unique=True)
                    bits.append(np.packbits(hit).tobytes())
                    same.append(int(hit.sum()))
                yield pa.RecordBatch.from_arrays([b.column("centre"), b.column("node"), pa.array(bits, pa.binary()),
                                                  pa.array(same, pa.int64())], ["centre", "node", "bits", "same"])

        with batch_rows(self.spark, 64):
            over = work.written(full.select("centre", "node", "sa", "sb")
                           .mapInArrow(overlap, "centre binary, node binary, bits binary, same long"), "centre-bits")
        # a centre's own shingles may be unshared, so what lies outside is at least 0
        return (known.join(over, ["centre", "node"])
                .withColumn("extra", F.greatest(F.col("shared") - F.col("same"), F.lit(0).cast("long")))
                .drop("centre", "same", "shared"))

    def mixed(self, members: DataFrame) -> DataFrame:
        """Members of buckets with several components, with the bucket's size and whether a member is outside its largest one."""
        sizes = self.tables.written(members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")), "comp-sizes")
        kinds = self.tables.written(sizes.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"),
                                                 F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1), "mixed-keys")
        return self.tables.written(members.drop("size").join(kinds, "key").select(
            "key", "node", "n", "sig", "comp", "bits", "extra", "size", (F.col("comp") != F.col("top.comp")).alias("out"),
            (F.col("size") - F.col("top.c")).alias("outs")), "mixed")

    def cross(self, mixed: DataFrame) -> DataFrame:
        """Pairs of different components within buckets, chunk against chunk, that sizes and signatures allow."""
        k_out, k_all = F.ceil(F.col("outs") / CHUNK_OUT), F.ceil(F.col("size") / CHUNK_ALL)
        row = F.struct("node", "n", "sig", "comp", "bits", "extra")
        here = lambda k: F.pmod(F.xxhash64("node"), k)
        out = (mixed.where("out").select("key", row.alias("r"), here(k_out).alias("i"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), k_all - 1)).alias("j"))
               .groupBy("key", "i", "j").agg(F.collect_list("r").alias("outs")))
        all_ = (mixed.select("key", row.alias("r"), here(k_all).alias("j"),
                             F.explode(F.sequence(F.lit(0).cast("long"), k_out - 1)).alias("i"))
                .groupBy("key", "i", "j").agg(F.collect_list("r").alias("members")))
        least, part, whole = self.estimate, self.part, self.whole

        def read(v):
            v = v.values
            sig = np.frombuffer(b"".join(v.field("sig").to_pylist()), np.uint8).reshape(len(v), -1)
            bits = None
            if not v.field("bits").null_count:
                bits = np.unpackbits(np.frombuffer(b"".join(v.field("bits").to_pylist()), np.uint8).reshape(len(v), -1),
                                     axis=1).astype(np.float32)
            return v.field("node").to_pylist(), v.field("n").to_numpy(), sig, v.field("comp").to_pylist(), bits, v.field("extra")

        def compare(batches):
            for b in batches:
                a_, b_ = [], []
                for x, y in zip(b.column("outs"), b.column("members")):
                    (n1, c1, s1, k1, b1, e1), (n2, c2, s2, k2, b2, e2) = read(x), read(y)
                    e1, e2 = (e.to_numpy(zero_copy_only=False) for e in (e1, e2))
                    for i in range(len(n1)):
                        ok = (s2 == s1[i]).mean(axis=1) >= least
                        ok &= whole * np.minimum(c1[i], c2) >= part * np.maximum(c1[i], c2)
                        if b1 is not None and b2 is not None:  # both of a large bucket, over the same centre
                            most = b2 @ b1[i] + np.minimum(e1[i], e2)
                            ok &= whole * most >= part * (c1[i] + c2 - most)
                        for j in np.flatnonzero(ok).tolist():
                            if k1[i] != k2[j]:
                                a_.append(min(n1[i], n2[j]))
                                b_.append(max(n1[i], n2[j]))
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], ["a", "b"])

        with batch_rows(self.spark, 32):
            return self.tables.written(out.join(all_, ["key", "i", "j"]).select("outs", "members")
                           .mapInArrow(compare, "a binary, b binary").distinct(), "cross-pairs")

    def classes(self) -> DataFrame:
        """(node, comp) of all linked nodes."""
        buckets = self.buckets()
        stars = self.stars(buckets)
        links = self.confirm(stars)
        comp = components(links, self.tables)
        members = self.mixed(buckets.join(comp, "node", "left")
                             .withColumn("comp", F.coalesce("comp", "node"))
                             .withColumn("bits", F.lit(None).cast("binary")).withColumn("extra", F.lit(None).cast("long")))
        large = members.where(F.col("size") > LARGE_BUCKET)
        if large.limit(1).count():
            with Tables(self.spark) as work:
                rest = self.mixed(work.written(self.thin(large, work), "thinned"))
            members = members.where(F.col("size") <= LARGE_BUCKET).unionByName(rest)
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self.tables.written(self.cross(members).join(tried, ["a", "b"], "left_anti"), "new-pairs")
        more = self.confirm(pairs)
        if not more.limit(1).count():
            return comp
        return components(links.unionByName(more), self.tables)

    def documents(self) -> DataFrame:
        """(_id, _text_key, n, node, comp, component_id) per row; comp names the class, which its smallest id need not."""
        least = self.sketch.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("_id").alias("first"))
        first = self.tables.written(least, "first-ids")
        comp = self.classes()
        named = self.tables.written(first.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
        lowest = self.tables.written(named.groupBy("comp").agg(F.min("first").alias("component_id")), "lowest")
        named = self.tables.written(named.join(lowest, "comp").select("node", "comp", "component_id"), "node-classes")
        return (self.sketch.select("_id", "_text_key", "n", "node").join(named, "node", "left")
                .withColumn("component_id", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 75,
                    whole: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept per row.

    Documents are linked when ``whole`` * |intersection| >= ``part`` * |union|
    of their sets of distinct ``k``-word shingles; a text of fewer words has
    its whole sequence as one shingle.  component_id is the smallest id that
    links reach, kept says that it is the row's own.  Null, empty and
    wordless texts have no shingle, no link, and are kept.  Repeated rows and
    rows that share an id keep that id's verdict each; a null id never is a
    smallest id, and counts as kept only where its class has no id at all.
    """
    with Tables(docs.sparkSession) as tables:
        found = _Finder(docs, id_col, text_col, k, part, whole, tables).documents()
        return tables.written(found.select(
            F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
            F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")), "near-duplicates", keep=True)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 75,
         whole: int = 100) -> DataFrame:
    """One row of ``docs`` per class, with its columns unchanged: the smallest id (then the smallest text hash).

    Rows without words are classes of their own.  Of rows equal in id and
    text, one stays.  The rows to drop are found on ids and text hashes; they
    are broadcast only up to ``BROADCAST_ROWS`` of them.
    """
    with Tables(docs.sparkSession) as tables:
        finder = _Finder(docs, id_col, text_col, k, part, whole, tables)
        found = tables.written(finder.documents().where(F.col("node").isNotNull()).select("_id", "_text_key", "comp"),
                               "classes", keep=True)
    best = written(found.groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_text_key"))
                                             .alias("s")), "stays")
    drop = (found.join(best, "comp")
            .where(~(F.col("_id").eqNullSafe(F.col("s._id")) & (F.col("_text_key") == F.col("s._text_key"))))
            .select("_id", "_text_key").distinct())
    drop = _small(written(drop, "drops"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rest = docs.join(drop, docs[id_col].eqNullSafe(drop["_id"]) & (key == drop["_text_key"]), "left_anti")
    twice = found.groupBy("_id", "_text_key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    if twice.join(drop, twice["_id"].eqNullSafe(drop["_id"]) & (twice["_text_key"] == drop["_text_key"]), "left_anti").limit(1).count():
        wordless = F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\f\r", "") == ""
        rest = rest.where(~wordless).dropDuplicates([id_col, text_col]).unionByName(rest.where(wordless))
    return rest
