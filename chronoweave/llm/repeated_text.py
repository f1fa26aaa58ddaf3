"""Removal of byte strings that repeat anywhere in the corpus (operator 11).

Every ``window`` bytes long string that starts at two places is found by
sorting suffixes, dealt so that no task needs more than a bounded piece:

1. *Anchors.*  Inside a window the ``k``-byte string with the smallest hash
   (the first of them) is its anchor.  Equal windows have equal anchors at
   equal places, so only windows around one anchor string can be equal.  The
   windows of one anchor place form one run; run and bytes are its *context*.
   Anchor strings seen once are done with.
2. *Cells.*  Equal contexts are one cell with a count.  A context that occurs
   twice repeats as a whole, so copies are settled before anything is sorted.
3. *Parts.*  The windows of a cell are cut by their anchor offset into blocks
   of ``width``.  All windows of a block share their middle, the *core*: a
   part is its left flank, one symbol for the core, its right flank, and each
   of its windows is ``width`` symbols long.
4. *Sort.*  The parts of one core, joined with separators, are ordered by
   ``suffix_groups.suffix_array``; windows that repeat are neighbours there
   and are compared symbol by symbol.
5. A core with more than ``GROUP`` different parts is never sorted in one
   piece: its parts are cut into narrower blocks with longer cores, in the end
   single windows, whose count alone decides.

What travels between the steps are hashes, places and flanks; texts are read
in place, three times.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Tables, batch_rows
from chronoweave.llm.suffix_groups import suffix_array
from chronoweave.llm.words import _BYTE as _FOLDED
from chronoweave.llm.words import _powers, buffers

PIECE = 1 << 20          # windows hashed at a time
GROUP = 8192             # different parts of one core that are sorted together
BUCKET_SYMBOLS = 1 << 18  # symbols that one sorted bucket aims at
BROADCAST_ROWS = 200_000
HEAVY = 10_000           # a context with at least 1/HEAVY of all places is heavy: at most HEAVY of them
_BYTE = _FOLDED.copy()   # one odd number for each byte, upper case apart from lower
_BYTE[65:91] = np.random.default_rng(11).integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(window: int) -> int:
    """Windows that may share an anchor: the power of two up to 0.64 * ``window``."""
    return 1 << max(0, (window * 16 // 25).bit_length() - 1)


def _spans(off: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
    """(first byte, last byte, row offsets inside, first row, place in that row) of pieces; long rows overlap by a window."""
    row, rows = 0, len(off) - 1
    while row < rows:
        if off[row + 1] - off[row] > PIECE + window:
            for at in range(0, int(off[row + 1] - off[row]) - window + 1, PIECE):
                a = int(off[row]) + at
                b = min(a + PIECE + window - 1, int(off[row + 1]))
                yield a, b, np.array([0, b - a]), row, at
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, side="right")) - 1)
        yield int(off[row]), int(off[end]), off[row:end + 1] - off[row], row, 0
        row = end


def anchors(raw: np.ndarray, off: np.ndarray, window: int) -> Iterator[tuple]:
    """Arrays (row, first window, last window, anchor place, anchor hash) of the runs, piece by piece."""
    many = runs(window)
    k = window - many + 1
    for a, b, inner, row, place in _spans(off, window):
        n = b - a
        if n < window:
            continue
        up, down = _powers(n + 1)
        value = _BYTE[raw[a:b]]
        value *= up[:n]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        h = total[k:] - total[:-k]
        h *= down[:len(h)]
        h *= _ODD
        least = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)  # smallest hash, then first place
        wide = 1
        while wide < many:  # minima over 2, 4, ... neighbours
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        start = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(least[1:] != least[:-1]) + 1])
        at = (least[start] & _POS).astype(np.int64)
        doc = np.searchsorted(inner, at, side="right") - 1
        # windows that cross into another row do not count
        first = np.maximum(start, inner[doc])
        last = np.minimum(np.append(start[1:], len(least)) - 1, inner[doc + 1] - window)
        ok = first <= last
        doc, first, last, at = doc[ok], first[ok], last[ok], at[ok]
        base = inner[doc] - place
        yield row + doc, first - base, last - base, at - base, h[at]


def _anchor_counts(window: int):
    def run(batches):
        for b in batches:
            raw, off = buffers(b.column("_text"))
            for *_, h in anchors(raw, off, window):
                h, c = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])
    return run


def _contexts(window: int):
    def run(batches):
        for b in batches:
            raw, off = buffers(b.column("_text"))
            view = memoryview(raw)
            for row, lo, hi, at, h in anchors(raw, off, window):
                begin = off[row] + lo
                g = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in
                                 zip(begin.tolist(), (off[row] + hi + window).tolist())), np.uint64, len(row))
                k1, k2 = (b.column(c).to_numpy()[row] for c in ("k1", "k2"))
                # the last window and the anchor lie less than a window behind the first one
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)),
                     pa.array(lo << 24 | (at - lo) << 12 | (hi - lo))], ["k1", "k2", "h", "g", "place"])
    return run


def _cells(window: int):
    """Flanks of the listed contexts of each text: the bytes of a context before and after its anchor string."""
    k = window - runs(window) + 1

    def run(batches):
        for b in batches:
            raw, off = buffers(b.column("_text"))
            out = {c: [] for c in ("h", "g", "n", "core", "left", "right")}
            for start, todo in zip(off.tolist(), b.column("todo").to_pylist()):
                for t in todo:
                    lo = start + (t["place"] >> 24)
                    at, end = lo + (t["place"] >> 12 & 4095), lo + (t["place"] & 4095) + window
                    for c in ("h", "g", "n"):
                        out[c].append(t[c])
                    out["core"].append(xxhash.xxh3_128_digest(raw[at:at + k].tobytes()))
                    out["left"].append(raw[lo:at].tobytes())
                    out["right"].append(raw[at + k:end].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))
    return run


def cut_part(core: bytes, left: bytes, right: bytes, r: int, wide: int, width: int) -> Iterator[tuple]:
    """(core, left, right, r) of the blocks of ``width`` offsets that a part of ``wide`` offsets from ``r`` on holds.

    Offsets are those of the anchor in a window.  The part's windows have the
    offsets r + wide - 1 - len(right) to r + len(left).
    """
    low, high = r + wide - 1 - len(right), r + len(left)
    for r1 in range(r, r + wide, width):
        r2 = r1 + width - 1
        a, b = max(low, r1), min(high, r2)
        if a > b:
            continue
        near, far = len(left) - (r1 - r), r + wide - 1 - r2
        inner = xxhash.xxh3_128_digest(b"%s:%d:%b%b" % (core, r1, left[near:], right[:far]))
        yield inner, left[len(left) - (b - r):near], right[far:r + wide - 1 - a], r1


def _parts(wide: int, width: int):
    def run(batches):
        for b in batches:
            out = {c: [] for c in ("h", "g", "n", "core", "left", "right", "r", "s")}
            for m in b.to_pylist():
                for core, left, right, r in cut_part(m["core"], m["left"], m["right"], m["r"], wide, width):
                    s = xxhash.xxh3_128_digest(b"%b%d:%b%b" % (core, len(left), left, right))
                    for c, v in zip(out, (m["h"], m["g"], m["n"], core, left, right, r, s)):
                        out[c].append(v)
            kinds = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))
    return run


def repeated(parts: list[tuple[bytes, bytes, bytes]], width: int) -> list[np.ndarray]:
    """Per part (core, left, right) whether each of its windows, leftmost first, equals another one of these parts."""
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    begin, starts = [], []
    for core, left, right in parts:
        begin.append(len(symbols))
        symbols += [x + 2 for x in left]
        symbols.append(258 + number.setdefault(core, len(number)))
        symbols += [x + 2 for x in right]
        starts.append(len(symbols) - begin[-1] - width + 1)
        symbols.append(1)  # separator
    flat = np.asarray(symbols, np.int64)
    window = np.zeros(len(flat), bool)
    for at, many in zip(begin, starts):
        window[at:at + many] = True
    collecting = gc.isenabled()
    gc.disable()  # the sort makes many lists and no cycles
    try:
        order = suffix_array(symbols)
    finally:
        if collecting:
            gc.enable()
    twin = np.zeros(len(flat), bool)
    side = np.flatnonzero(window[order[:-1]] & window[order[1:]])
    for i in range(0, len(side), 1 << 15):
        x, y = order[side[i:i + (1 << 15)]], order[side[i:i + (1 << 15)] + 1]
        same = np.ones(len(x), bool)
        for j in range(width):
            same &= flat[x + j] == flat[y + j]
        twin[x[same]] = True
        twin[y[same]] = True
    return [twin[at:at + many] for at, many in zip(begin, starts)]


def _sorted_parts(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["s", "n", "core", "left", "right", "r"]).to_pylist()
        s, low, high = [], [], []
        for m, hit in zip(rows, repeated([(m["core"], m["left"], m["right"]) for m in rows], width)):
            if m["n"] > 1:  # repeats as a whole, it was sorted for its neighbours' sake
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            top = m["r"] + len(m["left"])  # the leftmost window's offset
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                s.append(m["s"])
                low.append(top - b + 1)
                high.append(top - a)
        return pa.table([pa.array(s, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                        names=["s", "low", "high"])
    return run


def _merged(batches):
    for b in batches:
        out = []
        for spans in b.column("spans"):
            v = np.sort(spans.values.to_numpy(zero_copy_only=False))
            start, end = v >> 32, np.maximum.accumulate(v & 0xFFFFFFFF)
            gap = np.flatnonzero(start[1:] > end[:-1])
            out.append(np.stack([start[np.append(0, gap + 1)], end[np.append(gap, len(end) - 1)]], axis=1).ravel())
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(out, pa.list_(pa.int64()))],
                                         ["k1", "k2", "cuts"])


def _kept(batches):
    for b in batches:
        raw, off = buffers(b.column("_text"))
        size, gone, spans, sha = np.diff(off), [], [], []
        for start, end, cuts in zip(off[:-1].tolist(), off[1:].tolist(), b.column("cuts").to_pylist()):
            cuts = cuts or []
            digest, at = hashlib.sha256(), start
            for a, z in zip(cuts[::2], cuts[1::2]):
                digest.update(raw[at:start + a])
                at = start + z
            digest.update(raw[at:end])
            gone.append(sum(cuts[1::2]) - sum(cuts[::2]))
            spans.append(len(cuts) // 2)
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(sha, pa.string()), pa.array([c or [] for c in b.column("cuts").to_pylist()], pa.list_(pa.int64()))],
            ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cuts"])


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a written table if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= limit else df


def _marks(tables: Tables, mixed: DataFrame, texts: DataFrame, window: int) -> DataFrame | None:
    """(h, g, low, high): anchor offsets of repeated windows of the cells that share their anchor string with others."""
    want = tables.written(mixed.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "g", "n", "place")).alias("todo")), "wanted")
    found = texts.join(_small(want, BROADCAST_ROWS), ["k1", "k2"]).select("_text", "todo")
    members = tables.written(
        found.mapInArrow(_cells(window), "h long, g long, n long, core binary, left binary, right binary")
        .dropDuplicates(["h", "g"]).withColumn("r", F.lit(0).cast("long")), "flanks")
    wide, marks = runs(window), []
    for width in sorted({max(1, wide // 4), max(1, wide // 32), 1}, reverse=True):
        parts = tables.written(members.select("h", "g", "n", "core", "left", "right", "r").mapInArrow(
            _parts(wide, width), "h long, g long, n long, core binary, left binary, right binary, r long, s binary"), "parts")
        kinds = tables.written(parts.groupBy("s").agg(
            F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("core", "left", "right", "r")]), "kinds")
        groups = tables.written(kinds.groupBy("core").agg(
            F.count(F.lit(1)).alias("d"), F.sum(F.length("left") + F.length("right") + 2).alias("symbols"),
            F.max(F.col("n") == 1).alias("open")).where((F.col("d") > 1) & F.col("open")), "groups")
        small = groups.where(F.col("d") <= GROUP)
        whole = kinds.where(F.col("n") > 1).select("s", (F.col("r") + (width - 1) - F.length("right")).alias("low"),
                                                   (F.col("r") + F.length("left")).alias("high"))
        symbols = small.agg(F.sum("symbols")).first()[0] or 0
        buckets = max(1, -(-symbols // BUCKET_SYMBOLS))
        hits = whole
        if symbols:
            dealt = (kinds.join(_small(small.select("core"), BROADCAST_ROWS), "core")
                     .withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets))))
            hits = whole.union(dealt.groupBy("bucket").applyInArrow(_sorted_parts(width), "s binary, low long, high long"))
        hits = tables.written(hits, "hits")
        marks.append(tables.written(parts.select("h", "g", "s").join(_small(hits, BROADCAST_ROWS), "s")
                                    .select("h", "g", "low", "high"), "part-marks"))
        big = tables.written(groups.where(F.col("d") > GROUP).select("core"), "large-cores")
        if not big.limit(1).count():
            break
        members, wide = tables.written(parts.join(_small(big, BROADCAST_ROWS), "core", "left_semi").drop("s"), "members"), width
    out = marks[0]
    for m in marks[1:]:
        out = out.union(m)
    return out


def repeated_spans(tables: Tables, texts: DataFrame, window: int) -> DataFrame:
    """(k1, k2, cuts) of the texts that hold repeated strings: the removed runs as [from, to, from, to, ...] bytes."""
    counts = texts.select("_text").mapInArrow(_anchor_counts(window), "h long, c long")
    live = tables.written(counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > 1).select("h"), "live-anchors")
    places = texts.select("k1", "k2", "_text").mapInArrow(_contexts(window), "k1 long, k2 long, h long, g long, place long")
    # rows of one text are equal in all that follows: they count, but travel once
    places = tables.written(places.join(_small(live, 5 * BROADCAST_ROWS), "h", "left_semi")
                            .groupBy("k1", "k2", "h", "g", "place").agg(F.count(F.lit(1)).alias("c")), "places")
    cells = tables.written(places.groupBy("h", "g").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), *[F.first(c).alias(c) for c in ("k1", "k2", "place")]), "cells")
    # cells of one anchor string: several, of which one at least is not settled by its count
    several = tables.written(cells.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("n") == 1).alias("open"))
                             .where((F.col("m") > 1) & F.col("open")).select("h"), "shared-anchors")
    mixed = tables.written(cells.join(_small(several, 5 * BROADCAST_ROWS), "h", "left_semi"), "mixed-cells")
    marks = cells.where(F.col("n") > 1).select("h", "g", F.lit(None).cast("long").alias("low"),
                                               F.lit(None).cast("long").alias("high"))
    if mixed.limit(1).count():
        marks = marks.union(_marks(tables, mixed, texts, window))
    marks = tables.written(marks.groupBy("h", "g").agg(F.collect_list(F.struct(
        F.col("low"), F.col("high"))).alias("at_offsets")), "marks")
    spans = _placed(tables, places, cells, marks, window)
    return tables.written(spans.groupBy("k1", "k2").agg(F.collect_list(F.shiftleft("a", 32) + F.col("b")).alias("spans"))
                          .mapInArrow(_merged, "k1 long, k2 long, cuts array<bigint>"), "cuts")


def _placed(tables: Tables, places: DataFrame, cells: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(k1, k2, a, b): removed bytes at every place of the marked cells.  A context at very many places is broadcast."""
    total = cells.agg(F.sum("d")).first()[0] or 0
    if marks.count() <= BROADCAST_ROWS:
        joined = places.join(F.broadcast(marks), ["h", "g"])
    else:
        heavy = F.broadcast(tables.written(cells.where(F.col("d") * HEAVY >= total).select("h", "g"), "heavy-cells"))
        joined = (places.join(F.broadcast(marks.join(heavy, ["h", "g"], "left_semi")), ["h", "g"])
                  .unionByName(places.join(heavy, ["h", "g"], "left_anti")
                               .join(marks.join(heavy, ["h", "g"], "left_anti"), ["h", "g"])))
    lo = F.shiftright("place", 24)
    at, hi = lo + F.shiftright("place", 12).bitwiseAND(4095), lo + F.col("place").bitwiseAND(4095)
    one = joined.select("k1", "k2", lo.alias("lo"), at.alias("at"), hi.alias("hi"), F.explode("at_offsets").alias("o"))
    # a mark without offsets is the whole context
    return one.select("k1", "k2", F.coalesce(F.col("at") - F.col("o.high"), F.col("lo")).alias("a"),
                      (F.coalesce(F.col("at") - F.col("o.low"), F.col("hi")) + window).alias("b"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, _id, _text): both halves of the text's MD5, id and text, null texts empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    md5 = F.md5(text.cast("binary"))
    k1, k2 = (F.conv(F.substring(md5, at, 16), 16, -10).cast("long") for at in (1, 17))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, cuts per row.

    Texts are UTF-8 bytes.  Each byte covered by a ``window`` bytes long string
    that also starts anywhere else, in this text or another, is removed;
    strings overlap, and are judged on the input.  ``cuts`` lists the removed
    runs as [from, to, from, to, ...].  kept_sha256 is the digest of the rest.

    A null text is empty; texts shorter than ``window`` lose nothing.  Rows
    with the same text, repeated rows included, are places of their own, so
    such texts of ``window`` bytes or more go as a whole.  Ids are only
    carried, null and shared ones too.  An empty table gives no rows.
    ``window`` is 2 to 4096 bytes.
    """
    if not 2 <= window <= 4096:
        raise ValueError(f"window of {window} bytes")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = keyed(docs, id_col, text_col)
    with Tables(spark) as tables, batch_rows(spark, 256):
        cuts = _small(repeated_spans(tables, texts, window), BROADCAST_ROWS)
        rows = texts.join(cuts, ["k1", "k2"], "left").select("_id", "_text", "cuts")
        out = rows.mapInArrow(_kept, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                     "cuts array<bigint>")
        return tables.written(out.withColumnRenamed("_id", id_col), "without-repeats", keep=True)
