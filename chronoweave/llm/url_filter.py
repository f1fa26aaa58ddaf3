"""URL rules in a memory-mapped sorted digest array (operator 4).

The rule list is laid out as one binary file: xxhash64 keys in rising order,
verdicts, and the rule strings.  Spark ships the file to every executor, where
workers map it instead of loading it.  Each url asks for every host suffix and
every rule path length in one vectorised binary search; a key that is found
counts only if the stored string is the asked one.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import bound_batches, shared_path

VERDICTS = ("block", "allow")
MAX_RULES = 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_mapped: dict[str, "DigestArray"] = {}


class DigestArray:
    """Sorted xxhash64 keys with their strings, read through a memory map."""

    def __init__(self, path: str):
        m = np.memmap(path, np.uint8, "r")
        n, sizes = (int(x) for x in m[:16].view(np.uint64))
        self.n, at = n, 16
        self.sizes = m[at:at + 8 * sizes].view(np.uint64)
        at += 8 * sizes
        self.keys = m[at:at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = m[at:at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.verdicts = m[at:at + n]
        self.strings = m[at + n:]

    def text(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]):int(self.ends[i + 1])].tobytes()

    def find(self, asked: list[bytes]) -> np.ndarray:
        """Index of each asked string, -1 where it is not stored."""
        out = np.full(len(asked), -1, np.int64)
        if not asked or not self.n:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        low = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(low, self.n - 1)] == keys).tolist():
            j = int(low[i])
            while j < self.n and self.keys[j] == keys[i]:  # strings that share a key lie side by side
                if self.text(j) == asked[i]:
                    out[i] = j
                    break
                j += 1
        return out


def layout(rules: list[tuple[str, str]]) -> bytes:
    """The file's bytes for (verdict, "host/path") rules; the last of equal rules holds."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; build several filters of at most {MAX_RULES}")
    last = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        last[host.translate(str.maketrans(UPPER, LOWER)) + slash + path] = VERDICTS.index(verdict)
    order = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in last.items())
    sizes = sorted({len(r) - len(r.partition(b"/")[0]) for _, r, _ in order})
    ends = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in order])]).astype(np.uint64)
    return b"".join([struct.pack("<QQ", len(order), len(sizes)), np.array(sizes, np.uint64).tobytes(),
                     np.array([k for k, _, _ in order], np.uint64).tobytes(), ends.tobytes(),
                     bytes(v for _, _, v in order), *(r for _, r, _ in order)])


def ship(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Write the array into the shared folder and add it to the session's files; returns its file name."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = f"{shared_path(spark, 'url-rules')}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(layout(rules)))
    out.close()
    spark.sparkContext.addFile(path)
    return name


def mapped(name: str) -> DigestArray:
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = DigestArray(SparkFiles.get(name))
    return _mapped[name]


def best_rules(array: DigestArray, hosts: list[str], paths: list[str]) -> list[int]:
    """For each (host, path) the index of the longest rule that fits, or -1; of equally long ones, the longer host."""
    sizes, asked, owner = [int(s) for s in array.sizes], [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        h, p, at = host.encode(), path.encode(), 0
        while at >= 0 and h:
            for s in sizes:
                if s <= len(p):
                    asked.append(h[at:] + p[:s])
                    owner.append((i, len(h) - at))
            at = h.find(b".", at) + 1 or -1
    best = [(-1, -1, -1)] * len(hosts)
    hit = array.find(asked)
    for k in np.flatnonzero(hit >= 0).tolist():
        i, size = owner[k]
        best[i] = max(best[i], (len(asked[k]), size, int(hit[k])))
    return [b[2] for b in best]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for every row.

    A rule "host/path" fits that host and its subdomains when the url's path
    starts with the rule's; the longest fitting rule decides, and without one
    the verdict is ``default``: the array does not hold the url.  A null url,
    or one without ``://``, has an empty host and path and fits no rule.
    Repeated rows and null ids are judged like any other.  The list is bounded
    by ``MAX_RULES`` and mapped, so workers hold only the pages they touch.
    """
    bound_batches(pages.sparkSession, 4096)
    name = ship(pages.sparkSession, rules)
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER).alias("host"),
                        F.regexp_extract(url, URL_PARTS, 2).alias("path"))
    kind = rows.schema["_id"].dataType.simpleString()

    def probe(batches):
        for b in batches:
            array = mapped(name)
            found = best_rules(array, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([array.text(k).decode() if k >= 0 else None for k in found], pa.string()),
                 pa.array([VERDICTS[array.verdicts[k]] if k >= 0 else default for k in found], pa.string())],
                ["_id", "host", "path", "rule", "verdict"])

    return (rows.mapInArrow(probe, f"_id {kind}, host string, path string, rule string, verdict string")
            .select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict"))
