"""URL filters: a sorted digest array, memory-mapped by every task.

The rules' keys (host + path) are hashed to 64 bits with xxHash; Spark deals them by digest into shards of about
SHARD_BYTES and sorts each shard in a task into one array: digests, offsets, and the full strings with their
verdicts. The driver passes the shards on as files, one at a time; Spark ships them to every executor, and tasks map
them into memory, so that neither driver nor tasks hold more than a shard. All candidate keys of a batch are probed
with one vectorised binary search in the shards that their digests fall in, and every digest that is found is confirmed
on the stored full string, so that a collision never decides.

The candidates of a URL are the ends of its host of as many labels, joined to the beginnings of its path of the length,
that some rule has: pairs that Spark collects from the rules, so that the number of candidates does not depend on how
long a URL is. The longest confirmed rule wins.

The array lies on every executor's disk, which is checked: a list of more than MAX_INDEX_BYTES is an error.

Defined results: a null URL or one without "://" has empty host and path and gets the default verdict; rules with null
host, path or verdict are ignored; hosts of rules are read without regard to the case of A-Z; of equal rules the last
verdict in alphabetical order counts ("block" before "allow"); of rules of one length that fit, the last in alphabetical
order wins (they can differ in where the host ends); an empty rule list gives every URL the default. Duplicate rows stay;
other columns, whatever their names, are never read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a shard of the array, about, and the most of all.
SHARD_BYTES = 64 << 20
MAX_INDEX_BYTES = 64 << 30

#: Rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then the text up to '?' or '#'."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


#: Spark's own seed, so that its xxhash64() gives the same digests.
SEED = 42


def digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


class DigestArray:
    """Sorted 64-bit digests with the full strings and their verdicts behind them, over one memory-mapped file:
    the number n, n digests, n + 1 offsets, n lengths of keys, and the strings, each key followed by its verdict."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.int64)[0])
        self.digest = data[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = data[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.sizes = data[16 + 16 * n : 16 + 24 * n].view(np.int64)
        self.text = data[16 + 24 * n :]

    @staticmethod
    def pack(keys: list[bytes], verdicts: list[bytes]) -> bytes:
        d = digests(keys)
        order = np.argsort(d, kind="stable").tolist()
        both = [keys[i] + verdicts[i] for i in order]
        sizes = np.array([len(keys[i]) for i in order], np.int64)
        return b"".join([np.array([len(keys)], np.int64).tobytes(), d[order].tobytes(), np.cumsum([0, *map(len, both)]).astype(np.int64).tobytes(), sizes.tobytes(), *both])

    @classmethod
    def open(cls, file: str) -> DigestArray:
        return cls(np.memmap(file, np.uint8, "r"))

    def key(self, i: int) -> bytes:
        return self.text[self.offsets[i] : self.offsets[i] + self.sizes[i]].tobytes()

    def verdict(self, i: int) -> str:
        return self.text[self.offsets[i] + self.sizes[i] : self.offsets[i + 1]].tobytes().decode()

    def find(self, keys: list[bytes], d: np.ndarray | None = None) -> np.ndarray:
        """Place of each key in the array, or -1; confirmed on the full strings."""
        n = len(self.digest)
        out = np.full(len(keys), -1, np.int64)
        if not n or not keys:
            return out
        d = digests(keys) if d is None else d
        at = np.searchsorted(self.digest, d)
        for i in np.flatnonzero((at < n) & (self.digest[np.minimum(at, n - 1)] == d)):
            j = int(at[i])
            while j < n and self.digest[j] == d[i]:  # several keys may share a digest
                if self.key(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def candidates(host: str, path: str, shapes: list[tuple[int, int]]) -> Iterator[str]:
    """Ends of the host of so many labels, each with the beginning of the path of such a length, as some rule has them."""
    labels = host.rsplit(".", max((n for n, _ in shapes), default=0))
    ends = {n: ".".join(labels[-n:]) for n in {n for n, _ in shapes} if n <= len(labels)}
    whole = len(labels) if "." not in labels[0] else -1
    for n, size in shapes:
        if n in ends and size <= len(path) and (n < len(labels) or n == whole):
            yield ends[n] + path[:size]


def _packed(part: pa.Table) -> pa.Table:
    """One shard's rules as bytes."""
    data = DigestArray.pack([x.encode() for x in part["rule"].to_pylist()], [x.encode() for x in part["verdict"].to_pylist()])
    return pa.table({"shard": part["shard"].slice(0, 1), "data": pa.array([data], pa.binary())})


class RuleIndex:
    """The files of the array's shards, in digest order, and the shapes (labels of the host, length of the path) of rules."""

    def __init__(self, files: list[str], shapes: list[tuple[int, int]]):
        self.files, self.shapes = files, shapes

    @classmethod
    def of(cls, rules: DataFrame, shard_bytes: int = SHARD_BYTES) -> RuleIndex:
        spark = rules.sparkSession
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        rules = rules.toDF("host", "path", "verdict").dropna().withColumn("host", F.translate("host", upper, lower))
        one = rules.groupBy(F.concat("host", "path").alias("rule")).agg(F.max("verdict").alias("verdict"))
        size = one.agg(F.sum(F.octet_length("rule") + F.octet_length("verdict") + 24)).first()[0] or 0
        if size > MAX_INDEX_BYTES:
            raise ValueError(f"rules of {size} bytes: more than the {MAX_INDEX_BYTES} that every executor may hold")
        bits = max(0, (-(-size // shard_bytes) - 1).bit_length())
        shard = F.shiftrightunsigned(F.xxhash64("rule"), 64 - bits).cast("int") if bits else F.lit(0)
        packed = one.withColumn("shard", shard).groupBy("shard").applyInArrow(_packed, "shard int, data binary")
        folder, files = tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), [""] * (1 << bits)  # goes when the session ends
        for shard, data in packed.toLocalIterator():  # one shard at a time
            files[shard] = f"urls-{uuid.uuid4().hex}"
            with open(path := f"{folder}/{files[shard]}", "wb") as f:
                f.write(data)
            spark.sparkContext.addFile(path)
        shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("size")).distinct()
        return cls(files, sorted((r.labels, r.size) for r in shapes.toLocalIterator()))  # one row for each shape

    def judge(self, hosts: pa.Array, paths: pa.Array) -> pa.Array:
        """rule, verdict (null where none fits)."""
        shards = [DigestArray.open(SparkFiles.get(f)) if f else None for f in self.files]
        shift = np.uint64(64 - (len(shards) - 1).bit_length())
        rule: list[str | None] = [None] * len(hosts)
        verdict: list[str | None] = [None] * len(hosts)
        for lo in range(0, len(hosts), 2048):
            owner, cand = [], []
            for i, (h, p) in enumerate(zip(hosts.slice(lo, 2048).to_pylist(), paths.slice(lo, 2048).to_pylist(), strict=True), lo):
                for c in candidates(h, p, self.shapes):
                    owner.append(i)
                    cand.append(c)
            keys = [c.encode() for c in cand]
            d = digests(keys)
            of = (d >> shift).astype(np.int64) if len(shards) > 1 else np.zeros(len(d), np.int64)
            for k, shard in enumerate(shards):
                own = np.flatnonzero(of == k)
                found = shard.find([keys[j] for j in own], d[own]) if shard is not None else np.full(len(own), -1)
                for j, place in zip(own[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                    i = owner[j]
                    if rule[i] is None or (len(cand[j]), cand[j]) > (len(rule[i]), rule[i]):
                        rule[i], verdict[i] = cand[j], shard.verdict(place)
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, host, path, rule, verdict of every row. rules: a list or a DataFrame of (host, path, verdict)."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    index = RuleIndex.of(rules, shard_bytes)

    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return index.judge(hosts, paths)

    judge.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    host, path = host_and_path(pages[url_col].cast("string"))
    urls = pages.select(pages[id_col].alias(id_col), host.alias("host"), path.alias("path"))
    said = F.arrow_udf(judge, "rule string, verdict string").asNondeterministic()("host", "path")  # evaluated once
    return urls.select(id_col, "host", "path", said.alias("said")).select(id_col, "host", "path", "said.rule", F.coalesce("said.verdict", F.lit(default)).alias("verdict"))


def url_verdicts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The contract's rows for the four rules of the registered query."""
    return filter_urls(pages, RULES)
