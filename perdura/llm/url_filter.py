"""URL filters: rules and a block list held in a sorted, memory-mapped digest array.

Method: every rule (host and path beginning) and every blocked host is one entry. The
entries' 64-bit xxhash keys are sorted into an array; a file of keys, offsets and full
strings is shipped once to each machine and memory-mapped by its Python workers, which
therefore share it. A url probes the array with every suffix of its host at a label
boundary, joined to its path cut to each length a rule has; keys are found by
vectorised binary search, and the stored string is compared, so that a collision of
digests never decides.

The longest rule that fits decides. Without one, a url whose host or a parent domain
is on the block list is blocked, any other allowed.

Rows: a null url, or one without "://", has an empty host and path and is allowed.
Repeated entries count once. The list is a parameter of the caller, so its size is known.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
BLOCKED_HOSTS = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)
ALLOW, BLOCK, LISTED = 0, 1, 2


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def pack(entries: Mapping[str, int]) -> bytes:
    """The file: number of entries, sorted digests, offsets, kinds, strings; all 8-byte values but the last."""
    keyed = sorted((xxhash.xxh64_intdigest(e), e.encode()) for e in entries)
    texts = [e for _, e in keyed]
    out = io.BytesIO()
    out.write(np.array([len(keyed)], np.uint64).tobytes())
    out.write(np.array([k for k, _ in keyed], np.uint64).tobytes())
    out.write(np.cumsum([0, *map(len, texts)], dtype=np.uint64).astype(np.uint64).tobytes())
    out.write(np.array([entries[t.decode()] for t in texts], np.uint64).tobytes())
    out.write(b"".join(texts))
    return out.getvalue()


class DigestArray:
    """A packed file, mapped and probed."""

    def __init__(self, path: str):
        words = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(words[:8].view(np.uint64)[0])
        at = 8 + 8 * n
        self.digests = words[8:at].view(np.uint64)
        self.offsets = words[at : at + 8 * (n + 1)].view(np.uint64)
        self.kinds = words[at + 8 * (n + 1) : at + 8 * (2 * n + 1)].view(np.uint64)
        self.texts = words[at + 8 * (2 * n + 1) :]

    def find(self, probes: Sequence[str]) -> np.ndarray:
        """The kind of each probe's entry, or -1; equal digests are told apart by the full string."""
        wanted = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.digests, wanted)
        kinds = np.full(len(probes), -1, dtype=np.int64)
        held = np.minimum(at, max(0, len(self.digests) - 1))
        likely = np.flatnonzero(self.digests[held] == wanted) if len(self.digests) else []
        for i in likely:
            j, text = at[i], probes[i].encode()
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.texts[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == text:
                    kinds[i] = self.kinds[j]
                j += 1
        return kinds


def ship(spark: SparkSession, rules: Mapping[str, str], blocked: Sequence[str]) -> str:
    """Send the packed list to every machine; the name it has there."""
    entries = {host: LISTED for host in blocked}
    entries |= {rule: BLOCK if verdict == "block" else ALLOW for rule, verdict in rules.items()}
    data = pack(entries)
    name = f"url-digests-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    # one place for each application and content: Spark refuses a second path for a name, and takes the same one again
    folder = os.path.join(os.path.realpath(tempfile.gettempdir()), f"perdura-{spark.sparkContext.applicationId}")
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        with open(path, "wb") as out:
            out.write(data)
    spark.sparkContext.addFile(path)
    return name


def probes_of(host: str, path: str, cuts: Sequence[int]) -> list[str]:
    """The suffixes of a host, alone and with each beginning of the path; longest host first."""
    if not host:
        return []
    labels = host.split(".")
    found = []
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        found.append(suffix)
        found += [suffix + path[:cut] for cut in cuts if len(path) >= cut]
    return found


def judge(
    pages: DataFrame, rules: Mapping[str, str] = RULES, blocked: Sequence[str] = BLOCKED_HOSTS
) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per row of pages."""
    name = ship(pages.sparkSession, rules, blocked)
    cuts = sorted({len(r) - r.index("/") for r in rules})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            each = [probes_of(h, p, cuts) for h, p in zip(hosts, paths)]
            flat = [p for probes in each for p in probes]
            kinds = listed.find(flat)
            found, verdicts, at = [], [], 0
            for probes in each:
                mine = range(at, at + len(probes))
                at += len(probes)
                best = max((i for i in mine if kinds[i] in (ALLOW, BLOCK)), key=lambda i: len(flat[i]), default=None)
                if best is not None:
                    found.append(flat[best])
                    verdicts.append("block" if kinds[best] == BLOCK else "allow")
                else:
                    found.append(None)
                    verdicts.append("block" if any(kinds[i] == LISTED for i in mine) else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    url = F.col("url").cast("string")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string"
    )
