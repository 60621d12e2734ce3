"""Operator 7, near-duplicate documents by MinHash.

Exact copies (equal word sequences) fold into one node, numbered by its
smallest doc_id.  A node's signature is the minimum of each of ``HASHES``
universal hashes over its word shingles.  ``ROWS`` minima make a band; nodes
with an equal band are candidates (at the threshold a pair shares no band with
a probability of about 1e-5).

Large buckets are never paired off.

1. Every member of a bucket is paired with the bucket's smallest node only.
   Pairs are checked by their signatures, then on their full shingle sets, and
   components are formed from the links.
2. Where members of a bucket are still in different components, those outside
   its largest component are compared with the others.  The comparison is the
   join condition itself: the parity sketch of two sets (bit ``h mod 1024``
   flipped by every element) differs in at most as many bits as the sets differ
   in elements, so it never rejects a link and nearly always rejects the rest.
   What passes is checked on the full sets, and components are formed again.

After that every pair of nodes with an equal band is in one component or has
been checked.  Full sets are built only for nodes of checked pairs, from a
second read of the texts.  Minima and counts are aggregated before shuffles;
all intermediate tables are written to the shared folder.

Edge cases: a null text or one without words has no shingle and links with
nothing; fewer words than a shingle count as one shingle; a row with a null
doc_id is in no component and is kept; rows with one doc_id are one node;
an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import saved, small_arrow, small_batches, word_table
from cadenza.llm.components import components

SHINGLE = 5
HASHES, ROWS = 144, 6
BANDS = HASHES // ROWS
PERCENT = 85  # links: 100 * intersection >= PERCENT * union
PARITY = 1024
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DRAWS = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _P)
_A = (_DRAWS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_DRAWS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of the texts (with repeats), each text's first, and word
    hashes with each text's first."""
    number, distinct, at = word_table(pc.ascii_lower(texts))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    words = table[number]
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    # start of each shingle among the words
    start = np.repeat(at[:-1] - first[:-1], count) + np.arange(first[-1])
    h = np.zeros(len(start), np.uint64)
    end = np.repeat(at[1:], count)
    for k in range(size):
        inside = start + k < end
        h = np.where(inside, h * _P + words[np.minimum(start + k, max(len(words) - 1, 0))], h * _P) if len(words) else h
    return _mix(h), first, words, at


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of each hash over each text's shingles; texts with none get the
    largest value."""
    out = np.full((len(first) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        x = (h >> np.uint64(32)).astype(np.uint32)
        starts = first[some]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def parity(values: np.ndarray) -> np.ndarray:
    """PARITY bits as longs: bit ``v mod PARITY`` flipped by every value."""
    odd = (np.bincount((values & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, sig binary, par array<long>, bands array<long>"


def sign(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Content key, set size, signature, parity sketch and bands of every row."""
    band_tag = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches):
        for batch in small_batches(batches, 1, max_bytes=400_000):
            h, first, words, at = shingles(batch.column(1), size)
            sig = signatures(h, first)
            rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
            band = np.broadcast_to(band_tag, (len(sig), BANDS)).copy()
            for k in range(ROWS):
                band = _mix(band * _P + rows[:, :, k])
            keys, sizes, odd = [], [], []
            for i in range(len(sig)):
                keys.append(xxhash.xxh3_128_digest(words[at[i]:at[i + 1]].tobytes()))
                own = np.unique(h[first[i]:first[i + 1]])
                sizes.append(len(own))
                odd.append(parity(own))
            key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            small = (sig & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sizes, pa.int64()),
                 pa.array([s.tobytes() for s in small], pa.binary()),
                 pa.array([o.tolist() for o in odd], pa.list_(pa.int64())),
                 pa.array([b.tolist() for b in band.view(np.int64)], pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n_shingles", "sig", "par", "bands"])

    return _rows(docs).mapInArrow(run, SIGNED)


def _rows(docs: DataFrame) -> DataFrame:
    return small_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _could_link(a: str, b: str, percent: int):
    """The set sizes allow the threshold."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _by_signature(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes, signatures and parity sketches allow a link.  A
    signature agrees in at least the threshold's share of places, less five
    standard deviations."""
    p = percent / 100
    least_same = HASHES * (p - 5 * (p * (1 - p) / HASHES) ** 0.5)
    left = nodes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    right = nodes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    joined = pairs.join(left, "u").join(right, "v").where(_could_link("nu", "nv", percent)).select("u", "v", "su", "sv")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            ok = pa.array((a == b).sum(axis=1) >= least_same)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return joined.mapInArrow(run, "u long, v long")


def _by_sets(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs that link on their full shingle sets, with the similarity."""
    wanted = saved(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id")))
                   .distinct(), "wanted")

    def run(batches):
        for batch in small_batches(batches, 1):
            h, first, _, _ = shingles(batch.column(1), size)
            sets = [np.unique(h[first[i]:first[i + 1]]).tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "own"])

    sets = _rows(docs).join(wanted, "doc_id", "left_semi").mapInArrow(run, "id long, own binary").distinct()
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("own").alias("a")), "u") \
                .join(sets.select(F.col("id").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")

    def check(batches):
        for batch in batches:
            keep = {"u": [], "v": [], "jaccard": []}
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                if union and 100 * common >= percent * union:
                    keep["u"].append(u)
                    keep["v"].append(v)
                    keep["jaccard"].append(common / union)
            yield pa.RecordBatch.from_arrays([pa.array(keep["u"], pa.int64()), pa.array(keep["v"], pa.int64()),
                                              pa.array(keep["jaccard"], pa.float64())], names=["u", "v", "jaccard"])

    return both.mapInArrow(check, "u long, v long, jaccard double").distinct()


def _across(members: DataFrame, nodes: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that sizes and parity
    sketches allow.  One side is outside the bucket's largest component."""
    placed = members.join(linked, "id", "left").select("h", "id", F.coalesce("component", "id").alias("c"))
    sizes = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("h").agg(F.max(F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("n_c")) \
                 .where("n_c > 1").select("h", F.col("top.c").alias("main"))
    rows = saved(placed.join(mixed, "h").join(nodes.select("id", "n", "par"), "id")
                 .select("h", "id", "c", (F.col("c") == F.col("main")).alias("in_main"), "n",
                         *(F.col("par")[k].alias(f"p{k}") for k in range(PARITY // 64))), "mixed-buckets")
    a, b = rows.where("NOT in_main").alias("a"), rows.alias("b")
    differ = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(1, PARITY // 64)),
                 F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))))
    # 100 (na + nb - d) >= percent (na + nb + d) for a symmetric difference of d
    near = differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)
    on = (F.col("a.h") == F.col("b.h")) & (F.col("a.c") != F.col("b.c")) \
        & (F.col("b.in_main") | (F.col("a.id") < F.col("b.id"))) & _could_link("a.n", "b.n", percent) & near
    return a.join(b, on).select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = saved(sign(docs, size), "signed")
    can = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(can.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "classes")
    nodes = saved(can.join(classes, ["k1", "k2"]).where("doc_id = id").dropDuplicates(["k1", "k2"])
                  .select("id", F.col("n_shingles").alias("n"), "sig", "par", "bands"), "nodes")
    banded = nodes.select("id", F.explode("bands").alias("h")).distinct()
    hubs = banded.groupBy("h").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "hub")
    members = saved(banded.join(hubs, "h"), "bucket-members")
    pairs = members.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    links = saved(_by_sets(saved(_by_signature(pairs, nodes, percent), "pairs"), docs, percent, size), "links")
    linked = components(links)
    more = saved(_across(members.select("h", "id"), nodes, linked, percent), "more-pairs")
    if not more.isEmpty():
        more_links = saved(_by_sets(more, docs, percent, size), "more-links")
        if not more_links.isEmpty():
            # the components so far stand for their links
            linked = components(linked.select(F.col("id").alias("u"), F.col("component").alias("v"))
                                .unionByName(more_links.select("u", "v")))
    found = signed.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2"], "left") \
                  .join(linked, "id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")) \
                 .otherwise(F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")))
    return found.select("doc_id", "n_shingles", component.alias("component_id")) \
                .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
