"""SimHash near-duplicate detection with pigeonhole blocks.

A 64-bit fingerprint is cut into blocks; if two fingerprints differ in at most
``distance`` bits, all blocks but ``distance`` are equal, so they share one of
the keys made of the remaining blocks.  Equal fingerprints are collapsed first;
distinct ones meet in buckets by key, and each bucket verifies Hamming
distances and passes on a spanning forest of its links, never all pairs.

Few, wide blocks give few keys but a group of near copies can fill a bucket.
Members of a bucket beyond ``BUCKET`` are keyed again by 16 blocks of 4 bits:
with ``distance`` blocks left out a bucket there can hold ``2 ** (4 *
distance)`` distinct fingerprints at most (256 for distance 2), which bounds
every task by construction and loses no pair.

``keep_one`` is asked for documents of similarity 0.8 or more over 5-word
shingles.  At that similarity fingerprints of 64 bits differ in 4 to 14 bits
(measured on the test tables), which no number of blocks both finds and keeps
apart, so it adds a second kind of block: the same shingle hashes give minima,
bands of which are keys.  Members of a bucket are compared on sketches of
``BINS`` bins, whose estimate has a standard deviation of about 0.01; a bound
lowered by ``MARGIN``, four of these, only chooses candidates.  Documents that
candidates connect form a class, and links are decided within classes on the
distinct 64-bit shingle hashes, so that no document is linked by an estimate.
What can still be missed is a pair that shares no band and that no chain of
candidates connects: at similarity 0.80 a pair shares none of ``BANDS`` bands
with probability (1 - 0.8 ** 4) ** 24, 3 in a million, and at 0.85 or more less
than 1 in 10 million.  Buckets beyond ``CHUNK`` members and classes beyond
``CLASS_BYTES`` of hashes are compared chunk by chunk, each pair of chunks in a
group of its own.

Edge cases: a null text, or one without words, has fingerprint 0 and links like
any other; texts of fewer words than a shingle are one shingle; a null id is
the smallest id; rows that repeat are in one component, and ``keep_one`` keeps
one row of them; an empty table gives no rows.  Other columns are not read by
``components`` and are carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import small
from lodestone.llm.components import connected_components
from lodestone.llm.store import fresh, stored

SEED = 42
#: Distinct fingerprints that one bucket may compare with each other.
BUCKET = 256
#: Blocks of the first keys, and of the keys whose buckets are bounded by construction (distance 2: 2 ** 8 = BUCKET).
COARSE, FINE = 4, 16
#: Bins of a sketch; bands of minima and minima in a band: two texts of similarity 0.8 share a band with probability 0.999997.
BINS, BANDS, ROWS = 1024, 24, 4
#: What an estimate may be off by: four standard deviations and more.
MARGIN = 0.05
#: Sketches that one task compares with each other, half as many of each of two chunks.
CHUNK = 8192
#: Shingle hashes that one group compares with each other, half as many of each of two chunks.
CLASS_BYTES = 16 << 20
#: Bits for each document of the filter that keeps other texts out of the exact comparison, and bits at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 26


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; one of the whole sequence if it is shorter, none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    digest, width = xxhash.xxh64_intdigest, min(shingle, len(words))
    return np.array([digest(joined[a + 1 : b], SEED) for a, b in zip(ends, ends[width:], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 without any."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # counts of up to 255 rows fit into bytes, which is the fast sum
    parts = [part.sum(0, dtype=np.uint8) for part in np.array_split(bits, -(-len(bits) // 255))]
    counts = np.add.reduce(parts, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    return majority(shingle_hashes(text, shingle))


_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of minima."""
    if not len(hashes):
        return [0] * BANDS
    mixed = hashes ^ (hashes >> np.uint64(31))
    low = np.array([(mixed * f).min() for f in _FACTORS], np.uint64).reshape(BANDS, ROWS)
    keys = ((low >> np.uint64(16)) * _MIX).sum(1, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def bins(hashes: np.ndarray) -> bytes:
    """A byte for each bin of hash space: 0 if no shingle falls into it, else a byte of its smallest hash."""
    out = np.zeros(BINS, np.uint8)
    ordered = np.sort(hashes)
    where, first = np.unique(ordered >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[where] = 1 + (ordered[first] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, sketched: bool = False) -> DataFrame:
    """``doc_id, tag, fp``: the fingerprint as a signed long; ``tag`` tells rows of one id apart.  With ``sketched`` also ``bands, sketch`` and ``whole, size``: a hash of the distinct shingle hashes and their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps, bands, sketches, wholes, sizes = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                hashes = shingle_hashes(t, shingle)
                fps.append(majority(hashes))
                if sketched:
                    hashes = np.unique(hashes)
                    bands.append(band_keys(hashes))
                    sketches.append(bins(hashes))
                    wholes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    sizes.append(len(hashes))
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if sketched:
                columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.array(wholes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "fp", "bands", "sketch", "whole", "size"][: len(columns)])

    tag = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, fp long" + ", bands array<long>, sketch binary, whole long, size long" * sketched)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks that leave out each choice of ``distance`` blocks."""
    width = 64 // blocks
    cut = [((1 << width) - 1) << (width * i) for i in range(blocks)]
    masks = [((1 << 64) - 1) ^ sum(out) for out in combinations(cut, distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(n: int, near) -> list[tuple[int, int]]:
    """Spanning forest of n members: (member, a linked one reached before it); ``near(i, open)`` says which of the open ones link to i."""
    edges = []
    open_ = np.arange(n)
    while len(open_):
        stack, open_ = [int(open_[0])], open_[1:]
        while stack and len(open_):
            i = stack.pop()
            hit = near(i, open_)
            found = open_[hit].tolist()
            open_ = open_[~hit]
            edges += [(j, i) for j in found]
            stack += found
    return edges


def close_bits(fps: np.ndarray, distance: int):
    values = fps.view(np.uint64)
    return lambda i, open_: np.bitwise_count(values[open_] ^ values[i]) <= distance


def close_sketches(sketches: np.ndarray, similarity: float):
    """Shared bins over bins filled in either, for rows of a matrix of sketches."""
    filled = sketches > 0

    def near(i: int, open_: np.ndarray) -> np.ndarray:
        same = ((sketches[open_] == sketches[i]) & filled[i]).sum(1)
        return same >= similarity * (filled[open_] | filled[i]).sum(1)

    return near


def close_sets(hashes: np.ndarray, sizes: np.ndarray, similarity: float):
    """Shared hashes over hashes in either, for sets of distinct hashes that stand one after another."""
    _, ids = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(ids), bool)

    def near(i: int, open_: np.ndarray) -> np.ndarray:
        own = ids[starts[i] : ends[i]]
        mark[own] = True
        if len(open_) < 16:
            same = np.array([np.count_nonzero(mark[ids[starts[j] : ends[j]]]) for j in open_.tolist()], np.int64)
        else:
            upto = np.concatenate(([0], np.cumsum(mark[ids], dtype=np.int64)))
            same = upto[ends[open_]] - upto[starts[open_]]
        mark[own] = False
        return same + 1e-9 >= similarity * (sizes[open_] + sizes[i] - same)

    return near


def _keyed(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    masks = block_masks(blocks, distance)
    keys = F.array(*(F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    return fps.select("fp", F.explode(keys).alias("at")).select("fp", "at.no", "at.key")


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _bucket_links(members: DataFrame, distance: int) -> DataFrame:
    """Links of buckets of at most ``BUCKET`` members."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for members in batch.column(0):
                fps = np.array(members.values.to_numpy(zero_copy_only=False), np.int64)
                edges += [(int(fps[j]), int(fps[i])) for j, i in forest(len(fps), close_bits(fps, distance))]
            yield _edges(edges)

    buckets = members.groupBy("no", "key").agg(F.collect_list("fp").alias("fps"))
    return buckets.select("fps").mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: links that connect exactly what all links of at most ``distance`` bits connect, among distinct ``fp``."""
    if 2 ** ((64 // FINE) * distance) > BUCKET:
        raise ValueError("fine buckets are bounded for distances up to 2")
    keyed = _keyed(distinct, COARSE, distance)
    sizes = keyed.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(keyed.join(sizes, ["no", "key"]), "fingerprint-buckets")
    found = _bucket_links(met.filter(F.col("n") <= BUCKET), distance)
    crowded = met.filter(F.col("n") > BUCKET).select("fp").distinct()
    fine = _keyed(crowded, FINE, distance)
    fine_sizes = fine.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.unionByName(_bucket_links(fine.join(fine_sizes, ["no", "key"]), distance))


def _chunk_pairs(rid: str, chunks: str) -> Column:
    """The pairs of chunks, of ``chunks``, that a member belongs to: every two chunks meet in one."""
    own = F.pmod(rid, chunks).cast("int")
    return F.transform(F.sequence(F.lit(0), F.col(chunks) - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))


def candidate_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links of ``rid`` that connect what all links of an estimate of ``similarity - MARGIN`` or more in a bucket connect (``rid, bands, sketch``)."""
    keyed = distinct.select("rid", F.posexplode("bands").alias("no", "key"))
    sizes = keyed.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rid")).alias("sign")).filter("n > 1")
    # many bands give the same bucket, which is compared once
    once = sizes.groupBy("n", "sign").agg(F.min(F.struct("no", "key")).alias("at")).select("at.no", "at.key", "n")
    met = keyed.join(once, ["no", "key"]).withColumn("chunks", F.ceil(F.col("n") / (CHUNK // 2)).cast("int"))
    placed = met.withColumn("pair", F.explode(_chunk_pairs("rid", "chunks"))).join(distinct.select("rid", "sketch"), "rid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for members in batch.column(0):
                rids = np.array(members.values.field("rid"))
                sketches = np.frombuffer(b"".join(members.values.field("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
                edges += [(int(rids[j]), int(rids[i])) for j, i in forest(len(rids), close_sketches(sketches, similarity - MARGIN))]
            yield _edges(edges)

    groups = placed.groupBy("no", "key", "pair").agg(F.collect_list(F.struct("rid", "sketch")).alias("members"))
    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def _hashed(docs: DataFrame, members: DataFrame, text: str, shingle: int) -> DataFrame:
    """``pick, hashes``: distinct shingle hashes of the texts of ``docs(pick, text)`` that are in ``members(pick)``, and of a few others.

    Rows of one pick have equal texts: a task hashes and passes on the first of
    them, and of those that several tasks pass on one is kept.
    """
    bits = min(FILTER_MOST, max(1 << 10, FILTER_BITS * members.count()))
    place = members.select(F.pmod("pick", F.lit(bits)).cast("int").alias("p"))
    words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, p % 64))").alias("b")).toArrow()
    held = np.zeros(-(-bits // 64), np.uint64)
    held[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = shared.value, set()
        for batch in small(batches):
            picks = batch.column(0).to_numpy()
            at = picks % bits
            wanted = np.flatnonzero(held[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            wanted = [i for i, p in zip(wanted.tolist(), picks[wanted].tolist(), strict=True) if not (p in seen or seen.add(p))]
            batch = batch.take(pa.array(wanted, pa.int64()))
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["pick", "hashes"])

    return docs.select("pick", text).mapInArrow(run, "pick long, hashes binary").groupBy("pick").agg(F.first("hashes").alias("hashes"))


def similar_links(docs: DataFrame, distinct: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: links that connect what all links of ``similarity`` or more among candidates connect (``docs(pick, text)``, ``distinct(rid, pick, size, bands, sketch)``)."""
    classes = connected_components(candidate_links(distinct, similarity)).withColumnRenamed("node", "rid")
    members = stored(classes.join(distinct.select("rid", "pick", "size"), "rid"), "candidates")
    total = members.groupBy("component").agg(F.sum("size").alias("total"))
    chunks = F.ceil(F.col("total") * 8 / (CLASS_BYTES // 2)).cast("int")
    placed = members.join(total, "component").select("pick", "rid", "component", F.when(F.col("total") * 8 <= CLASS_BYTES, 1).otherwise(chunks).alias("chunks"))
    sets = placed.join(_hashed(docs, members, text, shingle), "pick").withColumn("pair", F.explode(_chunk_pairs("rid", "chunks")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for members in batch.column(0):
                rids = np.array(members.values.field("rid"))
                parts = [np.frombuffer(h, np.uint64) for h in members.values.field("hashes").to_pylist()]
                near = close_sets(np.concatenate(parts), np.array([len(p) for p in parts]), similarity)
                edges += [(int(rids[j]), int(rids[i])) for j, i in forest(len(rids), near)]
            yield _edges(edges)

    groups = sets.groupBy("component", "pair").agg(F.collect_list(F.struct("rid", "hashes")).alias("members"))
    return groups.select("members").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, tag, fp, component_id, component_tag``: the smallest id reachable over links of ``distance`` bits, and its tag."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    first = F.min(F.struct("doc_id", "tag"))
    distinct = prints.groupBy("fp").agg(first.alias("first"))
    roots = connected_components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    classed = stored(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "classes")
    lowest = classed.groupBy("component").agg(F.min("first").alias("lowest"))
    named = classed.join(lowest, "component").select("fp", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.tag").alias("component_tag"))
    return prints.join(named, "fp").select("doc_id", "tag", "fp", "component_id", "component_tag")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 2, similarity: float = 0.8) -> DataFrame:
    """``doc_id, tag, component_id, component_tag`` over links of ``distance`` bits or of ``similarity``."""
    prints = stored(fingerprints(docs, doc_id, text, shingle, sketched=True), "sketches")
    named = prints.withColumn("rid", F.xxhash64("fp", "whole"))
    grouped = named.groupBy("rid").agg(
        F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands"), F.min("size").alias("size"), F.min(F.struct("doc_id", "tag")).alias("first")
    )
    distinct = stored(grouped.withColumn("pick", F.xxhash64("first.doc_id", "first.tag")), "texts")
    picked = docs.select(F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("pick"), F.col(text).alias("text"))
    by_print = distinct.groupBy("fp").agg(F.min("rid").alias("head"))
    same = distinct.join(by_print, "fp").select(F.col("rid").alias("a"), F.col("head").alias("b")).filter("a <> b")
    close = links(by_print.select("fp"), distance)
    left, right = (by_print.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in ("a", "b"))
    close = close.join(left, "a").join(right, "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    roots = connected_components(similar_links(picked, distinct, "text", shingle, similarity).unionByName(same).unionByName(close)).withColumnRenamed("node", "rid")
    classed = stored(distinct.join(roots, "rid", "left").select("rid", "first", F.coalesce("component", "rid").alias("component")), "classes")
    lowest = classed.groupBy("component").agg(F.min("first").alias("lowest"))
    ends = classed.join(lowest, "component").select("rid", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.tag").alias("component_tag"))
    return named.select("doc_id", "tag", "rid").join(ends, "rid").select("doc_id", "tag", "component_id", "component_tag")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 2, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component of near copies, that with the smallest id."""
    known, own, tag = fresh(docs, "kept_known", "kept_id", "kept_tag")
    found = similar_components(docs, doc_id, text, shingle, distance, similarity)
    # neither key is null, so that the join and the choice of one among repeated rows share a shuffle
    kept = found.select(F.col("component_id").isNotNull().alias(known), F.coalesce("component_id", F.lit(0)).alias(own), F.col("component_tag").alias(tag)).distinct()
    tagged = docs.withColumns({
        known: F.col(doc_id).isNotNull(),
        own: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
        tag: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })
    keys = [known, own, tag]
    return tagged.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
