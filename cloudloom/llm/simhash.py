"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bit places gets a vector of radius + 1 bits.  For every non-zero vector v a mask keeps the places
whose vector has an odd inner product with v.  The vectors of at most ``radius`` differing places span too little to meet
every v, so some mask keeps none of them: two fingerprints within the radius agree under at least one of the
2 ** (radius + 1) - 1 masks, whatever the data.  Each mask is a hash table; fingerprints that agree under it are compared.

Equal fingerprints are one row before any table is built, so exact copies cost nothing.  A bucket above ``bucket``
fingerprints is split again: pairs within the radius also agree on one of radius + 1 parts of the bits that are still free, so the
bucket goes to the radius + 1 tables keyed by mask and part, and so on until all buckets are small: a bucket that agrees on all but b bits has 2 ** b
fingerprints at most, so this ends.  A bucket gives a spanning forest of its links, never its pairs.

``near_duplicates`` links fingerprints.  ``near_texts`` links texts whose sets of shingles have a similarity (Jaccard) of 0.8 or more.  Such texts differ in some
ten bits of a fingerprint, which would take 2 ** 15 tables to cover, so there texts meet by a prefix of their shingles, which loses no such pair either, and are compared by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import _words
from cloudloom.llm._graph import components, hot_join, shared
from cloudloom.llm._rows import packed, texts, tidied

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that are compared with each other directly.
BUCKET = 2048


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's words as a signed integer: a bit is 1 if it is set in over half the shingle hashes."""
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(begins[:n].tolist(), ends[len(words) - n :].tolist())
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for _ in range(0, n, 65536):  # of a long text, one slice of hashes at a time
        hashes = np.array([digest(line[a:b], SEED) for a, b in islice(spans, 65536)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (text) as the struct ``row`` of its columns ``keep`` (all by default), and fp, its fingerprint as a long."""
    rows = packed(docs, keep)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(_split(t.translate(_words.LOWER))) for t in _words.to_bytes(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["row", "fp"])

    return rows.mapInArrow(tidied(hashed), T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())]))


def _split(text: bytes) -> list[bytes]:
    """Runs of anything but space and \\t..\\r: what bytes.split() takes for white space is just that."""
    return text.split()


@cache
def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks (not to be changed): place i has vector 1 + i mod (2 ** (radius + 1) - 1), so that all vectors are used evenly."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def parts(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """radius + 1 masks: ``mask`` and one part each of the places that it drops."""
    dropped = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in dropped[p :: radius + 1]) for p in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each member of a component with its least one."""
    left = np.sort(fps)
    a, b = [left[:0]], [left[:0]]
    while len(left) > 1:
        root, left = left[0], left[1:]
        stack = [root]
        while stack and len(left):
            near = np.bitwise_count((left ^ stack.pop()).view(np.uint64)) <= radius
            if near.any():
                found, left = left[near], left[~near]
                a.append(found)
                b.append(np.full(len(found), root))
                stack.extend(found)
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a, b = [], []
        for fps in batch["fps"]:
            x, y = links(np.asarray(fps, np.int64))
            a.append(x)
            b.append(y)
        yield pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}).astype("int64")


def near_links(fps: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fps`` (fp) that connect all pairs within the radius.

    fps has no nulls and no repeated rows.  An empty table gives no links.
    """
    tables = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks(radius)])
    keyed, ladder, found = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.*"), masks(radius), None
    while True:
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        met = shared(keyed.join(sizes, ["mask", "key"]))
        small = met.where(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))  # of bucket fingerprints at most
        own = small.select("fps").mapInPandas(_bucket_links, "a long, b long")
        found = own if found is None else found.unionByName(own)
        large = met.where(F.col("n") > bucket)
        if large.isEmpty():
            return found.distinct()
        # The masks of the next level: four times as many a level, of those with a large bucket only.
        used = {r["mask"] for r in large.select("mask").distinct().collect()}
        finer = [(m, p) for m in ladder if _signed(m) in used for p in dict.fromkeys(parts(m, radius)) if p != m]
        ladder = list(dict.fromkeys(p for _, p in finer))
        next_ = fps.sparkSession.createDataFrame([(_signed(m), _signed(p)) for m, p in finer], "mask long, finer long")
        keyed = large.join(F.broadcast(next_), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")).distinct()


def _place():
    return F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "rid")


def _classes(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key_, least): of each node (key, first) the least ``first`` of its component."""
    found = components(links)
    grouped = found.join(nodes, found["node"] == nodes[key]).select(key, "component", "first")
    least = grouped.groupBy("component").agg(F.min("first").alias("least"))
    linked = grouped.join(least, "component").select(F.col(key).alias("linked_"), "least")
    return nodes.join(linked, F.col(key) == F.col("linked_"), "left").select(F.col(key).alias("key_"), F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, *, keep: list[str] | None = None, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as the struct ``row`` of its columns ``keep``, with fp, component_id and leader.

    keep must name doc_id; by default it is all columns.
    component_id is the smallest doc_id of the rows reachable over links of fingerprints that differ in ``radius`` bits or fewer,
    the row's own included; one row of each component is its leader, with that doc_id.  A fingerprint is of the 3-word shingles of the text with A-Z lower-cased, repeats included; of the
    whole text if it has fewer words.

    A text without words, null too, has fingerprint 0 and is linked like any other.  Null ids count last: a component of
    null ids alone is null.  Rows that repeat are linked with each other.  An empty table gives an empty table.
    """
    rows = shared(with_fingerprints(docs, keep).withColumn("rid", F.monotonically_increasing_id()))
    # One row per different fingerprint, with partial minima before the shuffle: groups of copies shrink where they are read.
    distinct = shared(rows.groupBy("fp").agg(F.min(_place()).alias("first")))
    ids = shared(_classes(distinct, near_links(distinct.select("fp"), radius=radius, bucket=bucket), "fp"))
    both = hot_join(rows, ids.withColumnRenamed("key_", "fp"), ["fp"])
    return both.select("row", "fp", F.col("least.doc_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("leader"))


#: Words of a shingle and similarity of near texts.
WORDS, SIMILARITY = 5, 0.8
#: Texts that the order of shingles is learned from, about, and shingles that it names at most; results do not depend on them.
ORDERED, NAMED = 8192, 1 << 17
#: Shingles put in order at once, and texts of a bucket that a text is compared with at once.
AT_ONCE, COMPARED = 1 << 18, 1 << 14


def _bit_sums(h: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, BITS): how often each bit is set in each text's hashes.  Eight counters of a byte are summed in one number, over 255 hashes at most."""
    runs = -(-sizes // 255)
    text = np.repeat(np.arange(len(begin)), runs)
    run = begin[text] + 255 * (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs))
    out = np.zeros((len(begin), 8, 8), np.int64)
    for bit in range(8):
        counters = np.add.reduceat(h >> np.uint64(bit) & np.uint64(0x0101010101010101), run).view(np.uint8).reshape(-1, 8)
        out[:, :, bit] = np.add.reduceat(counters, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    return out.reshape(-1, BITS)


def _marks(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks of some sorted sets, end to end, and their widths: the parity of the shingles that fall on each bit, of which there are 1.5 a shingle at least.

    Two sets differ in at least as many shingles as their marks in bits; a mark of twice the width is made one of the width by joining neighbours.
    """
    widths = np.full(len(sizes), 16)
    while (small := 64 * widths < 1.5 * sizes).any():
        widths[small] *= 2
    out = np.zeros(widths.sum(), np.uint64)
    if len(shingles):
        shift = np.repeat(32 - np.log2(widths).astype(np.uint32), sizes).astype(np.uint32)
        at = np.repeat(np.cumsum(widths) - widths, sizes) + (shingles >> shift)
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[begin]] = np.bitwise_xor.reduceat(np.uint64(1) << (shingles & np.uint32(63)).astype(np.uint64), begin)
    return out, widths


class _Marks:
    """Marks of a column of lists."""

    def __init__(self, lists: pa.ListArray):
        self.flat, self.width = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.width) - self.width

    def _folded(self, i: np.ndarray, width: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.flat[self.begin[i][:, None] + np.arange(width)].reshape(len(i), to, width // to), axis=2)

    def differ(self, i: np.ndarray, other: _Marks, j: np.ndarray) -> np.ndarray:
        """In how many bits the i-th marks differ from the j-th of others."""
        out, own, its = np.zeros(len(i), np.int64), self.width[i], other.width[j]
        for kind in np.unique(own << 32 | its):
            alike = np.flatnonzero((own << 32 | its) == kind)
            a, b = int(kind) >> 32, int(kind) & (1 << 32) - 1
            step = max(1, (1 << 18) // max(a, b))
            for begin in range(0, len(alike), step):
                at = alike[begin : begin + step]
                out[at] = np.bitwise_count(self._folded(i[at], a, min(a, b)) ^ other._folded(j[at], b, min(a, b))).sum(1)
        return out


def _can_be(differ: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles, of which so many differ at least, can be as similar."""
    return np.maximum(differ, np.abs(n - m)) * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6


def _likely(similarity: float):
    """Over rows (lead, rid, m, first, n, mark), sizes and marks of both: the pairs that can be as similar, with the share that differs at least."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, at = batch.column(2).to_numpy(), batch.column(4).to_numpy(), np.arange(batch.num_rows)
            differ = _Marks(batch.column(3)).differ(at, _Marks(batch.column(5)), at)
            kept = _can_be(differ, n, m, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), batch.column(1).filter(pa.array(kept)), pa.array((differ / (n + m))[kept])], ["lead", "rid", "differ"])

    return tidied(likely)


#: A text without words has one shingle, which no other has.
_NOTHING = np.array([0], np.uint64)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))


def _shingled(words: int):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, marks, digests, shingles = _words.to_bytes(texts(batch)), [], [], []
            for g in _words.groups(each):
                own = _words.split(each[g], _words.NOT_SPACE, lower=True)
                h = own.hashes()
                grams = _words.grams(h, words) if len(h) else h
                sets = []
                for a, b in zip(own.first[:-1].tolist(), own.first[1:].tolist()):
                    short = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes())], np.uint64) if b > a else _NOTHING
                    sets.append(grams[a : b - words + 1] if b - a >= words else short)
                digests += [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                distinct = np.sort(np.repeat(np.arange(len(sets), dtype=np.uint64), [len(x) for x in sets]) << np.uint64(32) | np.concatenate(sets) >> np.uint64(32))
                distinct = distinct[np.concatenate(([True], distinct[1:] != distinct[:-1]))]
                sizes = np.diff(np.searchsorted(distinct, np.arange(1, len(sets) + 1, dtype=np.uint64) << np.uint64(32)), prepend=0)
                distinct = distinct.astype(np.uint32)
                marks.append(_marks(distinct, sizes))
                shingles.append((distinct.view(np.int32), sizes))
            if not each:
                continue
            mark = _lists(np.concatenate([x for x, _ in marks]).view(np.int64), np.concatenate([n for _, n in marks]))
            lists = _lists(np.concatenate([x for x, _ in shingles]), np.concatenate([n for _, n in shingles]))
            yield pa.RecordBatch.from_arrays([batch.column(0), mark, pa.array(digests, pa.binary()), lists], ["row", "mark", "digest", "shingles"])

    return shingled


def _prefixed(order, similarity: float):
    """Over rows (rid, shingles): each text's keys, the first of its shingles in the order.

    Of n shingles, a text of that similarity shares n * similarity at least, so two such texts share one of their first n - ceil(n * similarity) + 1, whatever the order is.
    """

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = order.value
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + AT_ONCE, "right")))
                n, flat = sizes[begin:end], batch.column(1).slice(begin, end - begin).flatten().to_numpy().view(np.uint32)
                text = np.repeat(np.arange(end - begin), n)
                often = np.zeros(len(flat), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                    often = np.where(names[at] == flat, counts[at], 0)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                kept = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                keys = flat[np.lexsort((often, text))[place < np.repeat(kept, n)]]  # a stable sort: equally frequent ones stay in the order of their hashes
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), _lists(keys.view(np.int32), kept)], ["rid", "keys"])
                begin = end

    return prefixed


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut where it changes, so that equal ones are together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[0].column(0)[0].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, rid) sorted by both: the rows of each key with several texts, with the first of these and a name of their set."""
    for table in _whole(batches):
        key, rid = (table.column(i).to_numpy() for i in (0, 1))
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(begin, len(key)))
        name = _words.mix(np.add.reduceat(_words.mix(rid.view(np.uint64) + np.uint64(1)), begin) + sizes.astype(np.uint64))
        several = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, sizes)[several]) for x in (name.view(np.int64), rid[begin])] + [pa.array(rid[several])], ["bucket", "lead", "rid"])


def _crossing(i: int, class_: np.ndarray, n: np.ndarray, marks: _Marks, first: int, similarity: float) -> Iterator[np.ndarray]:
    """Of texts in the order of their sizes n, those after the i-th and of another class that can be as similar by their sizes and marks (from the ``first`` on); none that is is left out."""
    end = int(np.searchsorted(n, n[i] / similarity * (1 + 1e-9), "right"))
    for begin in range(i + 1, end, COMPARED):
        j = np.arange(begin, min(begin + COMPARED, end))
        j = j[class_[j] != class_[i]]
        if len(j):
            yield j[_can_be(marks.differ(np.full(len(j), first + i), marks, first + j), n[i], n[j], similarity)]


def _in_buckets(similarity: float, sets: bool):
    """Over rows (bucket, class, rid, n, mark) sorted by bucket and n: the texts that can be similar to one of another class in their bucket.

    With their sets (shingles), the links instead, without those between texts that links of the bucket connect already.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            bucket, class_, rid, n = (table.column(k).to_numpy() for k in range(4))
            marks = _Marks(table.column(4).combine_chunks())
            shingles = table.column(5).combine_chunks() if sets else None
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                own, at = class_[a:b].copy(), slice(a, b)
                if (own == own[0]).all():
                    continue
                met = np.zeros(b - a, bool)
                for i in range(b - a):
                    for near in _crossing(i, own, n[at], marks, a, similarity):
                        if not sets:
                            met[near] = True
                            met[i] |= len(near) > 0
                            continue
                        for j in near.tolist():
                            if own[j] != own[i]:
                                common = len(np.intersect1d(shingles[a + i].values.to_numpy(), shingles[a + j].values.to_numpy(), assume_unique=True))
                                if common >= similarity * (n[a + i] + n[a + j] - common):
                                    own[own == own[j]] = own[i]
                                    out.append((rid[a + i], rid[a + j]))
                out += [(bucket[a], rid[a + i]) for i in np.flatnonzero(met)]
            first, second = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["lead", "rid"] if sets else ["bucket", "rid"])

    return tidied(found)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (lead, rid) of texts that are as similar; only sets of texts in a pair are shuffled on."""
    wanted = pairs.select("rid").unionByName(pairs.select(F.col("lead").alias("rid"))).distinct()
    own = shared(sets.join(wanted, "rid", "left_semi"))
    one = hot_join(pairs, own.select(F.col("rid").alias("lead"), F.col("shingles").alias("y")), ["lead"], hot=64)
    both = one.join(own.withColumnRenamed("shingles", "x"), "rid")
    common = F.size(F.array_intersect("x", "y"))
    return shared(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("lead", "rid"))


def _order(distinct: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts in some of the texts; the rest come before them."""
    share = ORDERED / max(1, distinct.count())
    some = distinct.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < share * (1 << 30)).select("rid")
    counts = nodes.join(F.broadcast(some), "rid", "left_semi").select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    table = counts.where("n > 1").orderBy(F.desc("n"), "s").limit(NAMED).toArrow()
    names, n = table.column(0).to_numpy().astype(np.int32).view(np.uint32), table.column(1).to_numpy().astype(np.int64)
    at = np.argsort(names)
    return names[at], n[at]


def _similar(distinct: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all texts of ``distinct`` (rid) that are as similar; their marks and shingles are in ``nodes``."""
    marks, sets = nodes.select("rid", F.size("shingles").cast("long").alias("n"), "mark"), nodes.select("rid", "shingles")
    order = nodes.sparkSession.sparkContext.broadcast(_order(distinct, nodes))
    keys = sets.mapInArrow(tidied(_prefixed(order, similarity)), "rid long, keys array<int>").join(distinct.select("rid"), "rid", "left_semi")
    rows = keys.select(F.explode("keys").alias("key"), "rid").repartition("key").sortWithinPartitions("key", "rid")
    # Of buckets with the same texts, one.
    met = shared(rows.mapInArrow(tidied(_buckets), "bucket long, lead long, rid long").where(F.col("rid") != F.col("lead")).distinct())
    # All against their bucket's first: a group of near copies is done with here, over all tasks.
    pairs = shared(met.select("lead", "rid").distinct())
    firsts = marks.select(F.col("rid").alias("lead"), F.col("n").alias("m"), F.col("mark").alias("first"))
    both = hot_join(pairs, firsts, ["lead"]).join(marks, "rid").select("lead", "rid", "m", "first", "n", "mark")
    likely = shared(both.mapInArrow(_likely(similarity), "lead long, rid long, differ double"))
    linked = _verified(shared(likely.groupBy("rid").agg(F.min(F.struct("differ", "lead")).alias("best")).select("best.lead", "rid")), sets, similarity)
    labels = components(linked.select(F.col("lead").alias("a"), F.col("rid").alias("b")))
    # Of the other pairs with a first, those that are not connected by now.
    of = lambda rid, name: labels.select(F.col("node").alias(rid), F.col("component").alias(name))
    apart = likely.join(of("lead", "one"), "lead", "left").join(of("rid", "other"), "rid", "left").where(F.coalesce("one", "lead") != F.coalesce("other", "rid")).select("lead", "rid")
    apart = _verified(shared(apart.join(linked, ["lead", "rid"], "left_anti")), sets, similarity)
    # The rest of each bucket among itself, where its texts are not all connected.
    own = shared(met.join(labels, F.col("rid") == F.col("node"), "left").select("bucket", F.coalesce("component", "rid").alias("class"), "rid"))
    several = own.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where(F.col("low") < F.col("high"))
    open_ = own.join(several, "bucket", "left_semi")
    dealt = lambda rows, *more: rows.join(marks, "rid").select("bucket", "class", "rid", "n", "mark", *more).repartition("bucket").sortWithinPartitions("bucket", "n", "rid")
    near = shared(dealt(open_).mapInArrow(_in_buckets(similarity, False), "bucket long, rid long"))
    more = dealt(own.join(near, ["bucket", "rid"], "left_semi").join(sets, "rid"), "shingles").mapInArrow(_in_buckets(similarity, True), "lead long, rid long")
    return linked.unionByName(apart).unionByName(shared(more)).select(F.col("lead").alias("a"), F.col("rid").alias("b"))


def near_texts(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as the struct ``row``, with component_id and leader.

    Two texts are linked if their sets of ``words``-word shingles (A-Z lower-cased; of a shorter text, the whole) have a Jaccard similarity of ``similarity`` or more, by 32
    bits of each shingle's hash.  component_id is the smallest doc_id of the rows reachable; one row of each component is its leader, with that doc_id.  Texts with equal
    sequences of shingles are one node.  No link is lost: similar texts share one of their first shingles in an order with the frequent ones last, and so a bucket.  In
    each bucket all nodes are compared with its first; then those that are not in one component yet are compared with each other, by their sizes and marks, which no similar pair
    fails, and by their sets where they are.  Rows are as many as a bucket has nodes, never its pairs.  The texts are read for the shingles and for the result, where they are shuffled once.

    Texts without words, null too, are linked with each other.  Null ids count last.  Rows that repeat are linked, and one of them leads.  An empty table gives an
    empty table.
    """
    text = F.col("text")
    name = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    source = docs.select(name.alias("row"), text.alias("t"))
    schema = T.StructType([source.schema["row"], *T._parse_datatype_string("mark array<long>, digest binary, shingles array<int>").fields])
    nodes = shared(source.mapInArrow(tidied(_shingled(words)), schema).select("row.*", "mark", "digest", "shingles").withColumn("rid", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2", "rid")
    distinct = shared(nodes.groupBy("digest").agg(F.min(place).alias("first")).withColumn("rid", F.col("first.rid")))
    ids = _classes(distinct.select("rid", "first"), _similar(distinct.select("rid"), nodes, similarity), "rid")
    # A row for each name; copies of a text with other ids meet their node by the digest, of which there is one row in ``distinct``.
    node_of = hot_join(nodes.select("doc_id", "t1", "t2", "digest"), distinct.select("digest", F.col("rid").alias("node")), ["digest"])
    least = hot_join(node_of, ids.withColumnRenamed("key_", "node"), ["node"])
    least = shared(least.groupBy("doc_id", "t1", "t2").agg(F.first("least").alias("least"), F.count(F.lit(1)).alias("times")))
    least = least.select(F.col("doc_id").alias("doc_id_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), "least", "times")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", name["t1"].alias("t1"), name["t2"].alias("t2"))
    met = rows.join(least, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t1") == F.col("least.t1")) & (F.col("t2") == F.col("least.t2"))
    id_ = F.col("least.doc_id").alias("component_id")
    alone = met.where(F.col("times") == 1).select("row", id_, first.alias("leader"))
    if least.where(F.col("times") > 1).isEmpty():
        return alone
    number = F.row_number().over(Window.partitionBy("doc_id", "t1", "t2").orderBy("t1"))
    return alone.unionByName(met.where(F.col("times") > 1).select("row", id_, (first & (number == 1)).alias("leader")))
