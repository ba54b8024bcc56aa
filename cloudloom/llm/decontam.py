"""Benchmark decontamination by winnowing.

Of every ``window`` words the least k-gram hash is a fingerprint, so two texts that share ``window`` words in a row share
a fingerprint from inside them.  Fingerprints of the documents are joined with those of the benchmark, and each hit is extended: the
windows around it are compared with the benchmark's windows word by word.

The benchmark is split into blocks whose text has about ``block_bytes``; items longer than PIECE_BYTES are cut into pieces that overlap by a window.  A block is
sent to every task and joined there, so the documents are never shuffled.  One block, the usual case, is a single pass over the
documents.  With more, each block is a pass over the rows, which are written with a number first, and only the hits are grouped.

A block is flat arrays: its text once, the places of its words, and for each window its hash, first word and item; some six bytes for each byte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import _words
from cloudloom.llm._graph import shared
from cloudloom.llm._rows import packed, tidied
from cloudloom.llm._rows import texts as column

#: Words of a window, words of a fingerprinted gram.
WINDOW, GRAM = 13, 5
#: Text of the benchmark in one block, and of a piece of a longer item, about.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 1 << 20

_RESULT = "n_words long, starts array<int>, sizes array<int>, items array<string>"


def fingerprints(h: np.ndarray, room: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints of all windows of ``window`` words, and the hash of the gram at every place."""
    k = min(GRAM, window)
    g = _words.grams(h, k)
    return np.unique(_words.sliding_min(g, window - k + 1)[room >= window]), g


class Benchmark:
    """The windows of some items as sorted arrays, one set of them for each window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids = sorted({item for item, _ in items if item is not None})
        number = {item: i for i, item in enumerate(self.ids)}
        #: window length -> fingerprints; windows' hashes in order, their first words and items (-1: of no id)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        texts = [(text or "").encode() for _, text in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        raw, starts, ends, n_words, n_bytes = [], [], [], 0, 0
        for g in _words.groups(texts):
            words = _words.split(texts[g], _words.ALNUM, lower=True)
            raw.append(words.raw)
            starts.append((words.starts + n_bytes).astype(np.uint32))
            ends.append((words.ends + n_bytes).astype(np.uint32))
            if not len(words.starts):
                n_bytes += len(words.raw)
                continue
            h, room = words.hashes(), words.room()
            own = np.repeat(np.array([number.get(item, -1) for item, _ in items[g]], np.int32), words.counts())
            size = np.minimum(np.repeat(words.counts(), words.counts()), window)
            for m in np.unique(size).tolist():
                at = np.flatnonzero((size == m) & (room >= m))
                spots, grams = fingerprints(h, np.where(size == m, room, 0), m)
                parts.setdefault(m, []).append((grams[spots], _words.grams(h, m)[at], (at + n_words).astype(np.uint32), own[at]))
            n_words += len(words.starts)
            n_bytes += len(words.raw)
        self.raw, self.starts, self.ends = b"".join(raw), np.concatenate([np.zeros(0, np.uint32), *starts]), np.concatenate([np.zeros(0, np.uint32), *ends])
        for m in list(parts):
            fps, hashes, first, own = (np.concatenate(x) for x in zip(*parts.pop(m)))
            order = np.argsort(hashes, kind="stable")
            self.by_size[m] = np.unique(fps), hashes[order], first[order], own[order]

    @property
    def n_bytes(self) -> int:
        """Bytes of all arrays."""
        return len(self.raw) + self.starts.nbytes + self.ends.nbytes + sum(x.nbytes for arrays in self.by_size.values() for x in arrays)

    def _same(self, words: _words.WordBatch, i: int, first: np.ndarray, m: int) -> np.ndarray:
        """Which of the windows that begin at ``first`` are word for word the m words from i on."""
        want = words.span(i, i + m)
        own = lambda a: b" ".join([self.raw[x:y] for x, y in zip(self.starts[a : a + m].tolist(), self.ends[a : a + m].tolist())])
        return np.array([own(a) == want for a in first.tolist()], bool)

    def hits(self, words: _words.WordBatch) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Start word and length of each occurrence of a window in a batch, and its items."""
        starts, sizes, items = [], [], []
        if not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), items
        h, room = words.hashes(), words.room()
        for m, (known, hashes, first, own) in sorted(self.by_size.items()):
            at, g = fingerprints(h, room, m)
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            seeds = at[known[place] == g[at]]
            reach = m - min(GRAM, m)
            near = np.unique((seeds[:, None] - np.arange(reach + 1)).ravel())
            near = near[near >= 0]
            near = near[room[near] >= m]
            wanted = _words.grams(h, m)[near]
            low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
            for i, a, b in zip(near[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                same = self._same(words, i, first[a:b], m)
                if same.any():
                    starts.append(i)
                    sizes.append(m)
                    items.append({self.ids[x] for x in np.unique(own[a:b][same]).tolist() if x >= 0})
        return np.array(starts, np.int64), np.array(sizes, np.int64), items


def _pieces(window: int, most: int):
    """Items (item, text) whose longer texts are cut into pieces of about ``most`` bytes; a piece begins with the last ``window`` - 1 words of the one before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str]] = []
            for item, text in zip(batch.column(0).to_pylist(), _words.to_bytes(batch.column(1))):
                if len(text) <= most:
                    out.append((item, text.decode()))
                    continue
                words = _words.split([text], _words.ALNUM, lower=True)
                begin, n = 0, len(words.starts)
                while begin < n:
                    end = int(np.searchsorted(words.starts, words.starts[begin] + most))
                    end = n if n - end < window else max(end, begin + window)
                    out.append((item, words.span(begin, end).decode()))
                    if end == n:
                        break
                    begin = end - window + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["item", "text"])

    return cut


def _blocks(benchmark: DataFrame, block_bytes: int, window: int, piece_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, in blocks of about ``block_bytes`` of text; only one block is held at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    room = F.coalesce(F.octet_length("text"), F.lit(0))
    size, most = items.agg(F.sum(room + 40), F.max(room)).first()
    if (most or 0) > piece_bytes:
        items = shared(items.mapInArrow(tidied(_pieces(window, piece_bytes)), "item string, text string"))
    n = -(-2 * size // block_bytes) if (size or 0) > block_bytes else 1
    for i in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"]) for r in block.collect()]


def _finish(n_words: int, starts, sizes, items) -> tuple[int, int, str]:
    """n_hit, n_items and the digest of the items."""
    covered = np.zeros(n_words + 1, np.int64)
    np.add.at(covered, np.asarray(starts, np.int64), 1)
    np.add.at(covered, np.asarray(starts, np.int64) + np.asarray(sizes, np.int64), -1)
    ids = sorted(set(items))
    return int((np.cumsum(covered[:-1]) > 0).sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _scan(rows: DataFrame, bench: Benchmark, schema: T.StructType, shape) -> DataFrame:
    """Over ``packed`` rows: ``shape`` makes the columns besides row from (n_words, starts, sizes, items) of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(bench)
    names = schema.names[1:]
    kinds = [pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType) else pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in schema.fields[1:]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            out = []
            texts = _words.to_bytes(column(batch))
            for g in _words.groups(texts):
                words = _words.split(texts[g], _words.ALNUM, lower=True)
                starts, sizes, items = bench.hits(words)
                doc = np.searchsorted(words.first, starts, "right") - 1
                hits: dict[int, list[int]] = {}
                for i, d in enumerate(doc.tolist()):
                    hits.setdefault(d, []).append(i)
                for d, n in enumerate(words.counts().tolist()):
                    own = hits.get(d, [])
                    out.append(shape(n, (starts[own] - words.first[d]).tolist(), sizes[own].tolist(), set().union(*(items[i] for i in own))))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *names])

    return rows.mapInArrow(tidied(scan), schema)


def _decided(n: int, starts, sizes, items) -> tuple:
    n_hit, n_items, digest = _finish(n, starts, sizes, items)
    return n, n_hit, n_items, digest, sorted(items), n_hit > 0 and 20 * n_hit >= n


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Each row of ``docs`` (text) as the struct ``row`` of its columns ``keep`` (all by default), with what it shares with ``benchmark`` (item_id, text).

    Added: n_words, n_hit (words inside an occurrence of a benchmark window), n_items, items_sha256 (of the sorted, comma-joined ids),
    items (the sorted ids), contaminated (a twentieth of the words or more are hit).
    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  A window is ``window`` words of an
    item in a row, or the whole of a shorter item.

    Null and empty texts have no words, so nothing of them is hit.  An item with a null id hits words but is not listed.  Items that
    repeat count once.  Rows that repeat are rows of their own.  An empty benchmark hits nothing; an empty table gives an empty table.
    """
    rows = packed(docs, keep)
    final = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, contaminated boolean").fields])
    blocks = _blocks(benchmark, block_bytes, window, piece_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(rows, Benchmark(first, window), final, _decided)
    text = F.col("t") if "t" in rows.columns else F.col("row.text")
    rows = shared(rows.select(F.struct("row", F.monotonically_increasing_id().alias("rid")).alias("row"), text.alias("t")))  # one number a row in all passes
    base = None
    part = T.StructType([rows.schema["row"], *T._parse_datatype_string(_RESULT).fields])
    raw = lambda n, starts, sizes, items: (n, starts, sizes, sorted(items))
    hits = None
    for block in (x for known in ([first, second], blocks) for x in known):
        slim = rows.select(F.struct(F.col("row.rid").alias("rid")).alias("row"), "t")
        found = _scan(slim, Benchmark(block, window), T.StructType([slim.schema["row"], *part.fields[1:]]), raw)
        if base is None:
            found = shared(found)
            base = found.select(F.col("row.rid").alias("rid"), "n_words")
        found = found.where(F.size("starts") > 0).select(F.col("row.rid").alias("rid"), "starts", "sizes", "items")
        hits = found if hits is None else hits.unionByName(found)
    # A document's own hits; each is bounded by its words.
    joined = hits.groupBy("rid").agg(*[F.flatten(F.collect_list(F.struct("starts", "sizes", "items"))[c]).alias(c) for c in ("starts", "sizes", "items")])
    merged = rows.select(F.col("row.row").alias("row"), F.col("row.rid").alias("rid")).join(base, "rid").join(joined, "rid", "left")
    covered = F.array_distinct(F.flatten(F.zip_with("starts", "sizes", lambda s, n: F.sequence(s, s + n - 1))))
    n_hit = F.coalesce(F.size(covered), F.lit(0)).cast("long")
    n_hit = F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(n_hit)
    items = F.coalesce(F.array_sort(F.array_distinct("items")), F.expr("cast(array() as array<string>)"))
    out = merged.select("row", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), items.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
