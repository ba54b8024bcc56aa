"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A byte is predicted from the ORDER bytes before it.  A context that has not seen the byte escapes to the next shorter one
(method C: an escape weighs as many counts as the context has different bytes), where the bytes that the longer context
knows are excluded.  Below the empty context, bytes that were never seen are equally likely.  0xFF, which UTF-8 never has,
stands before and after each text.

Pretrained: all contexts are counted over the training texts, and all of them score.  Contexts of up to two bytes are at most
65,537, so their counts go to every task (Low).  Pairs of a three-byte context and a byte that make up at least 1 / GRAMS of all
bytes, GRAMS at most, go to every task as well; the others, however rare, meet their context's counts in a join.  A byte seen in a context
is seen in its shorter contexts too, so what is excluded depends on the context alone.

Adaptive: each document starts with an empty trie, which learns each byte after coding it.

The unigram baseline needs the count of every training token.  Tokens that make up at least 1 / HEAVY of all tokens, HEAVY at most,
are sent to every task; the others are rare by definition and meet their counts in a join, without hot keys.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _words
from cloudloom.llm._graph import shared
from cloudloom.llm._rows import tidied

#: Bytes of context; the counts pack ORDER + 1 bytes into 32 bits.
ORDER = 3
#: Pairs of a context and a byte that make up at least 1 / GRAMS of all bytes are sent to every task.
GRAMS = 1 << 20
#: The second key of contexts in the join with rare tokens, whose two keys are 128 bits of a hash.
CONTEXT = -1
#: Tokens of at least 1 / HEAVY of all tokens are sent to every task.
HEAVY = 1 << 18
#: A counting task passes its counts on when it has this many different tokens.
FLUSH = 400_000
EDGE = b"\xff"


def _grams(texts: list[bytes]) -> np.ndarray:
    """The last ORDER + 1 bytes, as a number, at each byte of each text and at its end."""
    buf = np.frombuffer(b"".join([EDGE * ORDER + t + EDGE for t in texts]), np.uint8).astype(np.uint32)
    packed = buf[ORDER:].copy()
    for j in range(1, ORDER + 1):
        packed |= buf[ORDER - j : len(buf) - j] << np.uint32(8 * j)
    lengths = np.array([len(t) + 1 + ORDER for t in texts])
    heads = (np.cumsum(lengths)[:-1][:, None] + np.arange(ORDER)).ravel() - ORDER  # that end before a text begins
    keep = np.ones(len(packed), bool)
    keep[heads] = False
    return packed[keep]



def _keys(tokens: list[bytes]) -> np.ndarray:
    """128 bits of each token as two signed numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in tokens]), ">i8").astype(np.int64).reshape(-1, 2)


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_words.LOWER).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b, n): of tokens (0; a, b their key), of grams (1; a the packed bytes), of texts (2)."""
    tokens: Counter[bytes] = Counter()
    grams, counts, n_docs = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def out(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

    def flushed() -> pa.RecordBatch:
        keys = _keys(list(tokens))
        return out(0, keys[:, 0], keys[:, 1], np.fromiter(tokens.values(), np.int64, len(tokens)))

    for batch in batches:
        texts = _words.to_bytes(batch.column(0))
        n_docs += len(texts)
        for g in _words.groups(texts, 4 << 20):
            for t in texts[g]:
                tokens.update(_tokens(t))
            if len(tokens) > FLUSH:
                yield flushed()
                tokens.clear()
            new, n = np.unique(_grams(texts[g]), return_counts=True)
            grams, at = np.unique(np.concatenate((grams, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(grams)).astype(np.int64)
            if len(grams) > 8 * FLUSH:
                yield out(1, grams.astype(np.int64), np.zeros(len(grams), np.int64), counts)
                grams, counts = grams[:0], counts[:0]
    if tokens:
        yield flushed()
    if len(grams):
        yield out(1, grams.astype(np.int64), np.zeros(len(grams), np.int64), counts)
    if n_docs:
        yield out(2, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([n_docs]))


def count(texts: DataFrame) -> DataFrame:
    """The counts (kind, a, b, n) of the tokens, byte grams and texts of ``texts`` (text), over all of it."""
    parts = texts.select("text").mapInArrow(tidied(_counted), "kind int, a long, b long, n long")
    return shared(parts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))


class Model:
    """The log10 probability of each byte in each context, as one dense table: the plain form of what score() does, for counts that fit the driver.

    grams: for each order 0..ORDER a pair of arrays, packed bytes (the predicted one last) and counts, nested as the
    module's text says.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        seen = np.unique((grams[0][0] & 255).astype(np.int64))
        self.of = np.full(256, len(seen), np.int32)  # bytes never seen share the last place
        self.of[seen] = np.arange(len(seen))
        a = self.width = len(seen) + 1
        count = np.zeros((1, a))
        count[0, self.of[(grams[0][0] & 255).astype(np.int64)]] = grams[0][1]
        missing = 256 - len(seen)
        below = np.full((1, a), 1.0 / missing if missing else 0.0)
        tables, row = [self._mixed(count, below)], np.zeros((), np.int64)
        for order in range(1, len(grams)):
            packed, n = grams[order]
            contexts, at = np.unique(packed.astype(np.int64) >> 8, return_inverse=True)
            own = np.zeros((len(contexts), a))
            own[at, self.of[(packed & 255).astype(np.int64)]] = n
            digits = [self.of[contexts >> (8 * j) & 255] for j in reversed(range(order))]
            parent = row[tuple(digits[1:])] - sum(len(t) for t in tables[:-1])
            free = np.where(own > 0, 0.0, count[parent])
            nx, ux = free.sum(1, keepdims=True), (free > 0).sum(1, keepdims=True)
            all_ = np.maximum(nx + ux, 1.0)
            below = np.where(ux > 0, np.where(count[parent] > 0, count[parent] / all_, ux / all_ * below[parent]), below[parent])
            count = own
            new = np.broadcast_to(row, (a,) * order).copy()
            new[tuple(digits)] = np.arange(len(contexts)) + sum(len(t) for t in tables)
            tables.append(self._mixed(count, below))
            row = new
        self.row = row.astype(np.int32).ravel()
        with np.errstate(divide="ignore"):
            self.log = np.log10(np.concatenate(tables)).astype(np.float32)

    @staticmethod
    def _mixed(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of each byte in each context: its share, or that of an escape times what is below."""
        n, u = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        all_ = np.maximum(n + u, 1.0)
        return np.where(count > 0, count / all_, np.where(u > 0, u / all_, 1.0) * below)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        s = self.of[np.frombuffer(b"".join([EDGE * ORDER + t + EDGE for t in texts]), np.uint8)]
        context = np.zeros(len(s) - ORDER, np.int32)
        for j in range(ORDER):
            context = context * self.width + s[j : len(s) - ORDER + j]
        log = self.log[self.row[context], s[ORDER:]].astype(np.float64)
        begin = np.cumsum([0] + [len(t) + 1 + ORDER for t in texts])
        heads = (begin[1:-1, None] + np.arange(ORDER)).ravel() - ORDER
        log[heads] = 0.0
        return np.add.reduceat(log, begin[:-1]) if len(texts) else log


def train(counts: DataFrame) -> Model:
    """The model of all grams of ``counts`` in one table on the driver."""
    grams = counts.where(F.col("kind") == 1)
    levels = []
    for order in range(ORDER + 1):
        own = grams.select(F.col("a").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("a"), "n").groupBy("a").agg(F.sum("n").alias("n")).toPandas()
        levels.append((own["a"].to_numpy(np.int64), own["n"].to_numpy(np.float64)))
    return Model(levels)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values where keys (sorted) is wanted, 0 where it is not."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[spot] == wanted, values[spot], 0)


class Low:
    """All contexts of fewer than ORDER bytes, from the counts ``n`` of the packed grams ``a`` of ORDER bytes."""

    def __init__(self, a: np.ndarray, n: np.ndarray):
        self.grams, self.contexts = [], []
        for order in range(ORDER):
            keys, at = np.unique(a & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            self.grams.append((keys, np.bincount(at, n, len(keys))))
        for order, (keys, n_) in enumerate(self.grams):
            own, at = np.unique(keys >> 8, return_inverse=True)
            all_, kinds = np.bincount(at, n_, len(own)), np.bincount(at, minlength=len(own)).astype(np.float64)
            free = kinds_free = np.zeros(len(own))
            if order:  # what the next shorter context knows besides
                up, mask = self.contexts[-1], (1 << 8 * (order - 1)) - 1
                shorter = np.bincount(at, _at(*self.grams[order - 1], keys & (1 << 8 * order) - 1), len(own))
                free, kinds_free = _at(up[0], up[1], own & mask) - shorter, _at(up[0], up[2], own & mask) - kinds
            self.contexts.append((own, all_, kinds, free, kinds_free))
        self.missing = 256 - len(self.grams[0][0])

    def seen(self, gram: np.ndarray, order: int = ORDER - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each gram in its context of ``order`` bytes: its count, that of all bytes, that of different bytes."""
        own, context = gram & (1 << 8 * (order + 1)) - 1, gram >> 8 & (1 << 8 * order) - 1
        keys, all_, kinds = self.contexts[order][:3]
        return _at(*self.grams[order], own), _at(keys, all_, context), _at(keys, kinds, context)

    def below(self, gram: np.ndarray, order: int = ORDER - 1) -> np.ndarray:
        """Probability after an escape from the context of ``order`` bytes."""
        if not order:
            return np.full(len(gram), 1.0 / self.missing if self.missing else 0.0)
        context, keys = gram >> 8 & (1 << 8 * order) - 1, self.contexts[order]
        n, free, kinds = self.seen(gram, order - 1)[0], _at(keys[0], keys[3], context), _at(keys[0], keys[4], context)
        rest, all_ = self.below(gram, order - 1), np.maximum(free + kinds, 1.0)
        return np.where(kinds > 0, np.where(n > 0, n / all_, kinds / all_ * rest), rest)

    def probability(self, gram: np.ndarray, order: int = ORDER - 1) -> np.ndarray:
        """Probability of each gram's last byte after the ``order`` bytes before it."""
        n, all_, kinds = self.seen(gram, order)
        rest = np.where(kinds > 0, kinds / np.maximum(all_ + kinds, 1.0), 1.0) * self.below(gram, order)
        out = np.where(n > 0, n / np.maximum(all_ + kinds, 1.0), rest)
        return np.where(kinds > 0, out, self.probability(gram, order - 1)) if order else out


def lower(counts: DataFrame) -> Low:
    """The shorter contexts of the grams of ``counts``: 2 ** (8 * ORDER) rows at most, whatever the texts are."""
    own = counts.where(F.col("kind") == 1).groupBy(F.col("a").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("a")).agg(F.sum("n").alias("n")).toArrow()
    return Low(own["a"].to_numpy().astype(np.int64), own["n"].to_numpy().astype(np.float64))


def contexts(counts: DataFrame, low) -> DataFrame:
    """A row for each context of ORDER bytes: its count n_all of bytes, kinds of them, what the next shorter context has besides (free, kinds_free), and its bytes' counts.

    low: broadcast Low.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n2, all2, kinds2 = low.value.seen(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (n2, all2, kinds2))], ["a", "n", "n2", "all2", "kinds2"])

    grams = counts.where(F.col("kind") == 1).select("a", "n").mapInArrow(tidied(added), "a long, n long, n2 double, all2 double, kinds2 double")
    bytes_ = F.map_from_entries(F.collect_list(F.struct(F.col("a").bitwiseAND(F.lit(255)).cast("int"), "n")))
    each = grams.groupBy(F.shiftright("a", 8).alias("context")).agg(
        F.sum("n").cast("double").alias("n_all"),
        F.count(F.lit(1)).cast("double").alias("kinds"),
        (F.first("all2") - F.sum("n2")).alias("free"),
        (F.first("kinds2") - F.count(F.lit(1))).alias("kinds_free"),
        bytes_.alias("bytes"),
    )
    return shared(each)


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns each byte after coding it."""
    trie: dict[bytes, Counter[int]] = {}
    data, out = EDGE * order + text + EDGE, 0.0
    for i in range(order, len(data)):
        s, excluded, p = data[i], set(), 1.0
        for k in range(order, -1, -1):
            known = trie.get(data[i - k : i])
            free = {x: n for x, n in known.items() if x not in excluded} if known else {}
            if not free:
                continue
            whole = sum(free.values()) + len(free)
            if s in free:
                p *= free[s] / whole
                break
            p *= len(free) / whole
            excluded |= free.keys()
        else:
            p /= 256 - len(excluded)
        out += math.log10(p)
        for k in range(order + 1):
            trie.setdefault(data[i - k : i], Counter())[s] += 1
    return out


def score_adaptive(docs: DataFrame, *, order: int = ORDER) -> DataFrame:
    """Each row of ``docs`` (text) as the struct ``row``, with its adaptive score; a null text is empty."""
    from pyspark.sql import types as T

    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [adaptive(t, order) for t in _words.to_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    return rows.mapInArrow(tidied(scored), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_sum double, score double, a long, b long, tf long, byte int, n2 double, below double, shorter double"


def _nones(k: int) -> tuple[pa.Array, ...]:
    return tuple(pa.nulls(k, t) for t in (pa.int32(), pa.float64(), pa.float64(), pa.float64()))


def score(docs: DataFrame, held_out: Column, *, grams: int = GRAMS, heavy: int = HEAVY) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): its PPM score, and the unigram baseline of its tokens.

    Learns from the rows where ``held_out`` is false.  Returned: doc_id, held_out, n_tokens (words and the end), n_known (those seen in
    training), train_tokens, base_score, score (log10 probabilities).

    A null text is empty: its end is its only token.  Rows that repeat are rows of their own.  Without training rows every byte has
    probability 1 / 256 and every token 1.  An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    spark = docs.sparkSession
    counts = count(docs.where(~F.col("held_out")).select("text"))
    totals = {r["kind"]: (r["n"], r["rows"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    n_ends = totals.get(2, (0, 0))[0]
    n_all = totals.get(0, (0, 0))[0] + n_ends
    vocabulary = totals.get(0, (0, 0))[1] + (n_ends > 0)
    is_heavy = F.col("n") * heavy >= n_all
    top = counts.where((F.col("kind") == 0) & is_heavy).select("a", "b", "n").toPandas().sort_values(["a", "b"])
    low = spark.sparkContext.broadcast(lower(counts))
    trie = contexts(counts, low)
    n_bytes = trie.agg(F.sum("n_all")).first()[0] or 0
    often = trie.select("context", "n_all", "kinds", F.explode("bytes").alias("byte", "n")).where(F.col("n") * grams >= n_bytes)
    often = often.select((F.shiftleft("context", 8) + F.col("byte")).alias("gram"), F.log10(F.col("n") / (F.col("n_all") + F.col("kinds"))).alias("log")).sort("gram").toArrow()
    shared_ = spark.sparkContext.broadcast((often["gram"].to_numpy().astype(np.uint32), often["log"].to_numpy(), top["a"].to_numpy(np.int64), top["b"].to_numpy(np.int64), np.log10(top["n"].to_numpy(np.float64) + 1)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        often_gram, often_log, top_a, top_b, top_log = shared_.value
        shorter = low.value
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1), _words.to_bytes(batch.column(2))
            for g in _words.groups(texts):
                gram, of = _grams(texts[g]), np.repeat(np.arange(len(texts[g])), [len(t) + 1 for t in texts[g]])
                spot = np.minimum(np.searchsorted(often_gram, gram), max(len(often_gram) - 1, 0))
                frequent = often_gram[spot] == gram if len(often_gram) else np.zeros(len(gram), bool)
                log = np.where(frequent, often_log[spot], 0.0) if len(often_gram) else np.zeros(len(gram))
                scores = np.bincount(of, log, len(texts[g]))
                rest, rest_tf = np.unique(of[~frequent] << 32 | gram[~frequent].astype(np.int64), return_counts=True)
                place: dict[bytes, int] = {}
                at, sizes = [], []
                for t in texts[g]:
                    own = [place.setdefault(w, len(place)) for w in _tokens(t)]
                    at.extend(own)
                    sizes.append(len(own))
                n = len(sizes)
                rids = np.arange(rid, rid + n)
                rid += n
                sizes = np.array(sizes, np.int64)
                # Times of each token in each text.
                pair, tf = np.unique(np.repeat(np.arange(n), sizes) << 32 | np.array(at, np.int64), return_counts=True)
                doc, word = pair >> 32, pair & 0xFFFFFFFF
                keys = _keys(list(place)) if place else np.zeros((0, 2), np.int64)
                spot = np.minimum(np.searchsorted(top_a, keys[:, 0]), max(len(top_a) - 1, 0))
                known = (top_a[spot] == keys[:, 0]) & (top_b[spot] == keys[:, 1]) if len(top_a) else np.zeros(len(keys), bool)
                log = np.where(known, top_log[spot], 0.0) if len(top_a) else np.zeros(len(keys))
                n_known = np.bincount(doc, tf * known[word], n).astype(np.int64)
                log_sum = np.bincount(doc, tf * log[word], n).astype(np.float64)
                light = ~known[word]
                heads = [pa.array(rids), ids.slice(g.start, n), held.slice(g.start, n), pa.array(sizes + 1), pa.array(n_known), pa.array(log_sum), pa.array(scores), pa.array(rids * np.int64(0x9E3779B97F4A7C15 - (1 << 64))), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *_nones(n)]
                names = [x.split()[0] for x in _SCORED.split(", ")]
                yield pa.RecordBatch.from_arrays(heads, names)
                d, w, k = doc[light], word[light], int(light.sum())
                if k and vocabulary:
                    none = (pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(rids[d]), *none, pa.array(keys[w, 0]), pa.array(keys[w, 1]), pa.array(tf[light]), *_nones(k)], names)
                # The rarer grams. What follows an escape is needed where a gram may be new: in held-out texts.
                of, gram, k = rest >> 32, rest & 0xFFFFFFFF, len(rest)
                new = np.asarray(held.slice(g.start, n).fill_null(True))[of]
                escaped = [np.zeros(k) for _ in range(3)]
                for x, values in zip(escaped, (shorter.seen(gram[new])[0], shorter.below(gram[new]), shorter.probability(gram[new]))):
                    x[new] = values
                if k:
                    none = (pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(rids[of]), *none, pa.array(gram >> 8), pa.array(np.full(k, CONTEXT)), pa.array(rest_tf), pa.array((gram & 255).astype(np.int32)), *(pa.array(x, mask=~new) for x in escaped)], names)

    # A row for each text, and one for each of its rarer tokens and grams.  Those meet their counts and then their text's row, all in two shuffles.
    rows = docs.mapInArrow(tidied(scored), _SCORED)
    rare = counts.where((F.col("kind") == 0) & ~is_heavy).select(F.col("a").alias("a_"), F.col("b").alias("b_"), "n")
    rare = rare.unionByName(trie.select(F.col("context").alias("a_"), F.lit(CONTEXT).cast("long").alias("b_"), "n_all", "kinds", "free", "kinds_free", "bytes"), allowMissingColumns=True)
    own = F.col("bytes")[F.col("byte")]
    free = F.col("free") + F.col("kinds_free")
    after = F.when(F.col("kinds_free") == 0, F.col("below")).when(F.col("n2") > 0, F.col("n2") / free).otherwise(F.col("kinds_free") / free * F.col("below"))
    all_ = F.col("n_all") + F.col("kinds")
    p = F.when(F.col("n_all").isNull(), F.col("shorter")).when(own.isNotNull(), own / all_).otherwise(F.col("kinds") / all_ * after)
    met = rows.join(rare, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left")
    each = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))), F.lit(0)) + int(n_ends > 0)).alias("n_known"),
        (F.max("log_sum") + F.coalesce(F.sum(F.col("tf") * F.log10(F.col("n") + 1)), F.lit(0.0))).alias("log_sum"),
        (F.max("score") + F.coalesce(F.sum(F.when(F.col("byte").isNotNull(), F.col("tf") * F.log10(p))), F.lit(0.0))).alias("score"),
    )
    base = F.col("log_sum") + math.log10(n_ends + 1) - F.col("n_tokens") * math.log10(n_all + vocabulary + 1)
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
