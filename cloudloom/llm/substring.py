"""Substring dedup with prefix-partitioned suffix trees.

Two documents share a passage of ``window`` words exactly if two suffixes of them have the same first ``window`` words, that is, meet in an internal
node of the suffix tree at that depth.  Only such deep nodes are asked for, so the tree is built from groups that hold whole subtrees:

0. A document whose whole text a smaller document has loses all its passages, so only the first of equal texts goes on.
1. A suffix belongs to the prefix of PREFIXES[0] words that begins at its anchor, the one of the least hash within its first ``window`` words.  Equal suffixes have
   equal anchors, so no subtree is torn, and neighbouring suffixes mostly share theirs and travel as one segment of text, not as a copy of ``window`` words each.
2. Prefixes that stand in one document only have no deep node with two documents; their suffixes are never sent.
3. A group that doesn't fit in memory (more than ``most_group`` segments) is split by longer prefixes, the next of PREFIXES, until it fits.  Equal segments become one before
   that, so a passage in a third of all documents costs as many rows as it has different surroundings.  A prefix of ``window`` words is a
   single deep node, whose least document is a partial aggregate.
4. A group that fits becomes a suffix array with its LCP array, by the words themselves.  Runs of the array whose LCP is ``window`` or more are
   the leaves below one deep internal node: the maximal repeats, each with its least document.

Groups and splits are the same at every size of the corpus.  Only documents with a shared prefix have text sent on; positions are (start, number of windows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import _words
from cloudloom.llm._graph import hot_join, shared
from cloudloom.llm._rows import tidied

#: Words of a passage, and of the prefixes that name groups; the last one is a whole passage.
WINDOW, PREFIXES = 50, (16, 32)
#: Segments of a group that is sorted in memory; larger groups are split by longer prefixes.
MOST_GROUP = 2048
#: Prefixes of larger groups, exact copies and marks of segments that are sent to every task; if there are more, they are joined.
SENT = 1 << 20
#: Text of the groups that are sorted together.
CHUNK_BYTES = 4 << 20
#: Stands for a null doc_id, which counts last.
LAST = (1 << 63) - 1
#: Stands for the number of all windows of a text.
ALL = -1


def segments(words: _words.WordBatch, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of windows with the same anchor; windows are word numbers of the batch."""
    g = _words.grams(words.hashes(), gram)
    begin = np.flatnonzero(words.room() >= window)
    anchor = _words.sliding_min(g, window - gram + 1)[begin]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(begin)])
    runs = np.diff(np.concatenate((first, [len(begin)])))
    return g[anchor[first]].view(np.int64), begin[first], runs


def suffix_array(texts: list[bytes], runs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the first ``runs[i]`` suffixes of each text i, its LCP array (up to ``window`` words) and the suffixes' texts.

    Suffixes have numbers in the order of the texts.  Ranks of the first 1, 2, 4, ... ``window`` words by prefix doubling give the array; the
    LCP of two neighbours adds up the longest steps, from the greatest down, over which their ranks agree.
    """
    place: dict[bytes, int] = {}
    words = [t.split(b" ") for t in texts]
    rank = np.array([place.setdefault(w, len(place)) for ws in words for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    first = np.cumsum(sizes) - sizes
    room = np.repeat(first + sizes, sizes) - np.arange(len(rank))
    depth, steps = 1, [(1, rank)]
    while depth < window:
        step = min(depth, window - depth)
        at = np.flatnonzero(room >= depth + step)
        _, ranks = np.unique(rank[at] * (len(rank) + len(place) + 1) + rank[at + step], return_inverse=True)
        rank = np.full(len(rank), -1, np.int64)
        rank[at] = ranks
        depth += step
        steps.append((depth, rank))
    text = np.repeat(np.arange(len(texts)), runs)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    order = np.argsort(rank[start], kind="stable")
    one, two = start[order[:-1]], start[order[1:]]
    lcp = np.where(rank[one] == rank[two], window, 0)
    apart = np.flatnonzero(lcp == 0)
    for step, ranks in reversed(steps[:-1]):
        a, b = one[apart] + lcp[apart], two[apart] + lcp[apart]
        lcp[apart] += step * ((ranks[a] == ranks[b]) & (ranks[a] >= 0))
    return order, np.concatenate((np.zeros(min(1, len(order)), np.int64), lcp)), text


def deep_nodes(texts: list[bytes], runs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The internal node of depth ``window`` above each of the first ``runs[i]`` suffixes of each text i, as a number, and the suffixes' texts."""
    order, lcp, text = suffix_array(texts, runs, window)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(lcp < window)
    return node, text


def _least(node: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each suffix the least of the numbers ``of`` the suffixes of its node."""
    order = np.argsort(node, kind="stable")
    edge = np.flatnonzero(np.diff(node[order], prepend=-1) > 0)
    out = np.empty(len(node), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(of[order], edge), np.diff(np.append(edge, len(node))))
    return out


def _ranges(flag: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of set flags that stay within one text."""
    at = np.flatnonzero(flag)
    new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(text[at]) != 0)))[: len(at)]
    begin = at[new]
    return begin, np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))


def _first_texts(batch: pa.RecordBatch, copies) -> list[bytes]:
    """The texts of (doc, tkey, text, name), empty for the rows whose name is among the ``copies`` (a broadcast sorted array, or None)."""
    texts = _words.to_bytes(batch.column(2))
    if copies is None or not len(copies.value):
        return texts
    name = batch.column(3).to_numpy()
    spot = np.minimum(np.searchsorted(copies.value, name), len(copies.value) - 1)
    return [b"" if x else t for t, x in zip(texts, (copies.value[spot] == name).tolist())]


def _refs(window: int, gram: int, copies):
    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _first_texts(batch, copies)
            doc, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for g in _words.groups(texts):
                words = _words.split(texts[g], _words.NOT_SPACE, lower=False)
                h, begin, runs = segments(words, window, gram)
                d = np.searchsorted(words.first, begin, "right") - 1
                arrays = [doc[g][d], tkey[g][d], h, (begin - words.first[d]).astype(np.int32), runs.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc", "tkey", "h", "start", "run"])

    return refs


def _light(window: int):
    """Texts of the listed segments of (doc, tkey, row, segs): (h, doc, tkey, start, run, content)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _words.to_bytes(batch.column(2).field("text"))
            doc, tkey, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            out: list[tuple] = []
            for i, t in enumerate(texts):
                words = t.split()
                for h, start, run in {(x["h"], x["start"], x["run"]) for x in listed[i]}:
                    out.append((h, doc[i], tkey[i], start, run, b" ".join(words[start : start + run + window - 1])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["h", "doc", "tkey", "start", "run", "content"])

    return cut


def _digests(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in texts]), ">i8").astype(np.int64).reshape(-1, 2)


def _heavy(window: int, gram: int, known, copies):
    """The segments of (doc, tkey, text, name) with one of the prefixes ``known`` (a broadcast sorted array), or with one of those listed in a fifth column.

    Each occurrence is a row (s1, s2, doc, tkey, start), s the segment's 128 bits.  Each different segment of a task is a row with its content and
    the least and greatest document that have it.
    """
    names = ["s1", "s2", "doc", "tkey", "start", "content", "least", "most"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def row(n: int, **own) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own[c], k) if c in own else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, size = {}, 0

        def told() -> pa.RecordBatch:
            s, (least, most) = _digests(list(ends)), zip(*ends.values())
            return row(len(ends), s1=s[:, 0], s2=s[:, 1], content=list(ends), least=least, most=most)

        for batch in batches:
            texts = _first_texts(batch, copies)
            doc, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            listed = batch.column(4).to_pylist() if known is None else None
            for g in _words.groups(texts):
                words = _words.split(texts[g], _words.NOT_SPACE, lower=False)
                h, begin, runs = segments(words, window, gram)
                names_ = np.unique(np.array([x for own in listed[g] for x in own], np.int64)) if known is None else known.value
                spot = np.minimum(np.searchsorted(names_, h), len(names_) - 1)
                own = np.flatnonzero(names_[spot] == h)
                d = np.searchsorted(words.first, begin[own], "right") - 1
                content = [words.span(a, a + n + window - 1) for a, n in zip(begin[own].tolist(), runs[own].tolist())]
                s = _digests(content)
                yield row(len(own), s1=s[:, 0], s2=s[:, 1], doc=doc[g][d], tkey=tkey[g][d], start=(begin[own] - words.first[d]).astype(np.int32))
                for t, x in zip(content, doc[g][d].tolist()):
                    known_ends = ends.get(t)
                    if known_ends is None:
                        size += len(t)
                        ends[t] = x, x
                    elif x < known_ends[0] or x > known_ends[1]:
                        ends[t] = min(x, known_ends[0]), max(x, known_ends[1])
                if size > 8 * _words.GROUP_BYTES:
                    yield told()
                    ends, size = {}, 0
        if ends:
            yield told()

    return cut


_RECUT = "h long, s1 long, s2 long, start int, run int, content binary, least long, most long"


def _recut(window: int, gram: int):
    """Segments by prefixes of ``gram`` words of the segments (s1, s2, start, content, least, most)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(3).to_pylist()
            for g in _words.groups(contents):
                words = _words.split(contents[g], _words.NOT_SPACE, lower=False)
                h, begin, runs = segments(words, window, gram)
                d = np.searchsorted(words.first, begin, "right") - 1
                s1, s2, start, least, most = (batch.column(c).to_numpy()[g][d] for c in (0, 1, 2, 4, 5))
                content = [words.span(a, a + n + window - 1) for a, n in zip(begin.tolist(), runs.tolist())]
                arrays = [h, s1, s2, (start + begin - words.first[d]).astype(np.int32), runs.astype(np.int32), pa.array(content, pa.binary()), least, most]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [x.split()[0] for x in _RECUT.split(", ")])

    return cut


def _in_groups(solve, chunk_bytes: int):
    """Applies ``solve`` to whole groups, some at a time, of rows sorted by their first column."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            if size >= chunk_bytes:  # hand over all whole groups
                last = held[-1].column(0)[-1].as_py()
                begin = int(np.searchsorted(h != last, True)) if (h != last).any() else batch.num_rows
                if begin < batch.num_rows:
                    yield solve(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                    held, size, batch = [], 0, batch.slice(begin)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return groups


def _of_contents(rows: pa.Table, window: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least document of each window of each row's content, by a tree over the different contents; the window's row and place."""
    content, runs = rows["content"].to_pylist(), rows["run"].to_numpy().astype(np.int64)
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(t, len(place)) for t in content], np.int64)
    own = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(own, which, least)
    sizes = np.zeros(len(place), np.int64)
    sizes[which] = runs
    node, text = deep_nodes(list(place), sizes, window)
    of_node = _least(node, own[text])
    row = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    return of_node[(np.cumsum(sizes) - sizes)[which][row] + at], row, at


def _trees(window: int):
    """Of rows (h, doc, tkey, start, run, content): the windows whose deep node has a smaller document, as (doc, tkey, start, n)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        doc, tkey, start = (rows[c].to_numpy() for c in ("doc", "tkey", "start"))
        least, row, at = _of_contents(rows, window, doc)
        begin, n = _ranges(doc[row] > least, row)
        own = row[begin]
        arrays = [doc[own], tkey[own], (start[own] + at[begin]).astype(np.int32), n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc", "tkey", "start", "n"])

    return solve


def _marks(window: int):
    """Of rows (h, s1, s2, start, run, content, least, most): the places in the segments s whose deep node has two documents, as (s1, s2, place, least)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        s1, s2, start, own, most = (rows[c].to_numpy() for c in ("s1", "s2", "start", "least", "most"))
        least, row, at = _of_contents(rows, window, own)
        keep = np.flatnonzero(least < most[row])
        row = row[keep]
        arrays = [s1[row], s2[row], (start[row] + at[keep]).astype(np.int32), least[keep]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["s1", "s2", "place", "least"])

    return solve


def _split(contents: DataFrame, prefixes: tuple[int, ...], window: int, most_group: int, chunk_bytes: int) -> DataFrame:
    """(s1, s2, place, least) of the segments (s1, s2, start, content, least, most), by prefixes that grow until their groups fit."""
    marks = None
    for gram in (*prefixes, window):
        found = shared(contents.mapInArrow(tidied(_recut(window, gram)), _RECUT))
        sizes = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("one"), F.max("most").alias("two")).where(F.col("one") < F.col("two"))
        met = shared(hot_join(found, sizes.select("h", "n"), ["h"]))
        fit = met.where(F.col("n") <= most_group).drop("n").repartition("h").sortWithinPartitions("h")
        own = fit.mapInArrow(tidied(_in_groups(_marks(window), chunk_bytes)), "s1 long, s2 long, place int, least long")
        marks = own if marks is None else marks.unionByName(own)
        contents = met.where(F.col("n") > most_group).select("s1", "s2", "start", "content", "least", "most")
        if contents.isEmpty():
            return marks
    # A group by a whole passage is one deep node.
    node = contents.groupBy("content").agg(F.min("least").alias("first"))
    last = hot_join(contents, node, ["content"]).where(F.col("first") < F.col("most"))
    return marks.unionByName(last.select("s1", "s2", F.col("start").alias("place"), F.col("first").alias("least")))


def _sorted_marks(marks: DataFrame) -> tuple[np.ndarray, ...]:
    """The marks of all segments as arrays: their 128 bits in order, where each one's marks begin, and the marks by place."""
    rows = marks.select("s1", "s2", F.explode("marks").alias("m")).select("s1", "s2", "m.place", "m.least").toArrow()
    s1, s2, place, least = (rows[c].to_numpy() for c in ("s1", "s2", "place", "least"))
    order = np.lexsort((place, s2, s1))
    s1, s2, place, least = s1[order], s2[order], place[order], least[order]
    first = np.flatnonzero(np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))[: len(s1)])
    return s1[first], s2[first], np.append(first, len(s1)), place, least


def _looked_up(marks):
    """Of occurrences (s1, s2, doc, tkey, start), a document's together: (doc, tkey, gone) by the broadcast arrays of ``_sorted_marks``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s1, s2, begin, place, least = marks.value
        for batch in batches:
            a, b, doc, tkey, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            # the first segment of the same first half; others of that half, if there are any, come next
            spot = np.searchsorted(s1, a)
            while True:
                near = np.minimum(spot, len(s1) - 1)
                wrong = (spot < len(s1)) & (s1[near] == a) & (s2[near] != b)
                if not wrong.any():
                    break
                spot[wrong] += 1
            at = np.flatnonzero((spot < len(s1)) & (s1[near] == a))
            n = begin[spot[at] + 1] - begin[spot[at]]
            row = np.repeat(at, n)
            mark = np.repeat(begin[spot[at]] - (np.cumsum(n) - n), n) + np.arange(len(row))
            keep = least[mark] < doc[row]
            row, window = row[keep], (start[row] + place[mark])[keep]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)))[: len(row)])
            runs, own = np.diff(np.append(new, len(row))).astype(np.int32), row[new]
            edge = np.flatnonzero(np.concatenate(([True], (doc[own][1:] != doc[own][:-1]) | (tkey[own][1:] != tkey[own][:-1])))[: len(own)])
            spans = pa.StructArray.from_arrays([pa.array(window[new].astype(np.int32)), pa.array(runs)], ["start", "n"])
            gone = pa.ListArray.from_arrays(pa.array(np.append(edge, len(own)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([pa.array(doc[own][edge]), pa.array(tkey[own][edge]), gone], ["doc", "tkey", "gone"])

    return look


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))


def _finish(window: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = _words.to_bytes(batch.column(0).field("text")), batch.column(1).to_pylist()
            kept, total, removed, spans = [], [], [], []
            for t, ranges in zip(texts, gone):
                words = t.split()
                n, own = len(words), []
                if ranges and any(x["n"] == ALL for x in ranges):
                    own, words = ([{"start": 0, "n": n}], []) if n >= window else ([], words)
                elif ranges:
                    mark = np.zeros(n + 1, np.int64)
                    at = np.array([(x["start"], x["start"] + x["n"] + window - 1) for x in ranges])
                    np.add.at(mark, at[:, 0], 1)
                    np.add.at(mark, at[:, 1], -1)
                    out = np.cumsum(mark[:-1]) > 0
                    begin, sizes = _ranges(out, np.zeros(n, np.int64))
                    own = [{"start": a, "n": k} for a, k in zip(begin.tolist(), sizes.tolist())]
                    words = [words[i] for i in np.flatnonzero(~out)]
                kept.append(b" ".join(words).decode())
                total.append(n)
                removed.append(n - len(words))
                spans.append(own)
            arrays = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "kept_text", "n_words", "n_removed", "removed"])

    return finish


def dedup_substrings(
    docs: DataFrame, *, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, most_group: int = MOST_GROUP, sent: int = SENT, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as the struct ``row``, its text without repeated passages, and counts.

    A word is removed if a passage of ``window`` words that covers it also begins in a row with a smaller doc_id.  Added: kept_text (the
    kept words joined by one space), n_words, n_removed, removed (the removed runs of words: start, n).  Passages are judged on the input, not on what is left of it.

    Null and empty texts have no words and give an empty kept_text.  A null doc_id counts as larger than all others but 2 ** 63 - 1, with which it ties.  Rows with the
    same doc_id never remove from each other.  Texts shorter than ``window`` words are kept.  An empty table gives an empty table.
    """
    spark, gram = docs.sparkSession, prefixes[0]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tkey"), F.struct("*").alias("row"))
    # Rows whose text a smaller document has: by 128 bits of the text.
    keys = shared(rows.select("doc", "tkey", F.coalesce(F.xxhash64(F.lit(7), "row.text"), F.lit(0)).alias("tkey2")))
    least = keys.groupBy("tkey", "tkey2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where(F.col("least") < F.col("most"))
    copies = shared(hot_join(keys, least, ["tkey", "tkey2"]).where(F.col("doc") > F.col("least")).select("doc", "tkey").distinct())
    name = F.xxhash64("doc", "tkey").alias("name")
    texts, known_copies = rows.select("doc", "tkey", F.col("row.text").alias("text"), name), None
    if copies.count() <= sent:
        known_copies = spark.sparkContext.broadcast(np.sort(copies.select(name).toPandas()["name"].to_numpy(np.int64)))
    else:
        texts = texts.join(copies, ["doc", "tkey"], "left_anti")
    refs = shared(texts.mapInArrow(tidied(_refs(window, gram, known_copies)), "doc long, tkey long, h long, start int, run int"))
    # A row for each prefix: partial sums before the shuffle.
    met = shared(refs.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last")).select("h", "n"))
    large = met.where(F.col("n") > most_group)
    n_large, total = large.count(), refs.count()
    # The hottest, 4,096 at most, stay out of the join, where each would be one task's.
    hottest = F.broadcast(large.where(F.col("n") * 4096 >= total).select("h"))
    calm = refs.join(hottest, "h", "left_anti").join(met.where(F.col("n") <= most_group).select("h"), "h")
    listed = calm.groupBy("doc", "tkey").agg(F.collect_list(F.struct("h", "start", "run")).alias("segs"))  # a document's own segments
    # The documents are dealt once, by (doc, tkey): both joins below read the same shuffle.
    pieces = rows.join(listed, ["doc", "tkey"]).select("doc", "tkey", "row", "segs").mapInArrow(tidied(_light(window)), "h long, doc long, tkey long, start int, run int, content binary")
    pieces = pieces.repartition("h").sortWithinPartitions("h").select("h", "doc", "tkey", "start", "run", "content")
    gone = pieces.mapInArrow(tidied(_in_groups(_trees(window), chunk_bytes)), "doc long, tkey long, start int, n int")
    gone = gone.select("doc", "tkey", F.array(F.struct("start", "n")).alias("gone"))
    gone = gone.unionByName(copies.select("doc", "tkey", F.array(F.struct(F.lit(0).alias("start"), F.lit(ALL).alias("n"))).alias("gone")))
    if n_large:
        known = None
        if n_large <= sent:
            known = spark.sparkContext.broadcast(np.sort(large.select("h").toPandas()["h"].to_numpy(np.int64)))
        else:
            own = refs.join(F.broadcast(large.where(F.col("n") * 4096 >= total).select("h")), "h").select("doc", "tkey", "h")
            own = own.unionByName(refs.join(hottest, "h", "left_anti").join(large.select("h"), "h").select("doc", "tkey", "h"))
            texts = texts.join(own.groupBy("doc", "tkey").agg(F.collect_set("h").alias("names")), ["doc", "tkey"]).select("doc", "tkey", "text", "name", "names")
        cut = shared(texts.mapInArrow(tidied(_heavy(window, gram, known, known_copies)), "s1 long, s2 long, doc long, tkey long, start int, content binary, least long, most long"))
        contents = cut.where(F.col("content").isNotNull()).groupBy("s1", "s2").agg(F.first("content").alias("content"), F.min("least").alias("least"), F.max("most").alias("most"))
        marks = _split(contents.select("s1", "s2", F.lit(0).alias("start"), "content", "least", "most"), prefixes[1:], window, most_group, chunk_bytes)
        marks = shared(marks.groupBy("s1", "s2").agg(F.collect_list(F.struct("place", "least")).alias("marks")))  # of a segment, as many as it has windows
        found = cut.where(F.col("content").isNull()).select("s1", "s2", "doc", "tkey", "start")
        n_marks = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
        if 0 < n_marks <= sent:  # they go to the occurrences, which stay where they are
            told = spark.sparkContext.broadcast(_sorted_marks(marks))
            gone = gone.unionByName(found.mapInArrow(tidied(_looked_up(told)), "doc long, tkey long, gone array<struct<start: int, n: int>>"))
        elif n_marks:
            taken = F.transform(F.filter("marks", lambda m: m["least"] < F.col("doc")), lambda m: F.struct((F.col("start") + m["place"]).alias("start"), F.lit(1).alias("n")))
            gone = gone.unionByName(hot_join(found, marks, ["s1", "s2"]).select("doc", "tkey", taken.alias("gone")).where(F.size("gone") > 0))
    removal = gone.groupBy("doc", "tkey").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    final = T.StructType([rows.schema["row"], *T._parse_datatype_string("kept_text string, n_words long, n_removed long, removed array<struct<start: int, n: int>>").fields])
    return rows.join(removal, ["doc", "tkey"], "left").select("row", "gone").mapInArrow(tidied(_finish(window)), final)
