"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent 1- to 3-grams in order of frequency.  A document's own most frequent n-grams are
compared with each profile: the out-of-place distance adds, over the document's n-grams, how far apart
the two ranks are, and the greatest possible shift for an n-gram that the profile lacks.  The nearest profile wins.

Profiles are kept sparse, a few kilobytes a language, and go to the tasks in blocks of ``block`` languages; with more than one block, each is a pass that
keeps the nearer language.  Texts are counted in slices, so memory doesn't follow their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm._graph import hot_join, shared
from cloudloom.llm._rows import packed, texts, tidied

#: N-grams kept of a language and of a document.
PROFILE, DOCUMENT = 400, 300
#: Labelled documents that a language's profile is learned from, about.
SAMPLE = 20_000
#: Languages whose profiles are sent to the tasks at a time.
BLOCK = 4096
#: Letters counted at a time, and n-grams that a counting task holds for a language before it adds them up.
SLICE, HELD = 1 << 20, 1 << 17
#: Texts of a batch that are Python strings at a time.
ROWS = 1024
#: The prediction for texts without letters.
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_BITS = 21
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, bool)
        for begin in range(0, 0x110000, 0x800):  # in small pieces: all of them at once are a million strings
            if not 0xD800 <= begin < 0xE000:
                for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(begin, begin + 0x800)))):
                    _letters[begin + m.start() : begin + m.end()] = True
    return _letters


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def ngrams(text: str, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of the letters of a text, runs of anything else being one space, and their counts."""
    low, parts, last = f" {text.lower()} ", [], np.zeros(0, np.int64)
    for begin in range(0, len(low), slice_):
        code = np.frombuffer(low[begin : begin + slice_].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_is_letter()[code], code, 32).astype(np.int64)
        space = code == 32
        code = code[~(space & np.concatenate((last[-1:] == 32 if len(last) else [False], space[:-1])))]
        one = code[code != 32]
        both = np.concatenate((last, code))  # with the two letters before, whose own n-grams are counted
        two = (both[:-1] << _BITS) | both[1:]
        three = (two[:-1] << _BITS) | both[2:]
        parts.append(np.unique(np.concatenate((one, two[max(len(last) - 1, 0) :], three[max(len(last) - 2, 0) :])), return_counts=True))
        last = both[-2:]
        if len(parts) == 16:
            parts = [_merged(parts)]
    return parts[0] if len(parts) == 1 else _merged(parts)


def _top(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams in order of frequency, the smaller code first on ties."""
    if len(grams) > 4 * k:  # all that tie with the k-th stay
        least = -np.partition(-counts, k - 1)[k - 1]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:k]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (text, lang): (lang, gram, n), in parts, so that no more than HELD n-grams are held for a language whatever it has."""
    sums: dict[str, list] = {}
    held: dict[str, int] = {}

    def made(lang: str, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32))), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                parts = sums.setdefault(lang, [])
                parts.append(ngrams(text))
                held[lang] = held.get(lang, 0) + len(parts[-1][0])
                if held[lang] > HELD:
                    sums[lang] = [_merged(parts)]
                    held[lang] = len(sums[lang][0][0])
                    if held[lang] > HELD // 2:
                        yield made(lang, *sums.pop(lang)[0])
                        held[lang] = 0
    for lang, parts in sums.items():
        yield made(lang, *_merged(parts))


def profile_table(docs: DataFrame, *, sample: int = SAMPLE, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profile of each language of the labelled documents (doc_id, text, lang), as n-gram codes.

    About ``sample`` documents of each language are used, chosen by a hash of doc_id and the text.  Rows without text or lang are left out.  On ties the smaller code
    comes first.  Rows that repeat are used together or not at all.  An empty table has no profiles.
    """
    docs = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    totals = docs.groupBy("lang").agg((sample / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = hot_join(docs.withColumn("draw", draw).drop("doc_id"), totals, ["lang"]).where(F.col("draw") < F.col("share")).select("text", "lang")
    counts = chosen.mapInArrow(tidied(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    key = F.struct((-F.col("n")).alias("n"), "gram")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(key))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank")


def _profiles(rows: list) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def learn_profiles(docs: DataFrame, *, sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """The ``profile_table`` of documents in a few languages, as n-gram codes in rank order by language."""
    return _profiles(profile_table(docs, sample=sample, size=size).collect())


class Classifier:
    """Holds the profiles as sorted n-grams, each with the languages that know it and its ranks there."""

    def __init__(self, profiles: dict[str, list[int]], document: int = DOCUMENT, missing: int = 0):
        self.langs = sorted(profiles)
        self.document = document
        self.missing = max([missing, document, *(len(p) for p in profiles.values())])
        gram = np.concatenate([np.zeros(0, np.int64), *(np.array(profiles[x], np.int64) for x in self.langs)])
        sizes = [len(profiles[x]) for x in self.langs]
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.lang = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.rank = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])[order]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / greatest distance."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        top = _top(*ngrams(text), self.document)
        low, n = np.searchsorted(self.gram, top), np.searchsorted(self.gram, top, "right")
        n -= low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = self.missing - np.abs(self.rank[at] - np.repeat(np.arange(len(top)), n))  # what a known n-gram saves of the greatest distance
        out = self.missing * len(top) - np.bincount(self.lang[at], near, len(self.langs)).astype(np.int64)
        best = int(out.argmin())
        return self.langs[best], float(min(1.0, max(0.0, 1 - out[best] / (self.missing * len(top)))))


def identify(docs: DataFrame, profiles: dict[str, list[int]] | DataFrame, *, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Each row of ``docs`` as the struct ``row`` of its columns ``keep`` (all by default), lang_pred and score (0 to 1).  docs needs text.

    profiles: those of ``learn_profiles`` or, for languages without number, ``profile_table``.
    A null text, or one without a letter, gets ``und`` and score 0, as does every text if there are no profiles.
    Languages that are equally near: the first by code point.  Whole texts are read.  Rows that repeat are rows of their own.  An empty table gives an empty table.
    """
    rows = packed(docs, keep)
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if isinstance(profiles, dict):
        blocks, missing, n = [profiles], 0, 1
    else:
        profiles = shared(profiles)
        n, missing = profiles.agg(F.count_distinct("lang"), F.coalesce(F.max("rank"), F.lit(0))).first()
        n = max(1, -(-2 * n // block)) if n > block else 1
        blocks = (_profiles(profiles.where(F.pmod(F.xxhash64("lang"), F.lit(n)) == i).collect()) for i in range(n))

    def passed(rows: DataFrame, model) -> DataFrame:
        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classify = model.value
            for batch in batches:
                each = texts(batch)
                found = [classify(t) for begin in range(0, len(each), ROWS) for t in each.slice(begin, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["row", "lang_pred", "score"])

        return rows.mapInArrow(tidied(predict), T.StructType([rows.schema["row"], *schema.fields[1:]]))

    models = (docs.sparkSession.sparkContext.broadcast(Classifier(own, missing=missing)) for own in blocks)
    if n == 1:
        return passed(rows, next(models))
    # The text goes along, and of two blocks the nearer language stays.
    text = F.col("t") if "t" in rows.columns else F.col("row.text")
    best = rows.select(F.struct("row", text.alias("t"), F.lit(UNDETERMINED).alias("lang"), F.lit(-1.0).alias("score")).alias("row"))
    for model in models:
        found = passed(best.select("row", F.col("row.t").alias("t")), model)
        old, new = (F.struct(F.col(f"{x}score").alias("score"), F.col(f"{x}{y}").alias("lang")) for x, y in (("row.", "lang"), ("", "lang_pred")))
        nearer = (new["score"] > old["score"]) | (new["score"] == old["score"]) & (new["lang"] < old["lang"])
        got = F.when(nearer, new).otherwise(old)
        best = shared(found.select(F.struct("row.row", "row.t", got["lang"].alias("lang"), got["score"].alias("score")).alias("row")))
    return best.select("row.row", F.col("row.lang").alias("lang_pred"), F.col("row.score").alias("score"))
