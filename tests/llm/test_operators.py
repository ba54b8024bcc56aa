"""The operators against plain versions: on the smallest table, and on nulls, ties, repeated rows and odd columns."""

import hashlib
import random
import time
import zlib

import brute
import duckdb
import pytest

from cloudloom.llm import avi, decontam, langid, linededup, mixing, pii, ppm, queries, simhash

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def table(name="documents", columns="doc_id, text, source, lang"):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


ODD = [
    (1, "a b c a b c", "s", "en"),
    (1, "a b c a b c", "s", "en"),
    (2, None, "s", None),
    (3, "", None, "en"),
    (None, " \t\n ", None, None),
    (None, "x" * 3000 + " y@b.c", "t", "de"),
    (7, "née 12 " * 4000, "t", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, source string, lang string"
    from pyspark.sql import functions as F

    # columns named as what the operators add
    clash = ("row", "t", "size", "target", "taken", "n_words", "host", "keys", "spans", "fp", "score", "rid", "media", "src", "a", "b", "n", "id")
    return spark.createDataFrame(ODD, schema).select("*", *[F.lit(1).alias(c) for c in clash])


# mixing


def test_mix_matches_targets(spark):
    got = queries.op1_mix_sources(spark, SF).toPandas()
    size = {d: len(brute.WORD.findall(t or "")) for d, t, *_ in table()}
    sizes = {}
    for d, _, s, _ in table():
        sizes[s] = sizes.get(s, 0) + size[d]
    want = brute.targets(sizes)
    source = {d: s for d, _, s, _ in table()}
    assert {r.doc_id: r.size for r in got.itertuples()} == size
    for s, t in want.items():
        own = got[got.doc_id.map(source) == s]
        assert own.target.iloc[0] == pytest.approx(t)
        assert own.taken.sum() == int(t + 1e-9)
        assert (own.taken <= 2 * own["size"]).all()
    again = queries.op1_mix_sources(spark, SF).toPandas()
    assert sorted(map(repr, got.itertuples(index=False))) == sorted(map(repr, again.itertuples(index=False)))


def test_mix_order_follows_a_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "early" if i % 2 else "late") for i in range(400)], "doc_id long, text string, source string")
    schedules = {"early": ((0.0, 1.0), (1.0, 0.0)), "late": ((0.0, 0.0), (1.0, 1.0))}
    got = mixing.mix_sources(docs, schedules=schedules, cycle=(1.0,), budget=1.0, slots=8).collect()
    at = [r["position"] for r in got]
    assert at == sorted(at)
    half = [r["row"]["source"] for r in got if r["position"] < 0.5]
    assert half.count("early") == 150 and half.count("late") == 50  # three quarters of a falling ramp come first


def test_mix_positions_invert_the_curriculum(spark):
    """Of the whole query: each document is read when its source's demand, summed up step by step, has reached the words before it."""
    import numpy as np

    assert all(len({w for _, w in knots}) > 1 for knots in mixing.CURRICULUM)
    got = queries.op1_mix_sources(spark, SF).toPandas().dropna(subset=["position"])
    source = got.doc_id.map({d: s for d, _, s, _ in table()})
    names = sorted({s for _, _, s, _ in table() if s is not None}, key=lambda s: s.encode())
    time = np.linspace(0, 1, 200_001)
    for rank, name in enumerate(names):
        own = got[source == name].sort_values("position")
        weight = np.interp(time, *zip(*mixing.CURRICULUM[rank % len(mixing.CURRICULUM)]))
        demand = np.concatenate(([0.0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
        before = (own["size"].cumsum() - own["size"]).to_numpy()
        want = np.interp(before / own["target"].to_numpy(), demand / demand[-1], time)
        assert own["position"].to_numpy() == pytest.approx(want, abs=1e-6)
    assert not np.allclose(got["position"], mixed_flat(spark, got.doc_id))


def test_mix_places_every_reading(spark):
    """A source read twice has as many readings in the second half of a flat schedule as in the first; the last round goes on where the first ends."""
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 40 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, curriculum=mixing.CURRICULUM, slots=8, schedules={"a": ((0.0, 1.0), (1.0, 1.0))}).collect()
    assert all(len(r["positions"]) == r["copies"] and r["positions"] == sorted(r["positions"]) and (r["position"] is None or r["positions"][0] == r["position"]) for r in got)
    of_a = [r["positions"] for r in got if r["row"]["source"] == "a"]
    assert all(len(x) == 2 and x[1] - x[0] == pytest.approx(0.5) for x in of_a)
    assert sorted(p for x in of_a for p in x) == pytest.approx([i / 80 for i in range(80)])


def mixed_flat(spark, ids):
    flat = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).select("row.doc_id", "position").toPandas()
    return ids.map(dict(zip(flat["doc_id"], flat["position"])))


def test_mix_odd(odd, spark):
    got = mixing.mix_sources(odd, slots=3)
    assert got.count() == len(ODD)
    assert sum(r["taken"] for r in got.collect()) == pytest.approx(1.5 * sum(r["size"] for r in got.collect()), abs=3)
    assert mixing.mix_sources(odd.limit(0)).count() == 0


# language


def test_language(spark):
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, SF).collect()}
    held = [(d, lang) for d, _, _, lang in table() if brute.fold(d, 4) == 2]
    assert {d for d, r in got.items() if r["held_out"]} == {d for d, _ in held}
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) > 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_against_brute_force(spark):
    """Every prediction and score of the query, from profiles learned as the query learns them."""
    docs = [(d, t, lang, brute.fold(d, 4) != 2) for d, t, _, lang in table()]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op2_language_id(spark, SF).collect()}
    want = brute.languages(docs)
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(got[d][1] == pytest.approx(want[d][1], abs=1e-12) for d in want)


def test_language_in_blocks_and_slices(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    many = docs.withColumn("lang", F.concat_ws("-", "lang", (F.col("doc_id") % 5).cast("string")))
    table_ = langid.profile_table(many)
    got, want = (sorted(map(repr, langid.identify(docs, p, keep=["doc_id"], block=6).collect())) for p in (table_, langid.learn_profiles(many)))
    assert got == want and len(set(langid.learn_profiles(many))) > 12
    text = "Où est l'été ? — ça, c'est 12 fois... ñandú" * 3
    for slice_ in (1, 2, 5, 7):
        assert [x.tolist() for x in langid.ngrams(text, slice_)] == [x.tolist() for x in langid.ngrams(text)]


def test_language_odd(odd, spark):
    profiles = {"en": langid.ngrams("the cat and the hat")[0].tolist(), "fr": langid.ngrams("née été")[0].tolist()}
    got = langid.identify(odd, profiles).select("row.doc_id", "lang_pred").collect()
    assert len(got) == len(ODD)
    by = {(o[0], o[1]): g["lang_pred"] for o, g in zip(ODD, got)}
    assert by[2, None] == by[3, ""] == by[None, " \t\n "] == "und"
    assert by[7, ODD[-1][1]] == "fr"
    assert langid.learn_profiles(odd.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_out_of_place():
    a, b, c = 97, 98, 99
    model = langid.Classifier({"x": [a, b, c], "y": [c, b, a]}, document=3)
    # "aab": 1-grams a (2), b (1) and their 2- and 3-grams: ranked by count, then code
    grams, counts = langid.ngrams("aab")
    top = langid._top(grams, counts, 3).tolist()
    miss = 3
    want = {lang: sum(abs(p.index(g) - i) if g in p else miss for i, g in enumerate(top)) for lang, p in {"x": [a, b, c], "y": [c, b, a]}.items()}
    best = min(want, key=lambda k: (want[k], k))
    assert model("aab") == (best, pytest.approx(1 - want[best] / (miss * len(top))))


# decontamination

COLUMNS3 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block_bytes,piece_bytes", [(decontam.BLOCK_BYTES, decontam.PIECE_BYTES), (20_000, 300)])
def test_decontamination(spark, block_bytes, piece_bytes):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(1000, "Un deux trois"), (1001, None), (None, "quatre cinq"), (1002, ""), (1003, "the of")], "item_id long, text string")
    more = spark.createDataFrame([(9000, "x un DEUX trois y the the of"), (9001, None), (9001, "the of"), (9001, "the of"), (9002, "")], "doc_id long, text string")
    docs, bench = docs.select("doc_id", "text").unionByName(more), bench.select("item_id", "text").unionByName(extra)
    got = decontam.find_contamination(docs, bench, block_bytes=block_bytes, piece_bytes=piece_bytes).select("row.doc_id", *COLUMNS3[1:])
    want = brute.contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.where("item_id is not null").collect()])
    assert sum(r[5] for r in want) > 5
    assert rows(got, *COLUMNS3) == sorted(want, key=repr)


def test_benchmark_block_is_small():
    """Bytes of a block's arrays for each byte of its text, so that a full block stays below 300 MB in a task."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(150))) for i in range(1500)]
    block = decontam.Benchmark(items)
    text = sum(len(t) for _, t in items)
    assert block.n_bytes < 7 * text and block.n_bytes / text * decontam.BLOCK_BYTES < 300e6
    from cloudloom.llm import _words

    own = _words.split([b"x y " + items[7][1].upper().encode() + b" z"], _words.ALNUM, lower=True)
    starts, sizes, found = block.hits(own)
    assert starts.tolist() == list(range(2, 140)) and set(sizes.tolist()) == {13} and set.union(*found) == {"7"}


def test_decontamination_odd(odd, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.find_contamination(odd, none).collect()} == {0}
    assert decontam.find_contamination(odd.limit(0), none).count() == 0


# lines


def test_lines(spark):
    want = brute.lines([r[:3] for r in table()])
    assert sum(r[2] for r in want) > 0
    assert rows(queries.op4_line_dedup(spark, SF), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_lines_odd(odd, spark):
    got = linededup.dedup_lines(odd, least_pages=2, sent_bytes=0, hot=4).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr)[:2] == [(1, "", 1, 1)] * 2 or (1, "", 1, 1) in map(tuple, got)
    assert (2, None, 0, 0) in map(tuple, got) and (3, "", 1, 0) in map(tuple, got)
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


@pytest.mark.parametrize("sent_bytes", [linededup.SENT_BYTES, 0])
def test_lines_however_they_are_joined(spark, sent_bytes):
    """Sent to every task or joined by parts; pages with many lines that repeat, of which many are boilerplate."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["", " ", f"line {rng.randrange(40)}", f" own {rng.random()} "]) for _ in range(rng.choice([0, 3, 400]))), rng.choice(["a", "a", "a", "b", None])) for i in range(80)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), sent_bytes=sent_bytes, hot=2)
    found = rows(got.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("s")), "doc_id", "n_lines", "n_dropped", "s")
    assert found == sorted(brute.lines(docs), key=repr) and sum(r[2] for r in found) > 1000


def test_lines_of_a_page_take_linear_time(spark):
    """A plan that compares all pairs of a page's lines would take minutes here."""
    page = "\n".join(f"line {i}" for i in range(200_000))
    df = spark.createDataFrame([(i, page, "h") for i in range(3)], "doc_id long, text string, source string")
    began = time.time()
    assert linededup.dedup_lines(df).agg({"n_dropped": "sum"}).first()[0] == 600_000
    assert time.time() - began < 60


def test_counting_holds_few_ngrams(monkeypatch):
    """The pipeline's memory: a language's n-grams leave in parts, however many it has, and sum up to the same."""
    import pyarrow as pa

    monkeypatch.setattr(langid, "HELD", 500)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(300)) for _ in range(60)]
    parts = list(langid._count(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["a", "b"] * 30)], ["text", "lang"])])))
    assert max(p.num_rows for p in parts) <= 500 + max(len(langid.ngrams(t)[0]) for t in texts)
    got, want = {}, {}
    for p in parts:
        for lang, gram, n in zip(*(c.to_pylist() for c in p.columns)):
            got[lang, gram] = got.get((lang, gram), 0) + n
    for i, t in enumerate(texts):
        for gram, n in zip(*(x.tolist() for x in langid.ngrams(t))):
            want["ab"[i % 2], gram] = want.get(("ab"[i % 2], gram), 0) + n
    assert got == want


# near duplicates


def test_near_texts_find_what_is_similar(spark):
    """Recall over pairs of 0.8 or more, by groups of similarity; no link below it; and the sketches' counting."""
    import numpy as np

    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    docs, similar = [], []
    for i in range(0, 600, 2):
        a = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 30))):
            b[rng.randrange(len(b))] = rng.choice(words)
        a, b = " ".join(a), " ".join(b).upper()
        docs += [(i, a), (i + 1, b)]
        similar.append(len(sets(a) & sets(b.lower())) / len(sets(a) | sets(b.lower())))
    docs += [(700, "one two"), (701, "two one"), (702, "One  two"), (703, None), (704, " "), (None, "one two")]
    got = {r["doc_id"]: (r["component_id"], r["leader"]) for r in simhash.near_texts(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "component_id", "leader").collect()}
    met = [got[2 * k + 1][0] == 2 * k for k in range(len(similar))]
    assert 100 < sum(j >= 0.8 for j in similar) < 280
    assert not any(m for m, j in zip(met, similar) if j < 0.8)
    assert sum(m for m, j in zip(met, similar) if 0.8 <= j < 0.85) > 0.9 * sum(0.8 <= j < 0.85 for j in similar)
    assert sum(m for m, j in zip(met, similar) if j >= 0.8) > 0.95 * sum(j >= 0.8 for j in similar)
    assert [got[d] for d in (700, 701, 702, 703, 704, None)] == [(700, True), (701, True), (700, False), (703, True), (703, False), (700, False)]
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    begin = np.array([0, 1, 2, 700, 955, 1210, 4000])
    sizes = np.diff(np.append(begin, 5000))
    want = [np.unpackbits(h[a : a + n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) for a, n in zip(begin, sizes)]
    assert (simhash._bit_sums(h, begin, sizes) == np.stack(want)).all()


def test_near_texts_lose_no_link(spark):
    """components equal those of all pairs where texts of a bucket are similar to each other, but not to its first, and to many of them."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 1500)]
    texts = [base[k : k + 200] for k in range(0, 1300, 20)]  # a chain: neighbours have 0.82, the next ones 0.66
    for f in range(60):  # families with a common half, the other half changed here and there
        body = [f"x{f % 6}y{i}" for i in range(90)] + [f"v{i}" for i in rng.integers(0, 10**6, 90)]
        texts += [[f"z{i}" if rng.random() < p else w for i, w in enumerate(body)] for p in (0.0, 0.01, 0.02, 0.02, 0.03)]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both) and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    order = rng.permutation(len(texts)).tolist()  # the first of a bucket is any of its texts
    docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string")
    got = dict(simhash.near_texts(docs).select("row.doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want
    assert set(want[:65]) == {0}


def test_near_texts_odd(odd):
    got = simhash.near_texts(odd).select("row.doc_id", "component_id", "leader").collect()
    assert len(got) == len(ODD)
    assert sorted((r["component_id"], r["leader"]) for r in got if r["doc_id"] == 1) == [(1, False), (1, True)]
    assert sum(r["leader"] for r in got) == len({r["component_id"] for r in got})
    assert simhash.near_texts(odd.limit(0)).count() == 0


def test_masks_cover():
    for radius in (1, 2, 3):
        tables = simhash.masks(radius)
        for _ in range(3000):
            x = sum(1 << i for i in random.sample(range(64), radius))
            assert any(x & m == 0 for m in tables)
            for m in tables:
                if x & m == 0:
                    assert any(x & p == 0 for p in simhash.parts(m, radius))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_near_duplicates(spark, bucket):
    docs = [(d, t) for d, t, *_ in table()] + [(900, None), (901, ""), (902, "One two"), (903, "one  TWO")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(df, bucket=bucket).select("row.doc_id", "fp", "component_id").collect()]
    want = brute.near(docs)
    assert sum(c != d for d, _, c in want) > 5
    assert sorted(got) == sorted(want)


def test_near_links_connect_all_pairs(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(63) for _ in range(40)}
    for f in list(fps):
        for _ in range(12):
            for i in rng.sample(range(63), rng.randint(1, 3)):
                f ^= 1 << i
            fps.add(f)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (simhash.BUCKET, 3):
        label = {f: f for f in fps}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for r in simhash.near_links(df, bucket=bucket).select(F.col("a"), F.col("b")).collect():
            label[root(r["a"])] = root(r["b"])
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3:
                    assert root(a) == root(b)


def test_near_duplicates_odd(odd):
    got = simhash.near_duplicates(odd).select("row.doc_id", "fp", "component_id").collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# personal data

TRICKY = [
    "a@b.c_d@e.f x@y.z.",
    "a.b@c-d.e-f.g@h.i",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 9" + ".9" * 9,
    "4111 1111-1111 1111 41111111111111112 0000000000000",
    "+1 (555) 010-9999+44 20 7946 0958 ++1234567890 +12",
    "é😀 me@x.yz 😀 10.0.0.1 e" + "@" * 5,
    "12 34" * 300 + " q@r.s" * 700,
    "1234" * 30000 + "@a.b",
    "a" * 50000 + "@@" + ".a" * 20000,
    "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE00370400440532013000",
]


def test_pii(spark):
    docs = [(d, t) for d, t, *_ in table()] + list(enumerate(TRICKY, 5000)) + [(6000, None), (6000, None), (6001, "")]
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("pii_docs")
    found = pii.find_pii(spark.table("pii_docs")).collect()
    base = {k.name for k in pii.KINDS if k.base}
    for r in found:
        want, _ = brute.pii(r["row"]["text"])
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in base] == want
        assert all((r["row"]["text"] or "")[s["start"] : s["end"]] == s["found"] for s in r["spans"])
    assert [s["found"][:4] for r in found if r["row"]["doc_id"] == 5009 for s in r["spans"] if s["kind"] == "iban"] == ["DE89", "GB82"]
    got = rows(queries.op8_pii(spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for d, t, *_ in table():
        spans, n = brute.pii(t)
        want.append((d, n["email"], n["ip"], n["card"], n["phone"], brute.sha(",".join(spans))))
    assert got == sorted(want, key=repr)


def test_pii_context(spark):
    got = pii.find_pii(spark.createDataFrame([("mail me: a@b.cd",), ("zzz a@b.cd",)], "text string")).select("spans.score").collect()
    assert got[0][0][0] > got[1][0][0]


def test_pii_secrets_need_context(spark):
    drawn = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'x token = "{drawn}" y', f"see {drawn} there", "password: " + "a" * 40, "api key AKIA/1b2c3d4e5f6g7h8i9== and", f"token {'-' * 60} {drawn}", f"SECRET={drawn}", None, ""]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    found = {r["row"]["i"]: [(s["kind"], s["found"], round(s["score"], 2)) for s in r["spans"] if s["kind"] == "secret"] for r in got}
    assert found[0] == found[5] == [("secret", drawn, 0.7)] and found[3] == [("secret", "AKIA/1b2c3d4e5f6g7h8i9==", 0.7)]
    assert not any(found[i] for i in (1, 2, 4, 6, 7))


def test_pii_query_has_the_scores(spark):
    """Each span's score in the query's result, against the context before it."""
    text = {d: t for d, t, *_ in table()}
    kinds = {k.name: k for k in pii.KINDS}
    import re

    n = 0
    for r in queries.op8_pii(spark, SF).collect():
        spans = [s.split(":") for s in r["spans"].split(",")] if r["spans"] else []
        for (kind, a, _), score in zip(spans, r["scores"].split(","), strict=bool(spans)):
            k, near = kinds[kind], text[r["doc_id"]][max(0, int(a) - pii.CONTEXT) : int(a)]
            assert int(score) == round(100 * (k.prior + pii.CONTEXT_GAIN * bool(re.search(k.context, near)))) >= 100 * k.least
            n += 1
    assert n > 10


def test_pii_odd(odd):
    assert pii.find_pii(odd).count() == len(ODD)
    assert pii.find_pii(odd.limit(0)).count() == 0


# media


def test_media(spark):
    got = {r["doc_id"]: r for r in queries.op9_avi_media(spark, SF).collect()}
    for d, t, *_ in table():
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_frames_decode_alike():
    """The table-driven decoder reads any baseline frame; on ours it must agree with the bit matrix."""
    import numpy as np

    samples = np.random.default_rng(1).integers(0, 256, (3, avi.SAMPLES), dtype=np.uint8)
    frames = avi.encode_frames(samples)
    assert (avi.decode_samples(frames) == samples).all()
    for f, s in zip(frames, samples):
        picture = avi.decode_frame(f)
        assert picture.shape == (avi.DOWN * 8, avi.ACROSS * 8)
        assert (picture.reshape(avi.DOWN, 8, avi.ACROSS, 8) == s.reshape(avi.DOWN, 1, avi.ACROSS, 1)).all()
    # a foreign header: the same tables in another order
    other = frames[0].replace(avi._HEAD[2:71], b"", 1)
    other = other[:2] + avi._segment(0xFE, b"note") + avi._HEAD[2:71] + other[2:]
    assert (avi.decode_samples([other, frames[1]]) == samples[:2]).all()


def _jpeg(width, height, sampling, restart=0, own_tables=False, seed=1):
    """A small encoder for the tests: a colour JPEG with the usual tables, and the luma that a decoder should give."""
    import numpy as np

    rng = np.random.default_rng(seed)
    h, v = sampling
    q = np.array([3 + i // 4 for i in range(64)])
    code_of = {}
    for t, (counts, values) in avi.USUAL_TABLES.items():
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                code_of[t, values[k]] = f"{code:0{length}b}"
                code, k = code + 1, k + 1
            code <<= 1
    number = lambda x, n: f"{x if x > 0 else x + (1 << n) - 1:0{n}b}" if n else ""
    cols, rows = -(-width // (8 * h)), -(-height // (8 * v))
    luma = np.zeros((rows * v * 8, cols * h * 8))
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
    out, bits, last = b"", "", {}

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return data

    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            last = {}
        for c, n in ((0, h * v), (1, 1), (2, 1)):
            for block in range(n):
                zz = np.zeros(64, int)
                zz[0] = rng.integers(-60, 60)
                for k in rng.choice(np.arange(1, 64), 5, replace=False):
                    zz[k] = rng.integers(-6, 7)
                t, diff = min(c, 1), int(zz[0] - last.get(c, 0))
                last[c] = int(zz[0])
                size = abs(diff).bit_length()
                bits += code_of[t, size] + number(diff, size)
                run = 0
                for k in range(1, 64):
                    if zz[k] == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits += code_of[0x10 | t, 0xF0]
                        run -= 16
                    size = abs(int(zz[k])).bit_length()
                    bits += code_of[0x10 | t, run << 4 | size] + number(int(zz[k]), size)
                    run = 0
                if run:
                    bits += code_of[0x10 | t, 0]
                if c == 0:
                    grid = np.zeros(64)
                    grid[avi._ZIGZAG] = zz * q
                    y, x = unit // cols * v + block // h, unit % cols * h + block % h
                    luma[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = cos @ grid.reshape(8, 8) @ cos.T
    out += flush()
    size = avi.struct.pack(">BHHB", 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(avi._segment(0xC4, bytes([t, *counts, *values])) for t, (counts, values) in avi.USUAL_TABLES.items()) if own_tables else b""
    head = b"\xff\xd8" + avi._segment(0xDB, bytes([0, *q])) + avi._segment(0xC0, size) + tables + (avi._segment(0xDD, avi.struct.pack(">H", restart)) if restart else b"")
    data = head + avi._segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + out + b"\xff\xd9"
    return data, np.clip(np.rint(luma + 128), 0, 255).astype(np.uint8)[:height, :width]


@pytest.mark.parametrize("width,height,sampling,restart,own", [(64, 48, (1, 1), 0, True), (50, 37, (2, 2), 0, False), (40, 24, (2, 1), 0, False), (48, 32, (2, 2), 2, False)])
def test_camera_frames(spark, width, height, sampling, restart, own):
    """Colour frames of any size: 4:4:4, 4:2:0 and 4:2:2, with and without tables and restart intervals; and a file of them."""
    import numpy as np

    assert [len(t[1]) for t in avi.USUAL_TABLES.values()] == [sum(t[0]) for t in avi.USUAL_TABLES.values()]
    frames = [_jpeg(width, height, sampling, restart, own, seed) for seed in (1, 2, 3)]
    for frame, luma in frames:
        assert (avi.decode_frame(frame) == luma).all()
    ours = avi.write_avi(np.zeros((3, avi.SAMPLES), np.uint8))
    fps, own_frames = avi.read_avi(ours)
    assert [len(x) for x in avi.decode_frames([own_frames[0], frames[0][0]])] == [avi.SAMPLES, width * height]
    assert avi.shots([luma.ravel() for _, luma in frames])[0][0] == 0


def test_foreign_file(spark):
    """A file of 64 x 48 frames: its luma and its cut, where the level jumps."""
    import numpy as np

    flat = {level: _jpeg(64, 48, (2, 2), seed=level) for level in (5, 6)}
    frames = [flat[5][0]] * 12 + [flat[6][0]] * 9
    chunk = lambda name, body: avi.struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avi.struct.pack("<14I", 40_000, *[0] * 13)))
    data = chunk(b"RIFF", b"AVI " + head + movi)
    got = avi.read_media(spark.createDataFrame([(bytearray(data),)], "media binary")).first()
    assert got["error"] is None and got["fps"] == 25 and len(got["samples"]) == 21 * 64 * 48
    assert bytes(got["samples"][: 64 * 48]) == flat[5][1].tobytes()
    assert np.abs(np.diff([np.histogram(flat[k][1], 16)[0] for k in (5, 6)], axis=0)).sum() // 2 > 64 * 48 // 16
    assert [(c["begin_s"], c["frames"]) for c in got["clips"]] == [(0.0, 12), (0.48, 9)]


def test_media_digests_are_of_the_file(spark):
    """Stored bytes, their digest and the feature of the query, against files that are written, decoded frame by frame and cut one after the other."""
    import numpy as np

    got = {r["doc_id"]: r for r in queries.op9_avi_media(spark, SF).collect()}
    for d, t, *_ in sorted(table(), key=lambda r: len(r[1] or ""))[:60:6]:
        media = avi.write_avi(np.frombuffer(avi.payload((t or "").encode()), np.uint8).reshape(-1, avi.SAMPLES))
        frames = avi.read_avi(media)[1]
        levels = [avi.decode_frame(f)[::8, ::8].ravel() for f in frames]
        diffs = [sum(abs(int(a) - int(b)) for a, b in zip(np.histogram(x, 16, (0, 256))[0], np.histogram(y, 16, (0, 256))[0])) // 2 for x, y in zip(levels, levels[1:])]
        cuts = [0]
        for i, x in enumerate(diffs):
            near = diffs[max(0, i - avi.AROUND) : i] + diffs[i + 1 : i + 1 + avi.AROUND]
            mean = sum(near) / max(1, len(near))
            spread = max(0, sum(y * y for y in near) / max(1, len(near)) - mean * mean) ** 0.5
            cuts += [i + 1] if x > mean + avi.DEVIATIONS * spread and x > avi.SAMPLES // 16 else []
        r = got[d]
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == ";".join(f"{a}-{b}" for a, b in zip(cuts, [*cuts[1:], len(frames)]))


def test_avi_reads_back():
    import numpy as np

    samples = np.zeros((40, avi.SAMPLES), np.uint8)
    samples[20:] = 200
    samples[::3, :4] = 90
    data = avi.write_avi(samples)
    fps, frames = avi.read_avi(data)
    assert fps == avi.FPS and len(frames) == 40
    assert avi.shots(avi.decode_samples(frames)) == [(0, 20), (20, 40)]
    cut = data.replace(b"idx1", b"JUNK")
    assert avi.read_avi(cut)[1] == frames
    with pytest.raises(avi.AviError):
        avi.read_avi(data[:100])


def test_media_rows(odd, spark):
    media = avi.with_media(odd)
    read = avi.read_media(media)
    assert media.count() == read.count() == len(ODD)
    clips = avi.clips(read).collect()
    assert all(c["end_s"] > c["begin_s"] for c in clips)
    bad = avi.read_media(spark.createDataFrame([(b"RIFFxx",), (None,)], "media binary")).collect()
    assert [r["samples"] for r in bad] == [None, None] and all(r["error"] for r in bad)
    assert avi.media_digest(odd).count() == len(ODD)
    assert avi.media_digest(odd.limit(0)).count() == 0


# language models


@pytest.mark.parametrize("heavy", [ppm.HEAVY, 50])
def test_unigram(spark, heavy):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(ppm.score(docs, queries._fold(7) == 2, heavy=heavy).collect(), key=lambda r: r["doc_id"])
    for r, w in zip(got, sorted(brute.unigram([(d, t) for d, t, *_ in table()])), strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:5]
        assert r["base_score"] == pytest.approx(w[5], rel=1e-9)
        assert r["score"] < 0
    bits = -sum(r["score"] for r in got if r["held_out"]) / sum(len((t or "").encode()) + 1 for d, t, *_ in table() if brute.fold(d, 7) == 2)
    assert bits * 3.3219 < 3.2  # a byte of held-out text costs under 3.2 bits


def _plain_ppm(grams, context, s):
    """Method C with exclusion over nested counts {(context, byte): n}, one byte."""
    p, excluded = 1.0, set()
    for k in range(len(context), -1, -1):
        c = context[len(context) - k :]
        free = {x: n for (d, x), n in grams.items() if d == c and x not in excluded}
        if not free:
            continue
        whole = sum(free.values()) + len(free)
        if s in free:
            return p * free[s] / whole
        p *= len(free) / whole
        excluded |= free.keys()
    return p / (256 - len(excluded))


def test_table_is_ppm(spark):
    import numpy as np

    texts = ["abracadabra", "abba", "cadabra cab", "é"]
    counts = ppm.count(spark.createDataFrame([(t,) for t in texts], "text string"))
    model = ppm.train(counts)
    grams = {}
    for t in texts:
        data = ppm.EDGE * 3 + t.encode() + ppm.EDGE
        for i in range(3, len(data)):
            for k in range(4):
                key = data[i - k : i], data[i]
                grams[key] = grams.get(key, 0) + 1
    for t in ["abracab", "zzz", "", "bé cad"]:
        data = ppm.EDGE * 3 + t.encode() + ppm.EDGE
        want = sum(np.log10(_plain_ppm(grams, data[i - 3 : i], data[i])) for i in range(3, len(data)))
        assert model.score([t.encode()])[0] == pytest.approx(want, rel=1e-5)
    # the probabilities of all bytes after a context add up to one
    whole = sum(10 ** float(model.log[model.row[0], model.of[b]]) for b in range(256))
    assert whole == pytest.approx(1, rel=1e-5)


@pytest.mark.parametrize("grams", [1 << 20, 16, 0])
def test_ppm_scores_by_all_contexts(spark, grams):
    """A script that is a millionth of the bytes still scores by its own contexts, as in the table of all counts, whatever is joined."""
    texts = [(i, "the cat sat on the mat " * 9000 if i % 3 else "a rather short one") for i in range(24)] + [(90 + i, "ქართული ენა") for i in range(2)] + [(95, "ქართული"), (96, "zq\u0416 the"), (97, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    from pyspark.sql import functions as F

    held = F.col("doc_id").isin(3, 95, 96, 97)
    model = ppm.train(ppm.count(docs.where(~held)))
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, held, grams=grams).collect()}
    for d, t in texts:
        assert got[d] == pytest.approx(model.score([t.encode()])[0], rel=1e-4)
    assert got[95] > -20  # 22 bytes and the end; -53 if each were as likely as any


def test_ppm_odd(odd, spark):
    from pyspark.sql import functions as F

    got = ppm.score(odd, F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r["n_tokens"] == r["n_known"] for r in got)
    none = ppm.score(odd, F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in none} == {(0, 0, 0.0)}
    assert none[0]["score"] == pytest.approx(-len(ODD[0][1] + "$") * 2.408239965, rel=1e-5) or len(none) == len(ODD)
    assert ppm.score(odd.limit(0), F.lit(False)).count() == 0
    adaptive = ppm.score_adaptive(odd.limit(4)).collect()
    assert len(adaptive) == 4 and all(r["score"] < 0 for r in adaptive)
    assert ppm.adaptive(b"abab" * 50) > 2.5 * ppm.adaptive(b"abab" * 10)  # repeats get cheaper
