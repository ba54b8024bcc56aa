"""Substring dedup, licence scans and the pipeline against plain versions."""

import math
import random

import brute
import duckdb
import pytest
from test_operators import ODD, SF, odd, rows  # noqa: F401

import corpus_pipeline
from cloudloom.llm import decontam, langid, licenses, queries, simhash, substring


def docs_of(spark, n=None):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:n]


def test_substrings_on_the_table(spark):
    want = brute.substrings(docs_of(spark))
    assert sum(r[2] for r in want) > 0
    assert rows(queries.op6_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def _passages(seed, window):
    """Texts over few words, with shared passages, periods, copies, repeated ids and nulls."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["é", "W1"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(4)]
    out = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 2 * window))]
        if rng.random() < 0.1:
            words = ["a", "b"] * (2 * window)
        out.append((rng.choice([i, i, i, 3, None]), rng.choice([" ", "\n", " \t"]).join(words)))
    return [*out, out[5], (70, None), (71, ""), (72, out[7][1])]


@pytest.mark.parametrize("most_group,chunk_bytes,sent,prefixes", [(2048, 1 << 22, 1 << 20, (3, 5)), (512, 300, 0, (3,)), (20, 300, 1 << 20, (3, 5)), (2, 300, 0, (3, 5))])
def test_substrings_against_brute_force(spark, most_group, chunk_bytes, sent, prefixes):
    """With groups that fit, and with groups that are split once, twice and down to single nodes, their prefixes sent or joined."""
    for seed in (1, 2)[: 1 if sent else 2]:
        docs = _passages(seed, 8)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = substring.dedup_substrings(df, window=8, prefixes=prefixes, most_group=most_group, sent=sent, chunk_bytes=chunk_bytes)
        from pyspark.sql import functions as F

        found = rows(got.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")), "doc_id", "n_words", "n_removed", "s")
        want = brute.substrings(docs, 8)
        assert sum(r[2] for r in want) > 100
        assert found == sorted(want, key=repr)


def test_deep_nodes():
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(rng.randint(9, 40))] for _ in range(30)]
    runs = [len(t) - 6 for t in texts]
    import numpy as np

    node, text = substring.deep_nodes([" ".join(t).encode() for t in texts], np.array(runs), 7)
    starts = [(i, s) for i, r in enumerate(runs) for s in range(r)]
    assert text.tolist() == [i for i, _ in starts]
    seen = {}
    for n, (i, s) in zip(node.tolist(), starts):
        seen.setdefault(tuple(texts[i][s : s + 7]), set()).add(n)
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_suffix_array_and_lcp():
    import numpy as np

    rng = random.Random(6)
    texts = [[rng.choice("abc") for _ in range(rng.randint(11, 60))] for _ in range(20)]
    for window in (1, 2, 5, 11):
        runs = np.array([len(t) - window + 1 for t in texts])
        order, lcp, text = substring.suffix_array([" ".join(t).encode() for t in texts], runs, window)
        suffixes = [t[s : s + window] for t, r in zip(texts, runs) for s in range(r)]
        assert sorted(order.tolist()) == list(range(len(suffixes))) and len(text) == len(suffixes)
        for k in range(1, len(order)):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert lcp[k] == next((i for i in range(window) if a[i] != b[i]), window)
        # suffixes with a common beginning of any length stand together
        for n in range(1, window + 1):
            blocks = 1 + int((lcp[1:] < n).sum())
            assert blocks == len({tuple(x[:n]) for x in suffixes})


def test_substrings_odd(odd):  # noqa: F811
    assert substring.dedup_substrings(odd).count() == len(ODD)
    few = substring.dedup_substrings(odd, window=2, prefixes=(1,), most_group=2)
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["kept_text"], [tuple(x) for x in r["removed"]]) for r in few.collect()}
    assert got[2, None] == got[3, ""] == ("", []) and got[1, "a b c a b c"] == ("a b c a b c", [])
    assert substring.dedup_substrings(odd.limit(0)).count() == 0


# licences


def _cosine(a, b, idf, other):
    va, vb = ({t: (1 + math.log(c)) * idf.get(t, other) for t, c in licenses.tokens(x).items()} for x in (a, b))
    dot = sum(x * vb.get(t, 0) for t, x in va.items())
    return dot / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values())) if va and vb else 0.0


def test_license_cosines(spark):
    """Each file's best cosine against a plain computation over all its headers, with corpus-wide frequencies."""
    files = [(f"d/{i}", t) for i, t in enumerate(["x\nReleased under the MIT License.\ny", "Licensed under CC BY-NC 4.0.", "nothing", None, "", "Some other license text that nobody knows of at all"] * 2)]
    got = licenses.detect(spark.createDataFrame(files, "path string, text string")).collect()
    headers = [licenses.header(t) for _, t in files]
    n = sum(bool(h) for h in headers)
    vocabulary = {t for _, x in licenses.TEMPLATES for t in licenses.tokens(x)}
    idf = {t: 1 + math.log((1 + n) / (1 + sum(t in licenses.tokens(h) for h in headers))) for t in vocabulary}
    for r, h in zip(got, headers):
        want = max([_cosine(x, t, idf, 1 + math.log(1 + n)) for x in [h, *h.split("\n")] for _, t in licenses.TEMPLATES])
        assert r["cosine"] == pytest.approx(want, abs=1e-12)
    assert [r["detected"] for r in got][:6] == ["MIT", "CC-BY-NC-4.0", None, None, None, None]


@pytest.mark.parametrize("common", [licenses.COMMON, 0])
def test_license_beside_a_holder(spark, common):
    """A notice that shares its line with a holder's name is found however many headers there are, with the frequencies of all words."""
    notice = "Copyright (c) {} {}. Released under the MIT License."
    files = [(f"d/{i}", notice.format(1990 + i % 30, f"holder{i}") if i % 2 else "The licensing office of town is closed.") for i in range(600)]
    files += [("e/1", "Copyright 2020 Foo Bar Inc., licensed under the GNU General Public License, version 3"), ("e/2", "All rights reserved. Copyright (c) 2001 Foo Bar."), ("e/3", None)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r["row"]["path"]: (r["detected"], r["cosine"]) for r in licenses.detect_all(df, common=common).collect()}
    assert len(got) == len(files)
    assert {got[f"d/{i}"][0] for i in range(1, 600, 2)} == {"MIT"} and {got[f"d/{i}"][0] for i in range(0, 600, 2)} == {None}
    assert (got["e/1"][0], got["e/2"][0], got["e/3"]) == ("GPL-3.0", None, (None, 0.0))
    scanned = {r["row"]["path"]: r["detected"] for r in licenses.scan_licenses(df, hot=3).collect()}
    assert scanned == {p: d for p, (d, _) in got.items()}
    headers = [h for _, t in files if (h := licenses.header(t))]
    df_ = {}
    for h in headers:
        for t in licenses.tokens(h):
            df_[t] = df_.get(t, 0) + 1
    match = licenses.Matcher(df_, len(headers))
    for p, t in files:
        if t:
            assert got[p][1] == pytest.approx(max(match(x)[1] for x in licenses.compared(t, False)), abs=1e-12)


def test_whole_license_texts_are_named(spark):
    """Whole texts as licence files, as comments in code, and with a holder's name; those of the system's folder where it has them."""
    import os

    year = "Copyright (c) 2021, Jane Doe and the Foo Authors. All rights reserved.\n\n"
    clause = licenses._BSD_TWO.replace(" 2. ", "\n\n2. ")
    texts = {
        "MIT": f"MIT License\n\n{year}{licenses._MIT_GRANT}\n\n{licenses._MIT_AS_IS}",
        "BSD-2-Clause": f"{year}{licenses._BSD_HEAD}\n\n{clause}\n\n{licenses._AS_IS_BSD}",
        "BSD-3-Clause": f"{year}{licenses._BSD_HEAD}\n\n{clause}\n\n{licenses._BSD_THIRD}\n\n{licenses._AS_IS_BSD}",
        "ISC": f"{year}{licenses._ISC_GRANT}\n\n{licenses._ISC_AS_IS}",
    }
    files = [(f"{n}/LICENSE", t) for n, t in texts.items()]
    files += [(f"{n}/code.c", "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\n\nint main() {\n  return 0;\n}\n" + "\n\nint f();" * 50) for n, t in texts.items()]
    files += [("MIT/short.txt", year + licenses._MIT_GRANT), ("BSD-2-Clause/short.txt", f"{year}{licenses._BSD_HEAD}\n\n{clause}")]
    for name, file in {"GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}.items():
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            files.append((f"{name}/COPYING", open(path, encoding="utf-8").read()))
    got = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()
    assert {r["row"]["path"]: r["detected"] for r in got} == {p: p.split("/")[0] for p, _ in files}


def test_license_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("LICENSE", mit), ("a/x.c", "code"), ("a/b/COPYING", gpl), ("a/b/c/y.c", "code"), ("a/b/z.c", mit), ("w.c", None), (None, "t"), ("a/x.c", "code")]
    got = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string"), hot=3).collect()
    found = {r["row"]["path"]: (r["license"], r["how"], r["from_dir"]) for r in got}
    assert len(got) == len(files)
    assert found["a/x.c"] == ("MIT", "directory", "") and found["a/b/c/y.c"] == ("GPL-3.0", "directory", "a/b")
    assert found["a/b/z.c"] == ("MIT", "header", None) and found["w.c"] == ("MIT", "directory", "") and found[None] == (None, None, None)


def test_license_query_against_plain_inheritance(spark):
    got = queries.op5_license_scan(spark, SF).collect()
    own = {r["path"]: r["detected"] for r in got}
    text = dict(docs_of(spark))
    assert all((r["detected"] is not None) == ("icense" in (text[r["doc_id"]] or "")) for r in got)
    by_dir = {}
    for p, d in own.items():
        folder, name = p.rsplit("/", 1)
        if d and name.startswith("LICENSE"):
            by_dir.setdefault(folder, []).append((next(r["cosine"] for r in got if r["path"] == p), d))
    for r in got:
        steps = r["path"].split("/")[:-1]
        above = ["/".join(steps[:i]) for i in range(len(steps), -1, -1)]
        want = r["detected"] or next((max(by_dir[a])[1] for a in above if a in by_dir), None)
        assert r["license"] == want


def test_licenses_odd(odd, spark):  # noqa: F811
    from pyspark.sql import functions as F

    df = odd.withColumn("path", F.concat_ws("/", "source", F.lit("f")))
    assert licenses.scan_licenses(df).count() == len(ODD)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


# pipeline


def test_pipeline_against_plain_stages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    profiles = langid.learn_profiles(spark.read.parquet(f"{SF}/documents.parquet"))
    classify = langid.Classifier(profiles)
    kept = [d for d in docs if (p := classify(d[1]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SIMILARITY]
    pages, seen = {}, {}
    for _, t, s in kept:
        pages[s] = pages.get(s, 0) + 1
        for x in {x.strip(" ") for x in t.split("\n") if x.strip(" ")}:
            seen[s, x] = seen.get((s, x), 0) + 1
    bad = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    kept = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad), s) for d, t, s in kept]
    component = brute.similar([r[:2] for r in kept])
    kept = [r for r in kept if component[r[0]] == r[0]]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    dirty = {r[0] for r in brute.contamination([r[:2] for r in kept], items) if r[5]}
    kept = [r for r in kept if r[0] not in dirty]
    assert 0 < len(kept) < len(docs) and dirty
    sizes = {}
    for _, t, s in kept:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t))
    got = corpus_pipeline.run(spark, SF).collect()
    text = {r[0]: r[1] for r in kept}
    assert len({r["doc_id"] for r in got}) == len(got) and all(text[r["doc_id"]] == r["text"] for r in got)
    for s, t in brute.targets(sizes).items():
        assert sum(r["taken"] for r in got if r["source"] == s) == int(t + 1e-9)
    at = [r["position"] for r in got]
    assert at == sorted(at)


def test_language_stage_rejects_other_languages_and_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rnd = random.Random(5)
    junk = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)) for n in (30, 300)]
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    ]
    long = [r["text"].split() for r in docs.where("text is not null and lang = 'en'").orderBy("doc_id").limit(40).collect()]
    clean = [" ".join(w[i : i + n]) for w in long for i, n in ((0, 5), (3, 12)) if len(w) >= 20]
    assert clean
    more = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate([*junk, *other, *clean])]
    added = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    columns = added.columns
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.select(columns).unionByName(added), SF).collect()}
    bad = len(junk) + len(other)
    assert not got & {10**9 + i for i in range(bad)}
    assert {10**9 + bad + i for i in range(len(clean))} <= got


def test_pipeline_stages_take_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 19), (1, "the cat and the dog", "en", "s", 19), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "le chat et le chien", None, "t", 19)], schema)
    spark.createDataFrame([(1, "zzz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (odd, odd.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, table, str(tmp_path))
            assert i == 4 or got.columns == odd.columns, name
            got.collect()
    assert corpus_pipeline.dedup_near(spark, odd, "").where("doc_id = 1").count() == 1


def test_pipeline_stages_take_clashing_columns(spark, tmp_path):
    """Documents with columns named as what the stages add, written and read again."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 19), (2, "a dog and two cats", "en", None, 18)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(7).alias(c) for c in ("size", "Position", "taken", "row", "t", "src", "name", "slot", "t1", "key", "rid", "host", "keys", "score", "leader", "items", "mix_size", "n_words")])
    spark.createDataFrame([(1, "zzz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 2 and {"mix_mix_size", "mix_position", "mix_taken", "copies"} <= set(docs.columns)
    assert docs.select("size", "Position", "taken", "mix_size").distinct().collect() == [(7, 7, 7, 7)]


def test_stage_operators_are_those_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]
    assert (simhash.RADIUS, decontam.WINDOW) == (3, 13)
