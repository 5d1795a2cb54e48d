"""The corpus operators against SQL or brute force, on the smallest tables and on rows that are meant to break them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from oracle import answer, rows
from pyspark.sql import functions as F

from murmurlake.llm import common, decontaminate, embeddings, language, licenses, lines, minhash, mixing, registry, substrings, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, size long, score double, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, white space, no letters, columns with clashing names."""
    p = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n ", p, p, "x " + p + " y", "aaaa " * 200, "one", "one two", "!!! 123 $$", "é ü Ünï", "A" * 5000, p.upper(), "the cat " * 3000, "line one two\nline one two\nother here now"]
    out = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 0, "l", 1, 0.5, "z") for i, t in enumerate(texts)]
    out += [out[3], (7, "another text under the same id", "en", "s1", 0, "l", 1, 0.5, "z"), (None, p, "en", "s1", 0, "l", 1, 0.5, "z")]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near(got, want, digits=6):
    got, want = got.copy(), want.copy()
    for d in (got, want):
        for c in d.columns:
            if d[c].dtype.kind == "f":
                d[c] = d[c].round(digits)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_and_sql(spark, sf, name):
    near(registry.QUERIES[name](spark, sf).toPandas(), answer(registry.SQL[name], sf))


def _own(odd):
    return odd.where("doc_id IS NOT NULL AND NOT (doc_id = 7 AND n_chars = 0 AND text LIKE 'another%')").dropDuplicates()


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op8_minhash_near_dedup", "op9_mix_sources"])
def test_sql_on_odd_rows(spark, odd, name):
    d = _own(odd)
    want = answer(registry.SQL[name], "/root/testdata/sf0.001", documents=d.toPandas())
    got = {"op1_substring_dedup": lambda: substrings.remove_repeats(d).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_runs"), "op8_minhash_near_dedup": lambda: minhash.near_duplicates(d, 85, 3).withColumn("kept", F.col("doc_id") == F.col("component_id")), "op9_mix_sources": lambda: mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken")}[name]()
    near(got.toPandas(), want)


def test_decontamination_on_odd_rows(spark, odd):
    b = spark.createDataFrame([(1, "W5 w6, w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, "one two"), (3, None), (4, "!!"), (10, "one two")], "item_id long, text string")
    d = _own(odd)
    got = decontaminate.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near").toPandas()
    near(got, answer(decontaminate.SQL, "/root/testdata/sf0.001", documents=d.toPandas(), benchmark=b.toPandas()))
    assert got.loc[got.doc_id == 8, "n_hit"].item() == 2
    near_ = decontaminate.contamination(spark.createDataFrame([(1, "w5 w6 w7 zz w8 w9 w10 w11 w12 w13 w14 w15")], "doc_id long, text string"), b).first()
    assert near_["n_hit"] == 0 and near_["n_near"] > 0


@pytest.mark.parametrize("table", ["odd", "none"])
def test_every_operator_takes_odd_rows(spark, request, table):
    d = request.getfixturevalue(table)
    n = d.where("doc_id IS NOT NULL").count()
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    counts = {
        "1": substrings.remove_repeats(d), "2": toxicity.score(d, labels), "3": lines.dedup_lines(d), "4": licenses.scan(d), "5": language.identify(d.where("doc_id IS NOT NULL").select("doc_id", "text"), ["doc_id", "text"], language.training_rows(d)),
        "6": suffixes.remove_repeats(d), "7": decontaminate.contamination(d, bench), "8": minhash.near_duplicates(d), "9": mixing.mix(d),
    }
    for k, x in counts.items():
        assert x.count() == n, k
    assert mixing.mix(d, keep=("doc_id", "text", "source", "label")).count() == n
    scores = {}
    for r in counts["2"].join(d.select("doc_id", "text").distinct(), "doc_id").collect():
        assert 0 <= r["score"] <= 1
        scores.setdefault(r["text"] or "", set()).add(round(r["score"], 9))
    assert all(len(scores.get(t, {0})) == 1 for t in ("", "one two"))  # doc_id 7 has two texts
    for r in counts["5"].collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0) if not any(c.isalpha() for c in r["text"] or "") else r["lang_pred"] == "en"
    sizes = {(r["doc_id"], r["size"]) for r in counts["9"].collect()}
    assert sizes == {(r["doc_id"], len((r["text"] or "").encode().split())) for r in d.where("doc_id IS NOT NULL").collect()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in counts["9"].collect())


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(500):
        t = [*rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)).tolist(), 0]
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def suffix_brute(rows_, length=50):
    out, seen = [], set()
    by_id = {}
    for i, t in sorted(rows_):
        by_id.setdefault(i, []).append(t)
    for i, texts in sorted(by_id.items()):
        own = set()
        for t in texts:
            b = (t or "").encode()
            gone = [False] * len(b)
            for p in range(len(b) - length + 1):
                if b[p : p + length] in seen:
                    gone[p : p + length] = [True] * length
                own.add(b[p : p + length])
            spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
            out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
        seen |= own
    return sorted(out)


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffix_dedup(spark, sf, odd, hot):
    for d in (spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80"), odd):
        d = d.where("doc_id IS NOT NULL").select("doc_id", "text")
        got = suffixes.remove_repeats(d, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == suffix_brute([(r[0], r[1] or "") for r in d.collect()])


def test_substrings_whatever_the_buckets(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, substrings.remove_repeats(d, buckets=n).collect())) for n in (1, 37))
    assert a == b


def test_line_templates(spark):
    docs = [(i, f"Own words {chr(97 + i) * 5} {chr(98 + i) * 3} {chr(99 + i) * 4} here\nPosted by user {i} at 12:{i:02d} today\nab cd") for i in range(8)]
    docs += [(100 + i, "Copied line of one text only\nand another of it") for i in range(20)] + [(200, None), (201, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(d).collect()}
    assert "Posted" in got[0]["text"] and all("Posted" not in got[i]["text"] and got[i]["n_dropped"] == 1 and "ab cd" in got[i]["text"] for i in range(1, 8))
    assert all(got[100 + i]["n_dropped"] == 0 for i in range(20))
    assert got[200]["text"] is None and got[200]["n_lines"] == 0 and got[201]["text"] == ""
    assert sum(r["n_dropped"] for r in lines.dedup_lines(d, min_texts=9).collect()) == 0


def license_brute(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    places, labels = [], set()
    for p, label in licenses.BASE.items():
        q = p.encode().split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, sf, odd):
    extra = spark.createDataFrame([(900, "x All rights reserved. cc by cc BY"), (901, "y licensed under the very Apache license version 2.0 z"), (902, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files to deal in the software without restriction")], "doc_id long, text string")
    for d in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), extra, odd.where("doc_id IS NOT NULL AND doc_id <> 7").dropDuplicates().select("doc_id", "text")):
        text = {r[0]: r[1] for r in d.collect()}
        for r in licenses.scan(d).collect():
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_brute(text[r["doc_id"]])
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = {r["doc_id"]: r for r in licenses.scan(extra).collect()}
    assert got[900]["n_base"] == 3 and "mit" in got[902]["labels"] and "apache-2.0" in got[901]["labels"]


def test_language(spark, sf):
    d = language.op5_language_id(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]])
    assert (d["held_out"] == d["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = d[d["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    x = language.Lattice([b"a", b"b", b"ab", b" ", b" a"])
    theta = np.array([[0.1], [0.2], [0.3], [0.15], [0.25]])
    p = np.exp(x.forward(np.frombuffer(b" ab", np.uint8)[None], np.array([3]), theta))[0, 0]
    assert math.isclose(p, 0.15 * 0.1 * 0.2 + 0.15 * 0.3 + 0.25 * 0.2)
    odd = language.identify(spark.createDataFrame([(1, None), (2, "12 !!"), (3, "—")], "doc_id long, text string"), ["doc_id"], language.training_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    assert {(r["lang_pred"], r["score"]) for r in odd.collect()} == {("und", 0.0)}


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    plain, bad = [f"wo{a}{b}" for a in "abcdefgh" for b in "xyz"], ["vileful", "vilest", "grossly"]
    docs = []
    for i in range(600):
        w = rng.choice(plain, 40).tolist()
        if i % 4 == 0:
            w[3], w[20], w[31] = rng.choice(bad, 3)
        docs.append((i, " ".join(w), int(i % 4 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    got = toxicity.score(d.select("doc_id", "text"), d.select("doc_id", "toxic")).toPandas().merge(d.toPandas()[["doc_id", "toxic"]])
    held = got[got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean() > 0.97 and got["score"].between(0, 1).all()
    grams = toxicity.order_of(np.array([1, 0x161, 0x16162], np.uint64))
    assert grams.tolist() == [0, 1, 2] and toxicity.suffix(np.array([0x16162], np.uint64), np.array([2]))[0] == 0x162


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(base[:300]), np.unique(np.concatenate([base[:270], base[300:330]])), np.unique(base[:1]), base[:0]]
    s = minhash.sketches(sets)
    assert (s[:3] != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 270 / 330) < 0.12
    assert np.array_equal(minhash.sketches(sets[:1])[0], s[0])
    odd = minhash.parities(sets[:2])
    assert np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum() <= 60


def test_near_duplicates_through_chains(spark):
    w = [f"t{i}" for i in range(400)]
    docs = [(k, " ".join(w[:k * 12] and [f"n{j}" for j in range(k * 12)] + w[k * 12 :])) for k in range(6)] + [(50 + k, " ".join(w)) for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = answer(minhash.SQL, "/root/testdata/sf0.001", documents=d.toPandas())
    near(minhash.near_duplicates(d, 85, 3).withColumn("kept", F.col("doc_id") == F.col("component_id")).toPandas(), want)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16))
    out = []
    for i in range(900):
        x = centre[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.25])
        out.append((i, x.tolist(), int(i % 3)))
    out += [(1000 + i, out[7][1], 1) for i in range(50)] + [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [1.0, 2.0], 1), (2005, [2.0, 4.0], 1), (2006, out[0][1], None), (2007, [None] * 16, 1)]
    e = spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(e, slice_=64).toPandas().set_index("vec_id")
    ids = [o[0] for o in out]
    links = Counter()
    for i, (a, x, la) in enumerate(out):
        for b, y, lb in out[i + 1 :]:
            if la is not None and la == lb and x and y and len(x) == len(y) and None not in x + y:
                x_, y_ = np.array(x), np.array(y)
                n = np.sqrt((x_**2).sum() * (y_**2).sum())
                if n > 0 and (x_ * y_).sum() / n >= 0.93:
                    links[a] += 1
                    links[b] += 1
    found = got["n_links"].sum() / max(1, sum(links.values()))
    assert 0.9 <= found <= 1 and all(got.loc[i, "n_links"] <= links[i] for i in ids)
    assert got.loc[2004, "component_id"] == 2004 and got.loc[2005, "component_id"] == 2004
    assert all(got.loc[i, "n_links"] == 0 and got.loc[i, "kept"] for i in (2000, 2001, 2002, 2003, 2006, 2007))
    assert embeddings.near_vectors(e.where("vec_id < 0")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(a) + 1) for a in range(0, 60) if a % 7] + [(100, int(b)) for b in rng.integers(101, 160, 40)]
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def test_targets_reshare(spark):
    s = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["a"] == 20 and all(got[k] <= 2 * n for k, n in (("b", 100), ("c", 1000), (None, 50))) and math.isclose(sum(got.values()), 1740)


def near_brute(docs, share=0.8, width=5):
    """doc_ids that are the smallest of their group, by all pairs of full sets."""
    sets = {}
    for i, t in docs:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return sorted(i for i in ids if root(i) == i)


def test_pipeline(spark, sf, odd, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (name, f) in enumerate(p.STAGES):
        f(spark, kept, sf).write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert kept.columns == columns
        if name == "language_id":
            lang = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.select("doc_id", "text"), ["doc_id"], language.training_rows(docs)).where("score >= 0.5 AND lang_pred <> 'und'").collect()}
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted(lang) and len(lang) > 0.9 * docs.count()
        if name == "line_dedup":
            want = {r[0]: r[3] for r in lines_brute([tuple(r) for r in before.select("doc_id", "text").collect()])}
            got = kept.select("doc_id", "text", "n_chars").collect()
            assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == near_brute([tuple(r) for r in before.select("doc_id", "text").collect()])
        if name == "decontamination":
            x = answer(decontaminate.SQL, sf, documents=before.toPandas())
            assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(x.loc[~x.contaminated, "doc_id"])
        if name == "mixing":
            x = answer(mixing.SQL, sf, documents=before.toPandas())
            assert sorted((r["doc_id"], r["taken"]) for r in kept.collect()) == sorted(x.loc[x.taken > 0, ["doc_id", "taken"]].itertuples(index=False, name=None))
    names = ["row", "gone", "th", "kept_id", "found_lang", "found_lang_", "source_size", "taken", "key", "kept", "places"]
    strange = odd.select("*", *(F.lit(k).alias(k) for k in names))
    for start in (strange, strange.limit(0)):
        x = start
        for name, f in p.STAGES:
            x = common.cut(f(spark, x, sf))
            assert name == "mixing" or x.columns == strange.columns
            if name != "mixing" and x.count():
                r = x.first()
                assert all(r[k] == k for k in names), name
        assert x.where("source_size IS NULL").count() == 0 and set(p.ADDED) <= set(x.columns) and "input_size" in x.columns
    twice = spark.createDataFrame([(1, "one text of some words here", "a"), (1, "another text under the same id", "b"), (1, "one text of some words here", "a")], "doc_id long, text string, source string")
    assert len({tuple(p.near_duplicates(spark, twice.repartition(n), sf).collect()) for n in (1, 2, 3)}) == 1
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_toxicity_keeps_every_ngram(spark):
    """Held to a plain Kneser-Ney model of all n-grams, of which there are more than a task should hold."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = ["".join(rng.choice(letters, 8)) for _ in range(26_000)]
    docs = [(i, " ".join(word[i * 20 : i * 20 + 20]), int(i % 3 == 0)) for i in range(1300)]
    docs += [(1300 + i, d[1], None) for i, d in enumerate(docs[:60])]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["llr"] for r in toxicity.score(d.select("doc_id", "text"), d.select("doc_id", "toxic")).collect()}
    n, share, less = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT
    seen = [Counter(), Counter()]
    for i, text, toxic in docs:
        if toxic is not None and zlib.crc32(str(i).encode()) % 5 > 1:
            for w in text.split():
                w = f" {w} "
                seen[1 - toxic].update(w[j - k : j + 1] for j in range(1, len(w)) for k in range(min(n, j + 1)))
    assert len(seen[0] | seen[1]) > 300_000
    before, hist, after = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    used = [Counter(), Counter()]
    for c in (0, 1):
        before[c].update(g[1:] for g in seen[c] if len(g) > 1)
        for g in seen[0] | seen[1]:
            used[c][g] = seen[c][g] if len(g) == n or g[0] == " " else before[c][g]
            hist[c][g[:-1]] += used[c][g]
            after[c][g[:-1]] += used[c][g] > 0
    both = Counter(g[:-1] for g in seen[0] | seen[1] if used[0][g] + used[1][g] > 0)

    def after_context(c):
        t = [hist[0][c], hist[1][c], hist[0][c] + hist[1][c]]
        return t, [less * u / a if a else 1.0 for a, u in zip(t, [after[0][c], after[1][c], both[c]], strict=True)]

    def spelling(w):
        """Each byte's probabilities after those before it."""
        for j in range(1, len(w)):
            p = [1 / 256] * 3
            for k in range(min(n, j + 1)):
                g = w[j - k : j + 1]
                t, on = after_context(g[:-1])
                low = [*((1 - share) * x + share * p[2] for x in p[:2]), p[2]]
                u = [used[0][g], used[1][g], used[0][g] + used[1][g]]
                p = [max(u[c] - less, 0) / t[c] + on[c] * low[c] if t[c] else p[c] for c in range(3)]
            yield p

    def llr(w):
        return sum(math.log(p[0] / p[1]) for p in spelling(f" {w} "))

    for w in (word[0][:3], "qqq", ""):
        sums = np.sum([list(spelling(f" {w}" + chr(c)))[-1] for c in range(256)], axis=0)
        assert np.allclose(sums, 1, atol=1e-9), (w, sums)
    for i in [*range(40), *range(1300, 1320)]:
        want = [llr(w) for w in docs[i % 1300][1].split()]
        assert math.isclose(got[i], sum(want) / len(want), abs_tol=1e-4), i


def test_lines_of_two_texts_recur(spark):
    line = " ".join(f"passage{chr(97 + j)}" for j in range(20))
    d = spark.createDataFrame([(i, f"{line if i in (2, 5) else 'nothing to see'.replace('see', 'x' * i)}\nown {i}") for i in range(1, 7)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(d).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}


def test_line_families_of_one_leaf(spark):
    """A banner and a family with a name field share a leaf; lines of four words that differ in the last share no template."""
    names = ["anna", "boris", "carla", "dmitri", "elena", "farid", "gesa", "hugo"]
    docs = [(i, f"All content on this page is provided as is\nAll content on sale today by {n} for members") for i, n in enumerate(names)]
    docs += [(100 + i, f"We went to {n}") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 2 * (i > 0) for i in range(8)} | {100 + i: 0 for i in range(8)}


def lines_brute(docs, min_texts=2, min_words=3):
    """doc_id, n_lines, n_dropped, kept text by the rule, in plain Python."""
    places, texts = {}, {i: t for i, t in docs}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = tuple("#" if re.search("[0-9]", x) else x for x in re.split("[ \t\n\x0b\x0c\r]+", line) if x)
            if len(w) >= min_words:
                places.setdefault((len(w), w[:3]), {}).setdefault(w, []).append((i, k))
    drop = {}
    for lines_ in places.values():
        left = sorted(lines_, key=lambda w: (-len(lines_[w]), min(lines_[w])))
        while left:
            rest = left[0][3:]
            taken = [w for w in left if sum(a == b for a, b in zip(w[3:], rest)) >= 0.7 * len(rest)]
            left = [w for w in left if w not in set(taken)]
            at = [p for w in taken for p in lines_[w]]
            first_of = {}
            for i, _ in at:
                first_of[texts[i]] = min(i, first_of.get(texts[i], i))
            if len(first_of) >= min_texts:
                for i, k in at:
                    if i != min(first_of.values()):
                        drop.setdefault(i, set()).add(k)
    out = []
    for i, t in docs:
        split = [] if t is None else t.split("\n")
        gone = drop.get(i, set())
        out.append((i, len(split), len(gone), t if not gone else "\n".join(x for k, x in enumerate(split) if k not in gone)))
    return sorted(out)


def test_lines_by_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, lines.dedup_lines(d).select("doc_id", "n_lines", "n_dropped", "text").collect()))
    assert got == lines_brute([tuple(r) for r in d.collect()])
    assert sum(r[2] for r in got) > 0
    clash = d.select("doc_id", "text", *(F.lit(k).alias(k) for k in ("row", "gone", "th", "n_lines", "line", "template")))
    x = lines.dedup_lines(clash, counts=None)
    assert x.columns == clash.columns and sorted((r["doc_id"], r["text"]) for r in x.collect()) == [(r[0], r[3]) for r in got]
    short = spark.createDataFrame([(1, "Yes\nmore words here"), (2, "Yes\nother things there")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(short, min_words=1).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize(("coarse", "lists"), [(1024, 1024), (64, 1024)])
def test_recall_of_probes(coarse, lists):
    """Of the links among 30,000 vectors, the share that either end's search reaches, with as many lists as a million vectors have."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))[rng.integers(0, 6000, 30_000)] + rng.normal(size=(30_000, 64)) * rng.choice([0.1, 0.2, 0.26], (30_000, 1))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    q = embeddings.Quantiser(x[:20_000], lists, coarse)
    assert len(q.coarse) * len(q.second) >= lists
    asked = np.concatenate([q.lists(part, embeddings.PROBES) for part in np.array_split(x, 20)])
    found = every = 0
    for i in range(0, len(x), 2000):
        a, b = np.nonzero(x[i : i + 2000] @ x.T >= 0.93)
        a += i
        a, b = a[a < b], b[a < b]
        every += len(a)
        found += ((asked[b] == asked[a, :1]).any(axis=1) | (asked[a] == asked[b, :1]).any(axis=1)).sum()
    assert every > 1000 and found >= 0.97 * every


def test_toxicity_on_held_out_labels(spark):
    """The registered query: labels of a remainder it never learns from, by the area under the curve."""
    sf = "/root/testdata/sf0.01"
    x = toxicity.op2_toxicity(spark, sf).toPandas()
    assert (x["held_out"] == x["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and (x["predicted"] == (x["score"] >= 0.5)).all()
    x = x.merge(pd.read_parquet(f"{sf}/labels.parquet")[["doc_id", "toxic"]])
    held = x[x["held_out"] & x["toxic"].notna()]
    rank, bad = held["score"].rank(), held["toxic"] == 1
    area = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert bad.sum() > 3 and area > 0.95


def test_a_string_in_every_document(spark):
    """Passages that all texts share, between words of their own: one entry a chunk, and the same result as brute force."""
    p = " ".join(f"shared{i}" for i in range(40))
    d = spark.createDataFrame([(i, f"a{i} b{i} {p} c{i} d{i}") for i in range(300)], "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(d).collect()
    assert {(r["n_words"], r["n_removed"], r["n_runs"]) for r in got} == {(44, 40, 1)} and len(got) == 300
    for hot in (1000, 1):
        got = suffixes.remove_repeats(d, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == suffix_brute([tuple(r) for r in d.collect()])


def segmentations(word, pieces, longest):
    """All ways to cut a word into pieces."""
    if not word:
        yield ()
    for k in range(1, min(longest, len(word)) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces, longest):
                yield (pieces[word[:k]], *rest)


def padded(words):
    n = max(map(len, words))
    return np.array([list(w.ljust(n, b"z")) for w in words], np.uint8), np.array([len(w) for w in words])


def test_lattice_against_all_segmentations():
    """Words of 1 to 40 bytes of a small alphabet side by side, some with all their segmentations, all with sums in logarithms of exact fractions."""
    from fractions import Fraction

    rng = np.random.default_rng(7)
    names = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aab", b"bbb", b" ab", b"abababab"]
    x, pieces = language.Lattice(names), {p: i for i, p in enumerate(names)}
    words = [b" " + bytes(rng.choice([97, 98], n).tolist()) for n in (0, 1, 2, 3, 5, 7, 8, 9, 12, 14, 15, 16, 23, 24, 31, 39)]
    theta = rng.random((len(names), 3)) * 1e-6
    letters, sizes = padded(words)
    got, uses = x.forward(letters, sizes, theta), [x.expected(letters[i : i + 1], sizes[i : i + 1], np.ones(1)) for i in range(len(words))]
    together = x.expected(letters, sizes, np.arange(1.0, len(words) + 1))
    assert np.allclose(together, sum((i + 1) * u for i, u in enumerate(uses)))
    for i, w in enumerate(words):
        sums = [[Fraction(int(j == 0)) for j in range(len(w) + 1)] for _ in range(3)]
        for e in range(1, len(w) + 1):
            for p, k in pieces.items():
                if w[:e].endswith(p):
                    for c in range(3):
                        sums[c][e] += sums[c][e - len(p)] * Fraction(theta[k, c])
        logs = [math.log(v[-1].numerator) - math.log(v[-1].denominator) for v in sums]
        assert np.allclose(got[i], logs, rtol=1e-12)
        if len(w) <= 17:
            ways = list(segmentations(w, pieces, 8))
            weight = np.array([64.0 ** -len(c) for c in ways])
            want = np.zeros(len(names))
            for c, v in zip(ways, weight / weight.sum(), strict=True):
                np.add.at(want, list(c), v)
            assert np.allclose(uses[i], want)
            assert np.allclose(got[i], [np.log(sum(np.prod(theta[list(c), k]) for c in ways)) for k in range(3)])


def test_words_of_any_length_are_scored_alike(spark):
    """A word of 20,000 bytes of the whole vocabulary neither underflows nor takes another path: it is scored as its pieces of text are."""
    import time

    x = language.Lattice(language.read_pieces())
    rng = np.random.default_rng(3)
    theta = rng.random((x.n, 2)) * 1e-9
    theta /= theta.sum(axis=0) * np.array([1.0, 1e3])
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, 1000)).encode()
    words = [b" " + text, b" " + text[:2001], b" " + text[:33], b" a"]
    letters, sizes = padded(words)
    side = x.forward(letters, sizes, theta)
    assert np.isfinite(side).all()
    for i, w in enumerate(words):
        assert np.allclose(side[i], x.forward(*padded([w]), theta)[0])
    many = [b" " + text[3 * i : 3 * i + 2100] for i in range(250)]
    began = time.process_time()
    x.forward(*padded(many), np.tile(theta, (1, 5)))
    assert (time.process_time() - began) / (250 * 2100) * 1e9 < 3000  # CPU seconds a GB, with room for a busy machine


def test_marks_part_words():
    assert language.letter_words("l’été—NAÏVE «ça» 漢字、かな。ＡＢ！x々y ªº".encode()) == [w.encode() for w in ("l", "été", "naÏve", "ça", "漢字", "かな", "ＡＢ", "x々y", "ªº")]
    for block in range(0x80, 0x10000):
        c = chr(block)
        if not 0xD800 <= block < 0xE000 and c.isalpha():
            assert language.letter_words(c.encode()) == [c.encode()], hex(block)


def test_text_without_spaces(spark):
    """Two languages of ideographs, texts without a space: told apart on texts that weren't learned from."""
    rng = np.random.default_rng(11)
    kinds = {"aa": 0x4E00, "bb": 0x5200}
    rows = [(i, "".join(chr(kinds[k] + int(c)) for c in rng.integers(0, 900, 700)), k, "", 0) for i, k in enumerate(["aa", "bb"] * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = language.identify(d.select("doc_id", "text"), ["doc_id"], language.training_rows(d)).toPandas().merge(d.toPandas()[["doc_id", "lang"]])
    assert (got["lang_pred"] == got["lang"]).all()


def test_pipeline_without_languages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.languages(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.where("rlike(text, '[a-zA-Z]')").count()


def test_too_many_languages(spark):
    d = spark.range(language.MOST_LANGUAGES + 1).select("id", F.lit("word").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language.learn(d, spark.sparkContext.broadcast(language.read_pieces()))


def test_toxicity_without_rows_for_the_curve(spark):
    """Labels only where the curve isn't fitted, of one class only, and none at all."""
    plain, bad = [f"wo{a}{b}" for a in "abcdefgh" for b in "xyz"], ["vileful", "vilest", "grossly"]
    rng = np.random.default_rng(4)
    docs = [(i, " ".join([*rng.choice(plain, 12), *rng.choice(bad if i % 2 else plain, 3)]), i % 2) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, *_ in docs}
    got = toxicity.score(d, d.where(~F.col("doc_id").isin([i for i in fold if fold[i] == 1]))).toPandas().merge(d.toPandas())
    held = got[got["doc_id"].map(fold).isin([0, 1])]
    assert held["score"].nunique() > 20 and ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean() > 0.95
    assert np.allclose(got["score"], 1 / (1 + np.exp(-got["llr"])))
    for labels in (d.where("toxic = 1"), d.limit(0), d.withColumn("toxic", F.lit(None).cast("int"))):
        assert {(r["score"], r["llr"]) for r in toxicity.score(d, labels).collect()} == {(0.0, 0.0)}


@pytest.mark.parametrize("coarse", [1024, 8])
def test_links_found_through_the_whole_operator(spark, coarse):
    """3,000 vectors near 120 middles, of which about half are within reach of each other: links against all pairs, with lists of one level and parted ones."""
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(120, 32))
    x = middle[rng.integers(0, 120, 3000)] + rng.normal(size=(3000, 32)) * rng.choice([0.1, 0.26], 3000)[:, None]
    x = x.astype(np.float32)
    d = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    got = embeddings.near_vectors(d, slice_=100, coarse=coarse).toPandas().sort_values("vec_id")
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    link = (u @ u.T >= 0.93) & (np.arange(3000)[:, None] % 2 == np.arange(3000) % 2)
    np.fill_diagonal(link, False)
    assert (got["n_links"].to_numpy() <= link.sum(axis=1)).all() and got["n_links"].sum() >= 0.95 * link.sum() > 10_000


def test_slices_hold_about_as_much(spark):
    """Keys of any quality, cut by the least: no slice holds over four times the mean."""
    rng = np.random.default_rng(0)
    for quality in (0.25, 0.4, 1.0):
        key = -np.log(rng.random(400_000)) / quality
        share = np.bincount(np.minimum(999, ((1 - np.exp(-mixing.LEAST * key)) * 1000).astype(int)), minlength=1000)
        assert share.max() < 4.5 * 400


@pytest.mark.parametrize("width", [0, 1, 2, 3, 4, 7, 10, 23])
def test_templates_by_parts_are_those_by_all_comparisons(monkeypatch, width):
    """Leaves of 600 lines of few words, some with long runs alike: looking lines up by parts gives the templates of comparing all."""
    rng = np.random.default_rng(width)
    base = rng.integers(0, 4, (12, width))
    x = np.where(rng.random((600, width)) < 0.25, rng.integers(0, 4, (600, width)), base[rng.integers(0, 12, 600)]).astype("<u2")
    by_parts = lines.first_alike(x)
    monkeypatch.setattr(lines, "MANY", 10**9)
    assert (by_parts == lines.first_alike(x)).all()


def test_a_leaf_of_many_templates():
    """20,000 different lines of one leaf take seconds, not the square of their number."""
    import time

    x = np.random.default_rng(1).integers(0, 60_000, (20_000, 10)).astype("<u2")
    began = time.process_time()
    assert len(np.unique(lines.first_alike(x))) > 19_000
    assert time.process_time() - began < 10


def test_a_phrase_whose_rarest_word_was_replaced(spark):
    """The next rarest word's list finds it; lists of one start meet whatever rows repeat."""
    words = [f"w{i}" for i in range(10)]
    other = [w if w != "w4" else "zz" for w in words]
    rows = [(1, " ".join(words)), (2, "a b " + " ".join(other) + " c"), (2, "a b " + " ".join(other) + " c"), (3, " ".join(words[5:]) + " q " + " ".join(words)), (3, " ".join(words[5:]) + " q " + " ".join(words))]
    d = spark.createDataFrame([*rows, (4, "w4 w4 w5 alone"), (5, None)], "doc_id long, text string")
    b = spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near"]) for r in decontaminate.contamination(d, b).collect()}
    assert got[1] == (10, 1, 0) and got[2] == (0, 0, 1) and got[3][:2] == (10, 1) and got[4] == (0, 0, 0) and got[5] == (0, 0, 0)
