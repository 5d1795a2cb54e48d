"""op11 against plain Python: every k-mer, every order, every neighbour."""

import hashlib

import numpy as np
import pytest

from murmurlake.llm import fingerprints as fp
from murmurlake.llm.common import factors

SCHEMA = "doc_id long, text string, fingerprint string, part int, n_chars string"
M = 1 << 64


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % M
    return x ^ x >> 31


def plain(text, k=fp.K, sketches=fp.SKETCHES, least=fp.TUPLE):
    """The definition, one k-mer after another."""
    f, orders, own = [[int(v) for v in factors(n, fp.SEED + s)] for n, s in ((k, 0), (sketches, 1), (least, 2))]
    x = [ord(c) + 1 for c in text]
    if not x:
        return "00000000" * sketches
    if len(x) < k:
        h = [mix((sum(a * b for a, b in zip(x, f)) + len(x)) % M)]
    else:
        h = [mix(sum(x[i + j] * f[j] for j in range(k)) % M) for i in range(len(x) - k + 1)]
    # Equal k-mers are told by the bits above those that number the places.
    bits, seen, rank = max(1, (len(h) - 1).bit_length()), {}, []
    for v in h:
        n = seen[v >> bits] = seen.get(v >> bits, -1) + 1
        rank.append(mix((v + n * 0x9E3779B97F4A7C15) % M) >> 32)
    own, out = [int(v) for v in factors(min(least, len(h)), fp.SEED + 2)], b""
    for o in orders:
        o = o >> 32 | 1
        chosen = sorted(sorted(range(len(h)), key=lambda i: (rank[i] * o % (1 << 32), i))[:least])
        out += (mix(sum(h[i] * g for i, g in zip(chosen, own)) % M) >> 32).to_bytes(4, "little")
    return out.hex()


def expected(rows, **how):
    """rows: (doc_id, text). By the brute force: each row with the next one's head."""
    rows = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: -r[0])
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 3
        e = t[: len(t) - n] + following[:n]
        a, b, c = plain(t, **how), plain(e, **how), plain(following, **how)
        like = lambda x, y: np.mean([x[j : j + 8] == y[j : j + 8] for j in range(0, len(x), 8)])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], bytes(r["fingerprint"]).hex(), bytes(r["edited_fingerprint"]).hex(), r["near_edited"], r["near_next"]) for r in df.collect())


ODD = ["", None, " ", "a", "abcd", "abcde", "éüß 漢字かな 😀", "aaaa " * 60, "one two three four five six seven", "One two three four five six seven", "x" * 300]


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_against_plain_python(spark, ranges):
    """Any number of ranges, empty ones too, gives the same rows."""
    rows = [(7 * i - 20, t) for i, t in enumerate(ODD)]
    d = spark.createDataFrame([(i, t, "z", 1, "q") for i, t in [*rows, (None, "no document")]], SCHEMA)
    assert got(fp.fingerprints(d, ranges=ranges)) == expected(rows)


def test_query_on_whole_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    short = {r[0] for r in rows if len(r[1] or "") < 1500}
    found = {r["doc_id"]: r for r in fp.op11_fingerprints(spark, sf).collect()}
    assert len(found) == len(rows)
    ordered = sorted(rows, reverse=True)
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(t) // 3
        e = t[: len(t) - n] + following[:n]
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if i in short:
            assert (found[i]["fingerprint"], found[i]["edited_fingerprint"]) == (plain(t), plain(e))
    near, far = (np.array([r[c] for r in found.values() if r["n_chars"] > 60]) for c in ("near_edited", "near_next"))
    assert np.mean(near > far) > 0.99 and near.mean() > 0.2 and far.mean() < 0.05


def test_order_counts():
    """Two halves changed about keep nearly all k-mers, but not their order; likeness falls with the share of edits."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    a = fp.points_of(" ".join(words))
    make = lambda w: fp.fingerprint(fp.points_of(" ".join(w)), sketches=256)
    own = fp.fingerprint(a, sketches=256)
    assert 0.4 < fp.likeness(own, make(words[200:] + words[:200])) < 0.65
    edits = [fp.likeness(own, make([("zz" + w if j % step == 0 else w) for j, w in enumerate(words)])) for step in (2, 8, 40)]
    assert edits[0] < edits[1] < edits[2] < 1


def test_small_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fp.fingerprints(none).collect() == []
    one = fp.fingerprints(spark.createDataFrame([(3, "abcdefghi", "", 0, "")], SCHEMA)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and one[0]["near_next"] == 1.0
    twin = fp.fingerprints(spark.createDataFrame([(3, "some words here", "", 0, "")] * 4 + [(3, "another text", "", 0, "")], SCHEMA), ranges=2).collect()
    assert len(twin) == 5 and len({bytes(r["fingerprint"]) for r in twin}) == 2
