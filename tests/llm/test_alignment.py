"""op13 against both libraries and every pair of ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from murmurlake.llm import alignment as al

A, B = f"{al.FOLDER}/byte_bpe_50k.json", f"{al.FOLDER}/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, pair string, batch int, n long"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = al.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return (
        lambda t: [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
        lambda t: [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)],
    )


def expected(rows, libraries):
    docs = []
    for doc_id, t in rows:
        sides = [f(t) if t else [] for f in libraries]
        if t and any(b"".join(x for _, x in s) != (" " + t).encode() for s in sides):
            sides = [[], []]
        placed = []
        for s in sides:
            at, out = 0, []
            for i, x in s:
                out.append((i, at, at + len(x)))
                at += len(x)
            placed.append(out)
        a, b = placed
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        both = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, start = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in placed) if len(a) < 400 else None)
            start = end
        docs.append((doc_id, a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return sorted((d, len(a), len(b), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), (hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") if None not in g else "long") for d, a, b, g, x in docs)


def same(df, want):
    have = sorted(tuple(r[c] for c in al._ALIGNED.names) for r in df.collect())
    have = [h[:-1] + ("long",) if w[-1] == "long" else h for h, w in zip(have, want, strict=True)]
    assert have == want


ODD = ["", " ", "  two  spaces ", "\n\ttabs\r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ is a mark", "x▁y", "café ÉCOLE naïve", "漢字かな交じり文。", "😀👍🏽 flags 🇫🇷", "ا العربية", "​ nbsp", "don't we'll I'M", "1234567 3.14", "a", "É", "\x00\x01\x7f", "word " * 300, "Aword" * 200, "é İ ﬁ"]


@pytest.mark.parametrize("batch_bytes", [1, 900, al.BATCH_BYTES])
def test_odd_texts(spark, libraries, batch_bytes):
    rows = [(i - 3, t) for i, t in enumerate([None, *ODD, ODD[7], ODD[7]])] + [(2, "twice"), (2, "twice"), (2, "other text")]
    d = spark.createDataFrame([(*r, "p", 1, 2) for r in [*rows, (None, "no document")]], SCHEMA)
    same(al.align(d, batch_bytes=batch_bytes), expected(rows, libraries))
    assert al.align(d.limit(0)).collect() == []
    same(al.align(d.where("text IS NULL OR text = ''")), expected([r for r in rows if not r[1]], libraries))


def test_query(spark, sf, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(al.op13_tokenizer_alignment(spark, sf), expected(rows, libraries))


def test_any_letters(libraries):
    """Ids are those of the tokenizers library, whatever the letters."""
    rng, a = random.Random(4), al.ByteLevel(A)
    assert a._encode.__name__ == "encode_ordinary"
    kinds = [(32, 127), (0x80, 0x2FFF), (0x3000, 0xD7FF), (0xE000, 0x1FFFF), (0x20000, 0x10FFFF), (32, 33), (9, 14), (0x85, 0xA1), (0x2000, 0x2030)]
    for _ in range(1500):
        t = "".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 60)))
        assert a.encode(t) == [i for i, _ in libraries[0](t)]


def test_counts_cross_batches(spark):
    """The documents that hold a pair are counted over all batches, not within one."""
    d = spark.createDataFrame([(i, "the cat", "", 0, 0) for i in range(40)], SCHEMA).repartition(5)
    found = al.align(d, batch_bytes=20).collect()
    assert {r["count_sum"] for r in found} == {40 * found[0]["n_links"]} and all(r["n_best"] == r["n_links"] for r in found)
    assert np.all([r["n_groups"] == 2 for r in found])
