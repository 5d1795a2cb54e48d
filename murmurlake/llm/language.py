"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of byte pieces gives each word all the ways it can be cut into pieces. Per language, a piece has
a probability; the probability of a word is the sum over all its segmentations of the products of their pieces, which a
forward pass over the word's lattice gives. A text's log-likelihood is the sum over its words.

Piece probabilities come from one expectation step: with all pieces alike, forward and backward passes give the expected
number of times each piece is used in the labelled texts of each language. These counts are summed by Spark over all
labelled texts; their number is bounded by MOST_LANGUAGES times pieces of the vocabulary.

A word is a run of ASCII letters, in lower case, and characters outside ASCII but punctuation; it starts with a space, as the
vocabulary's pieces do. Words of any length are scored whole and in one way: words of about one length side by side, byte by
byte, with sums rescaled on the way; equal words of a chunk are worked out once.

Defined results: null text, or text without a letter, is `und` with score 0, as is every text when nothing is labelled;
ties go to the first language by name; repeated rows each get the same result. No text or word is cut, however long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: After so many bytes sums are rescaled: a byte's probability is over 1e-20, so what they lose meanwhile stays within a double.
RESCALE = 8
#: Words up to this length are grouped by it; longer ones with those that are longer by a quarter at most.
EXACT = 32
#: Bytes of words, and words times languages, that are worked out at a time.
CELLS, SUMS = 2_000_000, 100_000
#: Bytes of text that a task cuts into words at a time; what it holds of them is about 60 times as much.
CHUNK = 3_000_000
PRIOR = 0.01
#: So many words' evidence at most makes the score: longer texts aren't surer than that.
EVIDENCE = 20.0
#: So many languages at most are learnt; their piece probabilities are one matrix of 80 MB in each task.
MOST_LANGUAGES = 200
SEED = 5

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


#: Blocks of Unicode outside ASCII that hold punctuation and symbols, no letters: Latin-1 (but for its letters), general, currency, arrows to miscellaneous symbols, CJK, wide forms.
_MARKS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xc3[\x97\xb7]|\xe2(?:\x80[\x80-\xbf]|\x81[\x80-\xaf]|\x82[\xa0-\xbf]|\x83[\x80-\x8f]|\x86[\x90-\xbf]|[\x87-\xaf][\x80-\xbf])|\xe3\x80[\x80-\x84\x88-\xa0]|\xef(?:\xbc[\x80-\x8f\x9a-\xa0\xbb-\xbf]|\xbd[\x80\x9b-\xa5])")


def letter_words(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = _MARKS.sub(b" ", text)
    return text.translate(_LETTERS).split()


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces that can be part of a word, whatever their length; all single bytes are among them."""
    try:
        lines = open(path, "rb").read().splitlines()
    except OSError as why:
        raise FileNotFoundError(f"language identification needs a vocabulary of byte pieces, one in base64 a line, at {path}") from why
    fit = set(range(128, 256)) | set(range(97, 123))
    found = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    pieces = [p for p in found if (p[:1] == b" " or p[0] in fit) and fit.issuperset(p[1:])]
    if missing := {bytes([c]) for c in fit | {32}} - set(pieces):
        raise ValueError(f"{len(missing)} single bytes are no pieces of {path}")
    return pieces


class Lattice:
    """The vocabulary as a tree, and all pieces of words of one length found in it at once."""

    def __init__(self, pieces: list[bytes]):
        symbols = sorted({c for p in pieces for c in p})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, p in enumerate(pieces):
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nodes[at][c]
            ends[at] = k
        self.width = len(symbols) + 1
        self.step = np.zeros(len(nodes) * self.width, np.int32)
        for at, edges in enumerate(nodes):
            for c, to in edges.items():
                self.step[at * self.width + self.symbol[c]] = to
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.n = len(pieces)
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.longest = int(self.length.max())

    def edges(self, coded: np.ndarray, s: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that start at s: (end, which words, which piece). coded: words by symbol, 0 behind their ends."""
        rows, node, out = np.arange(len(coded)), np.zeros(len(coded), np.int64), []
        for e in range(s, min(coded.shape[1], s + self.longest)):
            node = self.step[node * self.width + coded[rows, e]]
            alive = node > 0
            rows, node = rows[alive], node[alive].astype(np.int64)
            if not len(rows):
                break
            piece = self.piece[node]
            whole = piece >= 0
            out.append((e + 1, rows[whole], piece[whole]))
        return out

    def forward(self, words: np.ndarray, sizes: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Log-probability of each word (rows; sizes: bytes of each) under each column of theta."""
        coded, n = np.where(np.arange(words.shape[1]) < sizes[:, None], self.symbol[words], 0), words.shape[1]
        # Sums at the places that pieces from here can end at; behind them their slots are used again.
        ring = np.zeros((min(self.longest, n) + 1, len(words), theta.shape[1]))
        ring[0] = 1
        log, out = np.zeros(ring.shape[1:]), np.zeros(ring.shape[1:])
        for s in range(n + 1):
            here = ring[s % len(ring)]
            done = sizes == s
            if done.any():
                out[done] = np.log(here[done]) + log[done]
            if s == n:
                break
            if s and s % RESCALE == 0:
                by = np.where(here > 0, here, 1)  # words that have ended have nothing here
                log += np.log(by)
                ring /= by
            for e, rows, piece in self.edges(coded, s):
                ring[e % len(ring)][rows] += here[rows] * theta[piece]
            ring[s % len(ring)] = 0
        return out

    def expected(self, words: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected to be used, with all pieces alike; weight: how often each word occurs."""
        coded, n, flat = np.where(np.arange(words.shape[1]) < sizes[:, None], self.symbol[words], 0), words.shape[1], 1.0 / 64
        alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        before, after = np.zeros((n // RESCALE + 2, len(words))), np.zeros(len(words))  # logarithms of what sums were divided by
        alpha[0], beta[sizes, np.arange(len(words))] = 1, 1
        for s in range(n):
            if s % RESCALE == 0:
                by = np.where(sizes > s, alpha[s], 1)
                alpha[s : s + self.longest + 1] /= by
                before[s // RESCALE + 1] = before[s // RESCALE] + np.log(by)
            for e, rows, _ in self.edges(coded, s):
                alpha[e][rows] += alpha[s][rows] * flat
        # alpha[e] is divided as often as the last start of a piece that reaches it.
        last = np.maximum(sizes - 1, 0) // RESCALE + 1
        own = np.arange(len(words))
        whole = np.log(alpha[sizes, own]) + before[last, own]
        out = np.zeros(self.n)
        for s in range(n - 1, -1, -1):
            found = self.edges(coded, s)
            for e, rows, piece in found:
                beta[s][rows] += beta[e][rows] * flat
                share = np.exp(np.log(alpha[s][rows] * flat * beta[e][rows]) + before[s // RESCALE + 1][rows] + after[rows] - whole[rows])
                out += np.bincount(piece, share * weight[rows], self.n)
            if s % RESCALE == 0:
                by = np.where(beta[s] > 0, beta[s], 1)
                beta[s : s + self.longest + 1] /= by
                after += np.log(by)
        return out


_KNOWN: dict[int, Lattice] = {}


def lattice(pieces) -> Lattice:
    """Built once in a Python worker."""
    key = pieces.id if hasattr(pieces, "id") else id(pieces)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Lattice(pieces.value)
    return _KNOWN[key]


def by_length(words: Words, first: np.ndarray, columns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of distinct words of about one length: which they are, their bytes with a space before, and how many these are. A longer one goes alone where it has to."""
    lengths = (words.ends - words.starts)[first]
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        least = lengths[order[at]]
        most = least if least <= EXACT else least * 5 // 4
        end = int(np.searchsorted(lengths[order], most, side="right"))
        end = min(end, at + max(1, min(CELLS // int(most), SUMS // columns)))
        part = order[at:end]
        n = int(lengths[part].max())
        place = np.minimum(words.starts[first[part]][:, None] + np.arange(n), len(words.buffer) - 1)
        yield part, np.concatenate([np.full((len(part), 1), 32, np.uint8), words.buffer[place]], axis=1), lengths[part] + 1
        at = end


def learn(docs: DataFrame, pieces) -> tuple[list[str], np.ndarray]:
    """Languages and, for each piece and language, its probability. docs: text and lang of the labelled texts."""

    def count(batches):
        known, sums = lattice(pieces), {}
        for rows, texts in chunks(batches, CHUNK):
            langs = np.array(rows["lang"].to_pylist(), object)
            for lang in set(langs):
                words = Words([letter_words(t) for t, x in zip(texts, langs, strict=True) if x == lang])
                if not words.total:
                    sums.setdefault(lang, np.zeros(known.n))
                    continue
                _, first, times = np.unique(words.hashes(SEED), return_index=True, return_counts=True)
                for part, letters, sizes in by_length(words, first):
                    sums[lang] = sums.get(lang, 0) + known.expected(letters, sizes, times[part].astype(float))
        for lang, x in sums.items():
            at = np.flatnonzero(x > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(x[at], 0.0))], names=["lang", "piece", "uses"])

    named = docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if named > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages are labelled; so many at most are told apart")
    found = docs.select("text", "lang").mapInArrow(count, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
    langs = sorted(found["lang"].unique())
    uses = np.full((len(pieces.value), len(langs)), PRIOR)
    found = found[found["piece"] >= 0]
    np.add.at(uses, (found["piece"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)), found["uses"].to_numpy())
    return langs, uses / uses.sum(axis=0)


def identify(docs: DataFrame, keep: list[str], train: DataFrame, vocabulary: str = VOCABULARY, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in keep, with the language and the score under the given names, for each row of docs."""
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(read_pieces(vocabulary))
    langs, theta = learn(train.where("lang IS NOT NULL"), pieces)
    model = spark.sparkContext.broadcast((langs, theta))

    def score(batches):
        known, (langs, theta) = lattice(pieces), model.value
        for rows, texts in chunks(batches, CHUNK):
            split = [letter_words(t) for t in texts]
            words = Words(split)
            total = np.zeros((len(texts), len(langs)))
            if words.total and langs:
                _, first, of = np.unique(words.hashes(SEED), return_index=True, return_inverse=True)
                each = np.zeros((len(first), len(langs)))
                for part, letters, sizes in by_length(words, first, len(langs)):
                    each[part] = known.forward(letters, sizes, theta)
                for k in range(len(langs)):
                    total[:, k] = np.bincount(words.owner, each[of, k], len(texts))
            pred, sure = [], []
            for i, t in enumerate(texts):
                if not langs or not split[i] or not has_letter(t[:200]) and not has_letter(t):
                    pred.append("und")
                    sure.append(0.0)
                    continue
                x = total[i] * min(1.0, EVIDENCE / len(split[i]))
                best = int(np.argmax(x))
                pred.append(langs[best])
                sure.append(float(1 / np.exp(x - x[best]).sum()))
            out = rows.select(keep).append_column(names[0], pa.array(pred, pa.string())).append_column(names[1], pa.array(sure, pa.float64()))
            yield from out.combine_chunks().to_batches()

    text = F.col("text").cast("string").alias("text")
    rows = docs.select(*[text if c == "text" else F.col(c) for c in keep], *([] if "text" in keep else [text]))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(score, schema)


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(remainder(4) != 2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return identify(rows, ["doc_id"], training_rows(docs)).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
