"""Cross-tokenizer alignment: which tokens of one tokenizer overlap which of another, and in how many documents.

A batch of texts is cut by both tokenizers; a token's place is its range of bytes in space + text. Two backward as-of merges, keyed
by document, find for each token start of one side the token of the other side that covers it. A pair's overlap starts where the
later of its two tokens does, so the union of both directions is all overlapping pairs. Where tokens of both sides end at the same
byte a group ends.

How many documents hold a pair of ids linked is counted over the whole corpus: each batch tells its distinct pairs with their
documents, these are summed by pair, the highest count of each A id is set beside it, and the counts go back to the batches that
asked. A pair that every document has is one row a batch, before and after the sum.

Defined results: a text that is null or empty, or whose tokens' bytes joined are not space + text on either side (as where B's
pieces have a space for U+2581), has no tokens: zeros, and '' for groups_sha256. Strings of special tokens are plain text. Rows
without doc_id are left out; rows that repeat an id or a text are documents of their own, and each counts. An empty table gives no
rows. No text is cut: a batch is as many whole texts as hold BATCH_BYTES, or one longer text.

The tokenizers' files are public; their folder is a parameter and must be at the same path on all executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, planes, table, unplanes

FOLDER = "/opt/tokenizers"
#: Bytes of text that are aligned at a time; their tables take about 100 times as much.
BATCH_BYTES = 2_000_000
#: Ids of B have at most so many bits, ids of A 18.
B_BITS = 20
PAIR_BITS = 38
#: Pieces that hold a space where U+2581 stands.
SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A: a byte-level BPE in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Merges in the order of their ids make ranks; special tokens' strings are no entries, so they are plain text.
        made = [vocab[bytes(letters[c] for c in a + b)] for a, b in merges]
        of = {i: b for b, i in vocab.items()}
        self.tokens = pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.large_binary())
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        kind = spec["pre_tokenizer"]
        if made == sorted(made) and kind["type"] == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and spec["normalizer"] is None:
            self._encode = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self._encode = lambda text: own.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self._encode(" " + text)


class Pieces:
    """B: a SentencePiece model, which sets a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self._own.vocab_size()
        self.tokens = pa.array([bytes([int(p[3:5], 16)]) if self._own.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self._own.id_to_piece(list(range(n))))], pa.large_binary())

    def encode(self, text: str) -> list[int]:
        return self._own.encode(text)


@lru_cache(maxsize=4)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def covering(starts: pd.DataFrame, tokens: pd.DataFrame) -> np.ndarray:
    """For each token start the other side's token that covers it. Both: doc, start, at, by start; at is the token's number."""
    return pd.merge_asof(starts[["doc", "start"]], tokens, on="start", by="doc", direction="backward")["at"].to_numpy()


class Side:
    """Tokens of all texts of a batch: id, document, and range of bytes, counted through the batch so that starts ascend."""

    def __init__(self, ids: list[list[int]], tokens: pa.Array):
        self.counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.counts.sum()))
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        self.taken = tokens.take(pa.array(self.ids))
        edges = np.frombuffer(self.taken.buffers()[1], np.int64)[: len(self.ids) + 1] if len(self.ids) else np.zeros(1, np.int64)
        self.start, self.end = edges[:-1], edges[1:]
        self.table = pd.DataFrame({"doc": self.doc, "start": self.start, "at": np.arange(len(self.ids))})

    def joined(self) -> Iterator[bytes]:
        """By text, its tokens' bytes."""
        data = (self.taken.buffers()[2].to_pybytes() if len(self.ids) else b"")
        edges = np.append(0, self.end)[np.append(0, np.cumsum(self.counts))].tolist()
        return (data[x:y] for x, y in pairwise(edges))


def aligned(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A's and B's tokens of all pairs whose ranges of bytes overlap."""
    over = covering(a.table, b.table)
    under = covering(b.table, a.table)
    new = a.start[under] < b.start  # starts that coincide were found from the other side
    return np.concatenate([np.arange(len(a.ids)), under[new]]), np.concatenate([over, np.flatnonzero(new)])


def last_of_group(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Whether a group ends with a token: tokens of both sides end there."""
    ends = np.zeros((2, int(a.end[-1]) + 1 if len(a.end) else 1), bool)
    ends[0, a.end] = ends[1, b.end] = True
    return ends[1, a.end], ends[0, b.end]


@lru_cache(maxsize=2)
def _spellings(n: int) -> pa.Array:
    """id and what follows it in a group's text: a comma, the bar behind the last id of A, the semicolon behind the last of B."""
    return pa.array([f"{i}{s}" for i in range(n) for s in ",|;"], pa.string())


def spelled(a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray) -> list[bytes]:
    """By text, its groups: a1,a2|b1;a3|b2,b3."""
    n = max(a.ids.max(initial=0), b.ids.max(initial=0)) + 1
    # A group's tokens of A stand before its tokens of B: behind all of B's of earlier groups, before those of its own.
    ends_a, ends_b = np.append(0, np.flatnonzero(last_a) + 1), np.append(0, np.flatnonzero(last_b) + 1)
    at_a = np.arange(len(last_a)) + ends_b[np.cumsum(last_a) - last_a]
    at_b = np.arange(len(last_b)) + ends_a[np.cumsum(last_b) - last_b + 1]
    what, doc = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.int64)
    what[at_a], what[at_b] = a.ids * 3 + last_a, b.ids * 3 + 2 * last_b
    doc[at_a], doc[at_b] = a.doc, b.doc
    out = _spellings(int(n)).take(pa.array(what))
    ends = np.frombuffer(out.buffers()[1], np.int32)[: len(what) + 1]
    data = out.buffers()[2].to_pybytes()
    cuts = ends[np.searchsorted(doc, np.arange(len(a.counts) + 1))]
    return [data[x : y - 1] if y > x else b"" for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


#: A batch: its documents as packed columns; pairs by document (gaps) and how often each document links them; distinct pairs with how many of its documents have them.
BATCHES = "batch long, docs binary, counts binary, shas array<string>, sizes binary, gaps binary, times binary, pairs array<long>, holders array<long>"
_BATCHES = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("shas", pa.list_(pa.string())), ("sizes", pa.binary()), ("gaps", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
#: n_a, n_b, n_groups, n_links.
COUNTS = 4


def batch_of_texts(ids: np.ndarray, texts: list[str | None], a: ByteLevel, b: Pieces) -> dict:
    """A row of BATCHES but its number."""
    cuts = [[s.encode(t) if t else [] for t in texts] for s in (a, b)]
    whole = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    left, right = (Side(x, s.tokens) for x, s in zip(cuts, (a, b), strict=True))
    kept = [x == y == w for x, y, w in zip(left.joined(), right.joined(), whole, strict=True)]
    if not all(kept):
        left, right = (Side([x if k else [] for x, k in zip(c, kept, strict=True)], s.tokens) for c, s in zip(cuts, (a, b), strict=True))
    i, j = aligned(left, right)
    last_a, last_b = last_of_group(left, right)
    shas = [hashlib.sha256(s).hexdigest() if s else "" for s in spelled(left, right, last_a, last_b)]
    n = len(texts)
    per_doc = lambda doc: np.bincount(doc, minlength=n)
    n_groups = per_doc(left.doc[last_a])
    # A document's links, then the next one's: 38 bits of pair below the document's number.
    links = np.sort(left.doc[i] << PAIR_BITS | left.ids[i] << B_BITS | right.ids[j])
    doc, pair = links >> PAIR_BITS, links & ((1 << PAIR_BITS) - 1)
    first = np.flatnonzero(np.append(True, links[1:] != links[:-1])[: len(links)])
    held, at = np.unique(pair[first], return_inverse=True)
    sizes = per_doc(doc[first])
    place = at.astype(np.int64)  # of a document's pairs among the batch's, ascending in each document
    gaps = np.diff(place, prepend=0)
    starts = np.cumsum(sizes) - sizes
    begin = starts[sizes > 0]
    gaps[begin] = place[begin]
    return {
        "docs": planes(ids.astype(np.int64).view(np.uint64), 8), "counts": np.stack([left.counts, right.counts, n_groups, per_doc(doc)]).astype("<i8").tobytes(), "shas": shas,
        "sizes": planes(sizes, 4), "gaps": planes(gaps, 4), "times": planes(np.diff(first, append=len(pair)), 4), "pairs": held, "holders": np.bincount(at, minlength=len(held)),
    }


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ALIGNED = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def align(docs: DataFrame, a_path: str = f"{FOLDER}/byte_bpe_50k.json", b_path: str = f"{FOLDER}/piece_bpe_32k.model", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """ALIGNED: by document its tokens, groups and links, and how common its links are in the corpus."""
    batches, counts = linked(docs, a_path, b_path, batch_bytes)
    asked = batches.select("batch", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").groupBy("batch").agg(F.collect_list(F.struct("at", "n", "best")).alias("told"))

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in rows for r in (b.slice(i, 1) for i in range(b.num_rows))):
            v = {c: r.column(c) for c in r.schema.names}
            get = lambda c: v[c][0].as_py() or b""  # noqa: E731, B023
            ids, sizes = unplanes(get("docs"), 8).view(np.int64), unplanes(get("sizes"), 4).astype(np.int64)
            gaps, times = unplanes(get("gaps"), 4).astype(np.int64), unplanes(get("times"), 4).astype(np.int64)
            of = np.repeat(np.arange(len(ids)), sizes)
            run, start = np.cumsum(gaps), np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = run - (run[start] - gaps[start])
            t = v["told"].flatten()
            n, best = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
            if len(t):
                at = t.field("at").to_numpy()
                n[at], best[at] = t.field("n").to_numpy(), t.field("best").to_numpy(zero_copy_only=False)
            total = lambda x: np.array([s for s in np.add.reduceat(np.append(x, 0), np.cumsum(sizes) - sizes)]) * (sizes > 0) if len(ids) else np.zeros(0, np.int64)  # noqa: E731, B023
            n_best, count_sum = total(times * best[place]), total(times * n[place])
            four = np.frombuffer(get("counts"), "<i8").reshape(COUNTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, four), pa.array(n_best), pa.array(count_sum), v["shas"].flatten()], schema=_ALIGNED)

    return batches.select("batch", "docs", "counts", "shas", "sizes", "gaps", "times").join(told, "batch", "left").mapInArrow(summed, ALIGNED)


def linked(docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """BATCHES, written; and by pair (A's id, then B_BITS of B's) n, the documents that hold it linked, and best, whether no pair of its A id has more."""

    def cut_both(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in rows:
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < batch_bytes):
                    size += len(texts[end] or "")
                    end += 1
                row = batch_of_texts(ids[at:end], texts[at:end], a, b)
                yield pa.RecordBatch.from_pylist([{"batch": number, **row}], schema=_BATCHES)
                number, at = number + 1, end

    batches = cut(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_both, BATCHES))
    counts = batches.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n")).withColumn("a", F.shiftright("pair", B_BITS))
    counts = cut(counts)
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return batches, counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
