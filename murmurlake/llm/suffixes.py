"""Deduplication of byte strings with suffix arrays built by linear grouping.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Documents are
never joined to each other: strings meet by their anchors.

1. The anchor of a string is the smallest hash among its substrings of half its length. It depends on nothing but the
   string, and consecutive strings of a text mostly have the same one, so a text becomes runs: an anchor and the bytes
   that the run's strings cover, its context. Anchors and contexts are exchanged as hashes, packed by bucket.
2. Where an anchor occurs in one document only, its strings can't be repeated elsewhere. Of equal contexts, which repeat
   all their strings, the smallest document keeps its own; the others lose theirs.
3. Contexts of one anchor that differ share some of their strings at most. One of each goes, as bytes, to its anchor's
   bucket; their ends that can't match, by the hashes of their strings, are cut off, and a suffix array of what is left
   brings equal strings together; those that also start in a smaller document are removed. An anchor of more than HOT different contexts, like that of a passage in very many documents,
   is dealt by the hash of each string instead, so that no bucket grows with it.

The suffix array (suffix_array below) is built in two phases. Suffixes are grouped by first byte; groups are processed
in descending order, each suffix pointing to the nearest one before it in a lower group, and the suffixes pointed to,
parted by how many pointers they get and by group, become new groups right above their old ones, until every group holds
the suffixes of one Lyndon prefix. Then, in ascending order, each suffix places the one before it and those along its
pointers at the next free place of their groups. Nothing is renamed and nothing recurses.

Defined results: null text is empty; texts shorter than `length` lose nothing; rows that repeat a doc_id are not smaller
than each other and keep what they share; kept_sha256 of nothing is that of the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ANSWERS, PACKED, PACKED_ARROW, PLACES, answers, batch_of, bucket_of, buckets_for, by_bucket, chunks, covered, documents, factors, merged_answers, mix, pack, passed_on, read_places, table, text_bytes, told_apart, unpack

LENGTH = 50
HOT = 1000
#: Bytes of contexts in one suffix array, unless one anchor has more.
TOGETHER = 50_000
SEED = 6


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes. The last number of text is smaller than all others."""
    n = len(text)
    number: dict[int, int] = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in number]
    for s, k in enumerate(group):
        members[k].append(s)
    size = [len(m) for m in members]
    below = list(range(-1, len(number) - 1))
    above = list(range(1, len(number))) + [-1]
    done = [False] * len(number)
    previous = [-1] * n
    descending = []
    k = len(number) - 1
    while k >= 0:
        done[k] = True
        descending.append(k)
        own = members[k]
        if len(own) == 1:
            s = own[0]
            j = s - 1
            while j >= 0 and done[group[j]]:
                j = previous[j]
            previous[s] = j
            # A subset that is all that is left of its group would only trade places with an empty one.
            if j >= 0 and size[group[j]] > 1:
                parted = {1: {group[j]: [j]}}
            else:
                k = below[k]
                continue
        else:
            pointed: list[int] = []  # ascending, as pointers never cross
            times: list[int] = []
            last = -1
            most = 1
            for s in own:
                if group[s] != k:
                    continue
                j = s - 1
                while j >= 0 and done[group[j]]:
                    j = previous[j]
                previous[s] = j
                if j >= 0:
                    if j == last:
                        times[-1] += 1
                        most = 2
                    else:
                        pointed.append(j)
                        times.append(1)
                        last = j
            parted = {}
            if most == 1:
                by_group = parted[1] = {}
                for j in pointed:
                    g = group[j]
                    if g in by_group:
                        by_group[g].append(j)
                    else:
                        by_group[g] = [j]
            else:
                for j, m in zip(pointed, times, strict=True):
                    parted.setdefault(m, {}).setdefault(group[j], []).append(j)
        for m in sorted(parted, reverse=True):
            for old, suffixes in parted[m].items():
                if len(suffixes) == size[old]:
                    continue
                new = len(members)
                members.append(suffixes)
                size.append(len(suffixes))
                size[old] -= len(suffixes)
                done.append(False)
                for j in suffixes:
                    group[j] = new
                up = above[old]
                above[old] = new
                above.append(up)
                below.append(old)
                if up >= 0:
                    below[up] = new
        k = below[k]
    start = [0] * len(members)
    at = 0
    for k in reversed(descending):
        start[k] = at
        at += size[k]
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            k = group[j]
            order[start[k]] = j
            start[k] += 1
            placed[j] = True
            j = previous[j]
    return order


_BASE = 0xD6E8FEB86659FD93


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse; kept in the worker, as long as its longest chunk."""
    if not _POWERS or len(_POWERS[0]) <= n:
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([one, np.full(n + n // 8, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def prefix_hashes(text: bytes):
    """A function of places a and b that gives the hashes of the bytes between them."""
    n = len(text)
    power, inverse = powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(factors(256, SEED)[np.frombuffer(text, np.uint8)] * power[:n])])

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))

    return of


class Runs:
    """Some texts as bytes, and the runs of strings of one anchor: first and last start, the anchor's and context's hash."""

    def __init__(self, texts: list[bytes], length: int, contexts: bool = True):
        self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.text = b"".join(texts)
        self.length = length
        k = length // 2
        n = len(self.text)
        self.first = self.last = np.zeros(0, np.int64)
        self.anchor = self.context = np.zeros(0, np.uint64)
        if n < length:
            return
        value = factors(256, SEED)[np.frombuffer(self.text, np.uint8)]
        h = self.combined(value, k, lambda a, b, step: a * factors(step, SEED)[-1] + b)
        h = mix(h)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        low = self.combined(key, length - k + 1, lambda a, b, step: np.minimum(a, b))
        starts = np.flatnonzero(self.owner[: n - length + 1] == self.owner[length - 1 :])
        if not len(starts):
            return
        anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
        self.first, self.last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        self.anchor = h[anchor[new]]
        if contexts:
            self.context = prefix_hashes(self.text)(self.first, self.last + length)

    @staticmethod
    def combined(x: np.ndarray, n: int, f) -> np.ndarray:
        """f over each n consecutive numbers, by doubling."""
        out, have, power, step = None, 0, x, 1
        with np.errstate(over="ignore"):
            while True:
                if n & step:
                    part = power[: len(x) - n + 1] if out is None else power[have : have + len(x) - n + 1]
                    out = part if out is None else f(out, part, step + 64)
                    have += step
                if 2 * step > n:
                    return out
                power = f(power[: len(power) - step], power[step:], step)
                step *= 2


EQUAL, DIFFERENT, SPREAD = 1, 2, 3


def matched(strings: list[tuple[int, bytes, int]], length: int) -> list[tuple[int, int]]:
    """(string, place) of the starts of `length` bytes that also start in a smaller document. strings: doc, bytes, starts."""
    text: list[int] = []
    of: list[int] = []
    begin: list[int] = []
    for k, (_, data, starts) in enumerate(strings):
        begin.append(len(text))
        text += (np.frombuffer(data, np.uint8).astype(np.int64) + 2).tolist()
        text.append(1)
        of += [k] * starts + [-1] * (len(data) + 1 - starts)
    text.append(0)
    of.append(-1)
    out, run, before = [], [], None
    for s in suffix_array(text):
        k = of[s]
        if k < 0:
            continue
        here = strings[k][1][s - begin[k] : s - begin[k] + length]
        if here != before:
            if len(run) > 1:
                least = min(strings[x][0] for x, _ in run)
                out += [(x, p) for x, p in run if strings[x][0] > least]
            run, before = [], here
        run.append((k, s - begin[k]))
    if len(run) > 1:
        least = min(strings[x][0] for x, _ in run)
        out += [(x, p) for x, p in run if strings[x][0] > least]
    return out


CONTEXTS = "bucket int, keys binary, ids binary, ths binary, places binary, lengths binary, blob binary, grp int"
CONTEXTS_ARROW = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("keys", "ids", "ths", "places", "lengths", "blob")), ("grp", pa.int32())])


def behind_smallest(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries have the key of one in a smaller document."""
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.zeros(len(keys), bool)
    out[order] = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(k))))
    return out


def removed_places(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts dealt by id; runs of which all strings go; single starts of strings that go. Both as PLACES."""
    docs = documents(docs)
    n = buckets_for(text_bytes(docs))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 1_000_000):
            r = Runs(texts, length)
            if len(r.first):
                ids, ths, owner = rows["doc_id"].to_numpy(), rows["th"].to_numpy(), r.owner[r.first].astype(np.int64)
                larger = behind_smallest(ids[owner], mix(r.anchor ^ mix(r.context)))
                send = ~larger
                out = list(pack(ids, ths, r, r.first[send], bucket_of(mix(r.anchor[send]), n), (r.anchor[send] & np.uint64(0xFFFFFFFF), 4), (r.context[send], 5)))
                yield batch_of(out + passed_on(answers(larger, (r.first - r.offsets[owner]) * 4 + EQUAL, owner, ids, ths, n), n), PACKED_ARROW)

    def sorted_out(group: pa.Table) -> pa.Table:
        """What each run of a repeated anchor is: EQUAL to a smaller document's, or one of several DIFFERENT ones."""
        group, done = told_apart(group)
        if not len(group):
            return done
        anchor, context, place, owner, ids, ths = unpack(group, 4, 5)
        doc = ids[owner]
        order = np.lexsort((doc, context, anchor))
        a, c, d = anchor[order], context[order], doc[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
        of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        at_a = np.flatnonzero(new_a)
        several = np.minimum.reduceat(d, at_a) < np.maximum.reduceat(d, at_a)
        contexts = np.add.reduceat(new_c.astype(np.int64), at_a)
        equal = d > d[np.flatnonzero(new_c)][of_c]
        kind = np.where(equal, EQUAL, np.where(contexts[of_a] > hot, SPREAD, np.where(contexts[of_a] > 1, DIFFERENT, 0)))
        kind[~several[of_a]] = 0
        kinds = np.zeros(len(kind), np.int64)
        kinds[order] = kind
        return pa.concat_tables([answers(kinds > 0, place * 4 + kinds, owner, ids, ths, n), done])

    def contexts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 1_000_000):
            r = Runs(texts, length, contexts=False)
            keys, begin, end, spread, hash_of = [], [], [], [], None
            for k, found in enumerate(rows["places"].to_pylist()):
                x = read_places(found)
                runs = np.searchsorted(r.first, x // 4 + r.offsets[k])
                one = runs[x % 4 == DIFFERENT]
                keys.append(r.anchor[one])
                begin.append(r.first[one])
                end.append(r.last[one] + length)
                spread.append(np.zeros(len(one), bool))
                for i in runs[x % 4 == SPREAD]:
                    hash_of = hash_of or prefix_hashes(r.text)
                    p = np.arange(r.first[i], r.last[i] + 1)
                    keys.append(hash_of(p, p + length))
                    begin.append(p)
                    end.append(p + length)
                    spread.append(np.ones(len(p), bool))
            keys, begin, end, spread = map(np.concatenate, (keys, begin, end, spread))
            ids, ths, own = rows["doc_id"].to_numpy(), rows["th"].to_numpy(), r.owner[begin].astype(np.int64)
            larger = np.zeros(len(keys), bool)
            at = np.flatnonzero(spread)
            if len(at):
                larger[at] = behind_smallest(ids[own[at]], keys[at])
            done = answers(larger, begin - r.offsets[own], own, ids, ths, n)
            keys, begin, end, own = keys[~larger], begin[~larger], end[~larger], own[~larger]
            out = passed_on(done, n, "places", "lengths")
            for b, part in by_bucket(bucket_of(mix(keys), n)):
                own_b = own[part]
                out.append({"bucket": b, "keys": keys[part].tobytes(), "ids": ids[own_b].tobytes(), "ths": ths[own_b].tobytes(), "places": (begin[part] - r.offsets[own_b]).astype(np.int64).tobytes(), "lengths": (end - begin)[part].astype(np.int64).tobytes(), "blob": b"".join(r.text[x:y] for x, y in zip(begin[part].tolist(), end[part].tolist(), strict=True))})
            if out:
                yield batch_of(out, CONTEXTS_ARROW)

    def compared(group: pa.Table) -> pa.Table:
        group, done = told_apart(group, "places", "lengths")
        rows = group.to_pylist()
        if not rows:
            return done
        keys, ids, ths, places, lengths = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("keys", np.uint64), ("ids", np.int64), ("ths", np.int64), ("places", np.int64), ("lengths", np.int64)))
        blob = b"".join(r["blob"] for r in rows)
        begin = np.cumsum(lengths) - lengths
        # What can't be sorted next to an equal string of another document is left out: equal strings have equal hashes.
        starts = lengths - length + 1
        of = np.repeat(np.arange(len(keys)), starts)
        at = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(len(of))
        h = mix(prefix_hashes(blob)(at, at + length) ^ mix(keys)[of])
        by = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[by]) != 0]))
        doc = ids[of[by]]
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        likely = np.zeros(len(of), bool)
        likely[by] = np.repeat(several, np.diff(np.append(first, len(of))))
        of, at = of[likely], at[likely]
        new = np.flatnonzero(np.diff(of, prepend=-1))
        some = of[new]
        low, high = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
        order = some[np.argsort(keys[some], kind="stable")]
        from_, until = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        from_[some], until[some] = low, high + length
        found_k, found_p, batch, size = [], [], [], 0
        key = keys[order].tolist()

        def settle() -> None:
            strings = [(int(ids[i]), blob[from_[i] : until[i]], int(until[i] - from_[i]) - length + 1) for i in batch]
            for k, p in matched(strings, length):
                found_k.append(batch[k])
                found_p.append(p + int(from_[batch[k]] - begin[batch[k]]))

        for i, x, before in zip(order.tolist(), key, [None, *key], strict=False):
            if size >= TOGETHER and x != before:
                settle()
                batch, size = [], 0
            batch.append(i)
            size += int(until[i] - from_[i])
        if batch:
            settle()
        k = np.array(found_k, np.int64)
        return pa.concat_tables([answers(np.ones(len(k), bool), places[k] + np.array(found_p, np.int64), k, ids, ths, n), done])

    texts = docs.repartition("doc_id", "th")
    told = docs.mapInArrow(runs_of, PACKED).groupBy("bucket").applyInArrow(sorted_out, ANSWERS).groupBy("grp").applyInArrow(merged_answers, PLACES)
    single = texts.join(told, ["doc_id", "th"]).select("doc_id", "th", "text", "places").mapInArrow(contexts_of, CONTEXTS).groupBy("bucket").applyInArrow(compared, ANSWERS).groupBy("grp").applyInArrow(merged_answers, PLACES)
    return texts, told, single


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for each document."""
    texts, told, single = removed_places(docs, length, hot)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 1_000_000):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            equal = [x[x % 4 == EQUAL] // 4 for x in map(read_places, rows["runs"].to_pylist())]
            some = [i for i, x in enumerate(equal) if len(x)]
            r = Runs([texts[i] for i in some], length, contexts=False)
            runs = dict(zip(some, range(len(some)), strict=True))
            for i, (t, one) in enumerate(zip(texts, rows["starts"].to_pylist(), strict=True)):
                gone = covered(len(t), read_places(one), length) if one else np.zeros(len(t), bool)
                if i in runs:
                    base = r.offsets[runs[i]]
                    at = np.searchsorted(r.first, equal[i] + base)
                    step = np.zeros(len(t) + 1, np.int64)
                    np.add.at(step, r.first[at] - base, 1)
                    np.add.at(step, r.last[at] - base + length, -1)
                    gone |= np.cumsum(step[:-1]) > 0
                out["n_bytes"].append(len(t))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                out["kept"].append(np.frombuffer(t, np.uint8)[~gone].tobytes() if i in runs or one else t)
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])

    x = texts.join(told.withColumnRenamed("places", "runs"), ["doc_id", "th"], "left").join(single.withColumnRenamed("places", "starts"), ["doc_id", "th"], "left")
    return x.select("doc_id", "text", "runs", "starts").mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE doc_id > least),
e AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z, a FROM g UNION ALL SELECT doc_id, max(z), NULL FROM g GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(CASE WHEN a IS NULL THEN substr(x, 2 * z + 1) ELSE substr(x, 2 * z + 1, 2 * (a - z)) END, '' ORDER BY z) AS x FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
