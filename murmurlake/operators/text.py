"""Text for speech: punctuation, sentences, words, stress, tokens."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..functions.windows import running, shard_of

#: What an empty text becomes, replacements in order, and signs that end a sentence.
EMPTY = "You need to add some text for me to talk."
REPLACED = [("...", ", "), ("…", ", "), (":", ","), (" - ", ", "), (";", ", "), ("—", "-"), ("–", "-"), (" ,", ","), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")]
ENDERS = [".", "!", "?", "-", ",", "、", "，", "。", "？", "！"]
VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ"
#: What else than letters of the two alphabets, digits and white space is supported, and what no space stands before.
SIGNS = "—.,!?:;\"'(){}[]«»„-"
PUNCTUATION = "!\"#$%&'()*,./:;<=>?@[\\]^_`{|}"
_SPACE = r"[\t\n\x0B\f\r\x85\p{Z}]"
_WORD = r"[\p{L}\p{M}\p{N}_]"


def punc_norm(text: Column) -> Column:
    x = F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))
    x = F.trim(F.regexp_replace(x, _SPACE + "+", " "))
    for a, b in REPLACED:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.rtrim(x)
    ends = F.right(x, F.lit(1)).isin(ENDERS)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, EMPTY).otherwise(F.when(ends, x).otherwise(F.concat(x, F.lit("."))))


def split_sentences(texts: DataFrame) -> DataFrame:
    """id, idx, sentence, sep: cut at white space after . ! or ?; sep is that white space, so that all joined give the text."""
    space = rf"(?<=[.!?]){_SPACE}+"
    x = texts.select("id", F.split("text", space).alias("s"), F.regexp_extract_all("text", F.lit(rf"({space})"), F.lit(1)).alias("w"))
    # White space that ends a text ends its last sentence; nothing follows it.
    return x.select("id", "w", F.posexplode("s").alias("idx", "sentence")).where("sentence <> ''").select("id", "idx", "sentence", F.coalesce(F.get("w", F.col("idx")), F.lit("")).alias("sep"))


def split_words(sentences: DataFrame) -> DataFrame:
    """id, idx, word, before, after: words (with + marks inside) and runs of signs, the text before each, and what follows the last."""
    word = rf"{_WORD}+(?:\+{_WORD}+)*|\+{_WORD}+(?:\+{_WORD}+)*|[^\p{{L}}\p{{M}}\p{{N}}_\s]+"
    parts = [F.regexp_extract_all("sentence", F.lit(rf"(?s)(\s*)({word})"), F.lit(k)).alias(n) for n, k in (("w", 2), ("b", 1))]
    x = sentences.select("id", *parts, F.regexp_extract("sentence", r"(\s*)$", 1).alias("rest"))
    x = x.select("id", "rest", F.size("w").alias("n"), F.posexplode(F.arrays_zip("w", "b")).alias("idx", "z"))
    return x.select("id", "idx", F.col("z.w").alias("word"), F.col("z.b").alias("before"), F.when(F.col("idx") == F.col("n") - 1, F.col("rest")).otherwise("").alias("after"))


def _class(signs: str) -> str:
    return "".join("\\" + c if c in "\\[]^-" else c for c in signs)


def supported(text: Column) -> Column:
    """Without characters that the accent models don't know."""
    return F.regexp_replace(text, rf"[^a-zA-Z0-9\sа-яА-ЯёЁ{_class(SIGNS)}]", "")


def close_up(text: Column) -> Column:
    """No space before punctuation and none around -; then ~ becomes -."""
    x = F.regexp_replace(text, rf" ([{_class(PUNCTUATION)}])", "$1")
    for a, b in ((" -", "-"), ("- ", "-"), (" -", "-"), ("~", "-")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def clean_text(text: Column) -> Column:
    return close_up(supported(text))


#: Entries of a dictionary, and characters of their words, that go to every task; a larger one is joined by a shuffle.
MOST_ENTRIES, MOST_LETTERS = 500_000, 16_000_000
#: Letters of a frequent word at most.
FREQUENT_LETTERS = 32


def _frequent(words: DataFrame) -> DataFrame | None:
    """plain: the most frequent words, at most half of MOST_ENTRIES; none if as many words as that are equally frequent."""
    seen = settle(words.where(F.length("plain") <= FREQUENT_LETTERS).groupBy("plain").agg(F.count("*").alias("n")).where("n > 1"))
    total, least = 0, None
    # A row for each different count, and most counts are small.
    for n, c in seen.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += c
        if total > MOST_ENTRIES // 2:
            break
        least = n
    return None if least is None else seen.where(F.col("n") >= least).select("plain")


def _explained(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words (word, ...) with plain, their lower case, and what a dictionary (plain, and others) says of them, or null.

    A dictionary of a bounded size goes to every task. Of a larger one, what it says, or doesn't, of the most frequent words does; only other words,
    a small part of a text, are shuffled.
    """
    d, x = settle(dictionary), words.withColumn("plain", F.lower("word"))
    n, letters = d.agg(F.count("*"), F.coalesce(F.sum(F.length("plain")), F.lit(0))).first()
    if n <= MOST_ENTRIES and letters <= MOST_LETTERS:
        return x.join(F.broadcast(d), "plain", "left")
    often = _frequent(x)
    if often is None:
        return x.join(d, "plain", "left")
    y = x.join(F.broadcast(often.join(d, "plain", "left").withColumn("__often", F.lit(True))), "plain", "left")
    near = F.col("__often").isNotNull() | F.col("plain").isNull()
    return y.where(near).drop("__often").unionByName(y.where(~near).select(*x.columns).join(d, "plain", "left"))


def restore_accents(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words (id, idx, word) with accented spelling from dictionary (plain, accented); capitals stay, marked words are left."""
    x = _explained(words, dictionary)
    letters = F.split("accented", "")
    at = lambda i: F.size(F.filter(F.slice(letters, 1, i), lambda c: c != "+"))
    kept = F.array_join(F.transform(letters, lambda c, i: F.when((c != "+") & (F.substr(F.col("word"), at(i) + 1, F.lit(1)) != F.lower(F.substr(F.col("word"), at(i) + 1, F.lit(1)))), F.upper(c)).otherwise(c)), "")
    same = F.length(F.replace(F.col("accented"), F.lit("+"), F.lit(""))) == F.length("word")
    return x.select("id", "idx", F.when(F.col("accented").isNull() | F.contains(F.col("word"), F.lit("+")), F.col("word")).when(~same | (F.col("word") == F.lower("word")), F.col("accented")).when(same, kept).otherwise(F.col("accented")).alias("word"))


def like_capitals(word: Column, target: Column) -> Column:
    """target with each letter's case as word has it, where both are as long; else target as it is."""
    at = lambda i: F.substr(word, i + 1, F.lit(1))
    letters = F.transform(F.split(target, ""), lambda c, i: F.when(at(i) != F.lower(at(i)), F.upper(c)).otherwise(F.lower(c)))
    small = (word == F.lower(word)) & (target == F.lower(target))
    return F.when(F.coalesce(small | (F.length(word) != F.length(target)), F.lit(True)), target).otherwise(F.array_join(letters, ""))


def restore_tagged(words: DataFrame, dictionary: DataFrame, doubtful: DataFrame, tags: DataFrame | None = None, tag: str = "YO") -> DataFrame:
    """words (id, idx, word) restored in two steps: by dictionary (plain, restored); then, where tags (id, idx, tag) say `tag`, by what doubtful (plain, restored) has instead, or as the word was. Case is the word's.

    Words that come with their tag, as a column, need no tags, and no join by place.
    """
    none = F.lit(None).cast("string")
    both = dictionary.select("plain", F.col("restored").alias("sure"), none.alias("other")).unionByName(doubtful.select("plain", none.alias("sure"), F.col("restored").alias("other")))
    entries = both.groupBy("plain").agg(F.min("sure").alias("sure"), F.min("other").alias("other"))
    if tags is None:
        told = words.select("id", "idx", "word", (F.col("tag") == tag).alias("told"))
    else:
        told = words.join(tags.where(F.col("tag") == tag).select("id", "idx").distinct().withColumn("told", F.lit(True)), ["id", "idx"], "left")
    # Words are dealt by place before they get what dictionaries say of them, so that is never shuffled.
    x, word = _explained(told, entries), F.col("word")
    return x.select("id", "idx", like_capitals(word, F.when(F.col("told"), F.coalesce("other", word)).otherwise(F.coalesce("sure", word))).alias("word"))


def char_ids(text: Column, vocab: dict[str, int]) -> Column:
    """Ids of a text's characters between [bos] and [eos]; those that the vocabulary lacks are [unk]. A character is what is seen as one, its marks included."""
    if len(vocab) > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} characters")
    special = {t: vocab.get(t, i) for i, t in enumerate(("[pad]", "[unk]", "[bos]", "[eos]"))}
    ids = F.create_map(*[F.lit(v) for p in vocab.items() for v in p]) if vocab else F.lit(None).cast("map<string,int>")
    each = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\X"), F.lit(0)), lambda c: F.coalesce(ids[c], F.lit(special["[unk]"])).cast("int"))
    return F.concat(F.array(F.lit(special["[bos]"]).cast("int")), F.coalesce(each, F.array().cast("array<int>")), F.array(F.lit(special["[eos]"]).cast("int")))


def carry_groups(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """id, grp, words: the groups of group_words over other words (id, idx from 0, word) of the same places; a group beyond the last of these has none."""
    place = groups.where(F.size("words") > 0).select("id", "grp", F.explode(F.sequence(F.col("grp"), F.col("grp") + F.size("words") - 1)).alias("idx"))
    x = place.join(targets.select("id", "idx", "word"), ["id", "idx"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("idx", "word"))))
    return x.groupBy("id", "grp").agg(F.transform(found, lambda s: s["word"]).alias("words"))


def homograph_candidates(words: DataFrame, homographs: DataFrame, around: int = 50) -> DataFrame:
    """id, idx, variant, context: one row for each variant of a known word, the word marked among `around` words on either side.

    A hit reaches the words around it by its place, so what a long text costs grows with its hits.
    """
    hit = _explained(words, homographs).where("variants IS NOT NULL").select("id", "idx", "variants")
    block = F.floor(F.col("idx") / around)
    near = hit.select("id", F.col("idx").alias("at"), "variants", F.explode(F.sequence(block - 1, block + 1)).alias("block"))
    x = near.join(words.select("id", block.alias("block"), "idx", "word"), ["id", "block"]).where(F.abs(F.col("idx") - F.col("at")) <= around)
    marked = F.when(F.col("idx") == F.col("at"), F.concat(F.lit("<w>"), "word", F.lit("</w>"))).otherwise(F.col("word"))
    g = x.groupBy("id", F.col("at").alias("idx")).agg(F.first("variants").alias("variants"), F.array_sort(F.collect_list(F.struct("idx", marked.alias("word")))).alias("line"))
    return g.select("id", "idx", F.explode("variants").alias("variant"), F.array_join(F.transform("line", lambda s: s["word"]), " ").alias("context"))


def choose(scored: DataFrame) -> DataFrame:
    """The best scored variant of each place (ties: the first by spelling)."""
    return scored.groupBy("id", "idx").agg(F.min(F.struct((-F.col("score")).alias("less"), "variant"))["variant"].alias("variant"))


def stress_marks(text: Column) -> Column:
    """A + before a vowel becomes the vowel with a combining acute; every other + goes."""
    return F.replace(F.regexp_replace(text, rf"\+([{VOWELS}])", "$1́"), F.lit("+"), F.lit(""))


def group_words(words: DataFrame, special: DataFrame | None = None, shard: int = 10_000) -> DataFrame:
    """id, grp, words: consecutive words alike but for +. Of runs of over three, those of special words (base) are cut into threes, and even ones into twos."""
    x = words.withColumn("base", F.replace("word", F.lit("+"), F.lit("")))
    y = x.select("id", (F.col("idx") + 1).alias("idx"), F.col("base").alias("prior"))
    x = x.join(y, ["id", "idx"], "left").withColumn("new", (~F.col("base").eqNullSafe(F.col("prior"))).cast("long"))
    x = running(x, ["id"], ["idx"], shard_of("idx", shard), {"run": ("sum", "new", True)})
    sizes = x.groupBy("id", "run").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.first("base").alias("base"))
    known = sizes.withColumn("special", F.lit(False)) if special is None else sizes.join(special.select("base", F.lit(True).alias("special")).distinct(), "base", "left")
    step = F.when(F.col("n") <= 3, F.col("n")).when(F.coalesce("special", F.lit(False)), 3).when(F.col("n") % 2 == 0, 2).otherwise(F.col("n"))
    x = x.drop("base").join(known.select("id", "run", "first", step.alias("step")), ["id", "run"])
    x = x.withColumn("part", F.floor((F.col("idx") - F.col("first")) / F.col("step"))).groupBy("id", "run", "part")
    return x.agg(F.min("idx").alias("grp"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"]).alias("words")).select("id", "grp", "words")


# ---------------------------------------------------------------- tokens


def bpe(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pieces of a word: again and again, the known pair of lowest rank is merged wherever it stands."""
    parts = list(word)
    while True:
        best = min((p for p in zip(parts, parts[1:], strict=False) if p in ranks), key=ranks.__getitem__, default=None)
        if best is None:
            return parts
        merged: list[str] = []
        for c in parts:
            # The right half of a pair joins a left half that isn't yet part of one.
            if merged and (merged[-1], c) == best:
                merged[-1] = merged[-1] + c + "\0"
            else:
                merged.append(c)
        parts = [m.rstrip("\0") for m in merged]


class WordPieces:
    """Longest pieces from the left, ## before all but the first; a character that starts no piece is unknown by itself, as is a word that is too long.

    Pieces are a tree of letters for a word's beginning and one for what follows. A node that a word can't leave by its next
    letter says which pieces its letters are cut into as far as that is sure, and at which node the rest of them stands; so no
    letter is read twice, and a word costs its length.
    """

    def __init__(self, vocab: Iterable[str], unknown: str = "[UNK]", longest: int = 100):
        self.unknown, self.longest = unknown, longest
        self.next: list[dict[str, int]] = [{}, {}]  # a word's beginning, what follows
        piece: dict[int, str] = {}

        def add(root: int, letters: str, name: str) -> None:
            at = root
            for c in letters:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            piece.setdefault(at, name)

        for p in vocab:
            if p:
                add(0, p, p)
            if p.startswith("##") and len(p) > 2:
                add(1, p[2:], p)
        # A letter that begins pieces but is none is unknown by itself.
        for root in (0, 1):
            for at in self.next[root].values():
                piece.setdefault(at, unknown)
        self.cut: list[tuple[str, ...]] = [()] * len(self.next)
        self.rest = [1] * len(self.next)
        level = [(at, c, root) for root in (0, 1) for c, at in self.next[root].items()]
        while level:
            following = []
            for at, c, above in level:
                if at in piece:
                    self.cut[at], self.rest[at] = (piece[at],), 1
                else:
                    done, stand = list(self.cut[above]), self.rest[above]
                    while c not in self.next[stand] and stand != 1:
                        done += self.cut[stand]
                        stand = self.rest[stand]
                    if c in self.next[stand]:
                        stand = self.next[stand][c]
                    else:
                        done.append(unknown)
                    self.cut[at], self.rest[at] = tuple(done), stand
                following += [(to, d, at) for d, to in self.next[at].items()]
            level = following

    def __call__(self, word: str) -> list[str]:
        if len(word) > self.longest:
            return [self.unknown]
        out, at = [], 0
        for c in word:
            while c not in self.next[at]:
                if at < 2:
                    out.append(self.unknown)
                    at = 1
                    break
                out += self.cut[at]
                at = self.rest[at]
            else:
                at = self.next[at][c]
        while at > 1:
            out += self.cut[at]
            at = self.rest[at]
        return out


#: Pieces of a vocabulary at most: it goes to every worker.
MOST_PIECES = 2_000_000
_CUTTERS: dict[str, Callable[[str], list[str]]] = {}
#: Bytes of words that a worker cuts at once, in whole texts, and how many words of at most how many letters it keeps the ids of.
CUT_BYTES, KEPT_WORDS, KEPT_LETTERS = 1 << 20, 1 << 16, 64


def _cut(texts: DataFrame, make: Callable[[], Callable[[str], list[str]]], vocab: dict[str, int], unknown: str, offsets: bool = False) -> DataFrame:
    """texts (words, and others, which stay) with the ids of each text's words instead of them. Texts stay where they are: nothing is shuffled or sorted, and a worker holds few texts at a time.

    `make` makes once in a worker what cuts a word; the vocabulary goes to every worker once. Different words of CUT_BYTES are
    cut once, frequent ones once in a task. With offsets: start, end, is_subword of each piece; words have their `sizes`, and a place between them.
    """
    if len(vocab) > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} pieces")
    shared, name = texts.sparkSession.sparkContext.broadcast((make, vocab)), uuid.uuid4().hex
    kept = [c for c in texts.columns if c not in ("words", "sizes")]
    form = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("is_subword", pa.bool_())])

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole texts of CUT_BYTES or somewhat more."""
        ends = np.append(0, np.cumsum(batch["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        size, at = np.append(0, np.cumsum(pc.binary_length(batch["words"].flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 4))[ends], 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(size, size[at] + CUT_BYTES)))
            yield batch.slice(at, end - at)
            at = end

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build, known = shared.value
        if name not in _CUTTERS:
            _CUTTERS.clear()
            _CUTTERS[name] = build()
        f, none = _CUTTERS[name], known.get(unknown, 0)
        once = lambda w: np.array([known.get(p, none) for p in f(w)], np.int32)
        often = lru_cache(KEPT_WORDS)(once)
        for batch in (p for b in it for p in parts(b)):
            words = batch["words"].flatten()
            ends = np.append(0, np.cumsum(batch["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            coded = words.dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            pieces = [often(w) if len(w) <= KEPT_LETTERS else once(w) for w in coded.dictionary.to_pylist()]
            n = np.array([len(x) for x in pieces], np.int64)[which] if len(which) else np.zeros(0, np.int64)
            borders = pa.array(np.append(0, np.cumsum(n))[ends].astype(np.int32))
            ids = np.concatenate([pieces[k] for k in which]) if len(which) else np.zeros(0, np.int32)
            out = {**{c: batch[c] for c in kept}, "ids": pa.ListArray.from_arrays(borders, pa.array(ids, pa.int32()))}
            if offsets:
                size = batch["sizes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                run = np.append(0, np.cumsum(size + 1))
                start = run[:-1] - np.repeat(run[ends[:-1]], np.diff(ends))
                later = np.ones(len(ids), bool)
                later[(np.cumsum(n) - n)[n > 0]] = False
                spans = [pa.array(np.repeat(x, n).astype(np.int32)) for x in (start, start + size)]
                out["offsets"] = pa.ListArray.from_arrays(borders, pa.StructArray.from_arrays([*spans, pa.array(later)], fields=list(form)))
            yield pa.RecordBatch.from_pydict(out)

    own = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.mapInArrow(cut, f"{own}, ids array<int>" + ", offsets array<struct<start:int,end:int,is_subword:boolean>>" * offsets)


def bpe_or_whole(ranks: dict[tuple[str, str], int], special: frozenset[str]) -> Callable[[str], list[str]]:
    return lambda word: [word] if word in special else bpe(word, ranks)


def tokenize_bpe(texts: DataFrame, vocab: dict[str, int], ranks: dict[tuple[str, str], int], special: list[str], unknown: str = "[UNK]", lang: str | None = None, lower: bool = True, nfkd: bool = True) -> DataFrame:
    """id, ids, n of each row: lower case, NFKD, [lang] before and [SPACE] for each space; special tokens stay whole, what is between them is merged by rank."""

    @F.pandas_udf("string")
    def plain(text: pd.Series) -> pd.Series:
        text = text.str.lower() if lower else text
        return text.str.normalize("NFKD") if nfkd else text

    prefix = F.lit(f"[{lang.lower()}]" if lang else "")
    x = texts.select("id", F.concat(prefix, F.replace(plain(F.coalesce("text", F.lit(""))), F.lit(" "), F.lit("[SPACE]"))).alias("text"))
    names = "|".join("".join(c if c.isalnum() else "\\" + c for c in t) for t in sorted(special, key=len, reverse=True))
    pieces = F.filter(F.split("text", f"(?={names})|(?<={names})") if special else F.array("text"), lambda p: p != "")
    return _cut(x.select("id", pieces.alias("words")), partial(bpe_or_whole, ranks, frozenset(special)), vocab, unknown).withColumn("n", F.size("ids"))


def _pieces(texts: DataFrame, column: str, vocab: dict[str, int], unknown: str, offsets: bool = False) -> DataFrame:
    """texts with ids, and offsets (start, end, is_subword), of a column's words instead of it; spaces part words. Where a word starts follows from the lengths before it."""
    own = F.split(F.coalesce(column, F.lit("")), " ")
    x = texts.withColumns({"words": F.transform(own, F.lower)} | ({"sizes": F.transform(own, F.length)} if offsets else {})).drop(column)
    return _cut(x, partial(WordPieces, tuple(vocab), unknown), vocab, unknown, offsets)


def tokenize_wordpiece(texts: DataFrame, vocab: dict[str, int], longest: int, unknown: str = "[UNK]") -> DataFrame:
    """id, ids, mask, type_ids, offsets of texts (id, text, and pair, if there is one).

    CLS, the text's pieces, SEP, and the pair's with SEP (type 1); cut to `longest` with a SEP at the end, or padded. Offsets
    are those of the text's words, one for each piece, whatever was cut.
    """
    cls, sep, pad = vocab.get("[CLS]", 101), vocab.get("[SEP]", 102), vocab.get("[PAD]", 0)
    none = F.array().cast("array<int>")
    second = none
    x = texts.select("id", "text", *(["pair"] if "pair" in texts.columns else []))
    x = _pieces(x, "text", vocab, unknown, True).withColumnRenamed("ids", "own")
    if "pair" in texts.columns:
        x = _pieces(x.withColumn("paired", F.col("pair").isNotNull()), "pair", vocab, unknown)
        second = F.when(F.col("paired"), F.concat("ids", F.array(F.lit(sep)))).otherwise(none)
    x = x.select("id", F.concat(F.array(F.lit(cls)), "own", F.array(F.lit(sep))).alias("first"), second.alias("second"), "offsets")
    whole = F.concat("first", "second")
    n = F.least(F.size(whole), F.lit(longest))
    kept = F.when(F.size(whole) > longest, F.concat(F.slice(whole, 1, longest - 1), F.array(F.lit(sep)))).otherwise(whole)
    fill = F.greatest(F.lit(0), longest - n)
    types = F.slice(F.concat(F.array_repeat(F.lit(0), F.size("first")), F.array_repeat(F.lit(1), F.size("second"))), 1, longest)
    return x.select("id", F.concat(kept, F.array_repeat(F.lit(pad), fill)).alias("ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)).alias("mask"), F.concat(types, F.array_repeat(F.lit(0), fill)).alias("type_ids"), "offsets")


def prompt_of(text: str, source: str, target: str, template: str, names: dict[str, str]) -> str:
    """A template's {text}, {source}, {target}, {source_name} and {target_name} filled in; a language without a name is its code. What a text holds in braces stays."""
    parts = {"{source}": source, "{target}": target, "{source_name}": names.get(source, source), "{target_name}": names.get(target, target), "{text}": text}
    return re.sub("|".join(map(re.escape, parts)), lambda m: parts[m[0]], template)


def translate_batch(texts: DataFrame, source: str | None, target: str | None, fn: Callable[[list[str], str, str], list[str]], pairs: set[tuple[str, str]], template: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """id, text, translated, supported: each different text of a pair is translated once; unsupported pairs are flagged, null texts stay null.

    Without source or target they are columns of texts, and each row has a pair of its own. With a template fn gets prompts.
    """
    codes = {"source": F.col("source") if source is None else F.lit(source), "target": F.col("target") if target is None else F.lit(target)}
    known = F.array(*[F.concat_ws("\0", F.lit(a), F.lit(b)) for a, b in sorted(pairs)]) if pairs else F.array().cast("array<string>")
    x = texts.select("id", "text", *(c.alias(f"__{k}") for k, c in codes.items()))
    x = x.withColumn("supported", F.coalesce(F.array_contains(known, F.concat(F.col("__source"), F.lit("\0"), F.col("__target"))), F.lit(False)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for (a, b), part in pdf.groupby(["__source", "__target"]):
                given = part["text"].tolist()
                yield part.assign(translated=fn([prompt_of(t, a, b, template, names or {}) for t in given] if template else given, a, b))

    keys = ["text", "__source", "__target"]
    done = x.where("supported AND text IS NOT NULL").select(*keys).distinct().mapInPandas(run, "text string, __source string, __target string, translated string")
    return x.join(done, keys, "left").select("id", "text", "translated", "supported")
