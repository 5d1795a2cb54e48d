"""Queries over text for speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..operators import text as x
from ..sources import views as v

#: A small vocabulary of whole words, endings and letters; letters that are missing make unknown pieces.
PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "to", "of", "and", "is", "in", "user", "as", "##sist", "##ant", "##s", "##ing", "##ed", "##er", "##th", *"abcdefghijklmnoprstuvw", *(f"##{c}" for c in "abcdefghilmnoprtuwy")]
MERGES = [("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("a", "n"), ("an", "d"), ("o", "n"), ("r", "e")]
TOKENS = ["[UNK]", "[SPACE]", "[en]", *"abcdefghijklmnopqrstuvwxy", *(a + b for a, b in MERGES)]
#: Characters that have an id; all others are unknown.
CHARS = {c: i for i, c in enumerate(["[pad]", "[unk]", "[bos]", "[eos]", *"abcdefghijklmnopqrstuvwxyz ,."])}
_PROMPT = "{source_name} ({source}) to {target_name} ({target}): {text}"
_NAMES = {"en": "English", "fr": "French", "de": "German"}


def _lines(s, d):
    """Spoken material: all turns of conversations."""
    return v.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("role").alias("pair"))


def _words(s, d):
    return v.table(s, d, "events").select((F.col("event_id") % 97).alias("id"), F.floor(F.col("event_id") / 97).cast("int").alias("idx"), F.when(F.col("event_id") % 5 == 0, F.initcap("event_type")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("+"), F.col("event_type"))).otherwise(F.col("event_type")).alias("word"))


def _dictionary(s, d):
    """All words of the documents of over three letters, their lengths and how often they come: what dictionaries are made of."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return v.table(s, d, "documents").select(w.alias("plain")).where("length(plain) > 3").groupBy("plain").agg(F.count("*").alias("n")).withColumn("size", F.length("plain"))


def _spoken(s, d):
    """The words of all documents, by their places."""
    return v.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[a-zA-Z+]+"), F.lit(0))).alias("idx", "word"))


def _accented(s, d):
    p = F.col("plain")
    return _dictionary(s, d).where("n % 3 > 0").select("plain", F.when(F.col("n") % 3 == 1, F.concat(F.substr(p, F.lit(1), F.lit(1)), F.lit("+"), F.substr(p, F.lit(2)))).otherwise(F.concat(p, F.lit("+s"))).alias("accented"))


def _tagged(s, d):
    """Every third word by dictionary, every second by its reverse where it is tagged."""
    known, p = settle(_dictionary(s, d)), F.col("plain")
    words = _spoken(s, d).withColumn("tag", F.when((F.col("id") + F.col("idx")) % 4 == 0, "YO").otherwise("O"))
    return x.restore_tagged(words, known.where("n % 3 = 1").select("plain", F.concat(F.lit("y"), F.substr(p, F.lit(2))).alias("restored")), known.where("size % 2 = 0").select("plain", F.reverse("plain").alias("restored")))


def _carried(s, d):
    """The groups of one list of words over a shorter one of the same places."""
    other = _runs(s, d).where("idx < id").select("id", "idx", F.concat("word", F.col("idx").cast("string")).alias("word"))
    return x.carry_groups(x.group_words(_runs(s, d), s.sql("SELECT 'view' AS base")), other).select("id", "grp", F.concat_ws(" ", "words").alias("words"))


def _told(texts: list[str], source: str, target: str) -> list[str]:
    return [f"{target}:{t}"[::-1] for t in texts]


def _translated(s, d):
    docs = v.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("source"), F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr").otherwise("xx").alias("target"))
    y = x.translate_batch(docs, None, None, _told, {("de", "en"), ("en", "fr"), ("fr", "en"), ("de", "fr")}, _PROMPT, _NAMES)
    return y.select("id", F.md5("translated").alias("translated"), "supported")


def _runs(s, d):
    """Words in runs of two, five and six."""
    n = F.floor(F.col("event_id") / 97)
    word = F.when(n % 13 < 5, "view").when(n % 13 < 11, "so").otherwise("Click")
    return v.table(s, d, "events").select((F.col("event_id") % 97).alias("id"), n.cast("int").alias("idx"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("+"), word)).otherwise(word).alias("word"))


def _joined(column: str):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",").alias(column)


def _lower(texts: list[str], source: str, target: str) -> list[str]:
    return [t.lower() for t in texts]


def _wordpieces(s, d):
    y = x.tokenize_wordpiece(_lines(s, d), {p: i for i, p in enumerate(PIECES)}, 40)
    offset = lambda o: F.concat_ws(":", o["start"].cast("string"), o["end"].cast("string"), F.when(o["is_subword"], "s").otherwise("w"))
    return y.select("id", *map(_joined, ("ids", "mask", "type_ids")), F.array_join(F.transform("offsets", offset), ",").alias("offsets"))


QUERIES = {
    "punc_norm": lambda s, d: _lines(s, d).select("id", x.punc_norm(F.col("text")).alias("text")),
    "split_sentences": lambda s, d: x.split_sentences(_lines(s, d)),
    "split_words": lambda s, d: x.split_words(_lines(s, d).withColumnRenamed("text", "sentence")),
    "clean_text": lambda s, d: _lines(s, d).select("id", x.clean_text(F.col("text")).alias("text"), x.close_up(F.regexp_replace("text", "e", " ~ ")).alias("closed"), x.clean_text(F.regexp_replace("text", "a", " - ( ")).alias("spaced")),
    "restore_accents": lambda s, d: x.restore_accents(_spoken(s, d), _accented(s, d)),
    "restore_tagged": _tagged,
    "char_ids": lambda s, d: _lines(s, d).select("id", x.char_ids(F.lower("text"), CHARS).alias("ids")).select("id", _joined("ids")),
    "carry_groups": _carried,
    "homographs": lambda s, d: x.homograph_candidates(_spoken(s, d), _dictionary(s, d).where("size = 9").select("plain", F.array(F.concat(F.lit("+"), "plain"), F.concat("plain", F.lit("+"))).alias("variants")), 6),
    "choose_variants": lambda s, d: x.choose(v.table(s, d, "events").select((F.col("user_id") % 40).alias("id"), (F.col("event_id") % 9).alias("idx"), F.col("event_type").alias("variant"), F.col("value").alias("score"))),
    "stress_marks": lambda s, d: _lines(s, d).select("id", x.stress_marks(F.regexp_replace(F.regexp_replace("text", "a", "+а"), "s", "+s+Я")).alias("text")),
    "group_words": lambda s, d: x.group_words(_runs(s, d), s.sql("SELECT 'view' AS base")).select("id", "grp", F.concat_ws(" ", "words").alias("words")),
    "tokenize_wordpiece": _wordpieces,
    "tokenize_bpe": lambda s, d: x.tokenize_bpe(_lines(s, d), {t: i for i, t in enumerate(TOKENS)}, {m: i for i, m in enumerate(MERGES)}, ["[SPACE]", "[en]"], lang="EN", nfkd=False).select("id", _joined("ids"), "n"),
    "translate_batch": lambda s, d: x.translate_batch(_lines(s, d), "en", "fr", _lower, {("en", "fr")}).select("id", "translated", "supported"),
    "translate_pairs": _translated,
}

_L = "WITH lines AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)"
_D = """WITH known AS (SELECT plain, count(*) AS n, length(plain) AS size FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS plain FROM documents) WHERE length(plain) > 3 GROUP BY plain),
w AS (SELECT id, CAST(i - 1 AS INTEGER) AS idx, ws[i] AS word FROM (SELECT doc_id AS id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z+]+') AS ws FROM documents)))"""
_WS = r"[\t\n\x0B\f\r\x{85}\pZ]"


def _supported(text: str) -> str:
    return rf"""regexp_replace({text}, '[^a-zA-Z0-9\sа-яА-ЯёЁ—.,!?:;"''(){{}}\[\]«»„-]', '', 'g')"""


def _closed(text: str) -> str:
    """Sign after sign, as the rule has it."""
    for c in x.PUNCTUATION:
        sign = c.replace("'", "''")
        text = f"replace({text}, ' {sign}', '{sign}')"
    return f"replace(replace(replace(replace({text}, ' -', '-'), '- ', '-'), ' -', '-'), '~', '-')"


def _punc() -> str:
    q = f"trim(regexp_replace(upper(left(text, 1)) || substr(text, 2), '{_WS}+', ' ', 'g'))"
    for a, b in x.REPLACED:
        q = "replace({}, '{}', '{}')".format(q, a.replace("'", "''"), b.replace("'", "''"))
    ends = ", ".join(f"'{c}'" for c in x.ENDERS)
    return f"{_L}, q AS (SELECT id, text, rtrim({q}) AS t FROM lines) SELECT id, CASE WHEN length(coalesce(text, '')) = 0 THEN '{x.EMPTY}' WHEN right(t, 1) IN ({ends}) THEN t ELSE t || '.' END AS text FROM q"


def _wordpiece_sql() -> str:
    first = "|".join(sorted((p for p in PIECES if p[0] not in "#["), key=len, reverse=True))
    later = "|".join(sorted((p[2:] for p in PIECES if p[0] == "#"), key=len, reverse=True))
    known = "[" + ", ".join(f"'{p}'" for p in PIECES) + "]"
    begin = f"regexp_extract(word, '^(?:{first}|(?s:.))')"
    cut = f"list_concat([{begin}], list_transform(regexp_extract_all(substr(word, 1 + length({begin})), '(?:{later}|(?s:.))'), lambda p: '##' || p))"
    numbers = "CASE WHEN k.ids IS NULL THEN [] ELSE list_transform(string_split(k.ids, ','), lambda z: CAST(z AS INTEGER)) END"
    return f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, 0 AS part, text FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 1, role FROM conversations),
o AS (SELECT id, part, unnest(string_split(coalesce(text, ''), ' ')) AS own, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS i FROM t),
w AS (SELECT *, lower(own) AS word, coalesce(sum(length(own) + 1) OVER (PARTITION BY id, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM o),
p AS (SELECT id, part, i, begins, own, CASE WHEN length(word) > 100 THEN ['[UNK]'] ELSE {cut} END AS ps FROM w WHERE own <> ''),
q AS (SELECT id, part, i, begins, own, unnest(ps) AS p, unnest(range(len(ps))) AS j FROM p),
k AS (SELECT id, part, string_agg(coalesce(list_position({known}, p), 2) - 1, ',' ORDER BY i, j) AS ids, string_agg(CAST(begins AS BIGINT) || ':' || CAST(begins + length(own) AS BIGINT) || ':' || CASE WHEN j > 0 THEN 's' ELSE 'w' END, ',' ORDER BY i, j) AS offsets FROM q GROUP BY id, part),
a AS (SELECT t.id, list_concat([2], list_concat({numbers}, [3])) AS f, coalesce(k.offsets, '') AS offsets FROM t LEFT JOIN k ON t.id = k.id AND k.part = 0 WHERE t.part = 0),
b AS (SELECT t.id, CASE WHEN t.text IS NULL THEN [] ELSE list_concat({numbers}, [3]) END AS s FROM t LEFT JOIN k ON t.id = k.id AND k.part = 1 WHERE t.part = 1),
c AS (SELECT a.id, offsets, list_concat(f, s) AS x, list_concat(list_transform(f, lambda z: 0), list_transform(s, lambda z: 1)) AS y FROM a JOIN b USING (id)),
d AS (SELECT id, offsets, CASE WHEN len(x) > 40 THEN list_append(x[1:39], 3) ELSE x END AS x, y[1:40] AS y, list_transform(range(greatest(0, 40 - len(x))), lambda z: 0) AS fill FROM c)
SELECT id, array_to_string(list_concat(x, fill), ',') AS ids, array_to_string(list_concat(list_transform(x, lambda z: 1), fill), ',') AS mask, array_to_string(list_concat(y, fill), ',') AS type_ids, offsets FROM d"""


def _bpe_sql() -> str:
    """Special tokens stand for themselves as one private character each; merges are applied rank by rank."""
    q = "chr(1) || array_to_string(string_split(replace(replace('[en]' || replace(lower(coalesce(text, '')), ' ', '[SPACE]'), '[SPACE]', chr(57344)), '[en]', chr(57345)), ''), chr(1)) || chr(1)"
    for a, b in MERGES:
        for _ in range(2):
            q = f"replace({q}, chr(1) || '{a}' || chr(1) || '{b}' || chr(1), chr(1) || '{a + b}' || chr(1))"
    known = "[" + ", ".join({"[SPACE]": "chr(57344)", "[en]": "chr(57345)"}.get(t, f"'{t}'") for t in TOKENS) + "]"
    return f"{_L}, m AS (SELECT id, list_transform(string_split(trim({q}, chr(1)), chr(1)), lambda t: coalesce(list_position({known}, t), 1) - 1) AS ids FROM lines) SELECT id, array_to_string(ids, ',') AS ids, CAST(len(ids) AS INTEGER) AS n FROM m"


SQL = {
    "punc_norm": _punc(),
    "split_sentences": rf"""{_L}, m AS (SELECT id, regexp_replace(text, '([.!?])({_WS}+)', '\1' || chr(1) || '\2' || chr(2), 'g') AS t FROM lines),
p AS (SELECT id, string_split(t, chr(2)) AS ps FROM m), q AS (SELECT id, unnest(ps) AS p, unnest(range(len(ps))) AS idx FROM p)
SELECT id, CAST(idx AS INTEGER) AS idx, string_split(p, chr(1))[1] AS sentence, coalesce(string_split(p, chr(1))[2], '') AS sep FROM q WHERE string_split(p, chr(1))[1] <> ''""",
    "split_words": rf"""{_L}, m AS (SELECT id, regexp_extract_all(text, '\s*(?:[\p{{L}}\p{{M}}\p{{N}}_]+(?:\+[\p{{L}}\p{{M}}\p{{N}}_]+)*|\+[\p{{L}}\p{{M}}\p{{N}}_]+(?:\+[\p{{L}}\p{{M}}\p{{N}}_]+)*|[^\p{{L}}\p{{M}}\p{{N}}_\s]+)') AS ps, regexp_extract(text, '\s*$') AS rest FROM lines),
q AS (SELECT id, rest, len(ps) AS n, unnest(ps) AS p, unnest(range(len(ps))) AS idx FROM m)
SELECT id, CAST(idx AS INTEGER) AS idx, regexp_replace(p, '^\s+', '') AS word, regexp_extract(p, '^\s*') AS before, CASE WHEN idx = n - 1 THEN rest ELSE '' END AS after FROM q""",
    "clean_text": f"""{_L} SELECT id, {_closed(_supported("text"))} AS text, {_closed("regexp_replace(text, 'e', ' ~ ', 'g')")} AS closed, {_closed(_supported("regexp_replace(text, 'a', ' - ( ', 'g')"))} AS spaced FROM lines""",
    "restore_accents": f"""{_D}, dict AS (SELECT plain, CASE WHEN n % 3 = 1 THEN plain[1] || '+' || plain[2:] ELSE plain || '+s' END AS accented FROM known WHERE n % 3 > 0)
SELECT id, idx, CASE WHEN accented IS NULL OR contains(word, '+') THEN word WHEN length(replace(accented, '+', '')) <> length(word) THEN accented ELSE word[1] || '+' || word[2:] END AS word FROM w LEFT JOIN dict ON lower(word) = plain""",
    "restore_tagged": f"""{_D}, t AS (SELECT id, idx, word, CASE WHEN (id + idx) % 4 = 0 THEN CASE WHEN k.size % 2 = 0 THEN reverse(k.plain) ELSE word END ELSE CASE WHEN k.n % 3 = 1 THEN 'y' || k.plain[2:] ELSE word END END AS other FROM w LEFT JOIN known k ON lower(word) = k.plain)
SELECT id, idx, CASE WHEN length(other) <> length(word) THEN other ELSE array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN word[i] <> lower(word[i]) THEN upper(other[i]) ELSE lower(other[i]) END), '') END AS word FROM t""",
    "char_ids": f"{_L} SELECT id, '2,' || coalesce(array_to_string(list_transform(string_split(lower(text), ''), lambda c: coalesce(nullif(strpos('abcdefghijklmnopqrstuvwxyz ,.', c), 0) + 3, 1)), ',') || ',', '') || '3' AS ids FROM lines",
    "carry_groups": f"""WITH g AS ({{GROUPS}}) SELECT id, grp, coalesce(string_agg(o.word || o.idx, ' ' ORDER BY o.idx), '') AS words FROM (SELECT id, grp, unnest(range(grp, grp + len(string_split(words, ' ')))) AS idx FROM g) AS p
LEFT JOIN (SELECT event_id % 97 AS id, CAST(event_id // 97 AS INTEGER) AS idx, CASE WHEN event_id % 3 = 0 THEN '+' ELSE '' END || CASE WHEN event_id // 97 % 13 < 5 THEN 'view' WHEN event_id // 97 % 13 < 11 THEN 'so' ELSE 'Click' END AS word FROM events WHERE event_id // 97 < event_id % 97) AS o USING (id, idx) GROUP BY id, grp""",
    "homographs": f"""{_D}, a AS (SELECT id, list(word ORDER BY idx) AS words FROM w GROUP BY id), h AS (SELECT id, idx, plain FROM w JOIN known ON lower(word) = plain WHERE size = 9)
SELECT h.id, h.idx, unnest(['+' || plain, plain || '+']) AS variant, array_to_string(list_concat(words[greatest(1, h.idx - 5):h.idx], ['<w>' || words[h.idx + 1] || '</w>'], words[h.idx + 2:h.idx + 7]), ' ') AS context FROM h JOIN a USING (id)""",
    "translate_pairs": """WITH t AS (SELECT doc_id AS id, text, lang AS source, ['en', 'fr', 'xx'][doc_id % 3 + 1] AS target FROM documents), n AS (SELECT *, (source, target) IN (('de', 'en'), ('en', 'fr'), ('fr', 'en'), ('de', 'fr')) AS supported FROM t)
SELECT id, CASE WHEN supported THEN md5(reverse(target || ':' || CASE source WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'German' END || ' (' || source || ') to ' || CASE target WHEN 'en' THEN 'English' ELSE 'French' END || ' (' || target || '): ' || text)) END AS translated, supported FROM n""",
    "choose_variants": "SELECT user_id % 40 AS id, event_id % 9 AS idx, arg_min(event_type, (-value, event_type)) AS variant FROM events GROUP BY ALL",
    "stress_marks": f"{_L} SELECT id, replace(regexp_replace(regexp_replace(regexp_replace(text, 'a', '+а', 'g'), 's', '+s+Я', 'g'), '\\+([{x.VOWELS}])', '\\1' || chr(769), 'g'), '+', '') AS text FROM lines",
    "group_words": """WITH w AS (SELECT event_id % 97 AS id, event_id // 97 AS idx, CASE WHEN event_id % 3 = 0 THEN '+' ELSE '' END || CASE WHEN (event_id // 97) % 13 < 5 THEN 'view' WHEN (event_id // 97) % 13 < 11 THEN 'so' ELSE 'Click' END AS word FROM events), b AS (SELECT *, replace(word, '+', '') AS base FROM w),
n AS (SELECT *, CASE WHEN base = lag(base) OVER (PARTITION BY id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM b), r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY idx) AS run FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS n, idx - min(idx) OVER (PARTITION BY id, run) AS place FROM r), g AS (SELECT *, CASE WHEN n <= 3 THEN 0 WHEN base = 'view' THEN place // 3 WHEN n % 2 = 0 THEN place // 2 ELSE 0 END AS part FROM c)
SELECT id, CAST(min(idx) AS INTEGER) AS grp, string_agg(word, ' ' ORDER BY idx) AS words FROM g GROUP BY id, run, part""",
    "tokenize_wordpiece": _wordpiece_sql(),
    "tokenize_bpe": _bpe_sql(),
    "translate_batch": f"{_L} SELECT id, lower(text) AS translated, true AS supported FROM lines",
}
SQL["carry_groups"] = SQL["carry_groups"].replace("{GROUPS}", SQL["group_words"])
