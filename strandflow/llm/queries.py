"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontam, langid, licenses, near_dedup, quality, repeats, suffix_dedup, token_counts, toxicity, url_filter
from .common import read_table


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Place of a public tokenizer's file: ``spark.strandflow.tokenizers`` names the folder
    where it is set, else the installed package knows it."""
    folder = spark.conf.get("spark.strandflow.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path(spark, "word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(r"""
        SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, r'\### Assistant: </turn> ok' AS text
        UNION ALL SELECT -7L, 1L, 'assistant', r'\### Assistant: </turn> ok'
    """)
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_windows(table.unionByName(extra)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove(read_table(spark, sf_dir, "documents"))
    gone = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", gone.cast("bigint").alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(read_table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"), tokenizer_path(spark, "piece_bpe_32k.model"))


def cycled(text: Column, h: Column) -> Column:
    """The contract of op13 asks for texts whose words go round: from word a on, the first p
    of them again and again, where the digest h of the row's id gives a and p. A null or
    wordless text, or one without an id, stays."""
    g = F.floor(h / 10)

    def go_round(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")).otherwise(text)

    # a lambda's argument is computed once
    made = F.transform(F.array(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))), go_round)[0]
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), made).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = cycled(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    found = repeats.collapse(docs.select("doc_id", text.alias("text")))
    more = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), more)
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_language_id, op3_decontamination, op4_bpe, op5_toxicity, op6_near_dedup, op7_token_counts, op8_chat_format, op9_quality, op10_licenses, op11_suffix_dedup, op12_token_alignment, op13_periodic_runs)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) ELSE w END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_PLACES = {
    "cc-by": "[i for i in range(0, len(w)) if w[i + 1] = 'cc' and w[i + 2] = 'by']",
    "gpl": "[i for i in range(0, len(w)) if w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license']",
    "reserved": "[i for i in range(0, len(w)) if w[i + 1] = 'all' and w[i + 2] = 'rights' and w[i + 3] = 'reserved']",
}


def _as_regex(markup: str) -> str:
    """A license template as a regular expression over words with one space after each."""
    out = ""
    for part in re.split(r"(<<.*?>>)", markup):
        if part == "<<beginOptional>>":
            out += "("
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            out += "([^ ]+ )*"
        else:
            out += "".join(w + " " for w in re.findall("[0-9a-z]+", part.lower()))
    return out


_BASE = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in _PLACES.items())
_OWN = ", ".join(f"CASE WHEN regexp_matches(line, ' {_as_regex(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES.items())
LICENSES_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM t),
p AS (SELECT *, {" || ".join(_PLACES.values())} AS places, [x for x in [{_BASE}] if x IS NOT NULL] AS base, [x for x in [{_OWN}] if x IS NOT NULL] AS own FROM x)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM p
"""

_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)
_RAW = "regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}]+|\\p{N}+(?:[.,]\\p{N}+)*')"
_NAME = "x <> lower(x) AND x = upper(x[1]) || lower(x[2:])"
_MARKED = "[CASE WHEN regexp_matches(x, '^\\p{{N}}') THEN chr(1) WHEN {name} THEN chr(2) ELSE lower(x) END for x in r]"
_WITH_UNITS = f"[CASE WHEN i > 1 AND {{p}}[i - 1] = chr(1) AND {{p}}[i] IN ({_UNITS}) THEN chr(3) ELSE {{p}}[i] END for i in range(1, len({{p}}) + 1)]"
#: Of raw words r: the typed form t, the folded form f and the plain form q.
_FORMS = f"{_WITH_UNITS.format(p='t0')} AS t, {_WITH_UNITS.format(p='f0')} AS f, [lower(x) for x in r] AS q"
_FROM = f"SELECT *, {_MARKED.format(name=_NAME)} AS t0, {_MARKED.format(name='false')} AS f0"
_KEY = "array_to_string({w}[{nth} + 1 : {nth} + size], chr(31))"
_LITERAL = "len([x for x in {w}[nth + 1 : nth + size] if x >= ' ']) > (size + 1) // 2"


def _slots(fit: str, first: str, last: str) -> str:
    """The slots of the matching stretch around the windows from first to last."""
    low = f"coalesce(list_max([j for j in range(0, len(t)) if {fit}[j + 1] = 0 AND j < {first}]), -1)"
    high = f"coalesce(list_min([j for j in range(0, len(t)) if {fit}[j + 1] = 0 AND j >= {last} + size]), len(t))"
    return f"list_distinct([{{'k': kind[j + 1], 'a': q[j + 1], 'b': lower(dr[j + shift + 1])}} for j in range({low} + 1, {high}) if {fit}[j + 1] > 0 AND kind[j + 1] < ' '])"


def _ones(pairs: str) -> str:
    """Whether slots correspond one to one."""
    return f"(len(list_distinct([{{'k': x.k, 'a': x.a}} for x in {pairs}])) = len({pairs}) AND len(list_distinct([{{'k': x.k, 'b': x.b}} for x in {pairs}])) = len({pairs}))"


LEAKS_SQL = f"""
WITH items AS (SELECT DISTINCT item_id, r, {_FORMS}, least(len(r), 8) AS size FROM ({_FROM} FROM (SELECT item_id, {_RAW} AS r FROM benchmark)) WHERE len(r) > 1),
docs AS (SELECT doc_id, copy, r, {_FORMS} FROM ({_FROM} FROM (SELECT doc_id, any_value(text) AS text, md5(text) AS copy, any_value({_RAW}) AS r FROM documents WHERE text IS NOT NULL GROUP BY doc_id, md5(text)))),
placed AS (SELECT *, unnest(range(0, len(r) - size + 1)) AS nth FROM items),
tried AS (SELECT item_id, size, nth, CASE WHEN {_LITERAL.format(w="t")} THEN 1 WHEN {_LITERAL.format(w="f")} THEN 2 ELSE 3 END AS need,
  {_KEY.format(w="t", nth="nth")} AS kt, {_KEY.format(w="f", nth="nth")} AS kf, {_KEY.format(w="q", nth="nth")} AS kq FROM placed),
sizes AS (SELECT item_id, count(*) AS item_windows, count(*) FILTER (need = 1) AS strong, list({{'nth': nth, 'need': need}} ORDER BY nth) AS tried FROM tried GROUP BY item_id),
posts AS (SELECT DISTINCT item_id, size, nth, unnest(CASE need WHEN 1 THEN [kt, kf] WHEN 2 THEN [kf] ELSE [kq] END) AS k FROM tried),
doc_places AS (SELECT *, unnest(range(0, len(r) - size + 1)) AS pos FROM docs, (SELECT DISTINCT size FROM posts) WHERE len(r) >= size),
doc_posts AS (SELECT doc_id, copy, size, pos, unnest([{_KEY.format(w="t", nth="pos")}, {_KEY.format(w="f", nth="pos")}, {_KEY.format(w="q", nth="pos")}]) AS k FROM doc_places),
diagonals AS (SELECT DISTINCT doc_id, copy, item_id, pos - nth AS shift FROM doc_posts JOIN posts USING (size, k)),
bound AS (SELECT g.*, i.t, i.f, i.q, i.size, s.item_windows, s.strong, s.tried, d.r AS dr,
  [CASE WHEN j + shift < 0 THEN 0 WHEN i.q[j + 1] = d.q[j + shift + 1] THEN 3 WHEN i.f[j + 1] = d.f[j + shift + 1] THEN 2 WHEN i.t[j + 1] = d.t[j + shift + 1] THEN 1 ELSE 0 END for j in range(0, len(i.t))] AS fit,
  [CASE WHEN j + shift >= 0 AND i.t[j + 1] = d.t[j + shift + 1] THEN 1 ELSE 0 END for j in range(0, len(i.t))] AS typed
  FROM diagonals g JOIN items i USING (item_id) JOIN sizes s USING (item_id) JOIN docs d ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.copy = g.copy),
fits AS (SELECT *, [CASE WHEN typed[j] = 1 THEN t[j] ELSE f[j] END for j in range(1, len(t) + 1)] AS kind,
  [x.nth for x in tried if list_min(fit[x.nth + 1 : x.nth + size]) >= x.need] AS ats, [x.nth for x in tried if list_min(typed[x.nth + 1 : x.nth + size]) >= x.need] AS ats_typed FROM bound),
slots AS (SELECT *, CASE WHEN len(ats) > 0 THEN {_slots("fit", "list_min(ats)", "list_max(ats)")} ELSE [] END AS pairs,
  CASE WHEN len(ats_typed) > 0 THEN {_slots("typed", "list_min(ats_typed)", "list_max(ats_typed)")} ELSE [] END AS pairs_typed,
  [a for a in ats if list_contains(ats, a + 1) AND list_contains(ats, a + 2) AND list_contains(ats, a + 3) AND list_contains(ats, a + 4) AND list_contains(ats, a + 5)] AS starts FROM fits),
each_start AS (SELECT *, [{{'a': a, 'exact': list_min(fit[a + 1 : a + 13]) = 3, 'pairs': {_slots("fit", "a", "a + 5")}}} for a in starts] AS stretches FROM slots),
runs AS (SELECT *, CASE WHEN {_ones("pairs")} THEN stretches ELSE [x for x in stretches if x.exact OR {_ones("x.pairs").replace("for x in x.pairs", "for y in x.pairs").replace("x.k", "y.k").replace("'a': x.a", "'a': y.a").replace("'b': x.b", "'b': y.b")}] END AS run FROM each_start),
chosen AS (SELECT doc_id, item_id, item_windows, strong, tried, len(run) > 0 AS run,
  CASE WHEN len(ats) > 0 AND {_ones("pairs")} THEN ats WHEN len(ats_typed) > 0 AND {_ones("pairs_typed")} THEN ats_typed ELSE flatten([range(x.a, x.a + 6) for x in run]) END AS ats,
  CASE WHEN len(ats) > 0 AND {_ones("pairs")} THEN pairs WHEN len(ats_typed) > 0 AND {_ones("pairs_typed")} THEN pairs_typed ELSE flatten([CASE WHEN x.exact THEN x.pairs[1:0] ELSE x.pairs END for x in run]) END AS pairs FROM runs),
held AS (SELECT doc_id, item_id, item_windows, strong, [x.nth for x in tried if x.need = 1] AS literal, unnest(list_distinct(ats)) AS nth, len([x for x in pairs if x.a <> x.b]) = 0 AS same, run FROM chosen)
SELECT * EXCLUDE (run) FROM (SELECT doc_id, item_id, greatest(count(DISTINCT nth) / any_value(item_windows)::DOUBLE, coalesce(count(DISTINCT CASE WHEN list_contains(literal, nth) THEN nth END) / nullif(any_value(strong), 0)::DOUBLE, 0)) AS coverage,
  bool_and(same) AS same_fillers, bool_or(run) AS run FROM held GROUP BY doc_id, item_id) WHERE coverage >= 0.5 OR run
"""

#: What op8's windows come to. Turn numbers repeat in no conversation here, so ties play no part.
_ESCAPED = "replace(replace(replace({x}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
CHAT_SQL = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, {_ESCAPED.format(x="text")} AS e, 14 + length(replace({_ESCAPED.format(x="role")}, ':', '\c')) + length({_ESCAPED.format(x="text")}) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM said),
counted AS (SELECT *, (strlen(e) + 3) // 4 + 4 AS tokens FROM sized),
roomy AS (SELECT c.*, s.tokens AS system_tokens, s.chars AS system_chars, greatest(384 - 96 - coalesce(s.tokens, 0), 64) AS room
  FROM counted c LEFT JOIN (SELECT * FROM counted WHERE idx = 0 AND role = 'system') s ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
summed AS (SELECT *, coalesce(sum(tokens) OVER prev, 0) AS before, coalesce(sum(CASE WHEN tokens * 2 > room THEN 1 ELSE 0 END) OVER prev, 0) AS longs FROM roomy
  WINDOW prev AS (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, min(idx) OVER (PARTITION BY conv_id, before * 2 // room, longs, tokens * 2 > room) AS win FROM summed),
spans AS (SELECT DISTINCT conv_id, win, system_chars FROM cut WHERE win > 0),
late AS (SELECT s.conv_id, c.chars, sum(c.tokens) OVER (PARTITION BY s.conv_id, s.win ORDER BY c.idx DESC) AS taken FROM spans s JOIN cut c
  ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.idx BETWEEN s.win - 2 AND s.win - 1 AND (c.system_chars IS NULL OR c.idx > 0)),
extra AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM late WHERE taken <= 96 UNION ALL SELECT conv_id, system_chars FROM spans WHERE system_chars IS NOT NULL) GROUP BY conv_id),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '') AS loss, sum(chars) AS chars FROM cut GROUP BY conv_id)
SELECT w.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(w.chars + coalesce(x.chars, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN extra x ON x.conv_id IS NOT DISTINCT FROM w.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": LEAKS_SQL, "op6_near_dedup": NEAR_DEDUP_SQL, "op8_chat_format": CHAT_SQL, "op10_licenses": LICENSES_SQL}
