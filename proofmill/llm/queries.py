"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, decontaminate, divergence, langid, licenses, quality, sentencepiece_nbest, spelling, suffix_dedup, token_counts, token_output
from .common import stored, table
from .ngram_join import jaccard_classes


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=5, percent=75)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = stored(token_output.token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1))
    return token_output.token_digest(coded)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_nbest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=4).drop("ids")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, threshold=0.75)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.chat_windows(table(spark, sf_dir, "conversations").select(*columns).unionByName(extra), budget=512))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"), threshold=0.75)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary(tokenizer_path("word_bpe_49k.json")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = stored(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))  # so no worker has to do both
    return byte_bpe.digest(byte_bpe.decode(coded, path))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard, op2_token_output, op3_quality_rules, op4_sentencepiece_nbest, op5_decontamination,
        op6_language_id, op7_chat_formatting, op8_license_scan, op9_token_counts, op10_suffix_dedup,
        op11_byte_bpe, op12_spelling_variants, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""


_OP7 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER c AS i, len(regexp_extract_all(text, '[^ \t\n\r]+')) + 4 AS cost FROM said
  WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
kinds AS (SELECT *, i = 1 AND role = 'system' AND cost <= 256 AS system FROM numbered),
sums AS (
  SELECT *, CASE WHEN system THEN 0 ELSE cost END AS c, sum(CASE WHEN system THEN 0 ELSE cost END) OVER w - CASE WHEN system THEN 0 ELSE cost END AS before,
    512 - sum(CASE WHEN system THEN cost ELSE 0 END) OVER w AS room
  FROM kinds WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
stripes AS (SELECT *, (2 * before) // room AS stripe, 2 * cost > room AS long FROM sums),
begun AS (
  SELECT *, NOT system AND (lag(system, 1, true) OVER w OR long OR lag(long, 1, false) OVER w OR lag(stripe, 1, -1) OVER w <> stripe) AS begins
  FROM stripes WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
placed AS (
  SELECT *, greatest(0, sum(begins::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1) AS win FROM begun),
owned AS (SELECT *, sum(c) OVER (PARTITION BY conv_id, win) AS own FROM placed),
sized AS (
  SELECT *, 23 + esc(role) + esc(text) AS chars, max(win) OVER (PARTITION BY conv_id) AS last,
    lead(win, 1) OVER w AS win1, lead(win, 2) OVER w AS win2, lead(before, 1) OVER w AS before1, lead(before, 2) OVER w AS before2, lead(own, 1) OVER w AS own1, lead(own, 2) OVER w AS own2
  FROM owned WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
counted AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    max(last) + 1 AS n_windows,
    sum(chars * (1 + CASE WHEN system THEN last ELSE
      CASE WHEN win1 > win AND before1 - before + own1 <= room THEN 1 ELSE 0 END + CASE WHEN win2 > win1 AND before2 - before + own2 <= room THEN 1 ELSE 0 END END)) + 7 * (max(last) + 1) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, formatted_chars::BIGINT AS formatted_chars, n_windows::BIGINT AS n_windows FROM counted
"""
#: Code points of an escaped text: a backslash more for each backslash and for each control string.
_ESCAPED = "(length({0}) + " + " + ".join(f"(length({{0}}) - length(replace({{0}}, '{x}', ''))) // {len(x)}" for x in ("\\", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")) + ")"
for _name in ("role", "text"):
    _OP7 = _OP7.replace(f"esc({_name})", _ESCAPED.format(_name))


_OP10 = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT doc_id, j, substring(h, 2 * j + 1, 1422) AS part, least(512, n - 199 - j) AS m FROM (SELECT *, unnest(range(0, n - 199, 512)) AS j FROM raw)),
windows AS (SELECT doc_id, j + i AS i, md5(substring(part, 2 * i + 1, 400)) AS w FROM (SELECT *, unnest(range(0, m)) AS i FROM blocks)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM windows WHERE w IN (SELECT w FROM twice)),
runs AS (SELECT doc_id, i, sum((p IS NULL OR i > p + 200)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM starts),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
ends AS (SELECT doc_id, h, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  list_prepend(0, coalesce(b, [])) AS lo, list_append(coalesce(a, []), n) AS hi FROM raw LEFT JOIN cuts USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(lo) + 1), lambda i: substring(h, 2 * lo[i] + 1, 2 * (hi[i] - lo[i]))), ''))) AS kept_sha256
FROM ends
"""


#: One byte b of a CRC-32, from the state acc: the table's entry of a byte is the sum of those of its bits.
_BIT = [0] * 8
for _k in range(8):
    _c = 1 << _k
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _BIT[_k] = _c
_CRC = "xor(acc, b)"
_STEP = "acc >> 8"
for _k, _c in enumerate(_BIT):
    _STEP = f"xor({_STEP}, (({_CRC} >> {_k}) & 1) * {_c})"
_OP12 = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY ALL),
coded AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM runs),
bytes AS (SELECT w, n, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT) AS s FROM coded),
sums AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, s), lambda acc, b: {step}), 4294967295) AS h FROM bytes),
written AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
short AS (SELECT DISTINCT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM short a JOIN short b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM short s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word FROM short s JOIN words w ON w.word = s.rest),
ranked AS (
  SELECT near.word, near.other, w.n, o.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, hex(encode(near.other))) AS r
  FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = near.other),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 5 * w.n THEN r.other END AS form, CASE WHEN r.m >= 5 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON r.word = w.word),
up AS (SELECT word, word AS at FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN up ON up.word = f.word JOIN forms last ON last.word = up.at AND last.form IS NULL
""".replace("{step}", _STEP)

_OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM found GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0)::HUGEINT AS n, l.n AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source LEFT JOIN langs l ON l.lang = g.lang),
given AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (g.lang_n + g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM given x JOIN given y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM given WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, hex(encode(item)))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _OP1, "op7_chat_formatting": _OP7, "op10_suffix_dedup": _OP10, "op12_spelling_variants": _OP12, "op13_source_divergence": _OP13}
