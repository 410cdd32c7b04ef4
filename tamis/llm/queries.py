"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import bpe, decontaminate, interactions, jaccard, langid, licenses, lm, mixing, phrases, quality, toolcalls, toxicity, warc
from tamis.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc_revisits"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM o
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w FROM s),
l AS (SELECT *, max(lev) OVER () AS level FROM (SELECT *,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size * 2) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
  FROM r WINDOW o AS (ORDER BY CAST(source_size * 2 AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
t AS (SELECT source, source_size, least(CAST(source_size * 2 AS DOUBLE), level * w) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT source, h, sum(size) AS of FROM d GROUP BY source, h),
u AS (SELECT *, sum(of) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (SELECT c.source, min_by(struct_pack(h := u.h, of := u.of, under := u.upto - u.of), u.h) AS edge FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source
  WHERE u.upto > c.target - c.copies * c.source_size GROUP BY c.source),
k AS (SELECT c.*, CASE WHEN e.edge IS NULL THEN 1 << 41 ELSE e.edge.h + CASE WHEN (c.target - c.copies * c.source_size - e.edge.under) * 2 >= e.edge.of THEN 1 ELSE 0 END END AS below
  FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, k.source_size, k.target, CAST(size * least(2, copies + CASE WHEN h < below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def _license_sql() -> str:
    class_ = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    templates = ", ".join(f"('{label}', {licenses.template_words(t)}, {i})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({lower('text')}, '{class_}') AS words FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) AS x(label, phrase)),
h AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i : words[i + 1:i + len(phrase)] = phrase)) AS place FROM d, p),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM h GROUP BY doc_id),
l AS (SELECT DISTINCT line, regexp_extract_all({lower('line')}, '{class_}') AS words FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT line, label, len(list_intersect(list_distinct(words), t)) AS o, len(t) AS n FROM l, (VALUES {templates}) AS x(label, t, i)
  WHERE o >= ceil({licenses.THRESHOLD} * n - 1e-9)),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(o / n) AS score FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) JOIN m USING (line) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


ORACLES["op6_license_scan"] = _license_sql()


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), texts=False))


ORACLES["op7_decontamination"] = r"""
WITH words_of AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(words)) AS width, array_to_string(words[i + 1:i + 10], ' ') AS w
  FROM items, unnest(range(greatest(1, len(words) - 9))) AS x(i) WHERE len(words) > 0),
widths AS (SELECT DISTINCT width FROM windows),
spots AS (SELECT doc_id, width, i, array_to_string(words[i + 1:i + width], ' ') AS w FROM words_of, widths, unnest(range(len(words) - width + 1)) AS x(i) WHERE len(words) >= width),
hits AS (SELECT doc_id, i, width, item FROM spots JOIN windows USING (width, w)),
n_hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, width FROM hits), unnest(range(i, i + width)) AS y(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_of LEFT JOIN n_hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.calls_of_turns(table(spark, sf_dir, "conversations"))
    linked = toolcalls.link(calls, results, toolcalls.TURN_SCHEMAS)
    return linked.select("conv_id", "call_id", "name", "call_turn", "result_turn", "level", "n_missing", "status", (F.col("n_errors") == 0).alias("valid"), F.sha2("canonical", 256).alias("canonical_sha256"))


ORACLES["op3_tool_calls"] = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'system' THEN 'configure' ELSE 'reply' END AS name, min(text) AS text
  FROM conversations WHERE role IN ('system', 'user') GROUP BY ALL),
r AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
e AS (SELECT c.conv_id, c.turn, p.turn AS used FROM c JOIN c AS p ON c.conv_id = p.conv_id AND c.turn - p.turn IN (1, 2)),
walk AS (SELECT conv_id, turn, 0 AS level FROM c UNION SELECT e.conv_id, e.turn, level + 1 FROM walk JOIN e ON walk.conv_id = e.conv_id AND walk.turn = e.used),
v AS (SELECT conv_id, turn, max(level) AS level FROM walk GROUP BY ALL),
m AS (SELECT c.conv_id, c.turn, least(2, c.turn) - count(e.used) AS n_missing FROM c LEFT JOIN e USING (conv_id, turn) GROUP BY c.conv_id, c.turn),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name, c.turn AS call_turn, r.turn AS result_turn, c.text, r.content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT j.conv_id, call_id, name, call_turn, result_turn, CAST(v.level AS INTEGER) AS level, CAST(coalesce(n_missing, 0) AS BIGINT) AS n_missing,
  CASE WHEN name IS NULL THEN 'orphan_result' WHEN result_turn IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  name IS NULL OR coalesce(text, '') <> '' AS valid,
  sha256('{"arguments":' || CASE name WHEN 'configure' THEN '{"text":' || CAST(to_json(text) AS VARCHAR) || '}' WHEN 'reply' THEN '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || call_turn || '}' ELSE 'null' END
    || ',"id":"' || call_id || '","name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"' || name || '"' END || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}') AS canonical_sha256
FROM j LEFT JOIN m ON j.conv_id = m.conv_id AND j.call_turn = m.turn LEFT JOIN v ON j.conv_id = v.conv_id AND j.call_turn = v.turn
"""


@query
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_interactions"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, range(1, 6) AS r(step)),
h AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS only_own, regexp_matches(fails, CASE WHEN before = '' THEN 'x' ELSE '[' || before || ']' END) AS earlier FROM n, s),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (only_own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT earlier), 0) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


@query
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS words FROM documents),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM p, range(1, 5) AS a(m), unnest(range(1, len(words) - m + 2)) AS b(i) GROUP BY ALL HAVING count(*) >= 30),
q AS (SELECT *, string_split(phrase, ' ') AS words FROM c WHERE m > 1),
k AS (SELECT lang, phrase, f AS a, k, array_to_string(words[:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS rest FROM q, unnest(range(1, m)) AS b(k)),
s AS (SELECT k.lang, k.phrase, k.a, k, x.f AS l, y.f AS r, CAST(CAST(k.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM k JOIN c AS x ON k.lang = x.lang AND k.head = x.phrase JOIN c AS y ON k.lang = y.lang AND k.rest = y.phrase),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(words[j:j + w - 1], ' ') AS phrase, max(f) AS around FROM q, range(2, 4) AS a(w), unnest(range(1, m - w + 2)) AS b(j) WHERE w < m GROUP BY ALL),
u AS (SELECT t.*, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, t.phrase) AS rank FROM t LEFT JOIN i ON t.lang = i.lang AND t.phrase = i.phrase
  WHERE around IS NULL OR CAST(around AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT lang, rank, phrase, a, l, r, n, score FROM u JOIN n USING (lang) WHERE rank <= 2000
"""
