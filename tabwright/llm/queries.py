"""The registered queries of this subpackage and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..registry.base import Query, table
from . import bpe, collocations, embedding_dedup, filter_audit, html_extract, jaccard_join, mixing, ngram_lm, pii, preference_format, quality, token_counts, url_templates

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), keep=["doc_id"])


def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = bpe.encode_and_decode(docs, tokenizer_path(), keep=["doc_id"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf, "documents").select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")), tokenizer_path(), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


def language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = ngram_lm.fit(docs.where(ngram_lm.learned("doc_id")))
    docs = docs.withColumn("held_out", ~ngram_lm.learned("doc_id"))
    scored = ngram_lm.score(docs, model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs), keep=["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    made = preference_format.format_pairs(turns, preference_format.worse_copies(turns))
    spans = [F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["begin"], x["end"])), ",").alias(c) for c in ("chosen_spans", "rejected_spans")]
    return made.select("conv_id", "piece", "prompt_turns", "prompt", "chosen", "rejected", *spans)


def main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf, "documents").select("doc_id", "text"))


def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def filter_interaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit_documents(docs, table(spark, sf, "labels"))


def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf, "pages").select("page_id", "url"), keep=["page_id"])


def phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents").select("text", "lang"))


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR,'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3*source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap/w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS rest,
  sum(w) OVER (ORDER BY cap/w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
m AS (SELECT *, cap*open <= rest*w AS stopped FROM l),
t AS (SELECT source, source_size, CASE WHEN stopped THEN cap::DOUBLE ELSE ((total - coalesce(sum(cap) FILTER (WHERE stopped) OVER (),0))*w)::DOUBLE / (sum(w) FILTER (WHERE NOT stopped) OVER ()) END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, source_size, target, epochs, floor(target)::BIGINT - epochs*source_size AS remain,
  sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs*size + least(greatest(remain - before, 0), size))::BIGINT AS taken FROM p
"""

_B = "CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END"
_TOP = "CASE WHEN b < 64 THEN b ELSE ((b - ((b-32)//32)*32 + 1) << ((b-32)//32)) - 1 END"


def _quality_sql() -> str:
    slack = quality.SLACK
    ratio = {m: f"{by}*{top}//greatest({bottom},1)" for m, (top, bottom, by) in quality.RATIOS.items()}
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {m} AS v FROM f WHERE NOT base_failed" for m in slack)
    bound = " UNION ALL ".join(f"SELECT '{m}' AS m, {s} AS slack" for m, s in slack.items())
    fails = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS m, {m} AS v FROM f" for m in slack)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text,'') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, hash(array_to_string(ws[i:i+7], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws)-6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, h) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n,0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100*n_repeat_words > {quality.MAX_REPEAT_PCT}*n_words AS base_failed, {", ".join(f"{e} AS {m}" for m, e in ratio.items())} FROM c),
sk AS (SELECT lang, source, m, {_B} AS b, count(*) AS n FROM ({values}) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, m) AS tot FROM sk),
q AS (SELECT lang, source, m, min({_TOP}) FILTER (WHERE 4*upto >= tot) AS q1, min({_TOP}) FILTER (WHERE 4*upto >= 3*tot) AS q3 FROM r GROUP BY ALL),
z AS (SELECT lang, source, m, q1 - greatest({quality.IQRS}*(q3-q1), slack) AS low, q3 + greatest({quality.IQRS}*(q3-q1), slack) AS high FROM q JOIN ({bound}) USING (m)),
ok AS (SELECT a.rid, bool_and(coalesce(v BETWEEN low AND high, false)) AS usual FROM ({fails}) a LEFT JOIN z ON a.m = z.m AND a.lang IS NOT DISTINCT FROM z.lang AND a.source IS NOT DISTINCT FROM z.source GROUP BY a.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND usual AS kept FROM f JOIN ok USING (rid)
"""


#: Shingles joined with themselves, then the least id that links lead to, step by step.
JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT rid, doc_id, hash(array_to_string(ws[i:i+3], ' ')) AS h FROM (SELECT rid, doc_id, ws, unnest(range(1, greatest(len(ws)-3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS s FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM g a JOIN g b ON a.h = b.h AND a.rid <> b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100*common >= 85*(x.s + y.s - common)),
r AS (SELECT rid AS a, rid AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.b GROUP BY r.a)
SELECT w.doc_id, coalesce(n.s, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""

EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) >= {embedding_dedup.LIMIT}::DOUBLE*a.n*b.n),
r AS (SELECT DISTINCT a AS a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.k,0)::BIGINT AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

#: Lengths of rendered turns add up by a window; an answer's span leaves out its header and the line break behind its end mark.
PREFERENCE_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
l AS (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY 1),
h AS (SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' AND ((c.conv_id % 5 = 0 AND turn = last) OR (c.conv_id % 5 = 1 AND turn = first)) THEN substring(text, 1, length(text)//2) ELSE text END AS text
  FROM c LEFT JOIN l USING (conv_id) WHERE c.conv_id % 5 < 4 AND (c.conv_id % 5 <> 2 OR last IS NULL OR turn < last)
  UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', '...' FROM c WHERE conv_id % 5 = 3 GROUP BY 1),
o AS (SELECT 'a' AS side, conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM c UNION ALL SELECT 'b', conv_id, turn, coalesce(role,''), coalesce(text,'') FROM h),
t AS (SELECT * FROM o WHERE conv_id IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY side, conv_id, turn ORDER BY role, text) = 1),
d AS (SELECT conv_id, turn, count(DISTINCT (role, text)) > 1 OR count(*) < 2 AS differs FROM t GROUP BY 1, 2),
f AS (SELECT conv_id, min(turn) FILTER (WHERE differs) AS fork, min(turn // {preference_format.PIECE}) AS lowest FROM d GROUP BY 1),
p AS (SELECT conv_id, (turn // {preference_format.PIECE} - lowest)::BIGINT AS piece, turn, role, CASE WHEN coalesce(turn < fork, true) THEN 'prompt' WHEN side = 'a' THEN 'chosen' ELSE 'rejected' END AS part, side,
  '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS x FROM t JOIN f USING (conv_id)),
s AS (SELECT *, (sum(length(x)) OVER (PARTITION BY conv_id, piece, part ORDER BY turn))::BIGINT AS upto FROM p WHERE part <> 'prompt' OR side = 'a'),
z AS (SELECT *, (upto - length(x) + length(head))::VARCHAR || ':' || (upto - 1)::VARCHAR AS span FROM s)
SELECT conv_id, piece, count(*) FILTER (WHERE part = 'prompt')::BIGINT AS prompt_turns,
  {", ".join(f"coalesce(string_agg(x, '' ORDER BY turn) FILTER (WHERE part = '{n}'), '') AS {n}" for n in ("prompt", "chosen", "rejected"))},
  {", ".join(f"coalesce(string_agg(span, ',' ORDER BY turn) FILTER (WHERE part = '{n}' AND role = 'assistant'), '') AS {n}_spans" for n in ("chosen", "rejected"))}
FROM z GROUP BY 1, 2
"""

#: Every order is played through; the Shapley column is the plain sum over all of them.
AUDIT_SQL = """
WITH y AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang,'') AS part, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT part, coalesce(good,0) AS good, coalesce(toxic,0) AS toxic, (len(w) < 100)::INT + 2*(100*len(list_distinct(w)) < 80*len(w))::INT
  + 4*(100*len(regexp_extract_all(t, '[A-Z]')) > 10*length(t))::INT + 8*regexp_matches(t, '[#$%&*|]')::INT + 16*coalesce(d.doc_id > least, false)::INT AS fails
  FROM d JOIN m USING (t) LEFT JOIN y ON y.doc_id = d.doc_id),
s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(range(5)) AS i),
o AS (SELECT chr((65+a.i)::INT) || chr((65+b.i)::INT) || chr((65+c.i)::INT) || chr((65+x.i)::INT) || chr((65+e.i)::INT) AS filter_order, [(1<<a.i)::INT, (1<<b.i)::INT, (1<<c.i)::INT, (1<<x.i)::INT, (1<<e.i)::INT] AS bits
  FROM l a JOIN l b ON b.i <> a.i JOIN l c ON c.i NOT IN (a.i, b.i) JOIN l x ON x.i NOT IN (a.i, b.i, c.i) JOIN l e ON e.i NOT IN (a.i, b.i, c.i, x.i)),
p AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step-1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE fails & (before | own) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE fails & own > 0 AND fails & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE fails & own > 0 AND fails & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails & own > 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE fails & own > 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
  FROM s JOIN p ON true GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

_RULES = sorted(url_templates.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
_FITS = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in _RULES]
_APART = " OR ".join(f"abs({c}/n - lag({c}) OVER a/lag(n) OVER a) > sqrt({url_templates.CONFIDENCE}::DOUBLE/n) + sqrt({url_templates.CONFIDENCE}::DOUBLE/lag(n) OVER a)" for c in url_templates.SHARES)
URL_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
g AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(_FITS, _RULES))} END AS rule, CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(_FITS, _RULES))} END AS v,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) || CASE WHEN ends_with(path, '/') THEN ['/'] ELSE [] END AS shape FROM p),
s AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE v = 'block') AS blocked, count(*) FILTER (WHERE v = 'allow') AS allowed FROM g GROUP BY 1, 2),
e AS (SELECT *, unnest(range(1, len(shape) + 1)) AS d FROM s),
k AS (SELECT host, shape[1:d] AS node, sum(n)::BIGINT AS n, sum(blocked)::BIGINT AS blocked, sum(allowed)::BIGINT AS allowed, sum(CASE WHEN d = len(shape) THEN n ELSE 0 END)::BIGINT AS ends FROM e GROUP BY 1, 2),
w AS (SELECT *, node[1:len(node)-1] AS up, count(*) OVER a AS siblings, (sum(n) OVER a)::BIGINT AS all_n FROM k WINDOW a AS (PARTITION BY host, node[1:len(node)-1])),
v AS (SELECT *, CASE WHEN node[-1] IN ('*', '/') THEN node[-1] WHEN siblings > {url_templates.FANOUT} AND n * {url_templates.FANOUT} < all_n THEN '*' END AS var FROM w),
a AS (SELECT *, coalesce({_APART}, false)::INT AS apart FROM v WHERE var IS NULL WINDOW a AS (PARTITION BY host, up ORDER BY {", ".join(f"{c}/n" for c in url_templates.SHARES)}, node[-1])),
i AS (SELECT *, sum(apart) OVER (PARTITION BY host, up ORDER BY {", ".join(f"{c}/n" for c in url_templates.SHARES)}, node[-1]) AS grp FROM a),
c AS (SELECT host, node, CASE WHEN count(*) OVER (PARTITION BY host, up, grp) > 1 THEN '~' || grp::BIGINT ELSE node[-1] END AS called FROM i UNION ALL SELECT host, node, var FROM v WHERE var IS NOT NULL),
x AS (SELECT e.host, e.shape, list(called ORDER BY d) AS template FROM e JOIN c ON e.host = c.host AND e.shape[1:d] = c.node GROUP BY 1, 2),
y AS (SELECT s.host, s.shape, coalesce(template, []) AS template, blocked, allowed FROM s LEFT JOIN x ON s.host = x.host AND s.shape = x.shape),
q AS (SELECT coalesce(sum(blocked)::DOUBLE / nullif(sum(blocked + allowed), 0)::DOUBLE, 0) AS q FROM y),
z AS (SELECT host, template, (sum(blocked)::BIGINT + {url_templates.SMOOTHING} * any_value(q.q)) / (sum(blocked + allowed)::BIGINT + {url_templates.SMOOTHING}) AS purity FROM y, q GROUP BY 1, 2),
b AS (SELECT y.host, y.shape FROM y JOIN z ON y.host = z.host AND y.template = z.template WHERE purity >= {url_templates.REJECT}::DOUBLE)
SELECT g.page_id, g.host, g.path, g.rule, coalesce(g.v, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM g LEFT JOIN b ON g.host = b.host AND g.shape = b.shape
"""

COLLOCATION_SQL = f"""
WITH t AS (SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(x, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w JOIN range(1, {collocations.LONGEST + 1}) r(k) ON len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {collocations.THRESHOLD}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE words > 1),
u AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT u.lang, u.phrase, u.words, u.f AS a, l.f AS l, r.f AS r, n.n, u.k, (1000::HUGEINT * u.f * n.n) // (l.f::HUGEINT * r.f) AS score FROM u JOIN n ON n.lang = u.lang
  JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f AS a, unnest(flatten(list_transform(range(2, words), lambda k: list_transform(range(1, words - k + 2), lambda j: array_to_string(ws[j:j+k-1], ' '))))) AS phrase FROM c WHERE words > 2),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {collocations.COVERED_PCT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o QUALIFY rank <= {collocations.TOP}
"""

QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": Query(embedding_near_dedup, EMBEDDING_SQL),
    "op2_language_model": Query(language_model),
    "op3_personal_data": Query(personal_data),
    "op4_mix_sources": Query(mix_sources, MIX_SQL),
    "op5_bpe_round_trip": Query(bpe_round_trip),
    "op6_preference_format": Query(preference_pairs, PREFERENCE_SQL),
    "op7_main_text": Query(main_text),
    "op8_ngram_jaccard_join": Query(jaccard, JACCARD_SQL),
    "op9_token_counts": Query(count_tokens),
    "op10_quality_rules": Query(quality_rules, _quality_sql()),
    "op11_url_filters": Query(url_filters, URL_SQL),
    "op12_filter_audit": Query(filter_interaction_audit, AUDIT_SQL),
    "op13_phrase_collocations": Query(phrase_collocations, COLLOCATION_SQL),
}
