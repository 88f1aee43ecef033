"""One registered query per operator: ``fn(spark, sf_dir) -> DataFrame`` over whole tables,
and the DuckDB twin of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import (
    bpe, collocations, language_id, license_scan, mixing, quality_classifier, quality_rules, ranked_search, secret_scan,
    sentence_spans, simhash, suffix_dedup, topk_search,
)
from lumen.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file (installed on every node, never in this repository)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_fertility_rules")
def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and tokeniser fertility of all documents, with the rules' verdict."""
    import public_tokenizers
    return quality_rules.measured_rules(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
        vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, 3 or fewer differing bits."""
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@register("op4_sentence_spans", rf"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{sentence_spans.STOPS}\n]+[{sentence_spans.STOPS}]*|[{sentence_spans.STOPS}\n]') AS list
  FROM documents),
placed AS (SELECT doc_id, unnest(list) AS piece, generate_subscripts(list, 1) AS place FROM pieces),
sentences AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n,
         trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g')) AS words
  FROM placed WHERE regexp_matches(piece, '[^{sentence_spans.STOPS}\x20\x09-\x0D]')),
summed AS (
  SELECT *, sum(len(string_split(words, ' '))) OVER (PARTITION BY doc_id ORDER BY n) AS total,
         count(*) OVER (PARTITION BY doc_id) AS last
  FROM sentences),
ends AS (
  SELECT s.doc_id, s.n, min(e.n) AS finish
  FROM summed s JOIN summed e ON e.doc_id = s.doc_id AND e.n >= s.n AND e.n < s.n + 20 + {sentence_spans.MIN_WORDS}
    AND e.total >= s.total - len(string_split(s.words, ' ')) + {sentence_spans.MIN_WORDS}
    AND e.n >= s.n + least({sentence_spans.SPAN}, s.last) - 1
  GROUP BY s.doc_id, s.n),
runs AS (
  SELECT x.doc_id, x.n, x.finish, string_agg(s.words, chr(10) ORDER BY s.n) AS run
  FROM ends x JOIN sentences s ON s.doc_id = x.doc_id AND s.n BETWEEN x.n AND x.finish GROUP BY ALL),
ranked AS (SELECT doc_id, n, finish, row_number() OVER (PARTITION BY run ORDER BY doc_id, n) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(n, finish + 1)) AS n FROM ranked WHERE k > 1),
counted AS (
  SELECT s.doc_id, count(*) AS n_sentences, count(g.n) AS n_removed
  FROM sentences s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.n = g.n GROUP BY s.doc_id),
left_over AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.place) AS kept
  FROM placed p LEFT JOIN (SELECT s.doc_id, s.place FROM sentences s JOIN gone g ON s.doc_id = g.doc_id AND s.n = g.n) x
    ON p.doc_id = x.doc_id AND p.place = x.place
  WHERE x.place IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(c.n_sentences, 0)::BIGINT AS n_sentences, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(l.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN left_over l ON d.doc_id = l.doc_id
""")
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of runs that occur before."""
    out = sentence_spans.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op5_suffix_array_dedup", """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) AS p FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (
  SELECT w.doc_id, p, p - lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS gap
  FROM windows w JOIN firsts USING (s) WHERE first < w.doc_id),
islands AS (
  SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM hits),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM islands GROUP BY doc_id, span),
gaps AS (
  SELECT s.doc_id, s.a, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS since FROM spans s),
parts AS (
  SELECT g.doc_id, g.a, substr(h, 2 * since + 1, 2 * (g.a - since)) AS part FROM gaps g JOIN bytes USING (doc_id)),
cut AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head FROM parts GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM spans GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN total USING (doc_id) LEFT JOIN cut USING (doc_id)
""")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that start in an earlier one."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("begins").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def _license_sql() -> str:
    """The scan in DuckDB, with the library's licences and notices as rows."""
    line = "trim(regexp_replace(replace(lower(x), '©', ' copyright c '), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    for other, one in license_scan.EQUIVALENT:
        line = f"replace({line}, '{other}', '{one}')"
    # no look-ahead in DuckDB: a line of a holder's name is matched first and the body's lines taken out
    body = f"(the|{license_scan.BODY})( |$)"
    holders = license_scan.HOLDER.split("|^")
    named = next(h for h in holders if f"(?!{body})" in h)
    others = "|^".join([license_scan.COPYRIGHT, *[h.removeprefix("^") for h in holders if h != named]])
    name, before = "^" + named.replace(f"(?!{body})", ""), "^" + named.split("(?!")[0]
    owner = f"regexp_matches(y, '{others}') OR regexp_matches(y, '{name}') AND NOT regexp_matches(y, '{before}{body}')"
    lines = (f"list_filter(list_transform(list_transform(string_split(text, chr(10)), lambda x: {line}), "
             f"lambda y: CASE WHEN {owner} THEN '' ELSE y END), lambda x: x <> '')")
    digest = "CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END"

    def rows(texts: list[tuple[str, str]]) -> str:
        return ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in texts)

    return f"""
WITH licenses(license_id, text) AS (VALUES {rows(sorted(license_scan.LICENSES.items()) + license_scan.long_licenses())}),
notices(notice_id, text) AS (VALUES {rows(sorted(license_scan.NOTICES.items()))}),
known AS (SELECT {digest} AS digest, min(license_id) AS license_id FROM (SELECT license_id, {lines} AS lines FROM licenses) GROUP BY 1),
named AS (SELECT array_to_string(lines, ' ') AS form, notice_id FROM (SELECT notice_id, {lines} AS lines FROM notices)),
docs AS (SELECT doc_id, {lines} AS lines FROM documents),
found AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notice_ids
  FROM (SELECT doc_id, unnest(lines) AS form FROM docs) JOIN named USING (form) GROUP BY doc_id)
SELECT d.doc_id, {digest} AS text_digest, k.license_id, coalesce(f.n_notices, 0)::BIGINT AS n_notices,
       coalesce(f.notice_ids, '') AS notice_ids
FROM docs d LEFT JOIN known k ON {digest} = k.digest LEFT JOIN found f ON d.doc_id = f.doc_id
"""


@register("op6_license_scan", _license_sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and licence notices of all documents by canonical digest."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the word-end BPE vocabulary."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@register("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality score of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model)


@register("op9_mix_sources", """
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM per),
filled AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY full_at, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY full_at, source NULLS LAST) AS place
  FROM filled),
held AS (SELECT arg_min(level, place) AS top_level FROM levels WHERE level < full_at),
targets AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size, coalesce((SELECT top_level FROM held) * weight, 3.0::DOUBLE * source_size)) AS target
  FROM levels),
planned AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('9:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM planned
""")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 5, 2, 1 in turn, at most three repeats."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register("op10_top_k_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT query_id, vec_id, list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of every 20th embedding with all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans_sql() -> str:
    """Every rule's matches between two marks that texts don't have, then places by lengths."""
    found = []
    for place, rule in enumerate(secret_scan.RULES):
        head = rule.head
        if rule.ignore_case:  # ASCII letters only, where (?i) would fold others too
            head = re.sub(r"\\x..|[a-z]", lambda m: m[0] if len(m[0]) > 1 else f"[{m[0]}{m[0].upper()}]", head)
        pattern, head = (head + rule.value).replace("'", "''"), head.replace("'", "''")
        value = f"length(m) - length(regexp_extract(m, '^{head}'))" if head else "length(m)"
        found.append(rf"""
  SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, p AS begin, p + length(m) AS finish, {value} AS size, {rule.least} AS least
  FROM (SELECT doc_id, part, string_split(part, chr(57345))[1] AS m, i,
               coalesce(sum(length(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (
                   PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p
        FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
              FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS parts FROM docs)))
  WHERE i > 1""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(found)}),
spans AS (SELECT *, kind || ':' || begin || ':' || finish AS span FROM matches WHERE size >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY begin, place) FILTER (place < {len(secret_scan.BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY begin, place), '') AS spans
FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


@register("op12_secret_scan", _spans_sql())
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by one combined automaton."""
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


@register("op13_ranked_search", rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
size AS (SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS all_n, sum(n)::BIGINT AS all_l FROM size),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY 1, 2),
w AS (
  SELECT term, floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY term, all_n),
impact AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_n) // all_l)) AS impact
  FROM tf JOIN size USING (doc_id), whole),
asked AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY 1, 2),
scored AS (
  SELECT item_id, doc_id, sum(q * w * impact)::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN impact USING (term) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _collocations_sql(least: int = 100, first: int = 2000) -> str:
    """Phrases of 1 to 5 words of all pieces, counted; cuts by the parts' counts."""
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {LOWER.format('text')} AS t FROM documents),
pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(own, '[^\x20\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS own FROM docs)),
placed AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM pieces),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4, lead(w1, 4) OVER x AS w5
  FROM placed WINDOW x AS (PARTITION BY piece ORDER BY i)),
counted AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*)::BIGINT AS f FROM runs GROUP BY ALL UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least} UNION ALL
  SELECT lang, 3, concat_ws(' ', w1, w2, w3), count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least} UNION ALL
  SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4), count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least} UNION ALL
  SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5), count(*) FROM runs WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE f >= {least}),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, s.k AS cut, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM frequent c JOIN range(1, 6) s(k) ON s.k < c.k
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:s.k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[s.k + 1:], ' ')
  JOIN total t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
inner_phrases AS (
  SELECT DISTINCT lang, array_to_string(w[x.i:x.i + s.k - 1], ' ') AS phrase, f
  FROM frequent c JOIN range(1, 6) s(k) ON s.k < c.k, LATERAL (SELECT unnest(range(1, c.k - s.k + 2)) AS i) x),
within AS (SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM lowest c LEFT JOIN within x ON x.lang = c.lang AND x.phrase = c.phrase
  WHERE place = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {first}
"""


@register("op11_collocations", _collocations_sql())
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
