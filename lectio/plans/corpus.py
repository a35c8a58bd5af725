"""Queries over documents and pages: tokens, terms, chunks, definitions, headings, duplicates, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.text import humanized, slug, split_camel, truncated
from lectio.operators import chunking, extract, knowledge, metrics, simjoin
from lectio.sources.documents import markdown_of, pages_as_documents, table


def doc_token_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 tokens that most documents of a language have."""
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(metrics.metric_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    counts = docs.groupBy("lang", "token").agg(F.count("*").alias("n_docs"))
    n = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n_docs").desc(), "token"))
    return counts.withColumn("rank", n).filter("rank <= 20")


def doc_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.key_terms(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.definitions(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_without_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.without_hints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.formulas(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On texts without headings and blank lines, chunks are slices."""
    found = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "chunk_index", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def doc_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together again as numbered partial texts."""
    joined = chunking.summarised(chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return joined.select("doc_id", F.char_length("partials").alias("n_chars"), F.md5("partials").alias("partials_md5"))


def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different token sets with a similarity of 0.7 or more; doc_near_dup_members has the documents of each."""
    docs = table(spark, sf_dir, "documents")
    sets = docs.select(F.col("doc_id").alias("id"), metrics.metric_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = simjoin.similar_classes(sets, 0.7)
    return found.select("a", "b", F.bround("similarity", 6).alias("similarity"))


def doc_near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the class of its token set (a and b of doc_near_dup), and how many documents have it."""
    docs = table(spark, sf_dir, "documents")
    sets = docs.select(F.col("doc_id").alias("id"), metrics.metric_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = simjoin.classes(sets)
    return found.join(found.groupBy("class_id").agg(F.count("*").alias("n")), "class_id").select(F.col("id").alias("doc_id"), "class_id", "n")


def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.containing(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", markdown_of(F.coalesce("html", F.lit(""))).alias("md"))
    return pages.select("page_id", F.char_length("md").alias("n_chars"), F.md5("md").alias("markdown_md5"))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.headings(pages_as_documents(table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "pos", "level", "title")


def page_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knowledge.topics(pages_as_documents(table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "main_topic", slug(F.col("main_topic")).alias("slug"), truncated(F.col("main_topic"), 40).alias("short"), F.md5(split_camel(F.col("main_topic"))).alias("camel_md5"))


def page_subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knowledge.subtopics(pages_as_documents(table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "n", "subtopic")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each page's Markdown, with their length and the title as an identifier shows it."""
    pages = pages_as_documents(table(spark, sf_dir, "pages"))
    rows = pages.select("doc_id", F.posexplode(chunking.sections(F.col("text"))).alias("pos", "section"))
    first = F.regexp_replace(F.substring_index("section", "\n", 1), r"^#+\s+", "")
    return rows.select(F.col("doc_id").alias("page_id"), "pos", F.char_length("section").alias("n_chars"), F.md5(humanized(slug(first))).alias("title_md5"))


QUERIES = {f.__name__: f for f in (doc_token_top, doc_key_terms, doc_definitions, doc_formulas, doc_without_hints, doc_chunks, doc_partials, doc_exact_dedup, doc_near_dup, doc_near_dup_members, passage_containment, page_markdown, page_headings, page_topic, page_subtopics, page_sections)}

TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower(strip_accents({0})), '[a-z0-9áéíóúüñ]{{3,}}')), lambda t: NOT list_contains(['del','las','los','una','unos','unas','con','por','para','que','como','son','sus','les','este','esta','estos','estas','entre','sobre','sin','pero','mas','cual','cuando','donde','mismo','misma','tambien','tras','hasta'], t))"
CLEAN_TERM = r"regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g'), ' .,:;-—'), '^(?i:el|la|los|las|un|una|unos|unas)\s+', '')"
CLEAN_DEF = r"(CASE WHEN regexp_matches(trim(regexp_replace({0}, '\s+', ' ', 'g')), '[:;]$') THEN rtrim(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '[:;]$', '')) || '.' WHEN suffix(trim(regexp_replace({0}, '\s+', ' ', 'g')), '.') THEN trim(regexp_replace({0}, '\s+', ' ', 'g')) ELSE trim(regexp_replace({0}, '\s+', ' ', 'g')) || '.' END)"
IS_A = r"(?:^|[^\p{L}\p{N}_¿])((?:[A-ZÁÉÍÓÚÜÑ][\p{L}\p{N}_\-]*(?:\s+[a-záéíóúüñ]{1,4}\s+|\s+)){0,3}[A-ZÁÉÍÓÚÜÑ][\p{L}\p{N}_\-]*)\s+(?:es|son)\s+([^.;:\n]{8,240}[.;:])"
CALLED = r"(?i)Se\s+(?:llama|denomina|define(?:\s+como)?)\s+([\p{L}\p{N}_\-]{2,60})\s+(?:a|como)\s+([^.;:\n]{8,240}[.;:])"
BOLD_COLON = r"\*\*([^*\n]{2,80})\*\*\s*[:\-—]\s*([^.\n]{10,300}\.)"
_each = lambda rank, p: f"SELECT doc_id, {rank} AS rank, unnest(regexp_extract_all(text, '{p}', 1)) AS t, unnest(regexp_extract_all(text, '{p}', 2)) AS d, generate_subscripts(regexp_extract_all(text, '{p}', 1), 1) AS pos FROM documents"
DEFS = f"""
raw AS ({_each(0, BOLD_COLON)} UNION ALL {_each(1, IS_A)} UNION ALL {_each(2, CALLED)}),
cleaned AS (SELECT doc_id, rank, pos, {CLEAN_TERM.format('t')} AS term, {CLEAN_DEF.format('d')} AS definition FROM raw),
fit AS (SELECT * FROM cleaned WHERE term <> '' AND (rank = 0 OR (length(term) <= 60 AND len(regexp_split_to_array(term, '\\s+')) <= 6 AND len(regexp_split_to_array(definition, '\\s+')) >= 3))),
once AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY rank, pos) = 1),
defs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, pos) AS n, term, definition FROM once QUALIFY n <= 20)"""
FORMULAS = r"""
fraw AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^\s*([^\n]{3,160}=[^\n]{1,160})\s*$', 1)) AS c, generate_subscripts(regexp_extract_all(text, '(?m)^\s*([^\n]{3,160}=[^\n]{1,160})\s*$', 1), 1) AS pos FROM documents),
ffit AS (SELECT doc_id, pos, trim(c, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM fraw),
fonce AS (SELECT * FROM ffit WHERE length(content) - length(replace(content, '=', '')) <= 3 AND regexp_matches(content, '[\d\+\-\*/\^±√π∑∏∞≤≥≠∈∉⊂⊃∪∩∂Δ∇αβγδεθλμνξρστφχψω]')
          AND len(regexp_split_to_array(content, '\s+')) <= 18 AND content <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(content) ORDER BY pos) = 1),
formulas AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, content FROM fonce QUALIFY n <= 15)"""
_entities = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"


def _markdown(html: str) -> str:
    t = html
    for tag in ("script", "style", "nav", "footer", "head"):  # RE2 has no back references
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<!--.*?-->', '', 'g')"
    for k in range(1, 7):
        t = f"regexp_replace({t}, '(?i)<h{k}\\b[^>]*>', chr(10) || '{'#' * k} ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:b|strong)\\b[^>]*>', '**', 'g')"
    t = f"regexp_replace({t}, '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\b[^>]*>|</?(?:p|h[1-6]|ul|ol|div|article|section)\\b[^>]*>', chr(10), 'g')"
    t = _entities.format(f"regexp_replace({t}, '<[^>]*>', '', 'g')")
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({t}, ' ' || chr(9) || chr(10))"


PAGES = f"md AS MATERIALIZED (SELECT page_id, {_markdown('html')} AS text FROM pages)"
HEADS = r"heads AS (SELECT page_id, generate_subscripts(regexp_extract_all(text, '(?m)^(#{1,6})\s+(.+?)\s*$', 1), 1) - 1 AS pos, length(unnest(regexp_extract_all(text, '(?m)^(#{1,6})\s+(.+?)\s*$', 1))) AS level, trim(unnest(regexp_extract_all(text, '(?m)^(#{1,6})\s+(.+?)\s*$', 2))) AS title FROM md)"
TERMS = f"""
t0 AS (SELECT {{id}}, 0 AS rank, generate_subscripts(regexp_extract_all(text, '\\*\\*([^\\*\\n]{{{{2,60}}}})\\*\\*', 1), 1) AS pos, unnest(regexp_extract_all(text, '\\*\\*([^\\*\\n]{{{{2,60}}}})\\*\\*', 1)) AS t FROM {{table}}
       UNION ALL SELECT {{id}}, 1, generate_subscripts(regexp_extract_all(text, '(?m)^#{{{{1,6}}}}\\s+(.+?)\\s*$', 1), 1), unnest(regexp_extract_all(text, '(?m)^#{{{{1,6}}}}\\s+(.+?)\\s*$', 1)) FROM {{table}}),
t1 AS (SELECT {{id}}, rank, pos, trim({CLEAN_TERM.format('t')}) AS term FROM t0),
t2 AS (SELECT * FROM t1 WHERE length(term) BETWEEN 2 AND 80 AND NOT (rank = 1 AND lower(term) IN ('contexto de imágenes', 'indice', 'índice'))
       QUALIFY row_number() OVER (PARTITION BY {{id}}, lower(term) ORDER BY rank, pos) = 1),
terms AS (SELECT {{id}}, row_number() OVER (PARTITION BY {{id}} ORDER BY rank, pos) AS n, term FROM t2 QUALIFY n <= 60)""".replace("{{{{", "{{").replace("}}}}", "}}")
DOC_TERMS = TERMS.replace("{id}", "doc_id").replace("{table}", "documents").replace("{{", "{").replace("}}", "}")
PAGE_TERMS = TERMS.replace("{id}", "page_id").replace("{table}", "md").replace("{{", "{").replace("}}", "}")
SLUG = r"left(coalesce(nullif(trim(regexp_replace(lower(strip_accents(CASE WHEN contains({0}, ':') THEN regexp_replace({0}, '(?s)^[^:]*:', '') ELSE {0} END)), '[^a-z0-9_\-]+', '_', 'g'), '_-'), ''), 'item'), 40)"
SLICES = """
s AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
c AS (SELECT doc_id, i AS chunk_index, CASE WHEN length(t) <= 3000 THEN t ELSE substr(t, 3000 * i + 1, 3000) END AS piece FROM s, unnest(range(0, greatest(1, ((length(t) + 2999) // 3000))::BIGINT)) AS r(i) WHERE t <> ''),
chunks AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN piece ELSE right(lag(piece) OVER (PARTITION BY doc_id ORDER BY chunk_index), 250) || chr(10) || chr(10) || piece END AS text FROM c)"""
ENTITY = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
TOPIC = rf"""
ok AS (SELECT * FROM heads WHERE level <= 2 AND length(title) BETWEEN 2 AND 200 AND NOT regexp_matches(title, '^(?i)(?:\d+[\.\)]?\s+)?(?:introduccion|introducción|resumen|abstract|indice|índice|contenido|tabla\s+de\s+contenidos|prefacio|prologo|prólogo|agradecimientos|capitulo|capítulo|tema|leccion|lección)(?:[^\p{{L}}\p{{N}}_]|$)')),
h1 AS (SELECT page_id, title FROM ok QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY level, pos) = 1),
topic AS (SELECT md.page_id, left(coalesce(h1.title, terms.term, 'Documento'), 200) AS main_topic FROM md LEFT JOIN h1 USING (page_id) LEFT JOIN terms ON terms.page_id = md.page_id AND n = 1)"""

ORACLES = {
    "doc_token_top": f"SELECT lang, token, count(*) AS n_docs, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS rank FROM (SELECT lang, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY lang, token QUALIFY rank <= 20",
    "doc_key_terms": f"WITH {DOC_TERMS} SELECT doc_id, n, term FROM terms",
    "doc_definitions": f"WITH {DEFS} SELECT doc_id, n, term, definition FROM defs",
    "doc_formulas": f"WITH {FORMULAS} SELECT doc_id, n, content FROM formulas",
    "doc_without_hints": f"WITH {DEFS}, {FORMULAS}, {DOC_TERMS} SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM defs UNION SELECT doc_id FROM formulas UNION SELECT doc_id FROM terms UNION SELECT doc_id FROM documents WHERE contains(text, '```'))",
    "doc_chunks": f"WITH {SLICES} SELECT doc_id, chunk_index, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks",
    "doc_partials": f"WITH {SLICES}, p AS (SELECT doc_id, string_agg('[Resumen parcial ' || (chunk_index + 1) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS partials FROM chunks GROUP BY doc_id) SELECT doc_id, length(partials) AS n_chars, md5(partials) AS partials_md5 FROM p",
    "doc_exact_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents",
    "doc_near_dup": f"WITH s AS MATERIALIZED (SELECT min(doc_id) AS id, t, len(t) AS n FROM (SELECT doc_id, list_sort({TOKENS.format('text')}) AS t FROM documents) WHERE len(t) > 0 GROUP BY t), p AS (SELECT x.id AS i, y.id AS j, len(list_intersect(x.t, y.t)) AS c, x.n + y.n AS m FROM s x JOIN s y ON x.id < y.id AND least(x.n, y.n) >= 0.7 * greatest(x.n, y.n)) SELECT i AS a, j AS b, round_even(c / (m - c), 6) AS similarity FROM p WHERE c / (m - c) >= 0.7 - 1e-9",
    "doc_near_dup_members": f"WITH s AS (SELECT doc_id, list_sort({TOKENS.format("coalesce(text, '')")}) AS t FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS n FROM s",
    "passage_containment": f"SELECT item_id, doc_id FROM (SELECT item_id, {ENTITY.format('text')} AS p FROM benchmark) JOIN (SELECT doc_id, {ENTITY.format('text')} AS d FROM documents) ON contains(' ' || d || ' ', ' ' || p || ' ') WHERE p <> ''",
    "page_markdown": f"WITH {PAGES} SELECT page_id, length(text) AS n_chars, md5(text) AS markdown_md5 FROM md",
    "page_headings": f"WITH {PAGES}, {HEADS} SELECT page_id, pos, level, title FROM heads",
    "page_topic": f"WITH {PAGES}, {HEADS}, {PAGE_TERMS}, {TOPIC} SELECT page_id, main_topic, {SLUG.format('main_topic')} AS slug, CASE WHEN length(main_topic) <= 40 THEN main_topic ELSE rtrim(left(main_topic, 39)) || '…' END AS short, md5(regexp_replace(main_topic, '([a-záéíóúñ])([A-ZÁÉÍÓÚÑ])', '\\1 \\2', 'g')) AS camel_md5 FROM topic",
    "page_subtopics": f"WITH {PAGES}, {HEADS}, {PAGE_TERMS}, r AS (SELECT page_id, level AS rank, pos, title FROM heads WHERE level IN (2, 3) UNION ALL SELECT page_id, 4, n, term FROM terms WHERE n <= 15), b AS (SELECT * FROM r WHERE title <> '' QUALIFY rank = min(rank) OVER (PARTITION BY page_id)), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY page_id, lower(title) ORDER BY pos) = 1) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n, left(title, 120) AS subtopic FROM o QUALIFY n <= 30",
    "page_sections": f"WITH {PAGES}, x AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(#{{1,6}}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS ps FROM md), y AS (SELECT page_id, unnest(ps) AS section, generate_subscripts(ps, 1) - 1 AS pos FROM x), z AS (SELECT *, {SLUG.format("regexp_replace(string_split(section, chr(10))[1], '^#+\\s+', '')")} AS sl FROM y) SELECT page_id, pos, length(section) AS n_chars, md5(list_aggregate(list_transform(string_split(trim(regexp_replace(sl, '[_\\-\\s]+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('poo', 'oop') THEN upper(w) WHEN w = 'java' THEN 'Java' ELSE upper(left(w, 1)) || substr(w, 2) END), 'string_agg', ' ')) AS title_md5 FROM z",
}
