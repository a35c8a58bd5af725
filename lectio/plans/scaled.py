"""Queries that put the operators which need more than one pass over whole tables: upserts of a stream, greedy acceptance, ids as
models write them, ranked lists, nearest lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.functions.tables import named_folder, written
from lectio.functions.text import typed_id
from lectio.functions.values import BULLET_STOPWORDS, SIMILAR_BULLET, SIMILAR_SLIDE
from lectio.operators import deck, extract, knowledge, planning, quiz
from lectio.plans import study
from lectio.plans.corpus import DOC_TERMS, PAGES, SLUG
from lectio.sources.documents import captions, pages_as_documents, table
from lectio.streaming import upserts

STREAM_FILES = 10


def run_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of ten files, each a batch that is upserted into the table of buckets; the table as it is then."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    incoming = written(rows.repartitionByRange(STREAM_FILES, "event_id"), "incoming")
    folder = named_folder(spark, "upserts")
    source = incoming.inputFiles()[0].rsplit("/", 1)[0]  # ten files
    stream = spark.readStream.schema(incoming.schema).option("maxFilesPerTrigger", 1).parquet(source)
    keys, order = ["user_id", "event_type"], ["event_id"]
    upserts.start(stream, f"{folder}/table", f"{folder}/checkpoint", keys, order).awaitTermination()
    found = upserts.BucketTable(spark, f"{folder}/table", keys, order).read()
    return rows.limit(0) if found is None else found


def source_unrepeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents of a source, without those that are much like one before them."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text", "source")
    rows = study.bullets_of(docs, "source").withColumn("bullet_md5", F.md5("bullet"))
    return deck.unrepeated_by_source(rows, drop=("bullet",)).select("source", "doc_id", "slide_index", "bullet_index", "bullet_md5")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key terms of documents as atoms, each with a subtopic, three kinds in turn; a source is one document of the engine."""
    terms = written(extract.key_terms(table(spark, sf_dir, "documents").select("doc_id", "text")), "terms")
    rows = terms.join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    kind = F.element_at(F.array(F.lit("def"), F.lit("ex"), F.lit("dt")), (F.col("n") % 3 + 1).cast("int"))
    atom_id = F.concat(typed_id("def", F.col("term")), F.lit("_"), F.col("doc_id"), F.lit("_"), F.col("n"))
    return rows.select(F.col("source").alias("doc_id"), kind.alias("kind"), F.col("n").cast("int").alias("pos"), atom_id.alias("atom_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("subtopic"))


def term_ids_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of terms as a model may write them (as they are, in capitals, cut before an underscore, cut anywhere, of another kind),
    matched with those of the source."""
    atoms = _terms(spark, sf_dir)
    slug = F.regexp_replace("atom_id", "^[^:]*:", "")
    way = F.pmod(F.crc32(F.encode("atom_id", "UTF-8")), F.lit(5))
    said = (
        F.when(way == 0, F.col("atom_id")).when(way == 1, F.concat(F.lit("DEF:"), F.upper(slug)))
        .when(way == 2, F.concat(F.lit("def:"), F.regexp_extract(slug, "^(.*)_[^_]*_[^_]*$", 1))).when(way == 3, F.concat(F.lit("def:"), F.left(slug, F.lit(2)))).otherwise(F.concat(F.lit("ex:"), slug))
    )
    asked = written(atoms.select("doc_id", said.alias("concept_id")).distinct(), "asked")
    return planning.resolved(asked, atoms, "concept_id").select(F.col("doc_id").alias("source"), "concept_id", "atom_id")


def related_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.related(_terms(spark, sf_dir)).select(F.col("doc_id").alias("source"), "atom_id", "n", "related_id", "score")


def page_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line next to each heading of a page, where it could be a caption; lines are places from their number to the next one."""
    lines = pages_as_documents(table(spark, sf_dir, "pages")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("y0", "text"))
    lines = written(lines.withColumn("page", F.lit(1)).withColumn("y1", F.col("y0") + 1), "lines")
    images = lines.filter("text LIKE '#%'").select("doc_id", "page", F.col("y0").alias("image"), F.lit(1.0).alias("share"), "y0", "y1")
    blocks = lines.filter("text NOT LIKE '#%'").select("doc_id", "page", F.col("y0").alias("block"), "y0", "y1", "text")
    found = captions(images, blocks)
    return found.select(F.col("doc_id").alias("page_id"), F.col("image").alias("line"), F.char_length("caption").alias("n_chars"), F.md5("caption").alias("caption_md5"))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a model's answers in JSON (user turns as definitions, assistant turns as examples, system turns as data, each
    under other names, half of them in a wrapper and a fence), read into atoms."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    of = lambda role, *fields: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["role"] == role), lambda t: F.struct(*(f(t) for f in fields)))
    named = lambda mark, name: lambda t: F.concat(F.lit(mark), t["turn"].cast("string")).alias(name)
    body = F.struct(
        of("user", named("T", "termino"), lambda t: F.left(t["text"], F.lit(200)).alias("definicion")).alias("definiciones"),
        of("assistant", named("E", "name"), lambda t: F.left(t["text"], F.lit(200)).alias("descripcion")).alias("ejemplos"),
        of("system", lambda t: t["turn"].alias("valor"), lambda t: F.left(t["text"], F.lit(100)).alias("description")).alias("datos"),
    )
    bare = F.to_json(F.col("body"))
    payload = F.when(F.col("conv_id") % 2 == 0, bare).otherwise(F.concat(F.lit("Claro:\n```json\n{\"result\": "), bare, F.lit("}\n```\n")))
    answers = rows.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").alias("doc_id"), payload.alias("payload"))
    _, atoms = knowledge.from_answers(answers)
    head, said = F.coalesce("term", "name", "value"), F.coalesce("definition", "description")
    return atoms.select(F.col("doc_id").alias("conv_id"), "kind", "atom_id", head.alias("head"), F.md5(said).alias("said_md5"))


QUERIES = {f.__name__: f for f in (run_upsert_stream, source_unrepeated, term_ids_resolved, related_by_source, page_captions, conversation_answers)}

_STOP = ", ".join(f"'{w}'" for w in BULLET_STOPWORDS)
_TOKENS = rf"list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(strip_accents(bullet)), '[^\p{{L}}\p{{M}}\p{{N}}_\s]+', ' ', 'g'), '\s+')), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w))"
_WORDS = "list_distinct(regexp_extract_all(lower(bullet), '[a-z0-9áéíóúüñ]{3,}'))"
_share = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


def _greedy(name: str, rows: str, by: str, order: str, tokens: str, least: float) -> str:
    """Recursive SQL: rows in order, with the token lists of those that stayed so far."""
    return f"""
{name}_n AS MATERIALIZED (SELECT *, {tokens} AS tk, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS i FROM {rows}),
{name}_r AS (SELECT {by}, i, tk, true AS stays, [tk] AS kept FROM {name}_n WHERE i = 1
  UNION ALL SELECT x.{by}, x.i, x.tk, x.ok, CASE WHEN x.ok THEN list_append(x.kept, x.tk) ELSE x.kept END
  FROM (SELECT n.{by}, n.i, n.tk, r.kept, len(list_filter(r.kept, lambda k: {_share('k', 'n.tk')} >= {least} - 1e-9)) = 0 AS ok FROM {name}_r r JOIN {name}_n n ON n.{by} = r.{by} AND n.i = r.i + 1) x),
{name} AS MATERIALIZED (SELECT n.* FROM {name}_n n JOIN {name}_r r USING ({by}, i) WHERE r.stays)"""


_BULLETS = study.ORACLES["slide_bullets"]
_TERMS = f"""{DOC_TERMS},
atoms AS MATERIALIZED (SELECT source, lang, doc_id, ['def', 'ex', 'dt'][n % 3 + 1] AS kind, n, 'def:' || {SLUG.format('term')} || '_' || doc_id || '_' || n AS atom_id,
    CASE WHEN doc_id % 5 <> 0 THEN lang END AS sub FROM terms JOIN documents USING (doc_id))"""
_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9_\\-]+', '_', 'g'), '_-')"
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(octet_length(encode(atom_id))),
  lambda k: [('0x' || substr(hex(encode(atom_id)), (2 * k + 1)::INT, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END))"""

ORACLES = {
    "run_upsert_stream": study.ORACLES["run_upsert"],
    "slide_unrepeated": f"""WITH RECURSIVE b0 AS (SELECT * FROM ({_BULLETS})),
{_greedy('b1', 'b0', 'doc_id', 'slide_index, bullet_index', _TOKENS, SIMILAR_BULLET)},
s0 AS (SELECT doc_id, slide_index, list_distinct(flatten(list({_WORDS}))) AS words FROM b1 GROUP BY ALL),
{_greedy('s1', 's0', 'doc_id', 'slide_index', 'words', SIMILAR_SLIDE)}
SELECT doc_id, slide_index, row_number() OVER (PARTITION BY doc_id, slide_index ORDER BY bullet_index) AS bullet_index, bullet FROM b1 SEMI JOIN s1 USING (doc_id, slide_index)""",
    # all earlier rows that are similar, by a token in common; then the rows that have any, in order
    "source_unrepeated": f"""WITH RECURSIVE b0 AS (SELECT b.*, source FROM ({study.ORACLES['bullet_clean']}) b JOIN documents USING (doc_id)),
n AS MATERIALIZED (SELECT *, {_TOKENS} AS tk, row_number() OVER (ORDER BY source, doc_id, slide_index, bullet_index) AS i FROM b0),
t AS MATERIALIZED (SELECT source, i, len(tk) AS c, unnest(tk) AS t FROM n),
c AS (SELECT a.i, b.i AS j, count(*) / (any_value(a.c) + any_value(b.c) - count(*)) AS s FROM t a JOIN t b ON a.source = b.source AND a.t = b.t AND b.i < a.i
      AND least(a.c, b.c) >= {SIMILAR_BULLET} * greatest(a.c, b.c) - 1e-9 GROUP BY a.i, b.i),
e AS MATERIALIZED (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS k FROM c WHERE s >= {SIMILAR_BULLET} - 1e-9 GROUP BY i),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
      UNION ALL SELECT e.k, CASE WHEN len(list_filter(e.js, lambda j: NOT list_contains(r.gone, j))) > 0 THEN list_append(r.gone, e.i) ELSE r.gone END FROM r JOIN e ON e.k = r.k + 1),
g AS (SELECT unnest(gone) AS i FROM r WHERE k = (SELECT max(k) FROM r))
SELECT source, doc_id, slide_index, bullet_index, md5(bullet) AS bullet_md5 FROM n ANTI JOIN g USING (i)""",
    "term_ids_resolved": f"""WITH {_TERMS},
w AS (SELECT DISTINCT source, CASE {_CRC} % 5 WHEN 0 THEN atom_id WHEN 1 THEN 'DEF:' || upper(atom_id[5:]) WHEN 2 THEN 'def:' || regexp_extract(atom_id[5:], '^(.*)_[^_]*_[^_]*$', 1)
      WHEN 3 THEN 'def:' || left(atom_id[5:], 2) ELSE 'ex:' || atom_id[5:] END AS concept_id FROM atoms),
v AS (SELECT w.source, concept_id, atom_id, lower(split_part(concept_id, ':', 1)) = 'def' AS kin, {_NORM.format("regexp_replace(concept_id, '^[^:]*:', '')")} AS a, {_NORM.format('atom_id[5:]')} AS s FROM w JOIN atoms a USING (source)),
m AS (SELECT *, CASE WHEN atom_id = concept_id THEN 0 WHEN kin AND a = s THEN 1 WHEN kin AND a <> '' AND starts_with(s, a || '_') THEN 2 END AS step FROM v)
SELECT source, concept_id, arg_min(atom_id, (step, atom_id)) FILTER (step IS NOT NULL) AS atom_id FROM m GROUP BY source, concept_id""",
    "related_by_source": f"""WITH {_TERMS},
p AS (SELECT a.source, a.atom_id, b.atom_id AS related_id, 2 * coalesce((a.sub = b.sub)::INT, 0) + (b.kind = 'ex')::INT AS score FROM atoms a JOIN atoms b ON a.source = b.source AND a.atom_id <> b.atom_id)
SELECT source, atom_id, row_number() OVER (PARTITION BY source, atom_id ORDER BY score DESC, related_id) AS n, related_id, score::BIGINT AS score FROM p QUALIFY n <= 8""",
    "page_captions": rf"""WITH {PAGES},
l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM md),
b AS (SELECT page_id, y, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM l WHERE t NOT LIKE '#%'),
m AS (SELECT i.page_id, i.y AS line, arg_min(b.t, (least(abs(b.y - i.y - 1), abs(b.y + 1 - i.y)), b.y)) AS t FROM l i JOIN b USING (page_id) WHERE i.t LIKE '#%' AND b.t <> '' GROUP BY ALL)
SELECT page_id, line, length(t) AS n_chars, md5(t) AS caption_md5 FROM m WHERE length(t) BETWEEN 10 AND 300""",
    "conversation_answers": """WITH t AS (SELECT conv_id, turn, role, trim(left(coalesce(text, ''), CASE role WHEN 'system' THEN 100 ELSE 200 END)) AS s FROM conversations WHERE role IN ('user', 'assistant', 'system'))
SELECT conv_id, CASE role WHEN 'user' THEN 'def' WHEN 'assistant' THEN 'ex' ELSE 'dt' END AS kind,
       CASE role WHEN 'user' THEN 'def:t' WHEN 'assistant' THEN 'ex:e' ELSE 'dt:' END || turn AS atom_id, CASE role WHEN 'user' THEN 'T' WHEN 'assistant' THEN 'E' ELSE '' END || turn AS head,
       md5(CASE WHEN length(s) >= CASE role WHEN 'system' THEN 3 ELSE 5 END THEN s ELSE CASE role WHEN 'user' THEN 'Concepto: T' WHEN 'assistant' THEN 'Ejemplo: E' ELSE 'Dato: ' END || turn END) AS said_md5 FROM t""",
}
