"""The knowledge base: typed atoms of each document, its topic and subtopics, grounding, what models answer.

An atom is a row: doc_id, kind (def, ex, fc, dt, rel), pos, atom_id, subtopic, and the fields of its kind: term,
definition; name, description, attributes, methods; fc_kind, content, caption, language; value; rel_kind, source, target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.answers import entries, parsed, picked, unwrapped
from lectio.functions.tables import written
from lectio.functions.text import entity, entity_in, mapped, one_space, stripped, typed_id
from lectio.functions.values import (
    ANSWER_WRAPPERS, ATOM_BOUNDS, ATOM_FIELDS, ATOM_KINDS, ATOM_LISTS, CONCLUSION_FIELDS, ID_SEEDS, MAX_CONCLUSIONS, MAX_LISTED, MAX_SUBTOPICS, RELATION_PHRASES, SUBTOPIC_FIELDS, TOPIC_FIELDS,
)
from lectio.operators import extract

TEXTS = ("term", "definition", "name", "description", "fc_kind", "content", "caption", "language", "value", "rel_kind", "source", "target", "subtopic")
ARRAYS = ("attributes", "methods")
COLUMNS = ("doc_id", "kind", "pos", "atom_id", *TEXTS, *ARRAYS)

# --- fixed values: headings and topics that say nothing ---------------------------------------------------------------
GENERIC_HEADING = (
    r"(?iU)^(?:\d+[\.\)]?\s+)?(?:introduccion|introducción|resumen|abstract|indice|índice|contenido|tabla\s+de\s+contenidos|prefacio|prologo|prólogo|"
    r"agradecimientos|capitulo|capítulo|tema|leccion|lección)\b"
)
PLACEHOLDER_TOPIC = r"(?i)^\s*cadena\s+\d|^\s*string\s+\d|^\s*<.*>\s*$|^\s*\.\.\.\s*$|^\s*texto\s+aqui|^\s*tema\s+del\s+documento\s*$"
DEFAULT_TOPIC = "Documento"


def as_atoms(rows: DataFrame) -> DataFrame:
    """rows with all COLUMNS, null where a kind has no such field."""
    have = set(rows.columns)
    fill = {c: F.lit(None).cast("string") for c in TEXTS} | {c: F.lit(None).cast("array<string>") for c in ARRAYS}
    return rows.select(*(F.col(c) if c in have else fill[c].alias(c) for c in COLUMNS))


def kind_rank(kind: Column, order: tuple[str, ...] = ATOM_KINDS) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), kind)


def unique_ids(rows: DataFrame, base: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """atom_id: the base id, or, where it is taken, with the first of _2, _3 and so on that is free in the document. taken:
    doc_id, ids (array) that are not free from the start. Rows are taken in order; only documents with a clash are folded."""
    numbered = rows.withColumn("lectio_at", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    in_order = F.array_sort(F.collect_list(F.struct("lectio_at", F.col(base).alias("b"))))
    per = numbered.groupBy("doc_id").agg(F.transform(in_order, lambda x: x["b"]).alias("bases"))
    none = F.array().cast("array<string>")
    per = per.join(taken.select("doc_id", F.col("ids").alias("start")), "doc_id", "left") if taken is not None else per.withColumn("start", none)
    per = per.withColumn("start", F.coalesce("start", none))
    named = lambda b, n: F.concat(b, F.lit("_"), n.cast("string"))
    first_free = lambda used, b: F.element_at(F.filter(F.sequence(F.lit(2), F.size(used) + 2), lambda n: ~F.array_contains(used, named(b, n))), 1)
    settled = F.aggregate("bases", F.col("start"), lambda used, b: F.concat(used, F.array(F.when(F.array_contains(used, b), named(b, first_free(used, b))).otherwise(b))))
    every = F.concat("start", "bases")
    ids = F.when(F.size(F.array_distinct(every)) == F.size(every), F.col("bases")).otherwise(F.slice(settled, F.size("start") + 1, F.size("bases")))
    named_rows = per.select("doc_id", F.posexplode(ids).alias("p", "atom_id")).select("doc_id", (F.col("p") + 1).alias("lectio_at"), "atom_id")
    return numbered.join(named_rows, ["doc_id", "lectio_at"]).drop("lectio_at")


# --- fixed values: what looks like code and what like a formula, in texts and in answers --------------------------------
def code_or_formula(c: Column) -> Column:
    """By keywords and signs: code, formula, otherwise code."""
    return (
        F.when(c.rlike(r"\b(def|class|function|public|private|return|var|let|const)\b") | c.rlike(r"\b(import|from)\b\s+\w+"), "code")
        .when(c.rlike(r"[=<>]|\b\d+\s*[+\-*/]\s*\d+\b") & ~c.rlike(r"[{};]"), "formula")
        .otherwise("code")
    )


def code_or_formula_of_answer(c: Column) -> Column:
    """The same for a model's answer, which counts more words and any bracket or semicolon as code."""
    words = r"\b(def|class|function|public|private|return|var|let|const|import|from|if|else|while|for)\b"
    return F.when(c.rlike(words) | c.rlike(r"[{};]"), "code").when(c.rlike(r"[=<>]|\b\d+\s*[+\-*/]\s*\d+\b"), "formula").otherwise("code")


def fallback_atoms(docs: DataFrame) -> DataFrame:
    """The atoms that a document gives literally: definitions, code, formulas."""
    d = extract.definitions(docs).filter("char_length(definition) >= 5")
    d = unique_ids(d.withColumn("base", typed_id("def", F.col("term"))), "base", ["n"])
    d = d.select("doc_id", F.lit("def").alias("kind"), F.col("n").alias("pos"), "atom_id", F.left("term", F.lit(120)).alias("term"), F.left("definition", F.lit(600)).alias("definition"))
    c = extract.code_blocks(docs).select("doc_id", F.lit("fc").alias("kind"), F.col("n").alias("pos"), F.concat(F.lit("fc:code_"), "n").alias("atom_id"), F.lit("code").alias("fc_kind"), F.left("content", F.lit(2000)).alias("content"), "language")
    f = extract.formulas(docs).select("doc_id", F.lit("fc").alias("kind"), (F.col("n") + 1000).alias("pos"), F.concat(F.lit("fc:formula_"), "n").alias("atom_id"), code_or_formula(F.col("content")).alias("fc_kind"), F.left("content", F.lit(2000)).alias("content"))
    return as_atoms(d).unionByName(as_atoms(c)).unionByName(as_atoms(f))


def is_meaningful(title: Column) -> Column:
    t = stripped(title)
    return (F.char_length(t) >= 2) & (F.char_length(t) <= 200) & ~t.rlike(GENERIC_HEADING)


def topics(docs: DataFrame) -> DataFrame:
    """doc_id, main_topic: the first heading of level 1, else of level 2, that says something, else the first key term."""
    heads = extract.headings(docs).filter((F.col("level") <= 2) & is_meaningful(F.col("title")))
    first = heads.groupBy("doc_id").agg(F.min_by("title", F.struct("level", "pos")).alias("head"))
    term = extract.key_terms(docs).filter("n = 1").select("doc_id", "term")
    found = docs.select("doc_id").distinct().join(first, "doc_id", "left").join(term, "doc_id", "left")
    return found.select("doc_id", F.left(F.coalesce("head", "term", F.lit(DEFAULT_TOPIC)), F.lit(200)).alias("main_topic"))


def subtopics(docs: DataFrame) -> DataFrame:
    """doc_id, n, subtopic: headings of level 2, else of level 3, else the first 15 key terms; up to 30."""
    heads = extract.headings(docs).filter(F.col("level").isin(2, 3)).select("doc_id", F.col("level").alias("rank"), "pos", "title")
    terms = extract.key_terms(docs).filter("n <= 15").select("doc_id", F.lit(4).alias("rank"), F.col("n").alias("pos"), F.col("term").alias("title"))
    rows = heads.unionByName(terms).filter("title <> ''").withColumn("best", F.min("rank").over(W.partitionBy("doc_id"))).filter("rank = best")
    found = extract.firsts(rows, F.lower("title"), ["pos"], 30, "n")
    return found.select("doc_id", "n", F.left("title", F.lit(120)).alias("subtopic"))


def relation_phrase(kind: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    other = F.trim(F.replace(key, F.lit("_"), F.lit(" ")))
    known = F.when(key.isin(*RELATION_PHRASES), mapped(key, RELATION_PHRASES))
    return F.coalesce(known, F.nullif(other, F.lit("")), F.lit("se relaciona con"))


def relation_sentence(source: Column, kind: Column, target: Column, description: Column) -> Column:
    base = F.trim(F.concat_ws(" ", source, relation_phrase(kind), target))
    return F.when(F.coalesce(description, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(" ("), description, F.lit(")")))


def by_subtopic(atoms: DataFrame) -> DataFrame:
    """doc_id, subtopic (bare), atom_ids in order."""
    ordered = F.array_sort(F.collect_list(F.struct(kind_rank(F.col("kind")).alias("k"), "pos", "atom_id")))
    return atoms.groupBy("doc_id", F.trim(F.coalesce("subtopic", F.lit(""))).alias("subtopic")).agg(F.transform(ordered, lambda a: a["atom_id"]).alias("atom_ids"))


def first_by_id(atoms: DataFrame) -> DataFrame:
    """One atom for each id of a document, the first; joins by id are then to one row."""
    n = F.row_number().over(W.partitionBy("doc_id", "atom_id").orderBy(kind_rank(F.col("kind")), "pos"))
    return atoms.withColumn("lectio_n", n).filter("lectio_n = 1").drop("lectio_n")


def grounded(atoms: DataFrame, docs: DataFrame) -> DataFrame:
    """Atoms that their text bears out: examples whose name is in it, with those attributes and methods that are, and
    relations whose both ends are. Without a text nothing is dropped."""
    texts = docs.select("doc_id", entity(F.coalesce("text", F.lit(""))).alias("lectio_text"))
    both = atoms.join(texts, "doc_id", "left")
    none = F.coalesce("lectio_text", F.lit("")) == ""
    there = lambda c: entity_in(c, F.col("lectio_text"))
    keep = (
        none
        | ~F.col("kind").isin("ex", "rel")
        | ((F.col("kind") == "ex") & there(F.col("name")))
        | ((F.col("kind") == "rel") & there(F.col("source")) & there(F.col("target")))
    )
    pruned = both.filter(keep)
    for c in ARRAYS:
        pruned = pruned.withColumn(c, F.when(none, F.col(c)).otherwise(F.filter(c, there)))
    return pruned.drop("lectio_text")


def enriched(atoms: DataFrame, docs: DataFrame) -> DataFrame:
    """atoms and the definitions and code of the text that are new to them; what is there stays as it is."""
    d = extract.definitions(docs).withColumn("key", entity(F.col("term")))
    known = atoms.filter("kind = 'def'").select("doc_id", entity(F.col("term")).alias("key"))
    fresh = extract.firsts(d.join(known, ["doc_id", "key"], "left_anti").filter("key <> ''").withColumn("pos", F.col("n")), F.col("key"), ["pos"], 1 << 30, "m")
    taken = atoms.groupBy("doc_id").agg(F.collect_set("atom_id").alias("ids"))
    fresh = unique_ids(fresh.withColumn("base", typed_id("def", F.col("term"))), "base", ["m"], taken)
    fresh = fresh.select("doc_id", F.lit("def").alias("kind"), (F.col("m") + 10_000).alias("pos"), "atom_id", "term", "definition")
    head = lambda c: F.left(one_space(c), F.lit(200))
    code = extract.code_blocks(docs).withColumn("key", head(F.col("content")))
    known = atoms.filter("kind = 'fc'").select("doc_id", head(F.col("content")).alias("key"))
    code = extract.firsts(code.join(known, ["doc_id", "key"], "left_anti").withColumn("pos", F.col("n")), F.col("key"), ["pos"], 1 << 30, "m")
    code = code.select("doc_id", F.lit("fc").alias("kind"), (F.col("m") + 10_000).alias("pos"), F.concat(F.lit("fc:hint_code_"), "m").alias("atom_id"), F.lit("code").alias("fc_kind"), "content", "language")
    return atoms.unionByName(as_atoms(fresh)).unionByName(as_atoms(code))


def atom_line(with_id: bool = False) -> Column:
    """An atom as one line of Markdown, by its kind."""
    text = (
        F.when(F.col("kind") == "def", F.concat(F.lit("**"), F.col("term"), F.lit("**: "), F.col("definition")))
        .when(F.col("kind") == "ex", F.concat(F.lit("**"), F.col("name"), F.lit("**: "), F.col("description")))
        .when(F.col("kind") == "fc", F.concat(F.coalesce("caption", F.initcap("fc_kind")), F.lit(": `"), F.col("content"), F.lit("`")))
        .when(F.col("kind") == "dt", F.concat(F.lit("**"), F.col("value"), F.lit("**: "), F.col("description")))
        .otherwise(relation_sentence(F.col("source"), F.col("rel_kind"), F.col("target"), F.col("description")))
    )
    return F.concat(F.lit("- "), F.col("atom_id"), F.lit(" · "), text) if with_id else F.concat(F.lit("- "), text)


def as_markdown(atoms: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, markdown: atoms under a title for each kind, empty kinds left out, cut to `most` characters."""
    titles = F.element_at(F.array(*map(F.lit, ("## Definiciones", "## Ejemplos", "## Fórmulas y código", "## Datos e insights", "## Relaciones"))), kind_rank(F.col("kind")).cast("int"))
    section = F.array_sort(F.collect_list(F.struct("pos", "atom_id", atom_line().alias("line"))))
    parts = atoms.groupBy("doc_id", "kind").agg(F.concat(F.first(titles), F.lit("\n"), F.array_join(F.transform(section, lambda r: r["line"]), "\n")).alias("part"))
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(kind_rank(F.col("kind")).alias("k"), "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    if most:
        text = F.when(F.char_length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)
    return joined.select("doc_id", text.alias("markdown"))


def document_markdown(kb: DataFrame, atoms: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, markdown: the topic (kb: doc_id, main_topic, subtopics, conclusions), subtopics, atoms by kind, conclusions."""
    bulleted = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    parts = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("main_topic")), bulleted("Subtemas", F.col("subtopics")), F.col("markdown"), bulleted("Conclusiones", F.col("conclusions")))
    text = F.concat(parts, F.lit("\n"))
    if most:
        text = F.when(F.char_length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)
    return kb.join(as_markdown(atoms), "doc_id", "left").select("doc_id", text.alias("markdown"))


def needs_split(term: Column, definition: Column) -> Column:
    n = F.char_length(term)
    return (n > 120) | ((n > 60) & (F.char_length(F.coalesce(definition, F.lit(""))) < 10))


# --- fixed values: where a term ends and its definition begins, the first that fits; what is stripped of the term -------
TERM_ENDS = (r"(?U)^(.{2,80}?)\s*:\s*(.+)$", r"(?U)^(.{2,80}?)\s+[-—–]\s+(.+)$", r"(?iU)^(.{2,80}?)\s+(?:es|son|se\s+refiere\s+a)\s+(.+)$")
TERM_SIGNS = " .,:;—–-"


def split_term(term: Column) -> Column:
    """(head, tail) of a term that holds its definition: at a colon, a dash, es/son; else after six words or 120 characters."""
    bare = stripped(term)
    words = F.split(bare, r"(?U)\s+")
    join = lambda a: F.array_join(a, " ")
    after = lambda a, n: F.filter(a, lambda _, i: i >= n)
    out = F.when(F.size(words) > 6, F.struct(F.left(F.rtrim(join(F.slice(words, 1, 6)), F.lit(TERM_SIGNS)), F.lit(120)).alias("head"), join(after(words, 6)).alias("tail"))).otherwise(
        F.struct(F.rtrim(F.left(bare, F.lit(120)), F.lit(TERM_SIGNS)).alias("head"), stripped(F.substring(bare, 121, 1 << 30)).alias("tail"))
    )
    for pattern in reversed(TERM_ENDS):
        head, tail = F.btrim(F.regexp_extract(bare, pattern, 1), F.lit(TERM_SIGNS)), stripped(F.regexp_extract(bare, pattern, 2))
        out = F.when((head != "") & (tail != ""), F.struct(F.left(head, F.lit(120)).alias("head"), tail.alias("tail"))).otherwise(out)
    return out


def within_bounds(kind: str) -> Column:
    """Whether an atom's fields are as long as they may be; what is absent is only missed where it has to be there."""
    ok = (F.char_length(F.coalesce("subtopic", F.lit(""))) <= 120) & (F.size(F.coalesce("attributes", F.array())) <= MAX_LISTED) & (F.size(F.coalesce("methods", F.array())) <= MAX_LISTED)
    for c, (least, most) in ATOM_BOUNDS[kind].items():
        ok = ok & F.char_length(F.coalesce(F.col(c), F.lit(""))).between(least, most)
    return ok


def listed(c: Column, most: int) -> Column:
    """A list from a JSON array or from a text with separators; bare, without empty entries."""
    found = F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.split(c, r"[\n;,]+"))
    return F.slice(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), stripped), lambda x: x != ""), 1, most)


def from_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kb, atoms) from answers (doc_id, payload: a model's text). Fields go by any of their aliases, one wrapper is taken off,
    ids are made where they are missing; an atom without what its kind needs, or with a field out of its bounds, is dropped,
    the rest of its answer stays. kb: doc_id, main_topic (null: none that says something), subtopics, conclusions."""
    probes = (*TOPIC_FIELDS, *ATOM_LISTS["def"], *ATOM_LISTS["ex"])
    read = parsed(answers, ["doc_id"])
    read = written(read.select("doc_id", unwrapped(F.col("v"), ANSWER_WRAPPERS, probes).alias("j")), "read")  # parsed once for all kinds
    j = F.col("j")
    topic = picked(j, TOPIC_FIELDS)
    kb = read.filter("j IS NOT NULL").select(
        "doc_id", F.left(F.when(topic.rlike(PLACEHOLDER_TOPIC), None).otherwise(topic), F.lit(200)).alias("main_topic"),
        listed(picked(j, SUBTOPIC_FIELDS), MAX_SUBTOPICS).alias("subtopics"), listed(picked(j, CONCLUSION_FIELDS), MAX_CONCLUSIONS).alias("conclusions"),
    )
    found = None
    for kind in ATOM_KINDS:
        rows = read.select("doc_id", F.inline(F.coalesce(*(entries(j, n) for n in ATOM_LISTS[kind]))))
        field = lambda names: F.coalesce(*(F.nullif(F.trim(F.try_element_at("m", F.lit(n))), F.lit("")) for n in names))
        rows = rows.select("doc_id", F.lit(kind).alias("kind"), "pos", *(field(n).alias(c) for c, n in ATOM_FIELDS[kind].items()), "m")
        if kind == "ex":
            items = lambda n: F.coalesce(F.from_json(F.try_element_at("m", F.lit(n)), "array<string>"), F.split(F.try_element_at("m", F.lit(n)), r"[\n;,]+"))
            rows = rows.withColumn("attributes", F.coalesce(*map(items, ("attributes", "atributos", "properties")))).withColumn("methods", F.coalesce(*map(items, ("methods", "metodos", "métodos", "operations"))))
            rows = rows.withColumn("description", F.when(F.char_length("description") >= 5, F.col("description")).otherwise(F.concat(F.lit("Ejemplo: "), F.col("name"))))
        if kind == "def":
            parts = F.when(needs_split(F.col("term"), F.col("definition")), split_term(F.col("term")))
            rows = rows.withColumn("lectio_p", parts).withColumn("term", F.coalesce("lectio_p.head", "term")).withColumn("definition", F.nullif(F.concat_ws(" ", F.nullif("lectio_p.tail", F.lit("")), F.col("definition")), F.lit("")))
            rows = rows.withColumn("definition", F.when(F.char_length("definition") >= 5, F.col("definition")).otherwise(F.concat(F.lit("Concepto: "), F.col("term"))))
        if kind == "fc":
            rows = rows.withColumn("fc_kind", F.when(F.lower("fc_kind").isin("formula", "code"), F.lower("fc_kind")).otherwise(code_or_formula_of_answer(F.col("content"))))
        if kind == "dt":
            rows = rows.withColumn("description", F.when(F.char_length("description") >= 3, F.col("description")).otherwise(F.concat(F.lit("Dato: "), F.col("value"))))
        if kind == "rel":
            rows = rows.withColumn("rel_kind", F.coalesce("rel_kind", F.lit("related_to")))
        needed = {"def": ("term",), "ex": ("name",), "fc": ("content",), "dt": ("value",), "rel": ("source", "target")}[kind]
        for c in needed:
            rows = rows.filter(F.col(c).isNotNull())
        given = F.when(F.contains("id", F.lit(":")), typed_id(kind, F.col("id"))).when(F.col("id").isNotNull(), typed_id(kind, F.concat(F.lit(f"{kind}:"), F.col("id"))))
        rows = unique_ids(rows.withColumn("base", F.coalesce(given, typed_id(kind, F.coalesce(*ID_SEEDS[kind])))), "base", ["pos"])
        rows = as_atoms(rows).filter(within_bounds(kind))
        found = rows if found is None else found.unionByName(rows)
    return kb, found
