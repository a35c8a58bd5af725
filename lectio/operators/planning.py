"""Plans of quizzes and decks, without a model: closed forms where the order of acceptance allows, a pass by document where not."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.answers import entries, parsed, picked, unwrapped
from lectio.functions.deploy import deployed
from lectio.functions.tables import written
from lectio.functions.text import folded, humanized, mapped, normalized_slug
from lectio.functions.values import (
    BLOOM_ALIASES, BLOOM_CYCLE, BLOOM_FALLBACK_CYCLE, BLOOM_KINDS, MAX_QUESTIONS, MAX_SLIDES, MIN_QUESTIONS, NATURAL_KIND, QUESTION_KIND_ALIASES, QUESTION_KINDS,
    QUIZ_FIELDS, QUIZ_LISTS, QUIZ_ORDER, QUIZ_WRAPPERS, SHARED_ATOMS, SIMILAR_TITLE, SLIDE_FIELDS, SLIDE_KIND_ALIASES, SLIDE_KINDS, SLIDE_LISTS,
    SLIDE_TITLES, SLIDE_WRAPPERS, TITLE_STOPWORDS,
)
from lectio.operators.knowledge import first_by_id, kind_rank


def array_of(values) -> Column:
    return F.array(*map(F.lit, values))


def adaptive_target(n: Column, low: int = MIN_QUESTIONS, high: int = MAX_QUESTIONS) -> Column:
    """How many questions for n atoms."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(F.greatest(n, F.lit(1)) * 12 / 10))).cast("int")


def cap_per_concept(n: Column, target: Column) -> Column:
    return F.when(n <= 0, 2).otherwise(F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(target / n)))).cast("int")


def bloom(c: Column) -> Column:
    return mapped(F.lower(F.trim(c)), BLOOM_ALIASES)


def recommended(level: Column) -> Column:
    """The kinds of question for a Bloom level, the first one the default."""
    out = F.when(F.lit(False), array_of(["definicion"]))
    for k, v in BLOOM_KINDS.items():
        out = out.when(level == k, array_of(v))
    return out.otherwise(array_of(["definicion"]))


def question_kind(c: Column, level: Column) -> Column:
    k = mapped(F.translate(F.lower(F.trim(c)), " -", "__"), QUESTION_KIND_ALIASES)
    return F.when(k.isin(*QUESTION_KINDS), k).otherwise(recommended(level)[0])


def slide_kind(c: Column) -> Column:
    """A kind of slide, by its synonyms; null where there is none."""
    k = mapped(F.lower(F.trim(c)), SLIDE_KIND_ALIASES)
    return F.when(k.isin(*SLIDE_KINDS), k)


#: The concept of the question that a document without atoms has
MAIN_TOPIC = "main_topic"


def topic_plan(kb: DataFrame, atoms: DataFrame) -> DataFrame:
    """A plan as quiz_plan() gives it for the documents of kb that have no atoms: one question, on the topic itself."""
    bare = kb.select("doc_id").join(atoms.select("doc_id").distinct(), "doc_id", "left_anti")
    return bare.select("doc_id", F.lit(1).alias("question_id"), F.lit("recordar").alias("bloom"), F.lit(MAIN_TOPIC).alias("concept_id"), F.lit("definicion").alias("kind"))


def quiz_plan(atoms: DataFrame, target: Column | None = None) -> DataFrame:
    """doc_id, question_id, bloom, concept_id, kind: atoms in turn, three times round at most, along a cycle of levels. The
    k-th question is of the atom k mod n. topic_plan() has the documents without atoms."""
    once = first_by_id(atoms)
    numbered = once.select("doc_id", "atom_id", "kind", (F.row_number().over(W.partitionBy("doc_id").orderBy(kind_rank(F.col("kind"), QUIZ_ORDER), "pos")) - 1).alias("at"))
    n = F.count("*").over(W.partitionBy("doc_id"))
    numbered = numbered.withColumn("n", n)
    total = F.least(target if target is not None else adaptive_target(F.col("n")), F.col("n") * 3)
    rows = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("k", F.col("k") * F.col("n") + F.col("at")).filter(F.col("k") < total)
    level = array_of(BLOOM_CYCLE)[F.col("k").cast("int") % len(BLOOM_CYCLE)]
    natural = mapped(F.col("kind"), NATURAL_KIND)
    rows = rows.withColumn("bloom", level).withColumn("natural", natural)
    kind = F.when(F.array_contains(recommended(F.col("bloom")), F.col("natural")), F.col("natural")).otherwise(recommended(F.col("bloom"))[0])
    return rows.select("doc_id", (F.col("k") + 1).cast("int").alias("question_id"), "bloom", F.col("atom_id").alias("concept_id"), kind.alias("kind"))


def resolved(asked: DataFrame, atoms: DataFrame, column: str) -> DataFrame:
    """asked (doc_id, and an id as a model writes it in `column`) with atom_id: the same id, else the same once normalised
    within its kind, else the one whose slug goes on after the asked one and _. The smallest wins; null: none.

    Each step is a join on equal keys of what the step before left: ids; kinds and slugs; kinds and the beginnings of slugs, each
    slug under all that end before one of its underscores."""
    split = lambda c: (F.lower(F.substring_index(c, ":", 1)), normalized_slug(F.regexp_replace(c, r"^[^:]*:", "")))
    prefix, slug = split(F.col("atom_id"))
    valid = written(atoms.select("doc_id", "atom_id", prefix.alias("prefix"), slug.alias("slug")).distinct(), "valid")
    prefix, slug = split(F.col("asked"))
    wanted = asked.select("doc_id", F.col(column).alias("asked")).filter("asked IS NOT NULL").distinct().select("doc_id", "asked", prefix.alias("prefix"), slug.alias("slug"))
    same = wanted.join(valid.select("doc_id", F.col("atom_id").alias("asked"), "atom_id"), ["doc_id", "asked"]).select("doc_id", "asked", "atom_id")
    left = wanted.join(same, ["doc_id", "asked"], "left_anti")
    smallest = lambda met: met.groupBy("doc_id", "asked").agg(F.min("atom_id").alias("atom_id"))
    normal = smallest(left.join(valid, ["doc_id", "prefix", "slug"]))
    left = left.join(normal, ["doc_id", "asked"], "left_anti").filter("slug <> ''")
    parts = F.split("slug", "_", -1)
    begun = valid.filter(F.contains("slug", F.lit("_"))).select("doc_id", "atom_id", "prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))).alias("slug"))
    longer = smallest(left.join(begun.groupBy("doc_id", "prefix", "slug").agg(F.min("atom_id").alias("atom_id")), ["doc_id", "prefix", "slug"]))
    best = same.unionByName(normal).unionByName(longer).withColumnRenamed("asked", column)
    return asked.join(best, ["doc_id", column], "left")


def sanitized_quiz_plan(plan: DataFrame, atoms: DataFrame, target: int = MAX_QUESTIONS) -> DataFrame:
    """A plan (doc_id, question_id, bloom, concept_id, kind) with known concepts, none asked the same way twice nor more often than
    the cap, cut to target and numbered anew."""
    known = resolved(plan, atoms, "concept_id").filter("atom_id IS NOT NULL")
    n = atoms.groupBy("doc_id").agg(F.countDistinct("atom_id").alias("n_atoms"))
    once = known.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "atom_id", "bloom", "kind").orderBy("question_id"))).filter("r = 1").join(n, "doc_id")
    capped = once.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "atom_id").orderBy("question_id"))).filter(F.col("r") <= cap_per_concept(F.col("n_atoms"), F.lit(target)))
    numbered = capped.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("question_id"))).filter(F.col("r") <= target)
    return numbered.select("doc_id", F.col("r").alias("question_id"), "bloom", F.col("atom_id").alias("concept_id"), "kind")


# --- fixed values: slides of a deck without subtopics ------------------------------------------------------------------
BUCKETS = {
    "def": ("Definiciones clave", "definition", 8),
    "ex": ("Ejemplos ilustrativos", "example", 6),
    "fc": ("Fórmulas y código", "code", 6),
    "rel": ("Relaciones entre conceptos", "relations", 8),
    "dt": ("Datos numéricos", "outlook", 6),
}
SLIDE_OF = {"def": "definition", "ex": "example", "fc": "code", "rel": "relations", "dt": "outlook"}
INTRO, EXTRA = "Introducción", "Aspectos complementarios"
RESCUE_ORDER = ("def", "ex", "fc", "rel", "dt")
MOST_PLANNED, LEAST_PLANNED = 20, 3


def slide_plan(kb: DataFrame, atoms: DataFrame, subtopics: DataFrame | None = None) -> DataFrame:
    """doc_id, slide_index, title, kind, atom_ids: an introduction; then a slide for each subtopic of atoms, of the kind that most
    of its atoms have (the first seen on a tie), or without subtopics one for each kind of atom; at least 3, at most 20."""
    named = atoms.withColumn("group", F.trim(F.coalesce("subtopic", F.lit("")))).withColumn("k", kind_rank(F.col("kind")))
    has = named.groupBy("doc_id").agg(F.max(F.col("group") != "").alias("has"))
    named = named.join(has, "doc_id").withColumn("seen", F.row_number().over(W.partitionBy("doc_id").orderBy("k", "pos")))
    sub = named.filter("has AND group <> ''")
    kinds = sub.groupBy("doc_id", "group", "kind").agg(F.count("*").alias("c"), F.min("seen").alias("first"))
    dominant = kinds.groupBy("doc_id", "group").agg(F.max_by("kind", F.struct("c", -F.col("first"))).alias("kind"), F.min("first").alias("first"))
    ids = sub.groupBy("doc_id", "group").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seen", "atom_id"))), lambda a: a["atom_id"]), 1, 10).alias("atom_ids"))
    rank = subtopics.select("doc_id", F.col("subtopic").alias("group"), F.col("n").alias("rank")) if subtopics is not None else sub.select("doc_id", "group").distinct().withColumn("rank", F.lit(None).cast("int"))
    by_topic = dominant.join(ids, ["doc_id", "group"]).join(rank, ["doc_id", "group"], "left")
    by_topic = by_topic.select("doc_id", F.coalesce("rank", F.lit(10_000)).alias("o1"), F.col("first").alias("o2"), humanized(F.col("group")).alias("title"), mapped(F.col("kind"), SLIDE_OF).alias("kind"), "atom_ids")
    plain = named.filter("NOT has").groupBy("doc_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom_id"))), lambda a: a["atom_id"]).alias("ids"))
    title = mapped(F.col("kind"), {k: v[0] for k, v in BUCKETS.items()})
    most = F.lit(8)
    for k, v in BUCKETS.items():
        most = F.when(F.col("kind") == k, v[2]).otherwise(most)
    by_kind = plain.select("doc_id", kind_rank(F.col("kind"), tuple(BUCKETS)).cast("int").alias("o1"), F.lit(0).alias("o2"), humanized(title).alias("title"), mapped(F.col("kind"), {k: v[1] for k, v in BUCKETS.items()}).alias("kind"), F.slice(F.col("ids"), F.lit(1), most).alias("atom_ids"))
    none = F.lit(None).cast("array<string>")
    intro = kb.select("doc_id", F.lit(-1).alias("o1"), F.lit(0).alias("o2"), F.lit(INTRO).alias("title"), F.lit("intro").alias("kind"), F.coalesce(none, F.array().cast("array<string>")).alias("atom_ids"))
    body = by_topic.unionByName(by_kind)
    count = body.groupBy("doc_id").agg(F.count("*").alias("c"))
    missing = kb.select("doc_id").join(count, "doc_id", "left").select("doc_id", F.greatest(F.lit(0), 2 - F.coalesce("c", F.lit(0))).alias("m")).filter("m > 0")
    extra = missing.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("o2")).select("doc_id", F.lit(20_000).alias("o1"), "o2", humanized(F.lit(EXTRA)).alias("title"), F.lit("outlook").alias("kind"), F.array().cast("array<string>").alias("atom_ids"))
    rows = intro.unionByName(body).unionByName(extra).withColumn("slide_index", F.row_number().over(W.partitionBy("doc_id").orderBy("o1", "o2", "title")))
    again = F.row_number().over(W.partitionBy("doc_id", folded(F.col("title"))).orderBy("slide_index"))
    shown = F.when(again == 1, F.col("title")).otherwise(F.concat(F.left("title", F.lit(74)), F.lit(" ("), again.cast("string"), F.lit(")")))
    return rows.withColumn("title", shown).filter("slide_index <= 20").select("doc_id", "slide_index", "title", "kind", "atom_ids")


def sanitized_slide_plan(plan: DataFrame, atoms: DataFrame) -> DataFrame:
    """A plan (doc_id, slide_index, title, kind, atom_ids) without conclusions, second introductions (both by kind or title) and
    repeated slides, with known atoms, or up to three unused ones, of the slide's kind first, where none is known and the slide
    is no introduction or outlook. A plan of which fewer than three slides are left stays
    as it was. Slides are taken in turn, so each document's are seen together; there are some twenty."""
    deployed(plan.sparkSession)
    asked = plan.select("doc_id", "slide_index", F.posexplode("atom_ids").alias("at", "asked"))
    found = resolved(asked, atoms, "asked").filter("atom_id IS NOT NULL")
    ids = found.groupBy("doc_id", "slide_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "atom_id"))), lambda a: a["atom_id"]).alias("found"))
    pool = atoms.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(kind_rank(F.col("kind"), RESCUE_ORDER).alias("k"), "pos", "kind", "atom_id"))), lambda a: F.concat(a["kind"], F.lit("|"), a["atom_id"])).alias("pool"))
    signature = F.array_except(F.array_distinct(F.regexp_extract_all(F.replace(normalized_slug(F.col("title")), F.lit("_"), F.lit(" ")), F.lit(r"[a-z0-9\+]{3,}"), F.lit(0))), array_of(TITLE_STOPWORDS))
    rows = plan.join(ids, ["doc_id", "slide_index"], "left").join(pool, "doc_id", "left").select(
        "doc_id", "slide_index", humanized(F.col("title")).alias("title"), F.col("title").alias("given"), "kind", F.coalesce(F.array_distinct("found"), F.array().cast("array<string>")).alias("atom_ids"),
        F.coalesce("pool", F.array().cast("array<string>")).alias("pool"), folded(F.col("title")).alias("folded"), signature.alias("signature"), F.col("atom_ids").alias("asked_ids"),
    )
    kind = plan.schema["doc_id"].dataType.simpleString()

    def one(slides: pd.DataFrame) -> pd.DataFrame:
        slides = slides.sort_values("slide_index")
        kept = list(accepted(slides.to_dict("records")))
        if len(kept) < 3:
            kept = [{**s, "title": s["given"], "atom_ids": s["asked_ids"]} for s in slides.to_dict("records")]
        return pd.DataFrame([{"doc_id": s["doc_id"], "slide_index": k, "title": s["title"], "kind": s["kind"], "atom_ids": list(s["atom_ids"])} for k, s in enumerate(kept, 1)])

    return rows.groupBy("doc_id").applyInPandas(one, f"doc_id {kind}, slide_index int, title string, kind string, atom_ids array<string>")


def accepted(slides: list[dict]) -> Iterator[dict]:
    """Slides that nothing before them repeats."""
    kept: list[dict] = []
    used: set[str] = set()
    kind_of = {v: k for k, v in SLIDE_OF.items()}
    has_intro = False
    for s in slides:
        opens = s["kind"] == "intro" or s["folded"].strip().startswith("introduc")
        if s["kind"] == "conclusion" or s["folded"].strip().startswith("conclus") or (opens and has_intro):
            continue
        ids = list(s["atom_ids"])
        if not ids and s["kind"] not in ("intro", "outlook"):
            free = [p.split("|", 1) for p in s["pool"] if p.split("|", 1)[1] not in used]
            first = [i for k, i in free if k == kind_of.get(s["kind"])]
            ids = (first + [i for _, i in free if i not in first])[:3]
        s = {**s, "atom_ids": ids}
        if any(repeated(s, k) for k in kept):
            continue
        used.update(ids)
        has_intro |= opens
        kept.append(s)
        yield s


def repeated(s: dict, k: dict) -> bool:
    a, b = set(s["signature"]), set(k["signature"])
    if s["folded"] == k["folded"] or (a and b and len(a & b) / len(a | b) >= SIMILAR_TITLE):
        return True
    x, y = set(s["atom_ids"]), set(k["atom_ids"])
    return bool(s["kind"] == k["kind"] and x and y and len(x & y) / min(len(x), len(y)) >= SHARED_ATOMS)


def intro_first(plan: DataFrame, most: int = MAX_SLIDES) -> DataFrame:
    """The first introduction (by kind or title) at the front, one put there where there is none; numbered anew and cut to `most`."""
    bare = F.trim(F.regexp_replace(folded(F.col("title")), r"(?U)[^\w\s]+", " "))
    opens = (F.col("kind") == "intro") | (bare == "introduccion") | F.startswith(bare, F.lit("introduccion "))
    first = plan.withColumn("lectio_o", opens).withColumn("lectio_first", F.min(F.when(F.col("lectio_o"), F.col("slide_index"))).over(W.partitionBy("doc_id")))
    none = first.filter("lectio_first IS NULL").select("doc_id").distinct()
    added = none.select("doc_id", F.lit(0).alias("slide_index"), F.lit(INTRO).alias("title"), F.lit("intro").alias("kind"), F.array().cast("array<string>").alias("atom_ids"), F.lit(0).alias("lectio_r"))
    given = first.withColumn("lectio_r", F.when(F.col("slide_index") == F.col("lectio_first"), 0).otherwise(1)).select("doc_id", "slide_index", "title", "kind", "atom_ids", "lectio_r")
    rows = given.unionByName(added)
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("lectio_r", "slide_index"))
    return rows.withColumn("slide_index", n).filter(F.col("slide_index") <= most).drop("lectio_r")


def listed_rows(answers: DataFrame, wrappers, lists, bare_list: bool) -> DataFrame:
    """doc_id, pos, m (map of text): the entries of the list that a model's plan (doc_id, payload) holds."""
    read = parsed(answers, ["doc_id"], "lectio_b")
    body, inner = F.col("lectio_b"), F.col("lectio_i")
    read = read.select("doc_id", "lectio_b", F.explode(F.array(unwrapped(body, wrappers, lists))).alias("lectio_i"))
    found = [entries(inner, n) for n in lists]
    if bare_list:  # a list may stand alone, or right in a wrapper
        found = [entries(body), *found, *(entries(body, w) for w in wrappers)]
    return read.select("doc_id", F.inline(F.coalesce(*found)))


def titles_from_answers(answers: DataFrame, kb: DataFrame) -> DataFrame:
    """doc_id, title: what a model calls the deck (its plan is payload), 160 characters at most; the document's topic where it says
    nothing."""
    read = parsed(answers, ["doc_id"], "lectio_b")
    read = read.select("doc_id", F.explode(F.array(unwrapped(F.col("lectio_b"), SLIDE_WRAPPERS, SLIDE_TITLES + SLIDE_LISTS))).alias("lectio_i"))
    title = F.left(picked(F.col("lectio_i"), SLIDE_TITLES), F.lit(160))
    return kb.select("doc_id", "main_topic").join(read.select("doc_id", title.alias("lectio_t")), "doc_id", "left").select("doc_id", F.coalesce("lectio_t", "main_topic", F.lit("Presentación")).alias("title"))


def entry(names) -> Column:
    """The first of an entry's fields that says something."""
    return F.coalesce(*(F.nullif(F.nullif(F.trim(F.try_element_at("m", F.lit(n))), F.lit("")), F.lit("[]")) for n in names))


def quiz_plan_from_answers(answers: DataFrame) -> DataFrame:
    """A plan as quiz_plan() gives it from a model's answer (doc_id, payload): levels and kinds by their aliases, from a cycle and
    from the level where they are missing; entries without a concept go."""
    rows = listed_rows(answers, QUIZ_WRAPPERS, QUIZ_LISTS, True)
    level = bloom(entry(QUIZ_FIELDS["bloom"]))
    cycle = array_of(BLOOM_FALLBACK_CYCLE)[F.col("pos") % len(BLOOM_FALLBACK_CYCLE)]
    rows = rows.withColumn("bloom", F.when(level.isin(*BLOOM_KINDS), level).otherwise(cycle)).withColumn("concept_id", entry(QUIZ_FIELDS["concept"]))
    rows = rows.filter(F.char_length("concept_id").between(3, 80))
    kind = F.coalesce(question_kind(entry(QUIZ_FIELDS["kind"]), F.col("bloom")), recommended(F.col("bloom"))[0])
    return rows.select("doc_id", (F.col("pos") + 1).alias("question_id"), "bloom", "concept_id", kind.alias("kind"))


def slide_plan_from_answers(answers: DataFrame) -> DataFrame:
    """A plan as slide_plan() gives it from a model's answer (doc_id, payload), with focus, what a slide is about in the model's words:
    kinds by their synonyms, else outlook; ids as a list or a text with separators, twelve at most. A plan of less than three or more than twenty slides is none."""
    rows = listed_rows(answers, SLIDE_WRAPPERS, SLIDE_LISTS, False)
    ids = entry(SLIDE_FIELDS["atoms"])
    given = F.when(F.startswith(ids, F.lit("[")), F.from_json(ids, "array<string>")).otherwise(F.split(ids, "[,;]"))
    bare = F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("title", F.trim(F.left(entry(SLIDE_FIELDS["title"]), F.lit(80)))).filter("char_length(title) >= 2")
    rows = rows.withColumn("lectio_n", F.count("*").over(W.partitionBy("doc_id"))).filter(F.col("lectio_n").between(LEAST_PLANNED, MOST_PLANNED))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", index.alias("slide_index"), "title", F.coalesce(slide_kind(entry(SLIDE_FIELDS["kind"])), F.lit("outlook")).alias("kind"), F.array_distinct(F.slice(bare, 1, 12)).alias("atom_ids"), F.left(entry(SLIDE_FIELDS["focus"]), F.lit(200)).alias("focus"))


def id_lists(atoms: DataFrame, most: int = 80) -> DataFrame:
    """doc_id, prefix, ids: the first `most` ids of a document, listed by prefix, for prompts."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(kind_rank(F.col("kind")), "pos"))
    rows = first_by_id(atoms).withColumn("n", n).filter(F.col("n") <= most)
    return rows.groupBy("doc_id", F.substring_index("atom_id", ":", 1).alias("prefix")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "atom_id"))), lambda a: a["atom_id"]), ", ").alias("ids"))
