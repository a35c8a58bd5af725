"""Prompts as columns, and models as text functions.

A text function is anything that maps a column of prompts to a column of answers (an Arrow UDF that calls a server, with its
own retries). Without one the deterministic forms of the operators are used.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions.deploy import ship
from lectio.functions.values import DECK_CRITERIA, QUIZ_CRITERIA
from lectio.operators.ledger import within


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def map_prompts(chunks: DataFrame) -> DataFrame:
    """chunks with `prompt`: a request for a summary that knows its place among the document's chunks."""
    total = F.count("*").over(W.partitionBy("doc_id"))
    text = "Resume el fragmento {i} de {n} en español, con definiciones y datos literales.\n\n{text}"
    return chunks.withColumn("lectio_n", total).withColumn("prompt", filled(text, i=F.col("chunk_index") + 1, n=F.col("lectio_n"), text=F.col("text"))).drop("lectio_n")


def knowledge_prompt(partials: Column, hints: Column) -> Column:
    """A request for a document's atoms from the summaries of its chunks and its literal hints."""
    text = (
        "Reúne en un objeto JSON lo que dicen estos resúmenes: main_topic, definitions (term, definition), examples (name, description, "
        "attributes, methods), formulas_code (content, kind), data (value, description), relations (source, target, kind).\n\n{hints}\n\n{partials}"
    )
    return filled(text, hints=hints, partials=partials)


def question_prompt(atom: Column, level: Column, kind: Column, related: Column | None = None, before: Column | None = None) -> Column:
    """A request for one question on an atom; related atoms and earlier questions are there to be told apart from it."""
    text = (
        "Escribe una pregunta de opción múltiple de nivel {level} y tipo {kind} sobre este concepto y responde en JSON con "
        "bloom_level, question, options (A, B, C, D), correct_answer y justification.\n\n{atom}\n\nConceptos cercanos:\n{related}\n\nYa preguntado, no lo repitas:\n{before}"
    )
    none = F.lit("-")
    return filled(text, level=level, kind=kind, atom=atom, related=F.coalesce(related if related is not None else none, none), before=F.coalesce(F.nullif(before if before is not None else none, F.lit("")), none))


def quiz_plan_prompt(markdown: Column, valid: Column, target: Column) -> Column:
    """A request for a quiz plan from a knowledge base and the ids that it may use."""
    text = "Planifica {n} preguntas sobre este material y responde en JSON con questions (bloom_level, concept_id, kind). Usa solo estos identificadores:\n{valid}\n\n{markdown}"
    return filled(text, n=target, valid=valid, markdown=markdown)


def slide_plan_prompt(markdown: Column, valid: Column, target: Column) -> Column:
    """A request for a slide plan, likewise."""
    text = "Planifica entre 6 y 14 diapositivas sobre este material y responde en JSON con presentation_title y slides (title, kind, atom_ids). Usa solo estos identificadores:\n{valid}\n\n{markdown}"
    return filled(text, valid=valid, markdown=markdown)


def bullets_prompt(title: Column, lines: Column, before: Column | None = None, again: bool = False) -> Column:
    """A request for a slide's bullets from its atoms, with what the slides before say; again: with a word on what was missing."""
    text = "Redacta de 3 a 5 viñetas completas para la diapositiva «{title}» y responde en JSON con bullets.\n\n{lines}\n\nYa dicho, no lo repitas:\n{before}"
    text += "\n\nLa respuesta anterior no bastó: hacen falta al menos tres frases completas y nuevas." if again else ""
    none = F.lit("-")
    return filled(text, title=title, lines=lines, before=F.coalesce(F.nullif(before if before is not None else none, F.lit("")), none))


def conclusion_prompt(topic: Column, markdown: Column) -> Column:
    """A request for a deck's conclusions from the whole knowledge base."""
    return filled("Redacta de 3 a 5 conclusiones sobre «{topic}» y responde en JSON con bullets.\n\n{markdown}", topic=topic, markdown=markdown)


def skeleton(criteria: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*(F.struct(F.lit(0).alias("score"), F.lit("").alias("comment")).alias(c) for c in criteria)))


def judge_prompt(artifact: str, source: Column, content: Column) -> Column:
    """A request to score an artifact (quiz or pptx) by its criteria from 1 to 5."""
    criteria = QUIZ_CRITERIA if artifact == "quiz" else DECK_CRITERIA
    text = "Evalúa de 1 a 5 cada criterio ({criteria}) sobre {source} y responde en JSON:\n{skeleton}\n\n{content}"
    return filled(text, criteria=F.lit(", ".join(criteria)), source=source, skeleton=skeleton(criteria), content=content)


class TextFunction:
    """A column of prompts to a column of answers. cooler: the same at a lower temperature, for second tries; None: there is none."""

    def __init__(self, column: Callable[[Column], Column], cooler: TextFunction | None):
        self.column, self.cooler = column, cooler

    def __call__(self, c: Column) -> Column:
        return self.column(c)


def text_function(
    call: Callable[[str], str], attempts: int = 3, wait: float = 1.0, workers: int = 8, errors: tuple[type[Exception], ...] = (OSError, ValueError),
    timeout: float | None = None, cooler: Callable[[str], str] | None = None,
) -> TextFunction:
    """A text function from a Python function: so many requests at once, each tried again with growing waits after one of the
    errors or when it takes longer than `timeout` seconds; null where it fails to the end. Other errors are bugs and end the task.
    cooler: the function for second tries of answers that can't be read."""
    ship()

    def one(prompt: str | None) -> str | None:
        for k in range(attempts if prompt is not None else 0):
            try:
                return within(timeout, lambda: call(prompt))
            except errors:
                time.sleep(min(8.0, wait * 2**k) if k + 1 < attempts else 0)
        return None

    @F.arrow_udf("string")
    def lectio_text(prompts: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(workers) as pool:
            return pa.array(list(pool.map(one, prompts.to_pylist())), pa.string())

    again = text_function(cooler, attempts, wait, workers, errors, timeout) if cooler is not None else None
    return TextFunction(lectio_text, again)
