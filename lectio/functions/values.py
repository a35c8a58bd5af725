"""Word lists, phrases, cycles and limits that results depend on."""

from __future__ import annotations

# --- fixed values: limits -------------------------------------------------------------------------------------------
CHUNK_CHARS, CHUNK_OVERLAP = 3000, 250
MAX_INPUT_CHARS, MAX_PAGES = 90_000, 50
MIN_QUESTIONS, MAX_QUESTIONS = 7, 15
MAX_BULLETS, MAX_BULLET_CHARS, MAX_TITLE_CHARS = 5, 180, 80
MIN_SLIDES, MAX_SLIDES = 6, 14
DUPLICATE_QUESTION, DUPLICATE_STEM = 0.75, 0.70
SIMILAR_BULLET, SIMILAR_SLIDE, SIMILAR_TITLE, SHARED_ATOMS, OUTLINE_MATCH = 0.72, 0.78, 0.72, 0.8, 0.5

# --- fixed values: words that don't count ---------------------------------------------------------------------------
METRIC_STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas",
    "y", "o", "u", "en", "con", "por", "para", "que", "como", "al",
    "se", "es", "son", "su", "sus", "lo", "le", "les", "este", "esta",
    "estos", "estas", "entre", "sobre", "sin", "pero", "mas", "más",
    "cual", "cuál", "cuáles", "cuando", "cuándo", "donde", "dónde",
    "mismo", "misma", "tambien", "también", "tras", "hasta",
)
REVIEW_STOPWORDS = (
    "de", "la", "el", "en", "los", "las", "un", "una", "unos", "unas",
    "por", "para", "con", "sin", "que", "cual", "como", "se", "su", "sus",
    "ser", "son", "del", "al", "lo", "le", "les", "y", "o", "u", "e",
    "no", "si", "pero", "esto", "este", "esta", "estos", "estas", "ese",
    "eso", "esa", "esos", "esas",
)
BULLET_STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "u",
    "en", "con", "por", "para", "que", "como", "se", "es", "son", "al", "lo", "su",
)
TITLE_STOPWORDS = (
    "de", "del", "la", "las", "el", "los", "en", "para", "por", "con", "sin", "una",
    "uno", "unos", "unas", "the", "and", "for", "with", "from", "into",
)
HEADING_TERMS_OUT = ("contexto de imágenes", "indice", "índice")

# --- fixed values: phrases that reviews look for --------------------------------------------------------------------
BANNED_OPTION_PHRASES = (
    "todas las anteriores", "todas las opciones",
    "ninguna de las anteriores", "ninguna de las opciones",
    "a y b", "b y c", "a y c",
    "ninguna es correcta", "solo a", "solo b",
)
QUIZ_META_PHRASES = (
    "segun el texto", "segun el documento", "segun el autor",
    "segun la definicion", "de acuerdo con el documento",
    "de acuerdo con el texto", "conforme al documento",
    "el autor dice", "el texto menciona", "el documento indica",
    "como se menciona en", "basandose en el documento",
    "en este apartado", "en esta pregunta",
)
SLIDE_META_PHRASES = (
    "en este apartado", "en esta diapositiva",
    "se habla de", "se trata de", "se estudia", "se explica",
    "es importante destacar", "a continuacion",
    "el autor explica", "el documento",
    "facilita la comprension de", "ayuda a comprender",
    "permite entender", "permite comprender",
)
BULLET_OPENINGS_OUT = (
    "en esta diapositiva", "en este apartado",
    "en esta presentacion", "en esta presentación",
    "a continuacion", "a continuación",
    "se habla de", "se trata de",
    "es importante destacar",
    "visión panorámica", "vision panoramica",
)
BULLET_FRAGMENTS_OUT = (
    "sirve de ejemplo para ilustrar", "sirve para ilustrar",
    "facilita la creación y gestión", "facilita la creacion y gestion",
    "facilita la comprensión de", "facilita la comprension de",
    "ayuda a comprender", "permite entender", "permite comprender",
    "es clave para entender", "es clave para comprender",
    "ilustra cómo", "ilustra como",
)

# --- fixed values: vocabularies -------------------------------------------------------------------------------------
BLOOM_CYCLE = (
    "recordar", "comprender", "aplicar", "analizar",
    "recordar", "comprender", "evaluar", "aplicar",
    "comprender", "analizar", "recordar", "comprender",
    "aplicar", "analizar", "evaluar",
)
BLOOM_KINDS = {
    "recordar": ("definicion",),
    "comprender": ("definicion", "diferenciacion"),
    "aplicar": ("caso_practico", "completar_codigo"),
    "analizar": ("comparacion", "analisis_consecuencia"),
    "evaluar": ("juicio_alternativas", "analisis_consecuencia"),
    "crear": ("caso_practico",),
}
ATOM_KINDS = ("def", "ex", "fc", "dt", "rel")
QUIZ_ORDER = ("def", "ex", "rel", "fc", "dt")
NATURAL_KIND = {"def": "definicion", "ex": "caso_practico", "rel": "comparacion", "fc": "completar_codigo", "dt": "caso_practico"}
QUESTION_KINDS = ("definicion", "diferenciacion", "caso_practico", "comparacion", "analisis_consecuencia", "juicio_alternativas", "completar_codigo")
BLOOM_ALIASES = {
    "remember": "recordar", "understand": "comprender",
    "apply": "aplicar", "analyze": "analizar", "analyse": "analizar",
    "evaluate": "evaluar", "create": "crear",
    "comprensión": "comprender", "comprension": "comprender",
    "aplicación": "aplicar", "aplicacion": "aplicar",
    "análisis": "analizar", "analisis": "analizar",
    "evaluación": "evaluar", "evaluacion": "evaluar",
    "creación": "crear", "creacion": "crear",
}
QUESTION_KIND_ALIASES = {
    "definition": "definicion", "definición": "definicion",
    "differentiation": "diferenciacion", "difference": "diferenciacion",
    "diferenciación": "diferenciacion",
    "practical_case": "caso_practico", "case_study": "caso_practico",
    "application": "caso_practico",
    "ejemplo": "caso_practico", "example": "caso_practico",
    "comparison": "comparacion", "comparación": "comparacion",
    "relacion": "comparacion", "relación": "comparacion", "relation": "comparacion",
    "analysis": "analisis_consecuencia", "consequence": "analisis_consecuencia",
    "análisis": "analisis_consecuencia", "analisis": "analisis_consecuencia",
    "análisis_consecuencia": "analisis_consecuencia",
    "judgement": "juicio_alternativas", "judgment": "juicio_alternativas",
    "evaluation": "juicio_alternativas", "juicio": "juicio_alternativas",
    "code_completion": "completar_codigo", "fill_in_the_blank": "completar_codigo",
}
SLIDE_KIND_ALIASES = {
    "introduccion": "intro", "introducción": "intro", "introduction": "intro",
    "definicion": "definition", "definición": "definition", "definitions": "definition",
    "ejemplo": "example", "ejemplos": "example", "examples": "example",
    "comparacion": "comparison", "comparación": "comparison", "comparativa": "comparison",
    "codigo": "code", "código": "code",
    "proceso": "process", "flujo": "process",
    "relacion": "relations", "relación": "relations", "relaciones": "relations",
    "panoramica": "outlook", "panorámica": "outlook", "vision": "outlook", "visión": "outlook",
    "conclusion": "conclusion", "conclusión": "conclusion", "conclusiones": "conclusion",
}
SLIDE_KINDS = ("intro", "definition", "example", "comparison", "code", "process", "relations", "outlook", "conclusion")
RELATION_PHRASES = {
    "subclase_de": "es subclase de", "superclase_de": "es superclase de",
    "hereda_de": "hereda de", "implementa": "implementa",
    "compuesto_por": "está compuesto por", "compone": "se compone de",
    "contiene": "contiene", "parte_de": "es parte de",
    "depende_de": "depende de", "usa": "usa",
    "instancia_de": "es instancia de",
    "asociado_con": "está asociado con", "relacionado_con": "está relacionado con",
    "causa": "causa", "precede_a": "precede a", "sigue_a": "sigue a",
    "equivalente_a": "es equivalente a", "opuesto_a": "es opuesto a",
}
QUIZ_CRITERIA = ("semantic_correctness", "relevance", "clarity", "distractor_quality", "difficulty", "pedagogical_value", "hallucination_risk", "overall")
DECK_CRITERIA = ("thematic_coverage", "narrative_coherence", "clarity", "information_density", "no_repetition", "study_utility", "overall")
SCORE_NAMES = ("muy deficiente", "deficiente", "aceptable", "bueno", "excelente")
#: What a judge is asked for each criterion; own words
CRITERION_QUESTIONS = {
    "Cuestionario": {
        "semantic_correctness": "las preguntas y sus respuestas son ciertas según el documento",
        "relevance": "se pregunta por lo que importa del documento",
        "clarity": "enunciados y opciones se entienden a la primera",
        "distractor_quality": "las opciones falsas podrían parecer ciertas a quien no ha estudiado",
        "difficulty": "el nivel es el de una asignatura universitaria (1 trivial, 5 exigente)",
        "pedagogical_value": "responderlo ayuda a aprender la materia",
        "hallucination_risk": "todo lo afirmado está en el documento (1 casi nada, 5 todo)",
        "overall": "impresión de conjunto",
    },
    "Presentación": {
        "thematic_coverage": "están los temas centrales del documento",
        "narrative_coherence": "de la portada a las conclusiones se sigue un hilo",
        "clarity": "las viñetas se entienden y están bien escritas",
        "information_density": "cada diapositiva dice bastante sin llenarse",
        "no_repetition": "ninguna idea vuelve en otra diapositiva (1 muchas, 5 ninguna)",
        "study_utility": "se puede estudiar con ella sola",
        "overall": "impresión de conjunto",
    },
}
AVERAGED = (
    "pdf_has_images", "pdf_has_tables",
    "time_total_s", "time_kb_s", "time_quiz_s", "time_pptx_s",
    "kb_atoms", "kb_subtopics",
    "quiz_num_questions", "quiz_bloom_diversity",
    "quiz_duplicate_pairs", "quiz_pct_explanation",
    "quiz_kb_term_coverage",
    "pptx_num_slides_total", "pptx_num_content_slides", "pptx_avg_bullets",
    "pptx_bullets_total", "pptx_index_coherence",
)

# --- fixed values: aliases of the fields of a model's answer --------------------------------------------------------
ATOM_LISTS = {
    "def": ("definitions", "definiciones", "glossary", "glosario"),
    "ex": ("examples", "ejemplos", "instances", "casos"),
    "fc": ("formulas_code", "formulas", "code", "code_blocks"),
    "dt": ("numeric_data", "data", "datos", "metrics"),
    "rel": ("relations", "relaciones", "relationships"),
}
TOPIC_FIELDS = ("main_topic", "topic", "tema", "title")
SUBTOPIC_FIELDS = ("subtopics", "subtemas", "sections", "secciones")
CONCLUSION_FIELDS = ("conclusions", "conclusiones", "key_points", "takeaways")
ANSWER_WRAPPERS = ("kb", "knowledge_base", "base", "output", "result", "data", "respuesta")
ATOM_FIELDS = {
    "def": {
        "id": ("id", "identifier"),
        "term": ("term", "termino", "término", "name", "nombre", "concept"),
        "definition": ("definition", "definicion", "definición", "description", "descripcion"),
        "subtopic": ("subtopic", "subtema", "section"),
    },
    "ex": {
        "id": ("id", "identifier"),
        "name": ("name", "nombre", "title"),
        "description": ("description", "descripcion", "descripción"),
        "subtopic": ("subtopic", "subtema", "section"),
    },
    "fc": {
        "id": ("id", "identifier"),
        "fc_kind": ("kind", "type", "tipo"),
        "content": ("content", "contenido", "code", "codigo", "formula"),
        "caption": ("caption", "title", "description"),
        "language": ("language", "lang", "idioma"),
        "subtopic": ("subtopic", "subtema", "section"),
    },
    "dt": {
        "id": ("id", "identifier"),
        "value": ("value", "valor", "number"),
        "description": ("description", "descripcion", "descripción"),
        "subtopic": ("subtopic", "subtema", "section"),
    },
    "rel": {
        "id": ("id", "identifier"),
        "rel_kind": ("kind", "type", "tipo", "relation"),
        "source": ("source", "origen", "from", "subject"),
        "target": ("target", "destino", "to", "object"),
        "description": ("description", "descripcion", "descripción"),
        "subtopic": ("subtopic", "subtema", "section"),
    },
}
ID_SEEDS = {"def": ("term",), "ex": ("name",), "fc": ("caption", "content"), "dt": ("value", "description"), "rel": ("source", "rel_kind")}

# --- fixed values: aliases and wrappers of a model's plans -------------------------------------------------------------
SLIDE_WRAPPERS = ("plan", "output", "result", "data", "respuesta")
SLIDE_LISTS = ("slides", "diapositivas", "plan", "content", "contenido")
SLIDE_TITLES = ("presentation_title", "title", "titulo", "título", "tema", "topic")
SLIDE_FIELDS = {
    "title": ("title", "titulo", "título", "heading", "nombre"),
    "kind": ("kind", "type", "tipo", "layout"),
    "atoms": ("atom_ids", "atomos", "átomos", "ids", "atoms", "refs", "references"),
    "focus": ("focus", "enfoque", "intention", "intencion", "idea"),
}
QUIZ_WRAPPERS = ("quiz_plan", "quiz", "plan", "output", "result", "data")
QUIZ_LISTS = ("questions", "preguntas", "items", "plan", "quiz")
QUIZ_FIELDS = {
    "bloom": ("bloom_level", "bloom", "nivel", "level", "nivel_bloom"),
    "concept": ("concept_id", "atom_id", "concepto", "atom", "concept", "ref"),
    "kind": ("kind", "type", "tipo", "question_type"),
}
BLOOM_FALLBACK_CYCLE = (
    "recordar", "comprender", "aplicar", "analizar",
    "comprender", "aplicar", "evaluar", "recordar",
    "comprender", "analizar", "aplicar", "comprender",
)

# --- fixed values: how long the fields of an atom are (least, most) ----------------------------------------------------
ATOM_BOUNDS = {
    "def": {"term": (1, 120), "definition": (5, 600)},
    "ex": {"name": (1, 120), "description": (5, 600)},
    "fc": {"content": (1, 2000), "caption": (0, 200), "language": (0, 30)},
    "dt": {"value": (1, 80), "description": (3, 300)},
    "rel": {"rel_kind": (1, 60), "source": (1, 120), "target": (1, 120), "description": (0, 300)},
}
MAX_LISTED, MAX_SUBTOPICS, MAX_CONCLUSIONS = 20, 30, 10
