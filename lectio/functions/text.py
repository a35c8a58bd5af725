"""Text functions as Column expressions: everything here stays on the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters with marks, of all alphabets that Unicode has composed ones of up to U+1FFF, and what is left of them where that is
    one letter; then the marks that stand alone, which translate() drops, having no counterpart."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0xC0, 0x2000)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
SPACE = r"(?U)\s+"
#: The white space of all alphabets but the space itself; as a class of its own it costs a fraction of the property
OTHER_SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Of a run, its first space decides where a match starts; ranges cost a fraction of single characters
RUNS = r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*| [ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
TOKEN3 = "[a-z0-9áéíóúüñ]{3,}"
TOKEN4 = "[a-záéíóúñü0-9]{4,}"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it; keeps nested expressions small."""
    return F.element_at(F.transform(F.array(c), f), 1)


def unaccented(c: Column) -> Column:
    """Without accents; texts of ASCII alone, which have none, are not gone through letter by letter."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))


def folded(c: Column) -> Column:
    """Lower case, without accents."""
    return F.lower(unaccented(c))


def stripped(c: Column) -> Column:
    """Without white space (of any alphabet) at both ends."""
    return F.btrim(c, F.lit(" " + OTHER_SPACES))


def one_space(c: Column) -> Column:
    """Runs of white space as one space each, none at the ends. Single spaces, nearly all there are, aren't touched."""
    return F.trim(F.regexp_replace(c, RUNS, " "))


def one_space_of(c: Column) -> Column:
    """one_space() of a plain column, which is looked at several times: a text of ASCII that holds no run gets no regex."""
    ascii = F.octet_length(c) == F.char_length(c)
    return F.trim(F.when(ascii & ~contains_any(c, ("  ", *"\t\n\x0b\x0c\r")), c).otherwise(F.regexp_replace(c, RUNS, " ")))


def without_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def tokens(c: Column, pattern: str, stop: Iterable[str]) -> Column:
    """The different tokens of a folded text, in the order of their first place."""
    found = F.array_distinct(F.regexp_extract_all(folded(c), F.lit(pattern), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / union)


def clean_term(c: Column) -> Column:
    """One line, no separators at the ends, no leading article."""
    bare = without_chars(F.regexp_replace(c, SPACE, " "), " .,:;-—")
    return F.regexp_replace(bare, r"(?iU)^(?:el|la|los|las|un|una|unos|unas)\s+", "")


def clean_definition(c: Column) -> Column:
    """One line that ends in a full stop."""
    shut = lambda d: F.when(F.endswith(d, F.lit(".")), d).otherwise(F.concat(F.rtrim(F.regexp_replace(d, "[:;]$", "")), F.lit(".")))
    return let(one_space(c), shut)


def slug(c: Column) -> Column:
    """What follows the first colon, folded, other characters as _, cut to 40 once the ends are bare."""
    tail = F.when(F.contains(c, F.lit(":")), F.regexp_replace(c, r"(?s)^[^:]*:", "")).otherwise(c)
    s = without_chars(F.regexp_replace(folded(tail), r"[^a-z0-9_\-]+", "_"), "_-")
    return F.left(F.when(s == "", F.lit("item")).otherwise(s), F.lit(40))


def typed_id(prefix: Column | str, c: Column) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit(":"), slug(c))


def normalized_slug(c: Column) -> Column:
    return without_chars(F.regexp_replace(folded(c), r"[^a-z0-9_\-]+", "_"), "_-")


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-záéíóúñ])(?=[A-ZÁÉÍÓÚÑ])", "$1 ")


def entity(c: Column) -> Column:
    """Folded words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(folded(c), "[^a-z0-9]{2,}|[^a-z0-9 ]", " "))


def entity_in(e: Column, spaced: Column) -> Column:
    """Whether an entity is in a text that entity() gave: a phrase between its words, a single word (or what is written
    as one) anywhere, across spaces too."""
    phrase = entity(split_camel(e))
    compact = F.replace(phrase, F.lit(" "), F.lit(""))
    there = F.contains(F.replace(spaced, F.lit(" "), F.lit("")), compact)
    return F.when(F.coalesce(phrase, F.lit("")) == "", F.lit(False)).otherwise(F.contains(spaced, phrase) | there)


def truncated(c: Column, most: int) -> Column:
    """One line of at most so many characters, the last one an ellipsis where it was cut."""
    return let(one_space(c), lambda t: F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…"))))


def humanized(c: Column) -> Column:
    """A title from an identifier: spaces for _ and -, each word capitalised, short acronyms kept."""
    words = F.split(F.trim(F.regexp_replace(c, r"(?U)[_\-\s]+", " ")), " ", -1)
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20)))
    word = lambda w: (
        F.when(F.lower(w).isin("poo", "oop", "c++"), F.upper(w))
        .when(F.lower(w) == "java", F.lit("Java"))
        .when((w == F.upper(w)) & (w != F.lower(w)) & (F.char_length(w) <= 5), w)
        .otherwise(capital(w))
    )
    return F.array_join(F.transform(words, word), " ")


def clean_option(c: Column) -> Column:
    """An option without marks of its correctness and without trailing remarks in brackets, closed by a full stop."""
    tag = r"(?iU)\s*[\(\[]\s*(?:error|incorrecto|distractor|falso|correcto|respuesta correcta|respuesta incorrecta|answer|correct|wrong)\s*[\)\]]\s*\.?"
    remark = r"(?U)\s*[\(\[]\s*(?=[A-ZÁÉÍÓÚÑ])(?=(?:[^()\[\]]*\s){2,})[^()\[\]]{12,120}[\)\]]\s*\.?\s*$"
    t = stripped(F.regexp_replace(c, tag, ""))
    for _ in range(3):
        t = stripped(F.regexp_replace(t, remark, ""))
    return F.regexp_replace(t, r"(?s)([^.])\z", "$1.")


def file_stem(c: Column, fallback: str = "salida") -> Column:
    """A name that any file system takes."""
    t = stripped(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]+', "-"))
    t = without_chars(F.regexp_replace(F.regexp_replace(t, SPACE, "_"), "-{2,}", "-"), "-_")
    return F.when(t == "", F.lit(fallback)).otherwise(F.left(t, F.lit(80)))


def path_name(c: Column) -> Column:
    """A name as a part of a path: colons, slashes and spaces as _."""
    return F.translate(c, ":/ ", "___")


def contains_any(c: Column, phrases: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(c, F.lit(p))
    return found


def mapped(c: Column, of: dict[str, str]) -> Column:
    """The value that a fixed dictionary has for c, or c."""
    out = F.when(F.lit(False), c)
    for k, v in of.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(c)


def json_body(c: Column) -> Column:
    """The JSON within a model's answer: what a fence holds, from the first bracket to the last."""
    t = stripped(c)
    fence = F.regexp_extract(t, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)
    t = F.when(fence == "", t).otherwise(fence)
    return F.nullif(F.regexp_extract(t, r"(?s)([\{\[].*[\}\]])", 1), F.lit(""))


def safe_double(c: Column) -> Column:
    """A number from text; true and false count as 1 and 0, anything else is null."""
    t = F.lower(F.trim(c))
    return F.when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)).when(t == "nan", F.lit(None)).otherwise(t.try_cast("double"))
