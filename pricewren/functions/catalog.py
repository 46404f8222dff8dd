"""Fields of catalog records and supplier files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewren.functions import numbers
from pricewren.functions.text import ascii_fold, graph_text, search_text

# Abbreviations and what they stand for; codes and words that a product's text loses.
ABBREVIATIONS = {"claritromi": "claritromicina", "gluco": "glucosamina", "condro": "condroitin"}
PACK_CODES = ("ppsfcox", "fcox", "cjax", "jbefcox", "grancjax", "cjaxsob", "fcoxsob")
PACKS = ("caja", "blister", "frasco", "ampolla", "vial", "tableta", "tabletas", "capsula", "capsulas", "comprimidos?", "sobres?", "parche", "jeringa", "unidades?", r"und\.?", r"tab\.?", r"cap\.?")
PACK_UNITS = ("ml", "mg", "g", "mcg", "ui", "iu", "miu")
FORM_WORDS = ("oral", "intravenoso", r"iv\b", r"im\b", r"sc\b", "topico", "topica", "inyectable", "soluble", "efervescente", "rectal", "sublingual", "inhalador", "spray", "solucion", "suspension", "emulsion", "crema", "gel", "pomada", "jarabe", "gotas")
SALT_WORDS = ("clorhidrato", "hidrocloruro", "trihidrato", "monohidrato", "dihidrato", "anhidro", "mesilato", "mesilas", "etabonato", "besylato", "tartrato", "maleato", "fumarato", "gluconato")
SUFFIXES = ("col", "eof", "ni", "pps", "fco", "cja", "jbe", "sob")
# Words that don't count in a search.
STOP_WORDS = (
    "mg", "ml", "g", "mcg", "ug", "meq", "ui", "tableta", "tabletas", "capsula", "capsulas", "cápsula", "cápsulas", "comprimido", "comprimidos", "gragea", "grageas",
    "suspension", "suspensión", "solucion", "solución", "oral", "intravenosa", "intramuscular", "ampolla", "ampollas", "frasco", "caja",
)
# File names and headers by which suppliers are known, in order.
FILE_NAMES = {
    r"tecno\s*quimicas?": "TECNOQUIMICAS", r"la\s*sante?": "LA_SANTE", "fresenius": "FRESENIUS", "megalabs?": "MEGALABS", "procaps?": "PROCAPS", "bayer": "BAYER", "pfizer": "PFIZER", "novartis": "NOVARTIS",
    "genfar": "GENFAR", "lafrancol": "LAFRANCOL", r"\bmk\b": "MK", r"coaspharma|coas\s*pharma": "COASPHARMA", "roche": "ROCHE", "sanofi": "SANOFI", "merck": "MERCK",
}
HEADERS = (
    (("codigo axapta", "descripcion", "precio umd"), "MEGALABS"), (("cum", "vigente desde", "vigente hasta", "precio"), "FRESENIUS"), (("cum", "descripcion", "precio"), "LA_SANTE"),
    (("codigo cum", "producto", "precio unitario"), "TECNOQUIMICAS"), (("reg. invima", "descripcion", "precio"), "PROCAPS"),
)


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def pharma_text(c: Column) -> Column:
    """FN-STR-03, FN-STR-04: a product's text without packs, forms, salts and supplier codes; null counts as empty.

    The order of the steps is part of the result.
    """
    t = ascii_fold(F.coalesce(c, F.lit("")))
    for short, whole in ABBREVIATIONS.items():
        t = F.regexp_replace(t, rf"\b{short}\b", whole)
    gone = lambda x, pattern: F.regexp_replace(x, pattern, " ")
    t = gone(t, rf"\b{_any(PACK_CODES)}\d+\w*\b")
    t = F.regexp_replace(F.regexp_replace(t, "([0-9])([a-z])", "$1 $2"), "([a-z])([0-9])", "$1 $2")
    t = gone(t, rf"\b{_any(PACKS)}(?:\s*x\s*|\s+)\d+(?:\s*{_any(PACK_UNITS)})?\b")
    t = gone(gone(t, rf"\b{_any(FORM_WORDS)}\b"), rf"\b{_any(SALT_WORDS)}\b")
    t = gone(gone(t, r"[^0-9a-z\s]"), rf"\b{_any(SUFFIXES)}\b")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _letters_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\s]", " "), r"\s+", " "))


def trade_name(c: Column) -> Column:
    """FN-STR-10: a product's name without signs, doses and form words; null if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(c)), "[®™©]", "")
    t = F.regexp_replace(t, r"\d+(?:[.,]\d+)?\s?(?:mcg|meq|mg|ml|ui|ug|%|g)", " ")
    t = F.regexp_replace(t, r"tableta|capsula|c[?aá]psula|ampolla|vial|jarabe|loci[oó]n|gragea|inyectable|soluci[oó]\??n|recubierta|blanda|dura|cubierta", " ")
    return F.nullif(_letters_only(t), F.lit(""))


def dose_quantity(c: Column) -> Column:
    """FN-NUM-07: a plain number, or null."""
    return F.when(c.rlike(r"^\d+\.?\d*$"), c.try_cast("double"))


def presentation(c: Column) -> Column:
    """FN-STR-11: how a product is packed, by the first pattern that is found."""
    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))

    box = lambda n: F.concat(F.lit("Caja x "), n)
    point = lambda n: F.concat(F.replace(n, F.lit(","), F.lit(".")), F.lit(" ml"))
    return F.coalesce(
        box(found(r"(?i)caja[^\d]*(?:por|x|con)\s*(\d+)")), F.concat(F.lit("Blister x "), found(r"(?i)blister[^\d]*(?:por|x|con)?\s*(\d+)")),
        box(found(r"(?i)(\d+)\s*(?:tabletas|c[áa?]psulas|capsulas|comprimidos|grageas|ampollas|viales|sobres)")),
        F.concat(F.lit("Frasco "), point(found(r"(?i)frasco[^\d]*(\d+(?:[.,]\d+)?)\s*ml"))), point(found(r"(?i)(\d+(?:[.,]\d+)?)\s*ml")), box(found(r"(?i)x\s*(\d+)")),
    )


def solution_volume(c: Column) -> Column:
    """FN-STR-12: millilitres."""
    return F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*ml", 1).try_cast("double")


def plain_form(c: Column) -> Column:
    """FN-STR-13: the usual name of a form, else its letters in lower case."""
    t = F.lower(F.trim(c))
    rules = (
        ("tableta cubierta con pelicula", "tableta cubierta"), ("tableta recubierta", "tableta recubierta"), (r"tableta cubierta \(gragea\)", "gragea"), ("^tableta$", "tableta"),
        ("c.?psula dura|capsula dura", "cápsula dura"), ("c.?psula blanda|capsula blanda", "cápsula blanda"), ("soluci.?n inyectable", "solución inyectable"), ("soluci.?n oft[áa]lmica", "solución oftálmica"),
        ("soluci.?n oral", "solución oral"), ("loci.?n|locion", "loción"), ("^gragea$", "gragea"),
    )
    named = [F.when(t.rlike(pattern), F.lit(name)) for pattern, name in rules]
    return F.when(c.isNotNull(), F.coalesce(*named, F.lower(_letters_only(c))))


def route(c: Column, form: Column) -> Column:
    """FN-STR-14: the route as given, else as the form implies."""
    given = c.isNotNull() & ~c.isin("SIN DATO", "A", "B", "C", "S", "")
    implied = F.when(form.rlike("(?i)inyectable"), "intravenosa").when(form.rlike("(?i)oftalmica"), "conjuntival").when(form.rlike("(?i)locion|crema"), "tópica")
    return F.when(given, F.lower(F.trim(c))).otherwise(implied)


def release_type(c: Column) -> Column:
    """FN-STR-15."""
    return F.when(c.rlike("(?i)liberacion retardada"), "retardada").when(c.rlike("(?i)liofilizado"), "liofilizado").when(c.rlike("(?i)liberacion sostenida"), "sostenida")


def brand(c: Column) -> Column:
    """FN-STR-16: what stands before ® or ™ if no digit comes first."""
    return F.nullif(F.trim(F.regexp_extract(c, "^([^0-9]*?[®™])", 1)), F.lit(""))


def upper_words(c: Column) -> Column:
    """FN-STR-17: upper case, punctuation to spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)[^\w\s]", " "), r"\s+", " "))


def channel(c: Column) -> Column:
    """FN-STR-19: INS or COM, or null."""
    t = F.upper(F.trim(c))
    return F.when(F.contains(t, F.lit("INSTITUCIONAL")), "INS").when(F.contains(t, F.lit("COMERCIAL")), "COM").when(t.isin("INS", "I"), "INS").when(t.isin("COM", "C"), "COM")


def is_yes(c: Column) -> Column:
    """FN-STR-24: whether a text says yes; null doesn't."""
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin("SI", "SÍ", "YES", "TRUE", "1"), F.lit(False))


def currency(c: Column) -> Column:
    """FN-NUM-04: a price; dots are thousands where groups of three stand before a comma, else commas are dropped."""
    t = F.regexp_replace(F.trim(c), r"[^\d,.\-]", "")
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"\d{1,3}(\.\d{3})+,\d+"), european).otherwise(F.replace(t, F.lit(","), F.lit(""))).try_cast("double")


def instant(c: Column) -> Column:
    """FN-DT-02: a timestamp in one of four formats."""
    t = F.trim(c)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSS]", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d", "M/d/yyyy")))


def record_key(record: Column, sequence: Column) -> Column:
    """PRJ-01: both parts as integers, the second padded to two digits and never cut; null if either can't be read."""
    a, b = numbers.integer(record), numbers.integer(sequence)
    return F.when(a.isNotNull() & b.isNotNull(), F.format_string("%d-%02d", a, b))


def or_default(c: Column, default: Column) -> Column:
    """PRJ-02: c, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def no_data(c: Column) -> Column:
    """PRJ-05: the text, empty where it says that there is no data."""
    return F.regexp_replace(c, "(?i)^sin dato$", "")


def search_words(c: Column) -> tuple[Column, Column]:
    """FLT-05: words and numbers of a search text, without stop words and words of one or two letters."""
    parts = F.split(search_text(c), " ")
    return F.filter(parts, lambda x: ~x.rlike("^[0-9]+$") & ~x.isin(*STOP_WORDS) & (F.length(x) > 2)), F.filter(parts, lambda x: x.rlike("^[0-9]+$"))


def supplier_of(file_name: Column, columns: Column) -> Column:
    """FN-STR-22, ARR-04: code, confidence and method of the supplier that a file's name or else its headers show."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.replace(file_name, F.lit("\\"), F.lit("/")), "([^/]*)$", 1), r"\.[^.]+$", ""))
    own = F.transform(columns, lambda x: F.lower(F.trim(x)))
    answer = lambda code, sure, how: F.struct(F.lit(code).cast("string").alias("code"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))
    tests = [F.when(stem.rlike(pattern), answer(code, 0.95, "filename")) for pattern, code in FILE_NAMES.items()]
    tests += [F.when(F.size(F.array_except(F.array(*map(F.lit, names)), own)) == 0, answer(code, 0.9, "header")) for names, code in HEADERS]
    return F.coalesce(*tests, answer(None, 0.0, "unknown"))


def ingredient_tokens(c: Column) -> Column:
    """FN-STR-08: ingredients of four letters or more, upper case, distinct."""
    parts = F.split(F.upper(graph_text(c)), r"\s*(?:\+|/|\bY\b|\bCON\b|;)\s*")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= 4))


def share(a: Column, b: Column) -> Column:
    """Overlap of two sets by the larger one; 0 if only b is empty, one half if a is."""
    both = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return F.when(F.size(a) == 0, 0.5).when(F.size(b) == 0, 0.0).otherwise(both)


def five_part_score(text_ratio: Column, doses: tuple[Column, Column], makers: tuple[Column, Column], ingredients: tuple[Column, Column], rank: Column) -> Column:
    """FN-SCO-01: .45 text, .25 doses, .15 maker, .10 ingredients and .05 of the search rank; the first of each pair is the unmatched row's."""
    maker, own = graph_text(makers[1]), graph_text(makers[0])
    by_maker = F.when(own == "", 0.5).when((maker != "") & F.contains(maker, own), 1.0).otherwise(0.0)
    by_rank = F.least(F.greatest(F.coalesce(rank, F.lit(0.0)) / 5.0, F.lit(0.0)), F.lit(1.0))
    return text_ratio * 0.45 + share(*doses) * 0.25 + by_maker * 0.15 + share(*ingredients) * 0.10 + by_rank * 0.05


def approve(suggestions: Column, least: float = 0.99) -> Column:
    """FN-SCO-03: of suggestions (id, score) in rank order: the best score as confidence, and the first one's id if that is least or more."""
    best = F.array_max(F.transform(suggestions, lambda x: x["score"]))
    first = F.try_element_at(suggestions, F.lit(1))
    return F.struct(F.round(best, 4).alias("confidence"), F.when(best >= least, first["id"]).alias("id"), F.coalesce(best >= least, F.lit(False)).alias("approved"))


def homologation_state(state: Column) -> Column:
    """A state in capitals without outer spaces; automatic approvals count as approved, unknown states as pending."""
    plain = F.upper(F.trim(state))
    # fixed values
    known = F.when(plain == "AUTO_APROBADO", "APROBADO").when(~plain.isin("PENDIENTE", "APROBADO", "RECHAZADO"), "PENDIENTE")
    return known.otherwise(plain)
