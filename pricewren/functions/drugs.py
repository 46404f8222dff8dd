"""Names of medicines read into components, concentrations and forms, as column expressions."""

from __future__ import annotations

import unicodedata
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions.text import ascii_fold

# Units as they are written, and what they are read as.
UNITS = {
    "mg": "mg", "g": "g", "mcg": "mcg", "µg": "mcg", "microgramo": "mcg", "microgramos": "mcg", "ug": "mcg",
    "ui": "IU", "iu": "IU", "u": "IU", "usp": "IU", "miu": "mIU", "ml": "mL", "l": "L", "meq": "mEq", "mmol": "mmol", "%": "%",
    "mcg/dosis": "mcg/dosis", "ug/dosis": "mcg/dosis", "µg/dosis": "mcg/dosis", "mg/dosis": "mg/dosis", "ui/dosis": "IU/dosis", "iu/dosis": "IU/dosis",
    "mg/ml": "mg/mL", "mg/dl": "mg/dL", "mg/l": "mg/L", "mg/g": "mg/g", "mg/kg": "mg/kg", "g/ml": "g/mL", "g/dl": "g/dL", "g/l": "g/L", "g/g": "g/g",
    "mcg/ml": "mcg/mL", "ug/ml": "mcg/mL", "µg/ml": "mcg/mL", "mcg/kg": "mcg/kg", "ui/ml": "IU/mL", "iu/ml": "IU/mL", "ui/g": "IU/g", "iu/g": "IU/g",
    "meq/ml": "mEq/mL", "meq/l": "mEq/L", "mmol/ml": "mmol/mL", "mmol/l": "mmol/L",
}
# Names of substances, and what they are read as.
SUBSTANCES = {
    "vitamina d3": "colecalciferol", "vitamin d3": "colecalciferol", "cholecalciferol": "colecalciferol", "colecalciferol": "colecalciferol",
    "vitamina b12": "cianocobalamina", "cianocobalamina": "cianocobalamina", "vitamina b1": "tiamina", "tiamina": "tiamina",
    "vitamina c": "acido ascorbico", "acido ascorbico": "acido ascorbico", "acido folico": "acido folico", "folato": "acido folico",
    "paracetamol": "acetaminofen", "acetaminofen": "acetaminofen", "amoxicilina": "amoxicilina", "amoxycillin": "amoxicilina",
    "acido clavulanico": "acido clavulanico", "ac clavulanico": "acido clavulanico", "ac. clavulanico": "acido clavulanico", "clavulanato": "acido clavulanico",
    "azitromicina": "azitromicina", "claritromicina": "claritromicina", "ciprofloxacino": "ciprofloxacino", "ciprofloxacina": "ciprofloxacino",
    "metronidazol": "metronidazol", "abacavir": "abacavir", "aciclovir": "aciclovir", "acyclovir": "aciclovir",
    "codeina": "codeina", "codeína": "codeina", "tramadol": "tramadol", "morfina": "morfina",
    "agua destilada": "agua para preparaciones inyectables", "agua esteril": "agua para preparaciones inyectables", "agua destilada esteril": "agua para preparaciones inyectables",
}
# Pharmaceutical forms by route, each with other ways to write it.
FORMS = {
    "ORAL_SOLID": {
        "tableta": ("tabletas", "tab", "tab.", "comprimido", "comprimidos"),
        "tableta recubierta": (),
        "tableta dispersable": (),
        "tableta efervescente": (),
        "tableta de liberacion prolongada": ("tabletas de liberacion prolongada", "tableta liberacion prolongada", "tableta de liberacion modificada"),
        "tableta de liberacion retardada": ("tabletas de liberacion retardada", "tableta liberacion retardada"),
        "tableta masticable": ("tabletas masticables",),
        "tableta sublingual": (),
        "tableta orodispersable": ("tableta dispersible",),
        "capsula": ("capsulas", "cap", "cap.", "capsula dura", "cápsula dura", "capsulas duras"),
        "capsula blanda": ("capsulas blandas", "capsula gelatinosa"),
        "capsula de liberacion prolongada": ("capsula de liberacion retardada",),
        "capsula de liberacion modificada": (),
        "gragea": (),
        "granulos": ("granulos para solucion oral",),
    },
    "ORAL_LIQUID": {
        "solucion oral": ("sol. oral", "solucion"),
        "suspension oral": ("suspension",),
        "jarabe": ("syrup",),
        "elixir": (),
        "emulsion oral": (),
        "gotas orales": (),
    },
    "INJECTABLE": {
        "solucion inyectable": ("solucion para inyeccion", "sol. inyectable", "solucion inyectable concentrada"),
        "solucion para infusion": ("solucion para infusion intravenosa", "solucion concentrada para infusion"),
        "polvo para solucion inyectable": (),
        "polvo para reconstitucion": ("liofilizado", "polvo para reconstituir a solucion oral", "polvo para reconstituir a suspension oral", "polvo esteril para reconstituir", "polvo para reconstituir", "polvo liofilizado", "polvo liofilo"),
        "suspension inyectable": (),
    },
    "TOPICAL": {
        "unguento": ("unguento topico", "ungüento", "ungüento topico"),
        "crema": ("crema topica", "crema proctologica"),
        "crema vaginal": (),
        "gel topico": ("gel",),
        "solucion topica": (),
        "suspension topica": (),
        "locion": ("locion topica",),
        "espuma topica": (),
        "parche transdermico": ("parche trasdermico",),
        "polvo topico": (),
        "jalea": ("jalea topica", "jalea uretral", "gel uretral"),
        "pasta": ("pasta topica",),
    },
    "OPHTHALMIC": {
        "solucion oftalmica": ("colirio", "gotas oftalmicas"),
        "suspension oftalmica": (),
        "gel oftalmico": (),
        "unguento oftalmico": (),
        "solucion otica": ("gotas oticas",),
    },
    "INHALATION": {
        "inhalador": ("aerosol", "spray", "solucion en aerosol", "solucion en aerosol inhalador", "aerosol inhalador"),
        "spray nasal": ("solucion intranasal",),
        "polvo para inhalacion": ("capsula dura para inhalacion", "polvo para inhalacion inhalador"),
        "solucion para inhalacion": ("solucion para nebulizacion", "solucion nebulizable"),
    },
    "RECTAL_VAGINAL": {
        "supositorio": ("supositorios",),
        "ovulo": (),
        "ovulo vaginal": (),
        "tableta vaginal": (),
        "solucion rectal": (),
        "unguento rectal": (),
        "dispositivo intrauterino": (),
    },
    "OTHER": {
        "implante": ("implante trasdermico", "implante transdermico"),
        "polvo efervescente": (),
    },
}
# Words beside a substance's name that aren't part of it.
SALTS = ("clorhidrato", "hidrocloruro", "sodico", "potasico", "calcico", "acetato", "fosfato", "sulfato", "bromuro", "maleato", "fumarato", "tartrato", "base", "mesilato", "mesilas", "trihidrato", "monohidrato", "dihidrato", "etabonato", "anhidro", "besylato")
# Packaging at the end of a name.
CONTAINERS = r"frasco(?:\s+gotero)?|vial|jeringa(?:\s+prellenada)?|ampolla|ampula|sobre|tubo|caja|lapicero|cartucho|implante|par\b"
QUANTITY = r"x\s+\d+[.,]?\d*\s*(?:ml|g\b|l\b|mg|mcg|dosis|unidades?|uds?|u\b)"

_NUMBER = r"\d+(?:[.,]\d+)?"
_BY_LENGTH = sorted(UNITS, key=lambda u: ("/" not in u, -len(u)))
#: A dose: number, then unit, of which the longest is taken. Group 1 is the number, group 2 the unit.
DOSE = rf"(?i)({_NUMBER})\s*({'|'.join(_BY_LENGTH)})(?![\p{{L}}\p{{N}}_])"
RATIO = rf"(?i)^({_NUMBER})\s*(mg|mcg|µg|ug|g\b|ui|iu|meq|mmol|ml|l\b)\s*/\s*({_NUMBER})\s*(ml|g\b|l\b)$"
VALUE = "decimal(28,8)"
CONCENTRATION = f"struct<raw: string, value: {VALUE}, unit: string, encoding: string, ambiguous: boolean>"


def _forms() -> list[tuple[str, str, str]]:
    """Each way to write a form, the form, and its group."""
    return [(name, form, group) for group, forms in FORMS.items() for form, others in forms.items() for name in (form, *others)]


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _composed(c: Column) -> Column:
    """Letters and the combining marks of Spanish put together (Unicode NFC)."""
    for letter, mark in product("aeiounAEIOUN", "́̃̈"):
        whole = unicodedata.normalize("NFC", letter + mark)
        if len(whole) == 1:
            c = F.replace(c, F.lit(letter + mark), F.lit(whole))
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unit(c: Column) -> Column:
    """FN-PARSE-09: a unit as it is read; an unknown one in upper case."""
    return F.coalesce(F.try_element_at(_table(UNITS), F.lower(strip(c))), F.upper(strip(c)))


def number(c: Column) -> Column:
    """FN-PARSE-08: a number with a comma for thousands before three digits, and for decimals before any other count."""
    return F.when(c.rlike(r"^\d+,\d{3}$"), F.replace(c, F.lit(","), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit("."))).try_cast(VALUE)


def ambiguous(c: Column) -> Column:
    """Whether a number has a comma before four digits or more."""
    return c.rlike(r",\d{4,}$")


def _concentration(raw: Column, value: Column, unit_: Column, encoding: Column, unclear: Column) -> Column:
    return F.struct(raw.alias("raw"), value.alias("value"), unit_.alias("unit"), encoding.alias("encoding"), unclear.alias("ambiguous")).cast(CONCENTRATION)


def dose(c: Column, encoding: str = "INLINE") -> Column:
    """FN-PARSE-10: the first dose in a text, or null."""
    n, u = F.regexp_extract(c, DOSE, 1), F.regexp_extract(c, DOSE, 2)
    how = F.when(u == "%", F.lit("INLINE_PERCENT")).otherwise(F.lit(encoding)) if encoding == "INLINE" else F.lit(encoding)
    return F.when(c.rlike(DOSE), _concentration(c, number(n), unit(u), how, ambiguous(n)))


def bracket(c: Column) -> Column:
    """FN-PARSE-11: `a u / b v` as a/b in u/v, else the first dose in a bracket, or null."""
    t = strip(c)
    n1, u1, n2, u2 = (F.regexp_extract(t, RATIO, k) for k in range(1, 5))
    ratio = F.try_divide(number(n1), number(n2)).try_cast(VALUE)
    whole = _concentration(c, ratio, unit(F.concat(unit(u1), F.lit("/"), unit(u2))), F.lit("BRACKET_RATIO"), ambiguous(n1) | ambiguous(n2))
    return F.when(t.rlike(RATIO), F.when(ratio.isNotNull(), whole)).otherwise(dose(c, "BRACKET_SIMPLE"))


def catalog_concentration(c: Column) -> Column:
    """FN-PARSE-18: the concentration of a catalog text: a dose, else a bracket."""
    return F.coalesce(dose(strip(c)), bracket(F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", "")))


def substance(c: Column) -> Column:
    """FN-PARSE-13: a substance's name folded, without words for salts."""
    bare = F.regexp_replace(ascii_fold(c), rf"\b(?:{'|'.join(SALTS)})\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def form(c: Column) -> Column:
    """FN-PARSE-15: the form that a text names, or null."""
    key = F.regexp_replace(strip(ascii_fold(c)), r"\s+", " ")
    return F.try_element_at(_table({ascii_name: f for name, f, _ in _forms() if (ascii_name := unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode())}), key)


def form_group(c: Column) -> Column:
    """FN-PARSE-15: the route group of a form's text; OTHER where it isn't known, null for null and empty ones."""
    group = F.coalesce(F.try_element_at(_table({f: g for _, f, g in _forms()}), form(c)), F.lit("OTHER"))
    return F.when(F.coalesce(c, F.lit("")) != "", group)


def form_barrier(query_group: Column, catalog_form: Column) -> Column:
    """LNK-07: groups must be equal; a name without a form, or a catalog form that isn't known, passes."""
    group = form_group(catalog_form)
    return query_group.isNull() | group.isNull() | (group == "OTHER") | (query_group == group)


def same_concentration(a: Column, b: Column) -> Column:
    """LNK-06: equal value and unit; a catalog text that can't be read (b is null) passes."""
    return b.isNull() | F.coalesce((a["value"] == b["value"]) & (F.lower(a["unit"]) == F.lower(b["unit"])), F.lit(False))


def outside_plus(c: Column) -> Column:
    """FN-PARSE-05: a text divided at the plus signs outside brackets and parentheses.

    The depth rises with each opening sign and falls with each closing one, not below 0. Where it stands after a piece
    follows from the piece's sum of steps and its lowest point: the signs' clamped sum.
    """
    signs = lambda x: F.regexp_extract_all(x, F.lit(r"[()\[\]]"), F.lit(0))

    def steps(x: Column) -> Column:
        def step(s: Column, sign: Column) -> Column:
            total = s["total"] + F.when(sign.isin("(", "["), 1).otherwise(-1)
            return F.struct(total.alias("total"), F.least(s["low"], total).alias("low"))

        return F.aggregate(signs(x), F.struct(F.lit(0).alias("total"), F.lit(0).alias("low")), step)

    pieces = F.transform(F.split(c, r"\+"), lambda x: F.struct(x.alias("text"), steps(x).alias("steps")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("depth"))

    def take(s: Column, piece: Column) -> Column:
        ends = s["now"].isNotNull() & (s["depth"] == 0)
        done = F.when(ends, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        now = F.when(s["now"].isNull() | ends, piece["text"]).otherwise(F.concat(s["now"], F.lit("+"), piece["text"]))
        return F.struct(done.alias("done"), now.alias("now"), (piece["steps"]["total"] + F.greatest(s["depth"], -piece["steps"]["low"])).alias("depth"))

    whole = F.aggregate(pieces, start, take, lambda s: F.concat(s["done"], F.array(s["now"])))
    return F.when(c.rlike(r"[()\[\]]"), whole).otherwise(F.split(c, r"\+"))


def parse_names(names: DataFrame, column: str) -> DataFrame:
    """One row for each distinct text in column: itself and what it is read as.

    components (substance, canonical, aliases), concentrations (raw, value, unit, encoding), form, form_group, is_combo,
    concentration (the most precise one of a name with one component), warnings, is_matchable and inn_query (the
    canonical substances in order, joined by " / "). Null counts as the empty text. Each step is a projection of its own.
    """
    warn = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    d = names.select(F.col(column).alias("name")).distinct()
    d = d.withColumn("clean", F.lower(strip(_composed(F.coalesce("name", F.lit(""))))))
    d = d.withColumn("brackets", F.transform(F.regexp_extract_all("clean", F.lit(r"\[([^\]]*)\]")), strip))
    d = d.withColumn("parens", F.transform(F.regexp_extract_all("clean", F.lit(r"\(([^)]*)\)")), strip))
    bare = F.regexp_replace(F.regexp_replace("clean", r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    bare = strip(F.regexp_replace(bare, r"\s{2,}", " "))
    d = d.withColumn("bare", strip(F.regexp_replace(bare, rf"(?i)(?:\s+(?:{QUANTITY}|{CONTAINERS}))+\s*$", "")))
    endings = "|".join(name.replace(".", r"\.") for name, _, _ in _forms())
    d = d.withColumn("raw_form", F.nullif(F.regexp_extract("bare", rf"(?:{endings})$", 0), F.lit("")))
    d = d.withColumn("rest", strip(F.expr("left(bare, length(bare) - coalesce(length(raw_form), 0))")))
    parts = F.filter(F.transform(outside_plus(F.col("rest")), strip), lambda x: x != "")
    d = d.withColumn("parts", F.when(F.size(parts) == 0, F.array("rest")).otherwise(parts))
    head = lambda x: F.regexp_extract(x, rf"(?s)^(.*?)(?:{DOSE})", 1)
    read = F.transform("parts", lambda x: F.struct(F.when(x.rlike(DOSE), strip(head(x))).otherwise(strip(x)).alias("inn"), F.when(x.rlike(DOSE), strip(F.substring(x, F.length(head(x)) + 1, F.length(x)))).alias("dose")))
    d = d.withColumn("read", read)
    d = d.withColumn("inns", F.filter("read.inn", lambda x: x != "")).withColumn("inline", F.transform(F.filter("read.dose", lambda x: x.isNotNull()), lambda x: dose(x)))
    d = d.withColumn("bracketed", F.transform("brackets", bracket))
    plus = lambda x: F.contains(x, F.lit("+"))
    pieces = F.flatten(F.transform("brackets", lambda b: F.when(plus(b), F.transform(F.filter(F.transform(F.split(b, r"\+"), strip), lambda x: x != ""), lambda x: F.coalesce(dose(x), bracket(x)))).otherwise(F.array(bracket(b)))))
    several = F.size("inns") > 1
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    d = d.withColumn("pieces", pieces)
    d = d.withColumn("all", F.when(~several, F.concat(some(F.col("bracketed")), some(F.col("inline")))).when(F.size("inline") > 0, some(F.col("inline"))).otherwise(some(F.col("pieces"))))
    percent = F.try_element_at(F.filter("inline", lambda x: x["encoding"] == "INLINE_PERCENT"), F.lit(1))
    ratio = F.try_element_at(F.filter("bracketed", lambda x: x["encoding"] == "BRACKET_RATIO"), F.lit(1))
    d = d.withColumn("percent", percent).withColumn("ratio", ratio)

    def component(raw: Column, paren: Column) -> Column:
        own, known, near = substance(raw), _table(SUBSTANCES), F.lower(paren)
        by_paren, by_own = F.try_element_at(known, near), F.try_element_at(known, own)
        canonical = F.coalesce(by_paren, by_own, own)
        alias = F.when(by_paren.isNotNull(), F.when(own != by_paren, own)).when(by_own.isNotNull() & paren.isNotNull(), F.when(near != by_own, paren)).when(by_own.isNotNull(), F.when(own != by_own, own)).otherwise(paren)
        return F.struct(own.alias("substance"), canonical.alias("canonical"), F.array_compact(F.array(alias)).alias("aliases"), (paren.isNull() & by_own.isNull()).alias("unknown"))

    first = F.try_element_at("parens", F.lit(1))
    whole = F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col("clean"))
    alone = F.when(F.size("inns") == 0, F.array(whole)).otherwise(F.col("inns"))
    d = d.withColumn("components", F.when(F.col("clean") != "", F.transform(alone, lambda x, i: component(x, F.when(i == 0, first)))).otherwise(F.array().cast("array<struct<substance: string, canonical: string, aliases: array<string>, unknown: boolean>>")))
    d = d.withColumn("form", form(F.col("raw_form"))).withColumn("form_group", form_group(F.col("raw_form")))
    used_pieces = several & (F.size("inline") == 0)
    unread = F.exists("bracketed", lambda x: x.isNull()) | (used_pieces & F.exists("pieces", lambda x: x.isNull()))
    unclear = lambda c: F.exists(c, lambda x: F.coalesce(x["ambiguous"], F.lit(False)))
    off = (F.col("ratio.unit") == "mg/mL") & (F.abs(F.col("percent.value") * 10 - F.col("ratio.value")) > F.col("ratio.value") * F.lit(0.01).cast("decimal(4,2)"))
    warnings = F.concat(
        warn(unclear("inline") | unclear("bracketed") | (used_pieces & unclear("pieces")), "AMBIGUOUS_DECIMAL"), warn(unread, "UNPARSEABLE_BRACKET"), warn(F.coalesce(off, F.lit(False)), "BRACKET_RATIO_INCONSISTENT"),
        warn(F.size("all") == 0, "NO_CONCENTRATION_FOUND"), warn(F.exists("components", lambda x: x["unknown"]), "INN_NOT_IN_SYNONYM_TABLE"),
        warn((F.size("components") > 1) & (F.size("all") != F.size("components")), "COMPONENT_COUNT_MISMATCH"), warn(F.col("raw_form").isNotNull() & F.col("form").isNull(), "FORM_NOT_RECOGNIZED"),
    )
    d = d.withColumn("warnings", warnings)
    # FN-PARSE-16: the most precise encoding first
    encoded = lambda e: F.try_element_at(F.filter("all", lambda x: x["encoding"] == e), F.lit(1))
    best = F.coalesce(*(encoded(e) for e in ("BRACKET_RATIO", "INLINE", "BRACKET_SIMPLE", "INLINE_PERCENT")))
    return d.select(
        F.col("name").alias(column), F.transform("components", lambda x: x.dropFields("unknown")).alias("components"), F.transform("all", lambda x: x.dropFields("ambiguous")).alias("concentrations"),
        "form", "form_group", (F.size("components") > 1).alias("is_combo"), F.when(F.size("components") <= 1, best).dropFields("ambiguous").alias("concentration"), "warnings",
        (~F.arrays_overlap("warnings", F.array(F.lit("COMPONENT_COUNT_MISMATCH"), F.lit("AMBIGUOUS_DECIMAL")))).alias("is_matchable"), F.array_join(F.array_sort(F.transform("components", lambda x: x["canonical"])), " / ").alias("inn_query"),
    )
