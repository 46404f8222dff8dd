"""Records of feeds and supplier files projected to the columns that are kept, by the names that a file happens to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions import catalog, numbers
from pricewren.functions.text import graph_text, strip_marks
from pricewren.operators.topk import first_of

# Fields of market prices, and the names under which feeds have them, in order of preference.
MARKET_FIELDS = {
    "expediente": ("expedientecum", "expediente"),
    "consecutivocum": ("consecutivo", "consecutivocum", "consecutivo_cum"),
    "canal_mercado": ("transaccionsismeddesc", "canal", "canal_mercado", "tipo_canal"),
    "regimen_precios": ("regimen", "regimen_precios", "regimen_precio", "id_regimen"),
    "precio_regulado_maximo": ("precio_maximo_venta_regulado", "precio_regulado_maximo", "precio_regulado", "precio_maximo_regulado", "precioreguladomaximo"),
    "acto_administrativo_precio": ("acto_administrativo", "acto_administrativo_precio", "acto_adm", "circular", "acto_adm_precio"),
    "precio_sismed_minimo": ("valorminimo", "precio_minimo_venta", "precio_minimo", "precio_sismed_minimo", "preciomin"),
    "precio_sismed_maximo": ("valormaximo", "precio_maximo_venta", "precio_maximo", "precio_sismed_maximo", "preciomax"),
    "fechacorte": ("fechacorte", "fecha_corte", "fecha_reporte"),
}
# Fields of supplier rows, their usual columns, and what stands for a missing column or value.
SUPPLIER_FIELDS = {
    "texto_original": ("descripcion", ""), "moneda": ("moneda", "COP"), "laboratorio_raw": ("laboratorio", ""), "principio_activo_raw": ("principio_activo", ""), "centro_distribucion": ("centro_distribucion", ""),
}
SUPPLIER_MAP = {"laboratorio_raw": "laboratorio", "principio_activo_raw": "principio_activo"}


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of names that is a column, null values and all; null where none is."""
    return next((F.col(f"`{n}`").cast("string") for n in names if n in df.columns), F.lit(None).cast("string"))


def market_prices(df: DataFrame) -> DataFrame:
    """PRJ-03: market prices by key and channel; rows without a key or a channel go. fechacorte is for choosing among rows of one key."""
    raw = {field: first_present(df, names) for field, names in MARKET_FIELDS.items()}
    money = lambda field: numbers.locale_decimal(raw[field]).alias(field)
    out = df.select(
        catalog.record_key(raw["expediente"], raw["consecutivocum"]).alias("id_cum"), catalog.channel(raw["canal_mercado"]).alias("canal_mercado"), numbers.regime(raw["regimen_precios"]).alias("regimen_precios"),
        money("precio_regulado_maximo"), raw["acto_administrativo_precio"].alias("acto_administrativo_precio"), money("precio_sismed_minimo"), money("precio_sismed_maximo"), F.coalesce(raw["fechacorte"], F.lit("")).alias("fechacorte"),
    )
    return out.where("id_cum is not null and canal_mercado is not null")


def products(catalog_rows: DataFrame) -> DataFrame:
    """PRJ-06: what the product table takes from catalog rows with a key."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    name = F.concat(F.coalesce("descripcioncomercial", "producto", F.lit("")), F.lit(" "), c("principioactivo"))
    kept = {"laboratorio": "titular", "principio_activo": "principioactivo", "forma_farmaceutica": "formafarmaceutica", "registro_invima": "registrosanitario", "atc": "atc", "estado_cum": "estadocum"}
    return catalog_rows.where("id_cum is not null").select(
        "id_cum", F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))).alias("nombre_limpio"), *(F.col(old).alias(new) for new, old in kept.items()), F.lower(c("estadocum")).isin("vigente", "activo").alias("activo"), F.lit("pending").alias("embedding_status")
    )


def supplier_rows(df: DataFrame, document: str, supplier: str, day: str, columns: dict[str, str] | None = None) -> DataFrame:
    """PRJ-07: a supplier's file as rows of twelve columns; rows whose price can't be read go.

    columns names the file's column of a field where that isn't the usual one. The key's and the price's have to be there.
    """
    columns = columns or {}
    key, price, rise = (columns.get(f, usual) for f, usual in (("cum", "cum"), ("precio_proveedor", "precio"), ("porcentaje_aumento", "porcentaje_aumento")))
    if missing := [c for c in (key, price) if c not in df.columns]:
        raise ValueError(f"no columns {', '.join(missing)} in the supplier's file")

    def text(field: str) -> Column:
        usual, default = SUPPLIER_FIELDS[field]
        name = columns.get(SUPPLIER_MAP.get(field, field), usual)
        return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default))) if name in df.columns else F.lit(default)

    number = lambda name: (numbers.last_separator_decimal(F.col(f"`{name}`").cast("string")) if name in df.columns else F.lit(None)).cast("double")
    out = df.select(
        F.lit(document).alias("id_documento"), F.lit(supplier).alias("proveedor"), F.lit(day).alias("fecha"), F.trim(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("cum"), number(price).alias("precio_proveedor"), number(rise).alias("porcentaje_aumento"),
        *(text(f).alias(f) for f in ("texto_original", "laboratorio_raw", "principio_activo_raw", "centro_distribucion", "moneda")), F.lit("archivo_proveedor").alias("fuente_archivo"),
    )
    return out.where("precio_proveedor is not null")


def plain_number(c: Column) -> Column:
    """A double as the shortest text with a point: 2.0, 12500.25; from 1e16 on, below 1e-4 and beyond ten decimals as 1e+16."""
    short = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    exact = (F.abs(c) < 1e16) & ((F.abs(c) >= 1e-4) | (c == 0)) & (c.cast("decimal(38,10)").cast("double") == c)
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    return F.when(exact, short).otherwise(F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2"))


def row_key(orphan: bool = False) -> Column:
    """FN-HASH-01: sha1 of a supplier row's fields in a regular form, joined by bars; of an orphan's, other fields."""
    plain = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    low = lambda name: F.lower(plain(name))
    price = F.coalesce(plain_number(F.col("precio_proveedor")), F.lit(""))
    head = [low("id_documento"), low("proveedor"), plain("fecha"), low("cum")]
    tail = [graph_text(F.col(c)) for c in ("texto_original", "laboratorio_raw", "principio_activo_raw")] if orphan else [low("centro_distribucion"), graph_text(F.col("texto_original"))]
    return F.sha1(F.concat_ws("|", *head, *tail, price))


# Fixed value: a dose that a description has or lacks. Digits are read once from where they begin: given back one by one,
# those of a long key without a unit would be tried in every division, which costs the cube of their number.
DESCRIBED_DOSE = r"(?i)(?<!\d)\d++[.,]?+\d*+\s*+(?:mg|mcg|ug|ml|g\b|ui\b|iu\b|%)"


def with_doses(description: Column, trade_name: Column, dose: str = DESCRIBED_DOSE) -> Column:
    """FN-STR-09: a description without a dose, followed by the doses of the trade name in lower case."""
    found = F.regexp_extract_all(F.coalesce(trade_name, F.lit("")), F.lit(dose), F.lit(0))
    own = F.nullif(F.trim(description), F.lit(""))
    # found stands once, so that only descriptions without a dose search the trade name
    return F.when(~own.rlike(dose), F.rtrim(F.concat_ws(" ", own, F.lower(F.array_join(found, " "))))).otherwise(own)


# Columns of the master file that are cleaned, fields of open-data records by kind, and labels of their origins.
MASTER = ("ESTADO REGISTRO", "ESTADO CUM", "EXPEDIENTE", "CONSECUTIVO", "ATC", "REGISTRO INVIMA", "NOMBRE COMERCIAL", "PRINCIPIO ACTIVO", "FORMA FARMACEUTICA", "LABORATORIO TITULAR")
NUMBERS = ("expediente", "consecutivocum", "cantidadcum")
DATES = ("fechaexpedicion", "fechavencimiento", "fechaactivo", "fechainactivo")
ORIGINS = {"vigentes": "Vigente", "vencidos": "Vencido", "en_tramite": "En tramite", "otros": "Otro"}


def master_rows(df: DataFrame, place: str | None = None) -> DataFrame:
    """PRJ-05: valid and active rows of the master file with a key, of which the last by ``place`` stays (else the greatest of all its columns).

    "Sin dato" counts as empty. The name is the trade name and the substance in lower case, without signs and marks.
    """
    clean = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), "(?i)^sin dato$", "")
    c = {name: clean(name) for name in MASTER}
    name = F.trim(F.regexp_replace(F.regexp_replace(F.concat_ws(" ", c["NOMBRE COMERCIAL"], c["PRINCIPIO ACTIVO"]), "[®™]", " "), r"\s+", " "))
    kept = df.where((F.lower(c["ESTADO REGISTRO"]) == "vigente") & (F.lower(c["ESTADO CUM"]) == "activo"))
    out = kept.select(
        F.concat(c["EXPEDIENTE"], F.lit("-"), c["CONSECUTIVO"]).alias("id_cum"), c["ATC"].alias("atc"), c["REGISTRO INVIMA"].alias("registro_invima"), F.concat(c["ESTADO REGISTRO"], F.lit(" / "), c["ESTADO CUM"]).alias("estado_regulatorio"),
        strip_marks(F.lower(name)).alias("nombre_limpio"), c["LABORATORIO TITULAR"].alias("laboratorio"), c["PRINCIPIO ACTIVO"].alias("principio_activo"), c["FORMA FARMACEUTICA"].alias("forma_farmaceutica"), *([F.col(place).alias("_place")] if place else []),
    ).where(F.length("id_cum") > 1)
    others = [F.col(x).desc() for x in out.columns if x not in ("id_cum", "_place")]
    order = [F.col("_place").desc(), *others] if place else others
    return first_of(out, ["id_cum"], order).drop("_place")


def open_records(df: DataFrame, origin: str, cut_off: str) -> DataFrame:
    """PRJ-01, PRJ-02: open-data records of one origin with key, numbers, dates, and the origin's state where they have none; rows without a key go."""
    keyed = df.withColumn("id_cum", catalog.record_key(F.col("expediente"), F.col("consecutivocum")))
    out = keyed.withColumns({c: numbers.integer(F.col(c)) for c in NUMBERS if c in df.columns} | {c: catalog.instant(F.col(c)) for c in DATES if c in df.columns})
    state = catalog.or_default(F.col("estadocum"), F.lit(ORIGINS.get(origin, origin)))
    return out.withColumn("estadocum", state).withColumn("estado_origen", F.lit(origin)).withColumn("fecha_corte_dato", F.lit(cut_off).cast("timestamp")).where("id_cum is not null")


def display_text(c: Column) -> Column:
    """FN-STR-21: a text without signs that couldn't be read, white space squeezed; null counts as empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\ufffd?]", ""), r"\s+", " "))


def title_case(c: Column) -> Column:
    """FN-STR-21: display_text() in lower case, with letters in capitals where a word begins.

    A word's border is between an ASCII letter, digit or _ and anything else, so a letter with an accent that follows
    an ASCII one is a capital too.
    """
    signs = F.regexp_extract_all(F.lower(display_text(c)), F.lit("(?s)."), F.lit(0))
    word = lambda x: x.rlike("^[A-Za-z0-9_]$")

    def cased(x: Column, i: Column) -> Column:
        before = (i > 0) & F.coalesce(word(F.get(signs, i - 1)), F.lit(False))
        return F.when(x.rlike(r"^\p{L}$") & (word(x) != before), F.upper(x)).otherwise(x)

    return F.array_join(F.transform(signs, cased), "")
