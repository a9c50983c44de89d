"""Rules over a profile table (one row per column, any number of tables): roles, entities, measures, geo, privacy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, Window

from lumbre.functions import net

NUMERIC = ("integer", "long", "float", "double")

# Name rules, as regexes over the field path.
_ENTITY = (r"(?i)(^|[._])(id|user|customer|client|account|session|patient|usuario|cliente|cuenta|sesion|paciente|legajo|"
           r"dni|cuit|socio|afiliado)([._]|$)")
_CRITICAL = (r"(?i)(^|[._])(failed|error|denied|blocked|rejected|cancelled|canceled|down|downtime|critical|triage|alarm|alert|"
             r"fault|outage|exception|timeout|fallido|fallida|fallo|falla|rechazo|rechazado|rechazada|denegado|denegada|"
             r"bloqueado|bloqueada|cancelado|cancelada|caida|critico|critica|alarma|alerta|excepcion)([._]|$)")
_SUCCESS = (r"(?i)(^|[._])(response_code|status_code|result_code|return_code|outcome|result|response|rc|estado|resultado|"
            r"respuesta|codigo_respuesta|codigo_resultado)([._]|$)")
_TIMESTAMP = r"(?i)(^|[._])(time|timestamp|date|tim|created_at|event_time|fecha|hora|fecha_hora|momento)([._]|$)"
_MEASURE = (r"(?i)(amount|price|cost|revenue|total|sum|latency|duration|bytes|size|volume|count|value|metric|measure|monto|"
            r"importe|precio|costo|coste|cantidad|consumo|velocidad|duracion|tiempo|peso|saldo|valor|volumen|temperatura|"
            r"presion|caudal|produccion|paginas|ventas|ingreso|gasto|stock|litros)")
_ENTITY_HINT = (r"(?i)(^|[._])(id|ids|user|usuario|cliente|customer|client|account|cuenta|ip|host|device|dispositivo|patient|"
                r"paciente|comitente|sesion|session|merchant|comercio|well|pozo)($|[._])")
_ENTITY_WHO = (r"(?i)(^|[._])(user|usuario|cliente|customer|client|account|cuenta|patient|paciente|comitente|merchant|"
               r"comercio)($|[._])")
_ENTITY_DEVICE = r"(?i)(^|[._])(device|dispositivo|host|well|pozo|ip)($|[._])"
NOT_A_MEASURE = (r"(?i)(^|[._])(lat|latitud|latitude|lon|lng|long|longitud|longitude|edad|age|anio|año|year|mes|month|dia|day|"
                 r"hora|hour|puerto|port|srcport|dstport|sport|dport|codigo|code|cod|id|nro|numero|number|zip|cp|type|tipo|"
                 r"status|estado|sequence|secuencia|index|indice|counter|contador|orden|order|policyid|ruleid|sessionid|"
                 r"devid|proto|protocol|protocolo)($|[._])")
DURATION = (r"(?i)(^|[._])(tiempo|duracion|duration|latencia|latency|demora|delay|espera|wait|time|seg|segundos|seconds|min|"
            r"minutos|minutes|ms|horas|hours)($|[._])")
PRICE_OR_RATE = (r"(?i)(^|[._])(price|precio|tarifa|rate|tasa|kbps|bitrate|pct|porcentaje|percent|ratio|score)($|[._])")
FLOW_UNIT = r"(?i)/\s*(d|día|dia|day|h|hr|hora|hour)\b|\bpor\s+(día|dia|hora)\b|\bper\s+(day|hour)\b|\bbpd\b"
FLOW_NAME = r"(?i)(_m3d|_bpd|_mm3d|_por_dia|_per_day|_por_hora|_per_hour)$"
LOG_LEVEL = r"(?i)(^|[._])(level|loglevel|log_level|severity|severidad|nivel|priority|prioridad)$"
COMPONENT = r"(?i)(^|[._])(logger|component|componente|service|servicio|module|modulo|app|application|aplicacion)$"
_LAT = r"(?i)(^|[_.\-])(lat|latitude|latitud)([_.\-]|$)"
_LON = r"(?i)(^|[_.\-])(lon|lng|long|longitude|longitud)([_.\-]|$)"
_PAIR = r"(?i)(^|[_.\-])(geo|geoloc|location|locations|coord|coords|coordinates|coordenadas)([_.\-]|$)"
MESSAGE_HINT = (r"(?i)(^|[._])(msg|message|mensaje|log|logdesc|desc|description|descripcion|detail|detalle|reason|motivo|action|"
                r"accion|event|evento)([._]|$)")
FREE_TEXT_HINTS = (
    r"(?i)(^|[._])(msg|message|mensaje|logdesc|log_message)([._]|$)",
    r"(?i)(^|[._])(desc|description|descripcion|detail|detalle|summary|resumen|comments?|comentarios?|notas?|notes?|"
    r"observaci[oó]n|observaciones|observations?)([._]|$)",
    r"(?i)(^|[._])(rule\.name|attack|title|titulo|product_name|nombre_producto)([._]|$)",
    r"(?i)(^|[._])(\w*reason|motivo|razon|causa|cause|diagnos\w*|sintoma\w*|symptom\w*)([._]|$)")
NOT_TEXT = r"(?i)(^|[._])(id|ids|code|codigo|cod|uuid|hash|key|ref)([._]|$)|_id$|_code$"
# Words of the last path segment that identify a person, and those that do not.
_PERSON = ("user", "users", "usuario", "username", "email", "mail", "correo", "dni", "cuit", "cuil", "documento", "document",
           "passport", "pasaporte", "phone", "telefono", "tel", "celular", "mobile", "customer", "cliente", "client",
           "comitente", "account", "cuenta", "patient", "paciente", "afiliado", "card", "tarjeta", "iban", "cbu")
_NOT_PERSON = ("agent", "type", "tipo", "role", "rol", "group", "grupo")
# Log levels that carry no problem, and units that are averaged.
INFORMATIVE_LEVELS = ("INFO", "Info", "info", "INFORMATION", "Information", "information", "INFORMATIONAL", "Informational",
                      "informational", "DEBUG", "Debug", "debug", "TRACE", "Trace", "trace", "NOTICE", "Notice", "notice")
PROBLEM_LEVEL = r"(?i)^(err|error|errors|fatal|crit|critical|severe|alert|emerg|emergency|panic|warn|warning)$"
AVERAGED_UNITS = ("ms", "milisegundos", "s", "sec", "seg", "segundos", "min", "minutos", "h", "hs", "horas", "%", "pct",
                  "porcentaje", "rate", "ratio", "ppm", "rpm", "fps", "mbps", "km/h", "kmh", "°c", "°f")


def role(path: Column, kind: Column) -> Column:
    """The role a field plays, by its name and type."""
    numeric = kind.isin(*NUMERIC)
    return F.when((kind == "date") | path.rlike(_TIMESTAMP), F.lit("timestamp")) \
        .when(numeric & path.rlike(_ENTITY), F.lit(None)) \
        .when(numeric, F.when(path.rlike(_MEASURE), F.lit("measure"))) \
        .when(path.rlike(_CRITICAL), F.lit("critical_indicator")) \
        .when(path.rlike(_SUCCESS), F.lit("success_indicator")) \
        .when(path.rlike(_ENTITY), F.lit("entity_id"))


def with_roles(p: DataFrame) -> DataFrame:
    """The profile with ``role``, ``is_rate``, ``default_agg`` and ``sensitive``."""
    path, kind = F.col("column"), F.col("type")
    return p.withColumns({"role": role(path, kind), "is_rate": is_rate(path, kind, F.col("unit")),
                          "default_agg": default_agg(path, kind, F.col("unit")),
                          "sensitive": kind.isin("string", "keyword", "text") & sensitive(path)})


def is_rate(path: Column, kind: Column, unit: Column) -> Column:
    """A flow per day or hour: its readings must not be summed."""
    return kind.isin(*NUMERIC) & (F.coalesce(unit.rlike(FLOW_UNIT), F.lit(False)) | path.rlike(FLOW_NAME))


def default_agg(path: Column, kind: Column, unit: Column) -> Column:
    """Amounts are summed; durations, prices and rates averaged."""
    averaged = path.rlike(DURATION) | path.rlike(PRICE_OR_RATE) | F.coalesce(F.lower(F.trim(unit)).isin(*AVERAGED_UNITS), F.lit(False))
    return F.when(kind.isin(*NUMERIC) & ~path.rlike(NOT_A_MEASURE), F.when(averaged, F.lit("avg")).otherwise(F.lit("sum")))


def measures(p: DataFrame) -> DataFrame:
    """Per table, the measures of its entity: two sums and two averages, or three of the only kind there is."""
    marked = p.where(F.col("type").isin(*NUMERIC)).withColumn("m", F.col("role") == "measure")
    any_marked = F.max(F.coalesce(F.col("m"), F.lit(False))).over(Window.partitionBy("table"))
    agg = F.when(F.col("column").rlike(DURATION) | F.col("column").rlike(PRICE_OR_RATE), F.lit("avg")).otherwise(F.lit("sum"))
    chosen = marked.withColumn("any", any_marked).where(F.when(F.col("any"), F.coalesce(F.col("m"), F.lit(False)))
                                                        .otherwise(~F.col("column").rlike(NOT_A_MEASURE))) \
        .withColumn("agg", agg)
    kinds = F.size(F.collect_set("agg").over(Window.partitionBy("table")))
    rank = F.row_number().over(Window.partitionBy("table", "agg").orderBy("position"))
    return chosen.withColumns({"kinds": kinds, "rank": rank}) \
        .where(F.col("rank") <= F.when(F.col("kinds") == 2, 2).otherwise(3)) \
        .select("table", "column", "agg", "rank").orderBy("table", F.desc("agg"), "rank")


def entity(p: DataFrame, marked: tuple[str, ...] = ()) -> DataFrame:
    """Per table, the column that identifies who: marked, else a customer, else a device, else any id."""
    path = F.col("column")
    hint = path.rlike(_ENTITY_HINT) & F.col("type").isin("string", "keyword", "ip")
    tier = F.when(path.isin(*marked) if marked else F.lit(False), 0).when(hint & path.rlike(_ENTITY_WHO), 1) \
        .when(hint & path.rlike(_ENTITY_DEVICE), 2).when(hint, 3)
    candidates = p.withColumn("tier", tier).where(F.col("tier").isNotNull() & ((F.col("tier") == 0) | (F.col("distinct") < F.col("rows"))))
    return candidates.groupBy("table").agg(F.min_by("column", F.struct("tier", "position")).alias("entity"))


def rollup_plan(p: DataFrame, max_dimensions: int = 3, max_measures: int = 3) -> DataFrame:
    """Per table, the dimensions and measures of its hourly summary (fewest distinct values first)."""
    dims = p.where(F.col("dimension") & (F.col("type") == "string")) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy("distinct", "position"))) \
        .where(F.col("rank") <= max_dimensions).select("table", F.lit("dimension").alias("use"), "column", "rank")
    nums = p.where(F.col("type").isin(*NUMERIC) & ~F.col("column").rlike(NOT_A_MEASURE)) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy("position"))) \
        .where(F.col("rank") <= max_measures).select("table", F.lit("measure").alias("use"), "column", "rank")
    return dims.unionByName(nums)


def classify(p: DataFrame) -> DataFrame:
    """Per table, which column plays each part of an automatic board."""
    path, kind = F.col("column"), F.col("type")
    texts = kind.isin("string", "keyword", "text")
    first = lambda test: F.min_by("column", F.when(test, F.col("position")))
    level = texts & path.rlike(LOG_LEVEL)
    r = p.withColumn("role", role(path, kind))
    has = lambda name: F.coalesce(F.col("role") == name, F.lit(False))
    amount = F.col("default_agg") == "sum"
    return r.withColumn("default_agg", default_agg(path, kind, F.col("unit"))).groupBy("table").agg(
        F.bool_or(kind == "date").alias("has_time"), first(kind == "date").alias("time"),
        first(has("entity_id") & (texts | (kind == "ip"))).alias("entity"), first(has("critical_indicator")).alias("critical"),
        first(has("success_indicator")).alias("success"), first(level).alias("level"),
        first(texts & path.rlike(COMPONENT)).alias("component"),
        first(texts & F.col("dimension") & ~level & F.col("role").isNull()).alias("main_dimension"),
        first(amount).alias("amount"), first((F.col("default_agg") == "avg") & path.rlike(DURATION)).alias("duration"),
        first(kind == "text").alias("free_text"))


def free_text_fields(p: DataFrame) -> DataFrame:
    """Per table, the columns where searching by words makes sense, best first."""
    path, kind = F.col("column"), F.col("type")
    hint = F.when(kind == "text", 0)
    for i, rx in enumerate(FREE_TEXT_HINTS):
        hint = hint.when(path.rlike(rx), i + 1)
    return p.where(kind.isin("text", "string", "keyword") & ~path.rlike(NOT_TEXT)).withColumn("hint", hint) \
        .where(F.col("hint").isNotNull()) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy("hint", "dimension", "position"))) \
        .select("table", "column", "rank")


def pattern_field(p: DataFrame) -> DataFrame:
    """Per table, the column to look for templates in: free text, else one named after what happened."""
    tier = F.when(F.col("type") == "text", 0).when((F.col("type") == "string") & F.col("column").rlike(MESSAGE_HINT), 1)
    return p.withColumn("tier", tier).where(F.col("tier").isNotNull()).groupBy("table") \
        .agg(F.min_by("column", F.struct("tier", "position")).alias("pattern_field"))


def normalize_path(c: Column) -> Column:
    """``[a][b]`` and mixed spellings as ``a.b``, lower case."""
    dotted = F.regexp_replace(F.regexp_replace(F.trim(c), r"\]\.?\[?", "."), r"\[", ".")
    parts = F.filter(F.transform(F.split(dotted, r"\."), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.array_join(parts, ".")


def classify_paths(fields: DataFrame, standard: DataFrame, path: str = "column") -> DataFrame:
    """Fields left-joined to a table of standard fields (``field``, ``type``) supplied by the user."""
    spec = standard.select(F.lower("field").alias("normalized"), F.col("type").alias("standard_type"))
    return fields.withColumn("normalized", normalize_path(F.col(path))).join(spec, "normalized", "left") \
        .withColumn("is_standard", F.col("standard_type").isNotNull())


def geo_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: which columns hold latitude, longitude or a ``"lat,lon"`` pair, by name and by value."""
    checks = {}
    for n in names:
        c = F.col(f"`{n}`").cast("string")
        number = c.try_cast("double")
        checks[f"lat_{n}"] = F.avg(number.between(-90, 90).cast("int")) if _matches(n, _LAT) else F.lit(None).cast("double")
        checks[f"lon_{n}"] = F.avg(number.between(-180, 180).cast("int")) if _matches(n, _LON) else F.lit(None).cast("double")
        checks[f"pair_{n}"] = F.avg(net.geo_point_from_text(c).isNotNull().cast("int")) if _matches(n, _PAIR) else F.lit(None).cast("double")
    one = df.agg(*[c.alias(k) for k, c in checks.items()])
    pick = lambda kind: F.coalesce(*[F.when(F.col(f"`{kind}_{n}`") >= 1.0, F.lit(n)) for n in names])
    return one.select(pick("lat").alias("lat"), pick("lon").alias("lon"), pick("pair").alias("pair"))


def _matches(name: str, rx: str) -> bool:
    return bool(re.search(rx, name))


def sensitive(path: Column) -> Column:
    """Personal by the words of its last segment (a bare name or id, by the segment before it)."""
    def words(segment: Column) -> Column:
        spaced = F.regexp_replace(segment, r"(?<=[a-z0-9])(?=[A-Z])|[_\-\s]+", " ")
        return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")
    parts = F.split(path, r"\.")
    leaf, parent = words(F.element_at(parts, -1)), words(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    person, other = F.array(*map(F.lit, _PERSON)), F.array(*map(F.lit, _NOT_PERSON))
    bare = F.size(F.array_except(leaf, F.array(F.lit("name"), F.lit("nombre"), F.lit("id")))) == 0
    return ~F.arrays_overlap(leaf, other) & (F.arrays_overlap(leaf, person) | (bare & F.arrays_overlap(parent, person)))


def sensitive_values(df: DataFrame, names: list[str], share: float = 0.5) -> DataFrame:
    """Columns whose values look like e-mails, phones or document numbers, with the share that does."""
    rx = r"^[^@\s]+@[^@\s]+\.[^@\s]+$|^\+?\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}$|^\d{2}-?\d{8}-?\d$"
    hits = df.agg(*[F.avg(F.col(f"`{n}`").cast("string").rlike(rx).cast("int")).alias(n) for n in names])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("hit_rate")) for n in names]))
                       .alias("s")).select("s.*").where(F.col("hit_rate") >= share)
