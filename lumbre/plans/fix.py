"""FIX order logs: envelopes, tag=value decoding, session events and delays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumbre.functions.nested import pairs_to_map
from lumbre.plans.grok import capture

# Tag → (field name, type). s text, t long text, f decimal, i integer, d UTC time.
TAGS = {
    1: ("account", "s"), 6: ("avg_px", "f"), 7: ("begin_seq_no", "i"), 8: ("begin_string", "s"), 11: ("cl_ord_id", "s"),
    14: ("cum_qty", "f"), 15: ("currency", "s"), 16: ("end_seq_no", "i"), 17: ("id_ejecucion", "s"), 21: ("handl_inst", "s"),
    31: ("last_px", "f"), 32: ("last_qty", "f"), 34: ("msg_seq_num", "i"), 35: ("msg_type", "s"), 36: ("new_seq_no", "i"),
    37: ("order_id", "s"), 38: ("order_qty", "f"), 39: ("ord_status", "s"), 40: ("ord_type", "s"),
    41: ("orig_cl_ord_id", "s"), 43: ("poss_dup_flag", "s"), 44: ("price", "f"), 45: ("ref_seq_num", "i"),
    48: ("security_id", "s"), 49: ("sender_comp_id", "s"), 50: ("sender_sub_id", "s"), 52: ("sending_time", "d"),
    54: ("side", "s"), 55: ("symbol", "s"), 56: ("target_comp_id", "s"), 57: ("target_sub_id", "s"), 58: ("text", "t"),
    59: ("time_in_force", "s"), 60: ("transact_time", "d"), 63: ("settl_type", "s"), 97: ("poss_resend", "s"),
    98: ("encrypt_method", "s"), 102: ("cxl_rej_reason", "s"), 103: ("ord_rej_reason", "s"), 108: ("heart_bt_int", "i"),
    112: ("test_req_id", "s"), 122: ("orig_sending_time", "d"), 123: ("gap_fill_flag", "s"),
    141: ("reset_seq_num_flag", "s"), 150: ("tipo_ejecucion", "s"), 151: ("leaves_qty", "f"), 167: ("security_type", "s"),
    207: ("security_exchange", "s"), 371: ("ref_tag_id", "s"), 372: ("ref_msg_type", "s"),
    373: ("session_reject_reason", "s"), 380: ("business_reject_reason", "s"), 434: ("cxl_rej_response_to", "s"),
    447: ("party_id_source", "s"), 448: ("party_id", "s"), 452: ("party_role", "s"), 453: ("no_party_ids", "i"),
    461: ("cfi_code", "s"), 1128: ("appl_ver_id", "s"), 1137: ("default_appl_ver_id", "s"),
}
# Body length and checksum carry nothing.
IGNORED = (9, 10)

# Code → label of the coded tags.
_YES_NO = {"Y": "Sí", "N": "No"}
_VERSION = {"6": "FIX44", "7": "FIX50", "8": "FIX50SP1", "9": "FIX50SP2"}
LABELS = {
    35: {"0": "Heartbeat", "1": "Pedido de prueba", "2": "Pedido de reenvío", "3": "Rechazo de sesión",
         "4": "Reinicio de secuencia", "5": "Logout", "A": "Logon", "D": "Orden nueva", "F": "Pedido de cancelación",
         "G": "Pedido de modificación", "8": "Reporte de ejecución", "9": "Rechazo de cancelación",
         "j": "Rechazo de negocio", "H": "Consulta de estado de orden", "q": "Cancelación masiva",
         "r": "Reporte de cancelación masiva", "V": "Pedido de market data", "W": "Market data (completo)",
         "X": "Market data (incremental)", "Y": "Rechazo de market data", "c": "Pedido de definición de instrumento",
         "d": "Definición de instrumento", "e": "Pedido de estado de instrumento", "f": "Estado de instrumento",
         "h": "Estado de la rueda", "x": "Pedido de lista de instrumentos", "y": "Lista de instrumentos",
         "AE": "Reporte de operación", "AR": "Acuse de reporte de operación", "BE": "Pedido de usuario",
         "BF": "Respuesta de usuario"},
    39: {"0": "Nueva", "1": "Parcialmente ejecutada", "2": "Ejecutada", "3": "Terminada en el día", "4": "Cancelada",
         "5": "Reemplazada", "6": "Cancelación pendiente", "7": "Detenida", "8": "Rechazada", "9": "Suspendida",
         "A": "Alta pendiente", "B": "Calculada", "C": "Vencida", "E": "Reemplazo pendiente"},
    150: {"0": "Nueva", "1": "Ejecución parcial", "2": "Ejecución total", "3": "Terminada en el día", "4": "Cancelada",
          "5": "Reemplazada", "6": "Cancelación pendiente", "7": "Detenida", "8": "Rechazada", "9": "Suspendida",
          "A": "Alta pendiente", "B": "Calculada", "C": "Vencida", "D": "Restablecida", "E": "Reemplazo pendiente",
          "F": "Operación", "G": "Corrección de operación", "H": "Anulación de operación", "I": "Estado de la orden"},
    54: {"1": "Compra", "2": "Venta", "3": "Compra menos", "4": "Venta más", "5": "Venta en corto",
         "6": "Venta en corto exenta", "7": "No informado", "8": "Cruce", "9": "Cruce en corto"},
    40: {"1": "Mercado", "2": "Límite", "3": "Stop", "4": "Stop límite", "K": "Mercado con resto límite"},
    59: {"0": "Día", "1": "Hasta cancelar", "2": "En la apertura", "3": "Inmediata o cancelar", "4": "Todo o nada",
         "6": "Hasta la fecha", "7": "Al cierre"},
    63: {"0": "Regular", "1": "Contado inmediato", "2": "24 horas", "3": "T+2", "4": "T+3", "5": "T+4",
         "6": "Fecha futura", "7": "Cuando se emita", "8": "Vendedor elige", "9": "T+5"},
    102: {"0": "Demasiado tarde para cancelar", "1": "Orden desconocida", "2": "Opción del broker",
          "3": "Cancelación ya pendiente", "6": "ClOrdID duplicado", "99": "Otro"},
    103: {"0": "Opción del broker", "1": "Instrumento desconocido", "2": "Mercado cerrado",
          "3": "Excede el límite de la orden", "4": "Demasiado tarde", "5": "Orden desconocida", "6": "Orden duplicada",
          "8": "Orden vieja", "11": "Característica no soportada", "13": "Cantidad incorrecta", "15": "Cuenta desconocida",
          "16": "Precio fuera de rango", "18": "Precio inválido", "99": "Otro"},
    373: {"0": "Tag inválido", "1": "Falta un tag requerido", "2": "Tag no definido para el mensaje",
          "3": "Tag no definido", "4": "Tag sin valor", "5": "Valor incorrecto", "6": "Formato incorrecto",
          "9": "Problema de CompID", "10": "Problema de SendingTime", "11": "Tipo de mensaje inválido",
          "13": "Tag repetido", "99": "Otro"},
    380: {"0": "Otro", "1": "ID desconocido", "2": "Instrumento desconocido", "3": "Tipo de mensaje no soportado",
          "4": "Aplicación no disponible", "5": "Falta un campo requerido", "6": "No autorizado"},
    434: {"1": "Cancelación", "2": "Modificación"},
    167: {"CS": "Acción", "GO": "Bono soberano", "CORP": "Bono corporativo", "FUT": "Futuro", "OPT": "Opción",
          "TB": "Letra", "CD": "Certificado de depósito", "MF": "Fondo"},
    1128: _VERSION, 1137: _VERSION, 43: _YES_NO, 97: _YES_NO, 123: _YES_NO, 141: _YES_NO,
}
# Message types of the session layer, and the tag with the reason of each rejection.
SESSION_TYPES = ("0", "1", "2", "3", "4", "5", "A")
REASON_TAG = {"8": 103, "9": 102, "3": 373, "j": 380}

# Fixed values, tried in order: what a session event line says.
SESSION_EVENTS = (
    ("secuencia_alta", r"MsgSeqNum too high"), ("secuencia_baja", r"MsgSeqNum too low"),
    ("reenvio_pedido", r"Sent ResendRequest|Resending"), ("reenvio_recibido", r"Received ResendRequest"),
    ("reinicio_de_secuencia", r"SequenceReset"),
    ("heartbeat_vencido", r"[Tt]imed out waiting for heartbeat|Heartbeat timeout"),
    ("desconexion", r"Disconnect|disconnect"),
    ("logon", r"Initiated logon request|Received logon|Logon contains|[Ll]ogon response"),
    ("logout", r"[Ll]ogout"), ("rechazo", r"[Rr]eject|[Rr]echaz"),
    ("sesion", r"Created session|Session .* schedule|Session state"),
)

# The three line envelopes (regex, capture names).
ENVELOPES = {
    "slf4j": (r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]\d{3})\s+([A-Z]+)\s+\[([^\]]*)\]\s+(\S+)\s+-\s+"
              r"(?:(FIXT?\.[\d.]+:[^\s:]+->[^\s:]+):\s+)?(.*)$", ["ts", "level", "thread", "logger", "session", "payload"]),
    "filelog": (r"^(\d{8}-\d{2}:\d{2}:\d{2}(?:\.\d{3,9})?)\s*:\s+(.*)$", ["ts", "payload"]),
    "crudo": (r"^(8=FIXT?\..*)$", ["payload"]),
}
ANY_ENVELOPE = "|".join(f"(?:{rx})" for rx, _ in ENVELOPES.values())
_MESSAGE = r"(?:^|[\s:|\x01])8=FIXT?\.\d"
_FIX_TIME = r"^\d{8}-\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?$"
# An application log runs on the server's clock; the protocol's own times are UTC.
LOG_ZONE = "America/Argentina/Buenos_Aires"
_LIMIT_MS = 60_000


def has_message(c: Column) -> Column:
    return c.rlike(_MESSAGE) & c.contains("35=")


def detect(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: the envelope of 80 % of the lines, and whether a third of them carry a message."""
    line = F.regexp_replace(F.col(value), r"[\r\n]+$", "")
    kind = reduce(lambda acc, item: acc.when(line.rlike(item[1][0]), F.lit(item[0])), list(ENVELOPES.items())[1:],
                  F.when(line.rlike(ENVELOPES["slf4j"][0]), F.lit("slf4j")))
    counted = lines.where(F.trim(F.col(value)) != "").groupBy(kind.alias("kind")) \
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(has_message(line)).alias("messages"))
    total, top = F.sum("n"), F.max(F.when(F.col("kind").isNotNull(), F.col("n")))
    voted = top >= F.greatest(F.lit(1), F.floor(total * 0.8))
    name = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
    return counted.agg(F.when(voted, name).alias("envelope"),
                       F.coalesce(voted & (F.sum("messages") >= F.greatest(F.lit(1), F.floor(total / 3))), F.lit(False)).alias("is_fix"))


def fix_time(c: Column) -> Column:
    """UTC timestamp of a protocol time, milliseconds at most."""
    part = lambda at, n: F.substring(c, at, n)
    text = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(10, 12))
    return F.when(c.rlike(_FIX_TIME), text.try_cast("timestamp"))


def tag_map(payload: Column) -> Column:
    """tag → raw value; the first occurrence of a repeated tag wins."""
    # found as text: a regular expression to the end walks every character of the line
    at = F.instr(payload, "8=FIX")
    message = F.when(at > 0, F.substr(payload, at)).when(payload.isNotNull(), F.lit(""))
    part = F.lit(r"(?:^|[|\x01])(\d+)=([^|\x01]*)")
    return pairs_to_map(F.regexp_extract_all(message, part, F.lit(1)), F.regexp_extract_all(message, part, F.lit(2)), keep="first")


def label(tag: int, code: Column) -> Column:
    """The label of a coded value, the code itself when it has none."""
    table = F.create_map(*[F.lit(x) for kv in LABELS[tag].items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code)


def decode(lines: DataFrame, envelope: str, value: str = "value", zone: str = LOG_ZONE) -> DataFrame:
    """One column per known tag (``fix_<name>``), the unknown ones in ``fix_other``, and what the message implies."""
    regex, names = ENVELOPES[envelope]
    kept = [c for c in lines.columns if c != value]
    df = lines.withColumn("_g", capture(F.regexp_replace(F.col(value), r"[\r\n]+$", ""), regex, names))
    get = lambda n: F.col(f"_g.{n}") if n in names else F.lit(None).cast("string")
    payload = F.coalesce(get("payload"), F.lit(""))
    is_message = F.concat(F.lit(" "), payload).rlike(_MESSAGE)
    df = df.withColumns({"_payload": payload, "_msg": is_message, "_session": get("session"), "_logger": get("logger"),
                         "_tags": F.when(is_message, tag_map(payload))})
    raw = lambda tag: F.try_element_at(F.col("_tags"), F.lit(str(tag)))
    logged = F.try_to_timestamp(F.translate(F.translate(get("ts"), ",", "."), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    # columns of their own, so that what uses a time several times does not parse it again
    df = df.withColumns({"_received": F.to_utc_timestamp(logged, zone) if envelope == "slf4j" else fix_time(get("ts")),
                         "_sent": fix_time(raw(52)), "_made": fix_time(raw(60))})
    received, sent, made = F.col("_received"), F.col("_sent"), F.col("_made")

    fields: dict[str, Column] = {}
    for tag, (name, kind) in TAGS.items():
        text = raw(tag)
        fields[f"fix_{name}"] = {"f": text.try_cast("double"), "i": text.try_cast("bigint"), "d": fix_time(text)}.get(
            kind, label(tag, text) if tag in LABELS else text)
    known = [str(t) for t in (*TAGS, *IGNORED)]
    fields["fix_other"] = F.transform_keys(F.map_filter("_tags", lambda k, v: ~k.isin(*known)),
                                           lambda k, v: F.concat(F.lit("tag_"), k))
    code = raw(35)
    fields["fix_msg_type_code"] = code
    own = F.substring_index(F.substring_index(F.col("_session"), ":", -1), "->", 1)
    other = F.substring_index(F.substring_index(F.col("_session"), ":", -1), "->", -1)
    direction = F.when(F.col("_msg") & F.col("_session").isNotNull(),
                       F.when(raw(49) == own, F.lit("saliente")).otherwise(F.lit("entrante"))) \
        .when(F.col("_msg") & F.col("_logger").contains("incoming"), F.lit("entrante")) \
        .when(F.col("_msg") & F.col("_logger").contains("outgoing"), F.lit("saliente"))
    outgoing = direction == "saliente"
    event = F.when(~F.col("_msg") & F.col("_g").isNotNull(), F.col("_payload"))
    chain = reduce(lambda acc, item: acc.when(event.rlike(item[1]), F.lit(item[0])), SESSION_EVENTS[1:],
                   F.when(event.rlike(SESSION_EVENTS[0][1]), F.lit(SESSION_EVENTS[0][0])))
    event_kind = F.when(event.isNotNull(), chain.otherwise(F.lit("otro")))
    rejected = reduce(lambda acc, item: acc.when(code == item[0], _reason(raw, item[1])), list(REASON_TAG.items())[1:],
                      F.when((code == "8") & (raw(150) == "8"), _reason(raw, 103)))
    jump = r"(?i)expecting (\d+) but received (\d+)"
    qty, px = raw(32).try_cast("double"), raw(31).try_cast("double")
    fields.update({
        "fix_capa": F.when(event.isNotNull(), F.lit("evento")).when(
            F.col("_msg"), F.when(code.isin(*SESSION_TYPES), F.lit("sesión")).otherwise(F.lit("aplicación"))),
        "fix_sesion": F.col("_session"),
        "fix_direccion": direction,
        "fix_contraparte": F.when(event.isNotNull(), other).when(outgoing, F.coalesce(raw(56), F.lit("")))
                            .when(direction.isNotNull(), F.coalesce(raw(49), F.lit(""))),
        "fix_comp_id_propio": F.when(event.isNotNull() | (direction.isNotNull() & F.col("_session").isNotNull()), own)
                               .when(outgoing, F.coalesce(raw(49), F.lit("")))
                               .when(direction.isNotNull(), F.coalesce(raw(56), F.lit(""))),
        "fix_evento": event,
        "fix_tipo_evento": event_kind,
        "fix_rechazo_motivo": F.when(event_kind == "rechazo", F.col("_payload")).otherwise(F.nullif(rejected, F.lit(""))),
        "fix_salto_secuencia": F.when(event.rlike(jump), F.regexp_extract(event, jump, 2).try_cast("bigint")
                                      - F.regexp_extract(event, jump, 1).try_cast("bigint")),
        "fix_monto_ejecutado": F.when(qty > 0, F.round(qty * px, 2)),
    })
    fields["@timestamp"] = received
    fields["fix_demora_ms"] = _credible(sent, made)
    fields["fix_latencia_ms"] = F.when(direction == "entrante", _credible(received, sent))
    fields["log_level"], fields["log_logger"] = get("level"), get("logger")
    fields["parse_errors"] = F.array_compact(F.array(F.when(F.col("_g").isNull(), F.lit("_fix_sin_formato"))))
    fields["raw_line"] = F.when(F.size(fields["parse_errors"]) > 0, F.col(value))
    return df.select(*kept, *[c.alias(n) for n, c in fields.items()])


def _reason(raw, tag: int) -> Column:
    coded = raw(tag)
    table = F.create_map(*[F.lit(x) for kv in LABELS[tag].items() for x in kv])
    return F.coalesce(F.nullif(raw(58), F.lit("")), F.try_element_at(table, coded))


def _credible(later: Column, earlier: Column) -> Column:
    """Difference in milliseconds, NULL beyond a minute either way (clocks apart, or an old resend)."""
    ms = F.unix_millis(later) - F.unix_millis(earlier)
    return F.when(ms.between(-_LIMIT_MS, _LIMIT_MS), ms)
