"""Named-pattern composition: a grok expression becomes one Java regex.

The expression is expanded while the plan is built; at run time a line is
matched once and all captures come out of that single match as a struct.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lumbre.functions import net
from lumbre.functions.nested import let

# The public core pattern library, by name. ``%{NAME}`` refers to
# another entry; every inner group is non-capturing.
CORE = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]{1,64}(?:\.[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]{1,62}){0,63}",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "INT": r"(?:[+-]?(?:[0-9]+))",
    "BASE10NUM": r"(?<![0-9.+-])(?>[+-]?(?:(?:[0-9]+(?:\.[0-9]+)?)|(?:\.[0-9]+)))",
    "NUMBER": r"(?:%{BASE10NUM})",
    "BASE16NUM": r"(?<![0-9A-Fa-f])(?:[+-]?(?:0x)?(?:[0-9A-Fa-f]+))",
    "BASE16FLOAT": r"\b(?<![0-9A-Fa-f.])(?:[+-]?(?:0x)?(?:(?:[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]*)?)|(?:\.[0-9A-Fa-f]+)))\b",
    "POSINT": r"\b(?:[1-9][0-9]*)\b",
    "NONNEGINT": r"\b(?:[0-9]+)\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"(?:\"(?:\\.|[^\\\"])*\"|'(?:\\.|[^\\'])*'|`(?:\\.|[^\\`])*`)",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "URN": r"urn:[0-9A-Za-z][0-9A-Za-z-]{0,31}:(?:%[0-9a-fA-F]{2}|[0-9A-Za-z()+,.:=@;$_!*'/?#-])+",
    "CISCOMAC": r"(?:(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4})",
    "WINDOWSMAC": r"(?:(?:[A-Fa-f0-9]{2}-){5}[A-Fa-f0-9]{2})",
    "COMMONMAC": r"(?:(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2})",
    "MAC": r"(?:%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC})",
    "IPV6": net.IPV6,
    "IPV4": net.IPV4,
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*(?:\.?|\b)",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+",
    "TTY": r"(?:/dev/(?:pts|tty(?:[pq])?)(?:\w+)?/?(?:[0-9]+))",
    "WINPATH": r"(?:[A-Za-z]+:|\\)(?:\\[^\\?*]*)+",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "URIPROTO": r"[A-Za-z](?:[A-Za-z0-9+\-.]+)+",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]un(?:e)?|[Jj]ul(?:y)?"
             r"|[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)\b",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHNUM2": r"(?:0[1-9]|1[0-2])",
    "MONTHDAY": r"(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?>\d\d){1,2}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"(?:[0-5][0-9])",
    "SECOND": r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": r"(?!<[0-9])%{HOUR}:%{MINUTE}(?::%{SECOND})(?![0-9])",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))",
    "ISO8601_SECOND": r"(?:%{SECOND}|60)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "DATE": r"(?:%{DATE_US}|%{DATE_EU})",
    "DATESTAMP": r"%{DATE}[- ]%{TIME}",
    "TZ": r"(?:[APMCE][SD]T|UTC)",
    "DATESTAMP_RFC822": r"%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}",
    "DATESTAMP_RFC2822": r"%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}",
    "DATESTAMP_OTHER": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}",
    "DATESTAMP_EVENTLOG": r"%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}%{SECOND}",
    "HTTPDERROR_DATE": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{YEAR}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+",
    "PID": r"%{POSINT}",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}.%{NONNEGINT:priority}>",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo(?:rmation)?|INFO(?:RMATION)?"
                r"|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL"
                r"|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?|FINE(?:R|ST)?|CONFIG)",
    "UNIXTIME": r"\d{10}(?:\.\d+)?",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "SYSLOGBASE2": r"(?:%{SYSLOGTIMESTAMP:timestamp}|%{TIMESTAMP_ISO8601:timestamp8601}) (?:%{SYSLOGFACILITY} )?"
                   r"%{SYSLOGHOST:logsource}(?: %{SYSLOGPROG}:|)",
    "SYSLOGLINE": r"%{SYSLOGBASE2} %{GREEDYDATA:message}",
    "SYSLOGPAMSESSION": r"%{SYSLOGBASE} %{WORD:pam_module}\(%{DATA:pam_caller}\): session %{WORD:pam_session_state} for user "
                        r"%{USERNAME:username}(?: by %{GREEDYDATA:pam_by})?",
    "CRON_ACTION": r"[A-Z ]+",
    "CRONLOG": r"%{SYSLOGBASE} \(%{USER:user}\) %{CRON_ACTION:action} \(%{DATA:message}\)",
    "SYSLOG5424PRINTASCII": r"[!-~]+",
    "SYSLOG5424PRI": r"<%{NONNEGINT:syslog5424_pri}>",
    "SYSLOG5424SD": r"\[%{DATA}\]+",
    "SYSLOG5424BASE": r"%{SYSLOG5424PRI}%{NONNEGINT:syslog5424_ver} +(?:%{TIMESTAMP_ISO8601:syslog5424_ts}|-) +"
                      r"(?:%{IPORHOST:syslog5424_host}|-) +(?:-|%{SYSLOG5424PRINTASCII:syslog5424_app}) +"
                      r"(?:-|%{SYSLOG5424PRINTASCII:syslog5424_proc}) +(?:-|%{SYSLOG5424PRINTASCII:syslog5424_msgid}) +"
                      r"(?:%{SYSLOG5424SD:syslog5424_sd}|-|)",
    "SYSLOG5424LINE": r"%{SYSLOG5424BASE} +%{GREEDYDATA:syslog5424_msg}",
    "HTTPDUSER": r"(?:%{EMAILADDRESS}|%{USER})",
    "HTTPD_COMMONLOG": r"%{IPORHOST:clientip} %{HTTPDUSER:ident} %{HTTPDUSER:auth} \[%{HTTPDATE:timestamp}\] "
                       r"\"(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})\" "
                       r"(?:-|%{NUMBER:response}) (?:-|%{NUMBER:bytes})",
    "HTTPD_COMBINEDLOG": r"%{HTTPD_COMMONLOG} %{QS:referrer} %{QS:agent}",
    "COMMONAPACHELOG": r"%{HTTPD_COMMONLOG}",
    "COMBINEDAPACHELOG": r"%{HTTPD_COMBINEDLOG}",
    "HTTPD20_ERRORLOG": r"\[%{HTTPDERROR_DATE:timestamp}\] \[%{LOGLEVEL:loglevel}\] (?:\[client %{IPORHOST:clientip}\] )?"
                        r"%{GREEDYDATA:message}",
    "HTTPD24_ERRORLOG": r"\[%{HTTPDERROR_DATE:timestamp}\] \[%{WORD:module}:%{LOGLEVEL:loglevel}\] \[pid %{POSINT:pid}"
                        r"(?::tid %{NUMBER:tid})?\](?: \(%{POSINT:proxy_errorcode}\)%{DATA:proxy_message}:)?"
                        r"(?: \[client %{IPORHOST:clientip}:%{POSINT:clientport}\])?(?: %{DATA:errorcode}:)? %{GREEDYDATA:message}",
    "HTTPD_ERRORLOG": r"(?:%{HTTPD20_ERRORLOG}|%{HTTPD24_ERRORLOG})",
    "JAVACLASS": r"(?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*",
    "JAVAFILE": r"(?:[a-zA-Z$_0-9. -]+)",
    "JAVAMETHOD": r"(?:(?:<(?:cl)?init>)|[a-zA-Z$_][a-zA-Z$_0-9]*)",
    "JAVASTACKTRACEPART": r"\s*at\s+%{JAVACLASS:class}\.%{JAVAMETHOD:method}\(%{JAVAFILE:file}(?::%{INT:line})?\)",
    "JAVATHREAD": r"(?:[A-Z]{2}-Processor[\d]+)",
    "JAVALOGMESSAGE": r".*",
    "CATALINA_DATESTAMP": r"%{MONTH} %{MONTHDAY}, 20%{YEAR} %{HOUR}:?%{MINUTE}(?::?%{SECOND}) (?:AM|PM)",
    "CATALINALOG": r"%{CATALINA_DATESTAMP:timestamp} %{JAVACLASS:class} %{JAVALOGMESSAGE:logmessage}",
    "TOMCAT_DATESTAMP": r"20%{YEAR}-%{MONTHNUM}-%{MONTHDAY} %{HOUR}:?%{MINUTE}(?::?%{SECOND}) %{ISO8601_TIMEZONE}",
    "TOMCATLOG": r"%{TOMCAT_DATESTAMP:timestamp} \| %{LOGLEVEL:level} \| %{JAVACLASS:class} - %{JAVALOGMESSAGE:logmessage}",
    "RUBY_LOGLEVEL": r"(?:DEBUG|FATAL|ERROR|WARN|INFO)",
    "RUBY_LOGGER": r"[DFEWI], \[%{TIMESTAMP_ISO8601:timestamp} #%{POSINT:pid}\] *%{RUBY_LOGLEVEL:loglevel} -- +"
                   r"%{DATA:progname}: %{GREEDYDATA:message}",
}

_REFERENCE = re.compile(r"%\{(\w+)(?::([\w.\[\]@]+))?\}")
_SEPARATOR = "\x1f"


def expand(pattern: str, extra: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """(Java regex with one numbered group per named capture, capture names in order)."""
    library = {**CORE, **(extra or {})}
    names: list[str] = []

    def one(m: re.Match) -> str:
        name, field = m.group(1), m.group(2)
        if name not in library:
            raise ValueError(f"unknown pattern {name}")
        if not field:
            return f"(?:{_REFERENCE.sub(one, library[name])})"
        names.append(field)
        return f"({_REFERENCE.sub(one, library[name])})"
    return _REFERENCE.sub(one, pattern), names


def capture(c: Column, regex: str, names: list[str], fields: list[str] | None = None) -> Column:
    """Struct of captures of ``regex`` (group *i* is ``names[i]``), NULL when it does not match.

    One replacement joins all groups with a separator and one split takes them
    apart, so the line is matched once however many fields there are.
    ``fields`` names the fields of the struct when it should hold more than the captures.
    """
    head = "" if regex.startswith("^") else r"^[\s\S]*?"
    tail = "" if regex.endswith("$") else r"[\s\S]*$"
    # The input holds no separator, so one at the start tells a match from an untouched line.
    joined = F.regexp_replace(F.replace(c, F.lit(_SEPARATOR), F.lit(" ")), head + regex + tail,
                              "".join(f"{_SEPARATOR}${i + 1}" for i in range(len(names))))
    order: dict[str, list[int]] = {n: [] for n in fields or []}
    for i, n in enumerate(names):
        order.setdefault(n, []).append(i + 1)

    def struct(p: Column) -> Column:
        # A name used twice (in alternatives) takes the first group that captured something.
        return F.when(F.size(p) > 1, F.struct(*[
            (F.coalesce(*[F.nullif(F.get(p, i), F.lit("")) for i in idx]) if idx else F.lit(None).cast("string")).alias(n)
            for n, idx in order.items()]))
    return let(F.split(joined, _SEPARATOR), struct)


def grok(c: Column, patterns: str | list[str], extra: dict[str, str] | None = None) -> Column:
    """Struct of all named captures; with several patterns the first that matches wins."""
    expanded = [expand(p, extra) for p in ([patterns] if isinstance(patterns, str) else patterns)]
    every = list(dict.fromkeys(n for _, names in expanded for n in names))
    options = [capture(c, regex, names, every) for regex, names in expanded]
    return options[0] if len(options) == 1 else F.coalesce(*options)


def dissect(c: Column, mapping: str) -> Column:
    """Literal-delimiter split: ``%{a} - %{b}`` (``%{}`` skips a part)."""
    names: list[str] = []
    regex, pos = "^", 0
    marks = list(re.finditer(r"%\{([^}]*)\}", mapping))
    for i, m in enumerate(marks):
        regex += re.escape(mapping[pos:m.start()])
        pos = m.end()
        last = i == len(marks) - 1 and pos == len(mapping)
        body = r"[\s\S]*" if last else r"[\s\S]*?"
        if m.group(1):
            names.append(m.group(1))
            regex += f"({body})"
        else:
            regex += f"(?:{body})"
    return capture(c, regex + re.escape(mapping[pos:]) + "$", names)
