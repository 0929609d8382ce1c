"""Text functions as column expressions: tokenizers, normalisation, structure inference, validators, entity patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words of the ranker's tokenizer.
RANK_STOP = "a an and are as at be by can could did do does for from has he how in is it its my of on that the to what would was were will with".split()
# Ordered rules of the query classifier.
TEMPORAL = ("when", "last week", "yesterday", "today", "changed", "history", "timeline", "before", "after", "since")
CONSTRAINT = ("rule", "constraint", "must", "never", "always", "require", "forbidden", "policy")
VERIFY = ("is it", "does it", "can we", "should we", "is there", "are there", "did we", "have we")
PREFERENCE = ("prefer", "like", "want", "style", "convention")
RELATIONAL = ("depends on", "calls", "uses", "imports", "related to", "connected", "linked")
LOOKUP = ("what", "where", "which", "who", "how many", "how much")
# Signals of the observation classifier, in order.
OBSERVATION = (
    ("preference", r"\b(don'?t|never|always|stop|instead|prefer|please)\b"),
    ("decision", r"\b(decided|decision|we('ll| will)|let'?s|going to|plan is)\b"),
    ("constraint", r"\b(must|require|rule|constraint|forbidden|mandatory|critical)\b"),
    ("fact", r"\b(using|switched to|migrated|deployed|installed|configured)\b"),
    ("event", r"\b(bug|fix|broke|crash|error|issue|problem|wrong)\b"),
    ("commitment", r"\b(todo|will do|next step|action item|need to|should)\b"),
)
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL = r"https?://[^\s<>\"]+"
PATH = r"(?:^|\s)(/[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)+)"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def rank_tokens(text: Column) -> Column:
    """Set of [a-z0-9_]+ of three characters or more without stop words."""
    stop = F.array(*[F.lit(w) for w in RANK_STOP])
    return F.array_distinct(F.filter(all_matches(F.lower(text), "[a-z0-9_]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def dedupe_tokens(text: Column) -> Column:
    """Set of [a-z0-9_]{2,}."""
    return F.array_distinct(all_matches(F.lower(text), "[a-z0-9_]{2,}"))


def recall_tokens(text: Column) -> Column:
    """List of accented words of three characters or more, without URLs, code and paths."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"```[\s\S]*?```|`[^`]+`", " "), r"[A-Za-z]:\\\S+|/[\w./-]{4,}", " ")
    return F.transform(all_matches(bare, "[A-Za-zÀ-ɏ][A-Za-z0-9À-ɏ_-]{2,}"), F.lower)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def content_key(text: Column, scope: Column, tenant: Column) -> Column:
    return F.concat(F.lit("hash-"), F.substring(F.sha2(F.concat(F.lower(F.trim(text)), F.lit("|"), scope, F.lit("|"), tenant).cast("binary"), 256), 1, 16))


def alias_key(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[\s_\-.]+", "-"), "^-+|-+$", ""), 1, 200)


def structure(text: Column) -> Column:
    """(claim_type, subject, predicate, value): address, then URL, then path, then credential words."""

    def kind(*values) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(n) for n, v in zip(("claim_type", "subject", "predicate", "value"), values, strict=True)])

    low = F.lower(text)
    return (F.when(text.rlike(IPV4), kind("infra_fact", "server", "ip_address", F.regexp_extract(text, IPV4, 0)))
            .when(text.rlike(URL), kind("infra_fact", "service", "url", F.regexp_extract(text, URL, 0)))
            .when(text.rlike(PATH), kind("filesystem_fact", None, None, None))
            .when(low.contains("credential") | low.contains("secret"), kind("security_fact", "auth", "location_hint", F.trim(text)))
            .otherwise(kind(None, None, None, None)))


def query_type(query: Column) -> Column:
    q = F.trim(F.lower(query))

    def any_of(words: tuple, test) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | test(w)
        return out

    return (F.when(any_of(TEMPORAL, q.contains), "temporal").when(any_of(CONSTRAINT, q.contains), "constraint_check").when(any_of(VERIFY, q.startswith), "verification")
            .when(any_of(PREFERENCE, q.contains), "preference").when(any_of(RELATIONAL, q.contains), "relational").when(any_of(LOOKUP, q.startswith), "fact_lookup").otherwise("open_ended"))


def observation_type(text: Column) -> Column:
    out = None
    for name, pattern in OBSERVATION:
        test = F.lower(text).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(None))


# Formats of hosts and their parts.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_WHOLE = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
HOST_LABEL = r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)"
HOST = rf"^(?=.{{1,253}}$){HOST_LABEL}(?:\.{HOST_LABEL})*$"
# Markers of a request for action, English and Spanish.
ACTION_MARKERS = ("can you", "could you", "please", "pls", "todo", "to do", "remind", "reminder", "follow up", "send", "pay", "call", "check", "verify", "quote", "budget", "recordame", "recuerdame", "mandame", "enviame", "pasame", "pagar", "llamar", "presupuesto", "cotizacion")


def action_markers(text: Column) -> Column:
    """The markers a text holds, in their order."""
    return F.filter(F.array(*[F.lit(m) for m in ACTION_MARKERS]), lambda m: F.contains(F.lower(text), m))


def is_ipv6(value: Column) -> Column:
    """Eight groups, or fewer around one '::'; the last two may be a dotted address, a zone may follow '%'."""
    bare = F.regexp_replace(value, r"%[^%/]+$", "")
    dotted = F.regexp_extract(bare, r":([^:]*\.[^:]*)$", 1)
    x = F.when(dotted == "", bare).otherwise(F.regexp_replace(bare, r"[^:]*$", "0:0"))
    group = "[0-9a-fA-F]{1,4}"
    some = rf"(?:{group}(?::{group})*)?"
    short = x.rlike(f"^{some}::{some}$") & (F.size(all_matches(x, "[0-9a-fA-F]+")) <= 7)
    return ((dotted == "") | dotted.rlike(IPV4_WHOLE)) & (x.rlike(f"^{group}(?::{group}){{7}}$") | short)


def is_cidr(value: Column) -> Column:
    """An address, with a prefix length or without; an IPv4 one may have a net mask instead."""
    address, length = F.split_part(value, F.lit("/"), F.lit(1)), F.split_part(value, F.lit("/"), F.lit(2))
    bits = F.when(length.rlike(r"^\d{1,9}$"), length.try_cast("int"))
    plain = ~F.contains(value, F.lit("/"))
    octets = F.transform(F.split(length, r"\."), lambda o: F.lpad(F.conv(o, 10, 2), 8, "0"))
    mask = length.rlike(IPV4_WHOLE) & F.array_join(octets, "").rlike("^(?:1*0*|0*1*)$")
    fits = lambda most: plain | F.coalesce(bits <= most, F.lit(False))
    one = F.length(F.regexp_replace(value, "[^/]", "")) <= 1
    return one & ((address.rlike(IPV4_WHOLE) & (fits(32) | mask)) | (is_ipv6(address) & fits(128)))


def is_url(value: Column) -> Column:
    """http or https with a host that is a name or an address."""
    place = F.regexp_extract(value, r"^(?i:https?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::[^/?#]*)?(?:[/?#]|$)", 1)
    return place.rlike(HOST) | (F.startswith(place, F.lit("[")) & is_ipv6(F.regexp_replace(place, r"^\[|\]$", "")))


def _matches(pattern: str):
    return lambda v: F.trim(v).rlike(pattern)


def _port(value: Column) -> Column:
    v = F.trim(value)
    return v.rlike(r"^\+?\d+$") & F.coalesce(v.try_cast("int").between(1, 65535), F.lit(False))


def _date(value: Column) -> Column:
    v = F.trim(value)
    return v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.year(v.try_cast("date")) >= 1970, F.lit(False))


def _hostname(value: Column) -> Column:
    v = F.regexp_replace(F.trim(value), r"\.+$", "")
    return F.contains(v, F.lit(".")) & v.rlike(HOST)


#: (predicates, test, boost, drop, an invalid value fails the claim). Fixed values. Dates are those written YYYY-MM-DD.
VALIDATORS = (
    (("ip_address",), lambda v: v.rlike(IPV4_WHOLE), 0.10, -0.35, True),
    (("ipv6", "ip_v6_address"), is_ipv6, 0.10, -0.35, True),
    (("cidr", "network_cidr"), lambda v: is_cidr(F.trim(v)), 0.08, -0.30, True),
    (("url",), is_url, 0.10, -0.35, True),
    (("email", "support_email", "contact_email"), _matches(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"), 0.08, -0.25, True),
    (("hostname", "host"), _hostname, 0.08, -0.20, True),
    (("port",), _port, 0.06, -0.25, True),
    (("deadline", "date"), _date, 0.05, -0.18, False),
    (("version", "semver"), _matches(r"^v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.\-]+)?$"), 0.05, -0.10, False),
    (("sha256", "file_hash"), _matches("^[0-9a-fA-F]{64}$"), 0.08, -0.18, True),
    (("uuid", "uuid_v4", "object_id"), _matches("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"), 0.06, -0.22, True),
    (("phone", "phone_number"), lambda v: F.regexp_replace(v, "[ -]", "").rlike(r"^\+?[1-9]\d{6,14}$"), 0.05, -0.20, True),
    (("country_code", "iso_country_code"), _matches("^[A-Za-z]{2}$"), 0.04, -0.10, False),
)
#: Boost and drop of a path; whether it exists is given, for a task sees no user's disk. Fixed values.
PATH_DELTAS = (0.12, -0.10)


def validated(predicate: Column, value: Column, path_exists: Column | None = None) -> Column:
    """(valid, delta, hard_fail) of a value under its predicate's format; null where the predicate has none or the value is empty."""

    def verdict(ok: Column, boost: float, drop: float, hard: bool) -> Column:
        return F.struct(ok.alias("valid"), F.when(ok, boost).otherwise(drop).alias("delta"), (F.lit(hard) & ~ok).alias("hard_fail"))

    out = F.when((value.isNull()) | (value == ""), F.lit(None))
    for names, test, boost, drop, hard in VALIDATORS:
        out = out.when(predicate.isin(*names), verdict(test(value), boost, drop, hard))
    return out if path_exists is None else out.when(predicate == "path", verdict(path_exists, *PATH_DELTAS, False))


def redact_private(text: Column) -> Column:
    """Private addresses and absolute Windows or UNC paths out of claim text."""
    x = F.regexp_replace(text, r"\b(10\.\d{1,3}|192\.168|172\.(1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}\b", "[REDACTED:private_ip]")
    return F.regexp_replace(x, r"[A-Za-z]:\\[^\s]+|\\\\[^\s\\]+\\[^\s]+", "[REDACTED:path]")


ENTITY_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": IPV4,
    "hex": r"\b[0-9a-f]{32,64}\b",
    "assignment": r"\b(?:token|api_key|secret)\s*[:=]\s*[^\s,;]+",
    "version": r"\b\d+\.\d+\.\d+\b",
}


def entities(text: Column) -> Column:
    """Array of (kind, surface), distinct within a text."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(all_matches(text, pattern)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("surface")))

    return F.concat(*[found(k, p) for k, p in ENTITY_PATTERNS.items()])


def closet_terms(text: Column) -> Column:
    """CamelCase names and words of five letters or more, case-insensitively distinct, in order."""
    found = F.concat(all_matches(text, "[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]+"), all_matches(text, "[A-Za-z]{5,}"))
    return F.array_distinct(F.transform(found, F.lower))
