"""Column functions: time, normalisation, redaction, bounding, digests, classification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import jsonscan

REDACTED = "<redacted>"
PATH_REDACTED = "<absolute-path-redacted>"
#: Key names whose values are secrets, in any case.
SENSITIVE_KEYS = ("password", "secret", "token", "api_key", "apikey", "authorization", "cookie")
#: How tokens of known providers begin, and how many further letters, digits, `_` or `-` they have at least.
PROVIDER_TOKENS = {
    "ghp_": 20, "gho_": 20, "ghu_": 20, "ghs_": 20, "ghr_": 20, "github_pat_": 22, "glpat-": 20, "xoxb-": 20, "xoxp-": 20, "npm_": 30, "hf_": 30, "AKIA": 16, "ASIA": 16,
}
#: What a value may look like: quoted (the closing quote may be cut off), or a word.
_QUOTED = "\"[^\"\\\\]*(\\\\.[^\"\\\\]*)*+\"?|'[^']*'?"
_BLANK = "[ \\t\\r\\n\\f]"
#: Where a word begins. Java's `\\b` would count letters beyond ASCII as parts of the word.
_START = "(?<![A-Za-z0-9_])"


def secret_formats() -> list[str]:
    """Expressions for secrets in free text, in the order that they are replaced.

    They use what Java and Python read alike: no classes that differ. A group that repeats is possessive,
    as Java's stack would grow with it.
    """
    key_name = "[A-Z ]*PRIVATE KEY-----"
    is_ = f"[\"']?{_BLANK}*[:=]{_BLANK}*"
    word = "[^ \\t\\r\\n\\f]+"
    return [
        # a private key with all that stands up to its end; one that is cut off with the lines of base64 that follow its header
        f"-----BEGIN {key_name}[^-]*(-[^-]+)*+-----END {key_name}",
        f"-----BEGIN {key_name}({_BLANK}*[A-Za-z0-9+/=]{{24,}})*+",
        *(f"{_START}{start}[A-Za-z0-9_-]{{{least},}}" for start, least in PROVIDER_TOKENS.items()),
        # credentials of a header, with the scheme that may stand before them
        f"(?i){_START}(proxy-)?authorization{is_}[\"']?([a-z]+[ \\t]+)?{word}",
        f"(?i){_START}bearer{_BLANK}+[A-Za-z0-9_.~+/=-]{{16,}}",
        f"(?i){_START}(set-)?cookie{is_}({_QUOTED}|[^\\r\\n]+)",
        # a named value: quoted whole, else one word
        f"(?i)[\"']?(password|secret|token|api[_-]?key){is_}({_QUOTED}|{word})",
    ]


def path_formats() -> list[str]:
    """Expressions for absolute paths in free text, drive letters first. Group 1 is what stands in front of the path and stays; URLs do not match."""
    rest = "[^\\s'\"]"
    return [f"(^|[^a-zA-Z0-9])[a-zA-Z]:[/\\\\]{rest}+", f"(^|[^a-zA-Z0-9:/])/[^/\\s'\"]{rest}*"]


def secret_hints() -> list[tuple[bool, tuple[str, ...]]]:
    """For each of `secret_formats`: whether its case counts, and texts of which every match holds one. None of them can arise where a match was replaced."""
    names = ("password", "secret", "token", "apikey", "api_key", "api-key")
    return [(True, ("-----BEGIN ",))] * 2 + [(True, (start,)) for start in PROVIDER_TOKENS] + [(False, x) for x in (("authorization",), ("bearer",), ("cookie",), names)]


def let(col: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.transform(F.array(col), then)[0]


_OFFSET = "(Z|[+-][0-9]{2}:?[0-9]{2})$"


# --- time -------------------------------------------------------------------
def parse_utc(text: Column, strict: bool = False) -> Column:
    """ISO-8601 with an offset to an instant. Text without an offset is an error, never local time; lenient form: null."""
    value = F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))
    if not strict:
        return value
    return F.when(text.isNull(), F.lit(None).cast("timestamp")).otherwise(F.coalesce(value, F.raise_error(F.concat(F.lit("not an ISO instant with an offset: "), text)).cast("timestamp")))


def parse_reason(text: Column) -> Column:
    """Why `parse_utc` gives null: `naive`, `invalid`, or null if it does not."""
    return F.when(~text.rlike(_OFFSET), F.when(F.try_to_timestamp(text).isNotNull(), "naive").otherwise("invalid")).when(F.try_to_timestamp(text).isNull(), "invalid")


def to_utc(local: Column, zone: str | Column) -> Column:
    """Wall-clock time of a zone to UTC."""
    return F.to_utc_timestamp(local, zone)


def is_utc(text: Column) -> Column:
    """A zero offset; naive text is false."""
    return F.coalesce(text.rlike("(Z|[+-]00:?00)$"), F.lit(False))


def format_utc(ts: Column) -> Column:
    """U4: ISO text with Z; the fraction is printed, with six digits, only if there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def ensure_aware(df: DataFrame, cols: list[str], assume_utc: bool = False) -> DataFrame:
    """Refuse naive timestamp columns, or take them as UTC if told so."""
    naive = [c for c in cols if isinstance(df.schema[c].dataType, T.TimestampNTZType)]
    if naive and not assume_utc:
        raise ValueError(f"naive timestamps: {', '.join(naive)}")
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), "UTC") for c in naive})


def in_range(col: Column, start: Column, end: Column) -> Column:
    """The half-open range [start, end)."""
    return (col >= start) & (col < end)


def valid_range(start: Column, end: Column) -> Column:
    return F.coalesce(start < end, F.lit(False))


def range_duration(start: Column, end: Column) -> Column:
    """Seconds of [start, end), with their fraction; null for a range that is empty or turned round."""
    return F.when(valid_range(start, end), (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)


# --- normalisation -------------------------------------------------------------
def normalize_instrument(col: Column, longest: int = 32) -> Column:
    """Trimmed, upper case, ASCII letters and digits; null if it is not an id then."""
    name = F.upper(F.trim(col))
    return F.when(name.rlike(f"^[0-9A-Z]{{1,{longest}}}$"), name)


def _fold(col: Column) -> Column:
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return fold(col)


def _ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def normalize_title(col: Column) -> Column:
    """NFKC, white space collapsed, case folded. Only texts beyond ASCII go through Python."""
    folded = F.when(_ascii(col), F.lower(col)).otherwise(_fold(F.when(~_ascii(col), col)))
    return F.trim(F.regexp_replace(folded, "\\s+", " "))


@cache
def ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """What NFKD leaves of each character beyond ASCII that it leaves anything ASCII of: those with one character, and those with several."""
    one, many = {}, {}
    for code in range(0x80, 0x110000):
        told = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if told:
            (one if len(told) == 1 else many)[chr(code)] = told
    return one, many


def _ranges(chars: dict[str, str]) -> str:
    """Characters as ranges of an expression's class."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def strip_to_ascii(col: Column) -> Column:
    """The ASCII characters of a text's NFKD form. What a character leaves does not hang on those beside it, so it is told character by character."""
    one, many = ascii_forms()
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{told}" for c, told in many.items())), F.lit("\x01"), F.lit("\x02"))
    few = lambda x: F.regexp_replace(F.translate(x, "".join(one), "".join(one.values())), f"(?=[^\\x00-\\x7F])(?![{_ranges(many)}])(?s:.)", "")
    parts = lambda x: F.regexp_extract_all(x, F.lit("[\\x00-\\x7F]+|(?s:.)"), 0)
    whole = lambda x: F.array_join(F.transform(parts(x), lambda c: F.when(_ascii(c), c).otherwise(table[c])), "")
    return F.when(_ascii(col), col).otherwise(let(few(col), lambda x: F.when(_ascii(x), x).otherwise(whole(x))))


#: Characters of a text that a slug is sought in before the whole text is read.
SLUG_CHARS = 1000


def slugify(col: Column, prefix: Column | str = "", max_words: int = 12) -> Column:
    """A leading [tag] dropped, accents stripped, the first ASCII words joined by `-`; `task` if there are none. The whole text is read only if its beginning does not have one word more."""
    words = lambda x: F.regexp_extract_all(F.lower(strip_to_ascii(x)), F.lit("[0-9a-z]+"), 0)

    def first(bare: Column) -> Column:
        short = F.length(bare) <= SLUG_CHARS
        return let(words(F.substring(bare, 1, SLUG_CHARS)), lambda w: F.when(short | (F.size(w) > max_words), w).otherwise(words(bare)))

    found = let(F.regexp_replace(col, "^\\s*\\[[^\\]]+\\]\\s*", ""), first)
    slug = F.coalesce(F.nullif(F.array_join(F.slice(found, 1, max_words), "-"), F.lit("")), F.lit("task"))
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), slug)


def url_identity(col: Column) -> Column:
    """Host and path of a URL, without scheme, user, query, fragment and trailing slash or `.git`; null if there is no host."""
    bare = F.regexp_replace(F.trim(col), "^(?i)[a-z]+://([^/@]+@)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "(\\.git)?/*$", "")
    return F.when(bare.rlike("^[^/\\s]+\\.[^/\\s]+"), F.lower(bare))


def repository_identity(col: Column) -> Column:
    """`owner/name` of a repository URL, also of the form user@host:owner/name; scheme, credentials, host, `.git` and a closing slash go. Null for anything with more or fewer parts."""
    path = F.regexp_extract(F.trim(col), "^(?:[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?[^/]+/|[^/@:]+@[^/:]+:)([^?#]+?)(?:\\.git)?/*$", 1)
    return F.when(path.rlike("^[^/\\s]+/[^/\\s]+$"), path)


# --- redaction --------------------------------------------------------------
def redact_keys(df: DataFrame, keys: tuple[str, ...] = SENSITIVE_KEYS, json_cols: tuple[str, ...] = ()) -> DataFrame:
    """Everything under a sensitive key name (any case, exact) becomes `<redacted>`, at any depth of structs, arrays and maps.

    The schema is walked once, when the plan is made. A map holds one type of values, so a
    sensitive value of a map that is no text becomes null. Columns named in `json_cols` hold
    JSON text and are walked as values; text there that is no JSON is redacted as free text.
    """

    def walk(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*(field(col[f.name], f).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            hidden = F.lit(REDACTED) if isinstance(kind.valueType, T.StringType) else F.lit(None)
            return F.transform_values(col, lambda k, v: F.when(F.lower(k.cast("string")).isin(*keys), hidden).otherwise(walk(v, kind.valueType)))
        return col

    def field(col: Column, f: T.StructField) -> Column:
        if f.name.lower() in keys:
            return F.lit(REDACTED)
        return redact_json(col, keys) if f.name in json_cols else walk(col, f.dataType)

    return df.select(*(field(F.col(f"`{f.name}`"), f).alias(f.name) for f in df.schema.fields))


def redact_json(col: Column, keys: tuple[str, ...] = SENSITIVE_KEYS) -> Column:
    """R1 for JSON text of any shape, which no schema names: one pass over its tokens, so numbers and white space stay as they are written. Other strings in it, text that breaks off and text that is no JSON are redacted as free text. Python works on it in Arrow batches."""
    names, forms = frozenset(keys), secret_formats()

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        rules = [re.compile(f, re.ASCII) for f in forms]

        def plain(text: str) -> str:
            return reduce(lambda t, rule: rule.sub(REDACTED, t), rules, text)

        return texts.map(lambda t: None if t is None else jsonscan.redact(t, names, REDACTED, plain))

    return hide(col)


def _holds(col: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col, F.lit(p)) for p in parts))


def redact_text(col: Column) -> Column:
    """R2: secrets in free text. An expression runs on the texts that hold what each of its matches has."""

    def hide(c: Column, rule: tuple[str, tuple[bool, tuple[str, ...]]]) -> Column:
        form, (cased, hints) = rule
        return let(c, lambda x: F.when(_holds(x if cased else F.lower(x), *hints), F.regexp_replace(x, form, REDACTED)).otherwise(x))

    return reduce(hide, zip(secret_formats(), secret_hints(), strict=True), col)


def redact_paths(col: Column) -> Column:
    """Absolute Windows and POSIX paths; URLs stay."""
    hints = [(":/", ":\\"), ("/",)]
    return reduce(lambda c, rule: let(c, lambda x: F.when(_holds(x, *rule[1]), F.regexp_replace(x, rule[0], f"$1{PATH_REDACTED}")).otherwise(x)), zip(path_formats(), hints, strict=True), col)


def redact_url(col: Column) -> Column:
    """Scheme, host, port and path of a URL stay; user, query and fragment go. Anything else is unchanged."""
    whole = "^([A-Za-z][-+.0-9A-Za-z]*)://([^/?#]*@)?([^/?#@]+)([^?#]*).*$"
    return F.when(col.rlike(whole), F.concat(F.lower(F.regexp_extract(col, whole, 1)), F.lit("://"), F.lower(F.regexp_extract(col, whole, 3)), F.regexp_extract(col, whole, 4))).otherwise(col)


def canary_rows(df: DataFrame, canary: str) -> DataFrame:
    """Rows with the planted secret in any column, however nested; none is the proof of absence."""
    return df.where(F.instr(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))), canary) > 0)


# --- bounding ---------------------------------------------------------------
def bound_text(col: Column, limit: int = 512) -> Column:
    """B1: NUL stripped, redacted, cut to `limit - 16` characters and a marker; a text that begins as an absolute path is replaced whole, told before paths in it are redacted."""

    def cut(clean: Column) -> Column:
        return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, max(0, limit - 16)), F.lit("…<truncated>")))

    def bound(text: Column) -> Column:
        return F.when(text.rlike("^([A-Za-z]:[/\\\\]|/(?!/))"), PATH_REDACTED).otherwise(let(redact_paths(redact_text(text)), cut))

    return let(F.replace(col, F.lit("\x00"), F.lit("")), bound)


def tail_text(col: Column, limit: int = 2000) -> Column:
    """B2: the last `limit` characters, with a marker in front if any were cut."""
    return let(redact_paths(redact_text(F.trim(col))), lambda clean: F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.lit("<truncated>…"), F.right(clean, F.lit(limit)))))


def bound_list(col: Column, n: int = 50) -> Column:
    """The first n items, the true count, and whether any were cut."""
    return F.struct(F.slice(col, 1, n).alias("items"), F.size(col).alias("count"), (F.size(col) > n).alias("truncated"))


def bound_bytes(col: Column, n: int = 4096) -> Column:
    """Redacted text cut to n UTF-8 bytes, never inside a character, with the digest of the whole and a flag."""

    def cut(clean: Column) -> Column:
        head = F.rtrim(F.make_valid_utf8(F.substring(F.encode(clean, "UTF-8"), 1, n).cast("string")), F.lit("\ufffd"))
        long = F.octet_length(clean) > n
        return F.struct(F.when(long, F.concat(head, F.lit("\n<truncated>\n"))).otherwise(clean).alias("text"), long.alias("truncated"), F.sha2(clean, 256).alias("sha256"))

    return let(redact_paths(redact_text(col)), cut)


# --- digests -----------------------------------------------------------------
def _sorted_form(col: Column, kind: T.DataType) -> Column:
    """A value with the fields of its structs and the entries of its maps in order of their names, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(_sorted_form(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _sorted_form(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(col, lambda k, v: _sorted_form(v, kind.valueType))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return col


def canonical_digest(cols: list[str], schema: T.StructType | None = None) -> Column:
    """SHA-256 of the columns as one JSON object, keys sorted, nulls kept. With the schema of the rows, structs and maps in them are sorted as well; without it the columns must be flat."""
    parts = [F.col(c) if schema is None else _sorted_form(F.col(c), schema[c].dataType).alias(c) for c in sorted(cols)]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def is_digest(col: Column) -> Column:
    """40 or 64 hex digits."""
    return F.coalesce(col.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), F.lit(False))


def digest_gate(actual: Column, expected: Column) -> Column:
    """D3: nothing expected passes, as does an equal value; an absent value is unknown."""
    return F.when(expected.isNull() | actual.eqNullSafe(expected), "pass").when(actual.isNull(), "unknown").otherwise("fail")


# --- classification -------------------------------------------------------------
#: States of a check and their categories.
STATES = {
    "success": ("SUCCESS", "NEUTRAL"),
    "pending": ("PENDING", "QUEUED", "IN_PROGRESS", "EXPECTED", "WAITING"),
    "failed": ("FAILURE", "ERROR", "CANCELLED", "TIMED_OUT", "ACTION_REQUIRED"),
}


def categorize_state(*cols: Column) -> Column:
    """K1: the first non-empty of the columns, upper case, as success, pending, failed or skipped-or-unknown."""
    state = F.upper(F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit("UNKNOWN")))
    out = F.when(F.lit(False), "")
    for category, names in STATES.items():
        out = out.when(state.isin(*names), category)
    return out.otherwise("skipped-or-unknown")


#: Fixed values: (groups of phrases, category, reason, HTTP status). A rule is met by a text that has a phrase of each group, in lower case; the first rule that is met counts.
ERROR_RULES: list[tuple[list[list[str]], str, str, int | None]] = [
    ([[" 401", "bad credentials", "requires authentication"]], "authentication", "github-authentication-failure", 401),
    ([["403"], ["plan", "upgrade", "requires github pro", "requires github team", "private repositories require"]], "plan-limit", "github-plan-limit-403", 403),
    ([["403"], ["branch protection"], ["private repositories", "not available", "not included"]], "plan-limit", "github-plan-limit-403", 403),
    ([["403"], ["rate limit", "secondary rate"]], "rate-limit", "github-rate-limit-403", 403),
    ([["403"], ["resource not accessible by integration", "scope", "sso"]], "scope-or-permission", "github-scope-or-sso-403", 403),
    ([["403"]], "permission", "github-permission-403", 403),
    ([[" 429", "rate limit"]], "rate-limit", "github-rate-limit", 429),
    ([["could not resolve host", "connection refused", "operation timed out", "network", "proxyconnect"]], "network", "network-failure", None),
    ([["parse", "schema", "json"]], "schema-or-parse", "github-schema-or-parse-failure", None),
    ([[" 5"]], "service", "github-service-failure", None),
]
#: What a text that meets no rule is.
NO_RULE = ("unknown", "required-checks-query-failed", None)


def classify_error(text: Column) -> Column:
    """K2: (category, reason, http_status) of the first rule that a message meets."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def outcome(category: str, reason: str, status: int | None) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"), F.lit(status).cast("int").alias("http_status"))

    found = outcome(*NO_RULE)
    for groups, *told in reversed(ERROR_RULES):
        met = F.forall(F.array(*(F.exists(F.array(*map(F.lit, phrases)), low.contains) for phrases in groups)), lambda x: x)
        found = F.when(met, outcome(*told)).otherwise(found)
    return found


def extract_fields(text: Column, heading: str, keys: list[str]) -> Column:
    """K3: `key: value` lines of the one section under a heading, as a struct of a status and the keys.

    The section ends at the next heading. It must occur once; each key once and non-empty.
    Errors name the rule and never hold text of the body.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x))

    def section(lines: Column) -> Column:
        tail = F.slice(lines, F.greatest(F.array_position(lines, heading), F.lit(1)).cast("int") + 1, F.size(lines))
        stop = lambda t: F.array_min(F.transform(t, lambda x, i: F.when(x.rlike("^#+ "), i)))
        return let(tail, lambda t: F.slice(t, F.lit(1), F.coalesce(stop(t), F.size(t))))

    def values(section: Column, key: str) -> Column:
        own = F.filter(section, lambda x: F.lower(x).startswith(f"{key}:"))
        return F.transform(own, lambda x: F.trim(F.substr(x, F.lit(len(key) + 2))))

    def told(n: Column, v: Column) -> Column:
        any_ = lambda met: reduce(lambda a, b: a | b, (met(v[f"k{i}"]) for i in range(len(keys))))
        many, empty, missing = any_(lambda x: F.size(x) > 1), any_(lambda x: F.exists(x, lambda y: y == "")), any_(lambda x: F.size(x) == 0)
        status = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "unavailable").when(n != 1, "section-count").when(many, "duplicate").when(empty, "empty").when(missing, "missing").otherwise("ok")
        return let(status, lambda s: F.struct(s.alias("status"), *(F.when(s == "ok", F.try_element_at(v[f"k{i}"], F.lit(1))).alias(k) for i, k in enumerate(keys))))

    def read(lines: Column) -> Column:
        n = F.size(F.filter(lines, lambda x: x == heading))
        found = let(section(lines), lambda s: F.struct(*(values(s, k).alias(f"k{i}") for i, k in enumerate(keys))))
        return let(F.struct(n.alias("n"), found.alias("v")), lambda x: told(x["n"], x["v"]))

    return let(lines, read)


def summarize_log(text: Column, kind: Column, patterns: dict[str, str], failed: Column, limit: int = 240) -> Column:
    """K4: the first match of the kind's pattern (its first group, if it has one), else the last line that is not blank, else `pass`, redacted and cut to `limit`; failures keep their redacted tail."""
    summary = F.lit("")
    for name, pattern in patterns.items():
        summary = F.when(kind == name, F.regexp_extract(text, pattern, min(re.compile(pattern).groups, 1))).otherwise(summary)
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.try_element_at(lines, F.lit(-1)), F.lit("pass"))
    return F.when(failed, tail_text(text, 1200)).otherwise(bound_text(line, limit))


def find_key(json: Column, key: str) -> Column:
    """K6: the first value under a key, at any depth and in any case, in document order; an object counts by its `name`. Broken JSON is read as far as it goes. Python reads the tokens in Arrow batches."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else jsonscan.find(t, key))

    return found(json)
