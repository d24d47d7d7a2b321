"""Table operators for the shell dataflows (D01-D15), as Spark expressions.

Every function here is either a narrow expression over a column (no
shuffle: array lookups, JSON field tests, list validation, text replace,
formatting) or a grouped aggregate that Spark partially aggregates in each
task before the shuffle, so a hot key costs one partial row per task, not a
third of the table in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- D01 / D02 / D03: counting, top rows, latest row -------------------------

def first_field(line: Column | str) -> Column:
    """``awk '{print $1}'``: first whitespace-separated field, '' for a blank line."""
    return F.regexp_extract(_c(line), r"^\s*(\S+)", 1)


def count_by_desc(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """``sort | uniq -c | sort -rn``: (key, n), largest count first, ties by key."""
    return (df.groupBy(_c(key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(name)))


def top_metric(df: DataFrame, metric: str, k: int, tie_col: str) -> DataFrame:
    """k rows with the largest ``metric`` (``--sort-by=metric | head``)."""
    return df.orderBy(F.desc(metric), F.asc(tie_col)).limit(k)


def latest_row(df: DataFrame, ts: str, tie_col: str, values: Sequence[str],
               by: Sequence[str] = ()) -> DataFrame:
    """Last row by ``ts`` (ties: larger ``tie_col``), overall or per ``by`` group.

    ``max_by`` over a (ts, tie) struct is an ordinary aggregate: partial per
    task, so a group of any size never gathers in one place.
    """
    order = F.struct(F.col(ts), F.col(tie_col))
    picked = F.max_by(F.struct(*[F.col(v) for v in [ts, tie_col, *values]]), order)
    agg = df.groupBy(*by).agg(picked.alias("_last")) if by else df.agg(picked.alias("_last"))
    return agg.select(*by, "_last.*")


# --- D04 / D05: label selector, field in set -----------------------------------

def parse_selector(selector: str | Mapping[str, str]) -> dict[str, str]:
    """``app=a,component=b`` -> {'app': 'a', 'component': 'b'}."""
    if isinstance(selector, Mapping):
        return dict(selector)
    out = {}
    for part in selector.split(","):
        part = part.strip()
        if not part:
            continue
        k, sep, v = part.partition("=")
        if not sep:
            raise ValueError(f"selector term without '=': {part!r}")
        out[k.strip()] = v.strip()
    return out


def label_match(labels: Column | str, selector: str | Mapping[str, str]) -> Column:
    """True when every ``k=v`` pair of the selector is in the label map."""
    sel = parse_selector(selector)
    if not sel:
        return F.lit(True)
    m = _c(labels)
    cond = None
    for k, v in sel.items():
        term = F.coalesce(F.try_element_at(m, F.lit(k)) == F.lit(v), F.lit(False))
        cond = term if cond is None else cond & term
    return cond


def label_select(df: DataFrame, labels: Column | str, selector) -> DataFrame:
    return df.filter(label_match(labels, selector))


def phase_filter(df: DataFrame, field: str, excluded: Sequence[str],
                 keep_null: bool = False) -> DataFrame:
    """Rows whose ``field`` is not one of ``excluded``.

    A NULL field is neither in nor out of the set in SQL; it is kept only
    when ``keep_null`` is set.
    """
    out = ~F.col(field).isin(list(excluded))
    if keep_null:
        out = F.coalesce(out, F.lit(True))
    return df.filter(out)


# --- D06 / D07 / D08: arrays and JSON ------------------------------------------

def array_find(arr: Column | str, field: str, value, pick: str) -> Column:
    """``arr[?(@.field == value)].pick`` for the first matching element.

    ``get`` returns NULL for an empty match where ``[0]`` would fail under ANSI.
    """
    hit = F.filter(_c(arr), lambda x: x[field] == F.lit(value))
    return F.get(hit, 0)[pick]


def flatten_field(arr: Column | str, inner: str, pick: str | None = None) -> Column:
    """``items[*].inner[*].pick`` as one flat array, in order."""
    nested = F.transform(_c(arr), lambda x: x[inner])
    flat = F.flatten(nested)
    return F.transform(flat, lambda y: y[pick]) if pick else flat


def json_field_eq(js: Column | str, path: str, value: str) -> Column:
    """``grep '"Host":"Running"'`` made exact: the field at ``path`` equals ``value``."""
    return F.get_json_object(_c(js), path) == F.lit(value)


# --- D09: list column validation ----------------------------------------------

def list_items(s: Column | str, sep: str = ",") -> Column:
    """Split on a literal separator, trim each name, drop empty names."""
    parts = F.split(_c(s), _regex_literal(sep))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != F.lit(""))


def list_validate(df: DataFrame, s: Column | str, known: Sequence[str] | DataFrame,
                  sep: str = ",", prefix: str = "", id_col: str | None = None) -> DataFrame:
    """Add ``{prefix}items``, ``{prefix}unknown`` (names not in ``known``) and
    ``{prefix}reversed`` (stop order).

    A list of known names becomes a literal array in the expression: no
    join, no shuffle. A DataFrame of known names (first column) may be of any
    size: the items are exploded with their positions, anti-joined with it
    (AQE broadcasts the known side when its measured size is small) and
    gathered back per row by ``id_col`` (a unique row key); a row's group is
    bounded by its own list length.
    """
    if isinstance(known, DataFrame):
        return _list_validate_join(df, s, known, sep, prefix, id_col)
    items = list_items(s, sep)
    known_arr = F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>")
    return (df.withColumn(f"{prefix}items", items)
            .withColumn(f"{prefix}unknown",
                        F.filter(F.col(f"{prefix}items"),
                                 lambda x: ~F.array_contains(known_arr, x)))
            .withColumn(f"{prefix}reversed", F.reverse(F.col(f"{prefix}items"))))


def _list_validate_join(df, s, known, sep, prefix, id_col):
    if id_col is None:
        raise ValueError("a known-names DataFrame needs id_col, a unique row key")
    items_col = f"{prefix}items"
    base = df.withColumn(items_col, list_items(s, sep)) \
        .withColumn(f"{prefix}reversed", F.reverse(F.col(items_col)))
    names = known.select(F.col(known.columns[0]).alias("_name")).distinct()
    exploded = base.select(id_col, F.posexplode(items_col).alias("_pos", "_name"))
    unknown = (exploded.join(names, "_name", "left_anti")
               .groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_u"))
               .select(id_col, F.transform("_u", lambda x: x["_name"]).alias(f"{prefix}unknown")))
    return (base.join(unknown, id_col, "left")
            .withColumn(f"{prefix}unknown",
                        F.coalesce(F.col(f"{prefix}unknown"), F.array().cast("array<string>"))))


def _regex_literal(sep: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)


# --- D10 / D11: text match and replace -----------------------------------------

def text_match(text: Column | str, substring: str | None = None,
               pattern: str | None = None) -> Column:
    """``grep word`` (substring) and/or ``grep 'a.*b'`` (regex), AND-ed."""
    conds = []
    if substring is not None:
        conds.append(F.contains(_c(text), F.lit(substring)))
    if pattern is not None:
        conds.append(_c(text).rlike(pattern))
    if not conds:
        raise ValueError("give a substring or a pattern")
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def text_replace(text: Column | str, old: str, new: str, regex: bool = False) -> Column:
    """``sed 's|old|new|g'``: every occurrence, literal unless ``regex``."""
    if regex:
        return F.regexp_replace(_c(text), old, new)
    return F.replace(_c(text), F.lit(old), F.lit(new))


# --- D12 / D13 / D14: formatting ----------------------------------------------

# Name-part and ISO-8601 UTC timestamp formats.
TS_NAME_FMT = "yyyyMMdd-HHmmss"
TS_ISO_UTC_FMT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def ts_name(ts: Column | str) -> Column:
    """``date +%Y%m%d-%H%M%S`` in the session zone (UTC here)."""
    return F.date_format(_c(ts), TS_NAME_FMT)


def ts_iso_utc(ts: Column | str) -> Column:
    """``date -u +%Y-%m-%dT%H:%M:%SZ``."""
    return F.date_format(_c(ts), TS_ISO_UTC_FMT)


def unit_div(x: Column | str, divisor: int) -> Column:
    """Truncating integer division (``int(x/1024)``, ``$((x/1024))``).

    Spark's ``/`` always gives a fraction; ``div`` truncates toward zero.
    """
    return F.call_function("div", _c(x).cast("bigint"), F.lit(int(divisor)))


def json_pretty(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``jq .``: each row as indented JSON text."""
    cols = list(cols or df.columns)
    return df.select(F.to_json(F.struct(*[F.col(c) for c in cols]),
                               {"pretty": "true"}).alias("json"))


# --- D15: server log parse -----------------------------------------------------

# The server's log line prefix
#   '%t [%p]: [%l-1] user=%u,db=%d,app=%a,client=%h '
# followed by the message. %t is 'yyyy-MM-dd HH:mm:ss <zone>'.
LOG_LINE_RE = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) ([A-Za-z]+|[+-]\d{2}(?::?\d{2})?) \[(\d+)\]: \[(\d+)-1\] "
               r"user=([^,]*),db=([^,]*),app=([^,]*),client=(\S*) (.*)$")
LOG_FIELDS = (("ts", 1), ("zone", 2), ("pid", 3), ("line", 4), ("user", 5), ("db", 6),
              ("app", 7), ("client", 8), ("message", 9))


def parse_server_log(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects). The fields are the groups of one pattern, cut in one pass.

    Parsed columns: ts (wall-clock time as written, timestamp_ntz), zone (the name or
    numeric offset written after it), instant (the moment the two name; NULL where the
    zone's name is not known), pid int, line bigint, user, db, app,
    client, message (empty text -> NULL for user/db/app/client). Lines that
    do not match, hold a line feed, or an impossible date or number, go, unchanged, to ``rejects``.
    """
    # a matching line becomes its fields, one below the other, any other stays one piece
    pattern = LOG_LINE_RE.removesuffix("$") + r"\R?\z"
    cut = F.split(F.regexp_replace(col, pattern, "\n".join(f"${i}" for _, i in LOG_FIELDS)), "\n")
    fields = F.when(~F.contains(F.col(col), F.lit("\n")), cut)
    # a generator, since filters on its output stay above it: below, each use would cut the line again
    rows = lines.select("*", F.explode(F.array(fields)).alias("_fields"))
    g = {name: F.get("_fields", i - 1) for name, i in LOG_FIELDS}
    ts, pid, line = g["ts"].try_cast("timestamp_ntz"), g["pid"].try_cast("int"), g["line"].try_cast("bigint")
    # no match, no such date, or a number out of range: the line is a reject
    ok = F.coalesce((F.size("_fields") == len(LOG_FIELDS)) & ts.isNotNull() & pid.isNotNull() & line.isNotNull(), F.lit(False))
    written = F.concat_ws(" ", g["ts"], g["zone"])
    instant = F.coalesce(written.try_cast("timestamp"), F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss z")))
    parsed = rows.filter(ok).select(
        ts.alias("ts"), g["zone"].alias("zone"), instant.alias("instant"), pid.alias("pid"), line.alias("line"),
        *[F.nullif(g[n], F.lit("")).alias(n) for n in ("user", "db", "app", "client")],
        g["message"].alias("message"))
    rejects = rows.filter(~ok).drop("_fields")
    return parsed, rejects
