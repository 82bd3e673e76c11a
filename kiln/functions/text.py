"""String rules of the preparation job as Catalyst expressions.

Python's ``str.strip`` and regex ``\\s`` use the Unicode whitespace set
(``str.isspace``), which is wider than Spark's ``trim`` (spaces only) and
Java's ``\\s``. The set is derived from Python itself and handed to
``trim(col, chars)``; regexes use an equivalent Java character class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python treats as whitespace (29 code points, all in the BMP).
WHITESPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())

# Java regex class for the same set, and its complement.
WS_CLASS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NON_WS_CLASS = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_col(c), F.lit(WHITESPACE))


def scrub(c) -> Column:
    """Tab and newline to space, carriage return removed, then strip.
    Null stays null."""
    x = F.replace(_col(c), F.lit("\t"), F.lit(" "))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    return strip(F.replace(x, F.lit("\r"), F.lit("")))


def clean_text(c) -> Column:
    """Free-text cleaning, in order: drop backslash-quote pairs, URLs to a
    space (case-insensitive; runs before tag removal), HTML tags (shortest
    match, not across ``\\n``) to a space, whitespace runs to one space, strip."""
    x = F.replace(F.replace(_col(c), F.lit("\\'"), F.lit("")), F.lit('\\"'), F.lit(""))
    # Exact prefilters: a URL needs "http" or "www" (the only case-fold
    # partner of these letters is their upper case), a tag needs "<".
    low = F.lower(x)
    x = F.when(low.contains("http") | low.contains("www"),
               F.regexp_replace(x, rf"(?iu)(https?://{NON_WS_CLASS}+|www\.{NON_WS_CLASS}+)", " ")).otherwise(x)
    x = F.when(x.contains("<"), F.regexp_replace(x, r"(?d)<.*?>", " ")).otherwise(x)
    x = F.regexp_replace(x, rf"{WS_CLASS}+", " ")
    return strip(x)


# --- JSON details --------------------------------------------------------------

# JSON tokens. Possessive repeats: Java matches long strings without recursion.
_JSON_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_JSON_TOKEN = _JSON_STRING + r'|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null|NaN|-?Infinity|[{}\[\],:]'
_WS = r"[ \t\n\r]*+"
_FLAT_PAIR = rf"{_JSON_STRING}{_WS}:{_WS}(?:{_JSON_STRING}|-?[1-9][0-9]*+|0){_WS}"
_FLAT_OBJECT = rf"\A{_WS}\{{{_WS}(?:{_FLAT_PAIR}(?:,{_WS}{_FLAT_PAIR})*+)?+\}}{_WS}\z"     # strings and integers only
_FRAME = "struct<o: boolean, k: array<string>, v: array<string>>"
_BACKSLASH = r"'\\'"


def _let(value: str, name: str, body: str) -> str:
    """SQL ``body`` in which ``name`` stands for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _float_text(x: str) -> str:
    """SQL: a JSON number with a fraction or an exponent as Python prints
    floats: plain between 1e-4 and 1e16, else like ``1.5e-07``."""
    exp = "cast(split_part(j, 'E', 2) as int)"
    digits = "replace(regexp_replace(split_part(replace(j, '-', ''), 'E', 1), '[.]0$', ''), '.', '')"
    sign = "if(startswith(j, '-'), '-', '')"
    big = (f"concat({sign}, substring(rpad({digits}, greatest({exp} + 1, length({digits})), '0'), 1, {exp} + 1), '.', "
           f"if(length({digits}) > {exp} + 1, substring({digits}, {exp} + 2), '0'))")
    power = (f"concat(regexp_replace(split_part(j, 'E', 1), '[.]0$', ''), if({exp} < 0, 'e-', 'e+'), "
             f"lpad(cast(abs({exp}) as string), greatest(2, length(cast(abs({exp}) as string))), '0'))")
    body = (f"CASE WHEN j = 'Infinity' THEN 'inf' WHEN j = '-Infinity' THEN '-inf' WHEN NOT contains(j, 'E') THEN j "
            f"WHEN {exp} BETWEEN 7 AND 15 THEN {big} WHEN {exp} = -4 THEN concat({sign}, '0.000', {digits}) ELSE {power} END")
    return _let(f"cast(cast({x} as double) as string)", "j", body)


def _quoted(x: str) -> str:
    """SQL: a string as Python's ``repr`` quotes it."""
    code = "lower(hex(ascii(c)))"
    special = r"r'[\p{C}\p{Z}]'"
    char = (f"CASE WHEN c = q OR c = {_BACKSLASH} THEN concat({_BACKSLASH}, c) "
            + " ".join(rf"WHEN c = '\{e}' THEN '\\{e}'" for e in "nrt")
            + f" WHEN c <> ' ' AND c rlike {special} THEN CASE "
            rf"WHEN ascii(c) < 256 THEN concat('\\x', lpad({code}, 2, '0')) "
            rf"WHEN ascii(c) < 65536 THEN concat('\\u', lpad({code}, 4, '0')) ELSE concat('\\U', lpad({code}, 8, '0')) END ELSE c END")
    listed = f"""concat(q, array_join(transform(filter(split(s, ''), c -> c <> ''), c -> {char}), ''), q)"""
    plain = rf"""NOT (contains(s, {_BACKSLASH}) OR contains(s, "'") OR replace(s, ' ', '') rlike {special})"""
    quote = """if(contains(s, "'") AND NOT contains(s, '"'), '"', "'")"""
    return _let(x, "s", f"""CASE WHEN {plain} THEN concat("'", s, "'") ELSE {_let(quote, "q", listed)} END""")


def json_object_text(d: str) -> str:
    """SQL: the JSON object in ``d`` as ``key: value | key: value``, values
    printed as Python prints decoded JSON; anything else unchanged.

    One fold over the tokens. ``st`` is what may follow (start, key, K: key or
    end, colon, value, V: value or end, e: after a value, done, x: not JSON),
    ``f`` the open containers with their keys and printed values, ``key`` the
    key read last. A container holds a null in its parent until it closes. A
    repeated key keeps its place and takes the last value."""
    ws = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"
    text = f"if(contains(t, {_BACKSLASH}), from_json(concat('[', t, ']'), 'array<string>')[0], substring(t, 2, length(t) - 2))"
    top = "element_at(a.f, -1)"

    def state(st: str, frames: str = "a.f", key: str = "a.key") -> str:
        return f"named_struct('st', {st}, 'f', {frames}, 'key', {key})"

    def put(value: str) -> str:
        """The frames with a value added to the innermost one."""
        at = "array_position(p.k, a.key)"
        new = (f"CASE WHEN NOT p.o THEN named_struct('o', false, 'k', p.k, 'v', array_append(p.v, w)) "
               f"WHEN {at} > 0 THEN named_struct('o', true, 'k', p.k, 'v', transform(p.v, (y, i) -> if(i = {at} - 1, w, y))) "
               f"ELSE named_struct('o', true, 'k', array_append(p.k, a.key), 'v', array_append(p.v, w)) END")
        return _let(top, "p", _let(value, "w", f"array_append(slice(a.f, 1, size(a.f) - 1), {new})"))

    scalar = (f"""CASE WHEN startswith(t, '"') THEN if(size(a.f) = 1, {text}, {_quoted(text)}) WHEN t = 'true' THEN 'True' WHEN t = 'false' THEN 'False' """
              f"WHEN t = 'null' THEN 'None' WHEN t = 'NaN' THEN 'nan' WHEN t = 'Infinity' THEN 'inf' WHEN t = '-Infinity' THEN '-inf' WHEN t = '-0' THEN '0' "
              f"WHEN t rlike '[.eE]' THEN {_float_text('t')} ELSE t END")
    opened = "named_struct('o', t = '{', 'k', cast(array() as array<string>), 'v', cast(array() as array<string>))"
    closed = (f"if({top}.o, concat('{{', array_join(zip_with({top}.k, {top}.v, (x, y) -> concat(x, ': ', y)), ', '), '}}'), "
              f"concat('[', array_join({top}.v, ', '), ']'))")
    fill = _let(closed, "w", "transform(slice(a.f, 1, size(a.f) - 1), (x, i) -> if(i < size(a.f) - 2, x, "
                             "named_struct('o', x.o, 'k', x.k, 'v', transform(x.v, y -> coalesce(y, w)))))")
    merge = f"""CASE
      WHEN a.st IN ('x', 'done') THEN {state("'x'")}
      WHEN a.st = 'start' THEN {state("if(t = '{', 'K', 'x')", f"array({opened})")}
      WHEN t IN ('{{', '[') THEN if(a.st IN ('value', 'V'), {state("if(t = '{', 'K', 'V')", f"array_append({put('cast(null as string)')}, {opened})")}, {state("'x'")})
      WHEN t = ':' THEN {state("if(a.st = 'colon', 'value', 'x')")}
      WHEN t = ',' THEN {state(f"CASE WHEN a.st <> 'e' THEN 'x' WHEN {top}.o THEN 'key' ELSE 'value' END")}
      WHEN t IN ('}}', ']') THEN CASE
        WHEN {top}.o <> (t = '}}') OR NOT a.st IN ('e', if(t = '}}', 'K', 'V')) THEN {state("'x'")}
        WHEN size(a.f) = 1 THEN {state("'done'")} ELSE {state("'e'", fill)} END
      WHEN a.st IN ('key', 'K') THEN if(startswith(t, '"'), {state("'colon'", "a.f", f"if(size(a.f) = 1, {text}, {_quoted(text)})")}, {state("'x'")})
      WHEN a.st IN ('value', 'V') THEN {state("'e'", put(scalar))}
      ELSE {state("'x'")} END"""
    token = f"r'{_JSON_TOKEN}'"
    fold = (f"aggregate(regexp_extract_all({d}, {token}, 0), named_struct('st', 'start', 'f', cast(array() as array<{_FRAME}>), 'key', ''), "
            f"(a, t) -> {merge})")
    entry = f"trim(BOTH {ws} FROM replace(concat(x, ': ', y), ';', ' '))"
    done = f"if(z.st = 'done', array_join(zip_with(z.f[0].k, z.f[0].v, (x, y) -> {entry}), ' | '), {d})"
    whole = rf"regexp_replace({d}, {token}, '') rlike r'\A[ \t\n\r]*\z'"
    return f"CASE WHEN {whole} THEN {_let(fold, 'z', done)} ELSE {d} END"


def details_sql(d: str) -> str:
    """SQL text of ``format_details`` over the string expression ``d``."""
    ws = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"
    # Values that are all strings or integers, no key repeated: a map will do.
    native = (f"array_join(transform(map_entries(m), e -> trim(BOTH {ws} FROM replace(concat(e.key, ': ', e.value), ';', ' '))), ' | ')")
    flat = _let(f"from_json({d}, 'map<string,string>', map('allowSingleQuotes', 'false'))", "m",
                f"if(size(array_distinct(map_keys(m))) = size(map_keys(m)), {native}, {json_object_text(d)})")
    # Text not starting with "{" (after JSON blanks) is no object.
    return (f"CASE WHEN {d} IS NULL THEN '' WHEN NOT startswith(ltrim(' \\t\\n\\r', {d}), '{{') THEN {d} "
            f"WHEN {d} rlike r'{_FLAT_OBJECT}' THEN {flat} ELSE {json_object_text(d)} END")


def format_details(c) -> Column:
    """Render a JSON object string as ``key: value | key: value`` (key order,
    ``;`` to space, each entry stripped). Anything that is not a JSON object
    is returned unchanged; null and ``''`` give ``''``.

    Objects whose values are all strings or integers (the common case) are
    rendered from ``from_json(.., map<string,string>)``; the rest (nested,
    boolean, null, float values, repeated keys) by a fold over the JSON tokens,
    ``json_object_text``. No Python runs. Floats have the digits that Java
    prints, which before Java 19 are rarely more than the shortest (5e-324).
    """
    return F.element_at(F.call_function("transform", F.array(_col(c)), F.expr(f"d -> {details_sql('d')}")), 1)


# --- Labelled text -------------------------------------------------------------

def labelled_text(parts: list[tuple[str, Column | str]]) -> Column:
    """Join ``label + value`` for every part whose value is non-null and not
    blank after strip, by newline. Values are emitted unstripped."""
    pieces = []
    for label, value in parts:
        v = _col(value).cast("string")
        pieces.append(F.when(v.isNotNull() & (strip(v) != ""), F.concat(F.lit(label), v)))
    return F.concat_ws("\n", *pieces)


PRODUCT_TEXT_PARTS = (
    ("Main category: ", "main_category"),
    ("Title: ", "title"),
    ("Features: ", "features"),
    ("Description: ", "description"),
    ("Details: ", "details"),
)


def product_text(with_details: bool = True) -> Column:
    """Five-part labelled product text (four parts without details)."""
    parts = PRODUCT_TEXT_PARTS if with_details else PRODUCT_TEXT_PARTS[:4]
    return labelled_text([(lab, F.col(c)) for lab, c in parts])
