"""JSON helpers on VARIANT, written as SQL text over a column name so they compose
inside higher-order functions (``forall`` over findings) and stay JVM-side.

Type rules follow a lax model validator: strings must be JSON strings; ints accept
integers, integral decimals/doubles, booleans and integer-looking strings; floats
accept numbers, booleans and numeric strings; bools accept booleans, 0/1 and the usual
yes/no words; a missing list defaults to empty, an explicit null list is invalid.
"""

from __future__ import annotations

from . import patterns as P

# ```json ... ``` (tag optional, any case): first fenced body.
FENCE = P.FENCE_PATTERN


def python_json_semantics(spark) -> None:
    """Duplicate object keys: keep the last value, as Python's json.loads does (Spark's
    VARIANT parser rejects the whole text by default). A session SQL conf, set by the
    operators that parse untrusted JSON."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: what ``\s`` is to the fence's pattern, as a SQL string
_BLANKS = "' \\t\\n\\u000b\\u000c\\r'"


def strip_fence_sql(x: str) -> str:
    """The first fenced body, else the text trimmed of Unicode whitespace.

    ``FENCE`` is met by searches for its back quotes and not as a pattern, which tries every
    character of a body for its end: an opening fence that no other follows means that there is none
    at all, as neither its tag nor blanks hold back quotes."""
    rest = f"substring({x}, locate('```', {x}) + 3)"
    tagged = f"element_at(transform(array({rest}), fr -> IF(lower(left(fr, 4)) = 'json', substring(fr, 5), fr)), 1)"
    body = f"rtrim({_BLANKS}, substring_index(fb, '```', 1))"
    hit = f"element_at(transform(array(ltrim({_BLANKS}, {tagged})), fb -> CASE WHEN contains(fb, '```') THEN {body} END), 1)"
    return (f"coalesce(CASE WHEN contains({x}, '```') THEN {hit} END, "
            f"regexp_replace(regexp_replace({x}, '(?U)^\\\\s+', ''), '(?U)\\\\s+\\\\z', ''))")


#: a private-use character that marks the bare numbers while they are rewritten
_MARK = "\ue000"
_BARE = r'''("(?:[^"\\]|\\[\s\S])*+")|(?<![\w.+-])(?:NaN|-?Infinity)(?!\w)'''
#: stands for a bare NaN or Infinity: a number that no contract's range takes, as theirs are none
NO_NUMBER = "-1e308"


def plain_numbers_sql(x: str) -> str:
    """``x`` with the bare words ``NaN``, ``Infinity`` and ``-Infinity`` outside strings, which Python's
    parser takes as numbers, as a number that JSON has. One pass finds strings and words; a string
    keeps itself. Texts without either word, and those that hold the mark already, stay as they are."""
    marked = f"regexp_replace({x}, {sql_str(_BARE)}, '$1{_MARK}')"
    plain = f"replace(replace({marked}, '\"{_MARK}', '\"'), '{_MARK}', '{NO_NUMBER}')"
    return f"CASE WHEN (contains({x}, 'NaN') OR contains({x}, 'Infinity')) AND NOT contains({x}, '{_MARK}') THEN {plain} ELSE {x} END"


def strict_parse_sql(x: str) -> str:
    """VARIANT of ``x`` when the text is exactly one JSON value as Python's parser takes it, else
    NULL. ``try_parse_json`` alone accepts trailing text, so the text is parsed as the first of two
    elements; the second, a digest of the text, stands there only if the text is one whole value."""
    digest = f"hex(xxhash64({x}))"
    both = f"try_parse_json(concat('[', {plain_numbers_sql(x)}, ',\"', {digest}, '\"]'))"
    return (f"element_at(transform(array({both}), pj -> CASE WHEN try_variant_get(pj, '$[1]', 'string') = {digest} "
            f"AND try_variant_get(pj, '$[2]', 'variant') IS NULL THEN try_variant_get(pj, '$[0]', 'variant') END), 1)")


def vget(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'variant')"


def vtype(v: str, path: str = "$") -> str:
    """Variant type name at ``path``; NULL when missing, 'VOID' for JSON null."""
    return f"schema_of_variant({vget(v, path)})"


def is_object(v: str, path: str = "$") -> str:
    return f"coalesce(startswith({vtype(v, path)}, 'OBJECT'), false)"


def str_val(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'string')"


_TRUE_WORDS = "('true', '1', 'yes', 'on', 't', 'y')"
_FALSE_WORDS = "('false', '0', 'no', 'off', 'f', 'n')"


# ---------------------------------------------------------------------------
# Field extraction once, checks on the extracted columns (keeps plans small).
# ---------------------------------------------------------------------------

def field_struct_sql(g: str, text_only: bool = False) -> str:
    """named_struct(t, s, d, b): type name, string, double and boolean views of a field's VARIANT
    (``text_only``: type and string only, for string and enum fields)."""
    if text_only:
        return (f"named_struct('t', schema_of_variant({g}), 's', try_variant_get({g}, '$', 'string'), "
                f"'d', CAST(NULL AS DOUBLE), 'b', CAST(NULL AS BOOLEAN))")
    return (f"named_struct('t', schema_of_variant({g}), 's', try_variant_get({g}, '$', 'string'), "
            f"'d', try_variant_get({g}, '$', 'double'), 'b', try_variant_get({g}, '$', 'boolean'))")


def f_is_str(x: str) -> str:
    return f"coalesce({x}.t = 'STRING', false)"


def _f_num(x: str) -> str:
    return f"({x}.t IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') OR startswith({x}.t, 'DECIMAL'))"


def f_is_int(x: str) -> str:
    return (f"coalesce(({x}.t IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT', 'BOOLEAN') OR "
            f"({_f_num(x)} AND {x}.d = CAST(try_cast({x}.d AS BIGINT) AS DOUBLE)) OR "
            f"({x}.t = 'STRING' AND trim({x}.s) rlike '^[+-]?[0-9]+$')) AND ({f_int(x)}) IS NOT NULL, false)")


def f_int(x: str) -> str:
    """The integer value, NULL where it fits no 64-bit number (never an error)."""
    return (f"CASE WHEN {x}.t = 'BOOLEAN' THEN CAST({x}.b AS BIGINT) WHEN {x}.t IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') "
            f"THEN try_cast({x}.s AS BIGINT) WHEN {x}.t = 'STRING' THEN try_cast(trim({x}.s) AS BIGINT) "
            f"ELSE try_cast({x}.d AS BIGINT) END")


def f_is_float(x: str) -> str:
    return (f"coalesce({_f_num(x)} OR {x}.t = 'BOOLEAN' OR "
            f"({x}.t = 'STRING' AND try_cast(trim({x}.s) AS DOUBLE) IS NOT NULL), false)")


def f_float(x: str) -> str:
    return f"CASE WHEN {x}.t = 'BOOLEAN' THEN CAST(CAST({x}.b AS INT) AS DOUBLE) ELSE {x}.d END"


def f_is_bool(x: str) -> str:
    w = f"lower(trim({x}.s))"
    return (f"coalesce({x}.t = 'BOOLEAN' OR ({x}.t = 'BIGINT' AND {x}.d IN (0, 1)) OR "
            f"({x}.t = 'STRING' AND ({w} IN {_TRUE_WORDS} OR {w} IN {_FALSE_WORDS})), false)")


def f_bool(x: str) -> str:
    w = f"lower(trim({x}.s))"
    return (f"CASE WHEN {x}.t = 'BOOLEAN' THEN {x}.b WHEN {x}.t = 'BIGINT' THEN {x}.d = 1 "
            f"WHEN {x}.t = 'STRING' THEN {w} IN {_TRUE_WORDS} END")


def py_str_sql(v: str, path: str) -> str:
    """``str()`` of the parsed value as a Python service would print it: booleans as
    True/False, JSON null as None, numbers through double; NULL when the path is missing."""
    g = vget(v, path)
    t = f"schema_of_variant({g})"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'VOID' THEN 'None' "
            f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN try_variant_get({g}, '$', 'boolean') THEN 'True' ELSE 'False' END "
            f"WHEN {t} = 'DOUBLE' OR startswith({t}, 'DECIMAL') THEN CAST(try_variant_get({g}, '$', 'double') AS STRING) "
            f"ELSE try_variant_get({g}, '$', 'string') END")
