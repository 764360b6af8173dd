"""Column expressions over text. All built-in Spark functions: they stay inside
whole-stage codegen (or the JVM's interpreted higher-order functions), no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# Python's str.splitlines() boundaries, as one Java regex.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\f\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
RARE_BREAKS = "[\\r\\x0b\\f\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def lit_str(s: str) -> str:
    """A SQL string literal for ``s`` (single quotes doubled, backslashes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_line(c: Column) -> Column:
    """Text up to the first ``\\n`` (the whole text when there is none)."""
    return F.substring_index(c, "\n", 1)


def count_splitlines(c: Column) -> Column:
    """``len(text.splitlines())``: drop one trailing terminator, then count pieces. A text whose
    only boundary is the line feed is counted without a pattern."""
    stripped = F.regexp_replace(c, "(?:" + LINE_BREAKS + ")\\z", "")
    feeds = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (F.when((c.isNull()) | (c == ""), F.lit(0))
            .when(c.rlike(RARE_BREAKS), F.size(F.split(stripped, LINE_BREAKS, -1)))
            .otherwise(feeds + F.when(c.endswith("\n"), F.lit(0)).otherwise(F.lit(1))))


def rstrip_ws(c: Column) -> Column:
    """``str.rstrip()``: Unicode whitespace, not only spaces."""
    return F.regexp_replace(c, "(?U)\\s+\\z", "")


def count_matches(c: Column, pattern: str) -> Column:
    """Number of non-overlapping leftmost matches of ``pattern`` in ``c`` (BIGINT)."""
    return F.size(F.regexp_extract_all(c, F.lit(pattern), 0)).cast("bigint")


def luhn_ok_sql(x: str) -> str:
    """SQL predicate: the digits of ``x`` pass the Luhn check (fold over reversed digits)."""
    d = f"reverse(regexp_replace({x}, '[^0-9]', ''))"
    digit = "cast(substr(ld, li, 1) as int)"
    return (f"element_at(transform(array({d}), ld -> aggregate(sequence(1, length(ld)), 0, (lacc, li) -> lacc + "
            f"CASE WHEN li % 2 = 0 THEN (CASE WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 "
            f"ELSE 2 * {digit} END) ELSE {digit} END) % 10 = 0), 1)")


def mod97_ok_sql(x: str) -> str:
    """SQL predicate: IBAN mod-97 check. Rotate the first four characters to the end,
    letters count as 10..35, fold ``(acc*10+d) % 97`` / ``(acc*100+v) % 97``; valid when 1."""
    s = f"upper(regexp_replace({x}, ' ', ''))"
    ch = "substr(mr, mi, 1)"
    return (f"element_at(transform(transform(array({s}), ms -> concat(substr(ms, 5), substr(ms, 1, 4))), mr -> "
            f"aggregate(sequence(1, length(mr)), cast(0 as bigint), (macc, mi) -> "
            f"CASE WHEN {ch} rlike '[0-9]' THEN (macc * 10 + cast({ch} as int)) % 97 "
            f"ELSE (macc * 100 + ascii({ch}) - 55) % 97 END) = 1), 1)")


def phone_ok_sql(x: str) -> str:
    """SQL predicate (Spark's and DuckDB's alike, but for the digits): the number behind the plus sign
    has a known calling code and as many digits as that takes."""
    d = f"regexp_replace({x}, '[^0-9]', '')"
    groups: dict[tuple, list[str]] = {}
    for code, (least, most) in P.CALLING_CODES.items():
        groups.setdefault((len(code), least, most), []).append(code)
    ok = " OR ".join(f"(substr({d}, 1, {n}) IN ({', '.join(lit_str(c) for c in codes)}) AND length({d}) BETWEEN {n + least} AND {n + most})"
                     for (n, least, most), codes in groups.items())
    return f"(({ok}) AND NOT {x} rlike {lit_str(P.PHONE_DATE)})"


def base58_ok_sql(x: str) -> str:
    """SQL predicate: a base-58 address of 25 bytes whose last four are the checksum (the first of
    the double SHA-256 of the others). The number is folded, five digits at a time (zeros go before the
    first), into nine limbs of 24 bits, smallest first."""
    digits = " + ".join(f"cast(locate(substr(bc, {k + 1}, 1), '{P.BASE58}') - 1 AS bigint) * {58 ** (4 - k)}L" for k in range(5))
    fives = f"regexp_extract_all(lpad({x}, cast((length({x}) + 4) div 5 AS int) * 5, '1'), '.{{5}}', 0)"
    limbs = (f"aggregate({fives}, array_repeat(0L, 9), (ba, bc) -> aggregate(ba, "
             f"named_struct('c', {digits}, 'out', cast(array() AS array<bigint>)), (bs, bl) -> named_struct("
             f"'c', (bl * {58 ** 5}L + bs.c) div 16777216L, 'out', concat(bs.out, array((bl * {58 ** 5}L + bs.c) % 16777216L)))).out)")
    digits = f"lower(array_join(transform(reverse({limbs}), bl -> lpad(hex(bl), 6, '0')), ''))"
    good = ("substr(bh, 1, 4) = '0000' AND substr(bh, 5, 2) IN ('00', '05') "
            "AND substr(sha2(unhex(sha2(unhex(substr(bh, 5, 42)), 256)), 256), 1, 8) = substr(bh, 47, 8) "
            f"AND 2 * length(regexp_extract({x}, '^1*', 0)) = length(regexp_extract(substr(bh, 5, 50), '^(?:00)*', 0))")
    return f"element_at(transform(array({digits}), bh -> {good}), 1)"


def _bech32_start() -> int:
    """The checksum's state after the human-readable part ``bc``."""
    state = 1
    for v in (3, 3, 0, 2, 3):
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(P.BECH32_GENERATORS):
            state ^= g if top >> k & 1 else 0
    return state


def bech32_ok_sql(x: str) -> str:
    """SQL predicate: a ``bc1`` address whose checksum polynomial comes out as its version's constant."""
    fold = "((es % 33554432L) * 32L) ^ cast(locate(ec, '" + P.BECH32 + "') - 1 AS bigint)"
    for k, g in enumerate(P.BECH32_GENERATORS):
        fold += f" ^ (CASE WHEN (es div {1 << 25 + k}L) % 2 = 1 THEN {g}L ELSE 0L END)"
    state = f"aggregate(regexp_extract_all(substr({x}, 4), '.', 0), {_bech32_start()}L, (es, ec) -> {fold})"
    return (f"(NOT substr({x}, 4) rlike '[1bio]' AND {state} = "
            f"CASE WHEN substr({x}, 4, 1) = 'q' THEN {P.BECH32_OK}L ELSE {P.BECH32M_OK}L END)")


def part_sql(hit: str, check: str) -> str:
    """SQL: the part of a match that is the entity, NULL when there is none."""
    if check == "digit":
        return f"CASE WHEN {hit} rlike '[0-9]' THEN {hit} END"
    if check == "wallet":  # 0x addresses have no checksum that SQL functions could make
        return (f"CASE WHEN startswith({hit}, '0x') THEN {hit} WHEN startswith({hit}, 'bc1') THEN CASE WHEN {bech32_ok_sql(hit)} "
                f"THEN {hit} END WHEN {base58_ok_sql(hit)} THEN {hit} END")
    ok = {"luhn": luhn_ok_sql, "mod97": mod97_ok_sql, "phone": phone_ok_sql}[check]
    shapes = {"luhn": [P.card_part(n) for n in P.CARD_DIGITS], "mod97": [P.iban_part(g) for g in P.IBAN_GAPS],
              "phone": [P.phone_part(n) for n in P.PHONE_DIGITS]}[check]
    parts = ", ".join(f"regexp_extract({hit}, {lit_str(x)}, 1)" for x in shapes)
    found = f"try_element_at(filter(array({parts}), pp -> pp <> '' AND {ok('pp')}), 1)"
    if check == "phone":
        return (f"CASE WHEN startswith({hit}, '+') THEN coalesce({found}, nullif(regexp_extract({hit}, {lit_str(P.PHONE_LOCAL)}, 1), '')) "
                f"ELSE {hit} END")
    return found


def running_sql(array: str, join: str) -> str:
    """SQL: running totals of an array by doubling steps (n log n, nothing is appended). ``join``
    makes one total of ``{a}``, that of the earlier half, and ``{b}``."""
    one = join.format(a="get(ra, ri - shiftleft(1, rk))", b="rv")
    return (f"aggregate(sequence(0, greatest(0, cast(ceil(log2(greatest(size({array}), 1))) AS int))), {array}, "
            f"(ra, rk) -> transform(ra, (rv, ri) -> CASE WHEN ri >= shiftleft(1, rk) THEN {one} ELSE rv END))")


def validated_replace_sql(col_sql: str, pattern: str, label: str, check: str) -> str:
    """SQL: replace what of the matches of ``pattern`` passes ``check``.

    ``split`` and ``regexp_extract_all`` walk the same leftmost matches, so piece i of
    the split is followed by hit i. Both arrays are computed once (bound through a
    one-element ``transform``) and rebuilt in order. Rows without any match skip the
    higher-order work via a cheap ``rlike`` guard.
    """
    pat = lit_str(pattern)
    lab = lit_str(label)
    masked = (f"element_at(transform(array({part_sql('s.h[i]', check)}), e -> CASE WHEN e IS NULL THEN s.h[i] "
              f"ELSE concat({lab}, substring(s.h[i], length(e) + 1)) END), 1)")
    return (
        f"CASE WHEN {col_sql} rlike {pat} THEN element_at(transform(array(named_struct("
        f"'p', split({col_sql}, {pat}, -1), 'h', regexp_extract_all({col_sql}, {pat}, 0))), "
        f"s -> concat(array_join(transform(slice(s.p, 1, size(s.h)), (q, i) -> concat(q, {masked})), ''), "
        f"element_at(s.p, -1))), 1) ELSE {col_sql} END")


def count_validated(col_sql: str, pattern: str, check: str) -> Column:
    """Number of matches of ``pattern`` that hold an entity (BIGINT)."""
    pat = lit_str(pattern)
    return F.expr(f"CASE WHEN {col_sql} rlike {pat} THEN size(filter(regexp_extract_all("
                  f"{col_sql}, {pat}, 0), h -> ({part_sql('h', check)}) IS NOT NULL)) ELSE 0 END").cast("bigint")
