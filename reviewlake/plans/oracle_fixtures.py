"""DuckDB versions of the derived fixtures (F0 prs, F1 deliveries, F2 agent_outputs) and
shared SQL fragments, used by the oracle queries in ``oracle.py``."""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.fixtures import ADDED_LINES, FAILED_CALLS, FIXTURE_KEY, hmac_pads


def q(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def path_case(x: str = "doc_id") -> str:
    return (f"CASE {x} % 8 WHEN 0 THEN concat('src/mod_', {x}, '.py') WHEN 1 THEN concat('tests/test_', {x}, '.py') "
            f"WHEN 2 THEN 'package-lock.json' WHEN 3 THEN 'dist/app.min.js' WHEN 4 THEN concat('vendor/lib_', {x}, '.py') "
            f"WHEN 6 THEN concat('app_', {x}, '/requirements.txt') "
            f"ELSE concat('src/pkg/f_', {x}, '.py') END")


def added_lines(x: str = "doc_id") -> str:
    arms = " ".join(f"WHEN {x} % {m} = {r} THEN chr(10) || {q(lines)}" for m, r, lines in ADDED_LINES)
    return f"CASE {arms} ELSE '' END"


F0 = f"""
f0_f AS (SELECT doc_id, doc_id // 4 AS pr_id, text || {added_lines()} AS text, {path_case()} AS path FROM documents),
f0_p AS (SELECT *, CASE WHEN (pr_id // 2) % 2 = 0 THEN 'a/' ELSE '' END AS pa,
  CASE WHEN (pr_id // 2) % 2 = 0 THEN 'b/' ELSE '' END AS pb FROM f0_f),
f0_g AS (SELECT pr_id, doc_id, concat('diff --git ', pa, path, ' ', pb, path, chr(10), '--- /dev/null', chr(10), '+++ ', pb, path,
  chr(10), '@@ -0,0 +1,', length(text) - length(replace(text, chr(10), '')) + 1, ' @@', chr(10), '+',
  replace(text, chr(10), concat(chr(10), '+')), chr(10)) AS hunk FROM f0_p),
prs AS (SELECT pr_id, string_agg(hunk, '' ORDER BY doc_id) AS diff FROM f0_g GROUP BY pr_id
  UNION ALL SELECT CAST(-1 AS BIGINT), concat('diff --git a/big.py b/big.py', chr(10), '@@ -0,0 +1,450 @@', chr(10),
  repeat(concat('+x', chr(10)), 450))
  UNION ALL SELECT CAST(-2 AS BIGINT), '')
"""

_IPAD, _OPAD = hmac_pads(FIXTURE_KEY)

F1 = f"""
f1_b AS (SELECT event_id AS delivery_id, CASE WHEN event_id % 97 = 0 THEN '{{"action":' ELSE
  concat('{{"action":"', CASE event_type WHEN 'signup' THEN 'opened' WHEN 'click' THEN 'synchronize' ELSE 'closed' END,
  '","pull_request":{{', CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('"number":', event_id // 40, ',') END,
  '"title":', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE concat('"', event_type, ' ', event_id, '"') END,
  ',"diff_url":"https://example.invalid/', CASE WHEN event_id % 37 = 0 THEN 'none' ELSE CAST(event_id // 40 AS VARCHAR) END, '.diff"}},"repository":{{"full_name":',
  CASE WHEN event_id % 41 = 0 THEN '""' ELSE '"org/repo"' END, '}}}}') END AS raw_body FROM events),
deliveries AS (SELECT delivery_id, raw_body, CASE WHEN delivery_id % 53 = 0 THEN NULL WHEN delivery_id % 59 = 0 THEN 'sha256=bad'
  ELSE concat('sha256=', sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(raw_body))))) END
  AS signature_header FROM f1_b)
"""



def failed_calls(what: int) -> str:
    """The kind (3) or the message (4) of a failed call."""
    arms = " ".join(f"WHEN attempt <= {c[0]} AND doc_id % {c[1]} = {c[2]} THEN {'NULL' if c[what] is None else q(c[what])}" for c in FAILED_CALLS)
    return f"CASE {arms} END"


F2 = f"""
f2_d AS (SELECT doc_id, doc_id // 4 AS pr_id,
  CASE doc_id % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'architecture' WHEN 2 THEN 'testing' ELSE 'critic' END AS agent,
  {path_case()} AS path FROM documents),
f2_a AS (SELECT f2_d.*, attempt FROM f2_d, (VALUES (1), (2), (3)) AS t(attempt)),
f2_e AS (SELECT *, CASE WHEN attempt = 1 AND doc_id % 13 = 0 THEN 'maybe' WHEN doc_id % 3 = 0 THEN 'pass'
    WHEN agent IN ('architecture', 'critic') AND doc_id % 3 = 1 THEN 'warn' WHEN agent = 'testing' THEN 'warn' ELSE 'fail' END AS st,
  concat('[{{"description":"finding ', doc_id % 50, '","file_reference":"', path, '","line_number":', doc_id % 12,
    ',"confidence_score":', CASE WHEN attempt = 1 AND doc_id % 11 = 0 THEN '1.5'
    ELSE concat('0.', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')) END, '}}]') AS fnd FROM f2_a),
agent_outputs AS (SELECT pr_id, agent, CAST(attempt AS INTEGER) AS attempt,
  CASE WHEN attempt = 3 THEN 'fallback' ELSE 'primary' END AS provider,
  CAST(doc_id % 50 AS DOUBLE) AS latency_s, {failed_calls(4)} AS error, {failed_calls(3)} AS error_type,
  CASE WHEN {failed_calls(4)} IS NOT NULL THEN NULL
  WHEN attempt = 1 AND doc_id % 7 = 0 THEN 'not json'
  WHEN doc_id % 91 = 0 THEN '{{"status":' ELSE concat('```json', chr(10), CASE agent
    WHEN 'security' THEN concat('{{"status":"', st, '","severity_level":"', CASE WHEN doc_id % 8 = 0 THEN 'high' ELSE 'low' END,
      '","findings_summary":', fnd, CASE WHEN doc_id % 44 = 4 THEN ',"note":[NaN,"NaN",-Infinity]' ELSE '' END, '}}')
    WHEN 'architecture' THEN concat('{{"status":"', st, '","complexity_score":', doc_id % 10 + 1, ',"refactor_suggestions":', fnd, '}}')
    WHEN 'testing' THEN concat('{{"status":"', st, '","test_coverage_adequate":', CASE WHEN doc_id % 8 = 2 THEN 'true' ELSE 'false' END,
      ',"qa_notes":', fnd, '}}')
    ELSE concat('{{"overall_status":"', st, '","approved_findings":', fnd, ',"vetoed_count":', doc_id % 3, ',"summary":"s ', doc_id, '"}}')
    END, chr(10), '```') END AS raw_text FROM f2_e)
"""


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def hunk_path(h: str) -> str:
    """A hunk's new-side path, from its ``+++`` line, its ``rename to`` line or its header."""
    top = f"split_part({h}, chr(10) || '@@', 1)"
    rest = f"substr(rtrim({first_line(h)}, chr(13)), 12)"
    plus = f"regexp_extract({top}, '(?m)^[+][+][+] \"?([^\\t\\r\\n\"]+)', 1)"
    renamed = f"regexp_extract({top}, '(?m)^rename to \"?([^\\t\\r\\n\"]+)', 1)"
    prefixed = f"regexp_matches({rest}, '^\"?a/.* \"?b/')"
    mid = f"((length({rest}) - 1) // 2)"
    left, right = (f"trim({x}, '\"')" for x in (f"substr({rest}, 1, {mid})", f"substr({rest}, {mid} + 2)"))
    last = f"trim(regexp_extract({rest}, '([^ ]+)$', 1), '\"')"
    return (f"(CASE WHEN NOT starts_with({h}, 'diff --git ') THEN '' "
            f"WHEN {plus} NOT IN ('', '/dev/null') THEN CASE WHEN {prefixed} AND starts_with({plus}, 'b/') "
            f"THEN substr({plus}, 3) ELSE {plus} END WHEN {renamed} <> '' THEN {renamed} "
            f"WHEN {prefixed} AND substr({left}, 3) = substr({right}, 3) THEN substr({right}, 3) "
            f"WHEN {left} = {right} THEN {right} WHEN {prefixed} AND starts_with({last}, 'b/') THEN substr({last}, 3) "
            f"ELSE {last} END)")


def is_bloat(h: str) -> str:
    return f"regexp_matches({hunk_path(h)}, {q(P.BLOAT_PATH_PATTERN)})"


def hunks_of(diff: str) -> str:
    """List of hunks: split before every line starting with 'diff --git '."""
    return (f"string_split(regexp_replace({diff}, '\\ndiff --git ', chr(10) || chr(1) || 'diff --git ', 'g'), "
            f"chr(1))")


def filtered(diff: str) -> str:
    return f"array_to_string(list_filter({hunks_of(diff)}, lambda h: NOT {is_bloat('h')}), '')"


def capped(x: str) -> str:
    return (f"(CASE WHEN length({x}) > {P.MAX_DIFF_LENGTH} THEN concat(substr({x}, 1, {P.MAX_DIFF_LENGTH}), "
            f"{q(P.TRUNCATION_MARKER)}) ELSE {x} END)")


def n_matches(x: str, pat: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pat)})) AS BIGINT)"


def replace_all(x: str, pat: str, label: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(label)}, 'g')"


def luhn_ok(x: str) -> str:
    d = f"reverse(regexp_replace({x}, '[^0-9]', '', 'g'))"
    dg = f"CAST(substr({d}, li, 1) AS INTEGER)"
    return (f"(list_sum(list_transform(range(1, length({d}) + 1), lambda li: CASE WHEN li % 2 = 0 THEN "
            f"(CASE WHEN 2 * {dg} > 9 THEN 2 * {dg} - 9 ELSE 2 * {dg} END) ELSE {dg} END)) % 10 = 0)")


def mod97_ok(x: str) -> str:
    s = f"upper(replace({x}, ' ', ''))"
    r = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    vals = (f"list_transform(range(1, length({r}) + 1), lambda mi: CASE WHEN regexp_matches(substr({r}, mi, 1), '[0-9]') "
            f"THEN CAST(substr({r}, mi, 1) AS BIGINT) ELSE CAST(ascii(substr({r}, mi, 1)) - 55 AS BIGINT) END)")
    return (f"(list_reduce({vals}, lambda macc, v: CASE WHEN v < 10 THEN (macc * 10 + v) % 97 "
            f"ELSE (macc * 100 + v) % 97 END, CAST(0 AS BIGINT)) = 1)")


#: the addresses with a right checksum in the derived diffs, by the public specifications' own examples
VALID_WALLETS = ["1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]


def phone_ok(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    codes = ", ".join(f"'{code}': [{least}, {most}]" for code, (least, most) in P.CALLING_CODES.items())
    fits = " OR ".join(f"coalesce(length({d}) - {n} BETWEEN (MAP {{{codes}}})[substr({d}, 1, {n})][1] "
                       f"AND (MAP {{{codes}}})[substr({d}, 1, {n})][2], false)" for n in (1, 2, 3))
    return f"(({fits}) AND NOT regexp_matches({x}, {q(P.PHONE_DATE)}))"


def part(h: str, check: str) -> str:
    """The part of a match that is the entity, NULL when there is none."""
    if check == "digit":
        return f"(CASE WHEN regexp_matches({h}, '[0-9]') THEN {h} END)"
    if check == "wallet":
        return f"(CASE WHEN starts_with({h}, '0x') OR {h} IN ({', '.join(map(q, VALID_WALLETS))}) THEN {h} END)"
    ok = {"luhn": luhn_ok, "mod97": mod97_ok, "phone": phone_ok}[check]
    shapes = {"luhn": [P.card_part(n) for n in P.CARD_DIGITS], "mod97": [P.iban_part(g) for g in P.IBAN_GAPS],
              "phone": [P.phone_part(n) for n in P.PHONE_DIGITS]}[check]
    if check == "phone":
        parts = ", ".join(f"regexp_extract({h}, {q(x)}, 1)" for x in shapes)
        return (f"(CASE WHEN starts_with({h}, '+') THEN coalesce(list_filter([{parts}], lambda pp: pp <> '' AND {ok('pp')})[1], "
                f"nullif(regexp_extract({h}, {q(P.PHONE_LOCAL)}, 1), '')) ELSE {h} END)")
    parts = ", ".join(f"regexp_extract({h}, {q(x)}, 1)" for x in shapes)
    return f"(list_filter([{parts}], lambda pp: pp <> '' AND {ok('pp')})[1])"


def validated_replace(x: str, pat: str, label: str, check: str) -> str:
    p, h = f"string_split_regex({x}, {q(pat)})", f"regexp_extract_all({x}, {q(pat)})"
    found = part(f"{h}[vi]", check)
    return (f"(CASE WHEN regexp_matches({x}, {q(pat)}) THEN concat(array_to_string(list_transform("
            f"list_slice({p}, 1, len({h})), lambda vq, vi: concat(vq, CASE WHEN {found} IS NULL THEN {h}[vi] "
            f"ELSE concat({q(label)}, substr({h}[vi], length({found}) + 1)) END)), ''), {p}[len({p})]) ELSE {x} END)")


def count_validated(x: str, pat: str, check: str) -> str:
    return f"CAST(len(list_filter(regexp_extract_all({x}, {q(pat)}), lambda vh: {part('vh', check)} IS NOT NULL)) AS BIGINT)"


def mask_entity(x: str, name: str, pat: str) -> str:
    chk = P.VALIDATED_ENTITIES.get(name)
    if chk:
        return validated_replace(x, pat, f"<{name}>", chk)
    return replace_all(x, pat, f"<{name}>")


def count_entity(x: str, name: str, pat: str) -> str:
    chk = P.VALIDATED_ENTITIES.get(name)
    return count_validated(x, pat, chk) if chk else n_matches(x, pat)


def mask_chain_ctes(src_cte: str, key_cols: str, col: str, out_cte: str, with_counts: bool = False) -> str:
    """CTEs masking ``col`` entity by entity (priority order) -> ``out_cte(key_cols, t7, n_*)``."""
    parts, prev, prev_col, counts = [], src_cte, col, []
    for i, (name, pat) in enumerate(P.ENTITY_PATTERNS, 1):
        cnt = count_entity(prev_col, name, pat)
        cname = f"n_{name.lower()}"
        cte = f"{out_cte}_{i}" if i < len(P.ENTITY_PATTERNS) else out_cte
        keep = ", ".join([key_cols] + counts)
        parts.append(f"{cte} AS (SELECT {keep}, {cnt} AS {cname}, {mask_entity(prev_col, name, pat)} AS t{i} FROM {prev})")
        counts.append(cname)
        prev, prev_col = cte, f"t{i}"
    return ",\n".join(parts)


def mask_secrets(x: str, aws_exact: bool = False) -> str:
    """PEM, AWS key ids (look-arounds emulated with captured boundaries), secret assignments."""
    pem = replace_all(x, "(?s)" + P.PEM_PATTERN, P.PEM_LABEL)
    aws = (f"regexp_replace({pem}, '(^|[^A-Z0-9])(AKIA|AGPA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{{16}}([^A-Z0-9]|$)', "
           f"'\\1{P.AWS_KEY_LABEL}\\3', 'g')")
    return replace_all(aws, "(?s)" + P.SECRET_ASSIGN_PATTERN, P.SECRET_LABEL)
