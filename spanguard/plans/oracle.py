"""Reference SQL for the registered queries, for a second engine to check the results with.

The SQL takes other ways than the Spark plans: offsets come from running sums over the pieces around
the matches of a whole text, positions from window functions, deltas from `lag`.
"""

from __future__ import annotations

from typing import NamedTuple

from spanguard import advice, rules
from spanguard.functions import checks
from spanguard.operators import narrative
from spanguard.plans import fixtures as fx
from spanguard.plans.queries import BROKEN_REPORTS, LIMIT, SYNTHETIC


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def pick(number: str, values) -> str:
    return f"(CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END)"


def case(key: str, mapping: dict[str, str], default: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {q(default)} END)"


# --- derived inputs ------------------------------------------------------------------------------

SCAN = "((doc_id // 20) % 4)"
DOCS = f"""docs AS (SELECT source AS repo, {SCAN} AS scan_id,
  concat({pick('doc_id', fx.FOLDERS)}, 'd', doc_id::VARCHAR, {pick('doc_id', fx.EXTENSIONS)}) AS relative_path,
  {pick('doc_id', fx.EXTENSIONS)} AS extension, n_chars AS size_bytes, text FROM documents)"""
SCANS = f"""scans AS (SELECT source AS repo, {SCAN} AS scan_id, count(*) AS files_scanned FROM documents GROUP BY ALL)"""

# --- recognizers ---------------------------------------------------------------------------------


class Known(NamedTuple):
    """What the second engine knows of a recognizer: its own pattern, without look-around, and tests."""

    name: str
    entity: str
    score: float
    pattern: str
    alone: str = ""  # characters that may not stand before, or after if `after` is empty
    after: str = ""
    cues: tuple[str, ...] = ()
    cue_score: float = 0.0


_ALNUM = "[0-9A-Za-z]"
_KEY_VALUE = (r"""[A-Za-z0-9_\-]*["']?[ \t]*(?::=|=>|=|:)[ \t]*(?:"[^"\r\n]+"|'[^'\r\n]+'|"""
              r"""[^\s\x0B"'`,;(){}\[\]<>=:][^\s\x0B"'`,;(){}\[\]<>]*)""")


def _assigned(words: str) -> str:
    return rf"(?i)[A-Za-z0-9_\-]*(?:{words}){_KEY_VALUE}"


KNOWN = (
    Known("email", "EMAIL_ADDRESS", 1.0, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    Known("credit_card", "CREDIT_CARD", 1.0, r"[0-9]+(?:[ \-][0-9]+)*"),
    Known("ipv4", "IP_ADDRESS", 0.95, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "[0-9.]", "[0-9]"),
    Known("phone", "PHONE_NUMBER", 0.75,
          r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?[ .\-]?[0-9]{2,4}[ .\-]?[0-9]{2,4}(?:[.\-]?[0-9]{2,4})?"
          r"|\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}", "[0-9A-Za-z+.]", "[0-9]"),
    Known("api_key", "API_KEY", 0.8, _assigned(r"api[_\-]?key|access[_\-]?key|token|bearer")),
    Known("password", "PASSWORD", 0.8, _assigned("password|passwd|pwd")),
    Known("secret", "SECRET", 0.8, _assigned("secret|credential")),
    Known("iban", "IBAN_CODE", 1.0, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _ALNUM),
    Known("url", "URL", 0.6, r"(?:https?|ftp)://[^ \t\r\n\"'<>`()\[\]{}|\\^]*[^ \t\r\n\"'<>`()\[\]{}|\\^.,;:!?]"),
    Known("ssn", "US_SSN", 0.85, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9A-Za-z\-]", _ALNUM),
    Known("itin", "US_ITIN", 0.85, r"9[0-9]{2}-[0-9]{2}-[0-9]{4}", r"[0-9A-Za-z\-]", _ALNUM),
    Known("nhs", "UK_NHS", 0.4, r"[0-9]{3}[ \-]?[0-9]{3}[ \-]?[0-9]{4}", _ALNUM, cues=("nhs", "health", "patient"), cue_score=0.85),
    Known("dea", "MEDICAL_LICENSE", 0.6, r"[A-Za-z][A-Za-z9][0-9]{7}", _ALNUM),
    Known("aadhaar", "IN_AADHAAR", 0.6, r"[2-9][0-9]{3}[ \-]?[0-9]{4}[ \-]?[0-9]{4}", _ALNUM),
    Known("pan", "IN_PAN", 0.7, r"[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]", _ALNUM),
    Known("us_passport", "US_PASSPORT", 0.1, r"[A-Z][0-9]{8}|[0-9]{9}", _ALNUM, cues=("passport",), cue_score=0.7),
    Known("in_passport", "IN_PASSPORT", 0.1, r"[A-Z][1-9][0-9]{5}[1-9]", _ALNUM, cues=("passport",), cue_score=0.7),
    Known("us_bank", "US_BANK_NUMBER", 0.1, r"[0-9]{8,17}", _ALNUM, cues=("account", "bank", "routing"), cue_score=0.6),
    Known("us_driver", "US_DRIVER_LICENSE", 0.1, r"[A-Z][0-9]{7,12}", _ALNUM, cues=("driver", "licen"), cue_score=0.65),
    Known("crypto", "CRYPTO", 1.0, r"[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71}", _ALNUM),
    Known("date", "DATE_TIME", 0.6,
          r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", _ALNUM),
    Known("jwt", "JWT", 0.95, r"eyJ[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]{5,}){2}"),
    Known("private_key", "PRIVATE_KEY", 1.0,
          r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:(?:[^\-]|-{1,4}[^\-])*-----END [A-Z0-9 ]*PRIVATE KEY-----"
          r"|(?:(?:[ \t\r\n]|\\[nr])*[A-Za-z0-9+/]{20,}={0,2})*)"),
)
SECRETS = ("api_key", "password", "secret")

DIGITS = "list_transform(regexp_extract_all({v}, '[0-9]'), lambda c: c::INTEGER)"


def digits(value: str = "value") -> str:
    return DIGITS.format(v=value)


def luhn() -> str:
    d = digits()
    twice = f"({d}[i] * 2)"
    return (f"(list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 0 THEN {d}[i] "
            f"WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END)) % 10 = 0)")


def verhoeff() -> str:
    group, permutation = checks.verhoeff_tables()
    d = digits()
    permuted = (f"list_transform(range(0, len({d})), lambda i: ({permutation})[(i % 8) * 10 + {d}[len({d}) - i] + 1])")
    return f"(list_reduce(list_prepend(0, {permuted}), lambda c, x: ({group})[c * 10 + x + 1]) = 0)"


def weighted(value: str, weights) -> str:
    return "(" + " + ".join(f"{digits(value)}[{i + 1}] * {w}" for i, w in enumerate(weights)) + ")"


_nhs = f"(11 - {weighted('value', range(10, 1, -1))} % 11)"
_compact = "replace(value, ' ', '')"
_numbers = (f"list_transform(string_split(substr({_compact}, 5) || substr({_compact}, 1, 4), ''), "
            "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INTEGER ELSE ascii(c) - 55 END)")
_group = "substr(value, 5, 2)::INTEGER"
_slashed = "string_split(value, '/')"


def base58() -> str:
    """Base58Check with seven limbs of 32 bits, lowest first, each step unrolled."""
    base, terms, carry = 2 ** 32, [], "x[1]"
    for k in range(1, 8):
        term = f"(a[{k}] * 58 + {carry})"
        terms.append(f"{term} % {base}")
        carry = f"{term} // {base}"
    chars = (f"list_transform(string_split(value, ''), lambda c: [instr({q(checks.BASE58)}, c) - 1]::BIGINT[])")
    limbs = f"list_reduce(list_prepend([0, 0, 0, 0, 0, 0, 0]::BIGINT[], {chars}), lambda a, x: [{', '.join(terms)}]::BIGINT[])"
    hexed = f"array_to_string(list_transform(list_reverse({limbs}), lambda n: printf('%08x', n)), '')"
    payload = f"unhex(substr({hexed}, 7, 42))"
    return f"(left({hexed}, 6) = '000000' AND right({hexed}, 8) = left(sha256(unhex(sha256({payload}))), 8))"


CHECKS = {
    "crypto": base58(),
    "credit_card": f"(len({digits()}) BETWEEN 13 AND 19 AND {luhn()})",
    "ipv4": "(list_max(list_transform(string_split(value, '.'), lambda x: x::INTEGER)) <= 255)",
    "phone": f"(len({digits()}) BETWEEN 10 AND 15 AND regexp_matches(value, '^\\+|[ .()\\-]'))",
    "iban": f"(length({_compact}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {_numbers}), "
            "lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1)",
    "ssn": "(substr(value, 1, 3) NOT IN ('000', '666') AND value[1] <> '9' AND substr(value, 5, 2) <> '00' "
           "AND right(value, 4) <> '0000')",
    "itin": f"({_group} BETWEEN 50 AND 65 OR {_group} BETWEEN 70 AND 88 OR {_group} BETWEEN 90 AND 92 "
            f"OR {_group} BETWEEN 94 AND 99)",
    "nhs": f"(CASE WHEN {_nhs} = 11 THEN {digits()}[10] = 0 ELSE {digits()}[10] = {_nhs} END)",
    "dea": f"({weighted('substr(value, 3, 7)', (1, 2, 1, 2, 1, 2))} % 10 = {digits('substr(value, 3, 7)')}[7])",
    "aadhaar": verhoeff(),
    "date": f"(CASE WHEN contains(value, '/') THEN coalesce(try_cast({_slashed}[3] || '-' || lpad({_slashed}[1], 2, '0') "
            f"|| '-' || lpad({_slashed}[2], 2, '0') AS DATE), try_cast({_slashed}[3] || '-' || lpad({_slashed}[2], 2, '0') "
            f"|| '-' || lpad({_slashed}[1], 2, '0') AS DATE)) IS NOT NULL "
            "ELSE try_cast(substr(value, 1, 10) AS DATE) IS NOT NULL END)",
}


def spans_cte(source: str, recognizers=None, minimum: float = 0.5) -> str:
    """CTEs that end in `spans`, from a CTE or table `source` with the document columns."""
    chosen = [r for r in KNOWN if (recognizers is None or r.name in recognizers) and max(r.score, r.cue_score) >= minimum
              and (recognizers is not None or r.name != "crypto")]
    keys = "repo, scan_id, relative_path, extension, text"
    found = " UNION ALL ".join(
        f"SELECT {q(r.name)} AS rec, {keys}, regexp_extract_all(text, {q(r.pattern)}) AS m, "
        f"string_split_regex(text, {q(r.pattern)}) AS g FROM {source} WHERE regexp_matches(text, {q(r.pattern)})"
        for r in chosen
    )
    quotes = q('"') + ", " + q("'")
    secret = f"rec IN ({names(SECRETS)})"
    assigned = q(r"""^[^:=]*(?::=|=>|=|:)[ \t]*["']?(.*?)["']?$""")
    value = f"CASE WHEN {secret} THEN regexp_extract(mt, {assigned}, 1) ELSE mt END"
    trailing = f"CASE WHEN {secret} AND right(mt, 1) IN ({quotes}) THEN 1 ELSE 0 END"
    before, behind = "(CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END)", "substr(text, e + 1, 1)"
    free = [f"WHEN {q(r.name)} THEN NOT regexp_matches({before}, {q(r.alone)}) AND NOT regexp_matches({behind}, {q(r.after or r.alone)})"
            for r in chosen if r.alone]
    free_sql = f"CASE rec {' '.join(free)} ELSE true END" if free else "true"
    often = "(length(value) - length(replace(value, c, '')))"
    bits = (f"(CASE WHEN value = '' THEN 0 ELSE length(value) * log2(length(value)) - list_sum(list_transform(list_distinct("
            f"string_split(value, '')), lambda c: {often} * log2({often}))) END)")
    refers = q(r"^[$%]|://|^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$")
    opening = q("""[(\\[{<`"']""")
    secret_test = (
        f"(CASE WHEN {before} IN ({quotes}) AND {behind} = {before} THEN {bits} >= 10 ELSE regexp_matches(value, '[0-9]') AND "
        f"regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, {refers}) "
        f"AND NOT regexp_matches({behind}, {opening}) AND {bits} >= 24 END)")
    checked = [f"WHEN {q(r.name)} THEN {CHECKS[r.name]}" for r in chosen if r.name in CHECKS and r.name != "credit_card"]
    checked += [f"WHEN {q(r.name)} THEN {secret_test}" for r in chosen if r.name in SECRETS]
    check_sql = f"CASE rec {' '.join(checked)} ELSE true END" if checked else "true"
    score = "CASE rec " + " ".join(
        f"WHEN {q(r.name)} THEN " + (
            f"(CASE WHEN {' OR '.join(f'contains(lower(win), {q(c)})' for c in r.cues)} THEN {r.cue_score} ELSE {r.score} END)"
            if r.cues else str(r.score)) for r in chosen) + " END"
    entity = "CASE rec " + " ".join(f"WHEN {q(r.name)} THEN {q(r.entity)}" for r in chosen) + " END"
    return f"""found AS ({found}),
    numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
    placed AS (SELECT rec, {keys}, m[i] AS mt,
      (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]))::BIGINT AS stop FROM numbered),
    runs AS (SELECT row_number() OVER () AS run, {keys}, mt, stop - length(mt) AS base, string_split_regex(mt, '[ \\-]') AS gr
      FROM placed WHERE rec = 'credit_card' AND length(mt) >= 13),
    windows AS (SELECT run, i, n, array_to_string(gr[i:i + n - 1], '') AS value,
      array_to_string(list_transform(gr[i:i + n - 1], lambda x: length(x)), ',') AS shape,
      coalesce(list_sum(list_transform(gr[1:i - 1], lambda x: length(x) + 1)), 0) AS lead,
      list_sum(list_transform(gr[i:i + n - 1], lambda x: length(x) + 1)) - 1 AS width
      FROM (SELECT run, gr, unnest(range(1, len(gr) + 1)) AS i FROM runs), (VALUES (4), (3), (1)) AS o(n)),
    cards AS (SELECT * FROM windows WHERE CASE n WHEN 4 THEN regexp_matches(shape, '^4,4,4,[1-7]$') WHEN 3 THEN shape = '4,6,5'
      ELSE regexp_matches(shape, '^1[3-9]$') END AND {luhn()}),
    chosen AS (
      SELECT run, min(i) AS i, min_by(n, i) AS n, min_by(lead, i) AS lead, min_by(width, i) AS width FROM cards GROUP BY run
      UNION ALL
      SELECT c.run, min(w.i), min_by(w.n, w.i), min_by(w.lead, w.i), min_by(w.width, w.i)
      FROM chosen c JOIN cards w ON w.run = c.run AND w.i >= c.i + c.n GROUP BY c.run),
    valued AS (SELECT rec, {keys}, {value} AS value, stop - {trailing} AS e FROM placed WHERE rec <> 'credit_card'
      UNION ALL SELECT 'credit_card', {keys}, substr(mt, (lead + 1)::BIGINT, width::BIGINT), (base + lead + width)::BIGINT
      FROM chosen JOIN runs USING (run)),
    edged AS (SELECT *, e - length(value) AS s FROM valued),
    tested AS (SELECT * FROM edged WHERE {free_sql} AND {check_sql}),
    seen AS (SELECT *, substr(text, greatest(s - 120, 0) + 1, least(e + 120, length(text)) - greatest(s - 120, 0)) AS win,
      substr(text, 1, s) AS head, substr(text, e + 1) AS tail FROM tested),
    spans AS (SELECT * FROM (SELECT repo, scan_id, relative_path, extension, s::INTEGER AS "start", e::INTEGER AS "end",
      {entity} AS entity_type, ({score})::DOUBLE AS score, value,
      (length(head) - length(replace(head, chr(10), '')) + 1)::INTEGER AS line_number, win,
      string_split(head, chr(10))[-1] || value || string_split(tail, chr(10))[1] AS line FROM seen) WHERE score >= {minimum})"""


# --- validation ----------------------------------------------------------------------------------

def cue(cues, column: str = "win") -> str:
    return f"regexp_matches({column}, {q(rules.cue_regex(cues))})"


HOST = (r"lower(regexp_replace(regexp_replace(regexp_extract(value, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), "
        r"'^.*@', ''), ':.*$', ''))")
_stem = r"lower(regexp_extract(string_split(relative_path, '/')[-1], '^(.+?)(?:\.[^.]+)?$', 1))"
_parts = "string_split(lower(relative_path), '/')"


def overlap(values) -> str:
    return f"list_has_any({_parts}, [{names(values)}])"


DOCUMENTATION = (f"(lower(extension) IN ({names(rules.DOCUMENTATION_EXTENSIONS)}) OR {_stem} IN "
                 f"({names(rules.DOCUMENTATION_STEMS)}) OR {overlap(rules.DOCUMENTATION_PARTS)})")
TEST = overlap(rules.TEST_PARTS)
CODE = (f"(lower(extension) IN ({names(rules.CODE_EXTENSIONS)}) AND (contains(relative_path, value) OR contains(line, '`') "
        r"OR regexp_matches(line, '(?i)[a-z_][a-z0-9_]*\s*[:=]|(?:def|class|import|from|function|const|let|var)\s')))")
CREDIT = f"({cue(rules.CREDIT_CUES)} OR regexp_matches(line, '(?:^|\\s)@[-A-Za-z0-9_]'))"
SENSITIVE = "(" + " OR ".join(cue(c) for c in (
    rules.PERSON_CUES, rules.ORGANIZATION_CUES, rules.LOCATION_CUES, rules.DATE_CUES)) + ")"
URL_SECRET = (f"regexp_matches(value, '(?i)[?&](?:{'|'.join(rules.SECRET_QUERY_KEYS)})=|//[^/\\s:@]+:[^/\\s@]+@')")
PUBLIC = f"(list_bool_or(list_transform([{names(rules.PUBLIC_HOSTS)}], lambda h: {HOST} = h OR ends_with({HOST}, '.' || h))))"
_identifier = (r"(regexp_matches(value, '[_./\\{}()\[\]<>:=]') OR (length(value) > 1 AND regexp_matches(value, '\p{Lu}') "
               r"AND NOT regexp_matches(value, '\p{Ll}')) OR regexp_matches(value, '^[a-z]+[A-Z][A-Za-z0-9]*$') "
               r"OR regexp_matches(value, '^[A-Z][A-Za-z0-9]+(?:[A-Z][a-z0-9]+)+$'))")
KEEP_URL = (f"(CASE WHEN {URL_SECRET} THEN true WHEN {HOST} = '' THEN false WHEN {HOST} IN ({names(rules.LOOPBACK_HOSTS)}) "
            f"THEN false WHEN " + " OR ".join(f"ends_with({HOST}, {q(s)})" for s in rules.PRIVATE_SUFFIXES)
            + f" THEN true WHEN {PUBLIC} THEN false WHEN {DOCUMENTATION} THEN false ELSE {SENSITIVE} END)")
KEEP_LANGUAGE = (
    f"(CASE WHEN trim(value) = '' OR {_identifier} THEN false WHEN lower(trim(value)) IN ({names(rules.TECHNOLOGY_TERMS)}) "
    f"THEN false WHEN {DOCUMENTATION} AND NOT {SENSITIVE} THEN false WHEN {CREDIT} THEN false "
    f"WHEN {CODE} AND NOT {SENSITIVE} THEN false WHEN {TEST} AND NOT {SENSITIVE} THEN false "
    f"WHEN entity_type = 'PERSON' THEN {cue(rules.PERSON_CUES)} WHEN entity_type = 'ORGANIZATION' THEN "
    f"{cue(rules.ORGANIZATION_CUES)} WHEN entity_type = 'LOCATION' THEN {cue(rules.LOCATION_CUES)} ELSE {SENSITIVE} END)")
KEEP = (f"(CASE WHEN entity_type IN ({names(rules.HIGH_SIGNAL_ENTITIES)}) THEN true WHEN entity_type = 'URL' THEN {KEEP_URL} "
        f"WHEN entity_type = 'DATE_TIME' THEN {cue(rules.DATE_CUES)} WHEN entity_type IN ({names(rules.LANGUAGE_ENTITIES)}) "
        f"THEN {KEEP_LANGUAGE} ELSE true END)")

# --- findings and aggregates ---------------------------------------------------------------------

SEVERITY = case("entity_type", {e.entity_type: e.severity for e in rules.ENTITIES}, rules.DEFAULT_SEVERITY)
CATEGORY = case("entity_type", {e.entity_type: e.category for e in rules.ENTITIES}, rules.DEFAULT_CATEGORY)
MASK = ("(CASE WHEN entity_type = 'EMAIL_ADDRESS' AND contains(value, '@') THEN left(string_split(value, '@')[1], 2) || '***@' "
        "|| substr(value, instr(value, '@') + 1) WHEN length(value) <= 4 THEN repeat('*', length(value)) "
        "ELSE repeat('*', length(value) - 4) || right(value, 4) END)")
_key_parts = "string_split(file, '/')"
PATH_KEY = (f"array_to_string(list_transform({_key_parts}, lambda x, i: (CASE WHEN i < len({_key_parts}) THEN '1' ELSE '0' END) "
            "|| x), chr(1))")
SEVERITY_ORDER = "(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END)"
FINDINGS = f"""{DOCS}, {SCANS}, {spans_cte('docs')},
    labelled AS (SELECT repo, scan_id, relative_path AS file, line_number, entity_type, score AS confidence_score,
      {SEVERITY} AS severity, {CATEGORY} AS category, {MASK} AS matched_value, "start", "end" FROM spans WHERE {KEEP}),
    f AS (SELECT *, (row_number() OVER (PARTITION BY repo, scan_id ORDER BY {PATH_KEY}, confidence_score DESC, "start",
      "end", entity_type, matched_value) - 1)::BIGINT AS finding_index FROM labelled),
    findings AS (SELECT *, 'F-' || CASE WHEN finding_index < 1000000 THEN lpad(finding_index::VARCHAR, 6, '0')
      ELSE finding_index::VARCHAR END AS finding_id FROM f)"""


def _category_column(category: str) -> str:
    return category.lower().replace(" ", "_")


_score = " + ".join(f"{s.lower()} * {w}" for s, w in rules.SEVERITY_WEIGHTS.items())
PROFILE = f"""{FINDINGS},
    counts AS (SELECT s.repo, s.scan_id, s.files_scanned,
      {', '.join(f"count(*) FILTER (severity = {q(x)}) AS {x.lower()}" for x in rules.SEVERITIES)},
      {', '.join(f"count(*) FILTER (category = {q(c)}) AS {_category_column(c)}" for c in rules.CATEGORIES)},
      count(file) AS total_findings FROM scans s LEFT JOIN findings USING (repo, scan_id) GROUP BY ALL),
    scored AS (SELECT *, ({_score})::BIGINT AS risk_score FROM counts),
    profile AS (SELECT *, CASE WHEN critical > 0 OR risk_score >= 50 THEN 'FAIL' WHEN risk_score >= 20 THEN 'WARNING'
      ELSE 'PASS' END AS pipeline_status, 20::BIGINT AS warning_threshold, 50::BIGINT AS fail_threshold FROM scored)"""
_categories = ", ".join(_category_column(c) for c in rules.CATEGORIES)
_long = " UNION ALL ".join(
    f"SELECT repo, scan_id, {i + 1} AS category_rank, {q(c)} AS category, {_category_column(c)} AS finding_count FROM profile"
    for i, c in enumerate(rules.CATEGORIES))
CATEGORY_ROWS = f"{PROFILE}, category_rows AS ({_long})"
_compared = ["total_findings", "risk_score", *[_category_column(c) for c in rules.CATEGORIES]]
TREND = f"""{PROFILE},
    lagged AS (SELECT *, row_number() OVER w > 1 AS has_previous,
      {', '.join(f'lag({c}) OVER w AS p_{c}' for c in _compared)} FROM profile
      WINDOW w AS (PARTITION BY repo ORDER BY scan_id)),
    deltas AS ({' UNION ALL '.join(
        f"SELECT repo, scan_id, {i} AS rk, {q(c)} AS category, {_category_column(c)} - p_{_category_column(c)} AS delta "
        f"FROM lagged WHERE has_previous" for i, c in enumerate(rules.CATEGORIES))}),
    extremes AS (SELECT repo, scan_id,
      first(category ORDER BY delta, rk) FILTER (delta < 0) AS most_improved_category,
      first(category ORDER BY delta DESC, rk) FILTER (delta > 0) AS worst_category FROM deltas GROUP BY ALL)"""


def direction(delta: str) -> str:
    return f"(CASE WHEN {delta} > 0 THEN 'increased' WHEN {delta} < 0 THEN 'decreased' ELSE 'unchanged' END)"


def values_table() -> str:
    rows = []
    for row in advice.advice_rows():
        *texts, references = row
        rows.append("(" + ", ".join(q(t) for t in texts) + ", " + q(" ".join(references)) + ")")
    return ("advice(entity_type, root_cause, why_detected, likely_developer_mistake, security_impact, recommendation, "
            f"owasp, cwe, best_practice, refs) AS (VALUES {', '.join(rows)})")


def advised(field: str, entity: str = "x.entity_type") -> str:
    if field == "recommendation":
        default = f"printf({q(advice.DEFAULT_RECOMMENDATION)}, {entity})"
    elif field == "refs":
        default = q(" ".join(advice.DEFAULT_REFERENCES))
    else:
        default = q(advice.DEFAULTS[field])
    return f"coalesce(a.{field}, {default})"


RANKED = f"""{FINDINGS}, {values_table()},
    per_entity AS (SELECT repo, scan_id, entity_type,
      max(CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END)::INTEGER AS severity_rank,
      min(finding_index) AS first_index FROM findings GROUP BY ALL),
    ranked AS (SELECT repo, scan_id, entity_type, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][severity_rank + 1] AS severity,
      row_number() OVER (PARTITION BY repo, scan_id ORDER BY severity_rank DESC, first_index, entity_type)::INTEGER AS rank
      FROM per_entity)"""
_worst = f"row_number() OVER (PARTITION BY repo, scan_id ORDER BY {SEVERITY_ORDER}, finding_index)::INTEGER"
FILES = """files AS (SELECT repo, scan_id, file, count(*) AS finding_count, min(finding_index) AS first_index FROM findings
      GROUP BY ALL),
    ranked_files AS (SELECT *, row_number() OVER (PARTITION BY repo, scan_id ORDER BY finding_count DESC, first_index)::INTEGER
      AS rank FROM files)"""

RISK = ("low, medium, high, critical, total_findings, risk_score, pipeline_status, warning_threshold, fail_threshold")
PLACE = 'repo, scan_id, relative_path, "start", "end", entity_type, score, value'


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _identifiers() -> str:
    def number(factor: int, modulus: int, width: int) -> str:
        return f"lpad(((c_custkey * {factor}) % {modulus})::VARCHAR, {width}, '0')"

    lines = [f"{q(p + a)} || {number(f, m, w)} || {q(b)}" for p, f, m, w, a, b in fx.NUMBER_LINES]
    lines += [
        f"'ssn ' || {number(7919, 1000, 3)} || '-' || {number(31, 100, 2)} || '-' || {number(17, 10000, 4)}",
        f"'on 2024-' || {number(1, 14, 2)} || '-' || {number(3, 33, 2)}",
        f"'jwt eyJhbGciOi' || {number(7, 1000, 3)} || '.eyJzdWIiOi' || {number(3, 1000, 3)} || '.sig_' || {number(11, 1000, 3)}",
        f"'password = \"pw-' || {number(13, 100000, 5)} || '\"'",
        "'-----BEGIN RSA PRIVATE KEY-----'",
    ]
    return ("docs AS (SELECT c_custkey::VARCHAR AS repo, 0::BIGINT AS scan_id, 'exports/ids.csv' AS relative_path, '.csv' AS "
            f"extension, concat_ws(chr(10), {', '.join(lines)}) AS text FROM customer)")


def _urls() -> str:
    host = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
    path = pick("page_id", ("exports/a.csv", "exports/a.csv", "docs/guide.txt", "exports/a.csv", "exports/b.csv",
                            "src/app.json", "exports/c.csv", "exports/d.csv"))
    prefix = pick("page_id", ("customer portal ", "see ", "patient file ", "customer docs ", "employee link ", "open ",
                              "account ", "client host "))
    swapped = (f"CASE page_id % 8 WHEN 3 THEN replace(url, {host}, 'docs.python.org') WHEN 4 THEN replace(url, {host}, 'hr.corp') "
               f"WHEN 5 THEN url || '&token=abc' WHEN 6 THEN replace(url, {host}, 'localhost:8080') "
               f"WHEN 7 THEN replace(url, {host}, 'user:pw@files.example.org') ELSE url END")
    return (f"docs AS (SELECT page_id::VARCHAR AS repo, 0::BIGINT AS scan_id, {path} AS relative_path, "
            rf"regexp_extract({path}, '(\.[a-z]+)$', 1) AS extension, {prefix} || {swapped} || ' end' AS text FROM pages)")


def _dates() -> str:
    day = "strftime(o_orderdate, '%Y-%m-%d')"
    prefix = pick("o_orderkey", ("date of birth: ", "built on ", "The patient came on ", "born ", "Birthdays: ",
                                 "passport until "))
    return ("docs AS (SELECT o_orderkey::VARCHAR AS repo, 0::BIGINT AS scan_id, 'exports/o.csv' AS relative_path, '.csv' AS "
            f"extension, {prefix} || CASE WHEN o_orderkey % 7 = 0 THEN substr({day}, 1, 8) || '32' ELSE {day} END || '.' AS text "
            "FROM orders)")


def _sentences() -> str:
    paths = ("exports/customers.csv", "CHANGES.md", "src/app.py", "tests/data.csv", "exports/note.csv", "docs/guide.txt")
    before = ("patient full name: ", "Thanks to ", "owner = ", "written for ", "we met ", "billing address of ")
    after = (", on file", " for the release", " today", " today", " today", " today")
    return (f"parts AS (SELECT c_custkey::VARCHAR AS repo, {pick('c_custkey', paths)} AS relative_path, "
            f"{pick('c_custkey', before)} AS b, replace(c_name, 'Customer#', 'Kim ') AS value, {pick('c_custkey', after)} AS a "
            "FROM customer), ctx AS (SELECT repo, relative_path, regexp_extract(relative_path, '(\\.[a-z]+)$', 1) AS extension, "
            "value, b || value || a AS win, b || value || a AS line, unnest(['PERSON', 'ORGANIZATION', 'LOCATION', 'NRP']) AS "
            "entity_type FROM parts)")


_requests = ("requests AS (SELECT repo, scan_id, unnest(['F-000000', 'F-000003', 'F-999999', 'F-', 'bad', 'F-00x001']) AS "
             "requested_id FROM scans), asked AS (SELECT *, try_cast(nullif(regexp_extract(requested_id, '^F-([0-9]+)$', 1), '') "
             "AS BIGINT) AS finding_index FROM requests)")
_file_folder = pick("doc_id", ("docs/", "node_modules/a/", "src/", "build/", "", "src/venv/", "venv.d/"))
_file_suffix = pick("doc_id", (".md", ".PY", ".csv", ".json", ".png"))
LISTED = (f"listed AS (SELECT source AS repo, {SCAN} AS scan_id, concat({_file_folder}, 'd', doc_id::VARCHAR, {_file_suffix}) AS "
          f"relative_path, lower({_file_suffix}) AS extension, n_chars AS size_bytes FROM documents), "
          f"scoped AS (SELECT *, extension IN ({names(rules.SCANNED_EXTENSIONS)}) AND NOT list_has_any(string_split(relative_path, "
          f"'/')[:-2], [{names(rules.EXCLUDED_DIRECTORIES)}]) AS in_scope FROM listed)")


def count_text(column: str) -> str:
    return f"format('{{:,}}', ({column})::BIGINT)"


def duration_text(whole: str) -> str:
    return (f"(CASE WHEN {whole} IS NULL THEN 'n/a' WHEN {whole} >= 3600 THEN ({whole} // 3600)::VARCHAR || 'h ' || "
            f"(({whole} % 3600) // 60)::VARCHAR || 'm' WHEN {whole} >= 60 AND {whole} % 60 > 0 THEN ({whole} // 60)::VARCHAR || 'm ' || "
            f"({whole} % 60)::VARCHAR || 's' WHEN {whole} >= 60 THEN ({whole} // 60)::VARCHAR || 'm' ELSE ({whole})::VARCHAR || 's' END)")


def size_text(size: str) -> str:
    units = ("KB", "MB", "GB", "TB")
    steps = " ".join(
        f"WHEN {size} < {1024 ** (p + 2)} THEN printf('%.1f', {size} / {float(1024 ** (p + 1))}) || ' {u}'"
        for p, u in enumerate(units))
    return f"(CASE WHEN {size} < 1024 THEN ({size})::VARCHAR || ' B' {steps} ELSE printf('%.1f', {size} / {float(1024 ** 5)}) || ' PB' END)"


def _label(severity: str) -> str:
    return severity.title()


_parts_sql = ", ".join(f"CASE WHEN {s.lower()} > 0 THEN {s.lower()}::VARCHAR || ' {_label(s)}' END" for s in rules.SEVERITIES_DESC)
_sentence = (f"(CASE WHEN total_findings = 0 THEN {q(narrative.NO_SEVERITY)} ELSE 'Severity breakdown: ' || "
             f"concat_ws(', ', {_parts_sql}) || '.' END)")
_variants = ", ".join(["NULL", *[q(b) for b in BROKEN_REPORTS]])


def _gate() -> str:
    expected = {10: "WARNING"}
    reason = {1: "no report", 2: "no report", 3: "not valid JSON", 4: "no summary object", 5: "no summary object",
              6: "no summary object", 7: "unknown pipeline_status", 8: "unknown pipeline_status", 9: "not valid JSON",
              10: "pipeline_status is WARNING"}
    status = "CASE variant WHEN 0 THEN pipeline_status " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in expected.items()) + " END"
    why = ("CASE variant WHEN 0 THEN 'pipeline_status is ' || pipeline_status "
           + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in reason.items()) + " END")
    return _with(PROFILE, f"""SELECT repo, scan_id, variant::INTEGER AS variant, st AS pipeline_status,
      (CASE WHEN st IN ('PASS', 'WARNING') THEN 0 ELSE 1 END)::INTEGER AS exit_code,
      CASE st WHEN 'PASS' THEN 'Succeeded' WHEN 'WARNING' THEN 'SucceededWithIssues' ELSE 'Failed' END AS result, reason
      FROM (SELECT repo, scan_id, variant, {status} AS st, {why} AS reason FROM profile, range(0, {len(BROKEN_REPORTS) + 1}) r(variant))""")


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {
        "repo_risk": _with(PROFILE, f"SELECT repo, scan_id, {RISK} FROM profile"),
        "severity_counts": _with(PROFILE, "SELECT repo, scan_id, low, medium, high, critical, total_findings FROM profile"),
        "category_counts": _with(PROFILE, f"SELECT repo, scan_id, {_categories} FROM profile"),
    }
    for name, rec in (("spans_email", "email"), ("spans_card_luhn", "credit_card"), ("spans_ipv4", "ipv4"),
                      ("spans_phone", "phone"), ("spans_secret", "api_key"), ("spans_iban", "iban")):
        out[name] = _with(f"{DOCS}, {spans_cte('docs', (rec,))}", f"SELECT {PLACE}, line_number FROM spans")
    out["spans_from_udf"] = out["spans_email"]
    out["spans_url"] = _with(f"{_urls()}, {spans_cte('docs', ('url',))}", f"SELECT {PLACE}, {HOST} AS host FROM spans")
    html = ("docs AS (SELECT page_id::VARCHAR AS repo, 0::BIGINT AS scan_id, 'page.html' AS relative_path, '.html' AS extension, "
            "html AS text FROM pages)")
    out["spans_in_html"] = _with(f"{html}, {spans_cte('docs', ('email', 'phone', 'ipv4'))}", f"SELECT {PLACE} FROM spans")
    turns = ("docs AS (SELECT conv_id::VARCHAR AS repo, turn AS scan_id, role || '.txt' AS relative_path, '.txt' AS extension, "
             "text FROM conversations)")
    out["spans_in_conversations"] = _with(f"{turns}, {spans_cte('docs', ('email', 'phone', 'credit_card'))}",
                                          f"SELECT {PLACE} FROM spans")
    out["synthetic_ids"] = _with(f"{_identifiers()}, {spans_cte('docs', SYNTHETIC)}", f"SELECT {PLACE}, line_number FROM spans")
    long_lines = (f"docs AS (SELECT doc_id::VARCHAR AS repo, 0::BIGINT AS scan_id, 'exports/long.csv' AS relative_path, '.csv' AS extension, "
                  f"repeat(replace(text, chr(10), ' ') || ' ', {fx.LONG_COPIES}) AS text FROM documents)")
    out["spans_long_lines"] = _with(f"{long_lines}, {spans_cte('docs', ('email', 'phone', 'credit_card', 'ipv4'))}",
                                    f"SELECT {PLACE}, line_number, md5(win) AS window_md5 FROM spans")
    for name, made, chosen in (("spans_secrets_bare", fx.SECRET_LINES, SECRETS), ("spans_whole_keys", fx.KEY_LINES, ("private_key",)),
                               ("spans_cards_in_groups", fx.CARD_LINES, ("credit_card",)), ("spans_iban_valid", fx.IBAN_LINES, ("iban",))):
        texts = ", ".join(f"replace({q(line)}, '#', lpad((c_custkey % 10000)::VARCHAR, 4, '0'))" for line in made)
        docs = (f"docs AS (SELECT c_custkey::VARCHAR AS repo, 0::BIGINT AS scan_id, 'exports/made.csv' AS relative_path, '.csv' AS extension, "
                f"concat_ws(chr(10), {texts}) AS text FROM customer)")
        out[name] = _with(f"{docs}, {spans_cte('docs', chosen)}", f"SELECT {PLACE}, line_number FROM spans")
    at, known = 0, []
    for number, (line, values) in enumerate(fx.IPV6, 1):  # the answer is stated, not searched for
        wide = line.replace("#", "0000")
        for value in values:
            start = at + wide.index(value.replace("#", "0000"))
            known.append(f"({start}, {start + len(value.replace('#', '0000'))}, {q(value)}, {number})")
        at += len(wide) + 1
    out["spans_ipv6"] = f"""SELECT c_custkey::VARCHAR AS repo, 0::BIGINT AS scan_id, 'exports/made.csv' AS relative_path, a AS "start", b AS "end",
      'IP_ADDRESS' AS entity_type, 0.95::DOUBLE AS score, replace(v, '#', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS value, n AS line_number
      FROM customer, (VALUES {", ".join(known)}) AS known(a, b, v, n)"""
    wallets = ("docs AS (SELECT c_custkey::VARCHAR AS repo, 0::BIGINT AS scan_id, 'exports/w.csv' AS relative_path, '.csv' AS "
               "extension, 'a 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa b 1A1zP1eP5QGefi2DMPTfTL5SLmv7Div' || "
               "translate(lpad(c_custkey::VARCHAR, 4, '1'), '0', 'z') || ' c' AS text FROM customer)")
    out["synthetic_wallets"] = _with(f"{wallets}, {spans_cte('docs', ('crypto',))}", f"SELECT {PLACE} FROM spans")
    context = _with(f"{DOCS}, {spans_cte('docs')}", f"SELECT {PLACE}, line_number, win AS \"window\", line FROM spans")
    out["context_columns"] = out["spans_from_table"] = context
    out["validated_spans"] = _with(f"{DOCS}, {spans_cte('docs')}", f"SELECT {PLACE} FROM spans WHERE {KEEP}")
    out["custom_validator"] = _with(f"{DOCS}, {spans_cte('docs')}", f"SELECT {PLACE} FROM spans WHERE {KEEP} AND NOT {TEST}")
    out["resolve_overlaps"] = """WITH s AS (SELECT o_custkey::VARCHAR AS repo, o_orderstatus AS entity_type,
        (o_orderkey * 7 % 60)::INTEGER AS "start", (o_orderkey * 7 % 60 + 1 + o_orderkey * 13 % 40)::INTEGER AS "end",
        (o_orderkey % 5)::DOUBLE / 8 AS score FROM orders),
      u AS (SELECT repo, entity_type, "start", "end", max(score) AS score FROM s GROUP BY ALL)
      SELECT repo, "start", "end", entity_type, score FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.repo = x.repo
        AND y.entity_type = x.entity_type AND NOT (y."start" = x."start" AND y."end" = x."end")
        AND ((y."start" <= x."start" AND y."end" >= x."end" AND y.score >= x.score)
          OR (x."start" <= y."start" AND x."end" >= y."end" AND y.score > x.score)))"""
    out["rule_nlp"] = _with(_sentences(), f"""SELECT repo, relative_path, entity_type, value, {KEEP} AS keep, {DOCUMENTATION} AS
      documentation, {TEST} AS test, {CODE} AS code, {CREDIT} AS credit, {SENSITIVE} AS sensitive FROM ctx""")
    out["rule_url"] = _with(f"{_urls()}, {spans_cte('docs', ('url',))}",
                            f"SELECT repo, relative_path, value, {URL_SECRET} AS secret, {PUBLIC} AS public, {KEEP} AS keep FROM spans")
    out["rule_date"] = _with(f"{_dates()}, {spans_cte('docs', ('date',))}", f"SELECT repo, value, {KEEP} AS keep FROM spans")
    out["redacted_findings"] = _with(FINDINGS, """SELECT repo, scan_id, file, "start", "end", line_number, entity_type,
      confidence_score, severity, category, matched_value, true AS redacted FROM findings""")
    out["redacted_documents"] = _redacted_documents()
    out["masked_logs"] = """WITH s AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 > 0 THEN (user_id % 90 + 10)::VARCHAR END AS
        secret FROM events)
      SELECT event_id, CASE WHEN secret IS NULL THEN 'https://oauth2:' || props || '@host'
        ELSE replace('https://oauth2:' || props || '@host', secret, '***REDACTED***') END AS masked_message
      FROM events JOIN s USING (user_id)"""
    out["finding_ids"] = _with(FINDINGS, """SELECT repo, scan_id, finding_index, finding_id, file, entity_type, "start",
      finding_index AS parsed_index FROM findings""")
    known = "CASE WHEN x.entity_type IS NOT NULL THEN {} END"
    out["explain_findings"] = _with(f"{FINDINGS}, {values_table()}, {_requests}", f"""SELECT r.repo, r.scan_id, r.requested_id,
      {known.format('r.requested_id')} AS finding_id, x.entity_type, x.severity, x.file, x.line_number,
      {known.format(advised('root_cause'))} AS root_cause, {known.format(advised('why_detected'))} AS explanation,
      {known.format(advised('recommendation'))} AS recommendation, {known.format(advised('best_practice'))} AS best_practice,
      {known.format(advised('owasp'))} AS owasp, {known.format(advised('cwe'))} AS cwe, x.confidence_score AS confidence
      FROM asked r LEFT JOIN findings x USING (repo, scan_id, finding_index) LEFT JOIN advice a ON a.entity_type = x.entity_type""")
    out["finding_by_id"] = _with(f"{FINDINGS}, {_requests}", """SELECT r.repo, r.scan_id, requested_id, r.finding_index, file,
      entity_type, severity FROM asked r LEFT JOIN findings x USING (repo, scan_id, finding_index)""")
    out["findings_per_file"] = _with(FINDINGS, "SELECT repo, scan_id, file, count(*) AS finding_count FROM findings GROUP BY ALL")
    out["max_severity_per_entity"] = _with(RANKED, "SELECT * FROM per_entity")
    out["distinct_entities_preview"] = _with(FINDINGS, """SELECT repo, scan_id, array_to_string(list_sort(list_distinct(
      list(entity_type)))[1:8], ',') AS entities FROM findings WHERE finding_index < 20 GROUP BY ALL""")
    out["top_findings"] = _with(FINDINGS, f"""SELECT repo, scan_id, rank, finding_id, file, line_number, entity_type, severity
      FROM (SELECT *, {_worst} AS rank FROM findings) WHERE rank <= 25""")
    out["key_findings"] = _with(PROFILE, f"""SELECT repo, scan_id, rank, finding_id, severity, entity_type, file, line_number,
      greatest(total_findings - 15, 0)::BIGINT AS remaining FROM (SELECT *, {_worst} AS rank FROM findings)
      JOIN (SELECT repo, scan_id, total_findings FROM profile) USING (repo, scan_id) WHERE rank <= 15""")
    out["detailed_findings"] = _with(f"{PROFILE}, {values_table()}", f"""SELECT repo, scan_id, rank, finding_id, severity,
      x.entity_type, {advised('owasp')} AS owasp, {advised('cwe')} AS cwe, greatest(total_findings - 20, 0)::BIGINT AS remaining
      FROM (SELECT *, {_worst} AS rank FROM findings) x JOIN (SELECT repo, scan_id, total_findings FROM profile) p
      USING (repo, scan_id) LEFT JOIN advice a ON a.entity_type = x.entity_type WHERE rank <= 20""")
    out["top_critical"] = _with(FINDINGS, """SELECT repo, scan_id, rank, finding_id, entity_type, file, line_number FROM (SELECT *,
      row_number() OVER (PARTITION BY repo, scan_id ORDER BY finding_index)::INTEGER AS rank FROM findings
      WHERE severity = 'CRITICAL') WHERE rank <= 10""")
    out["prompt_sample"] = _with(PROFILE, """SELECT repo, scan_id, finding_index, entity_type, severity, file,
      total_findings > 25 AS truncated FROM findings JOIN (SELECT repo, scan_id, total_findings FROM profile)
      USING (repo, scan_id) WHERE finding_index < 25""")
    out["top_files"] = _with(f"{FINDINGS}, {FILES}", "SELECT repo, scan_id, rank, file, finding_count FROM ranked_files WHERE rank <= 10")
    out["top_categories"] = _with(CATEGORY_ROWS, """SELECT * FROM (SELECT repo, scan_id, row_number() OVER (PARTITION BY repo, scan_id
      ORDER BY finding_count DESC, category_rank)::INTEGER AS rank, category, finding_count FROM category_rows
      WHERE finding_count > 0) WHERE rank <= 8""")
    out["recommendations"] = _with(RANKED, f"""SELECT repo, scan_id, x.entity_type, severity, rank, {advised('recommendation')} AS
      recommendation FROM ranked x LEFT JOIN advice a ON a.entity_type = x.entity_type""")
    reference = (f"{advised('owasp')} AS owasp, {advised('cwe')} AS cwe, {advised('best_practice')} AS best_practice, "
                 f"{advised('refs')} AS \"references\"")
    out["secure_coding"] = _with(RANKED, f"""SELECT repo, scan_id, x.entity_type, severity, rank, {advised('recommendation')} AS
      recommendation, {reference} FROM ranked x LEFT JOIN advice a ON a.entity_type = x.entity_type""")
    causes = ", ".join(f"{advised(c)} AS {c}" for c in ("root_cause", "why_detected", "likely_developer_mistake", "security_impact"))
    out["root_cause"] = _with(f"{FINDINGS}, {values_table()}", f"""SELECT repo, scan_id, finding_id, x.entity_type, severity, category,
      file, line_number, confidence_score AS confidence, {causes} FROM findings x LEFT JOIN advice a ON a.entity_type = x.entity_type""")
    out["remediation"] = _with(f"{FINDINGS}, {values_table()}", f"""SELECT repo, scan_id, finding_id, x.entity_type, severity,
      {advised('recommendation')} AS recommendation, {reference} FROM findings x LEFT JOIN advice a ON a.entity_type = x.entity_type""")
    out["critical_with_recommendation"] = _with(f"{FINDINGS}, {values_table()}", f"""SELECT repo, scan_id, rank, finding_id,
      x.entity_type, file, line_number, severity, {advised('recommendation')} AS recommendation FROM (SELECT *, row_number() OVER (
      PARTITION BY repo, scan_id ORDER BY finding_index)::INTEGER AS rank FROM findings WHERE severity = 'CRITICAL') x
      LEFT JOIN advice a ON a.entity_type = x.entity_type WHERE rank <= 10""")
    findings_delta, risk_delta = "(total_findings - p_total_findings)", "(risk_score - p_risk_score)"
    avail = "CASE WHEN has_previous THEN {} END"
    fields = {
        "previous_total_findings": "p_total_findings", "current_total_findings": "total_findings", "difference": findings_delta,
        "findings_delta": findings_delta, "findings_trend": direction(findings_delta), "previous_risk_score": "p_risk_score",
        "current_risk_score": "risk_score", "risk_score_delta": risk_delta, "risk_score_trend": direction(risk_delta),
    }
    selected = ", ".join(f"{avail.format(v)} AS {k}" for k, v in fields.items())
    out["scan_trend"] = _with(TREND, f"""SELECT repo, scan_id, has_previous AS trend_available, {selected}, most_improved_category,
      worst_category FROM lagged LEFT JOIN extremes USING (repo, scan_id)""")
    out["category_trend"] = _with(TREND, "SELECT repo, scan_id, category, delta FROM deltas")
    out["category_union"] = _with(CATEGORY_ROWS, """, c AS (SELECT * FROM category_rows WHERE finding_count > 0)
      SELECT repo, scan_id, category, coalesce(p.finding_count, 0) AS previous_count, coalesce(c.finding_count, 0) AS current_count,
      coalesce(c.finding_count, 0) - coalesce(p.finding_count, 0) AS delta FROM (SELECT repo, scan_id + 1 AS scan_id, category,
      finding_count FROM c) p FULL JOIN c USING (repo, scan_id, category)""")
    cards = [("Previous Findings", count_text("p_total_findings")), ("Current Findings", count_text("total_findings")),
             ("Difference", count_text(findings_delta)),
             ("Trend", f"(CASE WHEN {findings_delta} > 0 THEN 'Increased' WHEN {findings_delta} < 0 THEN 'Decreased' ELSE 'Unchanged' END)"),
             ("Previous Risk", count_text("p_risk_score")), ("Current Risk", count_text("risk_score"))]
    card_text = " || '|' || ".join(f"'{label}:' || {value}" for label, value in cards)
    out["trend_cards"] = _with(TREND, f"SELECT repo, scan_id, CASE WHEN has_previous THEN {card_text} ELSE 'Trend:No Change' END AS cards FROM lagged")
    out["trend_with_unreadable"] = _with(TREND, f"""SELECT repo, scan_id, ok AS trend_available, CASE WHEN ok THEN {findings_delta} END AS
      findings_delta, CASE WHEN ok THEN {direction(risk_delta)} END AS risk_score_trend FROM (SELECT *, has_previous AND
      lag(scan_id) OVER (PARTITION BY repo ORDER BY scan_id) <> 1 AS ok0, coalesce(ok0, false) AS ok FROM lagged)""")
    out["reports_nested"] = _with(PROFILE, """SELECT repo, scan_id, coalesce(finding_index // 2, 0)::BIGINT AS page,
      greatest(ceil(total_findings / 2), 1)::BIGINT AS page_count, (finding_index % 2)::INTEGER AS position, total_findings, risk_score,
      pipeline_status, file, line_number, entity_type, matched_value FROM profile LEFT JOIN (SELECT repo, scan_id, finding_index, file,
      line_number, entity_type, matched_value FROM findings) USING (repo, scan_id)""")
    out["valid_reports"] = _with(SCANS, f"""SELECT repo, scan_id, variant::INTEGER AS variant, variant = 0 AS valid FROM scans,
      range(0, {len(BROKEN_REPORTS) + 1}) r(variant)""")
    out["dashboard"] = _with(f"{TREND}, {FILES}", f""",
      tf AS (SELECT repo, scan_id, string_agg(file || ':' || finding_count, '|' ORDER BY rank) AS top_files FROM ranked_files
        WHERE rank <= 10 GROUP BY ALL),
      tp AS (SELECT repo, scan_id, string_agg(finding_id || ':' || severity, '|' ORDER BY rank) AS top_findings FROM (SELECT *,
        {_worst} AS rank FROM findings) WHERE rank <= 25 GROUP BY ALL)
      SELECT repo, scan_id, total_findings, risk_score, pipeline_status, financial_data AS financial, other,
        has_previous AS trend_available, {avail.format(findings_delta)} AS findings_delta, top_files, top_findings, critical
      FROM lagged LEFT JOIN tf USING (repo, scan_id) LEFT JOIN tp USING (repo, scan_id)""")
    out["chart_data"] = _with(f"{CATEGORY_ROWS}, {FILES}", """,
      tf AS (SELECT repo, scan_id, string_agg(file || ':' || finding_count, '|' ORDER BY rank) AS top_files FROM ranked_files
        WHERE rank <= 10 GROUP BY ALL),
      rc AS (SELECT *, row_number() OVER (PARTITION BY repo, scan_id ORDER BY finding_count DESC, category_rank) AS rank
        FROM category_rows WHERE finding_count > 0),
      tc AS (SELECT repo, scan_id, string_agg(category || ':' || finding_count, '|' ORDER BY rank) AS top_categories FROM rc
        WHERE rank <= 8 GROUP BY ALL)
      SELECT repo, scan_id, high, personal_information AS personal, top_categories, top_files FROM profile
      LEFT JOIN tc USING (repo, scan_id) LEFT JOIN tf USING (repo, scan_id)""")
    metrics = (("Total Findings", "total_findings"), ("Critical", "critical"), ("High", "high"), ("Medium", "medium"),
               ("Low", "low"), ("Risk Score", "risk_score"), ("Files Scanned", "files_scanned"))
    out["executive_metrics"] = _with(PROFILE, " UNION ALL ".join(
        f"SELECT repo, scan_id, {i}::INTEGER AS position, {q(label)} AS label, {count_text(c)} AS value FROM profile"
        for i, (label, c) in enumerate(metrics)))
    out["release_recommendation"] = _with(PROFILE, f""", e AS (SELECT repo, scan_id, array_to_string(list_sort(list_distinct(
      list(entity_type)))[1:8], ', ') AS entities FROM findings WHERE finding_index < 20 GROUP BY ALL)
      SELECT repo, scan_id, {case('pipeline_status', rules.RELEASE_STATUS, '')} AS release_status, lower(pipeline_status) AS tone,
      CASE WHEN pipeline_status = 'PASS' THEN {q(rules.RELEASE_REASON['PASS'])} ELSE concat_ws(' ',
        CASE WHEN critical > 0 THEN 'Critical findings: ' || critical || '.' END,
        CASE WHEN high > 0 THEN 'High findings: ' || high || '.' END,
        CASE WHEN pipeline_status = 'FAIL' THEN {q(rules.RELEASE_REASON['FAIL'])} ELSE {q(rules.RELEASE_REASON['WARNING'])} END,
        'Kinds of data found: ' || entities || '.') END AS reason,
      CASE WHEN pipeline_status = 'PASS' THEN {q(' '.join(rules.SAFE_ACTIONS))} ELSE {q(' '.join(rules.BLOCKED_ACTIONS))} END AS actions
      FROM profile LEFT JOIN e USING (repo, scan_id)""")
    out["release_gate"] = _gate()
    own = (f"'The scan of ' || repo || ' gave ' || total_findings || ' finding(s), a risk score of ' || risk_score || "
           f"' and the pipeline status **' || pipeline_status || '** (warning from 20, fail from 50). ' || {_sentence}")
    out["narratives"] = _with(PROFILE, f"""SELECT repo, scan_id, CASE WHEN scan_id = 2 THEN 'All good.' ELSE {own} END AS
      executive_summary FROM profile""")
    out["summary_markdown"] = _summary(own)
    out["guidance_markdown"] = _guidance()
    out["prompts"] = _prompts()
    out["scan_accounting"] = _with(LISTED, f"""SELECT repo, scan_id, count(*) FILTER (in_scope AND size_bytes <=
      {LIMIT.max_file_size_bytes}) AS files_scanned, count(*) FILTER (in_scope AND size_bytes > {LIMIT.max_file_size_bytes}) AS
      files_skipped FROM scoped GROUP BY ALL""")
    out["file_filters"] = _with(LISTED, f"""SELECT repo, scan_id, relative_path, extension, size_bytes FROM scoped WHERE in_scope AND
      size_bytes <= {LIMIT.max_file_size_bytes}""")
    out["traversal_order"] = _with(LISTED, f"""SELECT repo, relative_path, (row_number() OVER (PARTITION BY repo ORDER BY
      {PATH_KEY.replace('file', 'relative_path')}) - 1)::BIGINT AS position FROM listed""")
    out["path_functions"] = _with(LISTED, r"""SELECT repo, relative_path, regexp_extract(string_split(relative_path, '/')[-1],
      '^(.+)\.[^.]+$', 1) AS stem, extension AS suffix, len(string_split(relative_path, '/'))::INTEGER AS parts,
      CASE WHEN starts_with(relative_path, 'src/') THEN substr(relative_path, 5) ELSE relative_path END AS below_src FROM listed""")
    out["decoded_files"] = "SELECT doc_id, text || chr(10) || 'end' AS text, 'é café' || source AS latin FROM documents"
    size = "(floor(pow(l_quantity, 8) + l_partkey)::BIGINT)"
    whole = "(floor(floor(l_extendedprice) / 2)::BIGINT)"
    out["formatting"] = f"""SELECT l_orderkey, l_linenumber, {size_text(size)} AS size_text, {duration_text(whole)} AS duration_text,
      {count_text('floor(l_extendedprice)')} AS count_text, strftime(l_shipdate, '%Y%m%d_%H%M%S') AS slug,
      strftime(l_shipdate, '%d %B %Y %I:%M %p') || ' UTC' AS report_date,
      CASE WHEN l_returnflag = 'A' THEN 'pass' ELSE 'unknown' END AS tone FROM lineitem"""
    seconds = "((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)"
    out["scan_times"] = f"""SELECT user_id, count(*) AS files_scanned, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS
      duration_seconds, {duration_text(seconds)} AS duration_text FROM events GROUP BY user_id"""
    out["sql_functions"] = _with(f"{DOCS}, {spans_cte('docs')}", f"""SELECT repo, scan_id, relative_path, "start", entity_type,
      {SEVERITY} AS severity, {CATEGORY} AS category, {MASK} AS masked, 'F-' || lpad("start"::VARCHAR, 6, '0') AS fid,
      {size_text('"start"')} AS size_text, entity_type IN ({names(rules.HIGH_SIGNAL_ENTITIES)}) AS high_signal FROM spans""")
    out["repo_files"] = r"""SELECT source AS repo, 0::BIGINT AS scan_id, 'p' || doc_id % 7 || '/.q/' || doc_id || '.py' AS relative_path, '.py' AS extension,
      strlen(text) AS size_bytes, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS text_md5 FROM documents WHERE text IS NOT NULL"""
    out["history_append"] = _with(SCANS, """SELECT repo, scan_id, row_number() OVER (PARTITION BY repo
      ORDER BY scan_id) AS scan_no FROM scans""")
    shown = "CASE WHEN scan_id = 2 THEN 'UNKNOWN' ELSE pipeline_status END"
    out["history_index"] = _with(PROFILE, f"""SELECT repo, scan_id + 1 AS scan_no, lpad((scan_id + 1)::VARCHAR, 3, '0') AS report_number,
      'n/a' AS report_date, {shown} AS pipeline_status, lower({shown}) AS tone FROM profile""")
    out["recent_reports"] = _with(PROFILE, f"""SELECT repo, scan_id + 1 AS scan_no, row_number() OVER (PARTITION BY repo ORDER BY scan_id
      DESC)::INTEGER AS rank, {shown} AS pipeline_status FROM profile""")
    out["latest_previous_report"] = _with(PROFILE, """SELECT repo, scan_id + 1 AS scan_no, CASE WHEN scan_id = 2 THEN 0 ELSE total_findings
      END AS total_findings FROM profile QUALIFY row_number() OVER (PARTITION BY repo ORDER BY scan_id DESC) = 1""")
    return out


def _redacted_documents() -> str:
    """The text is put together from gaps and masks; what sticks out of an earlier span is starred."""
    return _with(f"{DOCS}, {spans_cte('docs')}", f""",
      kept AS (SELECT *, {MASK} AS mask FROM spans WHERE {KEEP}),
      laid AS (SELECT *, coalesce(max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
        row_number() OVER w AS n FROM kept
        WINDOW w AS (PARTITION BY repo, scan_id, relative_path ORDER BY "start", "end" DESC, mask)),
      heads AS (SELECT l.repo, l.scan_id, l.relative_path, string_agg(CASE
        WHEN "start" >= pos THEN substr(d.text, pos + 1, "start" - pos) || mask
        WHEN "end" > pos THEN repeat('*', "end" - pos) ELSE '' END, ''
        ORDER BY n) AS body, max("end") AS last FROM laid l JOIN docs d USING (repo, scan_id, relative_path) GROUP BY ALL)
      SELECT d.repo, d.scan_id, d.relative_path, CASE WHEN body IS NULL THEN text ELSE body || substr(text, last + 1) END AS
      redacted_text FROM docs d LEFT JOIN heads USING (repo, scan_id, relative_path)""")


NEW_LINE = "chr(10)"


def sections(title: str, parts: list[tuple[str, str]]) -> str:
    pieces = [f"{q('# ' + title)} || {NEW_LINE}"]
    pieces += [f"{NEW_LINE} || {q('## ' + heading)} || {NEW_LINE} || {NEW_LINE} || ({body}) || {NEW_LINE}" for heading, body in parts]
    return " || ".join(pieces)


def risk_lines() -> str:
    counts = ", ".join(f"CASE WHEN {s.lower()} > 0 THEN '  - {_label(s)}: ' || {s.lower()} END" for s in rules.SEVERITIES_DESC)
    return (f"concat_ws({NEW_LINE}, '- **Pipeline status:** ' || pipeline_status, '- **Risk score:** ' || risk_score || "
            "' (warning >= 20, fail >= 50)', '- **Total findings:** ' || total_findings, "
            f"CASE WHEN total_findings > 0 THEN concat_ws({NEW_LINE}, {counts}) END)")


def and_more(limit: int) -> str:
    return (f"CASE WHEN total_findings > {limit} THEN '- ...and ' || (total_findings - {limit}) || "
            "' more finding(s); see the full JSON report.' END")


def _summary(own: str) -> str:
    found = "total_findings > 0"
    line = "'- **[' || severity || ']** ' || entity_type || ' in ' || file || ':' || line_number"
    body = sections("Security Summary", [
        ("Executive Summary", own), ("Overall Risk", risk_lines()),
        ("Key Findings", f"CASE WHEN {found} THEN concat_ws({NEW_LINE}, key_text, {and_more(15)}) ELSE {q(narrative.NO_FINDINGS)} END"),
        ("Recommendations", f"coalesce(advice_text, {q(narrative.NO_FINDINGS)})"),
        ("Prioritized Actions", f"CASE WHEN {found} THEN action_text || {NEW_LINE} || {NEW_LINE} || {q(narrative.PRIORITY_NOTE)} "
                                f"ELSE {q(narrative.NO_FINDINGS)} END"),
        ("Compliance Considerations", q(narrative.COMPLIANCE)),
    ])
    ranked = RANKED.replace(FINDINGS, PROFILE)
    return _with(ranked, f""", top AS (SELECT repo, scan_id, string_agg({line}, {NEW_LINE} ORDER BY rank) AS key_text FROM
        (SELECT *, {_worst} AS rank FROM findings) WHERE rank <= 15 GROUP BY ALL),
      texts AS (SELECT repo, scan_id,
        string_agg('- **' || x.entity_type || '** (' || severity || '): ' || {advised('recommendation')}, {NEW_LINE} ORDER BY rank) AS advice_text,
        string_agg(rank || '. Deal with **' || x.entity_type || '** (severity: ' || severity || '): ' || {advised('recommendation')},
          {NEW_LINE} ORDER BY rank) AS action_text
        FROM ranked x LEFT JOIN advice a ON a.entity_type = x.entity_type GROUP BY ALL)
      SELECT repo, scan_id, {body} AS summary_markdown FROM profile LEFT JOIN top USING (repo, scan_id)
      LEFT JOIN texts USING (repo, scan_id)""")


def _guidance() -> str:
    found = "total_findings > 0"
    fields = (("1. Recommended fix: ", advised("recommendation")), ("2. From now on: ", advised("best_practice")),
              ("3. Root cause: ", f"{advised('root_cause')} || ' ' || {advised('likely_developer_mistake')}"),
              ("4. What can come of it: ", advised("security_impact")), ("5. Read on: ", advised("refs")))
    issue = (f"'### ' || finding_id || ': ' || x.entity_type || ' in `' || file || ':' || line_number || '`' || {NEW_LINE} || {NEW_LINE} || "
             f"severity || ' severity, group ' || category || ', found with score ' || confidence_score::VARCHAR || '; see ' || "
             f"{advised('owasp')} || ' and ' || {advised('cwe')} || '.' || {NEW_LINE} || "
             + " || ".join(f"{NEW_LINE} || '{name}' || {value}" for name, value in fields))
    coding = (f"'- **' || x.entity_type || '** (' || severity || '): ' || {advised('owasp')} || ' / ' || {advised('cwe')} || ': ' || "
              f"{advised('best_practice')}")
    intro = ("'For each issue found in ' || repo || ' this guide says why it was marked and how to fix it. Score and status are "
             "those of the report.'")
    body = sections("Developer Guidance Report", [
        ("Executive Summary", intro),
        ("Risk Score & Overall Severity",
         f"concat_ws({NEW_LINE}, {risk_lines()}, CASE WHEN NOT {found} THEN {q('  - ' + narrative.NO_SEVERITY)} END)"),
        ("Detected Issues, Root Cause & Recommended Fix",
         f"CASE WHEN {found} THEN concat_ws({NEW_LINE} || {NEW_LINE}, issues, {and_more(20)}) ELSE {q(narrative.NO_FINDINGS)} END"),
        ("Secure Coding Recommendations (by category)", f"coalesce(coding, {q(narrative.NO_FINDINGS)})"),
    ])
    ranked = RANKED.replace(FINDINGS, PROFILE)
    return _with(ranked, f""", listed AS (SELECT repo, scan_id, string_agg({issue}, {NEW_LINE} || {NEW_LINE} ORDER BY rank) AS issues FROM
        (SELECT *, {_worst} AS rank FROM findings) x LEFT JOIN advice a ON a.entity_type = x.entity_type WHERE rank <= 20 GROUP BY ALL),
      coded AS (SELECT repo, scan_id, string_agg({coding}, {NEW_LINE} ORDER BY rank) AS coding FROM ranked x
        LEFT JOIN advice a ON a.entity_type = x.entity_type GROUP BY ALL)
      SELECT repo, scan_id, {body} AS guidance_markdown FROM profile LEFT JOIN listed USING (repo, scan_id)
      LEFT JOIN coded USING (repo, scan_id)""")


def _prompts() -> str:
    counts = " || ',' || ".join(f"'\"{s}\":' || {s.lower()}" for s in rules.SEVERITIES)
    item = "'{\"entity_type\":\"' || entity_type || '\",\"severity\":\"' || severity || '\",\"file\":\"' || file || '\"}'"
    return _with(PROFILE, f""", sample AS (SELECT repo, scan_id, string_agg({item}, ',' ORDER BY finding_index) AS items FROM findings
        WHERE finding_index < 25 GROUP BY ALL)
      SELECT repo, scan_id, {q(narrative.PROMPT_RULES)} || chr(10) || 'Scan report data:' || chr(10)
        || '{{"repository_identifier":"' || repo || '","total_findings":' || total_findings || ',"severity_counts":{{' || {counts}
        || '}},"risk_score":' || risk_score || ',"pipeline_status":"' || pipeline_status
        || '","risk_thresholds":{{"warning":20,"fail":50}},"findings_sample":[' || coalesce(items, '')
        || '],"findings_sample_is_truncated":' || (total_findings > 25) || '}}' || chr(10) || chr(10)
        || 'Write the executive summary paragraph now.' AS prompt FROM profile LEFT JOIN sample USING (repo, scan_id)""")
