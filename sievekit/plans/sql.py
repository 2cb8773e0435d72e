"""DuckDB SQL that says what the detection queries compute, made from the same rules."""

from __future__ import annotations

from sievekit.functions.rules import Rule, duckdb_pattern
from sievekit.functions.scalars import NARROW, PROD_WORDS, TAG_WEIGHTS, TEST_WORDS, WIDE
from sievekit.functions.validators import NAME_LABELS, NO_NAMES, NO_NAMES_ASCII, PREFECTURES, TEST_CARDS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines(source: str = "documents", path: str = "CAST(doc_id AS VARCHAR)", text: str = "text") -> str:
    return f"""
texts AS (SELECT {path} AS path, {text} AS text FROM {source} WHERE {text} IS NOT NULL AND {text} <> ''),
split AS (SELECT path, CASE WHEN text LIKE '%' || chr(10) THEN string_split_regex(text, '\\r?\\n')[:-2] ELSE string_split_regex(text, '\\r?\\n') END AS ls FROM texts),
lines AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line, ls FROM split)"""


def _luhn(t: str) -> str:
    """Whether some run of digit groups in text t passes Luhn's check: each group may begin a card, as validators.luhn has it."""
    return f"""list_bool_or(list_transform(regexp_extract_all({t}, '[0-9]+(?:[ \\t\\-　][0-9]+)*[ \\t\\-　]?'), lambda run: right(run, 1) BETWEEN '0' AND '9' AND coalesce(list_bool_or(list_transform(
  range(1, len(string_split_regex(run, '[ \\t\\-　]')) + 1), lambda i: {_card("string_split_regex(run, '[ \\t\\-　]')", "i")})), FALSE)))"""


def _card(groups: str, i: str) -> str:
    digits = f"array_to_string({groups}[{i}:], '')"
    total = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({digits})[k] AS INT) WHEN reverse({digits})[k] > '4' THEN CAST(reverse({digits})[k] AS INT) * 2 - 9 ELSE CAST(reverse({digits})[k] AS INT) * 2 END))"
    known = ", ".join(quoted(c) for c in sorted(TEST_CARDS))
    before = f"({i} > 1 AND length({groups}[{i} - 1]) >= 4 AND length({groups}[{i} - 1]) + length({digits}) <= 19)"
    return f"(length({digits}) BETWEEN 13 AND 19 AND {digits} NOT IN ({known}) AND NOT {before} AND ({i} = len({groups}) OR length({groups}[{i}]) >= 4) AND {total} % 10 = 0)"


def fits(validator: str | None, hit: str) -> str:
    """Whether a match passes its rule's validator."""
    narrow = f"translate({hit}, {quoted(WIDE)}, {quoted(NARROW)})"
    digits = f"translate({hit}, {quoted(WIDE[:10])}, {quoted(NARROW[:10])})"
    if validator == "jp_mynumber_len12":
        joined = digits
        for _ in range(2):
            joined = f"regexp_replace({joined}, '([0-9])[ \\t　\\\\\\-－―‐‑–—ー]+([0-9])', '\\1\\2', 'g')"
        return f"coalesce(list_bool_or(list_transform(regexp_extract_all({joined}, '[0-9]+'), lambda x: length(x) = 12)), FALSE)"
    if validator == "jp_phone_mobile":
        return f"regexp_matches(regexp_replace({digits}, '[^0-9]', '', 'g'), '^0[789]0[0-9]{{8}}$')"
    if validator == "luhn":
        return f"coalesce({_luhn(digits)}, FALSE)"
    if validator == "jp_address_prefecture_city_block":
        rest = f"regexp_extract({narrow}, '(?s)(?:{'|'.join(PREFECTURES)})(.*)$', 1)"
        city = f"length(regexp_extract(substr({rest}, 1, 40), '(?s)^[^市区町村]*[市区町村]'))"
        return f"({city} > 0 AND regexp_matches(substr({rest}, {city} + 1, 40), '[0-9][丁番号条]|[0-9]-[0-9]'))"
    if validator == "jp_person_name_keyword":
        label = "CASE " + " ".join(f"WHEN contains({narrow}, {quoted(w)}) THEN {quoted(w)}" for w in NAME_LABELS) + " END"
        raw = f"regexp_replace(substr({narrow}, strpos({narrow}, {label}) + length({label})), '^[\\s\\p{{Z}}]+', '')"
        value = f"regexp_replace(regexp_replace({raw}, '^[:：=は\\- \\t　\"'']+', ''), '^[\\s\\p{{Z}}\"'']+|[\\s\\p{{Z}}\"'']+$', '', 'g')"
        solid = f"regexp_replace({value}, '[\\s\\p{{Z}}]+', '', 'g')"
        no = " OR ".join([*(f"contains(lower({value}), {quoted(w)})" for w in NO_NAMES_ASCII), *(f"contains({value}, {quoted(w)})" for w in NO_NAMES)])
        japanese = "[ぁ-ゖァ-ヺ一-\\x{9fff}]"
        words = f"string_split_regex({value}, '[\\s\\p{{Z}}]+')"
        return f"(NOT starts_with({raw}, 'を') AND length({solid}) BETWEEN 2 AND 40 AND NOT ({no}) AND CASE WHEN regexp_matches({value}, '{japanese}') THEN regexp_full_match({solid}, '{japanese}+') ELSE len({words}) BETWEEN 2 AND 4 AND list_bool_and(list_transform({words}, lambda w: regexp_full_match(w, '[A-Za-z]{{2,}}'))) END)"
    return "TRUE"


def spans_of(rule: Rule, number: int, narrow: bool = True) -> str:
    """The matches of a rule as a table span<number>: what stands between matches and the matches alternate.  Rules of Japanese data read the line as it is and narrowed."""
    p = quoted(duckdb_pattern(rule.pattern))
    t = f"translate(line, {quoted(WIDE)}, {quoted(NARROW)})"
    read = "SELECT *, line AS t FROM lines" + (f" UNION ALL SELECT *, {t} AS t FROM lines WHERE {t} <> line" if narrow and rule.normalises else "")
    keep = "TRUE"
    if rule.id == "pii.jp.postal_code":
        keep = r"NOT regexp_matches(substr(line, 1, start), '(バージョン|(^|[^0-9A-Za-z_])(?i:version|build|release|rev|commit))[\s:=\-：＝]*$')"
    if rule.id == "pii.jp.mynumber.unlabeled":
        keep = "NOT regexp_matches(substr(line, CAST(greatest(0, start - 24) AS INT) + 1, CAST(stop + 16 - greatest(0, start - 24) AS INT)), '注文番号|受付番号|伝票番号|(?i:order|receipt|ticket)')"
    return f"""
hit{number} AS (SELECT path, line_number, line, ls, t, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM ({read}) WHERE regexp_matches(t, {p})),
at{number} AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit{number}),
pos{number} AS (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start FROM at{number}),
both{number} AS (SELECT *, CAST(start + length(m[i]) AS INT) AS stop, m[i] AS hit FROM pos{number}),
span{number} AS (SELECT DISTINCT path, line_number, line, ls, {number} AS rule, start, stop FROM both{number} WHERE {keep} AND {fits(rule.validator, "hit")})"""


def filtered(rules: list[Rule], source: str, path: str, text: str, placeholder: str = "<REDACTED>") -> str:
    """Each line with its islands replaced by their winners' placeholders: by priority, then length, then the earlier start."""
    chosen = [k for k, r in enumerate(rules) if r.enabled]
    parts = [lines(source, path, text)] + [spans_of(rules[k], k, narrow=False) for k in chosen]
    union = " UNION ALL ".join(f"SELECT * FROM span{k}" for k in chosen)
    word = "CASE rule " + " ".join(f"WHEN {k} THEN {quoted(r.placeholder or placeholder)}" for k, r in enumerate(rules)) + " END"
    rank = "CASE rule " + " ".join(f"WHEN {k} THEN {r.score + (5 if r.id.startswith('log.') else 0)}" for k, r in enumerate(rules)) + " END"
    parts.append(f"""
running AS (SELECT *, {word} AS word, {rank} AS rank, max(stop) OVER (PARTITION BY path, line_number ORDER BY start, stop, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({union})),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY path, line_number ORDER BY start, stop, rule ROWS UNBOUNDED PRECEDING) AS island FROM running),
islands AS (SELECT path, line_number, any_value(line) AS line, island, min(start) AS start, max(stop) AS stop, arg_max(word, (rank, stop - start, -start, word)) AS word FROM marked GROUP BY path, line_number, island),
gaps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY path, line_number ORDER BY start), 0) AS done FROM islands),
hidden AS (SELECT path, line_number, string_agg(substr(line, done + 1, start - done) || word, '' ORDER BY start) || substr(any_value(line), CAST(max(stop) AS INT) + 1) AS changed FROM gaps GROUP BY path, line_number),
filtered AS (SELECT lines.path, CAST(lines.line_number AS BIGINT) AS line_number, coalesce(changed, line) AS line FROM lines LEFT JOIN hidden USING (path, line_number))""")
    return "WITH " + ",".join(parts)


def _case(rules: list[Rule], value) -> str:
    return "CASE rule " + " ".join(f"WHEN {k} THEN {value(r)}" for k, r in enumerate(rules)) + " END"


def findings(rules: list[Rule], source: str = "documents", path: str = "CAST(doc_id AS VARCHAR)", text: str = "text", marker: str = "sieve:ignore", placeholder: str = "<REDACTED>") -> str:
    """WITH ... up to a table findings."""
    chosen = [k for k, r in enumerate(rules) if r.enabled]
    parts = [lines(source, path, text)] + [spans_of(rules[k], k) for k in chosen]
    union = " UNION ALL ".join(f"SELECT * FROM span{k}" for k in chosen)
    generic = f"((contains(line, '# {marker}') OR contains(line, '// {marker}')) AND NOT contains(line, '{marker}='))"
    weights = lambda r: r.base + sum(TAG_WEIGHTS.get(t, 0) for t in r.tags)
    words = lambda ws: " OR ".join(f"contains(near, {quoted(w)})" for w in ws)
    parts.append(f"""
found AS (SELECT * FROM ({union}) WHERE NOT {generic} AND NOT contains(line, '{marker}=' || {_case(rules, lambda r: quoted(r.id))})),
running AS (SELECT *, max(stop) OVER (PARTITION BY path, line_number ORDER BY start, stop, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY path, line_number ORDER BY start, stop, rule ROWS UNBOUNDED PRECEDING) AS island FROM running),
islands AS (SELECT path, line_number, any_value(line) AS line, island, min(start) AS start, max(stop) AS stop FROM marked GROUP BY path, line_number, island),
gaps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY path, line_number ORDER BY start), 0) AS done FROM islands),
masked AS (SELECT path, line_number, string_agg(substr(line, done + 1, start - done) || {quoted(placeholder)}, '' ORDER BY start) || substr(any_value(line), CAST(max(stop) AS INT) + 1) AS masked_snippet FROM gaps GROUP BY path, line_number),
scored AS (SELECT found.*, masked_snippet, lower(line || chr(10) || coalesce(array_to_string(ls[greatest(1, line_number - {_case(rules, lambda r: r.context_lines_before)}):line_number - 1], chr(10)), '')) AS near FROM found JOIN masked USING (path, line_number)),
findings AS (SELECT path, CAST(line_number AS BIGINT) AS line_number, line, {_case(rules, lambda r: quoted(r.id))} AS rule_id, substr(line, start + 1, stop - start) AS matched_content,
  CAST(strlen(substr(line, 1, start)) AS BIGINT) AS byte_start, CAST(strlen(substr(line, 1, stop)) AS BIGINT) AS byte_end,
  CAST(start + length(regexp_replace(substr(line, 1, start), '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS BIGINT) AS utf16_start, CAST(stop + length(regexp_replace(substr(line, 1, stop), '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS BIGINT) AS utf16_end,
  {_case(rules, lambda r: quoted(r.severity))} AS severity, {_case(rules, lambda r: quoted(r.category))} AS category, masked_snippet,
  CAST(greatest(0, least(100, {_case(rules, weights)} - CASE WHEN {words(TEST_WORDS)} THEN 10 ELSE 0 END + CASE WHEN {words(PROD_WORDS)} THEN 10 ELSE 0 END)) AS INT) AS score,
  'sha256:' || sha256({_case(rules, lambda r: quoted(r.id))} || '|' || path || '|' || CAST(line_number AS VARCHAR) || '|' || masked_snippet) AS fingerprint FROM scored),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'Critical' WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS grade FROM findings)""")
    return "WITH " + ",".join(parts)


def rewritten(rules: list[Rule], source: str = "documents", path: str = "CAST(doc_id AS VARCHAR)", text: str = "text", placeholder: str = "<REDACTED>") -> str:
    """WITH ... up to a table rewritten: all texts with masked lines, joined by \\n.  Rows are numbered, so those that share a path stay apart."""
    rows = f"WITH numbered AS MATERIALIZED (SELECT CAST(row_number() OVER () AS VARCHAR) AS row, {path} AS path, {text} AS text FROM {source}),"
    return rows + findings(rules, "numbered", "row", "text", placeholder=placeholder).removeprefix("WITH ") + """,
joined AS (SELECT path AS row, string_agg(coalesce(masked_snippet, line), chr(10) ORDER BY line_number) AS text FROM lines LEFT JOIN masked USING (path, line_number) GROUP BY path),
rewritten AS (SELECT numbered.path, coalesce(joined.text, numbered.text) AS text FROM numbered LEFT JOIN joined USING (row))"""
