"""DuckDB SQL that gives the results of ``mailrisk.plans.queries`` independently.

The queries share one chain of common table expressions; an engine only runs the
ones a query needs.  Rule values come from ``mailrisk.rules``, logic is plain SQL.
"""

from mailrisk import rules
from mailrisk.plans.views import EMPTY_VARIANT, GAUGES, VARIANTS

# --- helpers -----------------------------------------------------------------
NOT_WORD = r"[^\p{L}\p{N}_]"
WORD_CHARS = r"\p{L}\p{N}_"


def lit(text):
    return "'" + str(text).replace("'", "''") + "'"


def texts(values):
    return "([" + ", ".join(lit(v) for v in values) + "]::VARCHAR[])"


def case(subject, pairs, default):
    whens = " ".join(f"WHEN {a} THEN {b}" for a, b in pairs)
    return f"CASE {subject} {whens} ELSE {default} END"


def body(pattern):
    """A rule pattern without word edges, shorthands as explicit classes."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return inner.replace(r"\w", f"[{WORD_CHARS}]")


def hit(column, patterns):
    """Some pattern matches as whole words."""
    union = "|".join(f"(?:{body(p)})" for p in patterns)
    return f"regexp_matches({column}, {lit(f'(?:^|{NOT_WORD})(?:{union})(?:$|{NOT_WORD})')})"


def n_hits(column, patterns):
    return " + ".join(f"{hit(column, [p])}::INT" for p in patterns)


def n_matches(doubled, patterns):
    """Matches in a text whose separators are doubled, so edges are not shared."""
    return " + ".join(
        f"len(regexp_extract_all({doubled}, {lit(f'(?:^|{NOT_WORD})(?:{body(p)})(?:$|{NOT_WORD})')}))"
        for p in patterns
    )


def has_any(column, words):
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def compact(*pairs):
    """List of the values whose condition holds."""
    items = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def fold(text, matches, mask):
    return (
        f"list_reduce({matches}, lambda acc, m: replace(acc, m, {mask}), {text})"
    )


def middle(value, keep):
    return (
        f"left({value}, {keep}) || repeat('*', length({value}) - {2 * keep})"
        f" || right({value}, {keep})"
    )


EMAIL, PHONE = lit("(?i)" + rules.EMAIL_PATTERN), lit(rules.PHONE_PATTERN)
ACCOUNT, CARD = lit("(?i)" + rules.ACCOUNT_PATTERN), lit(rules.CARD_PATTERN)
MASK_EMAIL = """CASE WHEN NOT contains(m, '@') THEN m
  WHEN length(split_part(m, '@', 1)) <= 2
    THEN repeat('*', length(split_part(m, '@', 1))) || substr(m, strpos(m, '@'))
  ELSE left(m, 1) || repeat('*', strpos(m, '@') - 3) || substr(m, strpos(m, '@') - 1) END"""
MASK_CARD = (
    "left(regexp_replace(m, '[-\\s]', '', 'g'), 4) || '********' ||"
    " right(regexp_replace(m, '[-\\s]', '', 'g'), 4)"
)


def mask_emails(t):
    return fold(t, f"regexp_extract_all({t}, {EMAIL})", MASK_EMAIL)


def mask_phones(t):
    return fold(t, f"regexp_extract_all({t}, {PHONE})", middle("m", 3))


def mask_accounts(t):
    return fold(t, f"regexp_extract_all({t}, {ACCOUNT}, 1)", middle("m", 2))


def mask_cards(t):
    return fold(t, f"regexp_extract_all({t}, {CARD})", MASK_CARD)


# --- derived tables ----------------------------------------------------------
def variant(part, v="doc_id % 8"):
    return case(v, [(i, lit(row[part])) for i, row in enumerate(VARIANTS)], "NULL")


def files(row):
    rows = ", ".join(
        f"{{'filename': {lit(n)}, 'mime': {lit(m)}, 'size': {s}::BIGINT, 'hash': ''}}"
        for n, m, s in row[3]
    )
    return f"[{rows}]::STRUCT(filename VARCHAR, mime VARCHAR, size BIGINT, hash VARCHAR)[]"


def squeezed(t):
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def cleaned(t):
    return f"lower({squeezed(f'''regexp_replace({t}, '&[a-zA-Z0-9#]+;', ' ', 'g')''')})"


def signal_columns(c, d):
    """Text signals from clean text ``c`` and its doubled form ``d``."""
    names = [n for group in rules.BRAND_NAMES.values() for n in group]
    threat = "|".join(f"(?:{body(p)})" for p in rules.THREAT_PATTERNS)
    threat_pattern = lit(f"(?:^|{NOT_WORD})({threat})(?:$|{NOT_WORD})")
    return f"""
  least((({n_hits(c, rules.URGENCY_PATTERNS)}) + 0.5::DOUBLE * ({n_hits(c, rules.TIME_PATTERNS)})) / 8::DOUBLE, 1.0) AS urgency,
  {hit(c, rules.CREDENTIAL_PATTERNS)} OR ({has_any(c, rules.CREDENTIAL_WORDS)} AND {has_any(c, rules.CREDENTIAL_ACTIONS)}) AS credential_request,
  {hit(c, rules.PAYMENT_PATTERNS)} OR ({has_any(c, rules.PAYMENT_WORDS)} AND {has_any(c, rules.PAYMENT_ACTIONS)}) AS payment_request,
  {n_matches(d, rules.ERROR_PATTERNS)} + regexp_matches({c}, '[!?]{{2,}}')::INT
    + regexp_matches({c}, '[{WORD_CHARS}][!?.,;:][{WORD_CHARS}]')::INT AS lexical_errors,
  list_filter({texts(names)}, lambda b: contains({c}, b)) AS brands,
  {compact(*[(hit(c, [n]), lit(n)) for n in names])} AS word_brands,
  list_sort(list_distinct(list_concat(
    list_transform(regexp_extract_all({d}, {threat_pattern}, 1), lambda t: replace(t, '  ', ' ')),
    list_filter({texts(rules.THREAT_PHRASES)}, lambda t: contains({c}, t))))) AS threats"""


def header(name, raw):
    return f"regexp_extract({raw}, '(?im)^{name}:[ \\t]*([^\\n]*(?:\\n[ \\t][^\\n]*)*)', 1)"


def header_columns(raw):
    return f"""
  {header('authentication-results', raw)} AS auth_field,
  {header('received-spf', raw)} AS spf_field,
  {header('dkim-signature', raw)} AS dkim_field,
  {header('from', raw)} AS from_field,
  {header('reply-to', raw)} AS reply_field,
  regexp_extract_all({raw}, '(?im)^received:[ \\t]*([^\\n]*(?:\\n[ \\t][^\\n]*)*)', 1) AS hops"""


def mailbox_columns(field, prefix):
    return f"""
  CASE WHEN contains({field}, '<') THEN trim(replace(split_part({field}, '<', 1), '"', ''))
    ELSE regexp_extract({field}, '\\(([^)]*)\\)', 1) END AS {prefix}_name,
  CASE WHEN contains({field}, '<') THEN regexp_extract({field}, '<([^>]*)>', 1)
    ELSE split_part({field}, ' ', 1) END AS {prefix}_address"""


def auth_columns():
    return """
  CASE WHEN contains(lower(auth_field), 'spf=pass') THEN 'pass'
    WHEN contains(lower(auth_field), 'spf=fail') THEN 'fail'
    WHEN contains(lower(auth_field), 'spf=softfail') THEN 'softfail'
    WHEN contains(lower(auth_field), 'spf=neutral') THEN 'neutral'
    WHEN contains(lower(spf_field), 'pass') THEN 'pass'
    WHEN contains(lower(spf_field), 'fail') THEN 'fail' ELSE 'none' END AS spf,
  CASE WHEN contains(lower(auth_field), 'dkim=pass') THEN 'pass'
    WHEN contains(lower(auth_field), 'dkim=fail') THEN 'fail'
    WHEN dkim_field <> '' THEN 'neutral' ELSE 'none' END AS dkim,
  CASE WHEN contains(lower(auth_field), 'dkim=pass')
    THEN regexp_extract(dkim_field, 'd=([^;]+)', 1) ELSE '' END AS dkim_domain,
  CASE WHEN contains(lower(auth_field), 'dmarc=pass') THEN 'pass'
    WHEN contains(lower(auth_field), 'dmarc=fail') THEN 'fail' ELSE 'none' END AS dmarc,
  CASE WHEN contains(lower(auth_field), 'dmarc=pass') THEN ''
    ELSE regexp_extract(lower(auth_field), 'dmarc=fail[^;]*policy\\.([^;]+)', 1) END AS dmarc_policy"""


def spoof():
    steps = []
    for pattern in rules.DISPLAY_BRAND_PATTERNS:
        brand = next((b for b in rules.BRAND_DOMAINS if b in pattern), None)
        known = (
            " OR ".join(
                f"ends_with(lower(split_part(from_address, '@', -1)), {lit(d)})"
                for d in rules.BRAND_DOMAINS[brand]
            )
            if brand
            else "false"
        )
        steps.append(f"(regexp_matches(lower(from_name), {lit(pattern)}) AND NOT ({known}))")
    return "from_name <> '' AND from_address <> '' AND (" + " OR ".join(steps) + ")"


def hop_list(hop):
    return compact(
        *[
            (f"contains(lower({hop}), {lit(t)})", lit(f"Suspicious TLD: {t}"))
            for t in rules.HOP_TLDS
        ],
        (f"regexp_matches({hop}, {lit(rules.PRIVATE_IP_PATTERN)})", "'Private IP in routing'"),
        (
            f"NOT regexp_matches(lower({hop}), 'by [^\\n]+ for [^\\n]+')",
            "'Malformed received header'",
        ),
    )


def findings_columns():
    return f"""
  CASE WHEN dmarc = 'fail' OR (spf = 'fail' AND dkim = 'fail') THEN 'fail'
    WHEN spf IN ('pass', 'neutral') AND dkim = 'pass' THEN 'ok'
    WHEN spf = 'fail' OR dkim = 'fail' THEN 'mismatch' ELSE 'ok' END AS auth,
  reply_field <> '' AND from_address <> '' AND reply_address <> ''
    AND lower(from_address) <> lower(reply_address)
    AND lower(split_part(from_address, '@', 2)) <> lower(split_part(reply_address, '@', 2))
    AS reply_to_mismatch,
  {spoof()} AS display_name_spoof,
  contains(lower(from_field), 'xn--') OR contains(lower(reply_field), 'xn--') AS punycode,
  len(flatten(list_transform(hops, lambda h: {hop_list('h')}))) >= 2 AS suspicious_received"""


HEADER_SCORE = """least(CASE auth WHEN 'fail' THEN 35.0 WHEN 'mismatch' THEN 20.0 ELSE 0.0 END
  + CASE WHEN reply_to_mismatch THEN 15 ELSE 0 END + CASE WHEN display_name_spoof THEN 25 ELSE 0 END
  + CASE WHEN punycode THEN 20 ELSE 0 END + CASE WHEN suspicious_received THEN 10 ELSE 0 END, 100)::DOUBLE"""

TEXT_SCORE = """least(urgency * 20 + CASE WHEN credential_request THEN 30 ELSE 0 END
  + CASE WHEN payment_request THEN 25 ELSE 0 END + least(lexical_errors * 3, 15)
  + least(len(brands) * 5, 15) + least(len(threats) * 8, 20), 100)::DOUBLE"""


def attachment_points(f):
    ext = " OR ".join(f"ends_with(lower({f}.filename), {lit(e)})" for e in rules.RISKY_EXTENSIONS)
    return f"""(CASE WHEN {ext} THEN 25.0 ELSE 0 END
  + CASE WHEN contains(lower({f}.mime), 'executable') OR contains(lower({f}.mime), 'application/x-') THEN 15 ELSE 0 END
  + CASE WHEN {f}.size > 52428800 THEN 5 WHEN {f}.size = 0 THEN 10 ELSE 0 END)::DOUBLE"""


ATTACHMENT_SCORE = (
    "least(coalesce(list_sum(list_transform(attachments, lambda f: "
    + attachment_points("f")
    + ")), 0), 100)::DOUBLE"
)

TEXT_URL = lit(
    r"(?i)https?://[-\p{L}\p{N}_.]+[:\d]*(?:/[\p{L}\p{N}_/.]*(?:\?[\p{L}\p{N}_&=%.]*)?(?:#[\p{L}\p{N}_.]*)?)?"
)
HTML_LINKS = (
    "list_filter(list_transform(regexp_extract_all(raw_html, "
    + lit(r"""<(?:a|img|form)\s[^>]*?(?:href|src|action)=["']([^"']*)["']""")
    + ", 1), lambda u: replace(u, '&amp;', '&')), "
    "lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://'))"
)


def text_link_list(t):
    return f"regexp_extract_all({t}, {TEXT_URL})"


def url_table(name, source, text):
    """Distinct URLs per message by first appearance."""
    return f"""
{name}_all AS (
  SELECT message_id, unnest(l) AS url, generate_subscripts(l, 1) AS i FROM (
    SELECT message_id, list_concat({HTML_LINKS}, {text_link_list(text)}) AS l FROM {source})),
{name}_first AS (SELECT message_id, url, min(i) AS i FROM {name}_all GROUP BY ALL),
{name} AS (
  SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY i) - 1 AS pos, url
  FROM {name}_first)"""


DOMAIN = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
LAST_TWO = "regexp_extract(domain, '([^.]*\\.)?[^.]*$')"
LAST_THREE = "regexp_extract(domain, '([^.]*\\.)?([^.]*\\.)?[^.]*$')"
SIMILARITY = (
    f"list_max(list_transform({texts(rules.LOOKALIKE_BRANDS)}, lambda b: "
    "1.0::DOUBLE - levenshtein(registered, b)::DOUBLE / greatest(length(registered), length(b))))"
)


def url_facts(name, source):
    pattern = " OR ".join(
        f"regexp_matches(url, {lit('(?i)' + p)})" for p in rules.URL_PATTERNS
    )
    return f"""
{name}_d AS (SELECT *, {DOMAIN} AS domain FROM {source}),
{name}_r AS (
  SELECT *, CASE WHEN list_contains({texts(rules.PUBLIC_SUFFIXES)}, {LAST_TWO})
    THEN {LAST_THREE} ELSE {LAST_TWO} END AS registered FROM {name}_d),
{name} AS (
  SELECT *, ({pattern}) AS is_pattern,
    regexp_matches(url, '^https?://\\d+\\.\\d+\\.\\d+\\.\\d+') AS is_ip,
    list_contains({texts(rules.SHORTENERS)}, domain) AS is_shortener,
    NOT starts_with(lower(url), 'https:') AS no_https,
    CASE WHEN {SIMILARITY} > 0.7 THEN {SIMILARITY} END AS similarity
  FROM {name}_r)"""


def url_findings(name, facts, extra=""):
    t = rules.URL_REASONS
    reasons = compact(
        ("is_pattern", lit(t["pattern"])), ("is_ip", lit(t["ip"])),
        ("is_shortener", lit(t["shortener"])), ("no_https", lit(t["no_https"])),
        ("coalesce(similarity, 0) > 0.8", lit(t["similar"])),
        *([("redirects > 2", lit(t["redirects"])),
           ("age_days < 30 AND age_days <> 0", lit(t["young"]))] if extra else []),
    )
    return f"""
{name}_all AS (SELECT *, {reasons} AS reasons FROM {facts} {extra}),
{name} AS (
  SELECT message_id, pos, url, array_to_string(reasons[1:2], '; ') AS reason,
    CASE WHEN coalesce(similarity, 0) > 0.8 THEN 'high' WHEN no_https OR is_shortener THEN 'medium'
      WHEN is_ip THEN 'high' WHEN is_pattern THEN 'medium' ELSE 'low' END AS risk_level
  FROM {name}_all WHERE len(reasons) > 0)"""


URL_SCORE = """least(sum(CASE risk_level WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END)
  + CASE WHEN count(*) > 1 THEN least(count(*) * 5, 20) ELSE 0 END, 100)::DOUBLE"""

INTEL = """
  SELECT domain, DATE '2024-02-01' - (length(domain) * 3)::INT AS registered_on,
    length(domain) % 5 AS redirects, length(domain) % 7 = 0 AS blacklisted
  FROM (SELECT DISTINCT {domain} AS domain FROM {source}) WHERE NOT ends_with(domain, '.org')"""


def intel(source):
    return INTEL.format(domain=DOMAIN, source=source)


def intel_join(source):
    return f"""LEFT JOIN (SELECT domain AS intel_domain, redirects, blacklisted,
      date_diff('day', registered_on, DATE '2024-02-01') AS age_days
    FROM ({intel(source)})) ON intel_domain = domain"""


DESCRIPTIONS = compact(
    ("urgency > 0.3", "'Urgencia detectada (score: ' || printf('%.2f', round_even(urgency, 2)) || ')'"),
    ("credential_request", lit(rules.SIGNAL_TEXTS["credential"])),
    ("payment_request", lit(rules.SIGNAL_TEXTS["payment"])),
    ("lexical_errors > 2", "'Errores léxicos (' || lexical_errors || ')'"),
    ("len(brands) > 0", "'Marcas mencionadas: ' || array_to_string(brands[1:3], ', ')"),
    ("len(threats) > 0", lit(rules.SIGNAL_TEXTS["threats"])),
)
SUMMARY = (
    "CASE WHEN header_score <= 20 AND url_score <= 20 AND text_score <= 20 AND attachment_score <= 10"
    f" THEN {lit(rules.NO_SIGNALS_TEXT)} ELSE array_to_string("
    + compact(
        ("header_score > 20", "'Headers: riesgo ' || round_even(header_score, 0)::INT || '/100'"),
        ("url_score > 20", "'URLs: ' || n_findings || ' sospechosas, riesgo ' || round_even(url_score, 0)::INT || '/100'"),
        ("text_score > 20", "'NLP: ' || len(descriptions) || ' señales, riesgo ' || round_even(text_score, 0)::INT || '/100'"),
        ("attachment_score > 10", "'Adjuntos: riesgo ' || round_even(attachment_score, 0)::INT || '/100'"),
    )
    + ", '; ') END"
)
CRITICAL = compact(
    ("auth = 'fail'", lit(rules.CRITICAL_TEXTS["auth"])),
    ("n_high > 0", lit(rules.CRITICAL_TEXTS["url"])),
    ("credential_request", lit(rules.CRITICAL_TEXTS["credential"])),
)
LABEL_OF = "CASE WHEN {0} >= 60 THEN 'phishing' WHEN {0} >= 40 THEN 'sospechoso' ELSE 'seguro' END"


def by_label(part):
    def value(label):
        found = rules.FALLBACK_TEXTS[label][part]
        return lit(found) if part == 0 else lit("|".join(found))

    return f"CASE label WHEN 'phishing' THEN {value('phishing')} WHEN 'sospechoso' THEN {value('sospechoso')} ELSE {value('seguro')} END"


def scored(name, findings):
    return f"""
{name} AS (
  SELECT r.message_id, r.lang, r.v, r.raw_headers, r.text_body, r.text_r, r.hdr_r, r.attachments,
    h.*  EXCLUDE (message_id), s.* EXCLUDE (message_id), coalesce(n_findings, 0) AS n_findings,
    coalesce(n_high, 0) AS n_high, coalesce(u.url_score, 0) AS url_score,
    coalesce(url_text, '') AS url_text,
    {HEADER_SCORE} AS header_score, {TEXT_SCORE} AS text_score, {ATTACHMENT_SCORE} AS attachment_score,
    {DESCRIPTIONS} AS descriptions,
    header_score * 0.3::DOUBLE + coalesce(u.url_score, 0) * 0.4::DOUBLE + text_score * 0.25::DOUBLE + attachment_score * 0.05::DOUBLE AS total_score
  FROM red r JOIN rhead h USING (message_id) JOIN rsig s USING (message_id)
  LEFT JOIN (SELECT message_id, count(*) AS n_findings, count(*) FILTER (risk_level = 'high') AS n_high,
      {URL_SCORE} AS url_score,
      string_agg('• ' || url || ': ' || reason, chr(10) ORDER BY pos) AS url_text
    FROM {findings} GROUP BY message_id) u USING (message_id))"""


def policy(name, source):
    """Elevation, then label/score agreement; keeps the steps apart."""
    return f"""
{name}_e AS (
  SELECT *, len(critical) > 0 AND label = 'seguro' AS to_suspicious,
    len(critical) >= 2 AND label = 'sospechoso' AS to_phishing FROM {source}),
{name}_elevated AS (
  SELECT message_id, critical, total_score, summary, actions, signals,
    CASE WHEN to_suspicious THEN 'sospechoso' WHEN to_phishing THEN 'phishing' ELSE label END AS label,
    CASE WHEN to_suspicious THEN greatest(risk_score, 45) WHEN to_phishing THEN greatest(risk_score, 65)
      ELSE risk_score END AS risk_score,
    CASE WHEN to_suspicious THEN list_concat(['Señales críticas: ' || array_to_string(critical[1:2], ', ')], reasons)[1:3]
      ELSE reasons END AS reasons
  FROM {name}_e),
{name}_consistent AS ({consistent(source)}),
{name} AS ({consistent(f'{name}_elevated')})"""


def consistent(source):
    return f"""
  SELECT * EXCLUDE (label, risk_score),
    CASE WHEN label = 'seguro' AND risk_score >= 40 THEN 'sospechoso' ELSE label END AS label,
    CASE WHEN label = 'phishing' THEN greatest(risk_score, 60)
      WHEN label = 'sospechoso' THEN greatest(risk_score, 40) ELSE risk_score END AS risk_score
  FROM {source}"""


VERDICT = "message_id, label, risk_score, array_to_string(reasons, '|') AS top_reasons, summary, actions"
FALLBACK = f"""
  SELECT message_id, {LABEL_OF.format('total_score')} AS label, trunc(total_score)::INT AS risk_score,
    {texts(rules.FALLBACK_REASONS)} AS reasons, {by_label(0)} AS summary, {by_label(1)} AS actions,
    {lit(rules.FALLBACK_SIGNAL)} AS signals, {CRITICAL} AS critical, total_score"""

CHAIN = f"""
mail AS (
  SELECT doc_id AS message_id, lang, (doc_id % 8)::INT AS v,
    replace({variant(0)}, '{{id}}', doc_id::VARCHAR) AS raw_headers,
    replace({variant(2)}, '{{id}}', doc_id::VARCHAR) AS raw_html,
    CASE WHEN doc_id % 8 = {EMPTY_VARIANT} THEN ''
      ELSE replace({variant(1)}, '{{id}}', doc_id::VARCHAR) || text END AS text_body,
    {case('doc_id % 8', [(i, files(r)) for i, r in enumerate(VARIANTS)], 'NULL')} AS attachments
  FROM documents),
acc AS (SELECT * FROM mail WHERE v <> {EMPTY_VARIANT}),
red1 AS (SELECT *, {mask_emails('text_body')} AS t1, {mask_emails('raw_headers')} AS g1 FROM acc),
red2 AS (SELECT *, {mask_phones('t1')} AS t2, {mask_phones('g1')} AS g2 FROM red1),
red3 AS (SELECT *, {mask_accounts('t2')} AS t3, {mask_accounts('g2')} AS g3 FROM red2),
red AS (
  SELECT *, {mask_cards('t3')} AS text_r,
    regexp_replace({mask_cards('g3')}, '(?im)^(x-forwarded-for|x-real-ip|x-client-ip):[^\\n]*', '\\1: [IP_REDACTED]', 'g') AS hdr_r
  FROM red3),
hraw AS (SELECT message_id, {header_columns('raw_headers')} FROM acc),
hbox AS (SELECT *, {mailbox_columns('from_field', 'from')}, {mailbox_columns('reply_field', 'reply')}, {auth_columns()} FROM hraw),
head AS (SELECT *, {findings_columns()} FROM hbox),
rraw AS (SELECT message_id, {header_columns('hdr_r')} FROM red),
rbox AS (SELECT *, {mailbox_columns('from_field', 'from')}, {mailbox_columns('reply_field', 'reply')}, {auth_columns()} FROM rraw),
rhead AS (SELECT message_id, auth, reply_to_mismatch, display_name_spoof, punycode, suspicious_received
  FROM (SELECT *, {findings_columns()} FROM rbox)),
ctext AS (SELECT message_id, lang, {cleaned('text_body')} AS c FROM acc),
sig AS (SELECT message_id, lang, c, {signal_columns('c', 'd')}
  FROM (SELECT *, regexp_replace(c, '({NOT_WORD})', '\\1\\1', 'g') AS d FROM ctext)),
rtext AS (SELECT message_id, {cleaned('text_r')} AS c FROM red),
rsig AS (SELECT message_id, {signal_columns('c', 'd')}
  FROM (SELECT *, regexp_replace(c, '({NOT_WORD})', '\\1\\1', 'g') AS d FROM rtext)),
{url_table('urls', 'acc', 'text_body')},
{url_table('rurls', 'red', 'text_r')},
purls AS (
  SELECT 'page' AS origin, page_id AS message_id, 0 AS pos, url FROM pages
  UNION ALL SELECT 'mail', message_id, pos, url FROM urls),
{url_facts('facts', 'urls')},
{url_facts('pfacts', 'purls')},
{url_facts('rfacts', 'rurls')},
{url_findings('finds', 'facts')},
{url_findings('ifinds', 'facts', intel_join('urls'))},
{url_findings('rfinds', 'rfacts')},
{url_findings('rifinds', 'rfacts', intel_join('urls'))},
{scored('scored', 'rfinds')},
{scored('iscored', 'rifinds')},
fallback AS ({FALLBACK} FROM scored),
ifallback AS ({FALLBACK} FROM iscored),
reviews AS (
  SELECT message_id, [ 'phishing', 'seguro', 'sospechoso' ][message_id % 7 + 1] AS review_label,
    (message_id % 101)::INT AS review_score FROM acc WHERE message_id % 7 < 3),
combined AS (
  SELECT message_id, coalesce(review_label, label) AS label, coalesce(review_score, risk_score) AS risk_score,
    CASE WHEN review_label IS NULL THEN reasons ELSE ['a', 'b', 'c'] END AS reasons,
    CASE WHEN review_label IS NULL THEN summary ELSE repeat('x', 150) END AS summary,
    CASE WHEN review_label IS NULL THEN actions ELSE 'e' END AS actions,
    CASE WHEN review_label IS NULL THEN signals ELSE 's' END AS signals, critical, total_score
  FROM fallback LEFT JOIN reviews USING (message_id)),
{policy('final', 'fallback')},
{policy('ifinal', 'ifallback')},
{policy('cfinal', 'combined')},
log AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    CASE WHEN event_type = 'error' THEN 'Classification failed' ELSE 'HTTP request processed' END AS event,
    CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
    CASE WHEN event_type = 'view' THEN '/health' ELSE '/classify' END AS endpoint,
    CASE WHEN event_type = 'error' THEN [500, 400, 401][event_id % 3 + 1] ELSE 200 END AS status,
    floor(value * 20)::BIGINT AS duration_ms,
    CASE WHEN event_type = 'error'
      THEN ['internal_error', 'invalid_request', 'authentication_failed'][event_id % 3 + 1] END AS error_type,
    CASE WHEN event_type = 'purchase' THEN 'reviewer' ELSE 'api' END AS component,
    CASE WHEN event_type NOT IN ('error', 'view') THEN
      CASE WHEN event_id % 10 < 2 THEN 'phishing' WHEN event_id % 10 < 5 THEN 'sospechoso' ELSE 'seguro' END
    END AS classification,
    least((props->>'k')::INT, 100) AS risk_score, '10.0.0.' || (user_id % 50) AS remote_ip
  FROM events),
gauge AS (
  SELECT ts, metric, instance,
    CASE WHEN metric IN ('up', 'uptime_check') THEN (value > 8)::INT::DOUBLE
      WHEN metric = 'memory_limit' THEN 100.0
      WHEN metric IN ('restarts', 'deployment_failed') THEN (value > 60)::INT::DOUBLE
      ELSE least(value, 100.0) END AS value
  FROM (SELECT *, {texts(GAUGES)}[event_id % {len(GAUGES)} + 1] AS metric, 'i' || (user_id % 3) AS instance FROM events)),
truth AS (
  SELECT doc_id AS message_id, CASE WHEN toxic = 1 THEN 'phishing' ELSE 'seguro' END AS expected_label,
    CASE WHEN toxic = 1 THEN 70 ELSE 20 END AS expected_score FROM labels),
judged AS (SELECT f.*, expected_label, expected_score, lang FROM final f
  JOIN truth USING (message_id) JOIN acc USING (message_id)),
results AS (
  SELECT l.doc_id AS name, 'quality ' || quality AS category, expected_label, coalesce(label, '') AS label,
    coalesce(abs(f.risk_score - expected_score), -1) AS score_diff, coalesce(label = expected_label, false) AS label_ok,
    coalesce(abs(f.risk_score - expected_score) <= 20, false) AS score_ok,
    label_ok AND score_ok AS passed, f.label IS NOT NULL AND coalesce(duration_ms <= 3000, false) AS latency_ok
  FROM labels l JOIN truth t ON t.message_id = l.doc_id LEFT JOIN final f ON f.message_id = l.doc_id
  LEFT JOIN log ON event_id = l.doc_id)"""


def times(column="window_start"):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def bucket(width, column="ts"):
    return f"time_bucket(INTERVAL '{width}', {column})"


def sliding_rows(source, n, step, where="true"):
    """Rows repeated for each of the ``n`` windows of width ``n`` steps they fall in."""
    return f"""(SELECT l.*, {bucket(step)} - k * INTERVAL '{step}' AS window_start
      FROM {source} l, range({n}) r(k) WHERE {where})"""


N_5XX = "count(*) FILTER (status BETWEEN 500 AND 599)"
CLASSIFIED = "classification IS NOT NULL"
BOUNDS = [*rules.DURATION_BUCKETS, None]


def bound_rows():
    return ", ".join(
        "('+Inf', 1e18)" if b is None else f"('{b}', {b * 1000})" for b in BOUNDS
    )


def canonical(column):
    return case(
        f"lower({column})", [(lit(k), lit(v)) for k, v in rules.LABEL_SYNONYMS.items()], "'suspicious'"
    )


# every hour of the log and three rules on it, as runs of equal condition
HOURS = f"""
hours AS (
  SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL '1 hour')) AS ts FROM log),
hourly AS (
  SELECT date_trunc('hour', ts) AS ts, count(classification) AS n, count(*) AS n_all,
    {N_5XX} AS n_5xx, count(*) FILTER (classification = 'phishing') AS n_phishing FROM log GROUP BY 1),
ruled AS (
  SELECT ts, coalesce(n, 0) < 8 AS quiet_hour, n_5xx / n_all * 100 > 5 AS error_burst,
    n_phishing / nullif(n, 0) * 100 > 15 AS phishing_wave FROM hours LEFT JOIN hourly USING (ts)),
tick AS (
  SELECT rule, h.ts, coalesce(CASE rule WHEN 'quiet_hour' THEN quiet_hour WHEN 'error_burst' THEN error_burst
      ELSE phishing_wave END, false) AS breach,
    CASE rule WHEN 'quiet_hour' THEN 2 WHEN 'error_burst' THEN 1 ELSE 3 END AS hold_hours
  FROM hours h CROSS JOIN (VALUES ('quiet_hour'), ('error_burst'), ('phishing_wave')) r(rule)
  LEFT JOIN ruled USING (ts)),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts) - row_number() OVER (PARTITION BY rule, breach ORDER BY ts) AS run
  FROM tick),
since AS (SELECT *, min(ts) OVER (PARTITION BY rule, breach, run) AS since FROM runs)"""

ORACLES = {}


def oracle(name, select, extra=""):
    prefix = "WITH " + CHAIN + ("," + extra if extra else "")
    ORACLES[name] = prefix + "\n" + select


# --- sources and sinks -------------------------------------------------------
oracle("read_messages_json", """SELECT message_id, md5(text_body) AS text_md5, len(attachments)::INT AS n_attachments,
  CASE WHEN lang = 'en' THEN 'en-US' ELSE 'es-ES' END AS user_locale,
  CASE WHEN v = 4 THEN 'service@paypal.com' ELSE '' END AS trusted_senders FROM mail""")
EML = """
eml AS (SELECT message_id, raw_headers || chr(10) || chr(10) || text_body
    || repeat(chr(10) || 'Content-Disposition: attachment; x', len(attachments)) AS content FROM acc),
eml_lines AS (SELECT message_id, content, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
  SELECT message_id, content, string_split(content, chr(10)) AS l FROM eml)),
eml_blank AS (SELECT message_id, min(i) AS blank FROM eml_lines
  WHERE regexp_full_match(line, '[\\s]*') GROUP BY 1),
eml_sum AS (
  SELECT *, starts_with(line, 'From:') OR starts_with(line, 'Subject:') AS is_field,
    coalesce(sum(CASE WHEN i > blank AND NOT is_field THEN length(line) + 1 ELSE 0 END)
      OVER (PARTITION BY message_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM eml_lines JOIN eml_blank USING (message_id)),
eml_read AS (SELECT * FROM eml_sum)"""
oracle("parse_eml_files", """SELECT message_id,
  coalesce(trim(substr(max_by(line, i) FILTER (starts_with(line, 'From:')), 6)), 'Unknown') AS sender,
  coalesce(trim(substr(max_by(line, i) FILTER (starts_with(line, 'Subject:')), 9)), 'No Subject') AS subject,
  md5(string_agg(line, chr(10) ORDER BY i) FILTER (i < blank)) AS headers_md5,
  md5(coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (i > blank AND NOT is_field), '')) AS body_md5,
  ((length(any_value(content)) - length(replace(lower(any_value(content)), 'content-disposition: attachment', ''))) // 31)::INT AS attachment_count
FROM eml_read GROUP BY message_id""", EML)
RAW = """
raw AS (SELECT message_id, replace(raw_headers, chr(10), chr(13) || chr(10)) ||
  CASE WHEN message_id % 2 = 0 THEN chr(13) || chr(10) || chr(13) || chr(10) ELSE chr(13) || chr(10) END || text_body AS raw FROM mail),
cut AS (SELECT message_id, CASE WHEN contains(raw, chr(13) || chr(10) || chr(13) || chr(10))
  THEN split_part(raw, chr(13) || chr(10) || chr(13) || chr(10), 1) ELSE raw END AS head FROM raw)"""
oracle("split_raw_message", "SELECT message_id, md5(head) AS head_md5, length(head)::INT AS n_chars FROM cut", RAW)
HTML_TEXT = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,"
    " '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'),"
    " '<[^>]*>', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"
)
oracle("extract_mail_fields_pages", f"""SELECT page_id AS message_id, 'From: web@' || page_id AS raw_headers,
  md5(CASE WHEN page_id % 4 = 0 THEN url ELSE {HTML_TEXT} END) AS text_md5,
  'corp' || (page_id % 3) || '.example' AS owned_domains, 'es-ES' AS user_locale FROM pages""")
oracle("extract_review_fields_pages", """SELECT page_id AS message_id,
  'From: user' || (page_id % 7) || '@corp' || (page_id % 3) || '.example' || chr(10) || 'Subject: ' || url || chr(10) || 'Date: Mon, 1 Jan 2024' AS email_headers,
  md5(CASE WHEN page_id % 4 = 0 THEN url ELSE html END) AS body_md5,
  'user' || (page_id % 7) || '@corp' || (page_id % 3) || '.example' AS sender FROM pages""")
oracle("read_cases_json", """SELECT 'doc ' || message_id AS name, md5(text_body) AS text_md5,
  CASE expected_label WHEN 'phishing' THEN 'phishing_examples' ELSE 'legitimate_examples' END AS category,
  expected_label, expected_score FROM acc JOIN truth USING (message_id)""")
oracle("read_logs_lines", """SELECT endpoint, status, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms
FROM log WHERE event_id % 10 <> 3 GROUP BY ALL
UNION ALL SELECT 'corrupt', 0, count(*), 0 FROM log WHERE event_id % 10 = 3""")
oracle("write_verdict_table", """SELECT label, count(*) AS n, sum(risk_score)::BIGINT AS sum_score,
  sum(len(reasons))::BIGINT AS n_reasons FROM final GROUP BY label""")
oracle("export_metrics_table", f"""
SELECT 'requests_total' AS metric, 'endpoint=' || endpoint || ',method=' || method || ',status=' || status AS labels,
  count(*)::DOUBLE AS value FROM log GROUP BY ALL
UNION ALL SELECT 'classifications_total', 'classification=' || classification, count(*) FROM log WHERE {CLASSIFIED} GROUP BY ALL
UNION ALL SELECT 'errors_total', 'error_type=' || error_type, count(*) FROM log WHERE error_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'request_duration_seconds_bucket', 'le=' || le, count(*) FILTER (duration_ms <= ms)
  FROM log, (VALUES {bound_rows()}) b(le, ms) GROUP BY le
UNION ALL SELECT 'request_duration_seconds_sum', '', round(sum(duration_ms) / 1000, 6) FROM log
UNION ALL SELECT 'request_duration_seconds_count', '', count(*) FROM log""")

# --- validation --------------------------------------------------------------
oracle("require_content_split", f"""SELECT CASE WHEN v = {EMPTY_VARIANT} THEN 'invalid_request' ELSE 'accepted' END AS reason,
  lang, count(*) AS n FROM mail GROUP BY ALL""")
oracle("typed_ingest_lines", """SELECT 'accepted' AS reason, count(*) AS n, sum(len(attachments))::BIGINT AS n_attachments FROM mail WHERE v <> 1
UNION ALL SELECT 'invalid_type', count(*), 0 FROM mail WHERE v = 1""")
oracle("fill_message_defaults", """SELECT message_id, CASE WHEN lang = 'en' THEN 'en-US' ELSE 'es-ES' END AS user_locale,
  (v = 4)::INT AS n_trusted, 'example.com|empresa.com' AS owned_domains FROM mail""")
oracle("check_verdict_rows", """SELECT *, label_ok AND score_ok AND reasons_ok AND actions_ok AND summary_ok AS valid FROM (
  SELECT doc_id, doc_id % 5 < 3 AS label_ok, n_chars % 130 <= 100 AS score_ok, doc_id % 6 <= 3 AS reasons_ok,
    doc_id % 4 <= 3 AS actions_ok,
    length(text) <= 200 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 60 AS summary_ok
  FROM documents)""")

# --- text preparation --------------------------------------------------------
oracle("html_to_text", f"SELECT page_id, md5({HTML_TEXT}) AS text_md5, length({HTML_TEXT})::INT AS n_chars FROM pages")
oracle("clean_text", f"SELECT doc_id, md5({cleaned('text')}) AS text_md5, length({cleaned('text')})::INT AS n_chars FROM documents")
oracle("truncate_fields", """SELECT message_id, md5(left(raw_headers, 1000)) AS headers_md5, md5(left(text_body, 2000)) AS text_md5,
  array_to_string(string_split(text_body, ' ')[1:3], ' ') AS snippets,
  array_to_string(string_split(text_body, ' ')[1:5], ' ') AS metadata, 'example.com|empresa.com' AS owned_domains FROM acc""")

# --- redaction ---------------------------------------------------------------
oracle("mask_email", f"""SELECT c_custkey, {MASK_EMAIL} AS masked FROM (
  SELECT c_custkey, left(lower(c_name), (c_custkey % 18)::INT) || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '@' END
    || lower(c_mktsegment) || '.com' AS m FROM customer)""")
oracle("fingerprint", "SELECT doc_id, left(sha256(text), 16) AS fingerprint FROM documents")


def text_oracle(name, expression, source="acc"):
    oracle(name, f"SELECT message_id, md5(r) AS text_md5, length(r)::INT AS n_chars FROM (SELECT message_id, {expression} AS r FROM {source})")


text_oracle("redact_emails", mask_emails("text_body"))
text_oracle("redact_phones", mask_phones("text_body"))
text_oracle("redact_accounts", mask_accounts("text_body"))
text_oracle("redact_cards", mask_cards("text_body"))
text_oracle("redact_text", "text_r", "red")
PLACE = rules.PLACEHOLDERS


def place(name, source, pattern, kind, t):
    step = fold(t, f"regexp_extract_all({t}, {pattern})", lit(PLACE[kind]))
    return f"{name} AS (SELECT message_id, {step} AS p FROM {source})"


PLACED = ",\n".join([
    place("p1", "acc", EMAIL, "email", "text_body"), place("p2", "p1", PHONE, "phone", "p"),
    place("p3", "p2", ACCOUNT, "account", "p"), place("p4", "p3", CARD, "cc", "p"),
])
oracle("redact_placeholder", "SELECT message_id, md5(p) AS text_md5, length(p)::INT AS n_chars FROM p4", PLACED)
oracle("redaction_ledger", f"""SELECT message_id, (i - 1)::INT AS pos, e.kind AS kind, left(sha256(e.m), 16) AS fingerprint FROM (
  SELECT message_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT message_id, list_concat(
    list_transform(regexp_extract_all(text_body, {EMAIL}), lambda m: {{'kind': 'email', 'm': m}}),
    list_transform(regexp_extract_all(t1, {PHONE}), lambda m: {{'kind': 'phone', 'm': m}}),
    list_transform(regexp_extract_all(t2, {ACCOUNT}, 1), lambda m: {{'kind': 'account', 'm': m}}),
    list_transform(regexp_extract_all(t3, {CARD}), lambda m: {{'kind': 'cc', 'm': regexp_replace(m, '[-\\s]', '', 'g')}})) AS l FROM red))""")
oracle("redact_header_ips", "SELECT message_id, hdr_r AS headers FROM red")
SNIPPETS = PLACED + f""",
sentences AS (
  SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY i) AS k, s FROM (
    SELECT message_id, trim(unnest(l), E' \\t\\r\\n\\f\\v') AS s, generate_subscripts(l, 1) AS i
    FROM (SELECT message_id, regexp_split_to_array(p, '[.!?]+') AS l FROM p4))
  WHERE length(s) >= 20),
relevant AS (
  SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY k) AS k, s FROM sentences
  WHERE k <= 3 OR {has_any('lower(s)', rules.SNIPPET_KEYWORDS)}),
packed AS (
  SELECT message_id, k, s || '. ' AS piece, 1 AS piece_no FROM relevant WHERE k = 1
  UNION ALL
  SELECT r.message_id, r.k,
    CASE WHEN length(piece) + length(s) < 500 THEN piece || s || '. ' ELSE s || '. ' END,
    CASE WHEN length(piece) + length(s) < 500 THEN piece_no ELSE piece_no + 1 END
  FROM packed p JOIN relevant r ON r.message_id = p.message_id AND r.k = p.k + 1),
pieces AS (SELECT message_id, piece_no, trim(max_by(piece, k)) AS piece FROM packed GROUP BY ALL)"""
oracle("safe_snippets", """SELECT message_id, count(piece)::INT AS n_snippets,
  md5(coalesce(string_agg(piece, '|' ORDER BY piece_no), '')) AS snippets_md5
FROM acc LEFT JOIN pieces USING (message_id) GROUP BY message_id""", SNIPPETS)
ORACLES["safe_snippets"] = ORACLES["safe_snippets"].replace("WITH ", "WITH RECURSIVE ", 1)

# --- headers -----------------------------------------------------------------
oracle("parse_headers", """SELECT message_id, lower(split_part(line, ':', 1)) AS name,
  string_agg(regexp_replace(line, '^[^:]*:[ \\t]*', ''), '|' ORDER BY i) AS header_values FROM (
    SELECT message_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
      SELECT message_id, regexp_extract_all(raw_headers, '(?m)^[!-9;-~]+:[^\\n]*(?:\\n[ \\t][^\\n]*)*') AS l FROM acc))
GROUP BY ALL""")
oracle("spf_status", "SELECT message_id, spf FROM head")
oracle("dkim_status", "SELECT message_id, dkim AS status, dkim_domain AS domain FROM head")
oracle("dmarc_status", "SELECT message_id, dmarc AS status, dmarc_policy AS policy FROM head")
oracle("auth_status", "SELECT message_id, auth FROM head")
oracle("reply_to_mismatch", "SELECT message_id, reply_to_mismatch FROM head")
oracle("display_name_spoof", "SELECT message_id, display_name_spoof FROM head")
oracle("punycode_sender", "SELECT message_id, punycode FROM head")
oracle("suspicious_received", "SELECT message_id, suspicious_received FROM head")
BRAND_VALUES = ", ".join(
    f"({lit(b)}, {texts(ds)})" for b, ds in rules.BRAND_DOMAINS.items()
)
oracle("brand_domain_lookup", f"""SELECT domain, n_messages, brand,
  len(list_filter(domains, lambda d: ends_with(domain, d))) > 0 AS legitimate
FROM (SELECT lower(split_part(from_address, '@', -1)) AS domain, count(*) AS n_messages FROM hbox GROUP BY 1)
CROSS JOIN (VALUES {BRAND_VALUES}) b(brand, domains)""")
oracle("received_anomalies", f"""SELECT message_id, (i - 1)::INT AS hop, array_to_string({hop_list('h')}, '|') AS anomalies
FROM (SELECT message_id, unnest(hops) AS h, generate_subscripts(hops, 1) AS i FROM hraw)""")
oracle("header_score", f"SELECT message_id, {HEADER_SCORE} AS header_score FROM head")

# --- URLs --------------------------------------------------------------------
LINKS = "SELECT message_id, (i - 1)::INT AS pos, url FROM (SELECT message_id, unnest(l) AS url, generate_subscripts(l, 1) AS i FROM (SELECT message_id, {0} AS l FROM acc))"
oracle("html_links", LINKS.format(HTML_LINKS))
oracle("html_links_injected", """SELECT page_id, i::INT AS pos,
  CASE i WHEN 0 THEN 'https://x' || page_id || '.example/h?a=1&b=2' ELSE 'https://right.example/' || page_id END AS url
FROM pages CROSS JOIN (SELECT unnest([0, 1]) AS i)""")
oracle("text_links", LINKS.format(text_link_list("text_body")))
oracle("message_urls", "SELECT message_id, pos::INT AS pos, url FROM urls")
PAGE = "SELECT origin, message_id, pos::INT AS pos, "
oracle("url_domain", PAGE + "domain FROM pfacts")
oracle("suspicious_pattern", PAGE + "is_pattern AS suspicious FROM pfacts")
oracle("ip_host", PAGE + "is_ip FROM pfacts")
oracle("shortener", PAGE + "is_shortener FROM pfacts")
oracle("no_https", PAGE + "no_https FROM pfacts")
oracle("brand_similarity", PAGE + "coalesce(round(similarity, 6), 0) AS similarity FROM pfacts")
oracle("registered_domain", PAGE + f"""CASE
    WHEN regexp_matches(domain, '(^|\\.)www\\.tk$') THEN 'www.tk'
    WHEN regexp_matches(domain, '\\.tk$') OR regexp_matches(domain, '(^|\\.)example\\.net$') THEN {LAST_THREE}
    ELSE {LAST_TWO} END AS registered_domain FROM pfacts""")
oracle("domain_intel", PAGE + f"""coalesce(age_days, -1)::INT AS age_days, coalesce(redirects, -1)::INT AS redirects,
  coalesce(blacklisted, false) AS blacklisted FROM pfacts {intel_join('purls')}""")
oracle("url_findings", "SELECT message_id, pos::INT AS pos, url, reason, risk_level FROM finds")
oracle("url_findings_intel", "SELECT message_id, pos::INT AS pos, url, reason, risk_level FROM ifinds")
oracle("url_metadata", """SELECT message_id, pos::INT AS pos, url, domain, NOT no_https AS https, 0 AS redirections,
  CASE WHEN similarity > 0.8 THEN round(similarity, 6) ELSE 0 END AS similarity, false AS blacklist_hit,
  false AS analysis_failed FROM facts""")
oracle("url_score", f"SELECT message_id, count(*) AS n_findings, {URL_SCORE} AS url_score FROM finds GROUP BY 1")

# --- text signals ------------------------------------------------------------
oracle("urgency", "SELECT message_id, round(urgency, 6) AS urgency FROM sig")
oracle("credential_request", "SELECT message_id, credential_request FROM sig")
oracle("payment_request", "SELECT message_id, payment_request FROM sig")
oracle("lexical_errors", "SELECT message_id, lexical_errors::INT AS lexical_errors FROM sig")
oracle("language_mixing", f"""SELECT message_id, lang,
  ({n_hits('c', rules.SPANISH_PATTERNS)}) >= 1 AND ({n_hits('c', rules.ENGLISH_PATTERNS)}) >= 1 AS any_mix FROM ctext""")
oracle("brand_mentions", """SELECT message_id, array_to_string(brands, '|') AS brands,
  array_to_string(word_brands, '|') AS whole_word_brands FROM sig""")
oracle("top_brands", "SELECT brand, count(*) AS n_messages FROM (SELECT unnest(brands) AS brand FROM sig) GROUP BY 1")
oracle("threat_phrases", "SELECT message_id, array_to_string(threats, '|') AS threats FROM sig")
oracle("signal_descriptions", f"SELECT message_id, array_to_string({DESCRIPTIONS}, '|') AS descriptions FROM sig")
oracle("text_score", f"SELECT message_id, round({TEXT_SCORE}, 6) AS text_score FROM sig")
oracle("empty_text", f"""SELECT text_body = '' AS is_empty, count(*) AS n,
  round(coalesce(sum({TEXT_SCORE}) FILTER (text_body <> ''), 0), 6) AS total_score,
  coalesce(sum(len(brands) + len(threats)), 0)::BIGINT AS n_found
FROM mail LEFT JOIN sig USING (message_id) GROUP BY 1""")

# --- attachments -------------------------------------------------------------
oracle("attachment_scores", f"SELECT message_id, {ATTACHMENT_SCORE} AS attachment_score FROM acc")
oracle("attachment_report", f"""SELECT message_id, (i - 1)::INT AS pos, f.filename AS filename, {attachment_points('f')} AS points
FROM (SELECT message_id, unnest(attachments) AS f, generate_subscripts(attachments, 1) AS i FROM acc)""")
oracle("attachment_hash", """SELECT doc_id AS message_id, 'doc' || doc_id || '.txt' AS filename, 'text/plain' AS mime,
  strlen(text)::BIGINT AS size, 'sha256:' || sha256(text) AS hash FROM documents""")

# --- fusion, review, policy --------------------------------------------------
oracle("total_score", """SELECT message_id, header_score, url_score, round(text_score, 6) AS text_score, attachment_score,
  round(total_score, 6) AS total_score FROM scored""")
oracle("heuristic_summary", f"SELECT message_id, {SUMMARY} AS summary FROM scored")
oracle("review_request_rows", f"""SELECT message_id, md5(left(hdr_r, 1000)) AS headers_md5, md5(left(text_r, 2000)) AS text_md5,
  least(n_urls, 5)::INT AS n_urls, {SUMMARY} AS heuristic_summary, len(attachments)::INT AS n_attachments, (v = 4)::INT AS n_trusted,
  'example.com|empresa.com' AS owned_domains, CASE WHEN lang = 'en' THEN 'en-US' ELSE 'es-ES' END AS user_locale,
  35000 AS latency_budget_ms
FROM scored JOIN (SELECT message_id, count(url) AS n_urls FROM acc LEFT JOIN rurls USING (message_id) GROUP BY 1) USING (message_id)""")
oracle("reviewer_answers", """SELECT message_id, CASE WHEN contains(text_body, 'password')
  THEN '{"classification": "phishing", "risk_score": 77}' ELSE 'no idea' END AS response FROM acc""")
oracle("parse_review", """SELECT message_id, review_label AS label, review_score AS risk_score, 'a|b|c' AS top_reasons,
  150 AS summary_chars, 'e' AS actions, 'fail' AS auth FROM reviews""")
FLAT = f"SELECT {VERDICT}"
oracle("fallback_verdict", FLAT + " FROM fallback")
oracle("combined_review", FLAT + ", signals FROM combined")
oracle("critical_signals", "SELECT message_id, array_to_string(critical, '|') AS critical FROM fallback")
oracle("elevated_verdict", FLAT + " FROM cfinal_elevated")
oracle("score_label_consistency", FLAT + " FROM cfinal_consistent")
oracle("policy_verdict", FLAT + " FROM cfinal")
oracle("error_verdicts", f"""SELECT message_id, {lit(rules.ERROR_LABEL)} AS label, {rules.ERROR_SCORE} AS risk_score,
  {lit('|'.join(rules.ERROR_REASONS))} AS top_reasons, {lit(rules.ERROR_SUMMARY)} AS summary,
  {lit('|'.join(rules.ERROR_ACTIONS))} AS actions, {lit(rules.ERROR_SIGNAL)} AS signals FROM mail WHERE v = {EMPTY_VARIANT}""")
REMARKS = [
    "VEREDICTO: PHISHING", "VEREDICTO: SOSPECHOSO", "VEREDICTO: SPAM", "VEREDICTO: SEGURO",
    "Hay una estafa", "Es publicidad", "Mucha precaución", "Clasificación final: malicioso",
    "Clasificación final: seguro", "Es malicioso", "Presenta riesgos", "Parece un correo seguro", "",
]
WORDING = f"""
wording AS (SELECT conv_id, turn, lower(text || ' ' || {texts(REMARKS)}[(conv_id * 3 + turn) % {len(REMARKS)} + 1]) AS low FROM conversations)"""


def ladder(steps, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {default} END"


def four(part):
    def value(label, score, explanation):
        return lit((label, score, explanation, "|".join(rules.VERDICT_RECOMMENDATIONS[(label, score)]))[part])

    return ladder(
        [(f"contains(low, {lit(m)})", value(*r)) for m, *r in rules.VERDICT_MARKERS]
        + [(has_any("low", w), value(*r)) for w, *r in rules.VERDICT_KEYWORDS],
        value(*rules.VERDICT_DEFAULT),
    )


def filed(part):
    return ladder(
        [(f"contains(low, {lit(m)})", lit(r[part])) for m, *r in rules.FILE_MARKERS]
        + [(has_any("low", w), lit(r[part])) for w, *r in rules.FILE_KEYWORDS],
        lit(rules.FILE_DEFAULT[part]),
    )


oracle("four_class_verdict", f"""SELECT conv_id, turn, {four(0)} AS label, ({four(1)})::INT AS risk_score,
  {four(2)} AS explanation, {four(3)} AS recommendations FROM wording""", WORDING)
oracle("file_class_verdict", f"SELECT conv_id, turn, {filed(0)} AS label, ({filed(1)})::INT AS risk_score FROM wording", WORDING)
oracle("review_four_classes", f"""SELECT message_id, {four(0).replace('ELSE', 'WHEN low IS NULL THEN ' + lit(rules.FAILED_LABEL) + ' ELSE')} AS label,
  ({four(1).replace('ELSE', 'WHEN low IS NULL THEN ' + lit(rules.FAILED_SCORE) + ' ELSE')})::INT AS risk_score,
  coalesce(response, {lit(rules.FAILED_TEXT)}) AS analysis,
  {four(2).replace('ELSE', "WHEN low IS NULL THEN '' ELSE")} AS explanation,
  {four(3).replace('ELSE', 'WHEN low IS NULL THEN ' + lit('|'.join(rules.FAILED_RECOMMENDATIONS)) + ' ELSE')} AS recommendations,
  from_address || ',' || len(attachments) AS details FROM (
  SELECT *, lower(response) AS low FROM (
    SELECT message_id, from_address, attachments, CASE WHEN message_id % 4 <> 2 THEN
      ['VEREDICTO: PHISHING', 'veredicto: spam', 'Es una estafa', 'Todo bien', ''][message_id % 5 + 1] END AS response
    FROM hbox JOIN acc USING (message_id)))""")
oracle("four_class_request_rows", """SELECT message_id, from_address AS sender, 'mail ' || message_id AS subject,
  md5(text_body) AS body_md5, len(attachments)::INT AS n_attachments FROM hbox JOIN acc USING (message_id)""")
SPELLINGS = ["Phishing", "MALICIOUS", "sospechoso", "suspicious", "Spam", "seguro", "safe"]
oracle("canonical_label", f"""SELECT {canonical('raw')} AS label, count(*) AS n FROM (
  SELECT coalesce({texts(SPELLINGS)}[event_id % 9 + 1], event_type) AS raw FROM events) GROUP BY 1""")
oracle("risk_band", f"""SELECT CASE WHEN risk_score <= 30 THEN {lit(rules.RISK_BANDS[0][1])}
  WHEN risk_score <= 60 THEN {lit(rules.RISK_BANDS[1][1])} ELSE {lit(rules.RISK_BAND_TOP)} END AS band, count(*) AS n FROM log GROUP BY 1""")
EVIDENCE = compact(
    ("auth <> 'ok'", "'SPF/DKIM/DMARC: ' || auth"),
    *[(f, lit(rules.EVIDENCE_TEXTS[k])) for f, k in [
        ("reply_to_mismatch", "reply_to"), ("display_name_spoof", "spoof"),
        ("punycode", "punycode"), ("suspicious_received", "received")]],
)
oracle("evidence_text", f"""SELECT message_id,
  CASE WHEN len({EVIDENCE}) > 0 THEN array_to_string({EVIDENCE}, chr(10)) ELSE {lit(rules.NO_EVIDENCE_TEXT)} END AS headers,
  url_text AS urls, array_to_string(list_transform(descriptions, lambda s: '• ' || s), chr(10)) AS signals FROM scored""")
ROWS = "SELECT message_id, label, risk_score, array_to_string(reasons, '|') AS top_reasons, array_to_string(critical, '|') AS critical, round(total_score, 6) AS total_score FROM "
oracle("classify_mail", ROWS + "final")
oracle("classify_mail_intel", ROWS + "ifinal")
oracle("label_distribution", "SELECT label, count(*) AS n, sum(risk_score)::BIGINT AS sum_score FROM final GROUP BY label")

# --- monitoring --------------------------------------------------------------
oracle("request_counts", "SELECT method, endpoint, status, count(*) AS n_requests FROM log GROUP BY ALL")
oracle("duration_histogram", f"SELECT le, count(*) FILTER (duration_ms <= ms) AS n FROM log, (VALUES {bound_rows()}) b(le, ms) GROUP BY le")
oracle("duration_heatmap", f"""SELECT {times()}, le, n FROM (
  SELECT {bucket('6 hours')} AS window_start, le, count(*) FILTER (duration_ms <= ms) AS n FROM log, (VALUES {bound_rows()}) b(le, ms) GROUP BY 1, 2)""")
oracle("latency_quantiles", f"""SELECT {times()}, n_requests, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM (
  SELECT {bucket('1 hour')} AS window_start, count(*) AS n_requests, quantile_cont(duration_ms::DOUBLE, 0.5) AS p50,
    quantile_cont(duration_ms::DOUBLE, 0.95) AS p95, quantile_cont(duration_ms::DOUBLE, 0.99) AS p99 FROM log GROUP BY 1)""")
RATE = """SELECT {t}, round(a / {m}, 6) AS all_per_min, round(c / {m}, 6) AS classify_per_min, round(e / {m}, 6) AS errors_per_min FROM (
  SELECT {b} AS window_start, count(*) AS a, count(*) FILTER (endpoint = '/classify') AS c, {n} AS e FROM log GROUP BY 1)"""
oracle("request_rate", RATE.format(t=times(), m="60.0", b=bucket("1 hour"), n=N_5XX))
oracle("request_rate_minute", RATE.format(t=times(), m="1.0", b=bucket("1 minute"), n=N_5XX))
AVAILABLE = """SELECT {t}, n_all, round(share, 6) AS availability_pct, share < 99.5 AS breach FROM (
  SELECT window_start, count(*) AS n_all, count(*) FILTER (status NOT BETWEEN 500 AND 599) / count(*) * 100 AS share FROM {r} GROUP BY 1)"""
oracle("availability", AVAILABLE.format(t=times(), r=sliding_rows("log", 6, "1 hour")))
oracle("availability_10m", AVAILABLE.format(t=times(), r=sliding_rows("log", 10, "1 minute")))
oracle("error_rate", f"""SELECT {times()}, n_all, n_5xx, n_4xx, n_internal, round(n_5xx / n_all * 100, 6) AS error_pct,
  CASE WHEN n_5xx / n_all * 100 > 15 THEN 'critical' WHEN n_5xx / n_all * 100 > 5 THEN 'warning' ELSE 'ok' END AS severity,
  n_internal / 21600 > 0.1 AS internal_breach FROM (
  SELECT window_start, count(*) AS n_all, {N_5XX} AS n_5xx, count(*) FILTER (status BETWEEN 400 AND 499) AS n_4xx,
    count(*) FILTER (error_type = 'internal_error') AS n_internal FROM {sliding_rows('log', 6, '1 hour')} GROUP BY 1)""")
oracle("label_counts", f"""SELECT {times()}, safe, spam, suspicious, phishing FROM (
  SELECT {bucket('1 hour')} AS window_start, count(*) FILTER (classification = 'seguro') AS safe, 0::BIGINT AS spam,
    count(*) FILTER (classification = 'sospechoso') AS suspicious, count(*) FILTER (classification = 'phishing') AS phishing
  FROM log WHERE {CLASSIFIED} GROUP BY 1)""")
oracle("phishing_share", f"""SELECT {times()}, n_classified, n_phishing, round(n_phishing / n_classified * 100, 6) AS phishing_pct,
  n_phishing / n_classified * 100 > 25 AS breach FROM (
  SELECT window_start, count(*) AS n_classified, count(*) FILTER (classification = 'phishing') AS n_phishing
  FROM {sliding_rows('log', 6, '1 hour', CLASSIFIED)} GROUP BY 1)""")
oracle("low_volume", f"""SELECT {times()}, round(coalesce(n, 0) / 10, 6) AS per_minute, coalesce(n, 0) / 10 < 0.2 AS breach FROM (
  SELECT unnest(generate_series({bucket('10 minutes', 'min(ts)')}, {bucket('10 minutes', 'max(ts)')}, INTERVAL '10 minutes')) AS window_start FROM log)
  LEFT JOIN (SELECT {bucket('10 minutes')} AS window_start, count(*) AS n FROM log WHERE {CLASSIFIED} GROUP BY 1) USING (window_start)""")
oracle("error_types", f"""SELECT {times()}, error_type, n_errors FROM (
  SELECT {bucket('6 hours')} AS window_start, error_type, count(*) AS n_errors FROM log WHERE error_type IS NOT NULL GROUP BY ALL)""")
oracle("security_events", f"""SELECT {times()}, n_events FROM (
  SELECT {bucket('1 hour')} AS window_start, count(*) AS n_events FROM log
  WHERE error_type IN ('authentication_failed', 'invalid_request', 'rate_limit_exceeded') GROUP BY ALL)""")
oracle("auth_failures", f"""SELECT {times()}, n_failures, round(n_failures / 21600, 6) AS per_second, n_failures / 21600 > 0.0002 AS breach FROM (
  SELECT window_start, count(*) AS n_failures FROM {sliding_rows('log', 6, '1 hour', "error_type = 'authentication_failed'")} GROUP BY 1)""")
oracle("dependency_health", f"""SELECT {times()}, round(n / 360, 6) AS calls_per_min, round(e / 21600, 6) AS errors_per_sec, round(p95_ms, 6) AS p95_ms,
  e / 21600 > 0.05 AS error_breach, p95_ms > 10000 AS latency_breach FROM (
  SELECT {bucket('6 hours')} AS window_start, count(*) AS n, count(*) FILTER (status BETWEEN 500 AND 599 OR level = 'ERROR') AS e,
    quantile_cont(duration_ms::DOUBLE, 0.95) AS p95_ms FROM log WHERE component = 'reviewer' GROUP BY 1)""")
oracle("monthly_slo", """SELECT month, n_requests, round(a, 6) AS availability_pct, round(f, 6) AS fast_pct, a >= 99.5 AS availability_met,
  f >= 95 AS latency_met, round(1 - (n_requests - n_good) / (n_requests * (1 - 99.5 / 100)), 6) AS budget_left FROM (
  SELECT *, n_good / n_requests * 100 AS a, n_fast / n_requests * 100 AS f FROM (
    SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_requests, count(*) FILTER (status NOT BETWEEN 500 AND 599) AS n_good,
      count(*) FILTER (duration_ms < 2000) AS n_fast FROM log GROUP BY 1))""")
oracle("risk_level_metric", """SELECT CASE WHEN risk_score >= 80 THEN 'high' WHEN risk_score >= 50 THEN 'medium' ELSE 'low' END AS risk_level,
  count(*) AS n FROM log GROUP BY 1""")
oracle("top_sources", """SELECT remote_ip, count(*) AS n_failures FROM log WHERE error_type = 'authentication_failed'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
oracle("within_slo", "SELECT endpoint, duration_ms <= 2000 AS within_slo, count(*) AS n FROM log GROUP BY ALL")


def gauge_mean(metric, function="avg"):
    return f"{function}(value) FILTER (metric = '{metric}')"


oracle("gauge_alerts", f"""SELECT {times()}, instance, coalesce(up = 0, false) AS service_down, coalesce(cpu > 80, false) AS high_cpu,
  coalesce(used / lim * 100 > 85, false) AS high_memory, coalesce(restarts > 3, false) AS frequent_restarts,
  coalesce(failed > 0, false) AS failed_deployment, coalesce(reach < 0.8, false) AS unreachable FROM (
  SELECT {bucket('1 hour')} AS window_start, instance, {gauge_mean('up', 'min')} AS up, {gauge_mean('cpu_pct')} AS cpu,
    {gauge_mean('memory_used')} AS used, {gauge_mean('memory_limit')} AS lim, {gauge_mean('restarts', 'sum')} AS restarts,
    {gauge_mean('deployment_failed', 'sum')} AS failed, {gauge_mean('uptime_check')} AS reach FROM gauge GROUP BY 1, 2)""")
oracle("sustained_alert", f"""SELECT rule, {times('since')}, {times('fired_at')}, {times('last_true')}, n_firing FROM (
  SELECT rule, since, min(ts) AS fired_at, max(ts) AS last_true, count(*) AS n_firing FROM since
  WHERE breach AND ts - since >= hold_hours * INTERVAL '1 hour' GROUP BY rule, since)""", HOURS)
LOG_SUMS = {
    "n_all": "count(*)", "n_5xx": N_5XX,
    "n_internal": "count(*) FILTER (error_type = 'internal_error')",
    "n_auth": "count(*) FILTER (error_type = 'authentication_failed')",
    "n_classify": "count(*) FILTER (endpoint = '/classify')",
    "n_slow": "count(*) FILTER (endpoint = '/classify' AND duration_ms > 2000)",
    "n_classified": "count(classification)",
    "n_phishing": "count(*) FILTER (classification = 'phishing')",
    "n_calls": "count(*) FILTER (component = 'reviewer')",
    "n_call_errors": "count(*) FILTER (component = 'reviewer' AND (status BETWEEN 500 AND 599 OR level = 'ERROR'))",
    "n_call_slow": "count(*) FILTER (component = 'reviewer' AND duration_ms > 10000)",
}
GAUGE_SUMS = {
    "n_down": "count(*) FILTER (metric = 'up' AND value = 0)", "cpu": gauge_mean("cpu_pct"),
    "used": gauge_mean("memory_used"), "lim": gauge_mean("memory_limit"),
    "restarts": gauge_mean("restarts", "sum"), "failed": gauge_mean("deployment_failed", "sum"),
}
# rule: (window in minutes, source, condition; a window without rows has zero counts and null means)
SERVICE = {
    "high_latency": (5, "log", "n_slow > 0.05 * n_classify"),
    "low_availability": (10, "log", "(n_all - n_5xx) / n_all * 100 < 99.5"),
    "high_error_rate": (5, "log", "n_5xx / n_all * 100 > 5"),
    "critical_error_rate": (5, "log", "n_5xx / n_all * 100 > 15"),
    "internal_errors": (5, "log", "n_internal / 300 > 0.1"),
    "reviewer_errors": (5, "log", "n_call_errors / 300 > 0.05"),
    "reviewer_latency": (5, "log", "n_call_slow > 0.05 * n_calls"),
    "auth_failures": (5, "log", "n_auth / 300 > 1"),
    "possible_attack": (1, "log", "n_auth / 60 > 10"),
    "low_volume": (10, "log", "coalesce(n_classified, 0) / 10 < 5"),
    "high_phishing_share": (10, "log", "n_phishing / nullif(n_classified, 0) * 100 > 25"),
    "service_down": (1, "gauge", "n_down > 0"),
    "high_cpu": (5, "gauge", "cpu > 80"),
    "high_memory": (5, "gauge", "used / lim * 100 > 85"),
    "frequent_restarts": (60, "gauge", "restarts > 3"),
    "failed_deployment": (5, "gauge", "failed > 0"),
}


SERIES = {"log": "'all'", "gauge": "instance"}  # gauge rules are judged for each instance


def service_windows(source, sums, minutes):
    columns = ", ".join(f"{value} AS {name}" for name, value in sums.items())
    return f"""
{source}{minutes} AS (SELECT window_start + INTERVAL '{minutes - 1} minutes' AS ts, {SERIES[source]} AS series, {columns}
  FROM {sliding_rows(source, minutes, '1 minute')} GROUP BY 1, 2),
{source}{minutes}_t AS (SELECT m.ts, m.series, w.* EXCLUDE (ts, series) FROM {source}_minutes m LEFT JOIN {source}{minutes} w USING (ts, series))"""


MINUTES = ", ".join(
    f"""{t}_minutes AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL '1 minute')) AS ts FROM (
  SELECT {SERIES[t]} AS series, date_trunc('minute', min(ts)) AS lo, date_trunc('minute', max(ts)) AS hi FROM {t} GROUP BY 1))"""
    for t in ("log", "gauge")
)
SERVICE_TICKS = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, '{rules.ALERT_RULES[rule][2]}' AS severity, {int(rules.ALERT_RULES[rule][1].split()[0])} AS hold,"
    f" series, ts, coalesce({condition}, false) AS breach FROM {source}{minutes}_t"
    for rule, (minutes, source, condition) in SERVICE.items()
)
SERVICE_CHAIN = ",".join(
    [MINUTES]
    + [service_windows("log", LOG_SUMS, m) for m in (1, 5, 10)]
    + [service_windows("gauge", GAUGE_SUMS, m) for m in (1, 5, 60)]
) + f""",
sticks AS ({SERVICE_TICKS}),
sruns AS (SELECT *, row_number() OVER (PARTITION BY rule, series ORDER BY ts) - row_number() OVER (PARTITION BY rule, series, breach ORDER BY ts) AS run FROM sticks),
ssince AS (SELECT *, min(ts) OVER (PARTITION BY rule, series, breach, run) AS since FROM sruns)"""
oracle("service_alerts", f"""SELECT rule, series, severity, {times('since')}, {times('fired_at')}, {times('last_true')}, n_firing FROM (
  SELECT rule, series, severity, since, min(ts) AS fired_at, max(ts) AS last_true, count(*) AS n_firing FROM ssince
  WHERE breach AND ts - since >= hold * INTERVAL '1 minute' GROUP BY rule, series, severity, since)""", SERVICE_CHAIN)
oracle("log_search", f"""SELECT event_id, {times('ts')}, level, event FROM log
WHERE level = 'ERROR' OR contains(event, 'security') OR contains(event, 'authentication') OR contains(error_type, 'authentication')
ORDER BY log.ts DESC, event_id DESC LIMIT 50""")
oracle("slow_requests", f"SELECT event_id, {times('ts')}, duration_ms, endpoint FROM log WHERE duration_ms > 2000 ORDER BY log.ts DESC, event_id DESC LIMIT 50")
oracle("failed_requests", f"SELECT event_id, {times('ts')}, status, remote_ip FROM log WHERE status >= 400 ORDER BY log.ts DESC, event_id DESC LIMIT 50")

# --- evaluation --------------------------------------------------------------
oracle("case_result", "SELECT * FROM results")
oracle("category_pass_rate", """SELECT category, n_cases, n_passed, round(n_passed / n_cases * 100, 6) AS pass_pct,
  n_passed / n_cases * 100 >= 80 AS suite_ok FROM (
  SELECT category, count(*) AS n_cases, count(*) FILTER (passed) AS n_passed FROM results GROUP BY 1
  UNION ALL SELECT 'all', count(*), count(*) FILTER (passed) FROM results)""")
oracle("confusion_matrix", """SELECT expected_label, count(*) FILTER (label = 'phishing') AS phishing,
  count(*) FILTER (label = 'sospechoso') AS sospechoso, count(*) FILTER (label = 'seguro') AS seguro FROM judged GROUP BY 1""")
oracle("quality_rates", """SELECT *, round(n_fp / n_good * 100, 6) AS fp_pct, round(n_fn / n_bad * 100, 6) AS fn_pct,
  n_fp / n_good * 100 <= 2 AS fp_ok, n_fn / n_bad * 100 <= 0.5 AS fn_ok FROM (
  SELECT count(*) FILTER (expected_label = 'phishing') AS n_bad, count(*) FILTER (expected_label <> 'phishing') AS n_good,
    count(*) FILTER (expected_label <> 'phishing' AND label = 'phishing') AS n_fp,
    count(*) FILTER (expected_label = 'phishing' AND label <> 'phishing') AS n_fn FROM judged)""")
oracle("threshold_table", f"SELECT score, count(*) AS n_messages, {LABEL_OF.format('score')} AS label FROM (SELECT floor(total_score)::INT AS score FROM scored) GROUP BY score")
oracle("threshold_sweep", """SELECT cut::INT AS cut,
  count(*) FILTER (expected_label = 'phishing' AND floor(total_score) >= cut) AS true_positive,
  count(*) FILTER (expected_label <> 'phishing' AND floor(total_score) >= cut) AS false_positive,
  count(*) FILTER (expected_label = 'phishing' AND floor(total_score) < cut) AS false_negative,
  count(*) FILTER (expected_label <> 'phishing' AND floor(total_score) < cut) AS true_negative
FROM judged, range(0, 101, 5) r(cut) GROUP BY cut""")

# --- streaming ---------------------------------------------------------------
oracle("classify_stream_rows", ROWS + "final")
CLOSED = """
closed AS (
  SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_requests, count(*) FILTER (status BETWEEN 500 AND 599) AS n_5xx,
    count(*) FILTER (status BETWEEN 400 AND 499) AS n_4xx, count(*) FILTER (error_type = 'authentication_failed') AS n_auth,
    count(classification) AS n_classified, count(*) FILTER (classification = 'phishing') AS n_phishing
  FROM log GROUP BY 1
  HAVING date_trunc('hour', min(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) FROM log) - INTERVAL '10 minutes')"""
oracle("metrics_stream_rows", f"SELECT {times()}, n_requests, n_5xx, n_4xx, n_auth, n_classified, n_phishing FROM closed", CLOSED)
STATES = CLOSED + """,
closed_hours AS (
  SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts) - INTERVAL '10 minutes') - INTERVAL '1 hour', INTERVAL '1 hour')) AS window_start
  FROM log),
st AS (
  SELECT rule, window_start AS ts,
    CASE rule WHEN 'error_burst' THEN coalesce(n_5xx / n_requests * 100 > 5, false) ELSE coalesce(n_classified, 0) < 8 END AS breach,
    CASE rule WHEN 'error_burst' THEN 1 ELSE 2 END AS hold_hours
  FROM closed_hours LEFT JOIN closed USING (window_start) CROSS JOIN (VALUES ('error_burst'), ('quiet_hour')) r(rule)),
sr AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts) - row_number() OVER (PARTITION BY rule, breach ORDER BY ts) AS run FROM st),
ss AS (SELECT *, CASE WHEN breach THEN min(ts) OVER (PARTITION BY rule, breach, run) END AS since FROM sr),
sn AS (SELECT *, CASE WHEN NOT breach THEN 'inactive' WHEN ts - since >= hold_hours * INTERVAL '1 hour' THEN 'firing' ELSE 'pending' END AS state FROM ss),
sc AS (SELECT *, lag(state, 1, 'inactive') OVER (PARTITION BY rule ORDER BY ts) AS before FROM sn)"""
oracle("alerts_stream_rows", f"SELECT rule, {times('ts')}, state, {times('since')} FROM sc WHERE state <> before", STATES)
