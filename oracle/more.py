"""DuckDB SQL of the lookup, file and stream queries, on the chain of ``oracle.sql``."""

from mailrisk import rules
from mailrisk.plans.lookup_queries import FILE_REMARKS, IMITATED, SUFFIX_RULES
from mailrisk.plans.stream_queries import WIDTHS
from oracle import sql
from oracle.sql import CHAIN, DOMAIN, FALLBACK, LAST_THREE, ROWS, filed, lit, policy, scored, texts, times, url_findings

ORACLES = {}


def oracle(name, select, extra=""):
    ORACLES[name] = "WITH " + CHAIN + ("," + extra if extra else "") + "\n" + select


# --- tables of any size ------------------------------------------------------------
def registered(domain="domain"):
    """Registrable domain by SUFFIX_RULES: the longest end that a rule names, exceptions first."""
    labels = f"string_split(ltrim({domain}, '.'), '.')"
    tail = f"array_to_string({labels}[len({labels}) - k + 1:], '.')"
    parent = f"array_to_string({labels}[len({labels}) - k + 2:], '.')"
    ends = f"range(1, len({labels}) + 1)"
    known = texts(SUFFIX_RULES)
    plain = f"list_max(list_filter({ends}, lambda k: list_contains({known}, {tail}) OR (k > 1 AND list_contains({known}, '*.' || {parent}))))"
    exact = f"list_max(list_filter({ends}, lambda k: list_contains({known}, '!' || {tail}))) - 1"
    size = f"least(coalesce({exact}, {plain}, 1) + 1, len({labels}))"
    return f"array_to_string({labels}[len({labels}) - {size} + 1:], '.')"


SIMILAR = (
    f"list_max(list_transform({texts(IMITATED)}, lambda b: "
    "1.0::DOUBLE - levenshtein(registered, b)::DOUBLE / greatest(length(registered), length(b))))"
)
FACTS = sql.url_facts("tfacts", "rurls")
TABLES = f"""
tfacts_d AS (SELECT *, {DOMAIN} AS domain FROM rurls),
tfacts_r AS (SELECT *, {registered()} AS registered FROM tfacts_d),
""" + FACTS[FACTS.index("tfacts AS"):].replace(sql.SIMILARITY, SIMILAR) + f""",
{url_findings('tfinds', 'tfacts')},
{scored('tscored', 'tfinds')},
tfallback AS ({FALLBACK} FROM tscored),
{policy('tfinal', 'tfallback')}"""
oracle("classify_mail_tables", ROWS + "tfinal", TABLES)
oracle("registered_mail_domains", f"SELECT domain, {registered()} AS registered FROM (SELECT DISTINCT {DOMAIN} AS domain FROM urls)")
oracle("lookalike_hosts", f"""SELECT registered, round(max(s), 6) AS similarity FROM (
  SELECT registered, 1.0::DOUBLE - levenshtein(registered, brand)::DOUBLE / greatest(length(registered), length(brand)) AS s
  FROM (SELECT DISTINCT {DOMAIN} AS registered FROM pages) h,
    (SELECT DISTINCT {LAST_THREE} AS brand FROM (SELECT {DOMAIN} AS domain FROM pages)) b)
WHERE s > 0.7 GROUP BY registered""")
BRAND_ROWS = ", ".join(f"({lit(b)}, {lit(d)})" for b, ds in rules.BRAND_DOMAINS.items() for d in ds)
oracle("brand_domain_table", f"""SELECT DISTINCT s.domain, n_messages, brand, true AS legitimate
FROM (SELECT lower(split_part(from_address, '@', -1)) AS domain, count(*) AS n_messages FROM hbox GROUP BY 1) s
JOIN (VALUES {BRAND_ROWS}) b(brand, domain) ON ends_with(s.domain, b.domain)""")
oracle("answered_mail", """SELECT m.message_id, CASE WHEN f.message_id IS NULL THEN 'invalid_request' ELSE 'ok' END AS status,
  CASE WHEN f.message_id IS NULL THEN 'no content' ELSE '' END AS reason, coalesce(label, '') AS label, coalesce(risk_score, -1) AS risk_score,
  coalesce(array_to_string(reasons, '|'), '') AS top_reasons FROM mail m LEFT JOIN final f USING (message_id)""")
oracle("latency_sketch", f"""SELECT {times()}, n AS n_requests, true AS p50_near, true AS p95_near, true AS p99_near FROM (
  SELECT window_start, count(*) AS n FROM {sql.sliding_rows('log', 6, '1 hour')} GROUP BY 1)""")

# --- whole files --------------------------------------------------------------------
FILES = sql.EML.replace(
    "repeat(chr(10) || 'Content-Disposition: attachment; x', len(attachments)) AS content",
    "repeat(chr(10) || 'Content-Disposition: attachment; x', len(attachments)) || chr(10) AS content",
)
READ = sql.ORACLES["parse_eml_files"]
READ = READ[READ.rindex("\nSELECT message_id,\n  coalesce(trim(substr(max_by") + 1 :]
oracle("read_eml_files", READ, FILES)
SENDER = "coalesce(trim(substr(max_by(line, i) FILTER (starts_with(line, 'From:')), 6)), 'Unknown')"
RANK = "CASE label WHEN 'phishing' THEN 4 WHEN 'suspicious' THEN 3 WHEN 'spam' THEN 2 ELSE 1 END"
oracle("judge_mail_files", f"""SELECT s.message_id, coalesce(r.label, {lit(rules.FAILED_LABEL)}) AS label, coalesce(r.risk_score, {rules.FAILED_SCORE}) AS risk_score,
  sender || ',' || n_attachments AS details
FROM (SELECT message_id, {SENDER} AS sender FROM eml_read GROUP BY 1) s
JOIN (SELECT message_id, len(attachments) AS n_attachments FROM acc) a USING (message_id)
LEFT JOIN (
  SELECT message_id, max_by(label, {RANK} * 1000 + risk_score) AS label, max_by(risk_score, {RANK} * 1000 + risk_score) AS risk_score FROM (
    SELECT message_id, {filed(0)} AS label, ({filed(1)})::INT AS risk_score FROM (
      SELECT message_id, lower({texts(FILE_REMARKS)}[(message_id + k * 2) % {len(FILE_REMARKS)} + 1]) AS low
      FROM acc, range(3) t(k) WHERE k <= message_id % 3 AND message_id % 4 <> 2))
  GROUP BY 1) r USING (message_id)""", FILES)
oracle("review_several", """SELECT message_id, CASE message_id % 2 WHEN 0 THEN 'phishing' ELSE 'spam' END AS label,
  CASE message_id % 2 WHEN 0 THEN 85 ELSE 35 END AS risk_score,
  CASE message_id % 2 WHEN 0 THEN 'VEREDICTO: PHISHING' ELSE 'VEREDICTO: SPAM' END AS analysis FROM acc""")
oracle("read_log_fields", """SELECT (duration_ms <= 2000)::VARCHAR AS within_slo, count(*) AS n, min('r-' || event_id) AS first_id, max('r-' || event_id) AS last_id
FROM log WHERE event_id % 10 <> 3 GROUP BY 1
UNION ALL SELECT 'corrupt', count(*), 'corrupt', 'corrupt' FROM log WHERE event_id % 10 = 3""")

# --- streams: windows that the watermark, ten minutes behind the last row, has passed ----
PASSED = "(SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
# a stream of chosen rows has the watermark of those rows: filters are applied before it
CHOSEN = {
    "label_counts": "event_type NOT IN ('error', 'view')", "phishing_share": "event_type NOT IN ('error', 'view')",
    "error_types": "event_type = 'error'", "auth_failures": "event_type = 'error' AND event_id % 3 = 2",
}
for name, width in WIDTHS.items():
    passed = PASSED.replace("FROM events", f"FROM events WHERE {CHOSEN.get(name, 'true')}")
    ORACLES[f"{name}_stream"] = (
        f"SELECT * FROM ({sql.ORACLES[name]}) AS batch\n"
        f"WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL '{width}' <= {passed}"
    )
oracle("request_counts_stream", f"""SELECT method, endpoint, status, count(*) AS n_requests FROM log
WHERE date_trunc('hour', log.ts) + INTERVAL '1 hour' <= {PASSED} GROUP BY ALL""")
oracle("latency_quantiles_stream", f"""SELECT {times()}, n AS n_requests, true AS in_order FROM (
  SELECT window_start, count(*) AS n FROM {sql.sliding_rows('log', 6, '1 hour')} GROUP BY 1)
WHERE window_start + INTERVAL '6 hours' <= {PASSED}""")
STATES = sql.SERVICE_CHAIN.replace("date_trunc('minute', max(ts)) AS hi", f"date_trunc('minute', {PASSED}) - INTERVAL '1 minute' AS hi") + """,
sstates AS (
  SELECT *, CASE WHEN NOT breach THEN 'inactive' WHEN ts - since >= hold * INTERVAL '1 minute' THEN 'firing' ELSE 'pending' END AS state FROM ssince),
schanges AS (SELECT *, lag(state, 1, 'inactive') OVER (PARTITION BY rule, series ORDER BY ts) AS before FROM sstates)"""
oracle("service_alerts_stream", f"""SELECT rule, series, severity, {times('ts')}, state,
  CASE WHEN breach THEN strftime(since, '%Y-%m-%d %H:%M:%S') ELSE '' END AS since FROM schanges WHERE state <> before""", STATES)
EARLY = "message_id < (SELECT max(doc_id) - 144 FROM documents)"
oracle("reviewed_stream_rows", f"""SELECT message_id, label, risk_score, array_to_string(reasons, '|') AS top_reasons FROM (
  SELECT message_id, label, risk_score, reasons FROM cfinal WHERE message_id % 4 < 2
  UNION ALL SELECT message_id, label, risk_score, reasons FROM final WHERE message_id % 4 >= 2) WHERE {EARLY}""")
oracle("corrections_stream_rows", f"""SELECT message_id, f.label AS first_label, c.label, c.risk_score, 1::BIGINT AS n_late
FROM final f JOIN cfinal c USING (message_id) JOIN reviews USING (message_id) WHERE message_id % 4 >= 2 AND {EARLY}""")
