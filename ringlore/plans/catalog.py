"""The queries of the data model: one entry an operator, and for each the SQL that any engine can hold against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as idf
from ..functions import phone, text, urls
from ..operators.merge import changed_documents, merge
from ..rules import CATEGORY_RULES, COMPANY_FLAGS, COMPANY_PATTERN, CONNECTOR_PATTERN, HORIZON_HOURS, HOTLINE_KEYWORDS, JOB_STATUSES, MOBILE_PREFIXES, PHONE_KEYWORDS, PHONE_PATTERN, URL_DENY, URL_RULES
from ..session import table
from ..sources import procfs, sitemaps
from . import adapters, ingest, marts, writes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.evidence_rows(*_t(spark, sf_dir, "phone_observations", "raw_documents", "data_sources"))


# -- SQL shared by several twins ----------------------------------------------------------------------------------

_PREFIXES = ", ".join(f"'{p}'" for p in MOBILE_PREFIXES)


def ladder_sql(raw: str, source: str) -> str:
    """A query with ``raw`` of ``source`` (distinct) through the normalizer, as CTE text ending in ``ladder``."""
    return f"""
k AS (SELECT DISTINCT {raw} AS raw, regexp_replace(trim(coalesce({raw}, '')), '[^0-9+]', '', 'g') AS kept FROM {source}),
b AS (SELECT *, regexp_replace(kept, '^\\+', '') AS bare,
      CASE WHEN starts_with(kept, '+84') THEN '0' || substr(kept, 4) WHEN starts_with(kept, '84') AND length(kept) >= 11 THEN '0' || substr(kept, 3)
           WHEN starts_with(kept, '0') THEN kept END AS nat FROM k),
e AS (SELECT *, CASE WHEN kept = '' THEN 'empty_input'
      WHEN regexp_matches(bare, '^1900[0-9]{{4,7}}$') THEN 'HOTLINE_1900' WHEN regexp_matches(bare, '^1800[0-9]{{4,7}}$') THEN 'HOTLINE_1800'
      WHEN nat IS NULL AND regexp_matches(bare, '^[0-9]{{3,6}}$') THEN 'SHORT_CODE' WHEN nat IS NULL THEN 'no_recognizable_national_prefix'
      WHEN NOT regexp_matches(nat, '^[0-9]+$') THEN 'malformed'
      WHEN length(nat) = 10 AND substr(nat, 1, 3) IN ({_PREFIXES}) THEN 'MOBILE' WHEN length(nat) = 11 AND substr(nat, 2, 1) = '2' THEN 'LANDLINE'
      WHEN length(nat) IN (10, 11) THEN 'unrecognized_prefix' ELSE 'invalid_length' END AS outcome FROM b),
ladder AS (SELECT raw, CASE WHEN outcome IN ('MOBILE', 'LANDLINE', 'unrecognized_prefix') THEN '+84' || substr(nat, 2)
      WHEN outcome IN ('HOTLINE_1900', 'HOTLINE_1800', 'SHORT_CODE') THEN bare END AS normalized,
      CASE WHEN outcome IN ('MOBILE', 'LANDLINE', 'HOTLINE_1900', 'HOTLINE_1800', 'SHORT_CODE') THEN outcome ELSE 'UNKNOWN' END AS type,
      outcome IN ('MOBILE', 'LANDLINE', 'HOTLINE_1900', 'HOTLINE_1800', 'SHORT_CODE') AS valid,
      CASE WHEN outcome = 'MOBILE' THEN 0.95 WHEN outcome LIKE 'HOTLINE%' THEN 0.9 WHEN outcome = 'SHORT_CODE' THEN 0.5
           WHEN outcome = 'LANDLINE' THEN CASE WHEN substr(nat, 2, 2) IN ('24', '28') THEN 0.85 ELSE 0.75 END
           WHEN outcome = 'unrecognized_prefix' THEN 0.3 WHEN outcome = 'empty_input' THEN 0.0 ELSE 0.1 END::DOUBLE AS confidence,
      CASE WHEN outcome NOT IN ('MOBILE', 'LANDLINE', 'HOTLINE_1900', 'HOTLINE_1800', 'SHORT_CODE') THEN outcome END AS reason FROM e)"""


_RAWS = "(SELECT phone_raw FROM phone_observations UNION ALL SELECT phone_raw FROM spam_reports UNION ALL SELECT phone_raw FROM personal_call_logs)"
_EVIDENCE = """
ev AS (SELECT o.id, o.phone_normalized, o.context_text, o.context_before, o.context_after, o.discovered_at, d.source_id, s.name AS source_name, s.source_type, s.trust_level
       FROM phone_observations o JOIN raw_documents d ON d.id = o.raw_document_id JOIN data_sources s ON s.id = d.source_id WHERE o.phone_normalized IS NOT NULL)"""


def _any(words: tuple[str, ...], value: str) -> str:
    return f"regexp_matches({value}, '(?i){'|'.join(words)}')"


_CATEGORY = "CASE " + " ".join(f"WHEN {_any(words, 'context_text')} THEN '{name}'" for name, words in CATEGORY_RULES) + " END"
_GUESS = f"""{_EVIDENCE},
g0 AS (SELECT *, trim(regexp_extract(coalesce(context_before, '') || ' ' || coalesce(context_after, ''), '(?i){COMPANY_PATTERN}', 0)) AS said FROM ev),
g1 AS (SELECT *, nullif(coalesce(nullif(trim(regexp_replace(said, '(?i){CONNECTOR_PATTERN}', '')), ''), said), '') AS company,
       coalesce({_any(HOTLINE_KEYWORDS, 'context_text')}, false) AS hotline FROM g0),
g AS (SELECT *, CASE WHEN company IS NOT NULL THEN company WHEN hotline THEN source_name || ' Hotline' ELSE 'Unknown (' || source_name || ')' END AS display_name,
      CASE WHEN company IS NOT NULL THEN 'BUSINESS' WHEN hotline THEN 'HOTLINE' ELSE 'UNKNOWN' END AS identity_type, {_CATEGORY} AS category,
      coalesce({_any(COMPANY_FLAGS, 'context_text')}, false) AS says_company, trust_level = 'HIGH' AS high, source_type IN ('OFFICIAL_WEBSITE', 'GOVERNMENT') AS official FROM g1),
guess AS (SELECT *, regexp_replace(trim(lower(display_name)), '\\s+', ' ', 'g') AS name_key FROM g)"""
_FLAGS = """
fr AS (SELECT *, coalesce(reporter_ref, id) AS reporter FROM spam_reports WHERE phone_normalized IS NOT NULL),
ft AS (SELECT phone_normalized, count(*) AS report_count, count(DISTINCT reporter) AS reporter_count FROM fr GROUP BY 1),
fc AS (SELECT DISTINCT ON (phone_normalized) phone_normalized, category AS top_category FROM (SELECT phone_normalized, category, count(*) AS n FROM fr GROUP BY 1, 2) ORDER BY phone_normalized, n DESC, category),
flags AS (SELECT ft.*, top_category, CASE WHEN reporter_count >= 10 THEN 'HIGH' WHEN reporter_count >= 1 THEN 'MEDIUM' ELSE 'NONE' END AS risk FROM ft JOIN fc USING (phone_normalized))"""
_BEST = """
best AS (SELECT DISTINCT ON (n.phone_e164) n.phone_e164, n.phone_type, i.id AS identity_id, i.display_name, i.category, i.confidence
         FROM phone_numbers n JOIN phone_identities i ON i.phone_number_id = n.id WHERE i.status <> 'REJECTED'
         ORDER BY n.phone_e164, i.confidence DESC, CASE WHEN i.status = 'CONFIRMED' THEN 0 ELSE 1 END, i.evidence_count DESC NULLS LAST, i.normalized_name NULLS FIRST, i.id)"""
_CLAIMS = f"""{_GUESS},
claims AS (SELECT phone_normalized, name_key, arg_min(display_name, (discovered_at, id)) AS display_name, arg_min(identity_type, (discovered_at, id)) AS identity_type,
  arg_min_null(category, (discovered_at, id)) AS category, count(*) AS evidence_count,
  CAST(least(100, CASE WHEN bool_or(high) THEN 20 ELSE 0 END + 10 * count(*) + CASE WHEN bool_or(hotline) THEN 15 ELSE 0 END + CASE WHEN bool_or(says_company) THEN 15 ELSE 0 END
       + CASE WHEN bool_or(official) THEN 20 ELSE 0 END) AS INTEGER) AS score, min(discovered_at) AS first_seen_at, max(discovered_at) AS last_seen_at
  FROM guess WHERE phone_normalized IN (SELECT phone_e164 FROM phone_numbers) GROUP BY 1, 2)"""
#: The identities as an insert with ON CONFLICT (number, name, rule) DO UPDATE leaves them.
_IDENT = f"""{_CLAIMS},
st AS (SELECT n.phone_e164 AS phone_normalized, i.normalized_name AS name_key, i.claim_source, i.display_name, i.identity_type, i.category, i.status, i.confidence::DOUBLE AS confidence, i.evidence_count, i.first_seen_at, i.last_seen_at
       FROM phone_identities i JOIN phone_numbers n ON n.id = i.phone_number_id),
ident AS (SELECT st.* REPLACE (coalesce(c.category, st.category) AS category, coalesce(c.score::DOUBLE, st.confidence) AS confidence, coalesce(c.evidence_count, st.evidence_count)::BIGINT AS evidence_count, coalesce(c.last_seen_at, st.last_seen_at) AS last_seen_at)
          FROM st LEFT JOIN claims c ON st.claim_source = 'rule_based_aggregation_v1' AND c.phone_normalized = st.phone_normalized AND c.name_key = st.name_key
          UNION ALL SELECT phone_normalized, name_key, 'rule_based_aggregation_v1', display_name, identity_type, category, 'CANDIDATE', score::DOUBLE, evidence_count, first_seen_at, last_seen_at FROM claims c
          WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.phone_normalized = c.phone_normalized AND st.name_key = c.name_key AND st.claim_source = 'rule_based_aggregation_v1'))"""
_PRODUCTION = f"""{_IDENT},
trusted AS (SELECT i.* FROM ident i JOIN phone_numbers n ON n.phone_e164 = i.phone_normalized WHERE n.phone_type IN ('MOBILE', 'LANDLINE') AND i.status <> 'REJECTED' AND i.claim_source = 'rule_based_aggregation_v1'
            AND EXISTS (SELECT 1 FROM guess g WHERE g.phone_normalized = i.phone_normalized AND g.name_key = i.name_key AND g.trust_level = 'HIGH' AND g.source_name NOT LIKE 'Fixture%')),
prod AS (SELECT * FROM phone_numbers WHERE phone_e164 IN (SELECT phone_normalized FROM trusted))"""
_SUPPRESSED = f"sup AS ({adapters.SUPPRESSED_SQL})"


# -- numbers ------------------------------------------------------------------------------------------------------


@_query("normalize_phone", f"WITH {ladder_sql('phone_raw', _RAWS)} SELECT * FROM ladder")
def normalize_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (t.select("phone_raw") for t in _t(spark, sf_dir, "phone_observations", "spam_reports", "personal_call_logs"))
    out = a.unionByName(b).unionByName(c).distinct().select(phone.normalized(F.col("phone_raw")).alias("n"))
    return out.select("n.raw", "n.normalized", "n.type", "n.valid", F.col("n.normalization_confidence").alias("confidence"), "n.reason")


@_query("observations_by_type", f"WITH {ladder_sql('phone_raw', 'phone_observations')} SELECT type, valid, count(*) AS observations FROM phone_observations o JOIN ladder ON raw IS NOT DISTINCT FROM phone_raw GROUP BY 1, 2")
def observations_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = phone.normalized(F.col("phone_raw"))
    return table(spark, sf_dir, "phone_observations").groupBy(n["type"].alias("type"), n["valid"].alias("valid")).agg(F.count("*").alias("observations"))


@_query(
    "phone_numbers_rollup",
    f"""WITH {ladder_sql('phone_raw', 'phone_observations')}
SELECT phone_normalized AS phone_e164, count(*) AS observation_count, min(discovered_at) AS first_seen_at, max(discovered_at) AS last_seen_at, arg_max(type, (discovered_at, id)) AS phone_type
FROM phone_observations JOIN ladder ON raw IS NOT DISTINCT FROM phone_raw WHERE phone_normalized IS NOT NULL GROUP BY 1""",
)
def phone_numbers_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.number_rollup(table(spark, sf_dir, "phone_observations"))


@_query("national_number", "SELECT phone_e164, CASE WHEN phone_type IN ('MOBILE', 'LANDLINE') THEN regexp_replace(phone_e164, '^\\+84', '0') ELSE phone_e164 END AS national FROM phone_numbers")
def national_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "phone_numbers").select("phone_e164", phone.national_number(F.col("phone_e164"), F.col("phone_type")).alias("national"))


@_query(
    "call_log_line_parse",
    """WITH l AS (SELECT id, trim(coalesce(phone_raw, '') || ' x' || call_count) AS line FROM personal_call_logs), r AS (SELECT '^([+0-9][0-9 \t.\\-]*[0-9])\\s*(?:[,xX*\\-]\\s*([0-9]+))?\\s*.*$' AS rx)
SELECT id, regexp_extract(line, '^([+0-9][0-9 \t.\\-]*[0-9])\\s*(?:[,xX*\\-]\\s*([0-9]+))?\\s*.*$', 1) AS phone,
       coalesce(TRY_CAST(nullif(regexp_extract(line, '^([+0-9][0-9 \t.\\-]*[0-9])\\s*(?:[,xX*\\-]\\s*([0-9]+))?\\s*.*$', 2), '') AS INTEGER), 1) AS calls
FROM l, r WHERE regexp_matches(line, rx)""",
)
def call_log_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.coalesce("phone_raw", F.lit("")), F.lit(" x"), F.col("call_count").cast("string"))
    rows = table(spark, sf_dir, "personal_call_logs").select("id", phone.parsed_line(line).alias("p"))
    return rows.where("p IS NOT NULL").select("id", F.col("p.phone_raw").alias("phone"), F.col("p.call_count").alias("calls"))


@_query("phone_search", "SELECT phone_e164, national_number, phone_type FROM phone_numbers WHERE contains(national_number, '77') ORDER BY phone_e164 LIMIT 20")
def phone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.search_numbers(table(spark, sf_dir, "phone_numbers"), "7-7")


_ASKED = "(SELECT phone_e164 AS raw_input FROM phone_numbers UNION SELECT phone_raw FROM personal_call_logs)"


@_query(
    "phone_lookup",
    f"""WITH {_EVIDENCE}, {_FLAGS}, {ladder_sql('raw_input', _ASKED)},
seen AS (SELECT phone_normalized, count(DISTINCT source_id) AS source_count FROM ev GROUP BY 1),
named AS (SELECT phone_number_id, list({{'name': display_name, 'type': identity_type, 'category': category, 'confidence': confidence::DOUBLE, 'evidence_count': evidence_count, 'status': status}} ORDER BY confidence DESC, normalized_name NULLS FIRST, id) AS identities FROM phone_identities GROUP BY 1)
SELECT l.raw AS raw_input, l.normalized, coalesce(n.phone_type, l.type) AS type, l.valid, CASE WHEN l.normalized IS NULL THEN 'INVALID' WHEN n.id IS NULL THEN 'NEVER_SEEN' ELSE 'SEEN' END AS shape,
  coalesce(n.observation_count, 0) AS observation_count, CASE WHEN n.id IS NULL THEN 0 ELSE coalesce(source_count, 0) END AS source_count, n.first_seen_at, n.last_seen_at,
  array_to_string(list_transform(coalesce(identities, []), lambda i: concat_ws('|', i['name'], i['type'], coalesce(i['category'], '-'), CAST(round(i['confidence'] * 100) AS BIGINT), i['evidence_count'], i['status'])), ';') AS identities,
  coalesce(report_count, 0) AS report_count, coalesce(reporter_count, 0) AS reporter_count, coalesce(risk, 'NONE') AS risk, top_category
FROM ladder l LEFT JOIN phone_numbers n ON n.phone_e164 = l.normalized LEFT JOIN seen s ON s.phone_normalized = l.normalized LEFT JOIN named m ON m.phone_number_id = n.id LEFT JOIN flags f ON f.phone_normalized = l.normalized""",
)
def phone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored number and everything that was called, looked up; identities as text, one after the other."""
    numbers, identities, reports, calls = _t(spark, sf_dir, "phone_numbers", "phone_identities", "spam_reports", "personal_call_logs")
    asked = numbers.select(F.col("phone_e164").alias("raw_input")).unionByName(calls.select(F.col("phone_raw").alias("raw_input")))
    found = marts.lookup(asked, numbers, identities, _evidence(spark, sf_dir), reports)
    said = F.transform("identities", lambda i: F.concat_ws("|", i["name"], i["type"], F.coalesce(i["category"], F.lit("-")), F.round(i["confidence"] * 100).cast("bigint").cast("string"), i["evidence_count"].cast("string"), i["status"]))
    return found.withColumn("identities", F.array_join(said, ";"))


# -- extraction ---------------------------------------------------------------------------------------------------

_CANDIDATES = f"""
c0 AS (SELECT doc_id, text, regexp_extract_all(text, '{PHONE_PATTERN}', 0) AS m, string_split_regex(text, '{PHONE_PATTERN}') AS g FROM documents WHERE text IS NOT NULL),
c1 AS (SELECT doc_id, text, unnest(range(0, len(m))) AS ordinal, m, g FROM c0),
c2 AS (SELECT doc_id, text, ordinal, m[ordinal + 1] AS phone_raw,
       coalesce(list_sum(list_transform(g[1:ordinal + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:ordinal], lambda x: length(x))), 0) AS p FROM c1),
c3 AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, phone_raw, CAST(p AS INTEGER) AS position_start, CAST(p + length(phone_raw) AS INTEGER) AS position_end,
       trim(regexp_replace(string_split(substr(text, CAST(greatest(p - 80, 0) + 1 AS BIGINT), CAST(p - greatest(p - 80, 0) AS BIGINT)), chr(10))[-1], '\\s+', ' ', 'g')) AS context_before,
       trim(regexp_replace(string_split(substr(text, CAST(p + length(phone_raw) + 1 AS BIGINT), 80), chr(10))[1], '\\s+', ' ', 'g')) AS context_after FROM c2),
c AS (SELECT *, trim(context_before || ' ' || phone_raw || ' ' || context_after) AS context_text FROM c3)"""


@_query("extract_text_candidates", f"WITH {_CANDIDATES} SELECT doc_id, ordinal, phone_raw, position_start, position_end FROM c")
def extract_text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "ordinal", "phone_raw", "position_start", "position_end")


@_query(
    "extract_context_window",
    f"""WITH {_CANDIDATES} SELECT doc_id, ordinal, context_before, context_after, context_text,
CAST(round(least(0.95, 0.5 + CASE WHEN regexp_matches(phone_raw, '[\\s.\\-]') THEN 0.2 ELSE 0 END + CASE WHEN {_any(PHONE_KEYWORDS, 'context_text')} THEN 0.2 ELSE 0 END) * 100) AS INTEGER) AS percent FROM c""",
)
def extract_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "ordinal", "context_before", "context_after", "context_text", F.round(F.col("confidence") * 100).cast("int").alias("percent"))


def _visible_sql(html: str) -> str:
    """Scripts and styles go, breaks and block ends become newlines, other tags blanks, two entities are read, runs squeezed: step by step."""
    for found, put in (
        ("(?is)<script[^>]*>.*?</script>", "' '"), ("(?is)<style[^>]*>.*?</style>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"), ("(?i)</p>|</li>|</h[1-6]>|</div>|</tr>|</td>|</th>", "chr(10)"),
        ("(?i)</section>|</article>|</header>|</footer>", "chr(10)"), ("<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), (r"[ \t]+", "' '"), (r"( ?\n ?)+", "chr(10)"),
    ):
        html = f"regexp_replace({html}, '{found}', {put}, 'g')"
    return f"regexp_replace({html}, '^[ \\n]+|[ \\n]+$', '', 'g')"


@_query("html_visible_text", f"SELECT id, sha256({_visible_sql('raw_content')}) AS text_hash FROM raw_documents")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_documents").select("id", F.sha2(text.visible_text(F.col("raw_content")), 256).alias("text_hash"))


@_query("page_titles", "SELECT id, trim(regexp_extract(raw_content, '(?is)<title[^>]*>(.*?)</title>', 1)) AS page_title FROM raw_documents")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_documents").select("id", text.page_title(F.col("raw_content")).alias("page_title"))


def _method_sql(method: str, value: str) -> str:
    return f"SELECT id, '{method}' AS extraction_method, unnest(regexp_extract_all({value}, '{PHONE_PATTERN}', 0)) AS phone_raw FROM raw_documents"


@_query(
    "extract_html_candidates",
    "SELECT id, extraction_method, phone_raw, count(*) AS times FROM ("
    + " UNION ALL ".join(
        (
            "SELECT id, 'TEL_HREF' AS extraction_method, unnest(regexp_extract_all(raw_content, '(?i)href=[\"'']tel:([^\"'']+)[\"'']', 1)) AS phone_raw FROM raw_documents",
            _method_sql("REGEX_TEXT", _visible_sql("raw_content")),
            _method_sql("REGEX_TITLE", "trim(regexp_extract(raw_content, '(?is)<title[^>]*>(.*?)</title>', 1))"),
            _method_sql("REGEX_META_DESCRIPTION", "regexp_extract(raw_content, '(?i)<meta[^>]*name=[\"'']description[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1)"),
        )
    )
    + ") GROUP BY 1, 2, 3",
)
def extract_html_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.html_candidates(table(spark, sf_dir, "raw_documents").select("id", "raw_content"), "raw_content")
    return found.groupBy("id", "extraction_method", "phone_raw").agg(F.count("*").alias("times"))


# -- claims -------------------------------------------------------------------------------------------------------


@_query("identity_guess", f"WITH {_GUESS} SELECT id, display_name, name_key, identity_type, category FROM guess")
def identity_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.guesses(_evidence(spark, sf_dir)).select("id", "display_name", "name_key", "identity_type", "category")


@_query("identity_category_rules", f"WITH {_GUESS} SELECT category, count(*) AS observations FROM guess GROUP BY 1")
def identity_category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).groupBy(idf.category(F.col("context_text")).alias("category")).agg(F.count("*").alias("observations"))


@_query("identity_claims", f"WITH {_CLAIMS} SELECT * FROM claims")
def identity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.claims(_evidence(spark, sf_dir), table(spark, sf_dir, "phone_numbers"))


@_query("identity_evidence", f"WITH {_GUESS} SELECT DISTINCT phone_normalized, name_key, id AS phone_observation_id FROM guess WHERE phone_normalized IN (SELECT phone_e164 FROM phone_numbers)")
def identity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.claim_evidence(_evidence(spark, sf_dir), table(spark, sf_dir, "phone_numbers"))


@_query("identity_best_per_phone", f"WITH {_BEST} SELECT phone_e164, identity_id, display_name, CAST(confidence AS DOUBLE) AS confidence FROM best")
def identity_best_per_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.best_identities(*_t(spark, sf_dir, "phone_numbers", "phone_identities")).select("phone_e164", "identity_id", "display_name", F.col("confidence").cast("double").alias("confidence"))


@_query("identity_upsert_sticky", f"WITH {_IDENT} SELECT * FROM ident")
def identity_upsert_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, identities = _t(spark, sf_dir, "phone_numbers", "phone_identities")
    return marts.identities_after_run(numbers, identities, _evidence(spark, sf_dir))


# -- spam and directory -------------------------------------------------------------------------------------------


@_query("spam_flags", f"WITH {_FLAGS} SELECT * FROM flags")
def spam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.spam_flags(table(spark, sf_dir, "spam_reports"))


@_query("spam_breakdown", "SELECT phone_normalized, category, count(*) AS report_count FROM spam_reports WHERE phone_normalized IS NOT NULL GROUP BY 1, 2")
def spam_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.spam_breakdown(table(spark, sf_dir, "spam_reports"))


@_query("spam_recent", "SELECT id, phone_raw, category, reported_at FROM spam_reports ORDER BY reported_at DESC, id LIMIT 10")
def spam_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top(table(spark, sf_dir, "spam_reports").select("id", "phone_raw", "category", "reported_at"), [F.col("reported_at").desc(), F.col("id")], 10)


_DIRECTORY = f"""{_PRODUCTION}, {_FLAGS}, {_SUPPRESSED}, {ladder_sql('phone_normalized', 'spam_reports')},
shown AS (SELECT DISTINCT ON (phone_normalized) phone_normalized, coalesce(nullif(regexp_extract(display_name, '^Unknown \\((.+)\\)$', 1), ''), display_name) AS name FROM trusted
          ORDER BY phone_normalized, confidence DESC, CASE WHEN status = 'CONFIRMED' THEN 0 ELSE 1 END, evidence_count DESC, name_key),
j AS (SELECT coalesce(s.phone_normalized, f.phone_normalized) AS phone, name, reporter_count, top_category FROM shown s FULL OUTER JOIN flags f ON s.phone_normalized = f.phone_normalized
      WHERE name IS NOT NULL OR f.phone_normalized IN (SELECT raw FROM ladder WHERE type IN ('MOBILE', 'LANDLINE'))),
directory AS (SELECT regexp_replace(phone, '^\\+', '') AS digits,
  CASE WHEN reporter_count IS NULL THEN name
       WHEN name IS NULL OR reporter_count >= 10 THEN '⚠️ Nghi ngờ ' || CASE WHEN top_category = 'SCAM' THEN 'LỪA ĐẢO' ELSE 'SPAM' END || ' (' || reporter_count || ' báo cáo)'
       ELSE '⚠️ ' || name END AS label
  FROM j WHERE phone NOT IN (SELECT phone_normalized FROM sup))"""


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, identities, reports = _t(spark, sf_dir, "phone_numbers", "phone_identities", "spam_reports")
    return marts.call_directory(numbers, identities, _evidence(spark, sf_dir), reports, adapters.label_suppressions(numbers))


@_query("call_directory_export", f"WITH {_DIRECTORY} SELECT * FROM directory ORDER BY digits::HUGEINT")
def call_directory_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.in_number_order(_directory(spark, sf_dir))


@_query("directory_by_label", f"WITH {_DIRECTORY} SELECT row_number() OVER (ORDER BY label, digits::HUGEINT) AS place, digits, label FROM directory QUALIFY place <= 100")
def directory_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a device's list, with the place of each entry."""
    first = marts.by_label(_directory(spark, sf_dir)).limit(100)
    rows = first.agg(F.array_sort(F.collect_list(F.struct("label", F.col("digits").cast("decimal(20,0)").alias("n"), "digits"))).alias("r"))  # a page
    return rows.select(F.posexplode("r").alias("at", "e")).select((F.col("at") + 1).cast("bigint").alias("place"), "e.digits", "e.label")


_BLOCKED = """blocked AS (SELECT regexp_replace(phone_normalized, '^\\+', '') AS digits FROM flags WHERE reporter_count >= 10 AND top_category = 'SCAM'
AND phone_normalized IN (SELECT raw FROM ladder WHERE type IN ('MOBILE', 'LANDLINE')) AND phone_normalized NOT IN (SELECT phone_normalized FROM sup))"""


@_query("export_payload", f"WITH {_DIRECTORY}, {_BLOCKED} SELECT 'entries' AS part, digits, label, (SELECT count(*) FROM directory) AS count FROM directory UNION ALL SELECT 'blocked_digits', digits, NULL, (SELECT count(*) FROM directory) FROM blocked")
def export_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, reports = _t(spark, sf_dir, "phone_numbers", "spam_reports")
    return marts.export_payload(_directory(spark, sf_dir), marts.blocked_digits(reports, adapters.label_suppressions(numbers)))


@_query("blocked_digits", f"WITH {_FLAGS}, {_SUPPRESSED}, {ladder_sql('phone_normalized', 'spam_reports')}, {_BLOCKED} SELECT digits FROM blocked")
def blocked_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, reports = _t(spark, sf_dir, "phone_numbers", "spam_reports")
    return marts.in_number_order(marts.blocked_digits(reports, adapters.label_suppressions(numbers)))


# -- call log -----------------------------------------------------------------------------------------------------


@_query(
    "call_log_summary",
    f"""WITH {_BEST}, p AS (SELECT coalesce(phone_normalized, phone_raw) AS phone, phone_normalized, arg_max(phone_raw, (imported_at, id)) AS phone_raw, sum(call_count) AS total_calls,
  count(DISTINCT call_date) AS days, min(call_date) AS first_call, max(call_date) AS last_call FROM personal_call_logs WHERE call_date BETWEEN DATE '2024-01-01' AND DATE '2025-06-30' GROUP BY 1, 2)
SELECT phone, p.phone_normalized, phone_raw, CAST(total_calls AS BIGINT) AS total_calls, days, first_call, last_call, display_name AS identity_name, category AS identity_category
FROM p LEFT JOIN best ON best.phone_e164 = p.phone_normalized""",
)
def call_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, numbers, identities = _t(spark, sf_dir, "personal_call_logs", "phone_numbers", "phone_identities")
    return marts.call_summary(calls, numbers, identities, "2024-01-01", "2025-06-30")


@_query(
    "unknown_number_priority",
    f"""WITH u AS (SELECT coalesce(phone_normalized, phone_raw) AS phone, phone_normalized, arg_max(phone_raw, (imported_at, id)) AS phone_raw, sum(call_count) AS total_calls, count(DISTINCT call_date) AS days, max(call_date) AS last_call
  FROM personal_call_logs c WHERE NOT EXISTS (SELECT 1 FROM phone_numbers n JOIN phone_identities i ON i.phone_number_id = n.id WHERE n.phone_e164 = c.phone_normalized AND i.status <> 'REJECTED') GROUP BY 1, 2)
SELECT phone, phone_normalized, phone_raw, CAST(total_calls AS BIGINT) AS total_calls, days, last_call, CAST(least(100, least(total_calls * 5, 50)
  + greatest(0, 30 - greatest(0, date_diff('day', last_call, CAST('{marts.AS_OF}' AS DATE)))) + least(days * 3, 20)) AS INTEGER) AS priority FROM u""",
)
def unknown_number_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, numbers, identities = _t(spark, sf_dir, "personal_call_logs", "phone_numbers", "phone_identities")
    return marts.unknown_numbers(calls, numbers, identities, marts.AS_OF)


# -- statistics ---------------------------------------------------------------------------------------------------


@_query(
    "source_performance",
    """WITH d AS (SELECT source_id, count(*) AS documents, count(DISTINCT content_hash) AS distinct_contents FROM raw_documents GROUP BY 1),
o AS (SELECT r.source_id, count(*) AS observations, count(phone_normalized) AS normalized, count(DISTINCT phone_normalized) AS numbers FROM phone_observations p JOIN raw_documents r ON r.id = p.raw_document_id GROUP BY 1)
SELECT s.id AS source_id, s.name, coalesce(documents, 0) AS documents, coalesce(distinct_contents, 0) AS distinct_contents, coalesce(observations, 0) AS observations, coalesce(normalized, 0) AS normalized,
       coalesce(numbers, 0) AS numbers, CASE WHEN coalesce(documents, 0) = 0 THEN 0.0 ELSE coalesce(observations, 0) / documents END::DOUBLE AS yield_per_page
FROM data_sources s LEFT JOIN d ON d.source_id = s.id LEFT JOIN o ON o.source_id = s.id""",
)
def source_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.source_performance(*_t(spark, sf_dir, "data_sources", "raw_documents", "phone_observations"))


@_query(
    "data_quality",
    """SELECT *, CASE WHEN documents = 0 THEN 0.0 ELSE 1 - distinct_contents / documents END::DOUBLE AS duplicate_ratio, CASE WHEN observations = 0 THEN 0.0 ELSE invalid_observations / observations END::DOUBLE AS invalid_ratio FROM
(SELECT count(*) AS observations, count(*) FILTER (WHERE phone_normalized IS NULL) AS invalid_observations FROM phone_observations),
(SELECT count(*) AS numbers, count(*) FILTER (WHERE phone_type <> 'UNKNOWN') AS typed_numbers, count(*) FILTER (WHERE observation_count > 3) AS numbers_often_seen FROM phone_numbers),
(SELECT count(*) AS identities, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed_identities, count(DISTINCT phone_number_id) AS identified_numbers FROM phone_identities),
(SELECT count(*) AS documents, count(DISTINCT content_hash) AS distinct_contents FROM raw_documents)""",
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.data_quality(*_t(spark, sf_dir, "phone_observations", "phone_numbers", "phone_identities", "raw_documents"))


@_query("top_sources", f"WITH {_EVIDENCE} SELECT source_name, count(*) AS observations FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top_sources(_evidence(spark, sf_dir))


_H = ", ".join(f"count(*) FILTER (WHERE first_seen_at > TIMESTAMP '{marts.AS_OF}' - INTERVAL '{h}' HOUR) AS last_{h}h" for h in HORIZON_HOURS)


_SINCE = "2025-06-28 00:00:00"
_GROWTH = f"count(*) AS total, {_H}, count(*) FILTER (WHERE first_seen_at > TIMESTAMP '{_SINCE}') AS since_observation"


def _production(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, identities = _t(spark, sf_dir, "phone_numbers", "phone_identities")
    return marts.production_numbers(numbers, identities, _evidence(spark, sf_dir))


@_query("data_growth_horizons", f"WITH {_PRODUCTION} SELECT {_GROWTH} FROM prod")
def data_growth_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.growth_horizons(_production(spark, sf_dir), marts.AS_OF, _SINCE)


def _hourly(name: str, hours: int) -> None:
    sql = f"WITH {_PRODUCTION} SELECT date_trunc('hour', first_seen_at) AS hour, count(*) AS new_numbers FROM prod WHERE first_seen_at > TIMESTAMP '{marts.AS_OF}' - INTERVAL '{hours}' HOUR GROUP BY 1"

    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return marts.growth_hourly(_production(spark, sf_dir), marts.AS_OF, hours)


_hourly("data_growth_hourly", 24)
_hourly("data_growth_hourly_72h", 72)


# -- acquisition --------------------------------------------------------------------------------------------------

_SCORE = f"CASE WHEN regexp_matches(lower(url), '{'|'.join(x.replace('.', chr(92) + '.') for x in URL_DENY)}') THEN 0 " + " ".join(f"WHEN regexp_matches(lower(url), '{'|'.join(w)}') THEN {p}" for p, w in URL_RULES) + " ELSE 10 END"


@_query("url_score", f"SELECT id, {_SCORE} AS score FROM crawl_targets")
def url_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_targets").select("id", urls.url_score(F.col("url")).alias("score"))


@_query(
    "url_normalize",
    """WITH u AS (SELECT id, regexp_replace(trim(url), '[?#].*$', '') AS bare FROM raw_documents), h AS (SELECT id, bare, regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/]*)', 1) AS host FROM u),
p AS (SELECT *, regexp_replace(substr(bare, length(host) + 1), '/+$', '') AS path FROM h) SELECT id, host || CASE WHEN path = '' THEN '/' ELSE path END AS normalized FROM p""",
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_documents").select("id", urls.normalized_url(F.col("url")).alias("normalized"))


@_query("domain_normalize", "SELECT id, lower(regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\\-]*://', ''), '^([^/?#]*)', 1)) AS domain FROM raw_documents")
def domain_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_documents").select("id", urls.normalized_domain(F.col("url")).alias("domain"))


@_query(
    "raw_document_insert_if_changed",
    """WITH l AS (SELECT crawl_target_id, arg_max(content_hash, (created_at, id)) AS last_hash FROM raw_documents WHERE crawl_target_id IS NOT NULL AND created_at < TIMESTAMP '2025-01-01' GROUP BY 1)
SELECT r.id FROM raw_documents r LEFT JOIN l USING (crawl_target_id) WHERE r.created_at >= TIMESTAMP '2025-01-01' AND r.content_hash IS DISTINCT FROM l.last_hash""",
)
def raw_document_insert_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "raw_documents").select("id", "crawl_target_id", "content_hash", "created_at").withColumn("at", F.struct("created_at", "id"))
    new = F.col("created_at") >= marts.moment("2025-01-01 00:00:00")
    return changed_documents(docs.where(~new), docs.where(new), "crawl_target_id", "content_hash", "at").select("id")


@_query("unprocessed_documents", "SELECT id, source_id FROM raw_documents d WHERE NOT EXISTS (SELECT 1 FROM phone_observations o WHERE o.raw_document_id = d.id)")
def unprocessed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, seen = _t(spark, sf_dir, "raw_documents", "phone_observations")
    return ingest.unextracted(docs.select("id", "source_id"), seen)


_HTML = SQL["extract_html_candidates"]


@_query("crawl_pipeline_numbers", f"WITH h AS ({_HTML}), {ladder_sql('phone_raw', 'h')} SELECT normalized AS phone_e164, type AS phone_type, CAST(sum(times) AS BIGINT) AS observation_count, count(DISTINCT id) AS documents FROM h JOIN ladder ON raw = phone_raw WHERE normalized IS NOT NULL GROUP BY 1, 2")
def crawl_pipeline_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.page_observations(table(spark, sf_dir, "raw_documents").select("id", "raw_content")).where("phone_normalized IS NOT NULL")
    return found.groupBy(F.col("phone_normalized").alias("phone_e164"), "phone_type").agg(F.count("*").alias("observation_count"), F.count_distinct("id").alias("documents"))


@_query(
    "dataset_rows_to_observations",
    f"""WITH {ladder_sql('phone_raw', 'personal_call_logs')}
SELECT trim(phone_raw) AS phone_raw, normalized AS phone_normalized, type AS phone_type, 'calls: ' || call_count AS context_text, count(*) AS times, count(*) AS documents
FROM personal_call_logs JOIN ladder ON raw = phone_raw WHERE trim(phone_raw) <> '' GROUP BY 1, 2, 3, 4""",
)
def dataset_rows_to_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "personal_call_logs").select(F.col("phone_raw").alias("SĐT"), F.col("call_count").cast("string").alias("calls"))
    found = ingest.dataset_observations(rows, "calls")
    return found.groupBy("phone_raw", "phone_normalized", "phone_type", "context_text").agg(F.count("*").alias("times"), F.count_distinct("content_hash").alias("documents"))


@_query("observation_window", f"SELECT CAST(date_sub('second', t, n) AS BIGINT) AS elapsed_seconds, 259200 AS target_seconds, CAST(greatest(0, 259200 - date_sub('second', t, n)) AS BIGINT) AS remaining_seconds FROM (SELECT min(first_seen_at) AS t, TIMESTAMP '{marts.AS_OF}' AS n FROM phone_numbers)")
def observation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "phone_numbers").agg(F.min("first_seen_at").alias("started_at"))
    return marts.observation_window(start, marts.AS_OF, 72)


@_query("suppressed_numbers", f"SELECT phone_normalized, reason, created_at FROM ({adapters.SUPPRESSED_SQL}) ORDER BY created_at DESC, 1")
def suppressed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.suppressions_newest_first(adapters.label_suppressions(table(spark, sf_dir, "phone_numbers")))


_IMPORT = f"""{_BEST}, {ladder_sql('phone_raw', 'personal_call_logs')},
found AS (SELECT c.id, c.phone_raw, l.normalized AS phone_normalized, l.valid, CASE WHEN c.call_count > 0 THEN c.call_count ELSE 1 END AS call_count, b.phone_e164 IS NOT NULL AS known, b.display_name AS identity_name
FROM personal_call_logs c JOIN ladder l ON l.raw IS NOT DISTINCT FROM c.phone_raw LEFT JOIN best b ON b.phone_e164 = l.normalized)"""


@_query("call_log_import", f"WITH {_IMPORT} SELECT * FROM found")
def call_log_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, numbers, identities = _t(spark, sf_dir, "personal_call_logs", "phone_numbers", "phone_identities")
    return marts.call_import(calls, numbers, identities)


@_query("call_import_counts", f"WITH {_IMPORT} SELECT count(*) AS entries, count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE NOT known) AS unknown, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS skipped FROM found")
def call_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.import_counts(call_log_import(spark, sf_dir))


@_query(
    "spam_summary",
    f"""WITH {_FLAGS}, parts AS (SELECT phone_normalized, string_agg(category || '=' || n, ';' ORDER BY category) AS breakdown FROM (SELECT phone_normalized, category, count(*) AS n FROM fr WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT f.*, breakdown FROM flags f LEFT JOIN parts USING (phone_normalized)""",
)
def spam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marts.spam_summaries(table(spark, sf_dir, "spam_reports"))
    said = F.transform(F.array_sort(F.map_entries("breakdown")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.withColumn("breakdown", F.array_join(said, ";"))


@_query(
    "spam_of_one_number",
    """WITH r AS (SELECT * FROM spam_reports WHERE phone_normalized = (SELECT min(phone_normalized) FROM spam_reports)) SELECT category, reports, report_count, reporter_count FROM (SELECT category, count(*) AS reports FROM r GROUP BY 1),
(SELECT count(*) AS report_count, count(DISTINCT coalesce(reporter_ref, id)) AS reporter_count FROM r)""",
)
def spam_of_one_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "spam_reports")
    first = reports.agg(F.min("phone_normalized")).head()[0]
    return marts.spam_of_one(reports, first)


@_query(
    "robots_sitemaps",
    r"""WITH r AS (SELECT id, base_url, CASE WHEN robots_checked THEN 'User-agent: *' || chr(10) || 'SITEMAP:  ' || base_url || '/a.xml' || chr(10) || 'sitemap: ' || base_url || '/b.xml' END AS robots FROM data_sources),
s AS (SELECT id, base_url, regexp_extract_all(coalesce(robots, ''), '(?im)^sitemap:\s*(\S+)', 1) AS named FROM r)
SELECT DISTINCT base_url, unnest(CASE WHEN len(named) > 0 THEN named ELSE [regexp_replace(base_url, '/+$', '') || '/sitemap.xml', regexp_replace(base_url, '/+$', '') || '/sitemap_index.xml',
  regexp_replace(base_url, '/+$', '') || '/sitemap-index.xml', regexp_replace(base_url, '/+$', '') || '/sitemapindex.xml'] END) AS sitemap FROM s""",
)
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("User-agent: *\nSITEMAP:  "), "base_url", F.lit("/a.xml\nsitemap: "), "base_url", F.lit("/b.xml"))
    sites = table(spark, sf_dir, "data_sources").select("base_url", F.when(F.col("robots_checked"), body).alias("robots"))
    return sitemaps.starting_points(sites)


_FOUND = """(SELECT s.base_url, CASE WHEN t.crawl_status = 'FAILED' OR s.source_type = 'OTHER' THEN NULL ELSE t.url END AS url, CASE WHEN t.crawl_status = 'FAILED' OR s.source_type = 'OTHER' THEN t.url || ': unreadable' END AS error
FROM crawl_targets t JOIN data_sources s ON s.id = t.source_id)"""
_REPORT = f"""f AS {_FOUND}, u AS (SELECT DISTINCT base_url, url, {_SCORE} AS score FROM f WHERE url IS NOT NULL),
w AS (SELECT base_url, count(*) AS errors FROM f WHERE error IS NOT NULL GROUP BY 1),
g AS (SELECT base_url, count(*) AS urls_discovered, count(*) FILTER (WHERE score >= 80) AS urls_high_priority, least(count(*) FILTER (WHERE score >= 1), 500) AS urls_queued FROM u GROUP BY 1),
report AS (SELECT coalesce(g.base_url, w.base_url) AS base_url, coalesce(urls_discovered, 0) AS urls_discovered, coalesce(urls_high_priority, 0) AS urls_high_priority, coalesce(urls_queued, 0) AS urls_queued, coalesce(errors, 0) AS errors,
  CASE WHEN errors IS NULL THEN 'SUCCESS' WHEN urls_discovered > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM g FULL OUTER JOIN w ON g.base_url = w.base_url)"""


def found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base_url, url, error): stored targets as if their sites' sitemaps had been read, those that failed as faults."""
    targets, sources = _t(spark, sf_dir, "crawl_targets", "data_sources")
    rows = targets.join(sources.select(F.col("id").alias("source_id"), "base_url", "source_type"), "source_id")
    bad = F.coalesce((F.col("crawl_status") == "FAILED") | (F.col("source_type") == "OTHER"), F.lit(False))
    return rows.select("base_url", F.when(~bad, F.col("url")).alias("url"), F.when(bad, F.concat("url", F.lit(": unreadable"))).alias("error"))


@_query("discovery_report", f"WITH {_REPORT} SELECT * FROM report")
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.discovery(found_pages(spark, sf_dir))


@_query("discovery_queue", f"WITH {_REPORT} SELECT base_url, url, score AS priority, CAST(row_number() OVER (PARTITION BY base_url ORDER BY score DESC, url) AS INTEGER) AS rank FROM u WHERE score >= 1 QUALIFY rank <= 10")
def discovery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best addresses of each site."""
    return ingest.queued_urls(found_pages(spark, sf_dir), 10)


@_query(
    "cpu_percent_delta",
    """WITH c AS (SELECT user_id AS host, ts AS recorded_at, event_id, sum(CAST(floor(value) AS BIGINT)) OVER w AS idle, sum(CAST(floor(value) AS BIGINT) + event_id % 100) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, idle - lag(idle) OVER v AS di, total - lag(total) OVER v AS dt FROM c WINDOW v AS (PARTITION BY host ORDER BY recorded_at, event_id))
SELECT event_id, CASE WHEN dt IS NULL THEN NULL WHEN dt > 0 THEN CAST(round((1 - di / dt) * 100, 2) * 100 AS BIGINT) ELSE 0 END AS hundredths FROM d""",
)
def cpu_percent_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    idle = F.floor("value").cast("bigint")
    samples = events.select(F.col("user_id").alias("host"), F.struct("ts", "event_id").alias("recorded_at"), "event_id", F.sum(idle).over(w).alias("idle"), F.sum(idle + F.col("event_id") % 100).over(w).alias("total"))
    return procfs.cpu_percent_between(samples).select("event_id", F.round(F.col("cpu_percent") * 100).cast("bigint").alias("hundredths"))


@_query(
    "host_snapshots",
    """WITH c AS (SELECT user_id AS host, ts, event_id, sum(CAST(floor(value) AS BIGINT)) OVER w AS idle, sum(CAST(floor(value) AS BIGINT) + event_id % 100) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, idle - lag(idle) OVER v AS di, total - lag(total) OVER v AS dt FROM c WINDOW v AS (PARTITION BY host ORDER BY ts, event_id))
SELECT host, event_id, CAST(CASE WHEN dt IS NULL THEN NULL WHEN dt > 0 THEN round((1 - di / dt) * 100, 2) * 100 ELSE 0 END AS BIGINT) AS hundredths, CAST(event_id % 400 AS DOUBLE) AS load_1, 1.5::DOUBLE AS load_5, 2.0::DOUBLE AS load_15,
  8388608 * 1024::BIGINT AS memory_total_bytes, CASE WHEN event_id % 2 = 0 THEN (event_id + 7) * 1024 ELSE 5 * 1024 END::BIGINT AS memory_available_bytes, 1000::BIGINT AS disk_total_bytes, event_id % 1000 AS disk_available_bytes FROM d""",
)
def host_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host metrics out of text as /proc writes it, made of the events' numbers; every other host tells no available memory."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    idle, busy = F.sum(F.floor("value").cast("bigint")).over(w), F.sum(F.col("event_id") % 100).over(w)
    samples = events.select(
        F.col("user_id").alias("host"), F.struct("ts", "event_id").alias("recorded_at"), F.format_string("cpu  %d 0 0 %d 0\ncpu0 1 1 1 1\n", busy, idle).alias("stat"), F.format_string("%d.00 1.50 2.00 1/99 7", F.col("event_id") % 400).alias("loadavg"),
        F.concat(F.lit("MemTotal:       8388608 kB\nMemFree:   5 kB\n"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("MemAvailable: "), (F.col("event_id") + 7).cast("string"), F.lit(" kB\n"))).otherwise("")).alias("meminfo"),
        F.lit(1000).cast("bigint").alias("disk_total_bytes"), (F.col("event_id") % 1000).alias("disk_available_bytes"),
    )
    out = procfs.snapshots(samples).withColumns({"event_id": F.col("recorded_at.event_id"), "hundredths": F.round(F.col("cpu_percent") * 100).cast("bigint")})
    return out.drop("recorded_at", "cpu_percent")
