"""SQL that any engine can hold against those queries of this package that SQL can express over whole tables."""

from __future__ import annotations

#: Letters of other alphabets and languages that stand for a Latin one, in two lines of equal length.
_FROM = "авсԁеһіјкӏморԛѕтуѵԝхп" "АВСЕНІЈКМОРЅТУХ" "αεικνορτυχη" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ὸόὰάὲέὶίὺύ" "ÐðƉɖıɑɡȷ"
_TO = "abcdehijklmopqstyvwxn" "ABCEHIJKMOPSTYX" "aeikvoptuxn" "ABEZHIKMNOPTYX" "òóàáèéìíùú" "ĐđĐđiagj"
_WIDE, _ASCII = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_HIDDEN = r"\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}"
_BLANKS = r"\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_INLINE = "a|b|i|u|em|strong|span|font|small|big|sup|sub|blink|marquee|mark|tt|code"

_KEY = (
    f"trim(regexp_replace(lower(nfc_normalize(translate(translate(regexp_replace(normalized_name, '[{_HIDDEN}]', '', 'g'), '{_WIDE}', '{_ASCII}'), "
    f"'{_FROM}', '{_TO}'))), '[\\s{_BLANKS}]+', ' ', 'g'))"
)
P2 = f"""
WITH r AS (SELECT phone_number_id, id, {_KEY} AS k, CASE status WHEN 'CONFIRMED' THEN 3 WHEN 'CANDIDATE' THEN 2 WHEN 'REJECTED' THEN 1 ELSE 0 END AS a,
  coalesce(CASE trust_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END, 0) AS b, coalesce(confidence, -1) AS c,
  coalesce(last_seen_at, TIMESTAMP '0001-01-01') AS d, (category IS NOT NULL)::INT AS e
  FROM phone_identities LEFT JOIN claim_source_trust USING (claim_source) WHERE phone_number_id IS NOT NULL AND normalized_name IS NOT NULL),
m AS (SELECT phone_number_id, k, max(a) AS a, max(b) AS b, max(c) AS c, max(d) AS d, max(e) AS e FROM r GROUP BY 1, 2 HAVING count(*) > 1)
SELECT phone_number_id, min(id) AS survivor_id FROM r JOIN m USING (phone_number_id, k, a, b, c, d, e) GROUP BY phone_number_id, k HAVING count(*) = 1
"""


def _odd(text: str) -> str:
    bare = rf"regexp_replace({text}, '[{_HIDDEN}\x{{0300}}-\x{{036F}}]', '', 'g')"
    return rf"""(regexp_matches(regexp_replace({text}, '({_EMOJI}\x{{FE0F}}?\x{{200D}})+', '', 'g'), '[\t{_HIDDEN}\x{{FF01}}-\x{{FFEE}}{_BLANKS}ÐðƉɖıɑɡȷſᴏ]')
 OR nfc_normalize({text}) <> {text} OR regexp_matches({bare}, '\p{{Latin}}[\p{{Cyrillic}}\p{{Greek}}]|[\p{{Cyrillic}}\p{{Greek}}]\p{{Latin}}'))"""


P3 = f"""
SELECT DISTINCT 'phone_identities' AS src_table, id AS record_id FROM phone_identities WHERE {_odd('normalized_name')}
UNION ALL SELECT DISTINCT 'phone_observations', id FROM phone_observations WHERE {_odd('context_text')}
"""
P6 = rf"""
WITH l AS (SELECT id, coalesce(source_id, '') AS s, unnest(string_split(raw_content, chr(10))) AS line, generate_subscripts(string_split(raw_content, chr(10)), 1) AS n FROM raw_documents),
t AS (SELECT id, s, n, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(line, '(?i)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),
  '(?i)</?({_INLINE})(\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS said FROM l),
w AS (SELECT * FROM t WHERE regexp_matches(said, '[\p{{L}}\p{{N}}]')), c AS (SELECT s, said, count(DISTINCT id) AS docs FROM w GROUP BY 1, 2),
a AS (SELECT coalesce(source_id, '') AS s, count(*) AS total FROM raw_documents GROUP BY 1)
SELECT id AS raw_document_id, CAST(n AS INTEGER) AS line_no FROM w JOIN c USING (s, said) JOIN a USING (s) WHERE docs >= 5 AND docs >= 0.2 * total
"""
P6_CLEANED = f"""
WITH found AS ({P6}), lines AS (SELECT id, unnest(string_split(raw_content, chr(10))) AS line, generate_subscripts(string_split(raw_content, chr(10)), 1) AS n FROM raw_documents),
kept AS (SELECT lines.id, string_agg(line, chr(10) ORDER BY n) AS text FROM lines LEFT JOIN found ON found.raw_document_id = lines.id AND found.line_no = lines.n WHERE found.line_no IS NULL GROUP BY 1),
touched AS (SELECT DISTINCT raw_document_id AS id FROM found)
SELECT r.id AS raw_document_id, CASE WHEN touched.id IS NULL THEN r.raw_content ELSE coalesce(kept.text, '') END AS text FROM raw_documents r LEFT JOIN touched ON touched.id = r.id LEFT JOIN kept ON kept.id = r.id
"""
SQL = {"p2_found": P2, "p3_found": P3, "p6_found": P6, "p6_cleaned": P6_CLEANED}
