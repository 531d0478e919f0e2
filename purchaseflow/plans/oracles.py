"""DuckDB oracle SQL, written from the base tables with the fixture closed forms
(FIXTURES.md), not by mirroring the cleaning code."""

from __future__ import annotations

from ..functions.text import PROMPT_HEAD, PROMPT_TAIL_BATCH

CODE = "(l_orderkey + l_linenumber + l_partkey + l_suppkey)"
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
FILE_NAME = ("lpad(CAST({k} AS VARCHAR), CAST(greatest(9, length(CAST({k} AS VARCHAR))) AS INTEGER), '0') || "
             "CASE {k} % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' ELSE '.png' END")
# Every 32nd labelled document repeats the file name of another.
SHARED_NAME = FILE_NAME.replace("{k}", "(CASE WHEN {k} % 32 = 7 THEN {k} - 1 ELSE {k} END)")
SWAPPED = "({k} % 12 IN (2, 4, 8, 11) AND day({d}) <= 12)"


WHOLE = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
TWO = f"lpad({WHOLE}, 2, '0')"


def _f1_lines() -> str:
    """Lines of F1 with their rank in the order and the F1 quantity text."""
    return f"""
    lines AS (
      SELECT l_orderkey AS k, p_name, l_partkey, l_quantity, {CENTS} AS cents,
             row_number() OVER (PARTITION BY l_orderkey
                                ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    valid AS (
      SELECT *, CASE l_partkey % 8 WHEN 2 THEN 1.0::DOUBLE WHEN 5 THEN CAST('90071992547410' || {TWO} AS DOUBLE)
                     WHEN 6 THEN CAST('123456' || {TWO} || '.5' AS DOUBLE) WHEN 7 THEN CAST('0.0005' || {TWO} AS DOUBLE)
                     ELSE CAST(l_quantity AS DOUBLE) END AS qty,
             CASE l_partkey % 8 WHEN 2 THEN '1' WHEN 4 THEN {WHOLE} || '.0' WHEN 5 THEN '90071992547410' || {TWO}
                         WHEN 6 THEN '123456' || {TWO} || '.5' WHEN 7 THEN rtrim('0.0005' || {TWO}, '0')
                         ELSE {WHOLE} END AS qty_text,
             row_number() OVER (PARTITION BY k ORDER BY rn) AS pos
      FROM lines WHERE l_partkey % 17 <> 0),
    agg AS (
      SELECT k,
             string_agg(qty_text || 'x ' || p_name || ' ($' ||
                        printf('%.2f', CAST(cents AS DOUBLE) / 100) || ')', '; ' ORDER BY rn) AS items,
             count(*) AS n_items, sum(cents) AS valid_cents
      FROM valid GROUP BY k),
    sums AS (SELECT k, sum(cents) AS line_cents FROM lines GROUP BY k),
    base AS (
      SELECT o_orderkey AS k, o_orderdate AS d, o_custkey, c_name, c_mktsegment,
             CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
             CASE WHEN o_orderkey % 97 = 5 THEN 'bad_json' WHEN o_orderkey % 97 = 6 THEN 'failed'
                  ELSE 'ok' END AS status,
             (o_orderkey % 97 NOT IN (5, 6)) AS ok,
             (o_orderkey % 97 NOT IN (5, 6) AND o_orderkey % 53 <> 7) AS has_items,
             agg.items, agg.n_items, agg.valid_cents, coalesce(sums.line_cents, 0) AS line_cents
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey
                  LEFT JOIN agg ON agg.k = o_orderkey
                  LEFT JOIN sums ON sums.k = o_orderkey)"""


Q06 = f"""
WITH {_f1_lines()}
SELECT {FILE_NAME.format(k='k')} AS File_Name, status,
  CASE WHEN NOT ok THEN '' WHEN k % 11 IN (0, 1) THEN '' WHEN k % 11 = 2 THEN NULL
       WHEN k % 11 = 3 THEN 'N/A' ELSE c_name END AS Business_Name,
  CASE WHEN NOT ok OR k % 7 = 0 THEN ''
       ELSE 'Unit ' || CAST(o_custkey AS VARCHAR) || ', ' || c_mktsegment END AS Business_Address,
  CASE WHEN NOT ok THEN '' WHEN {SWAPPED.format(k='k', d='d')} THEN strftime(d, '%m-%d-%Y')
       ELSE strftime(d, '%d-%m-%Y') END AS Date,
  CASE WHEN has_items THEN coalesce(items, '') ELSE '' END AS Items,
  CASE WHEN ok THEN CAST(line_cents AS DOUBLE) / 100 ELSE 0.0 END AS Subtotal,
  CASE WHEN ok AND k % 5 <> 0 THEN CAST(total_cents % 10000 AS DOUBLE) / 100 ELSE 0.0 END AS Tax,
  CASE WHEN ok THEN CAST(total_cents AS DOUBLE) / 100 ELSE 0.0 END AS Total,
  CASE WHEN status = 'failed' THEN 0.0::DOUBLE ELSE CAST(k % 1000 AS DOUBLE) / 100 END AS Processing_Time_Seconds,
  CASE WHEN status = 'failed' THEN '' ELSE '# receipt ' || CAST(k AS VARCHAR) END AS Raw_OCR,
  CASE WHEN NOT ok OR k % 11 = 2 THEN NULL WHEN k % 11 IN (0, 1) THEN '' WHEN k % 11 = 3 THEN 'N/A' ELSE c_name END
    AS json_name,
  CASE WHEN ok THEN 'USD' END AS json_currency,
  CASE WHEN ok THEN CAST(total_cents AS DOUBLE) / 100 END AS json_total,
  CAST(CASE WHEN NOT ok THEN NULL WHEN has_items THEN coalesce(n_items, 0) ELSE 0 END AS INTEGER) AS json_items,
  CAST(CASE WHEN ok THEN 8 ELSE 0 END AS INTEGER) AS json_keys
FROM base
"""

Q07 = f"""
WITH {_f1_lines()}
SELECT {FILE_NAME.format(k='k')} AS file_name,
  CASE WHEN has_items THEN coalesce(items, '') ELSE '' END AS items,
  CAST(CASE WHEN has_items THEN coalesce(n_items, 0) ELSE 0 END AS INTEGER) AS n_items
FROM base
"""

Q08 = f"""
WITH {_f1_lines()}
SELECT {FILE_NAME.format(k='valid.k')} AS file_name, CAST(pos AS INTEGER) AS pos,
  p_name AS description, CAST(qty AS DOUBLE) AS quantity, qty_text AS quantity_text,
  CAST(cents AS DOUBLE) / 100 AS price,
  CASE WHEN qty > 1e6 THEN qty * (CAST(cents AS DOUBLE) / 100)
       ELSE round(qty * (CAST(cents AS DOUBLE) / 100), 2) END AS line_total
FROM valid JOIN base ON base.k = valid.k
WHERE base.has_items
"""

Q09 = f"""
WITH {_f1_lines()}
SELECT {FILE_NAME.format(k='k')} AS file_name,
  round(CASE WHEN has_items THEN CAST(coalesce(valid_cents, 0) AS DOUBLE) / 100 ELSE 0.0 END, 2)
    AS sum_price
FROM base
"""

ORACLE_SQL = {
    "q01_price_lenient": f"""
SELECT {LINE_KEY},
  CASE WHEN {CODE} % 8 IN (0, 3, 6) THEN 0.0 ELSE CAST({CENTS} AS DOUBLE) / 100 END AS price
FROM lineitem""",
    "q02_price_strict": f"""
SELECT {LINE_KEY},
  CASE WHEN {CODE} % 8 IN (0, 3, 6) THEN NULL ELSE CAST({CENTS} AS DOUBLE) / 100 END AS price
FROM lineitem""",
    "q03_date_ladder": f"""
SELECT o_orderkey,
  CASE WHEN {SWAPPED.format(k='o_orderkey', d='o_orderdate')} THEN strftime(o_orderdate, '%m-%d-%Y')
       ELSE strftime(o_orderdate, '%d-%m-%Y') END AS date,
  CASE WHEN {SWAPPED.format(k='o_orderkey', d='o_orderdate')}
       THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
       ELSE CAST(o_orderdate AS DATE) END AS date_value
FROM orders""",
    "q04_date_fallback": """
SELECT o_orderkey,
  CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%m-%d-%Y')
    WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
    WHEN 2 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%d-%m-%Y')
                     ELSE strftime(o_orderdate, '%m-%d-%Y') END
    WHEN 3 THEN strftime(o_orderdate, '%m-%d-%Y')
    WHEN 4 THEN CASE WHEN month(o_orderdate) = 5 THEN strftime(o_orderdate, '%d-%m-%Y')
                     ELSE strftime(o_orderdate, '%b') || ' ' || CAST(day(o_orderdate) AS VARCHAR)
                          || ', ' || strftime(o_orderdate, '%Y') END
    ELSE '' END AS date
FROM orders""",
    "q05_quantity": f"""
SELECT {LINE_KEY},
  CASE {CODE} % 10 WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 1.0 WHEN 5 THEN 1.0 WHEN 6 THEN CAST('90071992547410' || {TWO} AS DOUBLE)
    WHEN 7 THEN CAST('123456' || {TWO} || '.5' AS DOUBLE) WHEN 9 THEN CAST('123456' || {TWO} || '.5' AS DOUBLE)
    WHEN 8 THEN CAST('0.0005' || {TWO} AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS quantity,
  CASE {CODE} % 10 WHEN 3 THEN '1' WHEN 4 THEN '1' WHEN 5 THEN '1' WHEN 6 THEN '90071992547410' || {TWO}
    WHEN 7 THEN '123456' || {TWO} || '.5' WHEN 9 THEN '123456' || {TWO} || '.5'
    WHEN 8 THEN rtrim('0.0005' || {TWO}, '0') ELSE {WHOLE} END AS quantity_text,
  CASE {CODE} % 10 WHEN 0 THEN CAST(l_quantity AS BIGINT) WHEN 6 THEN CAST('90071992547410' || {TWO} AS BIGINT) END
    AS strict_quantity
FROM lineitem""",
    "q06_receipts": Q06,
    "q07_items_text": Q07,
    "q08_items_exploded": Q08,
    "q09_sum_price": Q09,
    "q10_description": f"""
SELECT {LINE_KEY}, p_name AS description
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_partkey % 17 <> 0""",
}


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PROMPT_SQL = (sql_literal(PROMPT_HEAD), sql_literal(PROMPT_TAIL_BATCH))


# ---------------------------------------------------------------- labelled cells (F5)

_F5_LINES = f"""
    lines AS (
      SELECT l_orderkey AS k, p_name, l_quantity, {CENTS} AS cents,
             row_number() OVER (PARTITION BY l_orderkey
                                ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
      FROM lineitem JOIN part ON p_partkey = l_partkey)"""

ORACLE_SQL["q12_label_dispatch"] = f"""
WITH {_F5_LINES},
    agg AS (SELECT k, sum(cents) AS c, count(*) AS n FROM lines WHERE rn % 5 <> 0 GROUP BY k)
SELECT o_orderkey, {SHARED_NAME.format(k='o_orderkey')} AS file_name, c_name AS business_name,
  strftime(o_orderdate, '%Y-%m-%d') AS date,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10000 AS DOUBLE) / 100 AS tax,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 AS total,
  round(CAST(coalesce(c, 0) AS DOUBLE) / 100, 2) AS subtotal,
  CAST(coalesce(n, 0) AS BIGINT) AS n_items
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN agg ON agg.k = o_orderkey
"""

ORACLE_SQL["q13_cell_pivot"] = f"""
WITH {_F5_LINES}
SELECT k AS o_orderkey, {SHARED_NAME.format(k='k')} AS file_name, CAST(rn AS BIGINT) AS row, p_name AS description,
  CAST(cents AS DOUBLE) / 100 AS price, CAST(l_quantity AS BIGINT) AS quantity
FROM lines WHERE rn % 5 <> 0
"""

# ---------------------------------------------------------------- attempt log (F6)

_F6 = """
    att AS (
      SELECT strftime(ts, '%Y-%m-%d') AS run_id,
             'r' || CAST(user_id AS VARCHAR) || '.jpg' AS file_name,
             '/data/receipts/r' || CAST(user_id AS VARCHAR) || '.jpg' AS path,
             event_id AS attempt_seq, ts AS attempted_at, value AS processing_time,
             CASE WHEN event_type IN ('purchase', 'view') THEN 'ok'
                  WHEN event_type = 'signup' THEN 'bad_json'
                  WHEN event_type = 'click' THEN 'timeout' ELSE 'failed' END AS status,
             CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN NULL
                  WHEN event_type = 'click' THEN 'chat: no time left'
                  WHEN event_id % 4 = 0 THEN 'ocr: HTTP 429 Too Many Requests'
                  WHEN event_id % 4 = 1 THEN 'ocr: HTTP 400 Bad Request'
                  WHEN event_id % 4 = 2 THEN 'chat: HTTP 400 Bad Request'
                  ELSE 'chat: HTTP 500 Server Error' END AS error
      FROM events),
    latest AS (
      SELECT file_name, max(attempt_seq) AS attempt_seq, arg_max(status, attempt_seq) AS status,
             arg_max(path, attempt_seq) AS path, arg_max(processing_time, attempt_seq) AS processing_time,
             arg_max(run_id, attempt_seq) AS run_id, min(attempt_seq) AS first_seen,
             count(*) AS n_attempts
      FROM att GROUP BY file_name)"""

ORACLE_SQL["q14_state_split"] = f"""
WITH {_F6}
SELECT file_name, attempt_seq, status,
  CASE WHEN status = 'ok' THEN 'completed' ELSE 'placeholder' END AS state
FROM latest
"""

ORACLE_SQL["q15_pending"] = f"""
WITH {_F6}
SELECT 'r' || CAST(c_custkey AS VARCHAR) || '.jpg' AS file_name,
       '/data/receipts/r' || CAST(c_custkey AS VARCHAR) || '.jpg' AS path
FROM customer
WHERE 'r' || CAST(c_custkey AS VARCHAR) || '.jpg' NOT IN
      (SELECT file_name FROM latest WHERE status = 'ok')
"""

ORACLE_SQL["q16_upsert"] = f"""
WITH {_F6}
SELECT file_name, attempt_seq, status, processing_time, run_id, first_seen, n_attempts FROM latest
"""

ORACLE_SQL["q17_placeholders"] = f"""
WITH {_F6}
SELECT file_name AS File_Name, '' AS Business_Name, '' AS Business_Address, '' AS Date,
  '' AS Items, 0.0::DOUBLE AS Subtotal, 0.0::DOUBLE AS Tax, 0.0::DOUBLE AS Total,
  0.0::DOUBLE AS Processing_Time_Seconds, '' AS Raw_OCR, '{{}}' AS Extracted_JSON
FROM latest WHERE status IN ('failed', 'timeout', 'error')
"""

ORACLE_SQL["q18_skipped"] = f"""
WITH {_F6}
SELECT DISTINCT path FROM latest WHERE status IN ('failed', 'timeout', 'error')
"""

ORACLE_SQL["q19_progress"] = f"""
WITH {_F6},
    run AS (
      SELECT *, count(*) OVER w AS processed,
             CAST(sum(CASE WHEN status IN ('ok', 'bad_json') THEN 1 ELSE 0 END) OVER w AS BIGINT)
               AS succeeded
      FROM att
      WINDOW w AS (PARTITION BY run_id ORDER BY attempt_seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run_id, attempt_seq, file_name, processed, succeeded,
  round(CAST(succeeded AS DOUBLE) * 100.0 / processed, 6) AS success_rate
FROM run WHERE status NOT IN ('timeout', 'error')
"""

ORACLE_SQL["q20_run_totals"] = f"""
WITH {_F6}
SELECT run_id, count(*) AS n_attempts,
  count(*) FILTER (WHERE status IN ('ok', 'bad_json')) AS n_results,
  count(*) FILTER (WHERE status IN ('failed', 'timeout', 'error')) AS n_skipped
FROM att GROUP BY run_id
"""

ORACLE_SQL["q21_mean_time"] = f"""
WITH {_F6}
SELECT run_id, round(avg(processing_time), 6) AS mean_time, count(*) AS n_results
FROM att WHERE status IN ('ok', 'bad_json') GROUP BY run_id
"""

ORACLE_SQL["q22_state_counts"] = f"""
WITH {_F6}
SELECT CASE WHEN status = 'ok' THEN 'completed' ELSE 'placeholder' END AS state,
  count(*) AS n_files
FROM latest GROUP BY 1
"""

ORACLE_SQL["q31_retry_plan"] = f"""
WITH {_F6},
    skips AS (
      SELECT *, row_number() OVER (PARTITION BY file_name, run_id ORDER BY attempt_seq) - 1 AS retry_no
      FROM att WHERE status IN ('failed', 'timeout', 'error')),
    waits AS (
      SELECT *, CASE WHEN retry_no >= 3 THEN NULL
                     WHEN status = 'failed' AND attempt_seq % 4 = 0
                       THEN CAST(power(2, retry_no) * 30 + 1 + attempt_seq % 30 AS BIGINT)
                     WHEN status = 'failed' AND attempt_seq % 4 = 1 THEN 5::BIGINT END AS wait_seconds
      FROM skips)
SELECT file_name, attempt_seq, error, CAST(retry_no AS BIGINT) AS retry_no, wait_seconds,
  attempted_at + to_seconds(wait_seconds) AS next_attempt_at, wait_seconds IS NULL AS give_up
FROM waits
"""

ORACLE_SQL["q32_stream_ingest"] = f"""
WITH {_F6}
SELECT file_name, attempt_seq, status, CAST(1 + attempt_seq % 2 AS INTEGER) AS ingest_run FROM att
"""

ORACLE_SQL["q33_run_order"] = f"""
WITH {_F6},
    placed AS (SELECT *, 1 + attempt_seq % 2 AS run_seq, attempt_seq // 2 AS seq FROM att),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY run_seq DESC, seq DESC) AS r,
                      count(*) OVER (PARTITION BY file_name) AS n_attempts,
                      first_value(seq) OVER (PARTITION BY file_name ORDER BY run_seq, seq) AS first_seen
               FROM placed)
SELECT file_name, run_seq, seq AS attempt_seq, status, 'run' || CAST(run_seq AS VARCHAR) AS run_id, first_seen, n_attempts
FROM ranked WHERE r = 1
"""

ORACLE_SQL["q37_log_append"] = f"""
WITH {_F6}
SELECT run_id, attempt_seq, file_name, path, status, error, processing_time, processing_time * 2 AS wall_time FROM att
"""

ORACLE_SQL["q40_skipped_file"] = ORACLE_SQL["q18_skipped"]

# ---------------------------------------------------------------- names, files, media, text

ORACLE_SQL["q11_file_name"] = """
SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS file_name FROM pages
"""

ORACLE_SQL["q23_csv_roundtrip"] = """
SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.jpg' AS File_Name,
  nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || ' | ' || lang END, '') AS Business_Name,
  '  "' || lang || '" \\ ' || source || '  ' AS Business_Address,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang || '-' || source END AS Date,
  CAST(doc_id % 3 AS VARCHAR) || 'x item|' || lang AS Items,
  CAST(n_chars AS DOUBLE) / 100 AS Subtotal, CAST(doc_id AS DOUBLE) / 10 AS Tax,
  CAST(n_chars AS DOUBLE) AS Total, CAST(doc_id AS DOUBLE) / 1000 AS Processing_Time_Seconds,
  nullif(text, '') AS Raw_OCR,
  '{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '"}' AS Extracted_JSON
FROM documents
"""

ORACLE_SQL["q24_json_export"] = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS business_name,
  strftime(o_orderdate, '%d-%m-%Y') AS date, CAST(1 AS INTEGER) AS n_items,
  o_totalprice AS subtotal, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS tax,
  o_totalprice AS total, CAST(6 AS INTEGER) AS n_keys, (o_orderkey % 4 = 0) AS has_null_name
FROM orders
"""

ORACLE_SQL["q25_data_url"] = f"""
SELECT doc_id, {FILE_NAME.format(k='doc_id')} AS file_name,
  'data:' || CASE doc_id % 3 WHEN 2 THEN 'image/png' ELSE 'image/jpeg' END || ';base64,'
    || to_base64(encode(text)) AS data_url
FROM documents
"""

ORACLE_SQL["q26_file_slice"] = """
SELECT page_id, url, regexp_extract(url, '[^/]*$', 0) AS file_name
FROM pages ORDER BY url, page_id LIMIT 50 OFFSET 10
"""

ORACLE_SQL["q27_display"] = """
WITH c AS (
  SELECT c_custkey, c_acctbal,
    CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN NULL ELSE c_name END AS name,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS d,
    CASE WHEN c_custkey % 5 = 0 THEN 0.0 WHEN c_custkey % 5 = 1 THEN NULL ELSE c_acctbal END AS tax
  FROM customer)
SELECT c_custkey, coalesce(nullif(name, ''), 'Unknown Business') AS display_name,
  coalesce(nullif(d, ''), 'Unknown') AS display_date,
  CASE WHEN tax IS NULL OR tax = 0 THEN '$0.00' ELSE '$' || printf('%.2f', tax) END AS tax_app,
  CASE WHEN tax IS NULL OR tax = 0 THEN 'N/A' ELSE '$' || printf('%.2f', tax) END AS tax_main,
  '$' || printf('%.2f', c_acctbal) AS balance
FROM c
"""

ORACLE_SQL["q28_prompt"] = f"""
SELECT doc_id, {PROMPT_SQL[0]} || coalesce(text, '') || {PROMPT_SQL[1]} AS prompt FROM documents
"""

_SIZE = "(CAST(n_chars * 1024 AS DOUBLE) / 1048576)"
_SCALE = f"sqrt(3.0 / {_SIZE})"
ORACLE_SQL["q29_size_budget"] = f"""
SELECT doc_id, {_SIZE} AS size_mb,
  CASE WHEN {_SIZE} > 3.0 THEN {_SCALE} ELSE 1.0 END AS scale,
  CASE WHEN {_SIZE} > 3.0 THEN CAST(floor((1000 + doc_id % 3000) * {_SCALE}) AS BIGINT)
       ELSE 1000 + doc_id % 3000 END AS new_width,
  CASE WHEN {_SIZE} > 3.0 THEN CAST(floor((800 + doc_id % 2000) * {_SCALE}) AS BIGINT)
       ELSE 800 + doc_id % 2000 END AS new_height
FROM documents
"""

ORACLE_SQL["q30_extract_offline"] = f"""
WITH {_F5_LINES},
    agg AS (
      SELECT k, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'x ' || p_name || ' ($'
                           || printf('%.2f', CAST(cents AS DOUBLE) / 100) || ')', '; ' ORDER BY rn)
               AS items,
             count(*) AS n, sum(cents) AS c
      FROM lines GROUP BY k)
SELECT {FILE_NAME.format(k='o_orderkey')} AS file_name, 'ok' AS status, c_name AS business_name,
  strftime(o_orderdate, '%d-%m-%Y') AS date, coalesce(items, '') AS items,
  CAST(coalesce(c, 0) AS DOUBLE) / 100 AS subtotal,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10000 AS DOUBLE) / 100 AS tax,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 AS total,
  CAST(coalesce(n, 0) AS INTEGER) AS n_items
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN agg ON agg.k = o_orderkey
"""

ORACLE_SQL["q34_extract_stage"] = """
SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.jpg' AS file_name,
  CASE WHEN doc_id % 10 = 3 THEN 'failed' WHEN doc_id % 10 = 5 THEN 'error' WHEN doc_id % 10 = 7 THEN 'timeout'
       WHEN doc_id % 10 = 9 THEN 'bad_json' ELSE 'ok' END AS status,
  CASE doc_id % 10 WHEN 3 THEN 'ocr: no answer' WHEN 5 THEN 'chat: HTTP 500' WHEN 7 THEN 'ocr: too slow' END AS error,
  CASE WHEN doc_id % 10 IN (3, 5, 7, 9) THEN '' ELSE source END AS business_name,
  CASE WHEN doc_id % 10 IN (3, 5, 7, 9) THEN 0.0::DOUBLE ELSE CAST(length(text) AS DOUBLE) END AS total
FROM documents
"""

ORACLE_SQL["q35_batch_job"] = ORACLE_SQL["q30_extract_offline"].replace(
    "'ok' AS status, c_name AS business_name", "'ok' AS status, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) "
    "AS n_attempts, c_name AS business_name").replace(",\n  CAST(coalesce(n, 0) AS INTEGER) AS n_items", "")

ORACLE_SQL["q36_csv_resume"] = """
WITH d AS (
  SELECT doc_id AS k, 'doc' || CAST(doc_id AS VARCHAR) || '.jpg' AS f, doc_id % 4 <> 3 AS has_row, doc_id % 3 <> 0 AS in_slice,
         (doc_id % 5 = 0 OR doc_id % 7 IN (1, 2)) AS blank
  FROM documents)
SELECT f AS file_name,
  CASE WHEN has_row THEN CASE WHEN NOT blank THEN 'completed' WHEN in_slice THEN 'placeholder' ELSE 'outside' END END AS state,
  in_slice AND NOT (has_row AND NOT blank) AS pending
FROM d WHERE has_row OR in_slice
"""

ORACLE_SQL["q38_dummy_rows"] = """
SELECT c_custkey, 'r' || CAST(c_custkey AS VARCHAR) || '.jpg' AS File_Name FROM customer WHERE c_custkey % 6 NOT IN (0, 1)
"""

ORACLE_SQL["q39_type_filter"] = """
SELECT page_id, regexp_extract(url, '[^/]*$', 0) ||
       CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' ELSE '.png' END AS file_name
FROM pages WHERE page_id % 5 < 3
"""

# ---------------------------------------------------------------- published runs, planned starts

_RUNS = """
    placed AS (SELECT *, 1 + attempt_seq % {n} AS run_seq, attempt_seq // {n} AS seq,
                      'run' || CAST(1 + attempt_seq % {n} AS VARCHAR) AS run FROM att)"""

ORACLE_SQL["q41_compacted_state"] = f"""
WITH {_F6}, {_RUNS.format(n=3)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY run_seq DESC, seq DESC) AS r,
                      count(*) OVER (PARTITION BY file_name) AS n_attempts,
                      first_value(seq) OVER (PARTITION BY file_name ORDER BY run_seq, seq) AS first_seen
               FROM placed)
SELECT file_name, status, run AS run_id, run_seq, seq AS attempt_seq, first_seen, n_attempts FROM ranked WHERE r = 1
"""

ORACLE_SQL["q42_publish_once"] = f"""
WITH {_F6}, {_RUNS.format(n=2)}
SELECT run AS run_id, run_seq, seq AS attempt_seq, file_name, status, error, processing_time FROM placed
"""

ORACLE_SQL["q43_mixed_headers"] = ORACLE_SQL["q23_csv_roundtrip"]

ORACLE_SQL["q44_slot_schedule"] = ORACLE_SQL["q31_retry_plan"].split("SELECT file_name, attempt_seq, error, CAST")[0].rstrip() + """,
    tasks AS (
      SELECT file_name, attempt_seq, attempted_at + to_seconds(wait_seconds) AS released_at FROM waits WHERE wait_seconds IS NOT NULL
      UNION ALL
      SELECT 'r' || CAST(c_custkey AS VARCHAR) || '.jpg', NULL, (SELECT min(attempted_at) FROM att) FROM customer
      WHERE 'r' || CAST(c_custkey AS VARCHAR) || '.jpg' NOT IN (SELECT file_name FROM att)),
    slots AS (SELECT *, row_number() OVER (ORDER BY released_at, file_name, attempt_seq NULLS FIRST) - 1 AS slot FROM tasks)
SELECT file_name, attempt_seq, released_at, slot,
  make_timestamp(slot * 5000000 + max(epoch_us(released_at) - slot * 5000000) OVER (ORDER BY slot)) AS start_at
FROM slots
"""

ORACLE_SQL["q45_run_times"] = f"""
WITH {_F6}, {_RUNS.format(n=2)}
SELECT run AS run_id, count(*) AS n_attempts, count(*) FILTER (WHERE status IN ('ok', 'bad_json')) AS n_results,
  count(*) FILTER (WHERE status IN ('failed', 'timeout', 'error')) AS n_skipped,
  round(sum(processing_time), 3) AS processing_time, round(sum(processing_time * 2), 3) AS wall_time
FROM placed GROUP BY run
"""
