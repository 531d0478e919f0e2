"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from . import io_queries as io
from . import log_queries as lq
from . import receipt_queries as rq
from . import state_queries as sq
from .oracles import ORACLE_SQL

QUERIES = {
    "q01_price_lenient": rq.q01_price_lenient,
    "q02_price_strict": rq.q02_price_strict,
    "q03_date_ladder": rq.q03_date_ladder,
    "q04_date_fallback": rq.q04_date_fallback,
    "q05_quantity": rq.q05_quantity,
    "q06_receipts": rq.q06_receipts,
    "q07_items_text": rq.q07_items_text,
    "q08_items_exploded": rq.q08_items_exploded,
    "q09_sum_price": rq.q09_sum_price,
    "q10_description": rq.q10_description,
    "q11_file_name": io.q11_file_name,
    "q12_label_dispatch": sq.q12_label_dispatch,
    "q13_cell_pivot": sq.q13_cell_pivot,
    "q14_state_split": sq.q14_state_split,
    "q15_pending": sq.q15_pending,
    "q16_upsert": sq.q16_upsert,
    "q17_placeholders": sq.q17_placeholders,
    "q18_skipped": sq.q18_skipped,
    "q19_progress": sq.q19_progress,
    "q20_run_totals": sq.q20_run_totals,
    "q21_mean_time": sq.q21_mean_time,
    "q22_state_counts": sq.q22_state_counts,
    "q23_csv_roundtrip": io.q23_csv_roundtrip,
    "q24_json_export": io.q24_json_export,
    "q25_data_url": io.q25_data_url,
    "q26_file_slice": io.q26_file_slice,
    "q27_display": io.q27_display,
    "q28_prompt": io.q28_prompt,
    "q29_size_budget": io.q29_size_budget,
    "q30_extract_offline": io.q30_extract_offline,
    "q31_retry_plan": sq.q31_retry_plan,
    "q32_stream_ingest": io.q32_stream_ingest,
    "q33_run_order": sq.q33_run_order,
    "q34_extract_stage": io.q34_extract_stage,
    "q35_batch_job": io.q35_batch_job,
    "q36_csv_resume": io.q36_csv_resume,
    "q37_log_append": io.q37_log_append,
    "q38_dummy_rows": sq.q38_dummy_rows,
    "q39_type_filter": io.q39_type_filter,
    "q40_skipped_file": io.q40_skipped_file,
    "q41_compacted_state": lq.q41_compacted_state,
    "q42_publish_once": lq.q42_publish_once,
    "q43_mixed_headers": lq.q43_mixed_headers,
    "q44_slot_schedule": lq.q44_slot_schedule,
    "q45_run_times": lq.q45_run_times,
}

ORACLES = dict(ORACLE_SQL)
