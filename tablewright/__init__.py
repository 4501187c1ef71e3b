"""Cleaning and combining messy tables on Spark."""

from tablewright.config import CleanConfig
from tablewright.operators.carry import fill_backward, fill_forward, interpolate_linear
from tablewright.operators.combine import find_orphans, join_chain, stack, stage_rates
from tablewright.operators.dedupe import count_duplicates, dedupe, duplicate_provenance, first_seen
from tablewright.operators.impute import drop_sparse_rows, fill_constants, fill_datetime, fill_numeric
from tablewright.operators.profile import (
    count_ambiguous,
    date_evidence,
    detect_columns,
    null_counts,
    table_shape,
)
from tablewright.operators.recommend import recommend_combine
from tablewright.operators.totals import drop_total_rows, filter_source, list_sources, preview, totals, with_total_row
from tablewright.plans.combined import (
    append_tables,
    clean_batch,
    clean_joined,
    clean_merged,
    clean_simple,
    combine_auto,
)
from tablewright.plans.result import clean, clean_tables, clean_with_plan, column_roles, display_format, tables_summary
from tablewright.plans.rules import CleanPlan
from tablewright.session import build_session, clear_scratch
from tablewright.sources.readers import read_csv, read_folder, read_header, read_table
from tablewright.sources.sinks import replace_base, write_csv, write_table, write_tables
from tablewright.streaming.append_stream import AppendStream

__all__ = [name for name in dir() if not name.startswith("_")]
