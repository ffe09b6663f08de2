"""Every job by name, with the SQL that checks it."""

from __future__ import annotations

from . import av_jobs, packet_jobs, report_jobs, stream_jobs

JOBS = packet_jobs.QUERIES | av_jobs.QUERIES | report_jobs.QUERIES | stream_jobs.QUERIES
#: Columns that are 32-bit in the jobs and would be 64-bit in the SQL.
INTS = {
    "contiguous_pts": ["frame_idx"], "z_order": ["draw"], "chroma_key": ["row", "col"], "rgb_to_ycbcr": ["row", "col"], "composite_text": ["row", "col"], "top_detections": ["rank"],
    "write_segments": ["stream_id"], "write_playlist": ["stream_id"],
}


def _narrowed(name: str, sql: str) -> str:
    casts = ", ".join(f'cast("{c}" as integer) as "{c}"' for c in INTS.get(name, ()))
    return f"select * replace ({casts}) from ({sql})" if casts else sql


QUERIES = {name: job for name, (job, _) in JOBS.items()}
SQL = {name: _narrowed(name, sql) for name, (_, sql) in JOBS.items()}
