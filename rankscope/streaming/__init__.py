"""Structured Streaming entry points.

The reference has no streaming operators.  The one streaming use here is the
score registry as a folder: scorer jobs drop score files (one method per
file) into a folder and the evaluation job (Q3) runs on every new batch of
files, appending summaries.  State lives in the query's checkpoint.
"""

from rankscope.streaming.scores import evaluate_score_stream, score_file_stream  # noqa: F401
