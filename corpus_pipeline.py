"""A training corpus from ``documents``: language ID, near-dedup, secret scans, mixing, SentencePiece.

The stages are in ``conceptlake.llm.stages``: ``STAGES`` are (name, function of (spark, docs, sf_dir)), ``run`` applies them.
"""

from conceptlake.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
