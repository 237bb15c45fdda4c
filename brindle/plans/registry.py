"""Every registered query and its SQL twin."""

from __future__ import annotations

from . import answering, evaluating, retrieval, understanding

QUERIES = retrieval.QUERIES | understanding.QUERIES | answering.QUERIES | evaluating.QUERIES
ORACLE = retrieval.ORACLE | understanding.ORACLE | answering.ORACLE | evaluating.ORACLE
