"""wardline: clinical-records analytics as PySpark DataFrame plans.

Records live as entity-attribute-value observations (one row per question and
answer).  The library turns them into registers, censuses, indicator tables,
cohort extracts, scores and audited corrections.  See README.md.
"""

from wardline.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
