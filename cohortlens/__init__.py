"""cohortlens: study analytics on Spark DataFrames.

Reports, exports and participant erasure for an online study held in four
tables (participants, code_submissions, feedback, events), expressed with
Spark's built-in operators so that they scale with the tables.
"""

from cohortlens.session import build_session, work_dir
from cohortlens.sources.tables import StudyTables, load_study, scan_table

__all__ = ["StudyTables", "build_session", "load_study", "scan_table", "work_dir"]
