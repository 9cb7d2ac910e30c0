"""The query catalogue."""

from . import careers, names, relational, reports, results, resumes, rollups, students, textual

QUERIES = relational.QUERIES | textual.QUERIES | careers.QUERIES | resumes.QUERIES | results.QUERIES | reports.QUERIES | rollups.QUERIES | names.QUERIES | students.QUERIES
SQL = relational.SQL | textual.SQL | careers.SQL | resumes.SQL | results.SQL | reports.SQL | rollups.SQL | names.SQL | students.SQL
