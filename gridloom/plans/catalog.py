"""The queries of the core library and their SQL."""

from __future__ import annotations

from gridloom.plans import files, problems, reference

QUERIES = {**reference.QUERIES, **files.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **files.SQL, **problems.SQL}
