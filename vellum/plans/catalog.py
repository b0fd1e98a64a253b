"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from . import analysis, content, documents, packages, scalar, structure

QUERIES = scalar.QUERIES | structure.QUERIES | analysis.QUERIES | documents.QUERIES | packages.QUERIES | content.QUERIES
SQL = scalar.SQL | structure.SQL | analysis.SQL | documents.SQL | packages.SQL | content.SQL
