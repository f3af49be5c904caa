"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from workload import fits, fits_oracle, oracle, queries

QUERIES = {**queries.QUERIES, **fits.QUERIES}
ORACLE = {**oracle.ORACLE, **fits_oracle.ORACLE}
