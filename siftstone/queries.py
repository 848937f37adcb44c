"""All queries of the engine and their SQL, without the optional subpackages."""

from __future__ import annotations

from siftstone.plans import catalog_queries, flow_queries, recon_queries, report_queries, scan_queries

MODULES = [scan_queries, recon_queries, report_queries, flow_queries, catalog_queries]


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
