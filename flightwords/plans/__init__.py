"""Runnable queries; importing the query modules fills the registry."""

from importlib import import_module

from .registry import ORACLES, QUERIES, query

for _module in ("decode_queries", "mapping_queries", "encode_queries", "stream_queries", "document_queries", "adb_queries", "review_queries", "session_queries", "cell_queries", "late_queries", "live_queries", "fleet_queries", "catalog_queries", "export_queries"):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES", "query"]
