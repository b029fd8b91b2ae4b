"""Serving views, decision scores, search, reports and run-ledger analytics."""
