"""Structured Streaming twins of the ledger, projection, market and alert operators."""
