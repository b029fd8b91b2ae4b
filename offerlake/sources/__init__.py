"""Readers, writers and the views that give driver tables their price-comparison meaning."""
