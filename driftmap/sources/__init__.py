"""Readers and writers for CSV, JSON, NDJSON, GeoJSON and WKT."""
