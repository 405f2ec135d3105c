"""Readers and writers: CSV, GeoJSON, OCR and map extracts, texts, reports and layers."""
