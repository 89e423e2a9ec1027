"""Operators for preparing training text: extraction, deduplication, quality, language, packing and scans."""
