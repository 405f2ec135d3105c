"""Operators on DataFrames: joins with fallbacks, ranks, mentions, matching, georeferencing, boxes, samples and upserts."""
