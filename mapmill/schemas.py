"""Schemas of the tables that are read, as DDL."""

from __future__ import annotations

TESSERACT = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
OCR_CANDIDATE = (
    "struct<text string, name string, category string, bbox_pixel array<double>, quad_pixel array<array<double>>, orientation string, confidence string, quality double, ocr_id string, raw_text string,"
    " ocr_text_raw_order string, alternative_texts string, source_map string, source_stage string, reference_logic string, notes string, x double, y double, map_x double, map_y double, place_id string>"
).replace(" string", ":string").replace(" double", ":double").replace(" array", ":array")
FEATURE = "struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"
FEATURES = f"features array<{FEATURE}>"
OSM = "elements array<struct<type:string, id:bigint, lon:double, lat:double, center:struct<lon:double, lat:double>, tags:map<string,string>>>"
