"""Schemas of the logical tables that operators take and return."""

from __future__ import annotations

FILES = "path string, content string, size long, mtime timestamp, extension string, language string, sha256 string"
LINES = "path string, line int, text string, offset long"
SYMBOLS = (
    "path string, name string, type string, start_line int, start_col int, end_line int, end_col int, "
    "scope array<struct<type:string,name:string>>, modifiers array<string>, attributes array<string>, superclass string, implements array<string>"
)
REFS = "path string, name string, line int, col int, kind string"
IMPORTS = "path string, line int, specifier string, kind string, is_relative boolean, imported array<string>"
EDGES = "src string, dst string"
FRAGMENTS = "path string, kind string, start_line int, end_line int, code string, tokens array<string>, hash string"
ISSUES = "path string, line int, column int, category string, type string, severity string, message string"
EDITS = "path string, start_line int, start_col int, end_line int, end_col int, old_text string, new_text string"
CHANGES = "path string, change string, ts timestamp"

SYMBOL_TYPES = (
    "class", "interface", "protocol", "struct", "function", "variable", "constant", "property", "type", "enum", "module", "namespace",
)
