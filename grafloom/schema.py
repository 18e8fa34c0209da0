"""The five tables of the property graph and their closed domains (fixed values)."""

from __future__ import annotations

REPOS = "name string, path string, indexed_at string, node_count int, edge_count int, file_count int"
NODES = "repo string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string"
EDGES = "repo string, edge_type string, src_qname string, dst_qname string, dst_raw string, src_file string, resolved int"
FILES = "repo string, path string, hash string"
IMPORTS = "repo string, file_path string, local_name string, target string, kind string"
TABLES = {"repos": REPOS, "nodes": NODES, "edges": EDGES, "files": FILES, "imports": IMPORTS}

NODE_KINDS = ["File", "Class", "Function", "Method", "Interface", "Config", "Service"]
SYMBOL_KINDS = ["Class", "Function", "Method", "Interface", "Config", "Service"]
EDGE_TYPES = ["CONTAINS", "IMPORTS", "CALLS", "INHERITS", "IMPLEMENTS", "USES_TYPE"]
RESOLVABLE = ["CALLS", "INHERITS", "IMPLEMENTS", "USES_TYPE"]
CALL_TARGETS = ["Function", "Method", "Class"]
TYPE_TARGETS = ["Class", "Interface"]

MAX_DEPTH, MAX_TRACE_NODES, MAX_BREADTH = 20, 500, 50
PAYLOAD_NODES = 3000
DEPENDENTS_LIMIT = SYMBOLS_LIMIT = 200
SEARCH_LIMIT = 1000
MAX_FILE_BYTES, PREVIEW_BYTES, BINARY_PROBE, SIGNATURE_CHARS = 1_500_000, 1_000_000, 8192, 500
