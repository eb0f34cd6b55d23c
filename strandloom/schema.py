"""Tables of the index, their keys and the version of the layout."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 6

_DDL = {
    "modules": "module_root string",
    "symbols": "id long, module_root string, package_path string, package_name string, file_path string, name string, kind string, recv string, signature string, fqname string, exported boolean, line int, col int",
    "calls": "id long, module_root string, package_path string, file_path string, line int, col int, from_fqname string, to_fqname string, callee_expr string, kind string",
    "unresolved_calls": "id long, module_root string, package_path string, file_path string, line int, col int, from_fqname string, expr string, reason string",
    "implements": "id long, module_root string, iface_pkg string, iface_fqname string, impl_pkg string, impl_fqname string, is_pointer boolean",
    "type_refs": "id long, module_root string, package_path string, file_path string, line int, col int, from_fqname string, to_fqname string, ref_kind string, expr string",
    "impl_methods": "module_root string, impl_fqname string",
    "iface_methods": "module_root string, iface_fqname string, method_name string",
    "package_meta": "module_root string, package_path string, indexed_at timestamp, files_hash string",
    "package_files": "module_root string, package_path string, file_path string, file_hash string",
    "index_meta": "id long, tool_version string, go_version string, indexed_at timestamp, root string, warnings int, indexed_commit string",
}

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}

SCHEMAS = {name: T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))]) for name, ddl in _DDL.items()}

#: Columns that identify a row; a later row with the same values replaces an earlier one.
KEYS = {
    "modules": ("module_root",),
    "implements": ("module_root", "iface_fqname", "impl_fqname"),
    "impl_methods": ("module_root", "impl_fqname"),
    "iface_methods": ("module_root", "iface_fqname", "method_name"),
    "package_meta": ("module_root", "package_path"),
    "package_files": ("module_root", "package_path", "file_path"),
}

#: The column by which a table's files are sorted, for pruning by Parquet statistics.
SORTED_BY = {"symbols": "fqname", "calls": "to_fqname", "type_refs": "to_fqname", "unresolved_calls": "expr", "implements": "iface_fqname"}

KINDS = ("func", "method", "type", "interface", "var", "const")
REF_KINDS = ("type_assert", "type_switch", "composite_lit", "conversion", "field_access", "embed")
