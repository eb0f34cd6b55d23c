"""Commands over an index, each answering with one JSON object."""

from __future__ import annotations

import json
import os
import platform
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strandloom import __version__, schema
from strandloom.functions import names
from strandloom.operators import graph, inventory, lookup, satisfy
from strandloom.sources import gitstate
from strandloom.sources.catalog import Catalog
from strandloom.sources.sqlite import import_sqlite
from strandloom.streaming import refresh

NOTE_DEAD = "Static analysis: calls by reflection, linkname or generated code aren't seen; interface methods are listed too."


class CommandError(Exception):
    """An error with a code that callers can tell apart."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    def payload(self) -> dict:
        return {"error": {"code": self.code, "message": str(self)}}


def _required(value: str, option: str) -> str:
    if not value.strip():
        raise CommandError("missing_required_flag", f"--{option} is required")
    return value


@dataclass
class Session:
    """An index on disk, the sources it was made from, and the options that hold for all commands."""

    catalog: Catalog
    root: str = ""
    auto_reindex: bool = False
    git: bool = False
    #: Whether the index may yet be missing.
    new: bool = False

    def __post_init__(self):
        if not self.catalog.exists("symbols") and not self.root and not self.new:
            raise CommandError("no_database", f"no index at {self.catalog.path}")

    @property
    def index(self):
        return self.catalog.index()

    def env(self) -> dict:
        """Where and when; stale packages are null where files aren't tracked."""
        stale = None
        if self.root and inventory.has_file_tracking(self.index):
            stale = sorted({r.package_path for r in refresh.stale_packages(self.catalog, self.root).toLocalIterator()})
        folder = gitstate.local_path(self.root) if self.root else "."
        asked = (self.git or os.environ.get("STRANDLOOM_ENV_GIT") == "1") and folder
        return {"ts": int(time.time()), "cwd": os.getcwd(), "os": platform.system().lower(), "arch": platform.machine(), "db": self.catalog.path, "git": gitstate.describe(folder) if asked else {"git_available": False}, "stale_packages": stale}

    def _answer(self, **values: Any) -> dict:
        return {k: [r.asDict(True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in values.items() if v is not None} | {"env": self.env()}

    def _fresh(self) -> None:
        if self.auto_reindex and self.root:
            refresh.refresh(self.catalog, self.root)

    def _symbol(self, name: str) -> tuple[str, str | None]:
        """A short name's only match, and a note on what was done."""
        if "/" in name:
            return name, None
        found = [r.fqname for r in lookup.resolve(self.index, name).collect()]
        if len(found) == 1:
            return found[0], f"{name} read as {found[0]}"
        return name, f"{name} is ambiguous: {', '.join(found)}" if found else None

    @staticmethod
    def _explain(command: str, given: str, resolved: str, note: str | None, filters: dict, **more: Any) -> dict:
        """How a command understood what it was asked; what is empty is left out."""
        return {k: v for k, v in {"command": command, "input": given, "resolved_symbol": resolved, "resolution": note, "filters": {k: v for k, v in filters.items() if v not in ("", False)}, **more}.items() if v}

    def _hint(self, symbol: str) -> str | None:
        near = [r.fqname for r in lookup.similar(self.index, symbol).collect()]
        return f"similar: {', '.join(near)}" if near else f"{symbol} is not in the index"

    def make(self, force: bool = False, tests: bool = True) -> dict:
        if force:
            self.catalog.reset()
        try:
            symbols, warnings = refresh.build(self.catalog, _required(self.root, "root"), tests=tests)
        except refresh.NothingToIndex as e:
            raise CommandError("no_packages", str(e)) from None
        self.catalog.purge_orphans(refresh.gosource.discover_modules(self.catalog.spark, self.root))
        refresh.record_run(self.catalog, self.root, warnings)
        ix = self.index
        return self._answer(indexed=True, symbols=symbols, warnings=warnings, calls=ix.calls.count(), unresolved=ix.unresolved_calls.count(), type_refs=ix.type_refs.count())

    def import_index(self, sqlite: str) -> dict:
        """Takes over an index that lies in a SQLite file."""
        path = _required(sqlite, "sqlite")
        if not os.path.exists(path):
            raise CommandError("no_database", f"no file {path}")
        import_sqlite(self.catalog, path)
        return self._answer(imported=True, symbols=self.index.symbols.count(), modules=self.catalog.module_roots())

    def find(self, q: str = "", pkg: str = "", kind: str = "", file: str = "", limit: int = 100, count: bool = False) -> dict:
        options = {"query": q, "pkg": pkg, "kind": kind, "file": file}
        self._known(kind, schema.KINDS, "kind")
        total = lambda: lookup.count_symbols(self.index, **options).first().n
        if count:
            return self._answer(count=total())
        limit = limit if limit > 0 else 100
        rows = [r.asDict() for r in lookup.find_symbols(self.index, limit + 1, **options).collect()]
        cut = len(rows) > limit
        return self._answer(symbols=rows[:limit], count=min(limit, len(rows)), total_matched=total() if cut else len(rows), truncated=cut)

    def definition(self, name: str, pkg: str = "") -> dict:
        rows = [r.asDict() for r in lookup.define(self.index, _required(name, "name"), pkg).drop("way").collect()]
        if len(rows) > 1:
            return self._answer(symbol=None, ambiguous=True, matches=rows)
        return self._answer(symbol=rows[0], ambiguous=False) if rows else self._answer(ambiguous=False, hint=self._hint(name)) | {"symbol": None}

    def callers(self, symbol: str, limit: int = 200, fuzzy: bool = False, pkg: str = "", include_unresolved: bool = False, depth: int = 1, is_test: bool = False, count: bool = False, explain: bool = False) -> dict:
        self._fresh()
        given = symbol
        symbol, note = self._symbol(_required(symbol, "symbol"))
        depth = graph.clamp(depth)
        rows = [r.asDict() for r in graph.callers(self.index, symbol, depth, limit, pkg, fuzzy, is_test).collect()]
        if count:
            return self._answer(callers_count=len(rows))
        unresolved = [r.asDict() for r in graph.unresolved_callers(self.index, symbol, fuzzy, limit).collect()] if include_unresolved else []
        hint = None
        if not rows and not unresolved:
            through = [r.iface_fqname for r in lookup.dispatching_interfaces(self.index, symbol).collect()]
            hint = f"may be called through {', '.join(through)}" if through else self._hint(symbol)
        plan = self._explain("callers", given, symbol, note, {"pkg": pkg, "is_test": is_test, "fuzzy": fuzzy}, mode="fuzzy" if fuzzy else "exact", traversal={"direction": "callers", "depth": depth, "limit_per_depth": limit}) if explain else None
        return self._answer(callers=rows, callers_count=len(rows), depth=depth, unresolved=unresolved, unresolved_count=len(unresolved), resolved=note, hint=hint, explain=plan)

    def callees(self, symbol: str, limit: int = 200, fuzzy: bool = False, pkg: str = "", include_unresolved: bool = True, unique: bool = False, count: bool = False) -> dict:
        self._fresh()
        symbol, note = self._symbol(_required(symbol, "symbol"))
        if count:
            return self._answer(callees_count=graph.count_callees(self.index, symbol, fuzzy, pkg, unique).first().n)
        rows = [r.asDict() for r in graph.callees(self.index, symbol, fuzzy, pkg, unique, limit).collect()]
        unresolved = [r.asDict() for r in graph.unresolved_callees(self.index, symbol, unique, limit).collect()] if include_unresolved else []
        return self._answer(callees=rows, callees_count=len(rows), unresolved=unresolved, unresolved_count=len(unresolved), resolved=note)

    def blast_radius(self, symbol: str, depth: int = 3, fuzzy: bool = False, pkg: str = "", exclude_tests: bool = False, limit: int = 500, explain: bool = False) -> dict:
        self._fresh()
        given = symbol
        symbol, note = self._symbol(_required(symbol, "symbol"))
        rows = graph.blast_radius(self.index, symbol, depth, limit, pkg=pkg, exclude_tests=exclude_tests, fuzzy=fuzzy).collect()
        frame = self.catalog.spark.createDataFrame(rows, "caller string, depth int, file_path string, line int, package_path string")
        notes = ["filters hold for every call on the way"] if pkg or exclude_tests else []
        plan = self._explain("blast-radius", given, symbol, note, {"pkg": pkg, "exclude_tests": exclude_tests, "fuzzy": fuzzy}, traversal={"direction": "callers", "depth": graph.clamp(depth), "limit": limit}, notes=notes) if explain else None
        return self._answer(target=symbol, callers=frame, summary=graph.blast_summary(frame, limit).first().asDict(), resolved=note, explain=plan)

    def dead(self, kind: str = "", pkg: str = "", include_exported: bool = False, limit: int = 200) -> dict:
        self._fresh()
        self._known(kind, ("func", "method"), "kind")
        options = {"kind": kind, "pkg": pkg, "include_exported": include_exported}
        rows = [r.asDict() for r in graph.dead_symbols(self.index, limit, **options).collect()]
        total = graph.all_dead(self.index, **options).count()
        return self._answer(symbols=rows, count=len(rows), total_matched=total, truncated=total > limit >= 0, note=NOTE_DEAD)

    def implementors(self, iface: str = "", type: str = "", limit: int = 200, explain: bool = False) -> dict:
        if bool(iface.strip()) == bool(type.strip()):
            raise CommandError("missing_required_flag", "give --iface or --type")
        rows = [r.asDict() for r in satisfy.implementors(self.index, iface, type, limit).collect()]
        given = iface if iface.strip() else type
        plan = self._explain("implementors", given, "", None, {}, mode="types of an interface" if iface.strip() else "interfaces of a type", normalized_query=names.plain_generics(given), notes=["names are matched as parts, without type arguments too"]) if explain else None
        return self._answer(implementors=rows, count=len(rows), explain=plan)

    def references(self, symbol: str, pkg: str = "", ref_kind: str = "", origin: str = "", limit: int = 200, count: bool = False) -> dict:
        self._known(ref_kind, schema.REF_KINDS, "ref-kind")
        symbol, note = self._symbol(_required(symbol, "symbol"))
        options = {"pkg": pkg, "ref_kind": ref_kind, "origin": origin}
        total = graph.count_references(self.index, symbol, **options).first().n
        if count:
            return self._answer(count=total)
        rows = [r.asDict() for r in graph.references(self.index, symbol, limit, **options).collect()]
        return self._answer(references=rows, count=len(rows), total_matched=total, truncated=total > len(rows), resolved=note)

    def packages(self) -> dict:
        rows = [r.asDict() for r in inventory.packages(self.index).collect()]
        return self._answer(packages=rows, count=len(rows))

    def health(self) -> dict:
        row = inventory.health(self.index).first()
        if row is None:
            raise CommandError("no_database", "the index has no run")
        return self._answer(**row.asDict(), top_unresolved=inventory.top_unresolved(self.index))

    def version(self) -> dict:
        return {"version": __version__, "schema_version": schema.VERSION}

    @staticmethod
    def _known(value: str, domain: tuple[str, ...], option: str) -> None:
        try:
            lookup.allowed(value, domain, option)
        except lookup.InvalidFlag as e:
            raise CommandError("invalid_flag_value", str(e)) from None


USAGE_LOG = "STRANDLOOM_USAGE_LOG"


def log_use(tool: str, argv: list[str], spark: SparkSession | None = None, **more: Any) -> None:
    """Appends a line of JSON on a use to the file that STRANDLOOM_USAGE_LOG names; to a folder of files where it is a URI."""
    path = os.environ.get(USAGE_LOG)
    if not path:
        return
    record = {"ts": int(time.time()), "session_id": os.environ.get("STRANDLOOM_SESSION_ID", ""), "session_name": os.environ.get("STRANDLOOM_SESSION_NAME", ""), "tool": tool, "argv": argv, "cwd": os.getcwd(), "git_branch": gitstate.git(".", "rev-parse", "--abbrev-ref", "HEAD") or ""} | more
    line = json.dumps(record, ensure_ascii=False, default=str)
    if "://" in path and spark is not None:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
    elif "://" not in path:
        with open(path, "a", encoding="utf-8") as log:
            log.write(line + "\n")
