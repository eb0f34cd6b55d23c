"""``python -m strandloom.cli COMMAND --db FOLDER``: the commands of :mod:`strandloom.api`.

Answers are JSON, or lines of text with ``--text``.
"""

from __future__ import annotations

import argparse
import inspect
import itertools
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from strandloom import __version__, schema
from strandloom.api import CommandError, Session, log_use
from strandloom.sources.catalog import Catalog

COMMANDS = {
    "index": "make", "find": "find", "def": "definition", "callers": "callers", "callees": "callees", "blast-radius": "blast_radius", "dead": "dead", "implementors": "implementors",
    "references": "references", "packages": "packages", "health": "health", "version": "version", "import": "import_index",
}
FOLDER = ".strandloom"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise CommandError("unknown_command_or_flag", message)


def parser() -> argparse.ArgumentParser:
    """One sub-command for each, its options those of the method."""
    whole = _Parser(prog="strandloom")
    commands = whole.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("agent-context", "manifest"):
        commands.add_parser(name)
    use = commands.add_parser("log-tool-use")
    use.add_argument("--tool", default="")
    use.add_argument("argv", nargs="*")
    for name, method in COMMANDS.items():
        sub = commands.add_parser(name)
        sub.add_argument("--db", default="")
        sub.add_argument("--root", default="")
        sub.add_argument("--git", action="store_true")
        sub.add_argument("--text", action="store_true")
        sub.add_argument("--auto-reindex", action="store_true")
        for option, p in list(inspect.signature(getattr(Session, method)).parameters.items())[1:]:
            flag = "--from" if option == "origin" else "--" + option.replace("_", "-")
            if isinstance(p.default, bool):
                sub.add_argument(flag, dest=option, action=argparse.BooleanOptionalAction, default=p.default)
            elif p.default is inspect.Parameter.empty:
                sub.add_argument(*(["name"] if name == "def" and option == "name" else [flag]), **({} if option == "name" else {"dest": option, "default": ""}))
            else:
                sub.add_argument(flag, dest=option, type=type(p.default), default=p.default)
    return whole


#: What each command is for, an example of its options, and what to ask next.
HELP = {
    "index": ("Index the modules below a folder.", "--root .", ["health", "packages"]),
    "find": ("Search symbols by name, package, kind or file.", "--q Store --kind type", ["def", "callers"]),
    "def": ("Look up one symbol; several matches are listed as ambiguous.", "NewStore", ["callers", "callees"]),
    "callers": ("Calls of a symbol, up to some calls before it.", "--symbol NewStore --depth 2", ["blast-radius"]),
    "callees": ("What a symbol calls.", "--symbol NewStore --unique", ["callers"]),
    "blast-radius": ("Everything that reaches a symbol, by depth.", "--symbol NewStore --depth 3 --exclude-tests", ["callers"]),
    "dead": ("Functions and methods that nothing calls.", "--kind func", ["references"]),
    "implementors": ("Types of an interface, or interfaces of a type.", "--iface Reader", ["references"]),
    "references": ("Where a type is used: assertions, switches, literals, conversions, fields, embedding.", "--symbol Store --ref-kind embed", ["implementors"]),
    "packages": ("Packages with their numbers of symbols.", "", ["find"]),
    "health": ("Row counts, warnings and the share of calls that aren't resolved.", "", ["index"]),
    "version": ("Version of the package and of the layout.", "", []),
    "import": ("Take over an index that lies in a SQLite file.", "--sqlite index.sqlite", ["health"]),
}
ERRORS = ("missing_required_flag", "invalid_flag_value", "no_database", "no_packages", "unknown_command_or_flag")


def manifest() -> dict:
    """Each command's purpose, options with type and default, an example and what follows, from the methods themselves."""
    out = {}
    for name, method in COMMANDS.items():
        summary, example, after = HELP[name]
        options = [
            {"name": "--from" if o == "origin" else "--" + o.replace("_", "-"), "type": type(p.default).__name__ if p.default is not inspect.Parameter.empty else "str", "default": None if p.default is inspect.Parameter.empty else p.default, "required": p.default is inspect.Parameter.empty}
            for o, p in list(inspect.signature(getattr(Session, method)).parameters.items())[1:]
        ]
        out[name] = {"summary": summary, "usage": f"strandloom {name} {example}".strip(), "options": options, "next": after, "errors": list(ERRORS)}
    return out


def tool_manifest() -> dict:
    """The same as the description of one command-line tool."""
    return {"name": "strandloom", "version": __version__, "schema_version": schema.VERSION, "output": "json", "tools": [{"name": n, "description": m["summary"], "arguments": m["options"]} for n, m in manifest().items()]}


def explained(plan: dict) -> list[str]:
    """An explanation as indented lines."""
    out = ["explain:"]
    for key, value in plan.items():
        if isinstance(value, dict):
            out += [f"  {key}:", *(f"    {k}: {v if isinstance(v, str) else json.dumps(v)}" for k, v in sorted(value.items()))]
        elif isinstance(value, list):
            out += [f"  {key}:", *(f"    - {v}" for v in value)]
        else:
            out.append(f"  {key}: {value}")
    return out


def as_text(command: str, answer: dict) -> str:
    """Rows as lines of fields between tabs; callers of a blast radius by depth."""
    out = [f"# {answer['resolved']}"] if answer.get("resolved") else []
    if answer.get("explain"):
        out += explained(answer["explain"])
    if command == "blast-radius":
        out.append(f"blast-radius: {answer['target']}")
        for depth, rows in itertools.groupby(answer["callers"], key=lambda r: r["depth"]):
            out += ["", f"  [depth {depth}]", *(f"    {r['caller']:<60} {r['file_path'] and '{file_path}:{line}'.format(**r)}".rstrip() for r in rows)]
        total = answer["summary"]
        out += ["", f"{total['total']} callers ({total['test']} in tests), depth {total['max_depth_reached']}" + (", cut off" if total["truncated"] else "") if total["total"] else "no callers found"]
        return "\n".join(out)
    listed = False
    for key, value in answer.items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            listed = True
            out += ["\t".join(_line(r)) for r in value]
        elif key == "symbol" and isinstance(value, dict):
            listed = True
            out.append("\t".join(_line(value)))
    if not listed:
        out += [f"{k}\t{v}" for k, v in answer.items() if k not in ("env", "resolved", "explain") and not isinstance(v, (list, dict))]
    return "\n".join(out)


def _line(row: dict) -> list[str]:
    """A row's values, its file, line and column as one."""
    if row.get("file_path") is None or "line" not in row:
        return [str(v) for v in row.values()]
    place = ":".join(str(row[k]) for k in ("file_path", "line", "col") if k in row)
    return [str(v) for k, v in row.items() if k not in ("file_path", "line", "col")] + [place]


def nearest_index(start: str) -> str:
    """The index folder in a directory or the nearest one above it, or ""."""
    here = os.path.abspath(start)
    while True:
        if os.path.isdir(found := os.path.join(here, FOLDER)):
            return found
        if (up := os.path.dirname(here)) == here:
            return ""
        here = up


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    began, code, command, catalog = time.time(), 2, "", None
    try:
        options = vars(parser().parse_args(argv))
        command = options.pop("command")
        if command == "agent-context":
            print(json.dumps({"commands": manifest(), "env": {"cwd": os.getcwd(), "db": nearest_index(".")}}))
            code = 0
        elif command == "manifest":
            print(json.dumps(tool_manifest()))
            code = 0
        elif command == "log-tool-use":
            if not options["tool"]:
                raise CommandError("missing_required_flag", "--tool is required")
            log_use(options["tool"], options["argv"], spark)
            return 0
        else:
            db, root, git, auto, text = (options.pop(k) for k in ("db", "root", "git", "auto_reindex", "text"))
            path = db or (os.path.join(root, FOLDER) if command == "index" and root else nearest_index("."))
            if not path:
                raise CommandError("no_database", "no index here or above; give --db")
            catalog = Catalog(spark or SparkSession.builder.appName("strandloom").getOrCreate(), path if "://" in path else "file://" + os.path.abspath(path))
            session = Session(catalog, root and (root if "://" in root else "file:" + os.path.abspath(root)), auto, git, command == "import")
            answer = getattr(session, COMMANDS[command])(**options)
            print(as_text(command, answer) if text else json.dumps(answer, ensure_ascii=False, default=str))
            code = 0
    except CommandError as e:
        print(json.dumps(e.payload() | ({"valid_commands": sorted(COMMANDS)} if e.code == "unknown_command_or_flag" else {})), file=sys.stderr)
    log_use("strandloom", argv, catalog.spark if catalog else None, cmd=command, duration_ms=int((time.time() - began) * 1000), exit_code=code, db=catalog.path if catalog else "")
    return code


if __name__ == "__main__":
    sys.exit(main())
