"""Go source trees as rows of the index, from their syntax and declared types.

Files come from the binaryFile source and are parsed where they lie. A file's parser
knows its imports and the types that receivers, parameters and simple assignments give to
local variables; what a selector on such a type means follows from joins over what all
files declare: fields, methods, and what embedding promotes. There is no type checker:
a variable whose type comes from a channel, a range, a closure or another module's
function is unknown, and calls of its methods are recorded as unresolved.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import names as N
from strandloom.functions.hashing import fnv64a, hex64
from strandloom.operators import satisfy
from strandloom.sources.scratch import Scratch

FACTS = "fact string, file_path string, package_name string, name string, recv string, kind string, signature string, target string, owner string, line int, col int, canon string, rest string"
_NAMES = [x.split()[0] for x in FACTS.split(", ")]

_TOKEN = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|[ \t\r]+)|(?P<text>`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<end>\n)|(?P<sign>:=|\.\.\.|<-|.)""", re.S)
_KEYWORDS = {"break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"}
_BUILTIN = {"append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover"}
#: Predeclared types, by the name under which they are compared.
_BASIC = {n: n for n in ("bool", "complex128", "complex64", "error", "float32", "float64", "int", "int16", "int32", "int64", "int8", "string", "uint", "uint16", "uint32", "uint64", "uint8", "uintptr", "comparable")} | {"byte": "uint8", "rune": "int32", "any": "interface{}"}
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
_NAMED = re.compile(r"\**([^\[\]*(){}$,]*\.[^\W\d]\w*)(?:\[.*)?", re.S)


def named_type(canon: str) -> str:
    """The named type that a type is or points to, or ""."""
    m = _NAMED.fullmatch(canon)
    return m[1] if m else ""


def default_alias(path: str) -> str:
    """The name by which a package is used if its import gives none: its path's last part that isn't a version."""
    parts = path.split("/")
    last = parts[-2] if len(parts) > 1 and re.fullmatch(r"v\d+", parts[-1]) else parts[-1]
    return re.sub(r"\.v\d+$", "", last)


class _Parser:
    """Declarations, calls and type uses of one file.

    Types are written in a form in which equal ones are equal in all files: packages by
    path, no parameter names, type parameters by number. What a use refers to is written as
    ``type:T`` (something of the type T), ``call:F`` (what F returns), ``name:N`` or
    ``import:N`` (a name of its own or of an imported package) or ``?``, and the selectors
    that follow.
    """

    def __init__(self, path: str, text: str, package_path: str = ""):
        self.path, self.out, self.package, self.package_path = path, [], "", package_path
        self.imports: dict[str, str] = {}
        self.params: dict[str, str] = {}
        self.scopes: list[dict[str, str]] = [{}]
        self.next_scope: dict[str, str] = {}
        self.initialised, self.calls_only, self.broken = "", False, False
        self.tokens: list[tuple[str, str, int, int]] = []
        line, start = 1, 0
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], line, len(text[start : m.start()].encode()) + 1))
            if new := m[0].count("\n"):
                line, start = line + new, m.start() + m[0].rindex("\n") + 1
        #: Where each bracket's own end lies; those that have none are in ``opened``.
        self.closed: dict[int, int] = {}
        stack = []
        for k, (kind, value, _, _) in enumerate(self.tokens):
            if kind == "sign" and value in _OPEN:
                stack.append(k)
            elif kind == "sign" and value in _CLOSE and stack:
                self.closed[stack.pop()] = k + 1
        self.opened = set(stack)

    def emit(self, fact: str, name: str, k: int, recv: str = "", kind: str = "", signature: str = "", target: str = "", owner: str = "", canon: str = "", rest: str = "") -> None:
        if self.calls_only and (fact, kind) != ("call", "call"):
            return
        _, _, line, col = self.tokens[min(k, len(self.tokens) - 1)] if self.tokens else ("", "", 1, 1)
        self.out.append((fact, self.path, self.package, name, recv, kind, signature, target, owner, line, col, canon, rest))

    def at(self, k: int) -> str:
        return self.tokens[k][1] if 0 <= k < len(self.tokens) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k][0] == "word"

    def is_name(self, k: int) -> bool:
        return self.is_word(k) and self.at(k) not in _KEYWORDS

    def closing(self, k: int) -> int:
        """Past the bracket that closes the one at k."""
        if k in self.opened:
            self.broken = True
            return len(self.tokens)
        return self.closed.get(k, min(k + 1, len(self.tokens)))

    def joined(self, a: int, b: int) -> str:
        return " ".join(t[1] for t in self.tokens[a:b] if t[0] != "end")

    def plain(self, a: int, b: int) -> str:
        return "".join(t[1] for t in self.tokens[a:b] if t[0] != "end")

    def end_of_line(self, k: int) -> int:
        while k < len(self.tokens) and self.at(k) not in ("\n", ";"):
            k = self.closing(k) if self.at(k) in _OPEN else k + 1
        return k

    # Types.

    def own(self, name: str) -> str:
        return f"{self.package_path}.{name}"

    def canon(self, a: int, b: int) -> str:
        """The type that these tokens write."""
        out, k = [], a
        while k < b:
            word = self.at(k)
            if word == "func" and self.at(k + 1) == "(":
                form, _, k = self.signature(k + 1)
                out.append("func" + form)
                continue
            if word in ("struct", "interface") and self.at(k + 1) == "{":
                end = self.closing(k + 1)
                out.append(self.plain(k, end))
                k = end
                continue
            if self.is_name(k) and self.at(k + 1) == "." and self.is_word(k + 2):
                out.append(f"{self.imports.get(word, word)}.{self.at(k + 2)}")
                k += 3
                continue
            if self.is_name(k):
                out.append(self.params.get(word) or _BASIC.get(word) or self.own(word))
            elif word not in ("\n", ";"):
                out.append(word)
            k += 1
        return "".join(out)

    def type_end(self, k: int) -> int:
        """Past one type."""
        word = self.at(k)
        if word in ("*", "...") or word == "chan" and self.at(k + 1) != "<-":
            return self.type_end(k + 1)
        if word == "[":
            return self.type_end(self.closing(k))
        if word == "map":
            return self.type_end(self.closing(k + 1))
        if word in ("chan", "<-"):
            return self.type_end(k + 2)
        if word == "func":
            return self.signature(k + 1)[2]
        if word in ("struct", "interface"):
            return self.closing(k + 1)
        if word == "(":
            return self.closing(k)
        k += 1
        if self.at(k) == "." and self.is_word(k + 1):
            k += 2
        return self.closing(k) if self.at(k) == "[" and self.at(k + 1) != "]" else k

    def fields(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name or "", type) of a list of parameters between brackets."""
        pieces, start, k = [], a, a
        while k < b:
            if self.at(k) == ",":
                pieces.append((start, k))
                start = k = k + 1
            else:
                k = self.closing(k) if self.at(k) in _OPEN else k + 1
        pieces.append((start, b))
        trimmed = []
        for x, y in pieces:
            while x < y and self.at(x) == "\n":
                x += 1
            while x < y and self.at(y - 1) == "\n":
                y -= 1
            if x < y:
                trimmed.append((x, y))
        # A name stands before a type, where the piece isn't a qualified or generic type itself.
        named = any(self.is_name(x) and y > x + 1 and self.at(x + 1) != "." and not (self.at(x + 1) == "[" and self.at(x + 2) != "]" and self.closing(x + 1) == y) for x, y in trimmed)
        out: list[tuple[str, str]] = []
        if not named:
            return [("", self.canon(x, y)) for x, y in trimmed]
        waiting = []
        for x, y in trimmed:
            waiting.append(self.at(x))
            if y > x + 1:
                out += [(n, self.canon(x + 1, y)) for n in waiting]
                waiting = []
        return out

    def signature(self, k: int) -> tuple[str, tuple[list[tuple[str, str]], list[tuple[str, str]]], int]:
        """(form, (parameters, results), end) of the parameters that begin at k."""
        end = self.closing(k)
        given, got = self.fields(k + 1, end - 1), []
        if self.at(end) == "(":
            stop = self.closing(end)
            got, end = self.fields(end + 1, stop - 1), stop
        elif self.is_name(end) or self.at(end) in ("*", "[", "map", "chan", "<-", "func", "struct", "interface"):
            stop = self.type_end(end)
            got, end = [("", self.canon(end, stop))], stop
        form = lambda rows: "(" + ",".join(t for _, t in rows) + ")"
        return form(given) + form(got), (given, got), end

    def type_params(self, k: int) -> int:
        """Takes up the type parameters that begin at k, where there are any; past them."""
        self.params = {}
        if self.at(k) != "[" or not self.is_name(k + 1) or self.at(k + 2) == "]":
            return k
        end = self.closing(k)
        names, depth = [], 0
        for j in range(k + 1, end - 1):
            depth += (self.at(j) in _OPEN) - (self.at(j) in _CLOSE)
            if depth == 0 and self.is_name(j) and self.at(j - 1) in ("[", ","):
                names.append(self.at(j))
        self.params = {n: f"${i}" for i, n in enumerate(names)}
        return end

    # Declarations.

    def run(self) -> list[tuple]:
        k = 0
        while k < len(self.tokens):
            word = self.at(k)
            if word == "package" and not self.package and self.is_word(k + 1):
                self.package, k = self.at(k + 1), k + 2
            elif word == "func":
                k = self.function(k + 1)
            elif word in ("import", "const", "var", "type"):
                k = self.group(word, k + 1)
            else:
                k += 1
        if not self.package:
            self.emit("error", "no package clause", 0)
        if self.broken:
            self.emit("error", "a bracket isn't closed", len(self.tokens) - 1)
        return self.out

    def group(self, word: str, k: int, top: bool = True, owner: str = "") -> int:
        if self.at(k) == "(":
            end, k = self.closing(k), k + 1
            while k < end - 1:
                k = self.one(word, k, top, owner) if self.at(k) not in ("\n", ";") else k + 1
            return end
        return self.one(word, k, top, owner)

    def one(self, word: str, k: int, top: bool, owner: str = "") -> int:
        if word == "import":
            alias = self.at(k) if self.is_word(k) or self.at(k) in (".", "_") else ""
            k += bool(alias)
            if k < len(self.tokens) and self.tokens[k][0] == "text":
                target = self.at(k)[1:-1]
                alias = alias or default_alias(target)
                self.imports[alias] = target
                self.emit("import", alias, k, target=target)
            return self.end_of_line(k)
        if word == "type":
            return self.type(k)
        first, end = k, self.end_of_line(k)
        names = []
        while self.is_word(k):
            names.append(k)
            k += 1
            if self.at(k) != ",":
                break
            k += 1
        value = next((j for j in range(k, end) if self.at(j) == "="), end)
        of = "type:" + t if value > k and (t := named_type(self.canon(k, value))) else self.guess(value + 1) if value == k and len(names) == 1 else ""
        for j in names:
            if self.at(j) != "_":
                self.emit("symbol", self.at(j), j, kind=word, target=of)
            if not top:
                self.scopes[-1][self.at(j)] = of
        if top:
            self.initialised = self.at(first)
        self.body(value, end, owner or f"init$var:{self.at(first)}")
        self.initialised = ""
        return end

    def type(self, k: int) -> int:
        name, at = self.at(k), k
        kept, k = self.params, self.type_params(k + 1)
        k += self.at(k) == "="
        word = self.at(k)
        self.emit("symbol", name, at, kind="interface" if word == "interface" else "type", signature=f"type {name} {word}", canon=str(len(self.params)))
        if word in ("interface", "struct") and self.at(k + 1) == "{":
            k = self.members(name, word, k + 1)
        else:
            k = self.end_of_line(k)
        self.params = kept
        return k

    def members(self, name: str, word: str, k: int) -> int:
        """Fields, methods and embedded types between the brackets at k."""
        end, k = self.closing(k), k + 1
        while k < end - 1:
            if self.at(k) in ("\n", ";"):
                k += 1
                continue
            stop = min(self.end_of_line(k), end - 1)
            after = k + (self.at(k) == "*")
            if word == "interface" and self.is_name(k) and self.at(k + 1) == "(":
                form, (_, got), _ = self.signature(k + 1)
                self.emit("symbol", self.at(k), k, recv=name, kind="method", signature=self.joined(k + 1, stop), owner="interface", canon=form, target="type:" + named_type(got[0][1]) if got else "")
            elif word == "interface" and (not self.is_name(k) or "|" in self.plain(k, stop)):
                self.emit("constraint", self.plain(k, stop), k, owner=name)
            elif self.is_name(after) and (word == "interface" or (past := self.type_end(after)) >= stop or self.tokens[past][0] == "text"):
                past = self.type_end(after)
                self.emit("embed", self.plain(k, past), k, owner=name, target=named_type(self.canon(after, past)) or self.canon(after, past), kind="pointer" if after > k else "")
            elif word == "struct" and self.is_name(k):
                names = [k]
                while self.at(names[-1] + 1) == ",":
                    names.append(names[-1] + 2)
                past = self.type_end(names[-1] + 1)
                for j in names:
                    self.emit("field", self.at(j), j, owner=name, target=named_type(self.canon(names[-1] + 1, past)))
            k = max(stop, k + 1)
        return end

    def function(self, k: int) -> int:
        recv, local = "", {}
        self.params = {}
        if self.at(k) == "(":
            end = self.closing(k)
            inside = N.plain_generics(self.joined(k + 1, end - 1)).split()
            recv = ("*" if "*" in inside else "") + (inside[-1] if inside else "")
            bracket = next((j for j in range(k, end) if self.at(j) == "["), end)
            names = [self.at(j) for j in range(bracket + 1, end) if self.is_name(j)]
            if len(inside) > 1 and self.is_name(k + 1):
                local[inside[0]] = "type:" + self.own(recv.lstrip("*"))
            self.params = {n: f"${i}" for i, n in enumerate(names)}
            k = end
        if not self.is_word(k):
            return k + 1
        name, at = self.at(k), k
        k += 1
        if self.at(k) == "[":
            k = self.type_params(k)
        start = k
        form, (given, got), k = self.signature(k)
        local |= {n: "type:" + t if (t := named_type(c)) else "" for n, c in [*given, *got] if n}
        self.emit("symbol", name, at, recv=recv, kind="method" if recv else "func", signature="func" + self.joined(start, k), canon=form, target="type:" + named_type(got[0][1]) if got else "")
        if self.at(k) != "{":
            return k
        end = self.closing(k)
        self.scopes, self.next_scope = [{}], local
        self.body(k, end, f"{recv}.{name}" if recv else name)
        self.scopes, self.params = [{}], {}
        return end

    # Bodies.

    def known(self, name: str) -> str | None:
        """What a local name is; None where there is none."""
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def guess(self, k: int) -> str:
        """What the expression at k is of."""
        k += self.at(k) == "&"
        if self.at(k) == "new" and self.at(k + 1) == "(":
            t = named_type(self.canon(k + 2, self.closing(k + 1) - 1))
            return "type:" + t if t else ""
        last = self.closing(k) if self.at(k) == "(" else k + 1
        while self.at(last) in ("(", "[") or self.at(last) == "." and self.is_word(last + 1):
            last = last + 2 if self.at(last) == "." else self.closing(last)
        if self.at(last) == "." and self.at(last + 1) == "(" and self.at(last + 2) != "type":
            t = named_type(self.canon(last + 2, self.closing(last + 1) - 1))
            return "type:" + t if t else ""
        if not self.is_name(k):
            return ""
        local, end = self.known(self.at(k)), k + 1
        while self.at(end) == "." and self.is_word(end + 1):
            end += 2
        if local is not None:
            return local if end == k + 1 and self.at(end) in ("\n", ";", ",", ")", "{", "}", "") else ""
        t, after = self.canon(k, end), self.closing(end) if self.at(end) == "[" else end
        if self.at(after) == "{":
            return "type:" + named_type(t) if named_type(t) else ""
        return "call:" + t if self.at(after) == "(" and named_type(t) else ""

    def place(self, chain: list[int]) -> tuple[str, str, str]:
        """(what it is of, selectors, their places) of a chain of names."""
        head = self.at(chain[0])
        local, n = self.known(head), 1
        if local is not None:
            of = local or "?"
            if len(chain) == 1:
                # A function in a local variable goes by the variable's name.
                of = "local:" + self.own(head)
        elif head in self.imports and len(chain) > 1:
            of, n = f"import:{self.imports[head]}.{self.at(chain[1])}", 2
        else:
            of = "name:" + self.own(head)
        return of, ".".join(self.at(j) for j in chain[n:]), ",".join(f"{self.tokens[j][2]}:{self.tokens[j][3]}" for j in chain[n:])

    def assign(self, k: int) -> None:
        """The names before the sign := at k."""
        names, j = [], k - 1
        while self.is_name(j):
            names.append(self.at(j))
            if self.at(j - 1) != ",":
                break
            j -= 2
        of = self.guess(k + 1)
        for n in names:
            # The first of several gets what a call returns first.
            self.scopes[-1][n] = of if n == names[-1] else ""

    def type_switch(self, k: int, owner: str) -> None:
        """Types of the cases between the brackets at k; those of switches inside come with their own."""
        end, k, depth = self.closing(k), k + 1, 0
        while k < end - 1:
            depth += (self.at(k) in _OPEN) - (self.at(k) in _CLOSE)
            if self.at(k) == "case" and depth == 0:
                k += 1
                while k < end - 1 and self.at(k) != ":":
                    stop = self.type_end(k)
                    if t := named_type(self.canon(k, stop)):
                        self.emit("type_ref", self.plain(k, stop), k, owner=owner, kind="type_switch", target=t)
                    k = stop + (self.at(stop) == ",")
            else:
                k += 1

    def literal(self, k: int, owner: str) -> int:
        """A function literal or type whose parameters begin at k; past its signature."""
        began, (_, (given, got), end) = k - 1, self.signature(k)
        if self.at(end) != "{":
            return end
        self.next_scope = {n: "type:" + t if (t := named_type(c)) else "" for n, c in [*given, *got] if n}
        if self.initialised and not self.calls_only:
            # Calls in an initialiser's literal count for the literal too.
            _, _, line, col = self.tokens[began]
            kept, scope = self.scopes, dict(self.next_scope)
            self.calls_only, self.scopes = True, [*kept]
            self.body(end, self.closing(end), f"{self.initialised}$lit@{self.path.rsplit('/', 1)[-1]}:{line}:{col}")
            self.calls_only, self.scopes, self.next_scope = False, kept, scope
        return end

    def body(self, k: int, end: int, owner: str) -> None:
        """Calls, function values passed on, selectors and type uses between two places."""
        header, depth = False, len(self.scopes)
        while k < end:
            word = self.at(k)
            if self.tokens[k][0] == "word" and word in _KEYWORDS:
                if word in ("if", "for", "switch", "select"):
                    header = True
                if word == "func" and self.at(k + 1) == "(":
                    k = self.literal(k + 1, owner)
                    header = False if self.at(k) == "{" else header
                elif word in ("var", "const") and self.is_word(k + 1):
                    k = self.group(word, k + 1, False, owner)
                elif word == "type" and self.is_word(k + 1):
                    k = self.type(k + 1)
                else:
                    k += 1
            elif self.is_word(k) and self.at(k - 1) != ".":
                k = self.primary(k, end, owner, header)
            else:
                if word == "{":
                    header = False
                    self.scopes.append(self.next_scope)
                    self.next_scope = {}
                elif word == "}" and len(self.scopes) > 1:
                    self.scopes.pop()
                elif word == ":=":
                    self.assign(k)
                elif word == "." and self.at(k + 1) == "(" and self.at(k + 2) != "type":
                    self.asserted(k, owner)
                elif word == "." and self.at(k + 1) == "(":
                    self.type_switch(self.closing(k + 1), owner)
                k += 1
        del self.scopes[max(1, depth) :]

    def asserted(self, k: int, owner: str) -> str:
        """The type in ``.(T)`` at k."""
        stop = self.closing(k + 1) - 1
        t = named_type(self.canon(k + 2, stop))
        if t:
            self.emit("type_ref", self.plain(k + 2, stop), k + 2, owner=owner, kind="type_assert", target=t)
        return t

    def primary(self, k: int, end: int, owner: str, header: bool) -> int:
        """A name and what follows it: selectors, calls, indices, assertions, a literal's bracket."""
        before, expr = self.at(k - 1), self.at(k)
        # The chain of names since what ``of`` tells, or since its own beginning if that is None.
        chain, of, k = [k], None, k + 1

        def found() -> tuple[str, str, str]:
            if of is None:
                return self.place(chain)
            return of, ".".join(self.at(j) for j in chain), ",".join(f"{self.tokens[j][2]}:{self.tokens[j][3]}" for j in chain)

        def select() -> None:
            what, rest, places = found()
            if rest and what != "?":
                self.emit("select", expr, chain[0], owner=owner, target=what, rest=rest, signature=places)

        while k < end:
            sign = self.at(k)
            if sign == "." and self.is_word(k + 1) and self.at(k + 1) not in _KEYWORDS:
                expr += "." + self.at(k + 1)
                chain.append(k + 1)
                k += 2
            elif sign == "." and self.at(k + 1) == "(":
                if chain:
                    select()
                stop = self.closing(k + 1)
                if self.at(k + 2) == "type":
                    self.type_switch(stop, owner)
                    return stop
                t = self.asserted(k, owner)
                chain, of, expr, k = [], "type:" + t if t else "?", "<*ast.TypeAssertExpr>", stop
            elif sign == "[" and (self.at(k + 1) != "]"):
                stop = self.closing(k)
                self.body(k + 1, stop - 1, owner)
                expr += "[...]"
                if self.at(stop) != "(" and self.at(stop) != "{":
                    if chain:
                        select()
                    chain, of = [], "?"
                k = stop
            elif sign == "(":
                what, rest, places = found()
                self.emit("call", expr, k, owner=owner, kind="call", target=what, rest=rest, signature=places)
                if rest and what != "?":
                    self.emit("select", expr, chain[0], owner=owner, target=what, rest=rest, signature=places)
                stop = self.closing(k)
                self.body(k + 1, stop - 1, owner)
                expr = f"return-value-of({expr})"
                of = "call:" + what.split(":", 1)[1] if not rest and what.startswith(("name:", "import:")) else "?"
                chain, k = [], stop
            elif sign == "{" and not header and chain and of is None and before != "]" and self.known(self.at(chain[0])) is None:
                a = chain[0]
                t = named_type(self.canon(a, k))
                # After a name that isn't a type comes a block, and then no blank line or bracket before it.
                if t and before not in (")", "]", "range") and self.at(a) not in _BASIC:
                    self.emit("type_ref", self.plain(a, chain[-1] + 1), a, owner=owner, kind="composite_lit", target=t)
                return k
            else:
                break
        if chain:
            what, rest, places = found()
            if before in ("(", ",", "=", ":=", "return", ":", "<-", "{", "+=") and self.at(k) in (")", ",", "\n", ";", "}"):
                self.emit("call", expr, chain[0], owner=owner, kind="ref", target=what, rest=rest, signature=places)
            select()
        return k


def parse(path: str, text: str, package_path: str = "") -> list[tuple]:
    """Facts of a file. Calls in calls are read by recursion, which generated code may nest deeply."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        return _Parser(path, text, package_path).run()
    finally:
        sys.setrecursionlimit(limit)


def discover_modules(spark: SparkSession, root: str) -> DataFrame:
    """Directories with a go.mod file, but for hidden ones, vendored code and node_modules."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "go.mod").load(root)
    hidden = F.regexp_like(F.replace("path", F.lit(root.rstrip("/")), F.lit("")), F.lit(r"/(\.[^/]*|vendor|node_modules)/"))
    module = F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1)
    return files.where(~hidden).select(N.dir_name("path").alias("module_root"), module.alias("module_path")).distinct()


def read_files(spark: SparkSession, root: str, tests: bool = True, only: list[str] | None = None) -> DataFrame:
    """(module_root, package_path, dir, file_path, content) of the Go files of all modules below a folder, or of those in the folders ``only``."""
    modules = discover_modules(spark, root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.go")
    if only is None:
        files = source.option("recursiveFileLookup", "true").load(root)
    else:
        files = source.load(only) if only else spark.createDataFrame([], schema)
    files = files.select("path", N.dir_name("path").alias("dir"), "content") if tests else files.where(~F.col("path").endswith("_test.go")).select("path", N.dir_name("path").alias("dir"), "content")
    # A file belongs to the innermost module above it: its ancestors meet module roots by equality.
    parts = F.split("dir", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("module_root"))
    owner = above.join(modules, "module_root").groupBy("path").agg(F.max_by(F.struct("module_root", "module_path"), F.length("module_root")).alias("m"))
    package = F.concat("m.module_path", F.substr("dir", F.length("m.module_root") + 1))
    # Tests that stand outside of the package they test are a package of their own.
    clause = F.regexp_extract(F.col("content").cast("string"), r"(?m)^package[ \t]+(\w+)", 1)
    package = F.concat(package, F.when(F.col("path").endswith("_test.go") & clause.endswith("_test"), "_test").otherwise(""))
    return files.join(owner, "path").select("m.module_root", package.alias("package_path"), "dir", F.col("path").alias("file_path"), "content")


def facts(files: DataFrame) -> DataFrame:
    """Facts of all files, with their module and package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                got = parse(row["file_path"], (row["content"] or b"").decode("utf-8", "replace"), row["package_path"])
                columns = list(zip(*got)) or [[]] * len(_NAMES)
                arrays = [pa.array(c, pa.int32() if n in ("line", "col") else pa.string()) for n, c in zip(_NAMES, columns)]
                yield pa.RecordBatch.from_arrays([pa.array([row[n]] * len(got), pa.string()) for n in ("module_root", "package_path")] + arrays, names=["module_root", "package_path", *_NAMES])

    return files.select("module_root", "package_path", "file_path", "content").mapInArrow(run, f"module_root string, package_path string, {FACTS}")


def _named(fact_rows: DataFrame) -> DataFrame:
    """Symbols with their fqname and the type that has them."""
    owner = F.replace("recv", F.lit("*"), F.lit(""))
    return fact_rows.where("fact = 'symbol'").select(
        "*",
        F.when(F.col("recv") != "", F.concat_ws(".", "package_path", "recv", "name")).otherwise(F.concat_ws(".", "package_path", "name")).alias("fqname"),
        F.when(F.col("recv") != "", F.concat_ws(".", "package_path", owner)).alias("holder"),
        F.regexp_like("name", F.lit(r"^\p{Lu}")).alias("exported"),
        F.xxhash64("file_path", "line", "col", "name").alias("id"),
    )


def _members(symbols: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(holder, name, what, type, fqname, pointer, canon, depth): fields and methods of types, with what embedding promotes.

    Of a name at several depths the least counts, and one that stands there more than once is
    none. ``pointer`` tells that only a pointer to the holder has the method. Each round is a
    table; there are as many as types are nested.
    """
    declared = symbols.where("kind = 'method'").select(
        "holder", "name", F.lit("method").alias("what"), F.expr("if(startswith(target, 'type:'), substr(target, 6), '')").alias("type"), "fqname", F.startswith("recv", F.lit("*")).alias("pointer"), "canon"
    )
    inside = found.where("fact = 'embed'").select(F.concat_ws(".", "package_path", "owner").alias("holder"), F.col("target").alias("inner"), (F.col("kind") == "pointer").alias("by_pointer")).distinct()
    fields = found.where("fact = 'field'").select(F.concat_ws(".", "package_path", "owner").alias("holder"), "name", F.lit("field").alias("what"), F.col("target").alias("type"), F.lit("").alias("fqname"), F.lit(False).alias("pointer"), F.lit("").alias("canon"))
    named = inside.select("holder", F.substring_index("inner", ".", -1).alias("name"), F.lit("field").alias("what"), F.col("inner").alias("type"), F.lit("").alias("fqname"), F.lit(False).alias("pointer"), F.lit("").alias("canon"))
    # The methods of error, as of a package without a name.
    error = symbols.sparkSession.createDataFrame([("error", "Error", "method", "", "", False, "()(string)")], declared.schema)
    whole = scratch.keep("members0", declared.unionByName(fields).unionByName(named).unionByName(error).distinct().withColumn("depth", F.lit(0)))
    last, depth = whole, 0
    while True:
        depth += 1
        pulled = inside.join(last.withColumnRenamed("holder", "inner"), "inner").select("holder", "name", "what", "type", "fqname", (F.col("pointer") & ~F.col("by_pointer")).alias("pointer"), "canon")
        fresh = pulled.distinct().join(whole.select("holder", "name"), ["holder", "name"], "left_anti")
        last, n = scratch.keep_counted(f"members{depth}", fresh.withColumn("depth", F.lit(depth)))
        if not n:
            break
        whole = whole.unionByName(last)
    # One interface may be embedded by two ways; its methods are the same then.
    several = whole.groupBy("holder", "name").agg(F.count_distinct("what", "canon", "fqname").alias("ways"))
    interfaces = symbols.where("kind = 'interface'").select(F.col("fqname").alias("holder")).distinct().withColumn("iface", F.lit(True))
    return (
        whole.join(several, ["holder", "name"]).join(interfaces, "holder", "left").where("iface OR ways = 1 OR depth = 0").drop("ways", "iface")
        .groupBy("holder", "name").agg(F.min(F.struct("what", "type", "fqname", "pointer", "canon", "depth")).alias("m")).select("holder", "name", "m.*")
    )


def _followed(uses: DataFrame, symbols: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(use, step, holder, what, fqname, last) of the selectors of ``uses`` (use, target, rest), as far as they are known."""
    returns = symbols.where("kind = 'func'").select(F.concat(F.lit("call:"), "fqname").alias("target"), F.col("target").alias("is"))
    itself = symbols.where("kind IN ('type', 'interface')").select("fqname").distinct()
    variables = symbols.where("kind = 'var' AND target <> ''").select("fqname", F.col("target").alias("is")).dropDuplicates(["fqname"])
    known = returns.unionByName(itself.select(F.concat(F.lit("call:"), "fqname").alias("target"), F.concat(F.lit("type:"), "fqname").alias("is"))).dropDuplicates(["target"])
    names = itself.select("fqname", F.concat(F.lit("type:"), "fqname").alias("is")).unionByName(variables).dropDuplicates(["fqname"])
    for prefix in ("name:", "import:"):
        # A variable's own initialiser may be a call.
        own = names.select(F.concat(F.lit(prefix), "fqname").alias("target"), "is").join(known.toDF("is", "then"), "is", "left").select("target", F.coalesce("then", "is").alias("is"))
        known = known.unionByName(own)
    begun = uses.where("rest <> ''").join(known, "target", "left").select("use", F.split("rest", r"\.").alias("names"), F.coalesce("is", "target").alias("of")).where("startswith(of, 'type:')")
    state, out, step = begun.select("use", "names", F.expr("substr(of, 6)").alias("holder")), None, 0
    while True:
        met = state.withColumn("name", F.get("names", F.lit(step))).where("name IS NOT NULL AND holder <> ''").join(members, ["holder", "name"])
        met, n = scratch.keep_counted(f"step{step}", met.select("use", F.lit(step).alias("step"), "holder", "name", "what", "fqname", (F.size("names") == step + 1).alias("last"), "names", "type"))
        out = met.drop("names", "type") if out is None else out.unionByName(met.drop("names", "type"))
        if not n:
            return out
        state, step = met.select("use", "names", F.col("type").alias("holder")), step + 1


def tables(found: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Tables of the index from the facts of :func:`facts`; keep those in a table first, as they are read often."""
    scratch = Scratch(found.sparkSession, "resolve")
    symbols = scratch.keep("symbols", _named(found))
    members = scratch.keep("members", _members(symbols, found, scratch))
    uses = scratch.keep("uses", found.where("fact IN ('call', 'select')").select("*", F.concat_ws(".", "package_path", "owner").alias("from_fqname"), F.xxhash64("fact", "kind", "file_path", "line", "col", "name", "owner").alias("use")))
    steps = scratch.keep("steps", _followed(uses, symbols, members, scratch))
    declared = symbols.groupBy(F.col("fqname").alias("guess")).agg(F.max("kind").alias("declared"))
    ends = steps.where("last").select("use", F.col("what").alias("end"), F.col("fqname").alias("method")).dropDuplicates(["use"])
    plain = F.expr("if(rest = '' AND split_part(target, ':', 1) IN ('name', 'import', 'local'), substr(target, instr(target, ':') + 1), NULL)")
    aimed = uses.where("fact = 'call'").join(ends, "use", "left").withColumn("guess", F.coalesce(F.when(F.col("end") == "method", F.col("method")), plain)).join(declared, "guess", "left").withColumn("id", F.col("use"))
    outside = F.startswith("target", F.lit("import:")) & (F.col("rest") == "")
    resolved = F.col("declared").isNotNull() | outside | F.startswith("target", F.lit("local:"))
    calls = aimed.where(F.when(F.col("kind") == "ref", F.col("declared").isin("func", "method")).otherwise(resolved))
    predeclared = (F.col("rest") == "") & F.startswith("target", F.lit("name:")) & F.col("name").isin(*_BUILTIN, *_BASIC)
    unresolved = aimed.where((F.col("kind") == "call") & ~resolved & ~predeclared)
    ref = lambda rows, kind: rows.select("module_root", "package_path", "file_path", "line", "col", "from_fqname", "to_fqname", kind.alias("ref_kind"), F.col("name").alias("expr"))
    owned = F.concat_ws(".", "package_path", "owner").alias("from_fqname")
    shown = found.where("fact IN ('type_ref', 'embed')").select("*", owned, F.col("target").alias("to_fqname")).join(symbols.select(F.col("fqname").alias("holder"), F.col("kind").alias("holder_kind")).dropDuplicates(["holder"]), F.col("from_fqname") == F.col("holder"), "left")
    # Embedding counts as a use in structs.
    shown = shown.where("instr(target, '.') > 0 AND (fact = 'type_ref' OR holder_kind = 'type')")
    converted = aimed.where("kind = 'call' AND declared IN ('type', 'interface')").withColumn("to_fqname", F.col("guess"))
    place = F.split(F.get(F.split("signature", ","), F.col("step")), ":")
    fields = steps.where("what = 'field'").select("use", "step", "name", F.col("holder").alias("to_fqname")).join(uses.where("fact = 'select'").drop("name", "line", "col"), "use").select("*", place[0].cast("int").alias("line"), place[1].cast("int").alias("col"))
    refs = ref(shown, F.when(F.col("fact") == "embed", F.lit("embed")).otherwise(F.col("kind"))).unionByName(ref(converted, F.lit("conversion"))).unionByName(ref(fields, F.lit("field_access"))).withColumn("id", F.xxhash64("file_path", "line", "col", "ref_kind", "expr", "from_fqname"))
    types = symbols.where("kind IN ('type', 'interface')").select(F.col("fqname").alias("holder"), F.col("kind").alias("is"), F.col("canon").alias("arity"), F.col("module_root").alias("root")).dropDuplicates(["holder"])
    methods = members.where("what = 'method'").join(types, "holder").withColumn("method", F.concat("name", F.lit(" "), "canon"))
    required = methods.where("is = 'interface'").select(F.col("root").alias("module_root"), F.col("holder").alias("iface_fqname"), F.col("name").alias("method_name"), "method", "arity").distinct()
    offered = methods.where("is = 'type'").select(F.col("holder").alias("impl_fqname"), "method", F.col("arity").alias("own_arity"), "pointer", F.col("fqname").alias("method_fqname"))
    closed = required.join(_open_interfaces(found, types, scratch), "iface_fqname", "left_anti")
    pairs = satisfy.divide(closed.select("iface_fqname", F.concat("method", F.lit(" "), "arity").alias("key")), offered.select("impl_fqname", F.concat("method", F.lit(" "), "own_arity").alias("key")).distinct(), "iface_fqname", "impl_fqname", "key")
    needed = pairs.join(closed, "iface_fqname").join(offered, ["impl_fqname", "method"])
    implements = needed.groupBy("module_root", "iface_fqname", "impl_fqname").agg(F.bool_or("pointer").alias("is_pointer"))
    package = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    hashes = files.select("module_root", "package_path", "file_path", hex64(fnv64a("content")).alias("file_hash"))
    return {
        "symbols": symbols,
        "calls": calls.select("*", F.col("guess").alias("to_fqname"), F.col("name").alias("callee_expr")),
        "unresolved_calls": unresolved.select("*", F.col("name").alias("expr"), F.lit("unresolved").alias("reason")),
        "type_refs": refs,
        "iface_methods": required,
        "implements": implements.select("*", package("iface_fqname").alias("iface_pkg"), package("impl_fqname").alias("impl_pkg"), F.xxhash64("iface_fqname", "impl_fqname").alias("id")),
        "impl_methods": needed.select("module_root", F.col("method_fqname").alias("impl_fqname")).where("impl_fqname <> ''").distinct(),
        "package_files": hashes,
    }


def _open_interfaces(found: DataFrame, types: DataFrame, scratch: Scratch) -> DataFrame:
    """Interfaces (iface_fqname) that constrain types or embed something whose methods aren't known; nobody can be said to satisfy them."""
    holder = F.concat_ws(".", "package_path", "owner").alias("holder")
    inside = found.where("fact = 'embed'").select(holder, F.col("target").alias("inner")).join(types.where("is = 'interface'").select("holder"), "holder", "left_semi").distinct()
    unknown = inside.where("inner <> 'error'").join(types.where("is = 'interface'").select(F.col("holder").alias("inner")), "inner", "left_anti").select("holder")
    whole, n = scratch.keep_counted("open0", unknown.unionByName(found.where("fact = 'constraint'").select(holder)).distinct())
    last, step = whole, 0
    while n:
        step += 1
        more = inside.join(last.select(F.col("holder").alias("inner")), "inner").select("holder").distinct().join(whole, "holder", "left_anti")
        last, n = scratch.keep_counted(f"open{step}", more)
        whole = whole.unionByName(last)
    return whole.select(F.col("holder").alias("iface_fqname"))


def warnings(found: DataFrame) -> DataFrame:
    """(file_path, line, name) of what could not be read; the rest of such files is indexed."""
    return found.where("fact = 'error'").select("file_path", "line", "name")
