"""Classes and functions of source files in languages with braces, found by a lexer and a stack of scopes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.operators.graph import python_chunks
from findling.session import dealt, ship

#: Languages by extension, and words before a parenthesis that call nothing.
LANGUAGES = {"js": "js", "jsx": "js", "mjs": "js", "ts": "ts", "tsx": "ts", "go": "go", "rs": "rust"}
_NO_CALL = {
    "if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "match", "typeof", "await", "yield", "in", "of", "do", "with", "void", "delete", "case", "else", "select", "range", "go", "defer", "throw",
    "async", "import", "let", "mut", "move", "where", "impl", "dyn", "as", "loop", "var", "const", "new",
}
#: Words after which a slash begins a pattern.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "await", "yield"}
_PAIRS = {")": "(", "]": "[", "}": "{"}
SCHEMA = "file_path string, id string, node_type string, name string, parent_id string, start_line int, end_line int, signature string, imports array<string>, bases array<string>, calls array<string>, error string"

_TEXTS = {
    "js": r""""(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?""",
    "go": r""""(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?""",
    "rust": r"""b?r(?P<marks>\#*)".*?(?:"(?P=marks)|\Z)|b?"(?:[^"\\]|\\.)*"?|b?'(?:[^'\\\n]|\\[^\n][^'\n]*)'""",
}
_LEXERS = {
    kind: re.compile(rf"(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<text>{texts})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d\w*)|(?P<mark>=>|->|::|\?\.|.)", re.S)
    for kind, texts in _TEXTS.items()
}
_LEXERS["ts"] = _LEXERS["js"]
_PATTERN = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\\?\Z)", re.S)
_COMMENT_ENDS = re.compile(r"/\*|\*/")


class Token(NamedTuple):
    kind: str
    value: str
    start: int
    line: int


def _block_end(text: str, at: int, nested: bool) -> int:
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in _COMMENT_ENDS.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return len(text)


def tokens(text: str, language: str) -> Iterator[Token]:
    """Words, texts, numbers and marks of the code, without comments; what stands in a template's holes is code."""
    lexer, script = _LEXERS[language], language in ("js", "ts")
    at, line, last, holes, divided = 0, 1, None, [], 0
    while at < len(text):
        m = lexer.match(text, at)
        kind, value, end = m.lastgroup if m.lastgroup != "marks" else "text", m.group(), m.end()
        if kind == "block":
            kind, end = "comment", _block_end(text, at, language == "rust")
        elif script and value == "/" and line != divided and (last is None or last.value in _BEFORE_PATTERN or (last.kind == "mark" and last.value not in _PAIRS)):
            # Where one slash begins no pattern, the others of its line divide too, so a line is tried once.
            if p := _PATTERN.match(text, at):
                kind, end = "text", p.end()
            else:
                divided = line
        elif script and kind == "mark" and value in "`{}":
            if value == "`" or (value == "}" and holes and holes[-1] == 0):
                if value == "}":
                    holes.pop()
                t = _TEMPLATE.match(text, end)
                kind, end = "text", t.end()
                if t.group(1) == "${":
                    holes.append(0)
            elif holes:
                holes[-1] += 1 if value == "{" else -1
        if kind not in ("space", "comment"):
            last = Token(kind, value if kind != "text" else text[at:end], at, line)
            yield last
        line += text.count("\n", at, end)
        at = end


def _names(part: list[Token]) -> list[str]:
    """Dotted names outside angle brackets and parentheses."""
    out, deep, joined = [], 0, False
    for t in part:
        if t.value in ("<", "(", "["):
            deep += 1
        elif t.value in (">", ")", "]"):
            deep -= 1
        elif deep == 0 and t.value in (".", "::") and out:
            out[-1] += t.value
            joined = True
            continue
        elif deep == 0 and t.kind == "word" and t.value not in ("extends", "implements", "for", "where", "dyn", "mut", "const"):
            if joined:
                out[-1] += t.value
            else:
                out.append(t.value)
        joined = False
    return out


class _File:
    """One pass over the tokens of a file; ``rows`` are its classes and functions."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.text, self.language, self.script = path, text, language, language in ("js", "ts")
        self.code = list(tokens(text, language))
        self.rows, self.imports, self.error = [], [], None
        self.stack: list[tuple[str, dict | None]] = []
        self.open: list[dict] = []
        self.opened = dict.fromkeys("([{", 0)
        self.next: dict[tuple, list[int]] = {}
        self.pending: dict[int, dict] = {}
        self.traits: dict[str, list[str]] = {}
        self.names_declared: set[int] = set()
        self.closes = self._closes()

    def _closes(self) -> dict[int, int]:
        found, opened = {}, []
        for i, t in enumerate(self.code):
            if t.kind == "mark" and t.value in _PAIRS.values():
                opened.append(i)
            elif t.kind == "mark" and t.value in _PAIRS:
                while opened and self.code[opened[-1]].value != _PAIRS[t.value]:
                    opened.pop()
                if opened:
                    found[opened.pop()] = i
        return found

    def at(self, i: int) -> str:
        return self.code[i].value if 0 <= i < len(self.code) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind == "word"

    def is_text(self, i: int) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind == "text"

    def until(self, i: int, *ends: str) -> int:
        """Place of the first of ``ends`` from ``i`` on; found for all places at once."""
        if ends not in self.next:
            at, found = len(self.code), []
            for j in range(len(self.code) - 1, -1, -1):
                at = j if self.code[j].value in ends else at
                found.append(at)
            self.next[ends] = found[::-1]
        return self.next[ends][i] if i < len(self.code) else len(self.code)

    def head(self, i: int, *ends: str) -> list[Token]:
        return self.code[i : self.until(i, *ends)]

    def inside(self) -> dict | None:
        return self.open[-1] if self.open else None

    def in_class(self) -> bool:
        return bool(self.stack) and self.stack[-1][1] is not None and self.stack[-1][1]["node_type"] == "class"

    def declare(self, i: int, name_at: int, node_type: str, bases: Callable[[], list[str]] = list, parent: str | None = None) -> None:
        """A class or function whose words begin at ``i`` and whose brace may come; its bases are read when it has come."""
        name, above = self.at(name_at), self.inside()
        parent = parent or (above["id"] if above else None)
        row = {"id": f"{parent or self.path}::{name}", "node_type": node_type, "name": name, "parent_id": parent, "start_line": self.code[i].line, "end_line": self.code[i].line, "start": self.code[i].start, "bases": bases, "calls": set()}
        self.names_declared.add(name_at)
        self.pending[len(self.stack)] = row

    def keep(self, row: dict, end: int) -> None:
        row["signature"] = " ".join(self.text[row["start"] : end].split())
        row["bases"] = row["bases"]()
        self.rows.append(row)

    def unquoted(self, i: int) -> str:
        return self.code[i].value.strip("\"'`")

    def script_word(self, i: int, word: str) -> None:
        if word in ("class", "interface") and self.is_word(i + 1) and self.at(i - 1) != "." and self.at(i + 1) not in ("extends", "implements"):
            self.declare(i, i + 1, "class", lambda: _names(self.code[self.until(i + 2, "extends", "implements", "{", ";") : self.until(i + 2, "{", ";")]))
        elif word == "function" and self.at(i - 1) != ".":
            name = i + (2 if self.at(i + 1) == "*" else 1)
            before = i - (2 if self.at(i - 1) == "async" else 1)
            if self.is_word(name):
                self.declare(i, name, "function")
            elif self.at(before) in ("=", ":") and self.is_word(before - 1):
                self.declare(before - 1, before - 1, "function")
        elif (word == "import" or (word == "from" and self.at(i - 1) != ".")) and self.is_text(i + 1):
            self.imports.append(self.unquoted(i + 1))
        elif word in ("require", "import") and self.at(i + 1) == "(" and self.is_text(i + 2):
            self.imports.append(self.unquoted(i + 2))
        elif self.in_class() and self.at(i + 1) == "(" and self.at(self.closes.get(i + 1, -2) + 1) in ("{", ":"):
            self.declare(i, i, "function")
        elif self.at(i + 1) == "=" and self.at(i - 1) != ".":
            start = i + (3 if self.at(i + 2) == "async" else 2)
            arrow = self.closes.get(start, start - 1) + 1 if self.at(start) == "(" else start + 1
            if self.at(arrow) == ":":
                arrow = self.until(arrow, "=>", ";", "{")
            if self.at(arrow) == "=>" and self.at(arrow + 1) == "{":
                self.declare(i, i, "function")

    def go_word(self, i: int, word: str) -> None:
        if word == "func" and self.is_word(i + 1):
            self.declare(i, i + 1, "function")
        elif word == "func" and self.at(i + 1) == "(" and not self.stack:
            end = self.closes.get(i + 1, i + 1)
            holder = [t.value for t in self.code[i + 2 : min(self.until(i + 2, "[", ")"), end)] if t.kind == "word"]
            if holder and self.is_word(end + 1):
                self.declare(i, end + 1, "function", parent=f"{self.path}::{holder[-1]}")
        elif self.at(kind := self.closes.get(i + 1, i) + 1 if self.at(i + 1) == "[" else i + 1) in ("struct", "interface") and self.at(kind + 1) == "{" and not (self.open and self.open[-1]["node_type"] == "class") and (self.at(i - 1) == "type" or (self.stack and self.stack[-1][0] == "type(")):
            self.declare(i - 1 if self.at(i - 1) == "type" else i, i, "class", lambda: self.embedded(kind + 2, self.closes.get(kind + 1, len(self.code))))
        elif word == "import" and self.is_text(i + 1):
            self.imports.append(self.unquoted(i + 1))
        elif word == "import" and not self.stack and (self.at(i + 1) == "(" or self.is_word(i + 1) or self.at(i + 1) in "._"):
            end = self.closes.get(i + 1, i + 1) if self.at(i + 1) == "(" else i + 2
            self.imports += [self.unquoted(j) for j in range(i + 1, end + 1) if self.is_text(j)]

    def embedded(self, begin: int, end: int) -> list[str]:
        """Types that stand alone in their line."""
        lines: dict[int, list[Token]] = {}
        for t in self.code[begin:end]:
            lines.setdefault(t.line, []).append(t)
        plain = [part for part in lines.values() if all(t.kind == "word" or t.value in (".", "*") for t in part)]
        return [names[0] for part in plain if len(names := _names(part)) == 1]

    def supertraits(self, i: int) -> list[str]:
        head, deep = self.head(i, "{", ";", "where"), 0
        for j, t in enumerate(head):
            deep += (t.value == "<") - (t.value == ">")
            if t.value == ":" and deep == 0:
                return _names(head[j:])
        return []

    def implemented(self, row: dict, i: int) -> bool:
        """Fill the scope of an ``impl``, which is no row of its own; its trait becomes a base of the type."""
        head = self.head(i, "{", ";", "where")
        names = _names(head)
        if names:
            row["id"] = f"{self.path}::{names[-1]}"
            if len(names) > 1 and any(t.value == "for" for t in head):
                self.traits.setdefault(names[-1], []).append(names[0])
        return bool(names)

    def rust_word(self, i: int, word: str) -> None:
        if word in ("struct", "enum", "trait") and self.is_word(i + 1):
            self.declare(i, i + 1, "class", (lambda: self.supertraits(i + 2)) if word == "trait" else list)
        elif word == "impl" and len(self.stack) not in self.pending and self.at(i - 1) in ("", "}", ";", "]", "unsafe", "{", "default"):
            self.pending[len(self.stack)] = {"node_type": "class", "impl": i + 1}
        elif word == "fn" and self.is_word(i + 1):
            self.declare(i, i + 1, "function")
        elif word == "use" and self.at(i - 1) in ("", ";", "}", "{", "pub", ")", "]"):
            path = "".join(t.value for t in self.head(i + 1, ";", "{", "as", "*"))
            self.imports.append(path.removesuffix("::"))

    def call(self, i: int) -> None:
        """A word before a parenthesis, with the names it hangs on, belongs to each function around it."""
        if i in self.names_declared or self.at(i + 1) != "(" or (self.at(i) in _NO_CALL and self.at(i - 1) not in (".", "::", "?.")):
            return
        name, j = self.at(i), i
        while self.at(j - 1) in (".", "::", "?.") and self.is_word(j - 2):
            name, j = f"{self.at(j - 2)}{self.at(j - 1)}{name}", j - 2
        for row in self.open:
            if row["node_type"] == "function":
                row["calls"].add(name)

    def push(self, kind: str, row: dict | None = None) -> None:
        self.stack.append((kind, row))
        self.opened[kind[-1]] += 1
        if row is not None:
            self.open.append(row)

    def pop(self, line: int) -> str:
        self.pending.pop(len(self.stack), None)
        kind, row = self.stack.pop()
        self.opened[kind[-1]] -= 1
        if row is not None:
            self.open.pop()["end_line"] = line
        return kind[-1]

    def mark(self, i: int, t: Token) -> None:
        mine = self.pending.get(len(self.stack))
        if t.value == "{":
            # A brace in a type is none of the body.
            before = self.at(i - 1)
            typed = before in (":", "<", "|", "&", ",") if self.script else self.language == "go" and before in ("struct", "interface") and mine is not None and mine["node_type"] == "function"
            if mine is not None and not typed:
                row = self.pending.pop(len(self.stack))
                if "impl" not in row:
                    self.keep(row, t.start)
                elif not self.implemented(row, row["impl"]):
                    row = None
                self.push("{", row)
            else:
                self.push("{")
        elif t.value in ("(", "["):
            self.push("type(" if self.language == "go" and self.at(i - 1) == "type" else t.value)
        elif t.value in _PAIRS:
            want = _PAIRS[t.value]
            if not self.opened[want]:
                self.error = self.error or f"line {t.line}: {t.value} closes nothing"
                return
            while (kind := self.pop(t.line)) != want:
                self.error = self.error or f"line {t.line}: {t.value} closes {kind}"
        elif t.value == ";" and mine is not None:
            # A type without a body is whole; a function without one is only announced.
            if mine["node_type"] == "class" and self.language == "rust" and "impl" not in mine:
                self.keep(mine, t.start)
            del self.pending[len(self.stack)]

    def parse(self) -> list[tuple]:
        word = {"js": self.script_word, "ts": self.script_word, "go": self.go_word, "rust": self.rust_word}[self.language]
        for i, t in enumerate(self.code):
            if t.kind == "word":
                word(i, t.value)
                self.call(i)
            elif t.kind == "mark":
                self.mark(i, t)
        last = self.text.count("\n") + 1
        while self.stack:
            kind = self.pop(last)
            self.error = self.error or f"line {last}: {kind} is never closed"
        for row in self.rows:
            if row["node_type"] == "class":
                row["bases"] += [b for b in self.traits.get(row["name"], ()) if b not in row["bases"]]
        imports = list(dict.fromkeys(self.imports))
        out = [(self.path, r["id"], r["node_type"], r["name"], r["parent_id"], r["start_line"], r["end_line"], r["signature"], imports, r["bases"], sorted(r["calls"]), None) for r in self.rows]
        if self.error is not None:
            out.append((self.path, self.path, "file", self.path, None, 0, 0, None, [], [], [], self.error))
        return out


def brace_chunks(files: DataFrame) -> DataFrame:
    """Classes and functions of JavaScript, TypeScript, Go and Rust files (file_path, text), as :func:`python_chunks` gives them.

    Methods belong to their class (in Go to the receiver's type, in Rust to the type of the ``impl``); interfaces, traits,
    structs and enums are classes, embedded types and implemented traits are bases. Arrow functions count where they have a
    name and a block. Comments, texts, patterns and templates hide braces. A file whose brackets don't match gives what
    was found and a ``file`` row with the error. Null texts are empty; other extensions give no rows. Time grows with the text.
    """
    ship(files.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["file_path"], frame["text"], strict=True):
                out += _File(path, text or "", LANGUAGES[path.rpartition(".")[2].lower()]).parse()
            yield pd.DataFrame(out, columns=columns)

    known = files.filter(_extension().isin(*LANGUAGES))
    return dealt(known.select("file_path", "text")).mapInPandas(run, SCHEMA)


def _extension() -> Column:
    return F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))


def code_chunks(files: DataFrame) -> DataFrame:
    """Classes and functions of Python files and of those with braces."""
    return python_chunks(files.filter(_extension() == "py")).unionByName(brace_chunks(files))
