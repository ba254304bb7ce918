"""Tool calls inside a program: some transcripts record one JavaScript program for many calls.

A program is cut into tokens once; calls `tools.name({...})` are read off the tokens where their argument
is a literal. Names of string constants stand for their text. What only running the program could tell is
left out; a call whose argument is no literal at all keeps the whole program.
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|$))
      | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)
      | (?P<name>[A-Za-z_$][\w$]*)
      | (?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))
      | (?P<mark>.)""",
    re.DOTALL | re.VERBOSE,
)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
WORDS = {"true": True, "false": False, "null": None, "undefined": None}
DEPTH = 64


class Unknown(Exception):
    """Only running the program could tell."""


def _tokens(program: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in TOKEN.finditer(program) if m.lastgroup != "gap"]


def _text(raw: str) -> str:
    if raw[0] == "`" and re.search(r"(?<!\\)(?:\\\\)*\$\{", raw):
        raise Unknown

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]
        return PLAIN.get(m[4], m[4])

    text = re.sub(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", one, raw[1:-1], flags=re.DOTALL)
    # halves of a pair that were written one by one
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]], at: int, known: dict[str, str]):
        self.tokens, self.at, self.known = tokens, at, known

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def value(self, depth: int = 0):
        """The literal that begins here and is followed by a comma or a closing mark."""
        kind, raw = self.take()
        if depth > DEPTH:
            raise Unknown
        if raw == "{" and kind == "mark":
            out = self.object(depth)
        elif raw == "[" and kind == "mark":
            out = self.array(depth)
        elif kind == "string":
            out = _text(raw)
        elif kind == "number":
            out = int(raw, 16) if "x" in raw.lower() else float(raw) if re.search("[.eE]", raw) else int(raw)
        elif kind == "name" and raw in WORDS:
            out = WORDS[raw]
        elif kind == "name" and raw in self.known:
            out = self.known[raw]
        else:
            raise Unknown
        if self.peek()[1] not in (",", "}", "]", ")") or self.peek()[0] != "mark":
            raise Unknown
        return out

    def skip(self) -> None:
        """To the comma or closing mark that ends what stands here."""
        open_ = 0
        while True:
            kind, raw = self.peek()
            if kind == "end":
                raise Unknown
            if kind == "mark":
                if open_ == 0 and raw in ",}])":
                    return
                open_ += (raw in "{[(") - (raw in "}])")
            self.at += 1

    def object(self, depth: int) -> dict:
        out: dict = {}
        lost = False
        while True:
            kind, raw = self.take()
            if kind == "mark" and raw == "}":
                if lost and not out:
                    raise Unknown
                return out
            if kind == "mark" and raw == ",":
                continue
            if kind not in ("string", "name", "number"):
                if kind == "end":
                    raise Unknown
                lost = True
                self.skip()
                continue
            key = _text(raw) if kind == "string" else raw
            start = self.at
            try:
                if self.peek() == ("mark", ":"):
                    self.at = start = self.at + 1
                    out[key] = self.value(depth + 1)
                elif kind == "name" and self.peek()[1] in (",", "}") and raw in self.known:
                    out[key] = self.known[raw]
                else:
                    raise Unknown
            except Unknown:
                lost = True
                self.at = start
                self.skip()

    def array(self, depth: int) -> list:
        out = []
        while True:
            if self.peek() == ("mark", "]"):
                self.at += 1
                return out
            out.append(self.value(depth + 1))
            if self.peek() == ("mark", ","):
                self.at += 1


def inner_calls(program: str) -> list[tuple[str, dict | None]]:
    """(tool, arguments) of the calls a program makes, in order; arguments are None where they are no literal."""
    tokens, known, out = _tokens(program), {}, []
    for i, (kind, raw) in enumerate(tokens):
        near = [t[1] for t in tokens[i : i + 5]]
        if kind != "name":
            continue
        before = tokens[i - 1][1] if i else ""
        if raw == "const" and len(near) > 3 and near[2] == "=" and tokens[i + 1][0] == "name" and tokens[i + 3][0] == "string":
            if len(near) < 5 or near[4] in (";", ",") or tokens[i + 4][0] == "name":
                try:
                    known[near[1]] = _text(near[3])
                except Unknown:
                    known.pop(near[1], None)
        elif raw == "tools" and before != "." and len(near) > 3 and near[1] == "." and tokens[i + 2][0] == "name" and near[3] == "(":
            reader = _Reader(tokens, i + 4, known)
            try:
                given = reader.value()
            except Unknown:
                given = None
            out.append((near[2], given if isinstance(given, dict) else None))
    return out


def wrapper_calls(program: str, name: str = "exec") -> list[tuple[str, dict]]:
    """The calls a program stands for; without any, the program itself as one call."""
    found = inner_calls(program) or [(name, None)]
    return [(tool, {"source": program} if given is None else given) for tool, given in found]
