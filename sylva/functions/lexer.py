"""A lossless JavaScript and TypeScript lexer.

Tokens are made on demand, because whether a slash starts a regular expression depends on what stands before it; the parser may
take a guess back with :meth:`Lexer.rescan`. Offsets here are in characters; :func:`byte_offsets` turns them into UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np

#: Punctuation and its kinds.
PUNCTUATION = {
    ";": "SEMICOLON", ",": "COMMA", "(": "L_PAREN", ")": "R_PAREN", "{": "L_CURLY", "}": "R_CURLY", "[": "L_BRACK", "]": "R_BRACK",
    "<": "L_ANGLE", ">": "R_ANGLE", "~": "TILDE", "?": "QUESTION", "??": "QUESTION2", "?.": "QUESTIONDOT", "&": "AMP", "|": "PIPE",
    "+": "PLUS", "++": "PLUS2", "*": "STAR", "**": "STAR2", "/": "SLASH", "^": "CARET", "%": "PERCENT", ".": "DOT", "...": "DOT2",
    ":": "COLON", "=": "EQ", "==": "EQ2", "===": "EQ3", "=>": "FAT_ARROW", "!": "BANG", "!=": "NEQ", "!==": "NEQ2", "-": "MINUS",
    "--": "MINUS2", "<=": "LTEQ", ">=": "GTEQ", "+=": "PLUSEQ", "-=": "MINUSEQ", "|=": "PIPEEQ", "&=": "AMPEQ", "^=": "CARETEQ",
    "/=": "SLASHEQ", "*=": "STAREQ", "%=": "PERCENTEQ", "&&": "AMP2", "||": "PIPE2", "<<": "SHL", ">>": "SHR", ">>>": "USHR",
    "<<=": "SHLEQ", ">>=": "SHREQ", ">>>=": "USHREQ", "&&=": "AMP2EQ", "||=": "PIPE2EQ", "**=": "STAR2EQ", "??=": "QUESTION2EQ", "@": "AT",
}

#: Reserved words; each has the kind of its upper-case name and _KW.
KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if in "
    "instanceof interface import implements new null package private protected public return super switch this throw try true typeof "
    "var void while with yield".split()
)

_WHITE = re.compile("[\\t\\v\\f \\xa0\\ufeff\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000\\n\\r\\u2028\\u2029]+")
_LINE_END = re.compile("[\\n\\r\\u2028\\u2029]")
_LINE_COMMENT = re.compile("//[^\\n\\r\\u2028\\u2029]*")
_SHEBANG = re.compile("#![^\\n\\r\\u2028\\u2029]*")
_ESCAPED = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
_WORD = re.compile(rf"(?:[^\W\d]|\$|{_ESCAPED})(?:[\w$\u200c\u200d]|{_ESCAPED})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]*n?|0[oO][0-7_]*n?|0[bB][01_]*n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_OPEN_STRING = re.compile(r"['\"](?:[^\\\n\r]|\\(?:\r\n|[\s\S]))*")
_REGEX = re.compile("/(?:[^/\\\\\\[\\n\\r\\u2028\\u2029]|\\\\[^\\n\\r\\u2028\\u2029]|\\[(?:[^\\]\\\\\\n\\r\\u2028\\u2029]|\\\\[^\\n\\r\\u2028\\u2029])*\\])+/(?:[\\w$])*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))+")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u(?!\{[0-9a-fA-F]{1,6}\}|[0-9a-fA-F]{4})|x(?![0-9a-fA-F]{2}))")
_PUNCTUATION = re.compile(r"\?\.(?![0-9])|" + "|".join(re.escape(p) for p in sorted(PUNCTUATION, key=len, reverse=True) if p != "?."))

#: After these a slash divides.
_OPERANDS = frozenset("NUMBER STRING REGEX BACKTICK IDENT R_BRACK THIS_KW SUPER_KW NULL_KW TRUE_KW FALSE_KW PLUS2 MINUS2 PRIVATE_NAME".split())
#: After these a brace opens an expression.
_BEFORE_OBJECT = frozenset("L_PAREN L_BRACK COMMA EQ COLON QUESTION RETURN_KW TYPEOF_KW VOID_KW DELETE_KW NEW_KW IN_KW INSTANCEOF_KW THROW_KW CASE_KW BANG TILDE PLUS MINUS DOLLARCURLY AWAIT_KW YIELD_KW AMP2 PIPE2 QUESTION2".split())

TRIVIA = ("WHITESPACE", "COMMENT")


class Token:
    __slots__ = ("kind", "start", "end", "nl", "error")

    def __init__(self, kind: str, start: int, end: int, nl: bool = False, error: str | None = None) -> None:
        self.kind, self.start, self.end, self.nl, self.error = kind, start, end, nl, error


class Lexer:
    """Raw tokens of a source, trivia included, one at a time."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.at = 0
        self.before = ""  # kind of the last token that isn't trivia
        self.stack: list[tuple[str, str]] = []  # open brackets: what they are, what stood before
        self.closed = ""  # what the last closed bracket was
        self.line = False  # a line ended since the last token that isn't trivia

    def state(self) -> tuple:
        return self.at, self.before, list(self.stack), self.closed, self.line

    def restore(self, state: tuple) -> None:
        self.at, self.before, stack, self.closed, self.line = state
        self.stack = list(stack)

    def _divides(self) -> bool:
        if self.before == "R_PAREN":
            return self.closed != "head"
        if self.before == "R_CURLY":
            return self.closed == "object"
        return self.before in _OPERANDS

    def next(self, regex: bool | None = None) -> Token | None:
        """The next token; regex overrides the guess for a slash."""
        source, at = self.source, self.at
        if at >= len(source):
            return None
        if self.stack and self.stack[-1][0] == "template" and self.before in ("BACKTICK", "TEMPLATE_CHUNK", "TEMPLATE_END"):
            if m := _CHUNK.match(source, at):
                return self._out("TEMPLATE_CHUNK", at, m.end())
            if source.startswith("${", at):
                self.stack.append(("dollar", self.before))
                return self._out("DOLLARCURLY", at, at + 2)
            if source[at] == "`":
                self.stack.pop()
                return self._out("BACKTICK", at, at + 1)
            return self._out("ERROR_TOKEN", at, len(source), "unterminated template")
        c = source[at]
        if m := _WHITE.match(source, at):
            self.line = self.line or _LINE_END.search(source, at, m.end()) is not None
            self.at = m.end()
            return Token("WHITESPACE", at, m.end())
        if c == "/":
            if source.startswith("//", at):
                self.at = _LINE_COMMENT.match(source, at).end()
                return Token("COMMENT", at, self.at)
            if source.startswith("/*", at):
                end = source.find("*/", at + 2)
                self.at = len(source) if end < 0 else end + 2
                self.line = self.line or _LINE_END.search(source, at, self.at) is not None
                return Token("COMMENT", at, self.at, error="unterminated comment" if end < 0 else None)
            if not self._divides() if regex is None else regex:
                if m := _REGEX.match(source, at):
                    return self._out("REGEX", at, m.end())
        if at == 0 and source.startswith("#!"):
            return self._out("SHEBANG", 0, _SHEBANG.match(source).end())
        if m := _WORD.match(source, at):
            word = m.group()
            if word in KEYWORDS and self.before != "DOT":
                return self._out(word.upper() + "_KW", at, m.end())
            return self._out(word.upper() + "_KW" if word in KEYWORDS else "IDENT", at, m.end(), as_word=self.before == "DOT")
        if c.isdigit() and c.isascii() or c == "." and source[at + 1 : at + 2].isdigit() and source[at + 1].isascii():
            end = _NUMBER.match(source, at).end()
            bad = _WORD.match(source, end)
            return self._out("NUMBER", at, end, "an identifier can't follow a number" if bad else None)
        if c in "'\"":
            if m := _STRING.match(source, at):
                return self._out("STRING", at, m.end(), "invalid escape sequence" if _BAD_ESCAPE.search(source, at, m.end()) else None)
            return self._out("ERROR_TOKEN", at, _OPEN_STRING.match(source, at).end(), "unterminated string")
        if c == "`":
            self.stack.append(("template", self.before))
            return self._out("BACKTICK", at, at + 1)
        if c == "#":
            return self._out("HASH", at, at + 1)
        if m := _PUNCTUATION.match(source, at):
            return self._punctuation(PUNCTUATION[m.group()], at, m.end())
        return self._out("ERROR_TOKEN", at, at + 1, f"unexpected character {c!r}")

    def _punctuation(self, kind: str, at: int, end: int) -> Token:
        if kind == "L_PAREN":
            self.stack.append(("head" if self.before in ("IF_KW", "WHILE_KW", "FOR_KW", "WITH_KW") else "paren", self.before))
        elif kind == "L_CURLY":
            self.stack.append(("object" if self.before in _BEFORE_OBJECT else "block", self.before))
        elif kind == "L_BRACK":
            self.stack.append(("bracket", self.before))
        elif kind in ("R_PAREN", "R_CURLY", "R_BRACK"):
            if self.stack and self.stack[-1][0] != "template":
                self.closed = self.stack.pop()[0]
                if kind == "R_CURLY" and self.closed == "dollar":
                    out = self._out(kind, at, end)
                    self.before = "TEMPLATE_END"
                    return out
        return self._out(kind, at, end)

    def _out(self, kind: str, at: int, end: int, error: str | None = None, as_word: bool = False) -> Token:
        token = Token(kind, at, end, self.line, error)
        self.at, self.before, self.line = end, "IDENT" if as_word else kind, False
        return token


def tokenize(source: str) -> list[Token]:
    """All tokens of a source by guess alone; their texts put together are the source."""
    lexer, out = Lexer(source), []
    while (t := lexer.next()) is not None:
        out.append(t)
    return out


def byte_offsets(source: str) -> np.ndarray | None:
    """UTF-8 byte offset of every character and of the end; None if characters are bytes."""
    if source.isascii():
        return None
    points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(sizes)))


def line_of(starts: list[int], offset: int) -> int:
    """The 0-based line of an offset: the last line that starts at or before it."""
    return bisect_right(starts, offset) - 1


def line_starts(source: bytes | str) -> list[int]:
    """Offset 0 and those after each newline."""
    mark = b"\n" if isinstance(source, bytes) else "\n"
    return [0, *(m.end() for m in re.finditer(mark, source))]
