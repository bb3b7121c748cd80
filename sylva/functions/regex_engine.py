"""Regular expressions of ECMAScript: a validating parser, a printer and six rewrites that are repeated until none applies."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from sylva.session import ship

YEARS = ("ES5", "ES2015", "ES2016", "ES2017", "ES2018", "ES2019", "ES2020", "ES2021")
SYNTAX = "^$\\.*+?()[]{}|/"
#: General categories and their long names, as \p{...} takes them.
CATEGORIES = {
    "L": "Letter", "LC": "Cased_Letter", "Lu": "Uppercase_Letter", "Ll": "Lowercase_Letter", "Lt": "Titlecase_Letter", "Lm": "Modifier_Letter", "Lo": "Other_Letter", "M": "Mark", "Mn": "Nonspacing_Mark", "Mc": "Spacing_Mark",
    "Me": "Enclosing_Mark", "N": "Number", "Nd": "Decimal_Number", "Nl": "Letter_Number", "No": "Other_Number", "P": "Punctuation", "Pc": "Connector_Punctuation", "Pd": "Dash_Punctuation", "Ps": "Open_Punctuation",
    "Pe": "Close_Punctuation", "Pi": "Initial_Punctuation", "Pf": "Final_Punctuation", "Po": "Other_Punctuation", "S": "Symbol", "Sm": "Math_Symbol", "Sc": "Currency_Symbol", "Sk": "Modifier_Symbol", "So": "Other_Symbol",
    "Z": "Separator", "Zs": "Space_Separator", "Zl": "Line_Separator", "Zp": "Paragraph_Separator", "C": "Other", "Cc": "Control", "Cf": "Format", "Cs": "Surrogate", "Co": "Private_Use", "Cn": "Unassigned",
}
#: Binary properties with their short names.
BINARY = frozenset(
    "ASCII AHex ASCII_Hex_Digit Alpha Alphabetic Any Assigned Bidi_C Bidi_Control Bidi_M Bidi_Mirrored CI Case_Ignorable Cased CWCF Changes_When_Casefolded CWCM Changes_When_Casemapped CWL "
    "Changes_When_Lowercased CWKCF Changes_When_NFKC_Casefolded CWT Changes_When_Titlecased CWU Changes_When_Uppercased Dash DI Default_Ignorable_Code_Point Dep Deprecated Dia Diacritic Emoji Emoji_Component "
    "Emoji_Modifier Emoji_Modifier_Base Emoji_Presentation EBase EComp EMod EPres ExtPict Extended_Pictographic Ext Extender Gr_Base Grapheme_Base Gr_Ext Grapheme_Extend Hex Hex_Digit IDSB IDS_Binary_Operator IDST "
    "IDS_Trinary_Operator IDC ID_Continue IDS ID_Start Ideo Ideographic Join_C Join_Control LOE Logical_Order_Exception Lower Lowercase Math NChar Noncharacter_Code_Point Pat_Syn Pattern_Syntax Pat_WS "
    "Pattern_White_Space QMark Quotation_Mark Radical RI Regional_Indicator STerm Sentence_Terminal SD Soft_Dotted Term Terminal_Punctuation UIdeo Unified_Ideograph Upper Uppercase VS Variation_Selector space "
    "White_Space XIDC XID_Continue XIDS XID_Start".split()
)


class Invalid(ValueError):
    """The pattern is not a regular expression; says why and at which character."""

    def __init__(self, what: str, at: int = 0) -> None:
        super().__init__(what)
        self.at = at


@dataclass
class Re:
    """A node. kind: char (text, value), dot, escape (class escapes), assert, backref, class, group, look, empty; with a quantifier or none."""

    kind: str
    text: str = ""
    value: int = -1
    parts: list = field(default_factory=list)  # of a class: (first, last) nodes or one; of a group: alternatives, lists of nodes
    open: str = ""
    quantifier: tuple[int, int | None, bool] | None = None  # least, most, lazy
    quantifier_text: str = ""


def _id_start(c: str) -> bool:
    return c in "$_" or c.isidentifier()


def _id_part(c: str) -> bool:
    return c in "$‌‍" or ("a" + c).isidentifier()


class Reader:
    """Parses one pattern. unicode: the u flag is set, which makes the grammar strict."""

    def __init__(self, pattern: str, unicode: bool, year: str = "ES2021") -> None:
        self.s, self.u, self.i = pattern, unicode, 0
        self.year = YEARS.index(year)
        self.names: list[str] = []
        self.refs: list[tuple[str, int]] = []
        self.back = 0
        self.named = False
        self.groups = 0

    def parse(self) -> list[list[Re]]:
        self.groups, has_names = self._count_groups()
        self.named = self.u or has_names and self.year >= 4
        out = self.disjunction()
        if self.i < len(self.s):
            c = self.s[self.i]
            self.fail("unmatched )" if c == ")" else f"a lone {c}")
        for name, at in self.refs:
            if name not in self.names:
                raise Invalid(f"no group is named {name}", at)
        if self.u and self.back > self.groups:
            self.fail("a back reference to a group that isn't there")
        return out

    def _count_groups(self) -> tuple[int, bool]:
        n, names, i, inside = 0, False, 0, False
        s = self.s
        while i < len(s):
            c = s[i]
            if c == "\\":
                i += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "(" and not inside:
                if not s.startswith("(?", i):
                    n += 1
                elif s.startswith("(?<", i) and s[i + 3 : i + 4] not in ("=", "!"):
                    n, names = n + 1, True
            i += 1
        return n, names

    def fail(self, what: str) -> None:
        raise Invalid(what, self.i)

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def eat(self, text: str) -> bool:
        if self.s.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def disjunction(self) -> list[list[Re]]:
        out = [self.alternative()]
        while self.eat("|"):
            out.append(self.alternative())
        return out

    def alternative(self) -> list[Re]:
        out: list[Re] = []
        while self.i < len(self.s) and self.peek() not in "|)":
            out.append(self.term())
        return out

    def term(self) -> Re:
        start, c = self.i, self.peek()
        if c in "^$":
            self.i += 1
            node = Re("assert", c)
            quantifiable = False
        elif self.s.startswith(("\\b", "\\B"), self.i):
            self.i += 2
            node, quantifiable = Re("assert", self.s[start : start + 2]), False
        elif c == "(":
            node, quantifiable = self.group()
        elif c in "*+?":
            self.fail("nothing to repeat")
        elif c == "{":
            if self.u or self._braces():
                self.fail("nothing to repeat")
            self.i += 1
            node, quantifiable = Re("char", c, ord(c)), True
        elif c in "]}":
            if self.u:
                self.fail(f"a lone {c}")
            self.i += 1
            node, quantifiable = Re("char", c, ord(c)), True
        elif c == ".":
            self.i += 1
            node, quantifiable = Re("dot", c), True
        elif c == "[":
            node, quantifiable = self.char_class(), True
        elif c == "\\":
            node, quantifiable = self.escape(False), True
        else:
            self.i += 1
            node, quantifiable = Re("char", c, ord(c)), True
        return self.quantify(node, quantifiable)

    def _braces(self) -> tuple[int, int | None, int] | None:
        """{n}, {n,} or {n,m} at the place, if there is one: least, most, end."""
        if self.peek() != "{":
            return None
        end = self.s.find("}", self.i)
        if end < 0:
            return None
        low, comma, high = self.s[self.i + 1 : end].partition(",")
        if not (low.isascii() and low.isdigit()) or high and not (high.isascii() and high.isdigit()):
            return None
        return int(low), int(high) if high else None if comma else int(low), end + 1

    def quantify(self, node: Re, quantifiable: bool) -> Re:
        start, c = self.i, self.peek()
        if c and c in "*+?":
            self.i += 1
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif braces := self._braces():
            low, high, self.i = braces
            if high is not None and low > high:
                self.fail("the numbers of a quantifier are out of order")
        else:
            if c == "{" and self.u:
                self.fail("an incomplete quantifier")
            return node
        if not quantifiable:
            self.fail("nothing to repeat")
        node.quantifier = (low, high, self.eat("?"))
        node.quantifier_text = self.s[start : self.i]
        return node

    def group(self) -> tuple[Re, bool]:
        start, quantifiable, kind = self.i, True, "group"
        if self.eat("(?:"):
            pass
        elif self.eat("(?=") or self.eat("(?!"):
            kind, quantifiable = "look", not self.u
        elif self.s.startswith(("(?<=", "(?<!"), self.i) and self.year >= 4:
            self.i += 4
            kind, quantifiable = "look", False
        elif self.s.startswith("(?<", self.i) and self.year >= 4:
            self.i += 3
            name = self.name()
            if name in self.names:
                self.fail(f"a second group named {name}")
            self.names.append(name)
        elif self.s.startswith("(?", self.i):
            self.fail("an invalid group")
        else:
            self.i += 1
        opened = self.s[start : self.i]
        parts = self.disjunction()
        if not self.eat(")"):
            self.fail("an unterminated group")
        return Re(kind, open=opened, parts=parts), quantifiable

    def name(self) -> str:
        out = ""
        while self.peek() not in (">", ""):
            c = self.peek()
            if c == "\\":
                at = self.i
                self.i += 1
                if not self.eat("u"):
                    self.fail("an invalid name of a group")
                value = self.unicode_escape(True)
                if value is None:
                    self.i = at
                    self.fail("an invalid name of a group")
                c = chr(value)
            else:
                self.i += 1
            if not (_id_part(c) if out else _id_start(c)):
                self.fail("an invalid name of a group")
            out += c
        if not out or not self.eat(">"):
            self.fail("an invalid name of a group")
        return out

    def unicode_escape(self, braces: bool) -> int | None:
        """What follows \\u."""
        s = self.s
        if braces and self.peek() == "{":
            end = s.find("}", self.i)
            text = s[self.i + 1 : end] if end > 0 else ""
            if not text or any(c not in "0123456789abcdefABCDEF" for c in text) or int(text, 16) > 0x10FFFF:
                return None
            self.i = end + 1
            return int(text, 16)
        text = s[self.i : self.i + 4]
        if len(text) < 4 or any(c not in "0123456789abcdefABCDEF" for c in text):
            return None
        self.i += 4
        value = int(text, 16)
        if braces and 0xD800 <= value < 0xDC00 and s.startswith("\\u", self.i):
            low = s[self.i + 2 : self.i + 6]
            if len(low) == 4 and all(c in "0123456789abcdefABCDEF" for c in low) and 0xDC00 <= int(low, 16) < 0xE000:
                self.i += 6
                return 0x10000 + ((value - 0xD800) << 10) + int(low, 16) - 0xDC00
        return value

    def escape(self, in_class: bool) -> Re:
        start = self.i
        self.i += 1
        c = self.peek()
        if not c:
            self.fail("a backslash at the end of the pattern")
        self.i += 1
        text = lambda: self.s[start : self.i]
        if c in "dDsSwW":
            return Re("escape", text())
        if c in "pP" and self.u and self.year >= 4:
            self.property()
            return Re("escape", text())
        if c in "fnrtv":
            return Re("char", text(), ord("\f\n\r\t\v"["fnrtv".index(c)]))
        if in_class and c == "b":
            return Re("char", text(), 8)
        if in_class and c == "-" and self.u:
            return Re("char", text(), ord("-"))
        if c == "c":
            after = self.peek()
            if after.isascii() and after.isalpha() or in_class and not self.u and after and (after.isascii() and after.isdigit() or after == "_"):
                self.i += 1
                return Re("char", text(), ord(after) % 32)
            if self.u:
                self.fail("an invalid control escape")
            self.i = start + 1
            return Re("char", "\\", ord("\\"))
        if c == "0" and not (self.peek().isascii() and self.peek().isdigit()):
            return Re("char", text(), 0)
        if c == "x":
            digits = self.s[self.i : self.i + 2]
            if len(digits) == 2 and all(x in "0123456789abcdefABCDEF" for x in digits):
                self.i += 2
                return Re("char", text(), int(digits, 16))
            if self.u:
                self.fail("an invalid escape")
            return Re("char", text(), ord("x"))
        if c == "u":
            value = self.unicode_escape(self.u)
            if value is None:
                if self.u:
                    self.fail("an invalid unicode escape")
                return Re("char", text(), ord("u"))
            return Re("char", text(), value)
        if c.isascii() and c.isdigit():
            if in_class:
                if self.u:
                    self.fail("an invalid escape in a class")
                return self._octal(start)
            j = self.i
            while j < len(self.s) and self.s[j].isascii() and self.s[j].isdigit():
                j += 1
            n = int(self.s[self.i - 1 : j])
            if c != "0" and (self.u or n <= self.groups):
                self.i = j
                self.back = max(self.back, n)
                return Re("backref", text())
            if self.u:
                self.fail("an invalid decimal escape")
            return self._octal(start)
        if c == "k" and self.named:
            if not self.eat("<"):
                self.fail("an invalid named reference")
            at = self.i
            self.refs.append((self.name(), at))
            return Re("backref", text())
        if self.u:
            if c not in SYNTAX:
                self.fail("an invalid escape")
        return Re("char", text(), ord(c))

    def _octal(self, start: int) -> Re:
        j = start + 1
        while j < len(self.s) and j < start + 4 and self.s[j] in "01234567" and int(self.s[start + 1 : j + 1], 8) <= 0o377:
            j += 1
        if j == start + 1:  # 8 or 9 stands for itself
            self.i = start + 2
            return Re("char", self.s[start : self.i], ord(self.s[start + 1]))
        self.i = j
        return Re("char", self.s[start:j], int(self.s[start + 1 : j], 8))

    def property(self) -> None:
        if not self.eat("{"):
            self.fail("an invalid property name")
        end = self.s.find("}", self.i)
        name, equals, value = self.s[self.i : end].partition("=")
        categories = {*CATEGORIES, *CATEGORIES.values(), "punct", "digit", "cntrl", "Combining_Mark"}
        ok = end > 0 and (name in ("General_Category", "gc") and value in categories or name in ("Script", "sc", "Script_Extensions", "scx") and value[:1].isalpha() and value.replace("_", "").isalnum() if equals else name in categories or name in BINARY)
        if not ok:
            self.fail("an invalid property name")
        self.i = end + 1

    def char_class(self) -> Re:
        start = self.i
        self.i += 1
        self.eat("^")
        opened = self.s[start : self.i]
        parts: list = []
        while True:
            if self.i >= len(self.s):
                self.fail("an unterminated class")
            if self.eat("]"):
                return Re("class", open=opened, parts=parts)
            first = self.class_atom()
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                self.i += 1
                last = self.class_atom()
                if first.kind == "char" and last.kind == "char":
                    if first.value > last.value:
                        self.fail("a range out of order")
                    parts.append((first, last))
                    continue
                if self.u:
                    self.fail("a range with a class escape")
                parts += [first, Re("char", "-", ord("-")), last]
                continue
            parts.append(first)

    def class_atom(self) -> Re:
        if self.peek() == "\\":
            return self.escape(True)
        c = self.peek()
        self.i += 1
        return Re("char", c, ord(c))


def check_flags(flags: str) -> None:
    for i, f in enumerate(flags):
        if f not in "gimsuy":
            raise Invalid(f"an invalid flag {f}")
        if f in flags[:i]:
            raise Invalid(f"the flag {f} twice")


def parse(pattern: str, flags: str = "", year: str = "ES2021") -> list[list[Re]]:
    check_flags(flags)
    return Reader(pattern, "u" in flags, year).parse()


def show(alternatives: list[list[Re]]) -> str:
    return "|".join("".join(map(_show, nodes)) for nodes in alternatives)


def _show(n: Re) -> str:
    if n.kind == "class":
        body = n.open + "".join(_show(p[0]) + "-" + _show(p[1]) if isinstance(p, tuple) else _show(p) for p in n.parts) + "]"
    elif n.kind in ("group", "look"):
        body = n.open + show(n.parts) + ")"
    else:
        body = n.text
    return body + n.quantifier_text


# Rewrites


def _range(p: object) -> str:
    return p[0].text + "-" + p[1].text if isinstance(p, tuple) else p.text


def _group_quantifier(n: Re) -> Re:
    """(a*)* is (a*)."""
    if n.kind == "group" and n.quantifier == (0, None, False) and len(n.parts) == 1 and n.parts[0]:
        if n.parts[0][-1].quantifier == (0, None, False) and n.parts[0][-1].quantifier_text == "*":
            return replace(n, quantifier=None, quantifier_text="")
    return n


def _word_class(n: Re) -> Re:
    """[a-zA-Z0-9_] is [\\w]."""
    if n.kind == "class":
        names = [_range(p) for p in n.parts]
        if all(x in names for x in ("a-z", "A-Z", "0-9", "_")):
            kept, put = [], False
            for name, p in zip(names, n.parts, strict=True):
                if name in ("a-z", "A-Z", "0-9", "_"):
                    if not put:
                        kept.append(Re("escape", "\\w"))
                        put = True
                else:
                    kept.append(p)
            return replace(n, parts=kept)
    return n


def _digit_class(n: Re) -> Re:
    """[0-9] is \\d."""
    if n.kind == "class" and any(_range(p) == "0-9" for p in n.parts):
        parts = [Re("escape", "\\d") if _range(p) == "0-9" else p for p in n.parts]
        if len(parts) == 1:
            return replace(parts[0], text="\\D" if n.open == "[^" else "\\d", quantifier=n.quantifier, quantifier_text=n.quantifier_text)
        return replace(n, parts=parts)
    return n


def _short_quantifier(text: str, short: str):
    def rewrite(n: Re) -> Re:
        if n.quantifier_text.rstrip("?") == text:
            return replace(n, quantifier_text=n.quantifier_text.replace(text, short))
        return n

    return rewrite


def _each(alternatives: list[list[Re]], rewrite) -> list[list[Re]]:
    return [[rewrite(replace(n, parts=_each(n.parts, rewrite)) if n.kind in ("group", "look") else n) for n in nodes] for nodes in alternatives]


def _runs(alternatives: list[list[Re]]) -> list[list[Re]]:
    """aaa is a{3}."""
    out = []
    for nodes in alternatives:
        done: list[Re] = []
        i = 0
        while i < len(nodes):
            n = nodes[i]
            j = i + 1
            if n.kind == "char" and n.quantifier is None:
                while j < len(nodes) and nodes[j].kind == "char" and nodes[j].text == n.text and nodes[j].quantifier is None:
                    j += 1
            if j - i >= 2:
                done.append(replace(n, quantifier=(j - i, j - i, False), quantifier_text="{%d}" % (j - i)))
            else:
                done.append(replace(n, parts=_runs(n.parts)) if n.kind in ("group", "look") else n)
            i = j
        out.append(done)
    return out


PASSES = (_group_quantifier, _word_class, _digit_class, _short_quantifier("{0,}", "*"), _short_quantifier("{1,}", "+"))


def simplify(pattern: str, flags: str = "") -> str:
    """The pattern after the rewrites, repeated until nothing changes."""
    while True:
        tree = parse(pattern, flags)
        for rewrite in PASSES:
            tree = _each(tree, rewrite)
        now = show(_runs(tree))
        if now == pattern or len(now) > len(pattern) + 8:
            return pattern if len(now) > len(pattern) + 8 else now
        pattern = now


def check(pattern: str, flags: str) -> tuple[bool, str | None, str | None]:
    """(valid, why not, what it may be written as)."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 20 * pattern.count("("))
    try:
        parse(pattern, flags)
        now = simplify(pattern, flags)
    except Invalid as e:
        return False, str(e), None
    except RecursionError:
        return False, "nesting is too deep", None
    finally:
        sys.setrecursionlimit(limit)
    return True, None, now if now != pattern else None


def _check_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [check(p.as_py() or "", f.as_py() or "") for p, f in zip(b.column(0), b.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["pattern", "flags", "ok", "message", "simplified"])


def check_patterns(patterns: DataFrame) -> DataFrame:
    """pattern, flags, ok, message, simplified (null if the rewrites change nothing) of distinct patterns."""
    ship(patterns.sparkSession)
    return patterns.select("pattern", "flags").mapInArrow(_check_rows, "pattern string, flags string, ok boolean, message string, simplified string")



def capture_groups(pattern: str, flags: str = "") -> tuple[int, list[str]]:
    """How many groups capture, and the names of those that have one."""
    reader = Reader(pattern, "u" in flags)
    reader.parse()
    return reader.groups, reader.names
