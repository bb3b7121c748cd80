"""Rows of tokens and nodes of one source, with the facts about subtrees that rules ask for."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache

import xxhash

from sylva.functions.lexer import TRIVIA, byte_offsets
from sylva.functions.parser import Node, Parser, parse
from sylva.functions.regex_engine import check

LEX_TOKENS = 24  # an expression of more tokens has no lex, only the hash of its tokens
TEXT_CHARS = 160
MAX_PATH = 512  # nearest ancestors in a path; of those above them, links of a chain are left out
#: What the parser reads in a loop, so that only these may be in each other without a bound.
CHAINED = frozenset(("BIN_EXPR", "CALL_EXPR", "DOT_EXPR", "BRACKET_EXPR", "PRIVATE_PROP_ACCESS", "TS_NON_NULL"))
FUNCTIONS = ("FN_DECL", "FN_EXPR", "ARROW_EXPR", "METHOD", "GETTER", "SETTER", "CONSTRUCTOR")
_BREAK = re.compile("[\n\r  ]")


#: What one-letter escapes in strings stand for.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
_ESCAPE = re.compile(r"\\(u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|\r\n|.)", re.S)


def string_value(literal: str) -> str:
    """What a string literal stands for; halves of a surrogate pair are joined."""

    def one(m: re.Match) -> str:
        if code := m[2] or m[3] or m[4]:
            return chr(int(code, 16)) if int(code, 16) <= 0x10FFFF else ""
        if m[1] in ("\n", "\r", "\r\n", "\u2028", "\u2029"):
            return ""
        return ESCAPES.get(m[1], m[1])

    out = _ESCAPE.sub(one, literal[1:-1])
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in out) else out


checked = lru_cache(4096)(check)  # each pattern once in a worker


#: Facts of a node, in the order of their columns.
NODE_FACTS = (
    "pre", "post", "parent", "depth", "ord", "role", "kind", "op", "start", "end", "tok_lo", "tok_hi", "child_count", "has_comment", "parent_kind",
    "grandparent_kind", "lex", "lexh", "text", "name", "last", "inner", "inner_op", "is_const", "truthy", "flags", "info",
)
HASHED = frozenset(("key", "test", "value", "lhs", "rhs", "callee", "object", "prop", "arg", "expr", "source", "extends", "tag", "element", "name", "init", "cons", "alt", "body"))
VALUED = frozenset(("test", "lhs", "rhs", "arg", "expr", "value", "init", "cons", "alt", "body", "update"))


class Tree:
    """A parsed source; everything it yields is in byte offsets."""

    def __init__(self, source: str, kind: str) -> None:
        self.source = source
        self.root, self.parser = parse(source, kind)
        self.offsets = byte_offsets(source)
        raw = self.parser.raw
        self.all_words = [source[t.start : t.end] for t in self.parser.toks]
        self._lexes: dict[tuple[int, int], tuple[str | None, str]] = {}
        self._consts: dict[tuple[int, bool], bool] = {}
        self._truths: dict[int, bool | None] = {}
        self._returns: dict[tuple[int, str], bool] = {}
        self.comment_before = [0]
        for t in raw:
            self.comment_before.append(self.comment_before[-1] + (t.kind == "COMMENT"))

    def at(self, char: int) -> int:
        return char if self.offsets is None else int(self.offsets[char])

    def span(self, node: Node) -> tuple[int, int]:
        """Characters of a node, trivia at its ends left out."""
        toks = self.parser.toks
        if node.hi <= node.lo:
            at = toks[min(node.lo, len(toks) - 1)].start
            return at, at
        return toks[node.lo].start, toks[node.hi - 1].end

    def text(self, node: Node) -> str:
        s, e = self.span(node)
        return self.source[s:e]

    def bytes_of(self, node: Node) -> str:
        s, e = self.span(node)
        return f"{self.at(s)}:{self.at(e)}"

    def words(self, node: Node) -> list[str]:
        return self.all_words[node.lo : node.hi]

    # Constants and control flow

    def inner(self, node: Node | None) -> Node | None:
        while node is not None and node.kind == "GROUPING_EXPR":
            node = node.get("expr")
        return node

    def is_const(self, node: Node | None, condition: bool) -> bool:
        """Whether an expression has the same value at each run; condition: only its truth counts."""
        if node is None:
            return False
        key = (node.pre, condition)
        if key not in self._consts:
            self._consts[key] = self._is_const(node, condition)
        return self._consts[key]

    def _all_const(self, nodes: list[Node | None], condition: bool) -> bool:
        for n in nodes:  # no generator: those take C stack
            if not self.is_const(n, condition):
                return False
        return True

    def _is_const(self, node: Node, condition: bool) -> bool:
        k = node.kind
        if k in ("LITERAL", "OBJECT_EXPR", "FN_EXPR", "ARROW_EXPR"):
            return True
        if k == "NAME_REF":
            return self.text(node) in ("NaN", "Infinity", "undefined")
        if k == "TEMPLATE":
            return condition and self.has_chunk(node) or self._all_const([e.get("expr") for e in node.all("element")], condition) and node.get("tag") is None
        if k == "GROUPING_EXPR":
            return self.is_const(node.get("expr"), condition)
        if k == "ARRAY_EXPR":
            if node.parent is not None and node.parent.kind == "BIN_EXPR" and node.parent.op == "+":
                elements = node.all("element")
                return "SPREAD_ELEMENT" not in [e.kind for e in elements] and self._all_const(elements, condition)
            return True
        if k == "UNARY_EXPR":
            return node.op == "void" or node.op == "typeof" and condition or self.is_const(node.get("arg"), condition)
        if k == "BIN_EXPR":
            left, right = node.get("lhs"), node.get("rhs")
            if node.op in ("&&", "||"):
                return self.is_const(left, condition) and self.is_const(right, condition) or self.decides(left, node.op) or self.decides(right, node.op)
            return node.op != "in" and self.is_const(left, False) and self.is_const(right, False)
        if k == "ASSIGN_EXPR":
            return node.op == "=" and self.is_const(node.get("rhs"), condition)
        if k == "SEQUENCE_EXPR":
            return self.is_const(node.kids[-1], condition)
        return False

    def decides(self, node: Node | None, op: str) -> bool:
        """Whether an operand settles a logical expression by itself."""
        if node is None:
            return False
        if node.kind == "LITERAL" and node.op == "boolean":
            return (self.text(node) == "true") == (op == "||")
        if node.kind == "UNARY_EXPR":
            return op == "&&" and node.op == "void"
        if node.kind == "BIN_EXPR" and node.op in ("&&", "||"):
            return self.decides(node.get("lhs"), node.op) or self.decides(node.get("rhs"), node.op)
        return False

    def has_chunk(self, template: Node) -> bool:
        own = {i for e in template.kids for i in range(e.lo, e.hi)}
        return any(t.kind == "TEMPLATE_CHUNK" for i, t in enumerate(self.parser.toks[template.lo : template.hi], template.lo) if i not in own)

    def truth(self, node: Node | None) -> bool | None:
        """The truth of an expression where it can be told; unknown in either operand is unknown."""
        if node is None:
            return None
        if node.pre not in self._truths:
            self._truths[node.pre] = self._truth(node)
        return self._truths[node.pre]

    def _truth(self, node: Node) -> bool | None:
        k = node.kind
        if k == "LITERAL":
            text = self.text(node)
            if node.op == "number":
                return re.fullmatch(r"(?:0[xXoObB])?[0_]*\.?[0_]*(?:[eE][+-]?[0-9_]+)?n?", text) is None
            return {"boolean": text == "true", "null": False, "string": len(text) > 2, "regex": True}[node.op]
        if k == "TEMPLATE":
            return True if self.has_chunk(node) else False if not node.kids else None
        if k in ("OBJECT_EXPR", "ARRAY_EXPR", "FN_EXPR"):
            return True
        if k == "ASSIGN_EXPR" and node.op == "=":
            return self.truth(node.get("rhs"))
        if k == "SEQUENCE_EXPR":
            return self.truth(node.kids[-1])
        if k == "NAME_REF":
            return {"NaN": False, "undefined": False, "Infinity": True}.get(self.text(node))
        if k == "BIN_EXPR" and node.op in ("&&", "||"):
            left = self.truth(node.get("lhs"))
            if left is None or node.op == "&&" and not left or node.op == "||" and left:
                return left
            return self.truth(node.get("rhs"))
        if k == "COND_EXPR":
            test = self.truth(node.get("condition").get("test"))
            return None if test is None else self.truth(node.get("cons" if test else "alt"))
        return None

    def returns(self, node: Node, how: str) -> bool:
        """how: 'all' and 'implicit' ask for a return on all branches, 'value' for one with a value on any."""
        key = (node.pre, how)
        if key not in self._returns:
            self._returns[key] = self._find_return(node, how)
        return self._returns[key]

    def _find_return(self, node: Node, how: str) -> bool:
        if node.kind == "RETURN_STMT":
            return how == "implicit" or bool(node.kids)
        if node.kind == "IF_STMT":
            arms = (node.get("cons"), node.get("alt"))
            found = 0
            for a in arms:
                found += a is not None and self.returns(a, how)
            return found > 0 if how == "value" else found == 2
        inside = node.kids if node.kind == "BLOCK_STMT" else [x for c in node.all("case") for x in c.all("item")] if node.kind == "SWITCH_STMT" else []
        for k in inside:
            if self.returns(k, how):
                return True
        return False

    # Facts

    def facts(self, node: Node) -> dict[str, str]:
        k, info, toks = node.kind, {}, self.parser.toks
        if k in FUNCTIONS and (body := node.get("body")) is not None and body.kind == "BLOCK_STMT":
            for how in ("all", "implicit", "value"):
                info[f"returns_{how}"] = str(self.returns(body, how)).lower()
            info["statements"] = str(len(body.kids))
            info["body"] = self.bytes_of(body)
            info["yields"] = str(any(s.kind == "EXPR_STMT" and s.kids and s.kids[0].kind == "YIELD_EXPR" for s in body.kids)).lower()
        if k in FUNCTIONS:
            name = node.get("key") or node.get("name")
            if name is not None:
                info["name"] = self.text(name)[:TEXT_CHARS]
        elif k == "CLASS_DECL":
            self.class_facts(node, info)
        elif k == "FOR_STMT":
            self.for_facts(node, info)
        elif k in ("CALL_EXPR", "TEMPLATE", "BRACKET_EXPR"):
            first = node.get("callee") or node.get("tag") or node.get("object")
            if first is not None and first.hi < len(toks) and first.hi < node.hi:
                at = first.hi
                info["part"] = str(self.at(toks[at].start))
                info["nl"] = str(toks[at].nl and toks[at].kind in ("L_PAREN", "L_BRACK", "BACKTICK")).lower()
            if k == "CALL_EXPR":
                args = node.get("args")
                info["args"] = str(len(args.kids) if args is not None else 0)
        elif k == "BIN_EXPR" and node.op == "/":
            left = node.get("lhs")
            if left.kind == "BIN_EXPR" and left.op == "/":
                slash, last = left.get("lhs").hi, left.hi
                s, e = toks[last].end, toks[min(last + 1, len(toks) - 1)]
                if toks[slash].nl and e.start == s and re.match(r"[gimsuy]+$", self.source[e.start : e.end]):
                    info["nl"] = "true"
        elif k in ("BLOCK_STMT", "SWITCH_STMT"):
            self.spacing(node, info)
        elif k in ("BREAK_STMT", "CONTINUE_STMT", "RETURN_STMT", "THROW_STMT"):
            info["what"] = k.split("_")[0].lower()
        elif k == "IMPORT_DECL" or k in ("EXPORT_NAMED", "EXPORT_WILDCARD"):
            if (s := node.get("source")) is not None:
                info["source"] = self.text(s)[1:-1]
        if k == "LITERAL" and node.op == "regex" or k in ("CALL_EXPR", "NEW_EXPR"):
            self.regex_facts(node, info)
        return info

    def regex_facts(self, node: Node, info: dict[str, str]) -> None:
        """What is wrong with a regular expression, and what a literal may be written as. Those made by RegExp of strings count, too."""
        if node.kind == "LITERAL":
            text = self.text(node)
            close = text.rindex("/")
            pattern, flags = text[1:close], text[close + 1 :]
        else:
            callee, args = node.get("callee"), node.get("args")
            if callee is None or args is None or self.words(callee) != ["RegExp"] or not 1 <= len(args.kids) <= 2:
                return
            values = [string_value(self.text(a)) if a.kind == "LITERAL" and a.op == "string" else None for a in args.kids]
            if None in values:
                return
            pattern, flags = values[0], (values + [""])[1]
        ok, message, short = checked(pattern, flags)
        if not ok:
            info["regex_error"] = message or ""
        elif short is not None and node.kind == "LITERAL":
            info["regex_short"], info["regex"] = short, pattern

    def class_facts(self, node: Node, info: dict[str, str]) -> None:
        if (parent := node.get("extends")) is not None:
            info["extends"] = self.bytes_of(parent)
        body = node.get("body")
        ctor = next((m for m in (body.kids if body else []) if m.kind == "CONSTRUCTOR" and m.get("body") is not None), None)
        if ctor is None:
            return
        info["ctor"] = self.bytes_of(ctor)
        for s in ctor.get("body").kids:
            if s.kind == "EXPR_STMT" and s.kids and s.kids[0].kind == "SUPER_CALL":
                info.setdefault("super", self.bytes_of(s.kids[0]))
        call, early, stack = None, None, [ctor]
        while stack:
            n = stack.pop()
            if n.kind == "SUPER_CALL":
                call = n
                inside = [x for x in self.descendants(n) if x is not n and (x.kind == "THIS_EXPR" or x.kind == "NAME_REF" and self.text(x) == "super" or x.kind == "SUPER_CALL")]
                early = inside[0] if inside else early
            elif call is None and (n.kind == "THIS_EXPR" or n.kind == "NAME_REF" and self.text(n) == "super"):
                early = n
            stack.extend(reversed(n.kids))
        if call is not None and early is not None:
            info["early"] = self.bytes_of(early)
            info["early_name"] = "this" if early.kind == "THIS_EXPR" else "super"

    def descendants(self, node: Node) -> list[Node]:
        out, stack = [], [node]
        while stack:
            n = stack.pop()
            out.append(n)
            stack.extend(reversed(n.kids))
        return out

    def for_facts(self, node: Node, info: dict[str, str]) -> None:
        test, update = node.get("condition"), node.get("update")
        test = test.kids[0] if test is not None else None
        if test is None or update is None or node.get("init") is None or test.kind != "BIN_EXPR" or test.get("lhs").kind != "NAME_REF":
            return
        counter, change = self.text(test.get("lhs")), update.kids[0]
        direction: int | None = None
        if change.kind == "UNARY_EXPR" and change.op in ("++", "--") and change.get("arg").kind == "NAME_REF" and self.text(change.get("arg")) == counter:
            direction = 1 if change.op == "++" else -1
        elif change.kind == "ASSIGN_EXPR" and self.text(change.get("lhs")) == counter:
            direction = {"+=": 1, "-=": -1}.get(change.op, 0)
            by = change.get("rhs")
            if by.kind == "UNARY_EXPR" and by.op == "-":
                direction = -direction
            elif by.kind == "NAME_REF":
                direction = 0
        info["test_op"] = test.op
        if direction is not None:
            info["direction"] = str(direction)

    def spacing(self, node: Node, info: dict[str, str]) -> None:
        p, toks = self.parser, self.parser.toks
        at = node.lo
        if node.kind == "SWITCH_STMT":
            at = node.get("condition").hi
        if toks[at].kind != "L_CURLY" or toks[node.hi - 1].kind != "R_CURLY":
            return
        info["comment"] = str(self.comment_before[p.index[node.hi - 1]] > self.comment_before[p.index[at] + 1]).lower()
        after, before = p.raw[p.index[at] + 1], p.raw[p.index[node.hi - 1] - 1]
        info["open"] = str(self.at(toks[at].end))
        info["close"] = str(self.at(toks[node.hi - 1].start))
        info["open_ws"] = str(self.at(after.end if after.kind == "WHITESPACE" else toks[at].end))
        info["close_ws"] = str(self.at(before.start if before.kind == "WHITESPACE" else toks[node.hi - 1].start))
        lead = self.source[after.start : after.end] if after.kind == "WHITESPACE" else ""
        trail = self.source[before.start : before.end] if before.kind == "WHITESPACE" else ""
        info["open_nl"] = str(bool(_BREAK.search(lead))).lower()
        info["close_nl"] = str(bool(_BREAK.search(trail))).lower()

    # Rows

    def _lex(self, node: Node) -> tuple[str | None, str]:
        key = (node.lo, node.hi)
        if key not in self._lexes:  # a node and its only child have the same tokens
            words = self.words(node)
            self._lexes[key] = " ".join(words) if len(words) <= LEX_TOKENS else None, xxhash.xxh3_128_hexdigest("\0".join(words).encode("utf-8", "surrogatepass"))
        return self._lexes[key]

    def _whole(self, n: Node) -> bool:
        """Whether text and tokens are kept whatever their length: of regular expressions, what is compared with -0, and arguments of an index search."""
        up = n.parent
        if n.kind == "LITERAL" and n.op == "regex":
            return True
        if n.kind == "ARG_LIST" and up is not None and up.kind == "CALL_EXPR":
            c = up.get("callee")
            return c is not None and self.all_words[c.hi - 1] in ("indexOf", "lastIndexOf")
        return up is not None and up.kind == "BIN_EXPR" and any(k is not n and k.hi - k.lo == 2 and self.words(k) == ["-", "0"] for k in up.kids)

    def node_rows(self) -> list[dict]:
        """The nodes' own facts, in order."""
        columns = self.node_columns()
        names = list(columns)
        return [dict(zip(names, values, strict=True)) for values in zip(*columns.values(), strict=True)]

    def node_columns(self, wanted: Callable[[Node], bool] | None = None) -> dict[str, list]:
        """A list for each fact, in order of pre. Costly facts are left out of nodes that are neither wanted nor children of such."""
        self.ordered = ordered = sorted(self.descendants(self.root), key=lambda n: n.pre)
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, limit + 8 * max(n.depth for n in ordered)))
        try:
            return self._node_columns(ordered, wanted)
        finally:
            sys.setrecursionlimit(limit)

    def _node_columns(self, ordered: list[Node], wanted: Callable[[Node], bool] | None) -> dict[str, list]:
        p, before = self.parser, self.comment_before
        rows: list[tuple] = []
        last_index, last_comment = len(p.index) - 1, len(before) - 1
        for n in ordered:
            up, kids = n.parent, n.kids
            s, e = self.span(n)
            width = n.hi - n.lo
            lo, hi = p.index[min(n.lo, last_index)], p.index[min(max(n.hi - 1, n.lo), last_index)]
            name = None
            if n.kind in ("CALL_EXPR", "NEW_EXPR"):
                c = n.get("callee")
                name = " ".join(self.words(c)) if c is not None and c.hi - c.lo <= LEX_TOKENS else None
            elif (key := n.get("key")) is not None:
                name = self.text(key)[:TEXT_CHARS]
            lex = lexh = text = last = is_const = truthy = None
            inner, flags, info = n, [], None
            if mine := wanted is None or wanted(n):
                flags, info = sorted(f for f in n.flags if "@" not in f), self.facts(n)
            if mine or up is not None and wanted(up):
                whole = self._whole(n)
                if n.role in HASHED and n.kind != "BLOCK_STMT" or width <= LEX_TOKENS:
                    lex, lexh = self._lex(n)
                if whole and lex is None:
                    lex = " ".join(self.words(n))
                text = self.source[s:e] if e - s <= TEXT_CHARS or whole else None
                last = self.all_words[n.hi - 1][:TEXT_CHARS] if width > 0 else None
                inner = self.inner(n) or n
                if n.role in VALUED:
                    is_const, truthy = self.is_const(n, True), self.truth(n)
            comment = before[min(hi + 1, last_comment)] > before[lo] if width > 0 else False
            row = (n.pre, n.post, up.pre if up is not None else -1, n.depth, n.ord, n.role, n.kind, n.op or None, self.at(s), self.at(e), lo, hi, len(kids), comment, up.kind if up is not None else None,
                   up.parent.kind if up is not None and up.parent is not None else None, lex, lexh, text, name, last, inner.kind, inner.op or None, is_const, truthy, flags, info)
            rows.append(row)
        return dict(zip(NODE_FACTS, map(list, zip(*rows, strict=True)), strict=True))

    def path_of(self, n: Node) -> list[int]:
        """Ancestors (pre), the root first; of those beyond MAX_PATH, links of a chain are left out."""
        out, up = [], n.parent
        while up is not None:
            if len(out) < MAX_PATH or up.kind not in CHAINED:
                out.append(up.pre)
            up = up.parent
        out.reverse()
        return out

    def token_columns(self) -> dict[str, list]:
        """Columns of all tokens, trivia included."""
        raw, source, nl, line = self.parser.raw, self.source, [], False
        trivia = [t.kind in TRIVIA for t in raw]
        for t, skip in zip(raw, trivia, strict=True):
            nl.append(line)
            if skip:
                line = line or (t.kind == "WHITESPACE" or source.startswith("/*", t.start)) and _BREAK.search(source, t.start, t.end) is not None
            else:
                line = False
        starts, ends = [t.start for t in raw], [t.end for t in raw]
        if self.offsets is not None:
            starts, ends = self.offsets[starts].tolist(), self.offsets[ends].tolist()
        return {"tok": list(range(len(raw))), "kind": [t.kind for t in raw], "start": starts, "end": ends, "text": [source[t.start : t.end] for t in raw], "is_trivia": trivia, "nl_before": nl}

    def errors(self) -> list[tuple[str, int, int]]:
        seen, out = set(), []
        for what, s, e in self.parser.errors:
            if (what, s) not in seen:
                seen.add((what, s))
                out.append((what, self.at(s), self.at(max(s, e))))
        return out


def dump(source: str, kind: str = "module") -> str:
    """The tree as text: kind and bytes, indented by depth."""
    t = Tree(source, kind)
    return "\n".join(f"{'  ' * r['depth']}{r['kind']}@{r['start']}..{r['end']}" for r in t.node_rows())


__all__ = ["Parser", "Tree", "dump"]
