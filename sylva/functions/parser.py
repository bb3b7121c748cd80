"""A recursive-descent parser of JavaScript and TypeScript that yields a tree of typed nodes with roles.

It follows the grammar of ECMAScript 2021 with TypeScript's types and declarations. Errors are collected, never raised: a statement
that can't be parsed becomes an ERROR node up to the next place where a statement may start.
"""

from __future__ import annotations

import sys

from sylva.functions.lexer import TRIVIA, Lexer, Token

MAX_STEPS_PER_TOKEN = 400  # a guard against runaway parsing of hostile input
MAX_DEPTH = 10_000  # of statements, expressions and types in each other


class Node:
    __slots__ = ("kind", "lo", "hi", "role", "kids", "op", "flags", "parent", "pre", "post", "depth", "ord", "info")

    def __init__(self, kind: str, lo: int) -> None:
        self.kind, self.lo, self.hi, self.role = kind, lo, lo, ""
        self.kids: list[Node] = []
        self.op = ""
        self.flags: set[str] = set()
        self.info: dict = {}
        self.parent: Node | None = None

    def add(self, child: Node | None, role: str = "") -> Node | None:
        if child is not None:
            child.role = role or child.role
            child.parent = self
            self.kids.append(child)
        return child

    def get(self, role: str) -> Node | None:
        return next((k for k in self.kids if k.role == role), None)

    def all(self, role: str) -> list[Node]:
        return [k for k in self.kids if k.role == role]


class Stop(Exception):
    """The parser can't go on in this statement."""


#: Binary operators and how tightly they bind.
BINARY = {
    "QUESTION2": 1, "PIPE2": 2, "AMP2": 3, "PIPE": 4, "CARET": 5, "AMP": 6, "EQ2": 7, "EQ3": 7, "NEQ": 7, "NEQ2": 7, "L_ANGLE": 8, "R_ANGLE": 8,
    "LTEQ": 8, "GTEQ": 8, "INSTANCEOF_KW": 8, "IN_KW": 8, "SHL": 9, "SHR": 9, "USHR": 9, "PLUS": 10, "MINUS": 10, "STAR": 11, "SLASH": 11,
    "PERCENT": 11, "STAR2": 12,
}
ASSIGN = frozenset("EQ PLUSEQ MINUSEQ STAREQ SLASHEQ PERCENTEQ STAR2EQ SHLEQ SHREQ USHREQ AMPEQ PIPEEQ CARETEQ AMP2EQ PIPE2EQ QUESTION2EQ".split())
UNARY = frozenset("DELETE_KW VOID_KW TYPEOF_KW PLUS MINUS TILDE BANG PLUS2 MINUS2".split())
WORDS = frozenset("IDENT AWAIT_KW YIELD_KW IMPLEMENTS_KW INTERFACE_KW PACKAGE_KW PRIVATE_KW PROTECTED_KW PUBLIC_KW".split())
ANGLES = frozenset("SHR USHR GTEQ SHREQ USHREQ".split())  # begin with an angle that may close type arguments
RESCANNED = ANGLES | {"SLASH", "SLASHEQ", "REGEX", "ERROR_TOKEN"}
TYPE_NAMES = {"any": "TS_ANY", "unknown": "TS_UNKNOWN", "number": "TS_NUMBER", "object": "TS_OBJECT", "boolean": "TS_BOOLEAN", "bigint": "TS_BIGINT", "string": "TS_STRING", "symbol": "TS_SYMBOL", "undefined": "TS_UNDEFINED", "never": "TS_NEVER"}
STATEMENT_STARTS = frozenset("VAR_KW CONST_KW FUNCTION_KW CLASS_KW IF_KW FOR_KW WHILE_KW DO_KW SWITCH_KW RETURN_KW THROW_KW TRY_KW BREAK_KW CONTINUE_KW DEBUGGER_KW IMPORT_KW EXPORT_KW".split())
MODIFIERS = frozenset("public private protected static readonly abstract declare override async".split())


class Parser:
    def __init__(self, source: str, kind: str = "module") -> None:
        self.source, self.module, self.ts = source, kind != "script", kind == "typescript"
        self.lexer = Lexer(source)
        self.raw: list[Token] = []
        self.toks: list[Token] = []
        self.index: list[int] = []  # of toks in raw
        self.saved: dict[int, tuple] = {}
        self.ended = False
        self.i = 0
        self.errors: list[tuple[str, int, int]] = []
        self.steps = 0
        self.depth = 0
        self.fn: list[str] = [""]  # kinds of the functions around: '', 'async', 'generator', 'async generator'
        self.strict = self.module
        self.no_in = False
        self.trying = 0
        self.ambient = False

    # Tokens

    def _fill(self, n: int) -> bool:
        while not self.ended and len(self.toks) <= n:
            state = self.lexer.state()
            t = self.lexer.next()
            if t is None:
                self.ended = True
                self.toks.append(Token("EOF", len(self.source), len(self.source), self.lexer.line))
                self.index.append(len(self.raw))
                break
            if t.kind in TRIVIA or t.kind == "SHEBANG":
                self.raw.append(t)
                continue
            if t.kind in RESCANNED:
                self.saved[len(self.toks)] = (len(self.raw), state)
            self.index.append(len(self.raw))
            self.raw.append(t)
            self.toks.append(t)
        return len(self.toks) > n

    def peek(self, n: int = 0) -> Token:
        return self.toks[self.i + n] if self._fill(self.i + n) else self.toks[-1]

    @property
    def k(self) -> str:
        if self.i < len(self.toks):
            return self.toks[self.i].kind
        return self.peek().kind

    def word(self, n: int = 0) -> str:
        t = self.peek(n)
        return self.source[t.start : t.end]

    def is_word(self, text: str, n: int = 0) -> bool:
        return self.peek(n).kind == "IDENT" and self.word(n) == text

    def rescan(self, regex: bool) -> None:
        if self.i not in self.saved:
            return
        raw, state = self.saved[self.i]
        del self.raw[raw:], self.toks[self.i :], self.index[self.i :]
        for n in [n for n in self.saved if n > self.i]:
            del self.saved[n]
        self.lexer.restore(state)
        self.ended = False
        t = self.lexer.next(regex)
        self.index.append(len(self.raw))
        self.raw.append(t)
        self.toks.append(t)

    def split_angle(self) -> None:
        """The next token starts with > but goes on: only its first character closes type arguments."""
        t = self.peek()
        if t.kind in ANGLES and self.i in self.saved:
            raw, state = self.saved[self.i]
            del self.raw[raw:], self.toks[self.i :], self.index[self.i :]
            for n in [n for n in self.saved if n >= self.i]:
                del self.saved[n]
            self.lexer.restore(state)
            self.lexer.at, self.ended, self.lexer.line = t.start + 1, False, False
            self.lexer.before = "R_ANGLE"
            first = Token("R_ANGLE", t.start, t.start + 1, t.nl)
            self.index.append(len(self.raw))
            self.raw.append(first)
            self.toks.append(first)

    def bump(self) -> Token:
        self.steps += 1
        t = self.peek()
        if self.steps > MAX_STEPS_PER_TOKEN * (len(self.toks) + 100):
            raise Stop("too many steps")
        if t.kind != "EOF":
            self.i += 1
            if t.error:
                self.error(t.error, t)
        return t

    def at(self, *kinds: str) -> bool:
        return self.k in kinds

    def eat(self, kind: str) -> bool:
        if self.k == kind:
            self.bump()
            return True
        return False

    def error(self, what: str, t: Token | None = None) -> None:
        t = t or self.peek()
        self.errors.append((what, t.start, max(t.end, t.start)))

    def fail(self, what: str) -> None:
        self.error(what)
        raise Stop

    def expect(self, kind: str) -> None:
        if not self.eat(kind):
            self.fail(f"expected {kind} but found {self.k}")

    def open(self, kind: str) -> Node:
        return Node(kind, self.i)

    def close(self, node: Node) -> Node:
        node.hi = max(self.i, node.lo)
        return node

    def semicolon(self) -> None:
        if self.eat("SEMICOLON") or self.at("R_CURLY", "EOF") or self.peek().nl:
            return
        self.fail("expected a semicolon or an implicit one after a statement")

    def attempt(self, parse):
        """parse() if it succeeds without errors; else None, and nothing has happened."""
        at, errors, fn, no_in = self.i, len(self.errors), list(self.fn), self.no_in
        self.trying += 1
        try:
            out = parse()
            if out is not None and len(self.errors) == errors:
                return out
        except Stop:
            pass
        finally:
            self.trying -= 1
        self.i, self.fn, self.no_in = at, fn, no_in
        del self.errors[errors:]
        return None

    # Programs and statements

    def program(self) -> Node:
        root = Node("MODULE" if self.module else "SCRIPT", 0)
        self.peek()
        if self.k == "STRING" and self.word()[1:-1] == "use strict":
            self.strict = True
        while not self.at("EOF"):
            root.add(self.item(top=True))
        root.hi = self.i
        return root

    def item(self, top: bool = False) -> Node:
        start, errors = self.i, len(self.errors)
        depth, fn, no_in, ambient = self.depth, list(self.fn), self.no_in, self.ambient
        try:
            if self.depth > MAX_DEPTH:
                self.fail("nesting is too deep")
            self.depth += 1
            return self.statement(top)
        except Stop:
            if self.trying:
                raise
            if len(self.errors) == errors:
                self.error("can't be parsed")
            node = Node("ERROR", start)
            if self.i == start:
                self.bump()
            level = 0
            while not self.at("EOF"):
                if level <= 0 and (self.at("SEMICOLON", "R_CURLY") or self.peek().nl or self.k in STATEMENT_STARTS):
                    break
                level += self.at("L_CURLY", "L_PAREN", "L_BRACK") - self.at("R_CURLY", "R_PAREN", "R_BRACK")
                self.bump()
            self.eat("SEMICOLON")
            if top and self.at("R_CURLY"):
                self.bump()
            return self.close(node)
        finally:
            self.depth, self.fn, self.no_in, self.ambient = depth, fn, no_in, ambient

    def statement(self, top: bool = False) -> Node:
        k = self.k
        if k == "L_CURLY":
            return self.block()
        if k == "SEMICOLON":
            node = self.open("EMPTY_STMT")
            self.bump()
            return self.close(node)
        if k in ("VAR_KW", "CONST_KW") and not (k == "CONST_KW" and self.ts and self.peek(1).kind == "ENUM_KW"):
            return self.variables()
        if k == "IDENT":
            if found := self.word_statement(top):
                return found
        if k == "FUNCTION_KW":
            return self.function("FN_DECL")
        if k == "CLASS_KW":
            return self.class_("CLASS_DECL")
        if k == "AT":
            return self.decorated(top)
        method = getattr(self, "s_" + k, None)
        if method is not None and not (k == "IMPORT_KW" and self.peek(1).kind in ("L_PAREN", "DOT")):
            return method(top) if k in ("IMPORT_KW", "EXPORT_KW") else method()
        if self.ts and k in ("ENUM_KW", "INTERFACE_KW", "CONST_KW"):
            return self.ts_declaration()
        return self.expression_statement()

    def word_statement(self, top: bool) -> Node | None:
        word, after = self.word(), self.peek(1)
        if word == "let" and (after.kind in WORDS or after.kind in ("L_BRACK", "L_CURLY")):
            return self.variables()
        if word == "async" and after.kind == "FUNCTION_KW" and not after.nl:
            return self.function("FN_DECL")
        if self.ts and not after.nl:
            if word == "declare" and after.kind in ("IDENT", "VAR_KW", "CONST_KW", "FUNCTION_KW", "CLASS_KW", "ENUM_KW", "INTERFACE_KW"):
                start, was = self.i, self.ambient
                self.bump()
                self.ambient = True
                node = self.statement(top)
                self.ambient = was
                node.lo = start
                node.flags.add("declare")
                return node
            if word in ("type", "namespace", "abstract") and after.kind in WORDS | {"CLASS_KW"} or word == "module" and after.kind in WORDS | {"STRING"} or word == "global" and after.kind == "L_CURLY":
                return self.ts_declaration()
        if after.kind == "COLON":
            return self.labelled()
        return None

    def labelled(self) -> Node:
        node = self.open("LABELLED_STMT")
        node.add(self.name(), "label")
        self.expect("COLON")
        node.add(self.statement(), "body")
        return self.close(node)

    def expression_statement(self) -> Node:
        if self.k in WORDS and self.peek(1).kind == "COLON":
            return self.labelled()
        node = self.open("EXPR_STMT")
        node.add(self.expression(), "expr")
        self.semicolon()
        return self.close(node)

    def block(self, role: str = "") -> Node:
        node = self.open("BLOCK_STMT")
        self.expect("L_CURLY")
        while not self.at("R_CURLY", "EOF"):
            node.add(self.item(), "item")
        self.expect("R_CURLY")
        return self.close(node)

    def condition(self) -> Node:
        node = self.open("CONDITION")
        closed = self.eat("L_PAREN")
        if not closed:
            if self.at("L_CURLY"):
                self.fail("expected a condition")
            self.error(f"expected L_PAREN but found {self.k}")
        node.add(self.expression(), "test")
        if closed:
            self.expect("R_PAREN")
        else:
            self.eat("R_PAREN")
        return self.close(node)

    def s_IF_KW(self) -> Node:
        node = self.open("IF_STMT")
        self.bump()
        node.add(self.condition(), "condition")
        if self.at("ELSE_KW"):
            self.fail("expected a statement")
        node.add(self.statement(), "cons")
        if self.eat("ELSE_KW"):
            if self.at("EOF", "R_CURLY"):
                self.fail("expected a statement")
            node.add(self.statement(), "alt")
        return self.close(node)

    def s_WHILE_KW(self) -> Node:
        node = self.open("WHILE_STMT")
        self.bump()
        node.add(self.condition(), "condition")
        node.add(self.statement(), "body")
        return self.close(node)

    def s_DO_KW(self) -> Node:
        node = self.open("DO_WHILE_STMT")
        self.bump()
        if self.at("WHILE_KW"):
            self.fail("expected a statement")
        node.add(self.statement(), "body")
        self.expect("WHILE_KW")
        node.add(self.condition(), "condition")
        self.eat("SEMICOLON")
        return self.close(node)

    def s_WITH_KW(self) -> Node:
        node = self.open("WITH_STMT")
        if self.strict and not self.module:
            self.error("with statements are not allowed in strict mode")
        self.bump()
        node.add(self.condition(), "condition")
        node.add(self.statement(), "body")
        return self.close(node)

    def s_FOR_KW(self) -> Node:
        node = self.open("FOR_STMT")
        self.bump()
        if self.eat("AWAIT_KW"):
            node.flags.add("await")
        self.expect("L_PAREN")
        init = self.open("FOR_STMT_INIT")
        if not self.at("SEMICOLON"):
            self.no_in = True
            let = self.is_word("let") and (self.peek(1).kind in WORDS or self.peek(1).kind in ("L_BRACK", "L_CURLY"))
            if self.at("VAR_KW", "CONST_KW") or let:
                init.add(self.variables(head=True), "init")
            else:
                init.add(self.expression(), "init")
            self.no_in = False
            node.add(self.close(init), "init")
            if self.at("IN_KW") or self.is_word("of"):
                node.kind = "FOR_IN_STMT" if self.at("IN_KW") else "FOR_OF_STMT"
                self.bump()
                node.add(self.expression() if node.kind == "FOR_IN_STMT" else self.assign(), "right")
                self.expect("R_PAREN")
                node.add(self.statement(), "body")
                return self.close(node)
        self.expect("SEMICOLON")
        if not self.at("SEMICOLON"):
            test = self.open("FOR_STMT_TEST")
            test.add(self.expression(), "test")
            node.add(self.close(test), "condition")
        self.expect("SEMICOLON")
        if not self.at("R_PAREN"):
            update = self.open("FOR_STMT_UPDATE")
            update.add(self.expression(), "update")
            node.add(self.close(update), "update")
        self.expect("R_PAREN")
        node.add(self.statement(), "body")
        return self.close(node)

    def _jump(self, kind: str) -> Node:
        node = self.open(kind)
        self.bump()
        if self.k in WORDS and not self.peek().nl:
            node.add(self.name_ref(), "label")
        self.semicolon()
        return self.close(node)

    def s_BREAK_KW(self) -> Node:
        return self._jump("BREAK_STMT")

    def s_CONTINUE_KW(self) -> Node:
        return self._jump("CONTINUE_STMT")

    def s_RETURN_KW(self) -> Node:
        node = self.open("RETURN_STMT")
        if len(self.fn) == 1:
            self.error("a return outside of a function")
        self.bump()
        if not self.at("SEMICOLON", "R_CURLY", "EOF") and not self.peek().nl:
            node.add(self.expression(), "value")
        self.semicolon()
        return self.close(node)

    def s_THROW_KW(self) -> Node:
        node = self.open("THROW_STMT")
        self.bump()
        if self.peek().nl:
            self.fail("a line break after throw")
        node.add(self.expression(), "value")
        self.semicolon()
        return self.close(node)

    def s_DEBUGGER_KW(self) -> Node:
        node = self.open("DEBUGGER_STMT")
        self.bump()
        self.semicolon()
        return self.close(node)

    def s_SWITCH_KW(self) -> Node:
        node = self.open("SWITCH_STMT")
        self.bump()
        node.add(self.condition(), "condition")
        self.expect("L_CURLY")
        while not self.at("R_CURLY", "EOF"):
            clause = self.open("CASE_CLAUSE" if self.at("CASE_KW") else "DEFAULT_CLAUSE")
            if self.eat("CASE_KW"):
                clause.add(self.expression(), "test")
            else:
                self.expect("DEFAULT_KW")
            self.expect("COLON")
            while not self.at("CASE_KW", "DEFAULT_KW", "R_CURLY", "EOF"):
                clause.add(self.item(), "item")
            node.add(self.close(clause), "case")
        self.expect("R_CURLY")
        return self.close(node)

    def s_TRY_KW(self) -> Node:
        node = self.open("TRY_STMT")
        self.bump()
        node.add(self.block(), "block")
        if self.at("CATCH_KW"):
            c = self.open("CATCH_CLAUSE")
            self.bump()
            if self.eat("L_PAREN"):
                c.add(self.pattern(typed=True), "param")
                self.expect("R_PAREN")
            c.add(self.block(), "body")
            node.add(self.close(c), "handler")
        if self.at("FINALLY_KW"):
            f = self.open("FINALIZER")
            self.bump()
            f.add(self.block(), "body")
            node.add(self.close(f), "finalizer")
        if len(node.kids) == 1:
            self.error("expected catch or finally")
        return self.close(node)

    def variables(self, head: bool = False) -> Node:
        node = self.open("VAR_DECL")
        node.op = self.word()
        self.bump()
        while True:
            d = self.open("DECLARATOR")
            d.add(self.pattern(typed=False), "target")
            if self.ts and self.eat("BANG"):
                pass
            self.type_annotation(d)
            if self.eat("EQ"):
                d.add(self.assign(), "init")
            elif not self.ambient and not (head and (self.at("IN_KW") or self.is_word("of"))):
                if node.op == "const" or d.kids[0].kind != "SINGLE_PATTERN":
                    self.error("a declaration that needs an initial value")
            node.add(self.close(d), "declarator")
            if not self.eat("COMMA"):
                break
        if not head:
            self.semicolon()
        return self.close(node)

    # Names and patterns

    def name(self, any_word: bool = False) -> Node:
        node = self.open("NAME")
        t = self.peek()
        if t.kind in WORDS or any_word and t.kind.endswith("_KW"):
            self.bump()
            return self.close(node)
        return self.fail(f"expected an identifier but found {t.kind}")

    def binding(self) -> Node:
        word, t = self.word(), self.peek()
        if t.kind == "AWAIT_KW" and "async" in self.fn[-1] or t.kind == "YIELD_KW" and "generator" in self.fn[-1] or self.strict and word in ("eval", "arguments") and not self.ts:
            self.error(f"illegal use of {word} as a name")
        return self.name()

    def name_ref(self) -> Node:
        node = self.open("NAME_REF")
        if self.k not in WORDS:
            self.fail(f"expected an identifier but found {self.k}")
        self.bump()
        return self.close(node)

    def pattern(self, typed: bool) -> Node:
        if self.at("L_BRACK"):
            node = self.open("ARRAY_PATTERN")
            self.bump()
            while not self.at("R_BRACK", "EOF"):
                if self.eat("COMMA"):
                    continue
                node.add(self.rest() if self.at("DOT2") else self.element(False), "element")
                if not self.at("R_BRACK"):
                    self.expect("COMMA")
            self.expect("R_BRACK")
        elif self.at("L_CURLY"):
            node = self.open("OBJECT_PATTERN")
            self.bump()
            while not self.at("R_CURLY", "EOF"):
                if self.at("DOT2"):
                    node.add(self.rest(), "element")
                elif self.k in WORDS and self.peek(1).kind != "COLON":
                    node.add(self.element(False), "element")
                else:
                    p = self.open("KEY_VALUE_PATTERN")
                    p.add(self.key(), "key")
                    self.expect("COLON")
                    p.add(self.element(False), "value")
                    node.add(self.close(p), "element")
                if not self.at("R_CURLY"):
                    self.expect("COMMA")
            self.expect("R_CURLY")
        else:
            node = self.open("SINGLE_PATTERN")
            node.add(self.binding(), "name")
        if typed:
            if self.ts and self.at("QUESTION"):
                self.bump()
            self.type_annotation(node)
        return self.close(node)

    def rest(self, typed: bool = False) -> Node:
        node = self.open("REST_PATTERN")
        self.expect("DOT2")
        node.add(self.pattern(typed), "target")
        if self.ts and typed and self.toks[self.i - 1].kind == "QUESTION":
            self.error("an optional rest parameter")
        return self.close(node)

    def element(self, typed: bool) -> Node:
        start = self.i
        left = self.pattern(typed)
        if not self.eat("EQ"):
            return left
        node = Node("ASSIGN_PATTERN", start)
        node.add(left, "target")
        no_in, self.no_in = self.no_in, False
        node.add(self.assign(), "default")
        self.no_in = no_in
        return self.close(node)

    # Functions and classes

    def function(self, kind: str) -> Node:
        node = self.open(kind)
        how = []
        if self.is_word("async"):
            self.bump()
            how.append("async")
        self.expect("FUNCTION_KW")
        if self.eat("STAR"):
            how.append("generator")
        node.flags.update(how)
        if not self.at("L_PAREN", "L_ANGLE"):
            if kind == "FN_EXPR":
                self.fn.append(" ".join(how))
                node.add(self.binding(), "name")
                self.fn.pop()
            else:
                node.add(self.binding() if self.k in WORDS else self.name(), "name")
        elif kind == "FN_DECL" and not node.info.get("anonymous") and not getattr(self, "_default", False):
            self.error("expected a name of the function")
        self._default = False
        self.function_rest(node, " ".join(how))
        return self.close(node)

    def function_rest(self, node: Node, how: str, optional: bool = False) -> None:
        self.type_parameters(node)
        self.fn.append(how or "plain")
        no_in, self.no_in = self.no_in, False
        try:
            node.add(self.parameters(), "params")
            self.type_annotation(node, "return_type")
            if self.at("L_CURLY"):
                node.add(self.body(), "body")
            elif self.ts and (self.ambient or optional or True) and (self.at("SEMICOLON", "R_CURLY", "EOF") or self.peek().nl):
                self.eat("SEMICOLON")
                node.flags.add("overload")
            else:
                self.fail("expected a function body")
        finally:
            self.fn.pop()
            self.no_in = no_in

    def body(self) -> Node:
        strict = self.strict
        if self.peek(1).kind == "STRING" and self.word(1)[1:-1] == "use strict":
            self.strict = True
        ambient, self.ambient = self.ambient, False
        out = self.block()
        self.strict, self.ambient = strict, ambient
        return out

    def parameters(self, kind: str = "PARAMETER_LIST") -> Node:
        node = self.open(kind)
        self.expect("L_PAREN")
        while not self.at("R_PAREN", "EOF"):
            while self.at("AT"):
                node.add(self.decorator(), "decorator")
            if self.at("DOT2"):
                node.add(self.rest(typed=True), "param")
            else:
                if self.ts and self.at("THIS_KW"):
                    p = self.open("SINGLE_PATTERN")
                    self.bump()
                    self.type_annotation(p)
                    node.add(self.close(p), "param")
                else:
                    start, marked = self.i, False
                    while self.ts and (self.at("PUBLIC_KW", "PRIVATE_KW", "PROTECTED_KW") or self.is_word("readonly")) and self.peek(1).kind in WORDS:
                        self.bump()
                        marked = True
                    p = self.element(typed=True)
                    if marked:
                        outer = Node("TS_CONSTRUCTOR_PARAM", start)
                        outer.add(p, "target")
                        p = self.close(outer)
                    node.add(p, "param")
            if not self.at("R_PAREN"):
                self.expect("COMMA")
        self.expect("R_PAREN")
        return self.close(node)

    def decorator(self) -> Node:
        node = self.open("TS_DECORATOR")
        self.expect("AT")
        node.add(self.subscripts(self.primary(), self.i), "expr")
        return self.close(node)

    def decorated(self, top: bool) -> Node:
        start, found = self.i, []
        while self.at("AT"):
            found.append(self.decorator())
        node = self.statement(top)
        node.lo = start
        for d in reversed(found):
            d.parent, d.role = node, "decorator"
            node.kids.insert(0, d)
        return node

    def class_(self, kind: str) -> Node:
        node = self.open(kind)
        if self.is_word("abstract"):
            self.bump()
        self.expect("CLASS_KW")
        strict, self.strict = self.strict, True
        if self.k in WORDS and not (self.at("IMPLEMENTS_KW") and self.peek(1).kind in WORDS):
            node.add(self.binding(), "name")
        elif kind == "CLASS_DECL" and not getattr(self, "_default", False):
            self.error("expected a name of the class")
        self._default = False
        self.type_parameters(node)
        if self.eat("EXTENDS_KW"):
            if self.at("L_CURLY"):
                self.fail("expected a superclass")
            node.add(self.left_side(), "extends")
            if self.ts and self.at("L_ANGLE"):
                node.add(self.type_arguments(), "type_args")
        if self.ts and self.eat("IMPLEMENTS_KW"):
            while True:
                node.add(self.heritage(), "implements")
                if not self.eat("COMMA"):
                    break
        body = self.open("CLASS_BODY")
        self.expect("L_CURLY")
        while not self.at("R_CURLY", "EOF"):
            if self.at("SEMICOLON"):
                empty = self.open("EMPTY_STMT")
                self.bump()
                body.add(self.close(empty), "empty")
                continue
            body.add(self.member(), "member")
        self.expect("R_CURLY")
        node.add(self.close(body), "body")
        self.strict = strict
        return self.close(node)

    def _member_follows(self, n: int = 1) -> bool:
        """Whether the word before goes with what follows, as against being a name itself."""
        return self.peek(n).kind not in ("L_PAREN", "EQ", "SEMICOLON", "R_CURLY", "COLON", "COMMA", "QUESTION", "BANG", "L_ANGLE", "EOF")

    def member(self) -> Node:
        start, decorators = self.i, []
        while self.at("AT"):
            decorators.append(self.decorator())
        node = Node("METHOD", start)
        for d in decorators:
            node.add(d, "decorator")
        how = []
        while (self.k == "IDENT" or self.at("PUBLIC_KW", "PRIVATE_KW", "PROTECTED_KW")) and self.word() in MODIFIERS and self._member_follows():
            word = self.word()
            if word == "async" and self.peek(1).nl:
                break
            if word == "static" and self.peek(1).kind == "L_CURLY":
                break
            self.bump()
            if word == "async":
                how.append("async")
            node.flags.add(word)
        if self.ts and self.at("L_BRACK") and self.peek(1).kind in WORDS and self.peek(2).kind == "COLON":
            node.kind = "TS_INDEX_SIGNATURE"
            self.index_signature(node)
            self.member_end()
            return self.close(node)
        if self.is_word("static") and self.peek(1).kind == "L_CURLY":
            self.bump()
            self.fn.append("plain")
            node.add(self.block(), "body")
            self.fn.pop()
            return self.close(node)
        if self.eat("STAR"):
            how.append("generator")
        node.flags.update(how)
        if (self.is_word("get") or self.is_word("set")) and self._member_follows() and not how:
            node.kind = "GETTER" if self.word() == "get" else "SETTER"
            self.bump()
        private = self.at("HASH")
        plain = self.word() in ("constructor", "'constructor'", '"constructor"') and not node.flags & {"static"} and node.kind == "METHOD"
        key = node.add(self.key(), "key")
        if self.ts and self.at("QUESTION", "BANG"):
            self.bump()
        if self.at("L_PAREN", "L_ANGLE"):
            if plain:
                node.kind = "CONSTRUCTOR"
            self.function_rest(node, " ".join(how), optional=True)
            return self.close(node)
        if node.kind != "METHOD":
            self.fail("expected parameters")
        node.kind = "PRIVATE_PROP" if private else "CLASS_PROP"
        self.type_annotation(node)
        if self.eat("EQ"):
            self.fn.append("plain")
            node.add(self.assign(), "value")
            self.fn.pop()
        self.member_end()
        del key
        return self.close(node)

    def member_end(self) -> None:
        if not self.eat("SEMICOLON") and not self.at("R_CURLY") and not self.peek().nl:
            self.fail("expected a semicolon or a line break after a member")

    def key(self) -> Node:
        if self.at("L_BRACK"):
            node = self.open("COMPUTED_PROPERTY_NAME")
            self.bump()
            no_in, self.no_in = self.no_in, False
            node.add(self.assign(), "expr")
            self.no_in = no_in
            self.expect("R_BRACK")
            return self.close(node)
        if self.at("STRING", "NUMBER"):
            node = self.open("LITERAL")
            self.bump()
            return self.close(node)
        if self.at("HASH"):
            node = self.open("PRIVATE_NAME")
            self.bump()
            node.add(self.name(any_word=True), "name")
            return self.close(node)
        return self.name(any_word=True)

    # Expressions

    def expression(self) -> Node:
        start = self.i
        first = self.assign()
        if not self.at("COMMA"):
            return first
        node = Node("SEQUENCE_EXPR", start)
        node.add(first, "item")
        while self.eat("COMMA"):
            node.add(self.assign(), "item")
        return self.close(node)

    def assign(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("nesting is too deep")
        try:
            return self._assign()
        finally:
            self.depth -= 1

    def _assign(self) -> Node:
        start = self.i
        if self.at("YIELD_KW") and "generator" in self.fn[-1]:
            node = self.open("YIELD_EXPR")
            self.bump()
            if not self.peek().nl:
                if self.eat("STAR") or not self.at("R_PAREN", "R_BRACK", "R_CURLY", "COMMA", "SEMICOLON", "COLON", "EOF", "IN_KW"):
                    node.add(self.assign(), "value")
            return self.close(node)
        if arrow := self.arrow():
            return arrow
        left = self.conditional()
        if self.k in ASSIGN or self.k == "SLASHEQ":
            op = self.k
            if not self._target(left, op == "EQ"):
                self.error("invalid assignment target", self.toks[left.lo])
            node = Node("ASSIGN_EXPR", start)
            node.op = self.word()
            self.bump()
            node.add(left, "lhs")
            node.add(self.assign(), "rhs")
            return self.close(node)
        return left

    def _target(self, node: Node, patterns: bool) -> bool:
        if node.kind == "NAME_REF":
            return not (self.strict and not self.ts and self.source[self.toks[node.lo].start : self.toks[node.lo].end] in ("eval", "arguments"))
        if node.kind in ("DOT_EXPR", "BRACKET_EXPR", "PRIVATE_PROP_ACCESS", "ERROR"):
            return "optional" not in node.flags
        if node.kind in ("TS_NON_NULL", "TS_ASSERTION", "GROUPING_EXPR"):
            return self._target(node.get("expr"), False)
        if patterns and node.kind in ("ARRAY_EXPR", "OBJECT_EXPR"):
            return True
        return False

    def arrow(self) -> Node | None:
        k, start = self.k, self.i
        if k in WORDS:
            after = self.peek(1)
            is_async = self.is_word("async") and not after.nl
            if after.kind == "FAT_ARROW" and not after.nl:
                return self.arrow_rest(Node("ARROW_EXPR", start), "")
            if is_async and after.kind in WORDS and self.peek(2).kind == "FAT_ARROW":
                node = Node("ARROW_EXPR", start)
                self.bump()
                if self.at("AWAIT_KW"):
                    self.error("illegal use of await as a name")
                return self.arrow_rest(node, "async")
            if not (is_async and after.kind in ("L_PAREN", "L_ANGLE")):
                return None
        elif k != "L_PAREN" and not (k == "L_ANGLE" and self.ts):
            return None

        def parse() -> Node | None:
            node = Node("ARROW_EXPR", start)
            how = ""
            if self.is_word("async"):
                self.bump()
                how = "async"
            self.type_parameters(node)
            self.fn.append(how or "plain")
            node.add(self.parameters(), "params")
            if self.ts and self.at("COLON"):
                self.type_annotation(node, "return_type")
            self.fn.pop()
            if not self.at("FAT_ARROW") or self.peek().nl:
                raise Stop
            return node

        if not self._may_be_arrow():
            return None
        head = self.attempt(parse)
        if head is None:
            return None
        return self.arrow_rest(head, "async" if self.word_at(start) == "async" and self.toks[start].kind == "IDENT" else "")

    def word_at(self, i: int) -> str:
        return self.source[self.toks[i].start : self.toks[i].end]

    def _may_be_arrow(self) -> bool:
        """Looks for => (or, in TypeScript, a colon) behind the matching parenthesis."""
        n, level = 0, 0
        while True:
            k = self.peek(n).kind
            if k == "EOF":
                return False
            if k in ("L_PAREN", "L_BRACK", "L_CURLY", "DOLLARCURLY"):
                level += 1
            elif k in ("R_PAREN", "R_BRACK", "R_CURLY"):
                level -= 1
                if level == 0 and k == "R_PAREN":
                    after = self.peek(n + 1).kind
                    return after == "FAT_ARROW" or self.ts and after == "COLON"
                if level < 0:
                    return False
            n += 1

    def arrow_rest(self, node: Node, how: str) -> Node:
        if how:
            node.flags.add(how)
        if not node.get("params"):
            node.add(self.name(), "params")
        self.expect("FAT_ARROW")
        self.fn.append(how or "arrow")
        try:
            if self.at("L_CURLY"):
                no_in, self.no_in = self.no_in, False
                node.add(self.body(), "body")
                self.no_in = no_in
            else:
                node.add(self.assign(), "body")
        finally:
            self.fn.pop()
        return self.close(node)

    def conditional(self) -> Node:
        start = self.i
        test = self.binary(0)
        if not self.at("QUESTION"):
            return test
        node = Node("COND_EXPR", start)
        outer = Node("CONDITION", start)
        outer.hi = self.i
        outer.add(test, "test")
        node.add(outer, "condition")
        self.bump()
        no_in, self.no_in = self.no_in, False
        node.add(self.assign(), "cons")
        self.no_in = no_in
        self.expect("COLON")
        node.add(self.assign(), "alt")
        return self.close(node)

    def binary(self, least: int) -> Node:
        start = self.i
        left = self.unary()
        while True:
            k = self.k
            if k == "REGEX":
                self.rescan(regex=False)
                k = self.k
            if self.ts and k == "IDENT" and self.word() in ("as", "satisfies") and not self.peek().nl and least < 8:
                node = Node("TS_ASSERTION", start)
                node.add(left, "expr")
                self.bump()
                if self.eat("CONST_KW"):
                    node.kind = "TS_CONST_ASSERTION"
                else:
                    node.add(self.type_(), "type")
                left = self.close(node)
                continue
            power = BINARY.get(k, 0)
            if not power or k == "IN_KW" and self.no_in:
                return left
            if power <= least and not (k == "STAR2" and power == least):
                return left
            node = Node("BIN_EXPR", start)
            node.op = self.word()
            node.flags.add("op@%d" % self.i)
            self.bump()
            node.add(left, "lhs")
            node.add(self.binary(power - 1 if k == "STAR2" else power), "rhs")
            left = self.close(node)
            if any(c.kind == "BIN_EXPR" and "??" in (node.op, c.op) and {node.op, c.op} & {"||", "&&"} for c in node.kids):
                self.error("?? mixed with || or && without parentheses", self.toks[node.lo])

    def unary(self) -> Node:
        k = self.k
        if k in UNARY:
            node = self.open("UNARY_EXPR")
            node.op = self.word()
            self.bump()
            node.add(self.unary(), "arg")
            if k in ("PLUS2", "MINUS2") and not self._target(node.kids[0], False):
                self.error("invalid target of an update", self.toks[node.lo])
            return self.close(node)
        if k == "AWAIT_KW" and ("async" in self.fn[-1] or len(self.fn) == 1 and self.module and self._operand_follows()):
            node = self.open("AWAIT_EXPR")
            self.bump()
            node.add(self.unary(), "arg")
            return self.close(node)
        if k == "L_ANGLE" and self.ts:
            node = self.open("TS_ASSERTION")
            self.bump()
            if self.eat("CONST_KW"):
                node.kind = "TS_CONST_ASSERTION"
            else:
                node.add(self.type_(), "type")
            self.split_angle()
            self.expect("R_ANGLE")
            node.add(self.unary(), "expr")
            return self.close(node)
        start = self.i
        left = self.left_side()
        if self.at("PLUS2", "MINUS2") and not self.peek().nl:
            if not self._target(left, False):
                self.error("invalid target of an update", self.toks[left.lo])
            node = Node("UNARY_EXPR", start)
            node.op = self.word()
            node.flags.add("postfix")
            self.bump()
            node.add(left, "arg")
            return self.close(node)
        return left

    def _operand_follows(self) -> bool:
        t = self.peek(1)
        return not t.nl and t.kind in ("IDENT", "NUMBER", "STRING", "L_PAREN", "L_BRACK", "L_CURLY", "BACKTICK", "NEW_KW", "THIS_KW", "IMPORT_KW", "FUNCTION_KW", "CLASS_KW", "NULL_KW", "TRUE_KW", "FALSE_KW", "AWAIT_KW")

    def left_side(self) -> Node:
        start = self.i
        if self.at("NEW_KW"):
            return self.subscripts(self.new_(), start)
        return self.subscripts(self.primary(), start)

    def new_(self) -> Node:
        node = self.open("NEW_EXPR")
        self.bump()
        if self.at("DOT"):
            self.bump()
            if self.word() != "target":
                self.fail("expected target after new.")
            self.bump()
            node.kind = "NEW_TARGET"
            return self.close(node)
        start = self.i
        callee = self.new_() if self.at("NEW_KW") else self.primary()
        node.add(self.subscripts(callee, start, calls=False), "callee")
        if self.ts and self.at("L_ANGLE"):
            if args := self.attempt(self.type_arguments):
                node.add(args, "type_args")
        if self.at("L_PAREN"):
            node.add(self.arguments(), "args")
        return self.close(node)

    def subscripts(self, left: Node, start: int, calls: bool = True) -> Node:
        while True:
            k = self.k
            if k in ("DOT", "QUESTIONDOT"):
                optional = k == "QUESTIONDOT"
                if optional and not calls:
                    self.fail("an optional chain in a new expression")
                self.bump()
                if optional and self.at("L_PAREN"):
                    node = Node("CALL_EXPR", start)
                    node.add(left, "callee")
                    node.flags.add("optional")
                    node.add(self.arguments(), "args")
                elif optional and self.at("L_BRACK"):
                    node = self.bracket(left, start)
                    node.flags.add("optional")
                elif optional and self.at("BACKTICK"):
                    self.fail("a template in an optional chain")
                else:
                    node = Node("PRIVATE_PROP_ACCESS" if self.at("HASH") else "DOT_EXPR", start)
                    node.add(left, "object")
                    node.add(self.key() if self.at("HASH") else self.name(any_word=True), "prop")
                    if optional or "optional" in left.flags:
                        node.flags.add("optional")
                left = self.close(node)
            elif k == "L_BRACK":
                left = self.bracket(left, start)
            elif k == "L_PAREN" and calls:
                node = Node("CALL_EXPR", start)
                node.add(left, "callee")
                node.add(self.arguments(), "args")
                left = self.close(node)
            elif k == "BACKTICK":
                node = self.template()
                if "optional" in left.flags:
                    self.error("a template in an optional chain", self.toks[node.lo])
                node.lo = start
                left.role, left.parent = "tag", node
                node.kids.insert(0, left)
                left = node
            elif k == "BANG" and self.ts and not self.peek().nl:
                node = Node("TS_NON_NULL", start)
                self.bump()
                node.add(left, "expr")
                left = self.close(node)
            elif k == "L_ANGLE" and self.ts and calls and (call := self.attempt(lambda left=left: self._typed_call(left, start))):
                left = call
            else:
                return left

    def _typed_call(self, left: Node, start: int) -> Node | None:
        args = self.type_arguments()
        if self.at("BACKTICK"):
            node = self.template()
            node.lo = start
            return node
        if not self.at("L_PAREN"):
            raise Stop
        node = Node("CALL_EXPR", start)
        node.add(left, "callee")
        node.add(args, "type_args")
        node.add(self.arguments(), "args")
        return self.close(node)

    def bracket(self, left: Node, start: int) -> Node:
        node = Node("BRACKET_EXPR", start)
        node.add(left, "object")
        node.flags.add("at@%d" % self.i)
        self.expect("L_BRACK")
        no_in, self.no_in = self.no_in, False
        node.add(self.expression(), "prop")
        self.no_in = no_in
        self.expect("R_BRACK")
        if "optional" in left.flags:
            node.flags.add("optional")
        return self.close(node)

    def arguments(self) -> Node:
        node = self.open("ARG_LIST")
        self.expect("L_PAREN")
        no_in, self.no_in = self.no_in, False
        while not self.at("R_PAREN", "EOF"):
            if self.at("DOT2"):
                s = self.open("SPREAD_ELEMENT")
                self.bump()
                s.add(self.assign(), "arg")
                node.add(self.close(s), "arg")
            else:
                node.add(self.assign(), "arg")
            if not self.at("R_PAREN"):
                self.expect("COMMA")
        self.no_in = no_in
        self.expect("R_PAREN")
        return self.close(node)

    def template(self) -> Node:
        node = self.open("TEMPLATE")
        self.expect("BACKTICK")
        while not self.at("BACKTICK", "EOF"):
            if self.at("TEMPLATE_CHUNK"):
                self.bump()
            elif self.at("DOLLARCURLY"):
                e = self.open("TEMPLATE_ELEMENT")
                self.bump()
                no_in, self.no_in = self.no_in, False
                e.add(self.expression(), "expr")
                self.no_in = no_in
                self.expect("R_CURLY")
                node.add(self.close(e), "element")
            else:
                self.bump()
        self.expect("BACKTICK")
        return self.close(node)

    def primary(self) -> Node:
        k = self.k
        if k in ("SLASH", "SLASHEQ"):
            self.rescan(regex=True)
            k = self.k
        if k in ("NUMBER", "STRING", "REGEX", "TRUE_KW", "FALSE_KW", "NULL_KW"):
            node = self.open("LITERAL")
            node.op = {"NUMBER": "number", "STRING": "string", "REGEX": "regex", "NULL_KW": "null"}.get(k, "boolean")
            self.bump()
            return self.close(node)
        if k == "IDENT" and self.word() == "async" and self.peek(1).kind == "FUNCTION_KW" and not self.peek(1).nl:
            return self.function("FN_EXPR")
        if k in WORDS:
            word = self.word()
            if k == "YIELD_KW" and "generator" in self.fn[-1] or k == "AWAIT_KW" and "async" in self.fn[-1]:
                self.error(f"illegal use of {word} as a name")
            return self.name_ref()
        if k == "THIS_KW":
            node = self.open("THIS_EXPR")
            self.bump()
            return self.close(node)
        if k == "L_PAREN":
            if self._may_be_arrow() and (arrow := self.arrow()):
                return arrow
            node = self.open("GROUPING_EXPR")
            self.bump()
            no_in, self.no_in = self.no_in, False
            node.add(self.expression(), "expr")
            self.no_in = no_in
            self.expect("R_PAREN")
            return self.close(node)
        if k == "L_BRACK":
            return self.array()
        if k == "L_CURLY":
            return self.object()
        if k == "FUNCTION_KW":
            return self.function("FN_EXPR")
        if k == "CLASS_KW":
            return self.class_("CLASS_EXPR")
        if k == "AT":
            while self.at("AT"):
                self.decorator()
            return self.class_("CLASS_EXPR")
        if k == "BACKTICK":
            return self.template()
        if k == "SUPER_KW":
            if self.peek(1).kind == "L_PAREN":
                node = self.open("SUPER_CALL")
                self.bump()
                node.add(self.arguments(), "args")
                return self.close(node)
            if self.peek(1).kind not in ("DOT", "L_BRACK"):
                self.error("a lone super")
            node = self.open("NAME_REF")
            self.bump()
            return self.close(node)
        if k == "IMPORT_KW":
            node = self.open("IMPORT_CALL")
            self.bump()
            if self.eat("DOT"):
                if self.word() != "meta":
                    self.fail("expected meta after import.")
                self.bump()
                node.kind = "IMPORT_META"
                return self.close(node)
            self.expect("L_PAREN")
            if self.at("R_PAREN"):
                self.error("expected an argument of import")
            else:
                node.add(self.assign(), "arg")
            self.expect("R_PAREN")
            return self.close(node)
        return self.fail(f"expected an expression but found {k}")

    def array(self) -> Node:
        node = self.open("ARRAY_EXPR")
        self.bump()
        no_in, self.no_in = self.no_in, False
        empty = True
        while not self.at("R_BRACK", "EOF"):
            if self.at("COMMA"):
                if empty:
                    node.flags.add("hole")
                self.bump()
                empty = True
                continue
            if not empty:
                self.fail("expected a comma")
            if self.at("DOT2"):
                s = self.open("SPREAD_ELEMENT")
                self.bump()
                s.add(self.assign(), "arg")
                node.add(self.close(s), "element")
            else:
                node.add(self.assign(), "element")
            empty = False
        self.no_in = no_in
        self.expect("R_BRACK")
        return self.close(node)

    def object(self) -> Node:
        node = self.open("OBJECT_EXPR")
        self.bump()
        no_in, self.no_in = self.no_in, False
        while not self.at("R_CURLY", "EOF"):
            node.add(self.property(), "prop")
            if not self.at("R_CURLY"):
                self.expect("COMMA")
        self.no_in = no_in
        self.expect("R_CURLY")
        return self.close(node)

    def property(self) -> Node:
        node = self.open("LITERAL_PROP")
        if self.eat("DOT2"):
            node.kind = "SPREAD_PROP"
            node.add(self.assign(), "value")
            return self.close(node)
        how = []
        names = ("L_PAREN", "COLON", "COMMA", "R_CURLY", "EQ", "L_ANGLE")
        if self.is_word("async") and self.peek(1).kind not in names and not self.peek(1).nl:
            self.bump()
            how.append("async")
        if self.eat("STAR"):
            how.append("generator")
        if not how and (self.is_word("get") or self.is_word("set")) and self.peek(1).kind not in names:
            node.kind = "GETTER" if self.word() == "get" else "SETTER"
            self.bump()
        t = self.k
        key = node.add(self.key(), "key")
        if self.at("L_PAREN", "L_ANGLE"):
            if node.kind == "LITERAL_PROP":
                node.kind = "METHOD"
            node.flags.update(how)
            self.function_rest(node, " ".join(how))
            return self.close(node)
        if how or node.kind != "LITERAL_PROP":
            self.fail("expected parameters")
        if self.eat("COLON"):
            node.add(self.assign(), "value")
            return self.close(node)
        if t not in WORDS:
            self.fail("expected a colon after the name of a property")
        if self.eat("EQ"):
            node.kind = "INITIALIZED_PROP"
            node.add(self.assign(), "value")
            return self.close(node)
        node.kind = "IDENT_PROP"
        del key
        return self.close(node)

    # Modules

    def s_IMPORT_KW(self, top: bool) -> Node:
        node = self.open("IMPORT_DECL")
        if not top:
            self.error("an import that isn't at the top level")
        elif not self.module:
            self.error("an import in a script")
        self.bump()
        if self.at("STRING"):
            node.add(self.literal(), "source")
            self.semicolon()
            return self.close(node)
        if self.is_word("type") and (self.peek(1).kind in ("L_CURLY", "STAR") or self.peek(1).kind in WORDS and not (self.word(1) == "from" and self.peek(2).kind == "STRING")):
            node.flags.add("type")
            self.bump()
        if self.k in WORDS:
            node.add(self.name(), "default")
            if self.ts and self.eat("EQ"):
                node.kind = "TS_IMPORT_EQUALS_DECL"
                node.add(self.expression(), "value")
                self.semicolon()
                return self.close(node)
            if not self.eat("COMMA"):
                return self._from(node)
        if self.at("STAR"):
            w = self.open("WILDCARD_IMPORT")
            self.bump()
            if not self.is_word("as"):
                self.fail("expected as")
            self.bump()
            w.add(self.name(), "name")
            node.add(self.close(w), "import")
        else:
            node.add(self.specifiers("NAMED_IMPORTS"), "import")
        return self._from(node)

    def literal(self) -> Node:
        node = self.open("LITERAL")
        node.op = "string"
        self.expect("STRING")
        return self.close(node)

    def _from(self, node: Node) -> Node:
        if not self.is_word("from"):
            self.fail("expected from")
        self.bump()
        node.add(self.literal(), "source")
        if self.is_word("assert") and self.peek(1).kind == "L_CURLY" or self.at("WITH_KW"):
            self.bump()
            node.add(self.object(), "assertions")
        self.semicolon()
        return self.close(node)

    def specifiers(self, kind: str) -> Node:
        node = self.open(kind)
        self.expect("L_CURLY")
        while not self.at("R_CURLY", "EOF"):
            s = self.open("SPECIFIER")
            if self.is_word("type") and self.peek(1).kind not in ("COMMA", "R_CURLY") and not self.is_word("as", 1):
                self.bump()
            s.add(self.name(any_word=True) if not self.at("STRING") else self.literal(), "name")
            if self.is_word("as"):
                self.bump()
                s.add(self.name(any_word=True) if not self.at("STRING") else self.literal(), "alias")
            node.add(self.close(s), "specifier")
            if not self.at("R_CURLY"):
                self.expect("COMMA")
        self.expect("R_CURLY")
        return self.close(node)

    def s_EXPORT_KW(self, top: bool) -> Node:
        node = self.open("EXPORT_DECL")
        if not top:
            self.error("an export that isn't at the top level")
        elif not self.module:
            self.error("an export in a script")
        self.bump()
        if self.ts and self.eat("EQ"):
            node.kind = "TS_EXPORT_ASSIGNMENT"
            node.add(self.expression(), "value")
            self.semicolon()
            return self.close(node)
        if self.ts and self.is_word("as") and self.is_word("namespace", 1):
            self.bump()
            self.bump()
            node.kind = "TS_NAMESPACE_EXPORT_DECL"
            node.add(self.name(), "name")
            self.semicolon()
            return self.close(node)
        if self.eat("DEFAULT_KW"):
            self._default = True
            if self.at("FUNCTION_KW", "CLASS_KW", "AT") or self.is_word("async") and self.peek(1).kind == "FUNCTION_KW" or self.ts and (self.is_word("abstract") or self.at("INTERFACE_KW")):
                node.kind = "EXPORT_DEFAULT_DECL"
                node.add(self.statement(), "decl")
            else:
                node.kind = "EXPORT_DEFAULT_EXPR"
                node.add(self.assign(), "expr")
                self.semicolon()
            self._default = False
            return self.close(node)
        if self.is_word("type") and self.peek(1).kind in ("L_CURLY", "STAR"):
            node.flags.add("type")
            self.bump()
        if self.at("STAR"):
            node.kind = "EXPORT_WILDCARD"
            self.bump()
            if self.is_word("as"):
                self.bump()
                node.add(self.name(any_word=True), "name")
            return self._from(node)
        if self.at("L_CURLY"):
            named = self.specifiers("EXPORT_NAMED")
            node.kind, node.kids = "EXPORT_NAMED", []
            for k in named.kids:
                node.add(k, "specifier")
            if self.is_word("from"):
                return self._from(node)
            self.semicolon()
            return self.close(node)
        if self.at("IMPORT_KW"):
            node.add(self.s_IMPORT_KW(True), "decl")
        else:
            if not (self.at("VAR_KW", "CONST_KW", "FUNCTION_KW", "CLASS_KW", "ENUM_KW", "INTERFACE_KW", "AT") or self.k == "IDENT"):
                self.fail("expected a declaration to export")
            node.add(self.statement(top), "decl")
        return self.close(node)

    # TypeScript

    def need_ts(self, what: str) -> None:
        if not self.ts:
            self.error(f"{what} in a source that isn't TypeScript")

    def type_annotation(self, node: Node, role: str = "type") -> None:
        if not self.at("COLON"):
            return
        if not self.ts:
            return
        self.bump()
        node.add(self.return_type() if role == "return_type" else self.type_(), role)

    def return_type(self) -> Node:
        start = self.i
        if self.is_word("asserts") and self.peek(1).kind in WORDS | {"THIS_KW"} and not self.peek(1).nl:
            node = Node("TS_PREDICATE", start)
            self.bump()
            self.bump()
            if self.is_word("is"):
                self.bump()
                node.add(self.type_(), "type")
            return self.close(node)
        if (self.k in WORDS or self.at("THIS_KW")) and self.is_word("is", 1) and not self.peek(1).nl:
            node = Node("TS_PREDICATE", start)
            self.bump()
            self.bump()
            node.add(self.type_(), "type")
            return self.close(node)
        return self.type_()

    def type_parameters(self, node: Node) -> None:
        if not self.at("L_ANGLE") or not self.ts:
            return
        params = self.open("TS_TYPE_PARAMS")
        self.bump()
        while not self.at("R_ANGLE", "EOF"):
            p = self.open("TS_TYPE_PARAM")
            while self.at("CONST_KW", "IN_KW") or self.is_word("out") and self.peek(1).kind in WORDS:
                self.bump()
            p.add(self.name(), "name")
            if self.at("EXTENDS_KW"):
                c = self.open("TS_CONSTRAINT")
                self.bump()
                c.add(self.type_(), "type")
                p.add(self.close(c), "constraint")
            if self.at("EQ"):
                c = self.open("TS_DEFAULT")
                self.bump()
                c.add(self.type_(), "type")
                p.add(self.close(c), "default")
            params.add(self.close(p), "param")
            if not self.at("R_ANGLE"):
                self.expect("COMMA")
        self.expect("R_ANGLE")
        node.add(self.close(params), "type_params")

    def type_arguments(self) -> Node:
        node = self.open("TS_TYPE_ARGS")
        self.expect("L_ANGLE")
        while True:
            node.add(self.type_(), "arg")
            if not self.eat("COMMA"):
                break
        self.split_angle()
        self.expect("R_ANGLE")
        return self.close(node)

    def type_(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("nesting is too deep")
        try:
            return self._type()
        finally:
            self.depth -= 1

    def _type(self) -> Node:
        start = self.i
        if self.at("L_ANGLE") or self.at("L_PAREN") and self._may_be_fn_type():
            return self.fn_type("TS_FN_TYPE")
        if self.at("NEW_KW") or self.is_word("abstract") and self.peek(1).kind == "NEW_KW":
            if self.is_word("abstract"):
                self.bump()
            self.bump()
            return self.fn_type("TS_CONSTRUCTOR_TYPE", start)
        left = self.union()
        if self.at("EXTENDS_KW") and not self.peek().nl and not self.no_in_conditional:
            node = Node("TS_CONDITIONAL_TYPE", start)
            node.add(left, "check")
            self.bump()
            was, self.no_in_conditional = self.no_in_conditional, True
            node.add(self.type_(), "extends")
            self.no_in_conditional = was
            self.expect("QUESTION")
            node.add(self.type_(), "cons")
            self.expect("COLON")
            node.add(self.type_(), "alt")
            return self.close(node)
        return left

    no_in_conditional = False

    def _may_be_fn_type(self) -> bool:
        after = self.peek(1)
        if after.kind in ("R_PAREN", "DOT2"):
            return True
        n, level = 0, 0
        while True:
            k = self.peek(n).kind
            if k == "EOF":
                return False
            level += k in ("L_PAREN", "L_BRACK", "L_CURLY")
            if k in ("R_PAREN", "R_BRACK", "R_CURLY"):
                level -= 1
                if level == 0:
                    return self.peek(n + 1).kind == "FAT_ARROW"
            n += 1

    def fn_type(self, kind: str, start: int | None = None) -> Node:
        node = Node(kind, self.i if start is None else start)
        self.type_parameters(node)
        node.add(self.parameters(), "params")
        self.expect("FAT_ARROW")
        node.add(self.return_type(), "return_type")
        return self.close(node)

    def _many(self, mark: str, kind: str, parse) -> Node:
        start = self.i
        self.eat(mark)
        first = parse()
        if not self.at(mark):
            return first
        node = Node(kind, start)
        node.add(first, "type")
        while self.eat(mark):
            node.add(parse(), "type")
        return self.close(node)

    def union(self) -> Node:
        return self._many("PIPE", "TS_UNION", lambda: self._many("AMP", "TS_INTERSECTION", self.type_operator))

    def type_operator(self) -> Node:
        start = self.i
        word = self.word() if self.k == "IDENT" else ""
        if word in ("keyof", "unique", "readonly") and self.peek(1).kind not in ("COMMA", "R_ANGLE", "SEMICOLON", "EQ", "R_PAREN", "PIPE", "AMP", "R_BRACK", "EOF"):
            node = Node("TS_TYPE_OPERATOR", start)
            node.op = word
            self.bump()
            node.add(self.type_operator(), "type")
            return self.close(node)
        if word == "infer" and self.peek(1).kind in WORDS:
            node = Node("TS_INFER", start)
            self.bump()
            node.add(self.name(), "name")
            return self.close(node)
        left = self.primary_type()
        while not self.peek().nl and self.at("L_BRACK"):
            self.bump()
            node = Node("TS_ARRAY", start)
            node.add(left, "type")
            if not self.at("R_BRACK"):
                node.kind = "TS_INDEXED_ARRAY"
                node.add(self.type_(), "index")
            self.expect("R_BRACK")
            left = self.close(node)
        return left

    def primary_type(self) -> Node:
        k, node = self.k, self.open("TS_TYPE_REF")
        if k in ("STRING", "NUMBER", "TRUE_KW", "FALSE_KW"):
            self.bump()
            node.kind = "TS_LITERAL"
        elif k == "MINUS":
            self.bump()
            self.expect("NUMBER")
            node.kind = "TS_LITERAL"
        elif k in ("VOID_KW", "NULL_KW", "THIS_KW"):
            self.bump()
            node.kind = {"VOID_KW": "TS_VOID", "NULL_KW": "TS_NULL", "THIS_KW": "TS_THIS"}[k]
        elif k == "BACKTICK":
            self.bump()
            node.kind = "TS_TEMPLATE"
            while not self.at("BACKTICK", "EOF"):
                if self.at("DOLLARCURLY"):
                    e = self.open("TS_TEMPLATE_ELEMENT")
                    self.bump()
                    e.add(self.type_(), "type")
                    self.expect("R_CURLY")
                    node.add(self.close(e), "element")
                else:
                    self.bump()
            self.expect("BACKTICK")
        elif k == "TYPEOF_KW":
            self.bump()
            node.kind = "TS_TYPE_QUERY"
            node.add(self.import_type() if self.at("IMPORT_KW") else self.qualified(), "expr")
        elif k == "IMPORT_KW":
            return self.import_type()
        elif k == "L_PAREN":
            self.bump()
            node.kind = "TS_PAREN"
            was, self.no_in_conditional = self.no_in_conditional, False
            node.add(self.type_(), "type")
            self.no_in_conditional = was
            self.expect("R_PAREN")
        elif k == "L_BRACK":
            self.bump()
            node.kind = "TS_TUPLE"
            while not self.at("R_BRACK", "EOF"):
                e = self.open("TS_TUPLE_ELEMENT")
                self.eat("DOT2")
                if self.k in WORDS and (self.peek(1).kind == "COLON" or self.peek(1).kind == "QUESTION" and self.peek(2).kind == "COLON"):
                    e.add(self.name(), "name")
                    self.eat("QUESTION")
                    self.bump()
                e.add(self.type_(), "type")
                self.eat("QUESTION")
                node.add(self.close(e), "element")
                if not self.at("R_BRACK"):
                    self.expect("COMMA")
            self.expect("R_BRACK")
        elif k == "L_CURLY":
            return self.mapped() if self._is_mapped() else self.object_type()
        elif k in WORDS:
            word = self.word()
            if word in TYPE_NAMES and self.peek(1).kind != "DOT":
                self.bump()
                node.kind = TYPE_NAMES[word]
            else:
                node.add(self.qualified(), "name")
                if self.at("L_ANGLE") and not self.peek().nl:
                    node.add(self.type_arguments(), "type_args")
        else:
            self.fail(f"expected a type but found {k}")
        return self.close(node)

    def qualified(self) -> Node:
        start = self.i
        left = self.open("TS_TYPE_NAME")
        if self.at("THIS_KW"):
            self.bump()
        else:
            left.add(self.name(), "name")
        self.close(left)
        while self.at("DOT"):
            self.bump()
            node = Node("TS_QUALIFIED_PATH", start)
            node.add(left, "left")
            node.add(self.name(any_word=True), "right")
            left = self.close(node)
        return left

    def import_type(self) -> Node:
        node = self.open("TS_IMPORT")
        self.bump()
        self.expect("L_PAREN")
        node.add(self.literal(), "source")
        self.expect("R_PAREN")
        while self.eat("DOT"):
            node.add(self.name(any_word=True), "name")
        if self.at("L_ANGLE"):
            node.add(self.type_arguments(), "type_args")
        return self.close(node)

    def _is_mapped(self) -> bool:
        n = 1
        if self.peek(n).kind in ("PLUS", "MINUS"):
            return self.is_word("readonly", n + 1)
        if self.is_word("readonly", n) and self.peek(n + 1).kind == "L_BRACK":
            n += 1
        return self.peek(n).kind == "L_BRACK" and self.peek(n + 1).kind in WORDS and self.peek(n + 2).kind == "IN_KW"

    def mapped(self) -> Node:
        node = self.open("TS_MAPPED_TYPE")
        self.bump()
        if self.at("PLUS", "MINUS") or self.is_word("readonly"):
            self.eat("PLUS") or self.eat("MINUS")
            self.bump()
        self.expect("L_BRACK")
        p = self.open("TS_MAPPED_TYPE_PARAM")
        p.add(self.name(), "name")
        self.expect("IN_KW")
        p.add(self.type_(), "type")
        if self.is_word("as"):
            self.bump()
            p.add(self.type_(), "as")
        node.add(self.close(p), "param")
        self.expect("R_BRACK")
        self.eat("PLUS") or self.eat("MINUS")
        self.eat("QUESTION")
        if self.eat("COLON"):
            node.add(self.type_(), "type")
        self.eat("SEMICOLON")
        self.expect("R_CURLY")
        return self.close(node)

    def object_type(self) -> Node:
        node = self.open("TS_OBJECT_TYPE")
        self.expect("L_CURLY")
        while not self.at("R_CURLY", "EOF"):
            node.add(self.type_member(), "member")
            if not (self.eat("SEMICOLON") or self.eat("COMMA")) and not self.at("R_CURLY") and not self.peek().nl:
                self.fail("expected a separator of type members")
        self.expect("R_CURLY")
        return self.close(node)

    def index_signature(self, node: Node) -> None:
        self.expect("L_BRACK")
        node.add(self.name(), "name")
        self.expect("COLON")
        node.add(self.type_(), "index")
        self.expect("R_BRACK")
        self.type_annotation(node)

    def type_member(self) -> Node:
        node = self.open("TS_PROPERTY_SIGNATURE")
        if self.at("L_PAREN", "L_ANGLE") or self.at("NEW_KW") and self.peek(1).kind in ("L_PAREN", "L_ANGLE"):
            node.kind = "TS_CONSTRUCT_SIGNATURE_DECL" if self.eat("NEW_KW") else "TS_CALL_SIGNATURE_DECL"
            self.type_parameters(node)
            node.add(self.parameters(), "params")
            self.type_annotation(node, "return_type")
            return self.close(node)
        if self.is_word("readonly") and self._member_follows():
            self.bump()
        if self.at("L_BRACK") and self.peek(1).kind in WORDS and self.peek(2).kind == "COLON":
            node.kind = "TS_INDEX_SIGNATURE"
            self.index_signature(node)
            return self.close(node)
        if (self.is_word("get") or self.is_word("set")) and self._member_follows():
            self.bump()
        node.add(self.key(), "key")
        self.eat("QUESTION")
        if self.at("L_PAREN", "L_ANGLE"):
            node.kind = "TS_METHOD_SIGNATURE"
            self.type_parameters(node)
            node.add(self.parameters(), "params")
            self.type_annotation(node, "return_type")
        else:
            self.type_annotation(node)
        return self.close(node)

    def heritage(self) -> Node:
        node = self.open("TS_EXPR_WITH_TYPE_ARGS")
        node.add(self.qualified(), "name")
        if self.at("L_ANGLE"):
            node.add(self.type_arguments(), "type_args")
        return self.close(node)

    def ts_declaration(self) -> Node:
        start, word = self.i, self.word()
        if word == "abstract":
            return self.class_("CLASS_DECL")
        if word == "const" or word == "enum":
            node = Node("TS_ENUM", start)
            self.eat("CONST_KW")
            self.bump()
            node.add(self.name(), "name")
            self.expect("L_CURLY")
            while not self.at("R_CURLY", "EOF"):
                m = self.open("TS_ENUM_MEMBER")
                m.add(self.key(), "name")
                if self.eat("EQ"):
                    m.add(self.assign(), "value")
                node.add(self.close(m), "member")
                if not self.at("R_CURLY"):
                    self.expect("COMMA")
            self.expect("R_CURLY")
            return self.close(node)
        if word == "interface":
            node = Node("TS_INTERFACE_DECL", start)
            self.bump()
            node.add(self.name(), "name")
            self.type_parameters(node)
            if self.at("EXTENDS_KW"):
                e = self.open("TS_EXTENDS")
                self.bump()
                while True:
                    e.add(self.heritage(), "type")
                    if not self.eat("COMMA"):
                        break
                node.add(self.close(e), "extends")
            node.add(self.object_type(), "body")
            return self.close(node)
        if word == "type":
            node = Node("TS_TYPE_ALIAS_DECL", start)
            self.bump()
            node.add(self.name(), "name")
            self.type_parameters(node)
            self.expect("EQ")
            node.add(self.type_(), "type")
            self.semicolon()
            return self.close(node)
        node = Node("TS_MODULE_DECL" if word in ("module", "global") else "TS_NAMESPACE_DECL", start)
        self.bump()
        if word != "global":
            node.add(self.literal() if self.at("STRING") else self.qualified(), "name")
        if self.at("L_CURLY"):
            b = self.open("TS_MODULE_BLOCK")
            self.bump()
            while not self.at("R_CURLY", "EOF"):
                b.add(self.item(top=True), "item")
            self.expect("R_CURLY")
            node.add(self.close(b), "body")
        else:
            self.semicolon()
        return self.close(node)


def parse(source: str, kind: str = "module") -> tuple[Node, Parser]:
    """The tree of a source, numbered, and the parser with its tokens and errors. kind: 'script', 'module' or 'typescript'."""
    p = Parser(source, kind)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 40 * MAX_DEPTH))
    try:
        root = p.program()
    finally:
        sys.setrecursionlimit(limit)
    while not p.ended:
        p._fill(len(p.toks))
    count = 0
    stack: list[tuple[Node, int]] = [(root, 0)]
    root.depth, root.ord = 0, 0
    while stack:
        node, done = stack.pop()
        if not done:
            node.pre = count
            count += 1
            stack.append((node, 1))
            for n, k in enumerate(node.kids):
                k.depth, k.ord = node.depth + 1, n
            stack.extend((k, 0) for k in reversed(node.kids))
        else:
            node.post = count - 1  # the last number in the subtree
    return root, p


def parse_expression(source: str, kind: str = "module") -> tuple[Node, Parser]:
    """The tree of one expression; what follows it is an error."""
    p = Parser(source, kind)
    root = Node("ERROR", 0)
    try:
        root = p.expression()
        if not p.at("EOF"):
            p.error("more than one expression")
    except Stop:
        root = p.close(root)
    return root, p
