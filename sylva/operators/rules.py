"""The built-in rules as expressions over nodes.

A rule of the filter or path kind is a list of SQL expressions over one row of nodes, each a struct (start, end, title, label, fixes) or
null; all such rules are evaluated in one scan and exploded. Rules that compare rows (duplicates) use windows, and the two regular
expression rules parse each distinct pattern once. Option values are substituted into the expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.syntax import Needs

#: What a comment that steers the rules begins with.
STEERING = "sylva-"
FIXES = "array<struct<start:int,end:int,insert:string>>"
LABELS = "array<struct<start:int,end:int,text:string>>"
#: What a diagnostic says besides its own span: further spans with a text each, and notes.
MORE = (("labels", LABELS), ("notes", "array<string>"))


@dataclass
class Rule:
    name: str
    group: str
    docs: str
    recommended: bool = True
    options: dict = field(default_factory=dict)
    kinds: tuple[str, ...] = ()
    matches: Callable[[dict], list[str]] | None = None  # per-row expressions
    frame: Callable[[DataFrame, DataFrame, dict], DataFrame] | None = None  # nodes, tokens, options
    repeats: Callable[[DataFrame, dict], DataFrame] | None = None  # nodes, options: rows of which one may repeat another
    roles: tuple[str, ...] = ()  # of nodes that repeats looks at, with their paths


RULES: dict[str, Rule] = {}


def rule(name: str, group: str, docs: str, kinds: str = "", recommended: bool = True, frame: bool = False, repeats: bool = False, roles: str = "", **options):
    def register(f):
        RULES[name] = Rule(name, group, docs, recommended, options, tuple(kinds.split()), None if frame or repeats else f, f if frame else None, f if repeats else None, tuple(roles.split()))
        return f

    return register


# Building blocks of expressions


def q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(triples: str, name: str) -> str:
    """The triples as structs; their parts are set off by a single |, as || may stand in SQL."""
    parts = (re.split(r"(?<!\|)\|(?!\|)", f, maxsplit=2) for f in triples.split(";;") if f)
    return ", ".join(f"named_struct('start', cast({s} as int), 'end', cast({e} as int), '{name}', {x})" for s, e, x in parts)


def hit(when: str, title: str, start: str = "start", end: str = "end", label: str = "''", fixes: str = "", also: str = "", note: str = "") -> str:
    """A match where ``when`` holds. title, label and note are SQL; fixes: 'start|end|insert' SQL triples joined by ';;', also: further labels, 'start|end|text'.

    A label without a start and a null note are left out.
    """
    labels = f"filter(cast(array({_spans(also, 'text')}) as {LABELS}), x -> x.start is not null)" if also else f"cast(array() as {LABELS})"
    notes = f"array_compact(array(cast({note} as string)))" if note else "cast(array() as array<string>)"
    made = f"'start', cast({start} as int), 'end', cast({end} as int), 'title', {title}, 'label', {label}, 'fixes', cast(array({_spans(fixes, 'insert')}) as {FIXES}), 'labels', {labels}, 'notes', {notes}"
    return f"if({when}, named_struct({made}), null)"


def span(of: str, text: str) -> str:
    """A label of a node's span."""
    return f"{of}.start|{of}.end|{text}"


def kid(role: str, n: int = 0) -> str:
    return f"get(filter(kids, k -> k.role = {q(role)}), {n})"


def info(key: str) -> str:
    return f"info[{q(key)}]"


def at(key: str, side: int) -> str:
    """Start (0) or end (1) of a span that is kept as text."""
    return f"cast(split(info[{q(key)}], ':')[{side}] as int)"


def up(n: int) -> str:
    """The n-th ancestor, 1 for the parent."""
    return f"get(path, size(path) - {n})"


OUTER = "filter(reverse(path), p -> p.kind <> 'GROUPING_EXPR')"
COMPARISONS = "('==', '===', '!=', '!==', '<', '<=', '>', '>=')"
FUNCTIONS = "('FN_DECL', 'FN_EXPR', 'ARROW_EXPR', 'METHOD', 'GETTER', 'SETTER', 'CONSTRUCTOR')"
LOOPS = "('FOR_STMT', 'FOR_IN_STMT', 'FOR_OF_STMT', 'WHILE_STMT', 'DO_WHILE_STMT')"


# Errors


@rule("constructor-super", "errors", "The constructor of a derived class must call super; that of any other class must not.", "CLASS_DECL")
def constructor_super(o: dict) -> list[str]:
    return [
        hit(f"{info('ctor')} is not null and {info('extends')} is not null and {info('super')} is null", "'the constructor of a derived class never calls super'", at("ctor", 0), at("ctor", 1), also=f"{at('extends', 0)}|{at('extends', 1)}|'the class is derived from this'", note="'this is undefined until super has returned'"),
        hit(f"{info('extends')} is null and {info('super')} is not null", "'super is called in a class that extends nothing'", at("super", 0), at("super", 1)),
    ]


@rule("for-direction", "errors", "A for loop's counter must move towards its bound.", "FOR_STMT")
def for_direction(o: dict) -> list[str]:
    wrong = f"case when {info('test_op')} in ('<', '<=') then '-1' when {info('test_op')} in ('>', '>=') then '1' end"
    return [hit(f"{info('direction')} = {wrong}", "'the counter of this loop moves away from its bound'")]


def _descriptor(name: str, callees: str) -> str:
    """Whether a function is the property ``name`` of the object that is the third of three arguments of a define call."""
    return f"{up(1)}.kind = 'LITERAL_PROP' and {up(1)}.name = {q(name)} and {up(2)}.kind = 'OBJECT_EXPR' and {up(2)}.ord = 2 and {up(3)}.kind = 'ARG_LIST' and {up(3)}.n = 3 and {up(4)}.name in {callees}"


@rule("getter-return", "errors", "A getter must return a value on every branch.", "GETTER FN_EXPR ARROW_EXPR", allow_implicit=False)
def getter_return(o: dict) -> list[str]:
    how = info("returns_implicit" if o["allow_implicit"] else "returns_all")
    where = _descriptor("get", "('Object . defineProperty')")
    return [hit(f"{how} = 'false' and (kind = 'GETTER' or {where})", "'this getter does not always return a value'", at("body", 0), at("body", 1))]


@rule("no-setter-return", "errors", "A setter must not return a value.", "SETTER FN_EXPR ARROW_EXPR METHOD")
def no_setter_return(o: dict) -> list[str]:
    defined = _descriptor("set", "('Object . defineProperty', 'Reflect . defineProperty', 'Reflect . defineProperties', 'Object . defineProperties')")
    method = "kind = 'METHOD' and name = 'set' and " + f"{up(1)}.kind = 'OBJECT_EXPR' and {up(1)}.ord = 2 and {up(2)}.kind = 'ARG_LIST' and {up(2)}.n = 3 and {up(3)}.name in ('Object . defineProperty', 'Reflect . defineProperty', 'Reflect . defineProperties', 'Object . defineProperties')"
    nested = f"{up(1)}.kind = 'LITERAL_PROP' and {up(1)}.name = 'set' and {up(3)}.kind = 'LITERAL_PROP' and {up(4)}.kind = 'OBJECT_EXPR' and {up(4)}.ord = 1 and {up(5)}.kind = 'ARG_LIST' and {up(6)}.name in ('Object . create', 'Object . defineProperties')"
    nested_method = f"kind = 'METHOD' and name = 'set' and {up(2)}.kind = 'LITERAL_PROP' and {up(3)}.ord = 1 and {up(4)}.kind = 'ARG_LIST' and {up(5)}.name in ('Object . create', 'Object . defineProperties')"
    return [hit(f"{info('returns_value')} = 'true' and (kind = 'SETTER' or {defined} or {nested} or {method} or {nested_method})", "'this setter returns a value'", at("body", 0), at("body", 1))]


@rule("no-async-promise-executor", "errors", "The executor of a promise must not be async.", "FN_EXPR ARROW_EXPR")
def no_async_promise_executor(o: dict) -> list[str]:
    return [hit(f"array_contains(flags, 'async') and get({OUTER}, 0).kind = 'ARG_LIST' and get({OUTER}, 1).kind = 'NEW_EXPR' and get({OUTER}, 1).name = 'Promise' and {up(1)}.kind in ('ARG_LIST', 'GROUPING_EXPR') and if({up(1)}.kind = 'ARG_LIST', ord, get(filter(path, p -> p.kind = 'GROUPING_EXPR'), 0).ord) = 0", "'this promise executor is async'", note="'what it throws is lost: the promise is not rejected'")]


@rule("no-await-in-loop", "errors", "An await in a loop's body runs one at a time.", "AWAIT_EXPR")
def no_await_in_loop(o: dict) -> list[str]:
    chain = "concat(path, array(named_struct('pre', pre, 'kind', kind, 'role', role, 'ord', ord, 'op', op, 'name', name, 'n', child_count, 'start', start, 'end', end)))"
    step = (
        "(acc, p) -> named_struct('loop', p.kind in " + LOOPS + " and not (p.kind = 'FOR_OF_STMT' and coalesce(p.op, '') = 'await'), 'in', "
        "case when p.kind in ('FN_DECL', 'FN_EXPR', 'ARROW_EXPR') or (p.kind = 'FOR_OF_STMT' and p.op = 'await') then false when acc.loop and p.role = 'body' then true else acc.in end)"
    )
    return [hit(f"aggregate({chain}, named_struct('loop', false, 'in', false), {step}, acc -> acc.in)", "'this await runs anew in each round of a loop'", also=span(f"get(filter(reverse(path), p -> p.kind in {LOOPS}), 0)", "'each round of this loop waits for the one before'"), note="'collect the promises and await all of them together'")]


@rule("no-compare-neg-zero", "errors", "A comparison with -0 is true for 0, too.", "BIN_EXPR")
def no_compare_neg_zero(o: dict) -> list[str]:
    out = []
    for side, other in (("lhs", "rhs"), ("rhs", "lhs")):
        fix = f"start|end|concat('Object.is(', {kid(other)}.text, ', -0)')"
        out.append(hit(f"op in {COMPARISONS} and {kid(side)}.lex = '- 0'", "concat('a comparison with -0 by ', op)", fixes=fix))
    return out


@rule("no-cond-assign", "errors", "An assignment as a condition is mostly a mistyped comparison.", "ASSIGN_EXPR", allow_parens=True)
def no_cond_assign(o: dict) -> list[str]:
    outer = "get(filter(reverse(path), p -> not (p.kind = 'GROUPING_EXPR' or (p.kind = 'BIN_EXPR' and p.op in ('&&', '||')))), 0)"
    parens = "and parent_kind <> 'GROUPING_EXPR'" if o["allow_parens"] else ""
    return [hit(f"{outer}.kind in ('CONDITION', 'FOR_STMT_TEST') {parens}", "'an assignment stands as a condition'", f"{outer}.start", f"{outer}.end")]


@rule("no-confusing-arrow", "errors", "An arrow function with a bare conditional is easily misread.", "ARROW_EXPR", allow_parens=True)
def no_confusing_arrow(o: dict) -> list[str]:
    return [hit(f"{kid('body')}.{'kind' if o['allow_parens'] else 'inner'} = 'COND_EXPR'", "'a bare conditional after an arrow'")]


@rule("no-constant-condition", "errors", "A condition that never changes.", "CONDITION FOR_STMT_TEST")
def no_constant_condition(o: dict) -> list[str]:
    test = "get(kids, 0)"
    return [hit(f"parent_kind in ('IF_STMT', 'DO_WHILE_STMT', 'WHILE_STMT', 'COND_EXPR', 'FOR_STMT') and {test}.is_const", "'a constant condition'", f"{test}.start", f"{test}.end", f"case {test}.truthy when true then 'always true' when false then 'always false' else 'always the same' end")]


@rule("no-debugger", "errors", "Debugger statements don't belong into finished code.", "DEBUGGER_STMT")
def no_debugger(o: dict) -> list[str]:
    return [hit("true", "'a debugger statement'")]


@rule("no-empty", "errors", "Empty blocks without a comment.", "BLOCK_STMT SWITCH_STMT", disallow_empty_functions=False, allow_empty_catch=False)
def no_empty(o: dict) -> list[str]:
    extra = "" if o["disallow_empty_functions"] else f"and coalesce(parent_kind, '') not in {FUNCTIONS}"
    extra += " and parent_kind <> 'CATCH_CLAUSE'" if o["allow_empty_catch"] else ""
    return [
        hit(f"kind = 'BLOCK_STMT' and child_count = 0 and {info('comment')} = 'false' {extra}", "'an empty block'"),
        hit(f"kind = 'SWITCH_STMT' and child_count = 1 and {info('comment')} = 'false'", "'a switch without cases'"),
    ]


@rule("no-extra-boolean-cast", "errors", "A cast to a boolean where one is made anyway.", "UNARY_EXPR CALL_EXPR", enforce_for_logical_operands=False)
def no_extra_boolean_cast(o: dict) -> list[str]:
    skip = "p.kind = 'GROUPING_EXPR'" + (" or (p.kind = 'BIN_EXPR' and p.op in ('&&', '||'))" if o["enforce_for_logical_operands"] else "")
    outer = f"filter(reverse(path), p -> not ({skip}))"
    a1, a2 = f"get({outer}, 0)", f"get({outer}, 1)"
    below = f"coalesce(get(path, cast(array_position(transform(path, p -> p.pre), {a1}.pre) as int)).ord, ord)"
    explicit = f"({a1}.kind = 'ARG_LIST' and {a2}.kind in ('CALL_EXPR', 'NEW_EXPR') and {a2}.name = 'Boolean' and {below} = 0)"
    implicit = f"({a1}.kind in ('CONDITION', 'FOR_STMT_TEST') and {a2}.kind in ('IF_STMT', 'WHILE_STMT', 'DO_WHILE_STMT', 'FOR_STMT', 'COND_EXPR'))"
    context = f"({explicit} or {implicit} or ({a1}.kind = 'UNARY_EXPR' and {a1}.op = '!'))"
    return [
        hit(f"kind = 'UNARY_EXPR' and op = '!' and {kid('arg')}.inner = 'UNARY_EXPR' and {kid('arg')}.inner_op = '!' and {context}", "'a double negation that changes nothing'", end="start + 1", also=span(a1, "'a boolean is made of this anyway'")),
        hit(f"kind = 'CALL_EXPR' and name = 'Boolean' and {context}", "'a call of Boolean that changes nothing'", also=span(a1, "'a boolean is made of this anyway'")),
    ]


@rule("no-extra-semi", "errors", "A semicolon that ends nothing.", "EMPTY_STMT")
def no_extra_semi(o: dict) -> list[str]:
    return [hit(f"coalesce(parent_kind, '') not in {LOOPS[:-1]}, 'IF_STMT', 'LABELLED_STMT', 'WITH_STMT')", "'an unneeded semicolon'", fixes="start|end|''")]


@rule("no-inner-declarations", "errors", "Functions, and var variables if asked for, belong to the top of a function or program.", "FN_DECL VAR_DECL", disallowed=("functions",))
def no_inner_declarations(o: dict) -> list[str]:
    kinds = " or ".join(["kind = 'FN_DECL'"] * ("functions" in o["disallowed"]) + ["kind = 'VAR_DECL' and op = 'var' and parent_kind <> 'FOR_STMT_INIT'"] * ("variables" in o["disallowed"])) or "false"
    place = f"parent_kind in ('SCRIPT', 'MODULE', 'TS_MODULE_BLOCK') or parent_kind like 'EXPORT%' or (parent_kind = 'BLOCK_STMT' and grandparent_kind in {FUNCTIONS})"
    outer = f"get(filter(reverse(path), p -> p.kind in {FUNCTIONS}), 0)"
    return [hit(f"({kinds}) and not ({place})", f"concat('move this declaration to ', if({outer} is null, 'the root of the program', 'the body of its function'))")]


@rule("no-new-symbol", "errors", "Symbol is no constructor.", "NEW_EXPR")
def no_new_symbol(o: dict) -> list[str]:
    return [hit("name = 'Symbol'", "'Symbol can not be called with new'", fixes=f"start|{kid('callee')}.start|''")]


@rule("no-prototype-builtins", "errors", "Methods of Object.prototype may be shadowed on an object.", "CALL_EXPR")
def no_prototype_builtins(o: dict) -> list[str]:
    return [hit(f"{kid('callee')}.kind = 'DOT_EXPR' and {kid('callee')}.last in ('hasOwnProperty', 'isPrototypeOf', 'propertyIsEnumerable', 'propertyIsEnumberable')", f"concat('do not call ', {kid('callee')}.last, ' of an object itself')")]


@rule("no-sparse-arrays", "errors", "Array literals with holes.", "ARRAY_EXPR")
def no_sparse_arrays(o: dict) -> list[str]:
    return [hit("array_contains(flags, 'hole')", "'an array literal with holes'", note="'a comma without a value before it leaves a hole'")]


@rule("no-this-before-super", "errors", "this and super can't be used before super is called.", "CLASS_DECL")
def no_this_before_super(o: dict) -> list[str]:
    return [hit(f"{info('early')} is not null", f"concat({info('early_name')}, ' is used before super is called')", at("early", 0), at("early", 1), also=f"{at('super', 0)}|{at('super', 1)}|'super is called here only'")]


@rule("no-unexpected-multiline", "errors", "A line break that looks like the end of a statement but isn't.", "CALL_EXPR TEMPLATE BRACKET_EXPR BIN_EXPR")
def no_unexpected_multiline(o: dict) -> list[str]:
    what = "case kind when 'CALL_EXPR' then 'a call' when 'TEMPLATE' then 'a tagged template' when 'BRACKET_EXPR' then 'a property access' else 'a division' end"
    return [hit(f"{info('nl')} = 'true' and not array_contains(flags, 'optional') and (kind <> 'CALL_EXPR' or {info('args')} <> '0')", f"concat({what}, ' over a line break')")]


@rule("no-unsafe-finally", "errors", "Leaving a finally block drops what the try block was about to do.", "BREAK_STMT CONTINUE_STMT THROW_STMT RETURN_STMT")
def no_unsafe_finally(o: dict) -> list[str]:
    return [hit("grandparent_kind = 'FINALIZER'", f"concat('a ', {info('what')}, ' in a finally block')", also=span(up(2), "'it leaves this block, and what the try block throws or returns is dropped'"))]


@rule("no-unsafe-negation", "errors", "A negation left of in or instanceof negates only the operand.", "BIN_EXPR")
def no_unsafe_negation(o: dict) -> list[str]:
    left = kid("lhs")
    return [hit(f"op in ('in', 'instanceof') and {left}.kind = 'UNARY_EXPR' and {left}.op = '!'", "concat('the operand of ', op, ' is negated')", f"{left}.start", f"{left}.end", fixes="start + 1|start + 1|'(';;end|end|')'", also=span(kid("rhs"), "concat('what the operand is tested with by ', op, ' is not negated')"))]


@rule("require-yield", "errors", "A generator without a yield.", "FN_DECL", recommended=False)
def require_yield(o: dict) -> list[str]:
    return [hit(f"array_contains(flags, 'generator') and {info('statements')} <> '0' and {info('yields')} = 'false'", "'this generator never yields'")]


@rule("use-isnan", "errors", "Nothing equals NaN.", "BIN_EXPR SWITCH_STMT CASE_CLAUSE CALL_EXPR CONDITION", enforce_for_switch_case=True, enforce_for_index_of=False)
def use_isnan(o: dict) -> list[str]:
    out = [hit(f"kind = 'BIN_EXPR' and op in {COMPARISONS} and ({kid('lhs')}.lex = 'NaN' or {kid('rhs')}.lex = 'NaN')", "concat('a comparison with NaN by ', op)", note="'nothing equals NaN, not even NaN itself: ask Number.isNaN'")]
    if o["enforce_for_switch_case"]:
        out.append(hit("kind = 'CONDITION' and parent_kind = 'SWITCH_STMT' and get(kids, 0).lex = 'NaN'", "'a switch over NaN'", note="'no case is ever equal to NaN'"))
        out.append(hit(f"kind = 'CASE_CLAUSE' and {kid('test')}.lex = 'NaN'", "'a case of NaN'", note="'no value is ever equal to NaN'"))
    if o["enforce_for_index_of"]:
        names = "('Array . prototype . indexOf', 'Array . prototype . lastIndexOf', 'String . prototype . indexOf', 'String . prototype . lastIndexOf')"
        args = f"{kid('args')}.lex"
        whole = f"coalesce(name in {names}, false)"
        out.append(hit(f"kind = 'CALL_EXPR' and (({whole} and {args} rlike '^\\\\( [^,]* , NaN [,)]') or (not {whole} and {kid('callee')}.kind = 'DOT_EXPR' and {kid('callee')}.last in ('indexOf', 'lastIndexOf') and {args} rlike '^\\\\( NaN [,)]'))", "'an index of NaN'"))
    return out


#: What typeof yields.
TYPES = ("undefined", "object", "boolean", "number", "string", "function", "symbol", "bigint")


@rule("valid-typeof", "errors", "typeof yields one of eight names.", "BIN_EXPR", require_string_literals=False)
def valid_typeof(o: dict) -> list[str]:
    names = ", ".join(q(m + n + m) for n in TYPES for m in ("'", '"'))
    known = f"array({', '.join(map(q, TYPES))})"

    def meant(text: str) -> str:
        """The nearest of the eight names, if it is within a third of the length."""
        said = f"substring({text}, 2, length({text}) - 2)"
        near = f"array_min(transform({known}, n -> named_struct('d', levenshtein(n, {said}), 'n', n)))"
        return f"if({near}.d <= floor(greatest(length({said}), 3) / 3), concat('did you mean ', {near}.n, '?'), null)"

    out = []
    for side, other in (("lhs", "rhs"), ("rhs", "lhs")):
        typeof = f"op in {COMPARISONS} and {kid(side)}.inner = 'UNARY_EXPR' and {kid(side)}.inner_op = 'typeof'"
        out.append(hit(f"{typeof} and {kid(other)}.kind = 'LITERAL' and {kid(other)}.op = 'string' and coalesce({kid(other)}.text not in ({names}), true)", "'no type is called so'", f"{kid(other)}.start", f"{kid(other)}.end", note=meant(f"{kid(other)}.text")))
        if o["require_string_literals"]:
            out.append(hit(f"{typeof} and not ({kid(other)}.kind = 'LITERAL' and {kid(other)}.op = 'string') and not ({kid(other)}.inner = 'UNARY_EXPR' and {kid(other)}.inner_op = 'typeof')", "'a type compared with something that is no string'", f"{kid(other)}.start", f"{kid(other)}.end"))
    return out


# Style


@rule("block-spacing", "style", "Spaces inside the braces of one-line blocks.", "BLOCK_STMT SWITCH_STMT", recommended=False, style="always")
def block_spacing(o: dict) -> list[str]:
    full = "if(kind = 'SWITCH_STMT', child_count > 1, child_count > 0)"
    out = []
    for edge, near, far in (("open", "open", "open_ws"), ("close", "close_ws", "close")):
        gap = f"{info('open_ws')} <> {info('open')}" if edge == "open" else f"{info('close_ws')} <> {info('close')}"
        if o["style"] == "always":
            when, insert = f"not ({gap})", "' '"
        else:
            when, insert = gap, "''"
        side = "after the opening" if edge == "open" else "before the closing"
        out.append(hit(f"{full} and {info(edge + '_nl')} = 'false' and {when}", q(f"{'no' if o['style'] == 'always' else 'a'} space {side} brace"), fixes=f"{info(near)}|{info(far)}|{insert}"))
    return out


# Rules over several rows


def repeated(rows: DataFrame, keys: list[str], title: str) -> DataFrame:
    """All but the first of the rows with equal keys in a file, with where the first starts; a key's rows are few: those of one object, switch or file."""
    w = Window.partitionBy("file_id", *keys).orderBy("pre")
    none = F.expr(f"cast(array() as {FIXES})")
    kept = [c for c in ("rule",) if c in rows.columns]
    there = F.array(F.struct(F.col("first").cast("int").alias("start"), F.col("_end").cast("int").alias("end"), F.lit("it is here first").alias("text")))
    later = rows.withColumns({"_n": F.row_number().over(w), "first": F.first("start").over(w), "_end": F.first("end").over(w)}).where("_n > 1")
    return later.select("file_id", *kept, "pre", "start", "end", "first", F.expr(title).alias("title"), F.lit("").alias("label"), none.alias("fixes"), there.alias("labels"), F.expr("cast(array() as array<string>)").alias("notes"))


def _keyed(rows: DataFrame, key: str, title: str) -> DataFrame:
    """Rows that may repeat each other, for one window over all such rules: key and title are SQL."""
    return rows.select("file_id", "pre", "start", "end", F.expr(f"cast({key} as string)").alias("_key"), F.expr(title).alias("_title"))


@rule("no-dupe-keys", "errors", "An object literal with equal keys.", repeats=True, roles="key")
def no_dupe_keys(nodes: DataFrame, o: dict) -> DataFrame:
    keys = nodes.where("role = 'key' and grandparent_kind = 'OBJECT_EXPR' and parent_kind in ('LITERAL_PROP', 'METHOD', 'GETTER', 'SETTER', 'IDENT_PROP')")
    return _keyed(keys, f"concat_ws(' ', {up(2)}.pre, lexh)", "concat('the key ', coalesce(text, '…'), ' was there before')")


@rule("no-duplicate-cases", "errors", "A switch with equal cases.", repeats=True, roles="test")
def no_duplicate_cases(nodes: DataFrame, o: dict) -> DataFrame:
    tests = nodes.where("role = 'test' and parent_kind = 'CASE_CLAUSE'")
    return _keyed(tests, f"concat_ws(' ', {up(2)}.pre, lexh)", "concat('the case ', coalesce(text, '…'), ' was there before')")


@rule("no-duplicate-imports", "errors", "A module imported twice.", "IMPORT_DECL EXPORT_NAMED EXPORT_WILDCARD", repeats=True, include_exports=False)
def no_duplicate_imports(nodes: DataFrame, o: dict) -> DataFrame:
    kinds = "('IMPORT_DECL', 'EXPORT_NAMED', 'EXPORT_WILDCARD')" if o["include_exports"] else "('IMPORT_DECL')"
    rows = nodes.where(f"kind in {kinds} and depth = 1 and {info('source')} is not null")
    return _keyed(rows, f"concat(array_contains(flags, 'type'), ' ', {info('source')})", f"concat('the module ', {info('source')}, ' was imported before')")


#: Code points of unusual white space.
IRREGULAR = (0x0B, 0x0C, 0xA0, 0x85, 0x1680, 0x180E, 0xFEFF, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@rule("no-irregular-whitespace", "errors", "Unusual white space outside of strings.", frame=True, skip_strings=True, skip_comments=False, skip_regex=False, skip_templates=False)
def no_irregular_whitespace(nodes: DataFrame, tokens: DataFrame, o: dict) -> DataFrame:
    skipped = [k for k, on in (("STRING", o["skip_strings"]), ("COMMENT", o["skip_comments"]), ("REGEX", o["skip_regex"]), ("TEMPLATE_CHUNK", o["skip_templates"])) if on]
    chars = "".join(f"\\x{{{c:x}}}" for c in IRREGULAR)
    found = tokens.where(~F.col("kind").isin(skipped) & F.col("text").rlike(f"[{chars}]")) if skipped else tokens.where(F.col("text").rlike(f"[{chars}]"))
    # Pieces that each end in such a character: a piece ends where the lengths up to it, in bytes, add up to.
    pieces = found.select("file_id", "tok", "start", F.posexplode(F.split("text", f"(?<=[{chars}])", -1)).alias("n", "piece"))
    upto = Window.partitionBy("file_id", "tok").orderBy("n")
    runs = pieces.withColumn("end", (F.col("start") + F.sum(F.octet_length("piece")).over(upto)).cast("int")).where(F.col("piece").rlike(f"[{chars}]$"))
    last = F.expr("substring(piece, -1, 1)")
    return runs.select("file_id", F.col("tok").alias("pre"), (F.col("end") - F.octet_length(last)).alias("start"), "end", F.lit("an unusual white space character").alias("title"), F.format_string("U+%04X", F.ascii(last)).alias("label"), F.expr(f"cast(array() as {FIXES})").alias("fixes"), *[F.expr(f"cast(array() as {t})").alias(c) for c, t in MORE])


@rule("no-invalid-regexp", "regex", "A regular expression that can't be parsed.", "LITERAL CALL_EXPR NEW_EXPR")
def no_invalid_regexp(o: dict) -> list[str]:
    return [hit(f"{info('regex_error')} is not null", f"concat('an invalid regular expression: ', {info('regex_error')})")]


@rule("simplify-regex", "regex", "A regular expression that can be written shorter.", "LITERAL", recommended=False)
def simplify_regex(o: dict) -> list[str]:
    return [hit(f"{info('regex_short')} is not null", f"concat('this can be written as ', {info('regex_short')})", fixes=f"start + 1|start + 1 + octet_length({info('regex')})|{info('regex_short')}")]


# Evaluation


def options_of(r: Rule, given: dict | None) -> dict:
    """The rule's options with those given; camelCase and kebab-case names count as snake_case."""
    out = dict(r.options)
    for k, v in (given or {}).items():
        name = "".join("_" + c.lower() if c.isupper() else c for c in k).replace("-", "_")
        if name not in out:
            raise ValueError(f"{r.name} has no option {k}")
        out[name] = tuple(v) if isinstance(out[name], tuple) else v
    return out


def needs_of(selected: dict[str, dict]) -> Needs:
    """What the selected rules look at."""
    kinds, roles, path, kids, regexes = set(), set(), set(), set(), False
    for name, given in selected.items():
        r = RULES[name]
        own = set(r.kinds)
        roles.update(r.roles)
        if r.group == "regex":
            regexes, own = True, own - {"LITERAL"}
        kinds |= own
        text = " ".join(r.matches(options_of(r, given))) if r.matches is not None else ""
        path |= own if "path" in text else set()
        kids |= own if "kids" in text else set()
    return Needs(*map(frozenset, (kinds, roles, path, kids)), regexes, STEERING, f"[{''.join(map(chr, IRREGULAR))}]" if "no-irregular-whitespace" in selected else "(?!)")


COLUMNS = ["file_id", "rule", "pre", "start", "end", "title", "label", "fixes", *(c for c, _ in MORE)]


def row_findings(nodes: DataFrame, selected: dict[str, dict]) -> DataFrame | None:
    """Findings of the rules over single rows: one scan, no shuffle."""
    tests, kinds = [], set()
    for name in sorted(selected):
        if (r := RULES[name]).matches is not None:
            kinds.update(r.kinds)
            own = " or ".join(f"kind = {q(k)}" for k in r.kinds)
            tests += [f"if({own}, named_struct('rule', {q(name)}, 'm', {m}), null)" for m in r.matches(options_of(r, selected[name]))]
    if not tests:
        return None
    found = nodes.where(F.col("kind").isin(sorted(kinds))).select("file_id", "pre", F.explode(F.expr(f"filter(array({', '.join(tests)}), x -> x.m is not null)")).alias("x"))
    return found.select("file_id", F.col("x.rule").alias("rule"), "pre", "x.m.*").select(COLUMNS)


def other_findings(nodes: DataFrame, tokens: DataFrame | None, selected: dict[str, dict]) -> list[DataFrame]:
    """Findings of the rules that compare rows, by one window over the rows of all of them, and of those over tokens, if there are any."""
    rows, out = [], []
    for name in sorted(selected):
        r = RULES[name]
        if r.repeats is not None:
            rows.append(r.repeats(nodes, options_of(r, selected[name])).withColumn("rule", F.lit(name)))
        elif r.frame is not None and tokens is not None:
            out.append(r.frame(nodes, tokens, options_of(r, selected[name])).withColumn("rule", F.lit(name)).select(COLUMNS))
    if rows:
        out.append(repeated(reduce(DataFrame.unionByName, rows), ["rule", "_key"], "_title").select(COLUMNS))
    return out


def run_rules(nodes: DataFrame, tokens: DataFrame | None, selected: dict[str, dict] | None = None) -> DataFrame:
    """Findings of the selected rules (name to options; all if None): file_id, rule, pre, start, end, title, label, fixes, labels, notes."""
    selected = {n: {} for n in RULES} if selected is None else selected
    parts = [x for x in (row_findings(nodes, selected), *other_findings(nodes, tokens, selected)) if x is not None]
    return reduce(DataFrame.unionByName, parts)
