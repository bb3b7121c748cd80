"""Table functions: sources to tokens, nodes and parse errors. The only Python on the way from a source to its findings.

``files`` has file_id, kind and source. One pass parses a source once and yields all three as flat rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.lexer import tokenize
from sylva.functions.parser import Node
from sylva.functions.tree import Tree
from sylva.session import ship
from sylva.sources.files import BLOCK

PORTION = 2000  # rows of an Arrow batch
STEPS = 200_000  # entries of paths and children in one

TOKEN = "tok int, kind string, start int, end int, text string, is_trivia boolean, nl_before boolean"
STEP = "pre int, kind string, role string, ord int, op string, name string, n int, start int, end int"
KID = "pre int, role string, kind string, op string, start int, end int, lex string, lexh string, text string, last string, inner string, inner_op string, is_const boolean, truthy boolean, child_count int"
NODE = (
    "pre int, post int, parent int, depth int, ord int, role string, kind string, op string, start int, end int, tok_lo int, tok_hi int, child_count int, has_comment boolean, parent_kind string, grandparent_kind string, "
    "lex string, lexh string, text string, name string, last string, inner string, inner_op string, is_const boolean, truthy boolean, flags array<string>, info map<string,string>, "
    f"path array<struct<{STEP}>>, kids array<struct<{KID}>>"
)
ERROR = "title string, start int, end int"

_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _struct(ddl: str) -> pa.DataType:
    return pa.struct([(n, _ARROW[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])


_FACTS, _STEP, _KID = _struct(NODE.split(", path")[0]), _struct(STEP), _struct(KID)
_NODE = pa.struct([*_FACTS, pa.field("path", pa.list_(_STEP)), pa.field("kids", pa.list_(_KID))])
FILE = "path string"
LINES = "line int, starts array<int>, path string"
_LINES = pa.struct([pa.field("line", pa.int32()), pa.field("starts", pa.list_(pa.int32())), pa.field("path", pa.string())])

_TYPES = {"token": ("t", _struct(TOKEN)), "node": ("n", _NODE), "error": ("e", _struct(ERROR)), "file": ("f", _struct(FILE)), "lines": ("l", _LINES)}


@dataclass(frozen=True)
class Needs:
    """What is asked of nodes: rows of which kinds and roles, with whose path and children. Tokens: those of files with steering comments, or with a character of ``chars``."""

    kinds: frozenset[str]
    roles: frozenset[str]
    path: frozenset[str]
    kids: frozenset[str]
    regexes: bool
    steering: str
    chars: str

    def wants(self, n: Node) -> bool:
        return n.kind in self.kinds or n.role in self.roles or self.regexes and n.kind == "LITERAL" and n.op == "regex"

    def path_of(self, n: Node) -> bool:
        return n.kind in self.path or n.role in self.roles


def _batch(file_id: int | None, what: str, own: pa.StructArray) -> pa.RecordBatch:
    out = [own if w == what else pa.nulls(len(own), t) for w, (_, t) in _TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array([file_id] * len(own), pa.int64()), pa.array([what] * len(own)), *out], names=["file_id", "what", *(x for x, _ in _TYPES.values())])


def _array(columns: dict[str, list], kind: pa.DataType) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in kind], fields=list(kind))


def _lists(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


def _node_arrays(tree: Tree, needs: Needs | None, steering: bool) -> Iterator[pa.StructArray]:
    """Portions of the wanted nodes: facts are made once for each, paths and children are picked from them by number."""
    wanted = None if needs is None else (lambda n: needs.wants(n) or steering and (n.role == "item" or n.depth == 1))
    columns = tree.node_columns(wanted)
    ordered = tree.ordered
    facts = {f.name: pa.array(columns[f.name], f.type) for f in _FACTS}
    op = pa.array(["await" if "await" in n.flags else o for n, o in zip(ordered, columns["op"], strict=True)], pa.string())
    steps = pa.StructArray.from_arrays([facts["child_count"] if f.name == "n" else op if f.name == "op" else facts[f.name] for f in _STEP], fields=list(_STEP))
    kids = pa.StructArray.from_arrays([facts[f.name] for f in _KID], fields=list(_KID))
    keep = list(range(len(ordered))) if wanted is None else [i for i, n in enumerate(ordered) if wanted(n)]
    at = 0
    while at < len(keep):
        own, paths, down, room = [], [], [], STEPS
        while at < len(keep) and len(own) < PORTION and (room > 0 or not own):  # long paths make short portions
            n = ordered[keep[at]]
            own.append(keep[at])
            paths.append(tree.path_of(n) if needs is None or needs.path_of(n) else [])
            down.append([k.pre for k in n.kids] if needs is None or n.kind in needs.kids else [])
            room -= len(paths[-1]) + len(down[-1])
            at += 1
        rows = pa.array(own, pa.int32())
        path, kid = (_lists([len(x) for x in of], values.take(pa.array([i for x in of for i in x], pa.int32()))) for of, values in ((paths, steps), (down, kids)))
        yield pa.StructArray.from_arrays([*(facts[f.name].take(rows) for f in _FACTS), path, kid], fields=list(_NODE))


def _parse_rows(needs: Needs | None):
    steered, odd = (re.compile(needs.steering), re.compile(needs.chars)) if needs else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                file_id, path, kind, source = (b.column(c)[i].as_py() for c in range(4))
                source = source or ""
                lines = np.concatenate(([0], np.flatnonzero(np.frombuffer(source.encode("utf-8", "surrogatepass"), np.uint8) == 10) + 1)).tolist()
                yield _batch(file_id, "file", _array({"path": [path]}, _struct(FILE)))
                firsts = range(0, len(lines), BLOCK)
                yield _batch(file_id, "lines", _array({"line": list(firsts), "starts": [lines[n : n + BLOCK] for n in firsts], "path": [path] * len(firsts)}, _LINES))
                steering = needs is None or steered.search(source) is not None
                try:
                    tree = Tree(source, kind or "module")
                    nodes = _node_arrays(tree, needs, steering)
                    first = next(nodes, None)  # all that may nest too deeply is done with the first portion
                except RecursionError:
                    yield _batch(file_id, "error", _array({"title": ["nesting is too deep"], "start": [0], "end": [0]}, _TYPES["error"][1]))
                    continue
                if steering or odd.search(source):
                    tokens = tree.token_columns()
                    for at in range(0, len(tokens["tok"]), PORTION):
                        yield _batch(file_id, "token", _array({c: x[at : at + PORTION] for c, x in tokens.items()}, _TYPES["token"][1]))
                if first is not None:
                    for own in chain([first], nodes):
                        yield _batch(file_id, "node", own)
                if errors := tree.errors():
                    yield _batch(file_id, "error", _array(dict(zip(("title", "start", "end"), zip(*errors, strict=True), strict=True)), _TYPES["error"][1]))

    return run


def spread(files: DataFrame) -> DataFrame:
    """files over at least as many partitions as there are cores, so that a few large input partitions don't parse alone.

    What comes out of a shuffle is dealt out already, and asking it for its partitions would run it.
    """
    if "Exchange" in files._jdf.queryExecution().executedPlan().toString():
        return files
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores, "file_id") if files.rdd.getNumPartitions() < cores else files


def parsed(files: DataFrame, needs: Needs | None = None) -> DataFrame:
    """Rows of tokens, nodes, errors and of the file itself, each file parsed once: file_id, what ('token', 'node', 'error', 'file', 'lines') and t, n, e, f, l.

    Written with partitionBy("what"), tokens and nodes are pruned reads of flat columns. needs: leaves out what nobody asks for.
    """
    ship(files.sparkSession)
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string").alias("path")
    return spread(files.select("file_id", path, "kind", "source")).mapInArrow(_parse_rows(needs), f"file_id bigint, what string, t struct<{TOKEN}>, n struct<{NODE}>, e struct<{ERROR}>, f struct<{FILE}>, l struct<{LINES}>")


def paths_of(trees: DataFrame) -> DataFrame:
    """file_id, path."""
    return trees.where("what = 'file'").select("file_id", "f.*")


def lines_of(trees: DataFrame) -> DataFrame:
    """file_id, line (from 0), starts (byte offsets of that line and those after it, BLOCK at most), path."""
    return trees.where("what = 'lines'").select("file_id", "l.*")


def tokens_of(trees: DataFrame) -> DataFrame:
    return trees.where("what = 'token'").select("file_id", "t.*")


def nodes_of(trees: DataFrame) -> DataFrame:
    return trees.where("what = 'node'").select("file_id", "n.*")


def errors_of(trees: DataFrame) -> DataFrame:
    return trees.where("what = 'error'").select("file_id", "e.*")


def _lex_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file_id, source in zip(b.column(0), b.column(1), strict=True):
            text = source.as_py() or ""
            toks = tokenize(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file_id.as_py()] * len(toks), pa.int64()), pa.array(range(len(toks)), pa.int32()), pa.array([t.kind for t in toks]), pa.array([len(text[t.start : t.end].encode("utf-8", "surrogatepass")) for t in toks], pa.int32()), pa.array([text[t.start : t.end] for t in toks]), pa.array([t.error for t in toks], pa.string())],
                names=["file_id", "tok", "kind", "len", "text", "error"],
            )


def lexed(files: DataFrame) -> DataFrame:
    """Tokens by lexing alone: file_id, tok, kind, len (bytes), text, error; an offset is the running sum of lengths."""
    ship(files.sparkSession)
    return files.select("file_id", "source").mapInArrow(_lex_rows, "file_id bigint, tok int, kind string, len int, text string, error string")
