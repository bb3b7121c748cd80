"""Moving about in syntax trees, as DataFrame operations on nodes (pre and post number a subtree as an interval).

Ancestors come from the path column without a join; intervals are met by the lookups and joins of :mod:`sylva.operators.spans`, which pair no
row of a file with all others; other relations are joins by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.spans import as_of, covered, inside


def parents(nodes: DataFrame) -> DataFrame:
    """Every node but the roots with its parent's columns as parent_*."""
    up = nodes.select("file_id", F.col("pre").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("kind", "start", "end", "depth")])
    return nodes.join(up, ["file_id", "parent"])


def ancestors(nodes: DataFrame) -> DataFrame:
    """file_id, pre, distance (1: the parent), ancestor (pre), kind: from the path, nearest first."""
    return nodes.select("file_id", "pre", F.posexplode(F.reverse("path")).alias("n", "a")).select("file_id", "pre", (F.col("n") + 1).alias("distance"), F.col("a.pre").alias("ancestor"), F.col("a.kind").alias("kind"))


def nearest(kinds: tuple[str, ...]) -> Column:
    """The nearest ancestor of one of the kinds, as a struct, or null."""
    return F.get(F.filter(F.reverse("path"), lambda p: p["kind"].isin(*kinds)), 0)


def children(nodes: DataFrame) -> DataFrame:
    """file_id, pre, children: array of (ord, pre, kind, role) of every node that has some."""
    down = nodes.where("parent >= 0").groupBy("file_id", F.col("parent").alias("pre"))
    return down.agg(F.array_sort(F.collect_list(F.struct("ord", F.col("pre").alias("child"), "kind", "role"))).alias("children"))


def siblings(nodes: DataFrame) -> DataFrame:
    """nodes with prev_pre, prev_kind, next_pre, next_kind, first and last of their parent."""
    w = Window.partitionBy("file_id", "parent").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumns({f"{n}_{c}": f(c).over(w) for n, f in (("prev", F.lag), ("next", F.lead)) for c in ("pre", "kind")} | {"first_pre": F.first("pre").over(whole), "last_pre": F.last("pre").over(whole)})


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of nodes below the rows of ``of`` (file_id, pre, post), with the upper one as ``top``."""
    upper = of.select("file_id", F.col("pre").alias("top"), (F.col("pre") + 1).alias("_lo"), F.col("post").alias("_hi"))
    return inside(nodes, upper, ["file_id"], "pre").drop("_lo", "_hi")


def pruned(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """nodes without the subtrees below the rows of ``at`` (file_id, pre, post); the rows themselves stay."""
    cut = at.where("pre < post").select("file_id", (F.col("pre") + 1).alias("_lo"), F.col("post").alias("_hi"))
    return covered(nodes, cut, ["file_id"], "pre", "pre", "_cut").where("not _cut").drop("_cut")


def preorder(nodes: DataFrame) -> DataFrame:
    """file_id, step, event ('enter' or 'leave'), pre, kind: the walk of every tree."""
    events = nodes.select("file_id", "pre", "kind", "depth", F.explode(F.array(F.struct(F.lit("enter").alias("event"), F.col("pre").alias("at"), (-F.col("depth")).alias("deep")), F.struct(F.lit("leave").alias("event"), F.col("post").alias("at"), F.lit(1_000_000).alias("deep")))).alias("e"))
    order = Window.partitionBy("file_id").orderBy("e.at", F.expr("if(e.event = 'leave', 1, 0)"), F.expr("if(e.event = 'leave', -depth, depth)"))
    return events.select("file_id", (F.row_number().over(order) - 1).alias("step"), F.col("e.event").alias("event"), "pre", "kind")


def covering(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """For ranges (file_id, range_id, lo, hi), the smallest node that covers each, of equally small ones the deepest: file_id, range_id, pre, kind.

    It is the last node that starts at or before the range, or one above that. What ends where an empty range is, or lies there empty, is not above the last one, so
    the last one before it and the deepest empty node there are looked at as well.
    """
    step = lambda at: F.struct((at["end"] - at["start"]).alias("wide"), at["start"].alias("start"), at["end"].alias("end"), at["pre"].alias("pre"), at["kind"].alias("kind"))
    own = F.struct("start", "end", "pre", "kind")
    marks = nodes.select("file_id", F.col("start").alias("_at"), F.struct("pre", F.concat(F.transform("path", step), F.array(step(own))).alias("chain")).alias("_mark"))
    held = as_of(ranges.select("file_id", "range_id", "lo", "hi"), marks, ["file_id"], "lo", "_a")
    held = as_of(held, marks, ["file_id"], "lo", "_b", strictly=True)
    empty = nodes.where("start = end").groupBy("file_id", F.col("start").alias("lo")).agg(F.max_by(F.array(step(own)), F.struct("depth", "pre")).alias("_c"))
    held = held.join(empty, ["file_id", "lo"], "left")
    none = F.array().cast(held.schema["_c"].dataType)
    chains = F.flatten(F.transform(F.array(F.coalesce("_a.chain", none), F.coalesce("_b.chain", none), F.coalesce("_c", none)), lambda c: F.filter(c, lambda x: (x["start"] <= F.col("lo")) & (x["end"] >= F.col("hi")))))
    best = held.withColumn("_best", F.array_min(F.transform(chains, lambda x: F.struct(x["wide"].alias("wide"), (-x["pre"]).alias("pre"), x["kind"].alias("kind")))))
    return best.where("_best is not null").select("file_id", "range_id", (-F.col("_best.pre")).alias("pre"), "_best.kind")


def tokens_at(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """For offsets (file_id, offset), the tokens that hold or touch each: the last that starts before it, and those that start there."""
    marks = tokens.select("file_id", F.col("start").alias("_at"), F.struct(*[c for c in tokens.columns if c != "file_id"]).alias("_mark"))
    before = as_of(offsets, marks, ["file_id"], "offset", "_t", strictly=True).where("_t.end >= offset").select("file_id", "_t.*", *[c for c in offsets.columns if c != "file_id"])
    there = tokens.withColumn("offset", F.col("start")).join(offsets, ["file_id", "offset"])
    return before.unionByName(there.select(before.columns))


def tokens_in(tokens: DataFrame, of: DataFrame, trivia: bool = True) -> DataFrame:
    """Tokens of the rows of ``of`` (file_id, pre, tok_lo, tok_hi), with pre; without trivia if asked for."""
    rows = tokens if trivia else tokens.where("not is_trivia")
    return inside(rows, of.select("file_id", "pre", "tok_lo", "tok_hi"), ["file_id"], "tok", "tok_lo", "tok_hi").drop("tok_lo", "tok_hi")


def lossy(tokens: DataFrame) -> DataFrame:
    return tokens.where("not is_trivia")


def neighbours(tokens: DataFrame) -> DataFrame:
    """tokens with the kinds and texts of the tokens before and after."""
    w = Window.partitionBy("file_id").orderBy("tok")
    return tokens.withColumns({f"{n}_{c}": f(c).over(w) for n, f in (("prev", F.lag), ("next", F.lead)) for c in ("kind", "text")})


def lexically_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of nodes of one file with equal tokens, trivia aside: file_id, a_pre, b_pre."""
    left, right = (d.where("lexh is not null").select("file_id", "lexh", F.col("pre").alias(f"{n}_pre")) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, ["file_id", "lexh"]).where("a_pre <> b_pre").drop("lexh")


def tokens_equal(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose tokens are those of a pattern, given with blanks between."""
    return nodes.where(F.col("lex") == pattern)


def child_with_kind(kind: str) -> Column:
    return F.get(F.filter("kids", lambda k: k["kind"] == kind), 0)


def comments(tokens: DataFrame) -> DataFrame:
    """file_id, tok, kind ('line', 'doc' or 'block'), content."""
    kind = F.when(F.col("text").startswith("//"), "line").when(F.col("text").rlike(r"^/\*\*(?!/)"), "doc").otherwise("block")
    content = F.regexp_replace("text", r"(?s)^(//|/\*\*?(?=[^/]|$))|\*/$", "")
    return tokens.where("kind = 'COMMENT'").select("file_id", "tok", kind.alias("kind"), content.alias("content"))


def siblings_towards(nodes: DataFrame, of: DataFrame, forward: bool = True) -> DataFrame:
    """The siblings after (or before) each row of ``of`` (file_id, pre, parent, ord): file_id, pre, distance, sibling, kind."""
    mine = of.select("file_id", "parent", F.col("pre").alias("_of"), F.col("ord").alias("_ord"))
    distance = F.col("ord") - F.col("_ord") if forward else F.col("_ord") - F.col("ord")
    beside = nodes.where("parent >= 0").join(mine, ["file_id", "parent"]).withColumn("distance", distance).where("distance > 0")
    return beside.select("file_id", F.col("_of").alias("pre"), "distance", F.col("pre").alias("sibling"), "kind")


def is_loop(kind: Column) -> Column:
    return kind.isin("FOR_STMT", "FOR_IN_STMT", "FOR_OF_STMT", "WHILE_STMT", "DO_WHILE_STMT")


def readable_name(kind: Column) -> Column:
    """The kind of a node in words."""
    spelt = F.lower(F.regexp_replace(F.regexp_replace(kind, "_", " "), r"\bFN\b", "FUNCTION"))
    for short, long in (("stmt", "statement"), ("expr", "expression"), ("decl", "declaration"), ("prop", "property")):
        spelt = F.regexp_replace(spelt, rf"\b{short}\b", long)
    return spelt


def running_positions(lexed: DataFrame) -> DataFrame:
    """Tokens by lexing alone (file_id, tok, len) with start and end: running sums of their lengths."""
    upto = Window.partitionBy("file_id").orderBy("tok")
    return lexed.withColumn("end", F.sum(F.col("len").cast("long")).over(upto)).withColumn("start", F.col("end") - F.col("len"))


def with_trivia(tokens: DataFrame) -> DataFrame:
    """Tokens that are no trivia with ``leading`` and ``trailing``, the trivia (tok, kind, text) on either side up to the next such token."""
    before = Window.partitionBy("file_id").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.withColumn("_n", F.coalesce(F.count_if(~F.col("is_trivia")).over(before), F.lit(0)))
    held = F.struct("tok", "kind", "text")
    # trivia numbered n stand before the n-th token that is none (from 0), and after the one before it
    gaps = numbered.where("is_trivia").groupBy("file_id", "_n").agg(F.array_sort(F.collect_list(held)).alias("_t"))
    none = F.expr("cast(array() as array<struct<tok:int,kind:string,text:string>>)")
    firm = numbered.where("not is_trivia")
    lead = gaps.select("file_id", "_n", F.col("_t").alias("leading"))
    trail = gaps.select("file_id", (F.col("_n") - 1).alias("_n"), F.col("_t").alias("trailing"))
    joined = firm.join(lead, ["file_id", "_n"], "left").join(trail, ["file_id", "_n"], "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("leading", "trailing")}).drop("_n")


def reach(rows: DataFrame, keys: list[str], order: list[str], holds: Column) -> DataFrame:
    """rows with ``back`` and ``ahead``: how many rows directly before and after each one ``holds`` is true of, up to the first where it fails.

    A row's number and that of the last failure before it, or of the first after it, are all it takes: a window each way, no array of neighbours.
    """
    way = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumns({"_n": F.row_number().over(way), "_fails": ~F.coalesce(holds, F.lit(False))})
    failed = F.when(F.col("_fails"), F.col("_n"))
    before = F.max(failed).over(way.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(failed).over(way.rowsBetween(1, Window.unboundedFollowing))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return numbered.withColumns({"back": F.col("_n") - 1 - F.coalesce(before, F.lit(0)), "ahead": (F.coalesce(after, total + 1) - F.col("_n") - 1)}).drop("_n", "_fails")


def trivia_around(tokens: DataFrame) -> DataFrame:
    """Tokens with ``back`` and ``ahead``: how many pieces of white space and comments lie directly before and after each."""
    return reach(tokens, ["file_id"], ["tok"], F.col("is_trivia"))


def until_comment(trivia: str, nearest_first: bool) -> Column:
    """The trivia of an array up to the first comment, seen from the token."""
    seen = F.reverse(trivia) if nearest_first else F.col(trivia)
    at = F.expr(f"array_position(transform({'reverse(' + trivia + ')' if nearest_first else trivia}, t -> t.kind), 'COMMENT')")
    return F.when(at == 0, seen).otherwise(F.slice(seen, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))))


def assigned_values(nodes: DataFrame) -> DataFrame:
    """file_id, pre, value: the text that an assignment evaluates to, a compound one written out; null where a side's text isn't kept."""
    side = lambda role: F.expr(f"get(filter(kids, k -> k.role = '{role}'), 0).text")
    value = F.when(F.col("op") == "=", side("rhs")).otherwise(F.concat_ws(" ", side("lhs"), F.expr("substring(op, 1, length(op) - 1)"), side("rhs")))
    return nodes.where("kind = 'ASSIGN_EXPR'").select("file_id", "pre", F.when(side("lhs").isNotNull() & side("rhs").isNotNull(), value).alias("value"))
