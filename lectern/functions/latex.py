"""LaTeX sources as trees: one pass over a text with a stack of what is open.

Every construct is a node: (node, parent, depth, kind, name, start, stop, line, col). Positions are code points, lines and columns
count from 1. Kinds: command, environment, group ({...}), option ([...] behind a command), math ($...$, \\(...\\)), display ($$...$$,
\\[...\\]), comment, escape (a backslash and a special character) and text (a run of other characters that are no white space).

What does not balance has a defined result: what is still open at the end of a text, or is cut off by the end of an environment or
group around it, ends there and is marked unclosed; an end that nothing open fits is a node of kind "stray". A brace doesn't close what
is open outside its environment, and \\) and \\] nothing outside their group. Comments and escapes open and close nothing. The stack
holds what is open only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow import slices

NODE = "node int, parent int, depth int, kind string, name string, start int, stop int, line int, col int, closed boolean"

#: What a token is, in the order in which forms are tried; all else that is no white space is text.
TOKENS = re.compile(r"(%[^\n]*|\\(?:begin|end)[ \t]*\{[^{}\n]*\}|\\[^\W\d_]+\*?|\\(?:.|\n)?|\$\$|[${}\[\]])")
ENVIRONMENT = re.compile(r"\\(begin|end)[ \t]*\{([^{}\n]*)\}")
KINDS = ["command", "environment", "group", "option", "math", "display", "comment", "escape", "text", "stray"]
COMMAND, ENV, GROUP, OPTION, MATH, DISPLAY, COMMENT, ESCAPE, TEXT, STRAY = range(10)
#: What a token does: nothing to the stack, opens or closes a node, or that depends on what is open (dollars, brackets).
LEAF, OPEN, CLOSE, DOLLAR, LEFT, RIGHT, END = range(7)
#: Bytes whose texts are parsed at a time (a longer text is alone), and tokens whose meaning is kept.
SLICE, MOST_KNOWN = 1 << 19, 100_000
#: Nodes that go to Spark at a time.
ROWS = 1 << 16


class Tokens(dict):
    """Numbers of tokens; ``rows`` has for each (what it does, kind, name, closer that it opens or is, kinds that a closer doesn't look past)."""

    def __init__(self):
        self.rows = [(LEAF, COMMENT, "", None, ()), (END, -1, "", None, ())]
        self["\n"] = 1  # what ends a text

    def __missing__(self, word: str) -> int:
        if word[0] == "%":
            return 0
        self[word] = len(self.rows)
        self.rows.append(self.meaning(word))
        return self[word]

    @staticmethod
    def meaning(word: str) -> tuple:
        if m := ENVIRONMENT.fullmatch(word):
            name = m.group(2).strip()
            return (OPEN, ENV, name, ("env", name), ()) if m.group(1) == "begin" else (CLOSE, -1, name, ("env", name), ())
        if word in ("\\(", "\\["):
            return OPEN, MATH if word == "\\(" else DISPLAY, word, ("math", word), ()
        if word in ("\\)", "\\]"):
            partner = "\\(" if word == "\\)" else "\\["
            return CLOSE, -1, partner, ("math", partner), (ENV, GROUP)
        if word in ("$", "$$"):
            return DOLLAR, MATH if word == "$" else DISPLAY, word, ("math", word), (ENV,)
        if word == "{":
            return OPEN, GROUP, "", ("brace", "}"), ()
        if word == "}":
            return CLOSE, -1, "}", ("brace", "}"), (ENV,)
        if word in "[]":
            return LEFT if word == "[" else RIGHT, TEXT, "", ("bracket", "]"), ()
        return (LEAF, ESCAPE, word, None, ()) if word[1:] and word[1] in "{}%\\#$^_&~" else (LEAF, COMMAND, word[1:], None, ())


def nested(ids: list[int], rows: list[tuple], apart: list[bool]) -> tuple[list[int], dict[int, tuple[int, bool]], list[tuple[int, int, int]]]:
    """One pass over tokens with a stack of what is open.

    Gives the kind of each token's node (-1: it has none), where those that open one end (token, whether that one closes it), and
    the stack's changes (token, what is open from there on, depth). ``apart``: something stands between a token and the one before.
    """
    kinds, ends, changes = [rows[i][1] for i in ids], {}, []
    stack: list[tuple[int, tuple]] = []
    waiting: Counter = Counter()  # how many open nodes each closer fits
    behind = -1  # the token that ends an option
    for at, number in enumerate(ids):
        does, kind, _, closer, within = rows[number]
        if does == LEAF:
            continue
        if does == OPEN or does == DOLLAR and not waiting[closer]:
            stack.append((at, closer))
            waiting[closer] += 1
        elif does == LEFT:
            # a bracket is an option only directly behind a command, an environment's begin or an option's end
            before = rows[ids[at - 1]] if at and not apart[at] else None
            if not before or not (before[:2] in ((LEAF, COMMAND), (OPEN, ENV)) or behind == at - 1):
                continue
            kinds[at] = OPTION
            stack.append((at, closer))
            waiting[closer] += 1
        elif does == RIGHT:
            if not stack or stack[-1][1] != closer:
                continue
            kinds[at], behind = -1, at
            ends[stack.pop()[0]] = at, True
            waiting[closer] -= 1
        elif does == END:
            for node, open_ in stack:
                ends[node] = at, False
            stack.clear()
            waiting.clear()
        else:  # the innermost open node that the closer fits; what is open in it ends before
            fits = -1
            for k in range(len(stack) - 1, -1, -1) if waiting[closer] else ():
                if stack[k][1] == closer:
                    fits = k
                    break
                if kinds[stack[k][0]] in within:
                    break
            if fits < 0:
                kinds[at] = STRAY
                continue
            kinds[at] = -1
            for node, open_ in stack[fits + 1 :]:
                ends[node] = at, False
                waiting[open_] -= 1
            ends[stack[fits][0]] = at, True
            waiting[closer] -= 1
            del stack[fits:]
        changes.append((at, stack[-1][0] if stack else -1, len(stack)))
    return kinds, ends, changes


def parsed_many(texts: list[str], known: Tokens, names: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The number of its text and the columns ``names`` of NODE (``code``: the place of its kind in KINDS), for each node of some texts, in the order in which nodes begin.

    Only tokens of LaTeX are walked through; runs of other characters hang on what is open between two of them.
    """
    parts: list[str] = []
    for text in texts:
        parts += TOKENS.split(text)
        parts.append("\n")  # ends the text, in a token's place
    words = parts[1::2]
    ids = list(map(known.__getitem__, words))
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    begin, end = edges[1:-1:2], edges[2::2]
    kinds_, ends, changes = nested(ids, known.rows, (begin > edges[:-1:2]).tolist())
    kinds, numbers = np.array(kinds_, np.int64), np.array(ids, np.int64)
    # what is open behind each token: it changes at few of them; in front of the first one nothing is
    where, top, depth = np.array([(-1, -1, 0), *changes], np.int64).T
    # runs of characters outside tokens, at most one text's between two tokens
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    plain = np.zeros(len(codes) + 1, np.int8)
    plain[:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    covered = np.zeros(len(codes) + 1, np.int8)
    covered[begin] += 1
    covered[end] -= 1
    np.cumsum(covered, out=covered)
    plain[covered > 0] = 0
    turn = np.flatnonzero(np.diff(plain, prepend=np.int8(0)))
    run, run_end = turn[::2], turn[1::2]
    own = np.flatnonzero(kinds >= 0)
    stop = end.copy()
    closed = np.ones(len(kinds), bool)
    if ends:
        opened, by = np.array(list(ends), np.int64), np.array([x[0] for x in ends.values()], np.int64)
        ok = np.array([x[1] for x in ends.values()], bool)
        stop[opened], closed[opened] = np.where(ok, end[by], begin[by]), ok
    starts = np.concatenate([begin[own], run])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    put = lambda mine, more: np.concatenate([mine, more])[order]
    # a token's node hangs on what is open before it, a run on what is open behind the last token
    state = np.searchsorted(where, put(own - 1, np.searchsorted(begin, run) - 1), "right") - 1
    node_of = np.full(len(kinds) + 1, -1, np.int64)
    node_of[own] = np.argsort(order, kind="stable")[: len(own)]
    border = begin[numbers == 1]
    text_of = np.searchsorted(border, starts)
    text_start = np.concatenate([[0], border[:-1] + 1])[text_of]
    first = np.searchsorted(text_of, np.arange(len(texts)))[text_of]
    parent = node_of[top[state]]
    breaks = np.concatenate([[-1], np.flatnonzero(codes == 10)])
    line = np.searchsorted(breaks, starts) - 1
    kind = put(kinds[own], np.full(len(run), TEXT))

    def named() -> pa.Array:
        used, place = np.unique(put(numbers[own], np.zeros(len(run), np.int64)), return_inverse=True)
        return pa.array([known.rows[i][2] for i in used.tolist()], pa.string()).take(pa.array(place))

    number = lambda x: pa.array(x.astype(np.int32))
    made = {
        "node": lambda: number(np.arange(len(starts)) - first), "parent": lambda: number(np.where(parent < 0, -1, parent - first)), "depth": lambda: number(depth[state]),
        "code": lambda: number(kind), "kind": lambda: pa.array(KINDS).take(pa.array(kind)), "name": named, "start": lambda: number(starts - text_start), "stop": lambda: number(put(stop[own], run_end) - text_start),
        "line": lambda: number(line - np.searchsorted(breaks, text_start) + 2), "col": lambda: number(starts - breaks[line]), "closed": lambda: pa.array(put(closed[own], np.ones(len(run), bool))),
    }
    return text_of, {c: made[c]() for c in names}


def parsed(text: str) -> list[list]:
    """The nodes of a text, in the order in which they begin."""
    _, columns = parsed_many([text], Tokens(), [x.split()[0] for x in NODE.split(", ")])
    return [list(row) for row in zip(*(c.to_pylist() for c in columns.values()), strict=True)]


def trees(sources: DataFrame, id_column: str = "id", column: str = "source", columns: list[str] | None = None) -> DataFrame:
    """(id, NODE columns, or some of them): a row for each node of each source. Null sources are empty; each text is parsed where it is
    read, so let ``dealt`` spread sources that lie in few files."""
    fields = [x for x in NODE.split(", ") if not columns or x.split()[0] in columns]
    names = [x.split()[0] for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in batches:
            for part in slices(batch, "source", SLICE):
                known = known if len(known) < MOST_KNOWN else Tokens()
                text_of, nodes = parsed_many([x or "" for x in part.column("source").to_pylist()], known, names)
                whole = pa.RecordBatch.from_arrays([part.column("id").take(pa.array(text_of)), *nodes.values()], ["id", *names])
                yield from (whole.slice(a, ROWS) for a in range(0, len(whole), ROWS))

    rows = sources.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("source"))
    return rows.mapInArrow(run, f"id long, {', '.join(fields)}")


def kind_counts(sources: DataFrame, id_column: str, column: str, kinds: dict[str, str]) -> DataFrame:
    """(id, a count for each of ``kinds``, by name): a row for each source that has nodes, counted where it is parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in batches:
            for part in slices(batch, "source", SLICE):
                known = known if len(known) < MOST_KNOWN else Tokens()
                text_of, nodes = parsed_many([x or "" for x in part.column("source").to_pylist()], known, ["code"])
                counts = np.bincount(text_of * len(KINDS) + nodes["code"].to_numpy(), minlength=len(part) * len(KINDS)).reshape(-1, len(KINDS))
                some = np.flatnonzero(counts.any(1))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(some)), *(pa.array(counts[some, KINDS.index(k)].astype(np.int64)) for k in kinds.values())], ["id", *kinds])

    rows = sources.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("source"))
    return rows.mapInArrow(run, ", ".join(["id long", *(f"{n} long" for n in kinds)]))


def arguments(nodes: DataFrame) -> DataFrame:
    """(id, node, name, n_options, n_groups): how many options and groups follow each command directly.

    An argument begins where the thing before it ends, white space aside, so children of one parent are numbered in runs.
    """
    order = Window.partitionBy("id", "parent").orderBy("node")
    is_head = F.col("kind").isin("command", "environment")
    is_arg = F.col("kind").isin("option", "group")
    head = F.last(F.when(~is_arg, F.struct("node", "kind", "name")), True).over(order)
    runs = nodes.withColumn("head", head)
    counted = runs.where(is_arg & F.col("head.kind").isin("command")).groupBy("id", F.col("head.node").alias("node")).agg(F.count_if(F.col("kind") == "option").alias("n_options"), F.count_if(F.col("kind") == "group").alias("n_groups"))
    return nodes.where(is_head).select("id", "node", "kind", "name").join(counted, ["id", "node"], "left").na.fill(0, ["n_options", "n_groups"])
