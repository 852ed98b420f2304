"""What an equation is made of: variables, functions, operators and structures of its LaTeX, and scores of them.

Everything is a column expression over one text; null is an equation without anything in it. Lists are distinct and in order of
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Names of functions, operators as characters and as commands (the first that fits counts), keywords of the classes.
FUNCTIONS = ["sin", "cos", "tan", "sec", "csc", "cot", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "lg", "exp", "sqrt", "lim", "max", "min", "det", "dim", "ker", "gcd", "lcm", "sup", "inf"]
SYMBOLS = "+-*/=<>≤≥≠≈∝∞∂∇∆∫∮∑∏⋃⋂∈∉⊂⊃⊆⊇∧∨¬⇒⇔∀∃"
COMMANDS = ["leq", "geq", "neq", "approx", "propto", "infty", "partial", "nabla", "Delta", "int", "oint", "sum", "prod", "cup", "cap", "in", "notin", "subset", "supset", "subseteq", "supseteq", "wedge", "vee", "neg", "Rightarrow", "Leftrightarrow", "forall", "exists"]
CLASSES = [("calculus", ["sum", "int", "integral"]), ("linear_algebra", ["matrix", "vec", "dot"]), ("fraction", ["frac", "/"]), ("exponential", ["^", "pow", "exp"]), ("radical", ["sqrt", "root"])]
#: What a structure adds to the complexity, and what each sign weighs in the density.
STRUCTURES = {
    "fractions": (2.0, ["\\frac", "\\dfrac", "\\tfrac"]),
    "integrals": (3.0, ["\\int", "\\iint", "\\iiint", "\\oint"]),
    "summations": (2.5, ["\\sum", "\\prod"]),
    "matrices": (3.5, ["\\matrix", "\\pmatrix", "\\bmatrix", "\\Bmatrix", "\\vmatrix", "\\Vmatrix"]),
}
DENSITY = {"\\frac": 2, "\\int": 3, "\\sum": 3, "\\prod": 3, "\\sqrt": 2, "^": 1, "_": 1, "\\matrix": 4, "\\begin": 3}
VARIABLE = r"[a-zA-Z](?:_\{[^}]*\})?(?:\^\{[^}]*\})?"


def escaped(sign: str) -> str:
    """A pattern for the sign itself, in the syntax that both engines read."""
    return "".join(c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c for c in sign)


def tidy(latex: Column) -> Column:
    """Without comments, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(latex, F.lit("")), r"%[^\n]*", ""), r"\s+", " "))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def variables(tidied: Column) -> Column:
    """Letters with their marks below and above; of a command, only its first letter does not count."""
    return _found(tidied, rf"(?<!\\){VARIABLE}", 0)


def called(tidied: Column) -> Column:
    return _found(tidied, rf"\\({'|'.join(FUNCTIONS)})\b", 1)


def operators(tidied: Column) -> Column:
    signs = F.regexp_extract_all(tidied, F.lit(f"[{''.join(map(escaped, SYMBOLS))}]"), F.lit(0))
    return F.array_sort(F.array_union(signs, F.regexp_extract_all(tidied, F.lit(rf"\\({'|'.join(COMMANDS)})"), F.lit(1))))


def parsed(latex: Column) -> Column:
    """(variables, functions, operators, fractions, integrals, summations, matrices, n_lines, complexity) of an equation."""
    tidied = tidy(latex)
    has = {k: X.any_of([tidied.contains(s) for s in signs]) for k, (_, signs) in STRUCTURES.items()}
    v, f, o = variables(tidied), called(tidied), operators(tidied)
    bonus = sum((F.when(has[k], weight).otherwise(0.0) for k, (weight, _) in STRUCTURES.items()), F.lit(0.0))
    complexity = 0.5 * F.size(v) + F.size(f) + 0.3 * F.size(o) + bonus
    lines = F.regexp_count(tidied, F.lit(r"\\\\")) + 1
    return F.struct(v.alias("variables"), f.alias("functions"), o.alias("operators"), *(c.alias(k) for k, c in has.items()), lines.alias("n_lines"), complexity.alias("complexity"))


def density(latex: Column) -> Column:
    """Weighted signs for each hundred characters, at most 100."""
    text = F.coalesce(latex, F.lit(""))
    weight = sum((w * F.regexp_count(text, F.lit(escaped(s))) for s, w in DENSITY.items()), F.lit(0))
    return F.least(F.lit(100.0), 100.0 * weight / F.greatest(F.char_length(text), F.lit(1)))


def equation_class(latex: Column) -> Column:
    """The first class of which the equation holds a keyword, also within words; else basic."""
    return X.first_match(F.lower(F.coalesce(latex, F.lit(""))), CLASSES, "basic")


def profile(equations: DataFrame, key: str) -> DataFrame:
    """(key, n, density, consistency, a count for each class) of rows with latex, numbered and display, by document.

    Consistency is the mean of two parts, 100 for a single equation: 70 where only some are numbered, else 100, and the distinct
    kinds of display for each hundred equations.
    """
    one = F.count(F.lit(1))
    mixed = F.when(F.bool_or("numbered") & ~F.bool_and("numbered"), 70.0).otherwise(100.0)
    consistency = F.when(one < 2, 100.0).otherwise((mixed + 100.0 * F.count_distinct("display") / one) / 2)
    names = [k for k, _ in CLASSES] + ["basic"]
    rows = equations.withColumns({"_density": density(F.col("latex")), "_class": equation_class(F.col("latex"))})
    return rows.groupBy(key).agg(one.alias("n"), F.avg("_density").alias("density"), consistency.alias("consistency"), *(F.count_if(F.col("_class") == k).alias(k) for k in names))
