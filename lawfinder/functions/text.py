"""Equation text as column expressions: normal form, signature parts, shapes and keys.

Words and identifiers are ASCII, as Java's patterns read them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# LaTeX names of Greek letters that become plain words.
GREEK = (
    "alpha", "beta", "gamma", "Gamma", "delta", "Delta", "epsilon", "zeta", "eta", "theta", "Theta", "iota", "kappa", "lambda", "Lambda", "mu", "nu", "xi",
    "pi", "rho", "sigma", "Sigma", "tau", "upsilon", "phi", "Phi", "chi", "psi", "Psi", "omega", "Omega",
)
# Replacements of the normal form, in the order in which they apply.
NORMAL_RULES = (
    (r"\\var(epsilon|phi)", "$1"), (rf"\\({'|'.join(GREEK)})", "$1"),
    (r"\\left|\\right", ""), (r"\\,", " "), (r"\\!", ""), (r"\\;", " "), (r"\\cdot|\\times", "*"),
    (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)"), (r"\\sqrt\{([^{}]*)\}", "sqrt($1)"), (r"\\(sqrt|exp)", "$1"), (r"\\ln", "log"), (r"\\log", "log10"),
    (r"\\(sin|cos|tan)", "$1"), (r"\$", ""), (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)"),
    (r"\^\{", "^("), (r"_\{", "_("), (r"\}", ")"), (r"([A-Za-z]+)_\(([^()]+)\)", "$1_$2"), (r"\*\*", "^"),
    (r"\^\(\s*-\s*1\s*/\s*2\s*\)", "^(-0.5)"), (r"\^\(\s*1\s*/\s*2\s*\)", "^(0.5)"),
)
# Identities of the canonical form, after the left side of an equation is cut off.
_NAME = "([A-Za-z_][A-Za-z_0-9]*)"
CANONICAL_RULES = (("(?s)^[^=]*=", ""), (rf"{_NAME}\^\(-0\.5\)", "1/sqrt($1)"), (rf"{_NAME}\^\(0\.5\)", "sqrt($1)"), (rf"{_NAME}\^\(-1\)", "1/($1)"), (rf"\be\^\(?{_NAME}\)?", "exp($1)"))
FUNCTIONS = ("exp", "log10", "log", "sqrt", "sinh", "cosh", "tanh", "sin", "cos", "tan")
_LITERAL = r"(?<![a-zA-Z_\d])(-?\d+\.\d+(?:[eE][+-]?\d+)?|-?\d+(?:[eE][+-]?\d+)?)(?![a-zA-Z_\d])"
#: Literals that keep their value when constants are renamed.
PLAIN_LITERALS = ("2", "3", "4", "5")


def _applied(text: Column, rules) -> Column:
    return reduce(lambda s, rule: F.regexp_replace(s, rule[0], rule[1]), rules, text)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def normalized(text: Column) -> Column:
    """LaTeX or plain text with macros, fractions, subscripts and half powers in one notation."""
    return _applied(text, NORMAL_RULES)


def canonical(text: Column) -> Column:
    """The normal form of an equation's right side, with half powers and inverses written one way."""
    return _applied(normalized(text), CANONICAL_RULES)


def operators(s: Column) -> Column:
    """Operators that occur; a minus counts only between spaces or in front."""
    signs = (("*", r"\*"), ("+", r"\+"), ("-", " - |^-"), ("/", "/"), ("^", r"\^"))
    return F.array_compact(F.array(*[F.when(s.rlike(p), F.lit(o)) for o, p in signs]))


def functions(s: Column) -> Column:
    """Function words that occur; the decimal logarithm counts as the logarithm."""
    hits = [F.when(s.rlike(r"\blog(10)?\b" if f == "log" else rf"\b{f}\b"), F.lit(f)) for f in sorted(set(FUNCTIONS) - {"log10"})]
    return F.array_compact(F.array(*hits))


def exponents(s: Column) -> Column:
    """Numeric exponents to two places; a fraction gives its value and its numerator."""
    fraction = r"\^\(\s*(-?\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*\)"
    tops, bottoms = _found(s, fraction, 1), _found(s, fraction, 2)
    ratios = F.zip_with(tops, bottoms, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))
    plain = F.transform(_found(s, r"\^\(?\s*(-?\d+\.?\d*)\s*\)?", 1), lambda a: a.cast("double"))
    return F.array_sort(F.array_distinct(F.transform(F.array_compact(F.concat(ratios, plain)), lambda x: F.bround(x, 2))))


def names(s: Column) -> Column:
    """Distinct identifiers that are not functions."""
    return F.array_except(_found(s, "[a-zA-Z_][a-zA-Z_0-9]*"), F.array(*map(F.lit, FUNCTIONS)))


def variables(s: Column) -> Column:
    """Base names: what stands before a subscript, without digits at its end."""
    def base(t: Column) -> Column:
        short = F.regexp_replace(F.regexp_extract(t, "^[^_]*", 0), r"\d+$", "")
        return F.lower(F.when(short == "", t).otherwise(short))

    return F.array_sort(F.array_distinct(F.transform(names(s), base)))


def complexity(s: Column) -> Column:
    words = reduce(lambda a, b: a + b, [F.regexp_count(s, F.lit(rf"\b{f}\b")) for f in FUNCTIONS])
    return F.regexp_count(s, F.lit(r"[+\-*/^]")) + words + F.size(names(s)) + F.regexp_count(s, F.lit(r"\d+\.?\d*"))


def parse_quality(s: Column) -> Column:
    """1 for clean text, less the more backslashes, braces and non-ASCII characters are in it; 0 for none."""
    debris = F.length(s) - F.length(F.regexp_replace(s, r"[\\{}]|[^\x00-\x7F]", ""))
    share = debris / F.greatest(F.length(s), F.lit(1)) * 4.0
    return F.when(F.coalesce(s, F.lit("")) == "", 0.0).otherwise(1 - F.least(share, F.lit(1.0)))


def too_nested(s: Column) -> Column:
    """Whether an exponential stands inside another, or a power inside a power's base or exponent.

    Open brackets are kept as letters: e of an exponential, p of an exponent, o
    of another; in capitals once a power has been seen inside.
    """
    def step(a: Column, t: Column) -> Column:
        top = F.right(a["open"], F.lit(1))
        closes, power, opens = F.contains(t, F.lit(")")), F.contains(t, F.lit("^")), F.contains(t, F.lit("("))
        left = F.when(closes, F.left(a["open"], F.greatest(F.length(a["open"]) - 1, F.lit(0)))).otherwise(a["open"])
        kind = F.when(power, F.lit("p")).when(F.startswith(t, F.lit("exp")), F.lit("e")).otherwise("o")
        bad = (F.startswith(t, F.lit("exp")) & F.contains(F.lower(left), F.lit("e"))) | (power & F.contains(F.lower(left), F.lit("p"))) | (power & closes & top.isin("E", "P", "O"))
        inside = F.when(power, F.upper(left)).otherwise(left)
        return F.struct(F.concat(inside, F.when(opens, kind).otherwise("")).alias("open"), (a["bad"] | bad).alias("bad"))

    flat = F.regexp_replace(s, r"\s+", "")
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("bad"))
    return F.aggregate(_found(flat, r"\bexp\(|\)?\^\(?|[()]"), start, step, lambda a: a["bad"]) | flat.rlike(r"\^-?[\w.]+\^")


def terms(s: Column) -> Column:
    """Parts between plus and minus signs that stand outside all brackets, with their signs."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, c: Column) -> Column:
        cuts = c.isin("+", "-") & (a["depth"] == 0)
        return F.struct(
            (a["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)).alias("depth"),
            F.when(cuts, c).otherwise(F.concat(a["now"], c)).alias("now"),
            F.when(cuts, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
        )

    cut = F.aggregate(F.split(s, ""), start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    return F.filter(F.transform(cut, lambda t: F.trim(t)), lambda t: ~t.isin("", "+", "-"))


def term_shape(t: Column) -> Column:
    """What a term is made of, as joined tags; linear if of nothing else."""
    half = t.rlike(r"\^\(?-?0\.5\)?")
    root = t.rlike(r"\bsqrt\b") | half
    tags = F.array_compact(F.array(
        F.when(root, F.lit("sqrt")), F.when(t.rlike(r"\blog\d*\b"), F.lit("log")), F.when(t.rlike(r"\bexp\b"), F.lit("exp")),
        F.when(t.rlike(r"\b(sin|cos|tan)\b"), F.lit("trig")), F.when(F.contains(t, F.lit("^")) & ~root, F.lit("pow")),
        F.when(F.contains(t, F.lit("/")) | t.rlike(r"\^\(?-0\.5\)?"), F.lit("div")),
    ))
    return F.when(F.size(tags) == 0, "linear").otherwise(F.array_join(tags, "_"))


def term_shapes(s: Column) -> Column:
    """How many terms have each shape, as a map."""
    def counted(shapes: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(shapes)), lambda k: F.struct(k, F.size(F.filter(shapes, lambda x: x == k)))))

    return _let(F.transform(_let(terms(s), lambda ts: F.when(F.size(ts) == 0, F.array(s)).otherwise(ts)), term_shape), counted)


def signature(text: Column, more_operators: Column | None = None, more_functions: Column | None = None, hint: Column | None = None, split: Callable[[Column], Column] | None = None) -> Column:
    """Everything similarity looks at; declared operators and functions join those found, a known complexity goes before a counted one, and ``split`` may rewrite the text whose terms are counted."""
    def parts(s: Column) -> Column:
        ops = operators(s) if more_operators is None else F.array_union(operators(s), F.coalesce(more_operators, F.array().cast("array<string>")))
        fns = functions(s) if more_functions is None else F.array_union(functions(s), F.transform(F.coalesce(more_functions, F.array().cast("array<string>")), declared_function))
        size = complexity(s).cast("double")
        return F.struct(
            F.array_sort(ops).alias("operators"), F.array_sort(fns).alias("functions"), exponents(s).alias("exponents"), variables(s).alias("var_names"),
            F.size(names(s)).alias("var_count"), (size if hint is None else F.coalesce(hint.cast("double"), size)).alias("complexity"),
            (term_shapes(s) if split is None else _let(split(s), term_shapes)).alias("term_shapes"), s.alias("norm"),
        )

    return _let(canonical(text), parts)


def declared_function(name: Column) -> Column:
    """A declared function's meaning: ln is the natural logarithm, log the decimal one."""
    return F.when(name == "ln", "log").when(name == "log", "log10").otherwise(name)


def structural_key(text: Column) -> Column:
    """The canonical form with literals as C and no spaces; equal for formulas that differ in coefficients."""
    return F.regexp_replace(F.regexp_replace(canonical(text), r"(?<![A-Za-z_\d])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", "C"), r"\s+", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(canonical(text), r"[\s()]", "")


def renamed_constants(text: Column) -> Column:
    """Literals as capital letters in order of appearance, equal ones alike; names already in use are passed over."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])

    def named(v: Column) -> Column:
        free = F.array_except(letters, v["used"])
        order = F.array_distinct(F.filter(v["hits"], lambda h: ~h.isin(*PLAIN_LITERALS)))
        new = F.transform(v["hits"], lambda h: F.coalesce(F.when(h.isin(*PLAIN_LITERALS), h).otherwise(F.get(free, F.array_position(order, h).cast("int") - 1)), h))
        return F.array_join(F.zip_with(v["pieces"], F.concat(new, F.array(F.lit(""))), lambda p, h: F.concat(p, h)), "")

    return _let(F.struct(F.split(text, _LITERAL, -1).alias("pieces"), _found(text, _LITERAL).alias("hits"), _found(text, "[A-Za-z_][A-Za-z_0-9]*").alias("used")), named)


def search_text(text: Column) -> Column:
    """Lower case, with hyphens, underscores and slashes as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[-_/]", " "), r"\s+", " "))


def matches_all(haystack: Column, query: str) -> Column:
    """Whether every word of a query occurs somewhere in the searched text."""
    words = [w for w in " ".join(query.lower().translate(str.maketrans("-_/", "   ")).split()).split(" ") if w]
    found = search_text(haystack)
    return reduce(lambda a, b: a & b, [F.contains(found, F.lit(w)) for w in words], F.lit(True))
