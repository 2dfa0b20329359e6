"""Formulas as trees: flat postfix arrays of tokens, as column expressions.

``a*exp(-x)`` is ``[a, x, ~, exp, *]``; ``~`` is the minus sign before a value.
A subtree is a slice that ends at its root, so putting formulas in place of
names is a flattening, and containment a comparison of slices. Everything
here folds over the tokens with a stack and stays in the JVM.

A text that is no formula has a null tree: other characters than those of
numbers, names, operators and brackets, unbalanced brackets, or values and
operators that do not alternate. Values beside each other multiply, and a
function without brackets takes the power that follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FUNCTIONS, canonical

NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
TOKEN = rf"{NUMBER}|[A-Za-z_][A-Za-z_0-9]*|[-+*/^()]"
BINARY = ("+", "-", "*", "/", "^")
#: How tightly operators hold; atoms hold tightest.
HOLDS = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3, "^": 4}
ATOM = 5
#: A function that stands without brackets: after the power, before a product.
BARE = 3
#: Terms that an expanded formula may have; beyond, it stays as it is.
MOST_TERMS = 32
#: Greatest power of a sum that is multiplied out.
MOST_POWER = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _choice(token: Column, table: dict[str, int], other: int) -> Column:
    found = F.lit(other)
    for name, value in table.items():
        found = F.when(token == name, value).otherwise(found)
    return found


def is_function(token: Column) -> Column:
    return token.isin(*FUNCTIONS)


def is_number(token: Column) -> Column:
    return token.rlike(r"^[0-9.]")


def is_name(token: Column) -> Column:
    return token.rlike("^[A-Za-z_]") & ~is_function(token)


def arity(token: Column) -> Column:
    return F.when(token.isin(*BINARY), 2).when(is_function(token) | (token == "~"), 1).otherwise(0)


def pop(stack: Column, n: int) -> Column:
    """The stack without its last ``n`` entries."""
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - n, F.lit(0)))


def folded(tree: Column, element: str, leaf: Callable, one: Callable, two: Callable) -> Column:
    """The value of a tree's root, from values of leaves and of nodes by those of their children."""
    def step(stack: Column, t: Column) -> Column:
        last, before = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        n = arity(t)
        kept = F.when(n == 2, pop(stack, 2)).when(n == 1, pop(stack, 1)).otherwise(stack)
        made = F.when(n == 0, leaf(t)).when(n == 1, one(t, last)).otherwise(two(t, before, last))
        return F.concat(kept, F.array(made)).cast(f"array<{element}>")

    return F.get(F.aggregate(tree, F.array().cast(f"array<{element}>"), step), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens with products written out and minus signs before values as ~; null if anything else is in the text."""
    plain = F.regexp_replace(F.translate(text, "[]{}", "()()"), r"\*\*", "^")
    clean = F.regexp_replace(F.regexp_replace(plain, TOKEN, ""), r"\s+", "") == ""

    def written(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(ts, i - 1))
            ends = last.isNotNull() & (last == ")") | F.coalesce(last.rlike("^[A-Za-z_0-9.]") & ~is_function(last), F.lit(False))
            ends = F.coalesce(ends, F.lit(False))
            begins = t.rlike("^[A-Za-z_0-9.(]")
            sign = t.isin("+", "-") & ~ends
            return F.when(sign & (t == "-"), F.array(F.lit("~"))).when(sign, F.array().cast("array<string>")).when(ends & begins, F.array(F.lit("*"), t)).otherwise(F.array(t))

        return F.flatten(F.transform(ts, one))

    return F.when(clean, let(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), written))


def parsed(text: Column) -> Column:
    """The tree of a text as it stands; null if it is no formula."""
    kind = "struct<out:array<string>,held:array<string>,value:boolean,ok:boolean>"

    def ahead(t: Column) -> Column:
        """How tightly what waits on the stack must hold to come before the operator."""
        return F.when(t == "^", HOLDS["^"] + 1).otherwise(_choice(t, HOLDS, 0))

    def step(a: Column, t: Column) -> Column:
        opens, closes, binary = t == "(", t == ")", t.isin(*BINARY)
        prefix = is_function(t) | (t == "~")
        holds = lambda h: F.when(h == "(", 0).otherwise(_choice(h, HOLDS, BARE))
        stay = lambda h: F.when(closes, h == "(").otherwise(holds(h) < ahead(t))
        # Entries go from the top down to the first that stays.
        at = F.array_position(F.reverse(F.transform(a["held"], stay)), F.lit(True)).cast("int")
        gone = F.when(~(closes | binary), 0).when(at == 0, F.size(a["held"])).otherwise(at - 1)

        def moved(n: Column) -> Column:
            left = F.slice(a["held"], F.lit(1), F.size(a["held"]) - n)
            out = F.concat(a["out"], F.reverse(F.slice(a["held"], F.size(a["held"]) - n + 1, n)))
            top = F.get(left, F.size(left) - 2)
            wraps = closes & F.coalesce(is_function(top), F.lit(False))
            held = F.when(closes, pop(left, 1)).otherwise(left)
            held = F.when(wraps, pop(left, 2)).otherwise(held)
            held = F.when(opens | binary | prefix, F.concat(held, F.array(t))).otherwise(held)
            out = F.when(wraps, F.concat(out, F.array(top))).when(opens | closes | binary | prefix, out).otherwise(F.concat(out, F.array(t)))
            takes = F.when(closes | binary, a["value"]).otherwise(~a["value"])
            ok = a["ok"] & takes & (~closes | (F.size(left) > 0))
            return F.struct(out.alias("out"), held.alias("held"), (closes | ~(opens | binary | prefix)).alias("value"), ok.alias("ok")).cast(kind)

        return let(gone, moved)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(False).alias("value"), F.lit(True).alias("ok")).cast(kind)

    def ended(a: Column) -> Column:
        whole = a["ok"] & a["value"] & ~F.array_contains(a["held"], "(")
        return F.when(whole, F.concat(a["out"], F.reverse(a["held"])))

    return F.aggregate(tokens(text), start, step, ended)


def tree(text: Column) -> Column:
    """The tree of an equation's right side in canonical form."""
    return parsed(canonical(text))


def printed(tree: Column) -> Column:
    """The text of a tree, with as few brackets as give the same tree again."""
    kind = "struct<s:string,p:int>"
    made = lambda s, p: F.struct(s.alias("s"), p.cast("int").alias("p")).cast(kind)
    around = lambda x, bare: F.when(bare, x["s"]).otherwise(F.concat(F.lit("("), x["s"], F.lit(")")))

    def one(t: Column, x: Column) -> Column:
        minus = t == "~"
        return made(F.when(minus, F.concat(F.lit("-"), around(x, x["p"] > HOLDS["~"]))).otherwise(F.concat(t, F.lit("("), x["s"], F.lit(")"))), F.when(minus, HOLDS["~"]).otherwise(ATOM))

    def two(t: Column, x: Column, y: Column) -> Column:
        p = _choice(t, HOLDS, 0)
        power = t == "^"
        left = around(x, F.when(power, x["p"] > p).otherwise(x["p"] >= p))
        right = around(y, F.when(power, y["p"] >= p).otherwise(y["p"] > p))
        sign = F.when(t.isin("+", "-"), F.concat(F.lit(" "), t, F.lit(" "))).otherwise(t)
        return made(F.concat(left, sign, right), p)

    return folded(tree, kind, lambda t: made(t, F.lit(ATOM)), one, two)["s"]


def put_back(tree: Column, formulas: Column) -> Column:
    """The tree with the trees of a map in place of the names that it holds; what is put in is not looked at again."""
    return F.flatten(F.transform(tree, lambda t: F.coalesce(F.try_element_at(formulas, t), F.array(t))))


def humanised(equation: Column, formulas: dict[str, str]) -> Column:
    """An equation with names as x0, x1 as text with the formulas that they stand for; as it was if it is no formula."""
    if not formulas:
        return equation
    known = F.create_map(*[c for name, formula in formulas.items() for c in (F.lit(name), parsed(F.lit(formula)))])
    return F.coalesce(printed(put_back(parsed(equation), known)), equation)


def names(tree: Column) -> Column:
    """Distinct names in order of appearance."""
    return F.array_distinct(F.filter(tree, is_name))


def sizes(tree: Column) -> Column:
    """Tokens of the subtree that ends at each place."""
    kind = "struct<all:array<int>,open:array<int>>"

    def step(a: Column, t: Column) -> Column:
        last, before = F.get(a["open"], F.size(a["open"]) - 1), F.get(a["open"], F.size(a["open"]) - 2)
        n = arity(t)
        size = F.when(n == 0, 1).when(n == 1, last + 1).otherwise(last + before + 1)
        held = F.when(n == 2, pop(a["open"], 2)).when(n == 1, pop(a["open"], 1)).otherwise(a["open"])
        return let(size, lambda s: F.struct(F.concat(a["all"], F.array(s)).alias("all"), F.concat(held, F.array(s)).alias("open")).cast(kind))

    empty = F.array().cast("array<int>")
    return F.aggregate(tree, F.struct(empty.alias("all"), empty.alias("open")).cast(kind), step, lambda a: a["all"])


def subtrees(tree: Column) -> Column:
    """Every subtree, by the place of its root."""
    return let(sizes(tree), lambda size: F.transform(tree, lambda _, i: F.slice(tree, i - size[i] + 2, size[i])))


def contains(tree: Column, part: Column) -> Column:
    """Whether a tree holds another as a subtree."""
    last = F.size(tree) - F.size(part) + 1
    return (last >= 1) & F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(tree, i, F.size(part)) == part)


def arguments(tree: Column) -> Column:
    """For each function in the tree its name and the names in its argument, however deep."""
    found = F.transform(subtrees(tree), lambda s: F.struct(F.element_at(s, -1).alias("function"), names(s).alias("names")))
    return F.filter(found, lambda a: is_function(a["function"]))


def nested(tree: Column) -> Column:
    """Whether an exponential stands inside another, or a power inside a power."""
    kind = "struct<e:boolean,p:boolean,bad:boolean>"
    made = lambda e, p, bad: F.struct(e.alias("e"), p.alias("p"), bad.alias("bad")).cast(kind)
    no = F.lit(False)
    return folded(
        tree, kind, lambda t: made(no, no, no), lambda t, x: made(x["e"] | (t == "exp"), x["p"], x["bad"] | ((t == "exp") & x["e"])),
        lambda t, x, y: made(x["e"] | y["e"], x["p"] | y["p"] | (t == "^"), x["bad"] | y["bad"] | ((t == "^") & (x["p"] | y["p"]))),
    )["bad"]


def value(tree: Column, of: Callable[[Column], Column]) -> Column:
    """The number that a tree gives, with ``of`` giving those of names; NaN where it has none."""
    applied = {
        "~": lambda x: -x, "exp": F.exp, "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    }
    joined = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y), "^": F.pow}
    nan = F.lit(float("nan"))

    def one(t: Column, x: Column) -> Column:
        found = nan
        for name, f in applied.items():
            found = F.when(t == name, f(x)).otherwise(found)
        return F.coalesce(found, nan)

    def two(t: Column, x: Column, y: Column) -> Column:
        found = nan
        for name, f in joined.items():
            found = F.when(t == name, f(x, y)).otherwise(found)
        return F.coalesce(found, nan)

    leaf = lambda t: F.coalesce(F.when(is_number(t), t.try_cast("double")).otherwise(of(t)), nan)
    return folded(tree, "double", leaf, one, two)


# --- expansion ---------------------------------------------------------------------------------------------------------

_TERM = "struct<n:double,d:double,up:array<string>,down:array<string>>"
_SUM = f"array<{_TERM}>"
_NONE = "array<string>"


def _term(n: Column, d: Column, up: Column, down: Column) -> Column:
    """A product: the whole or broken number n / d, times factors over factors; factors on both sides cancel."""
    def left(a: Column, b: Column) -> Column:
        every = F.array_sort(F.array_distinct(a))
        count = lambda fs, f: F.size(F.filter(fs, lambda x: x == f))
        return F.flatten(F.transform(every, lambda f: F.array_repeat(f, F.greatest(count(a, f) - count(b, f), F.lit(0)))))

    whole, under = F.pmod(n, d) == 0, (n == F.floor(n)) & (F.pmod(d, F.abs(n)) == 0)
    return F.struct(
        F.when(whole, n / d).when(under, F.signum(n)).otherwise(n).alias("n"), F.when(whole, 1.0).when(under, d / F.abs(n)).otherwise(d).alias("d"),
        left(up, down).alias("up"), left(down, up).alias("down"),
    ).cast(_TERM)


def _times(a: Column, b: Column) -> Column:
    return _gathered(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _term(x["n"] * y["n"], x["d"] * y["d"], F.concat(x["up"], y["up"]), F.concat(x["down"], y["down"]))))))


def _gathered(terms: Column) -> Column:
    """Terms of equal factors as one; none for those that add up to nothing."""
    def total(ts: Column, key: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("n"), F.lit(1.0).alias("d")).cast("struct<n:double,d:double>")
        add = lambda a, t: F.struct(F.when(a["d"] == t["d"], a["n"] + t["n"]).otherwise(a["n"] * t["d"] + t["n"] * a["d"]).alias("n"), F.when(a["d"] == t["d"], a["d"]).otherwise(a["d"] * t["d"]).alias("d")).cast("struct<n:double,d:double>")
        same = F.filter(ts, lambda t: (t["up"] == key["up"]) & (t["down"] == key["down"]))
        return let(F.aggregate(same, start, add), lambda c: _term(c["n"], c["d"], key["up"], key["down"]))

    def one(ts: Column) -> Column:
        keys = F.array_distinct(F.transform(ts, lambda t: F.struct(t["up"].alias("up"), t["down"].alias("down"))))
        return F.filter(F.transform(keys, lambda k: total(ts, k)), lambda t: t["n"] != 0)

    return let(terms, one)


def _figure(x: Column) -> Column:
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _product(t: Column, size: Column) -> Column:
    """A term's text, without its sign."""
    def powers(fs: Column) -> Column:
        return F.transform(F.array_distinct(fs), lambda f: let(F.size(F.filter(fs, lambda x: x == f)), lambda k: F.when(k == 1, f).otherwise(F.concat(_based(f), F.lit("^"), k.cast("string")))))

    first = F.when((size == 1) & (F.size(t["up"]) > 0), F.array().cast(_NONE)).otherwise(F.array(_figure(size)))
    top = F.array_join(F.concat(first, powers(t["up"])), "*")
    under = F.concat(F.when(t["d"] == 1, F.array().cast(_NONE)).otherwise(F.array(_figure(t["d"]))), powers(t["down"]))
    return let(under, lambda u: F.when(F.size(u) == 0, top).when(F.size(u) == 1, F.concat(top, F.lit("/"), u[0])).otherwise(F.concat(top, F.lit("/("), F.array_join(u, "*"), F.lit(")"))))


def _based(f: Column) -> Column:
    """A factor's text as the base of a power."""
    return F.when(f.rlike(r"^([A-Za-z_0-9]+(\([^()]*\))?|\([^()]*\))$"), f).otherwise(F.concat(F.lit("("), f, F.lit(")")))


def _sum_text(terms: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        minus = t["n"] < 0
        sign = F.when(i == 0, F.when(minus, "-").otherwise("")).otherwise(F.when(minus, " - ").otherwise(" + "))
        return F.concat(sign, _product(t, F.abs(t["n"])))

    return F.when(F.size(terms) == 0, "0").otherwise(F.array_join(F.transform(terms, one), ""))


def expanded_terms(tree: Column) -> Column:
    """The terms of a tree once products of sums and small powers of sums are multiplied out; null where there would be too many.

    What stands in a function, under a power that is no small whole number, or
    in a sum below a fraction stays together as one factor.
    """
    none = F.array().cast(_NONE)
    factor = lambda text: F.array(_term(F.lit(1.0), F.lit(1.0), F.array(text), none)).cast(_SUM)
    number = lambda x: F.array(F.struct(x.alias("n"), F.lit(1.0).alias("d"), none.alias("up"), none.alias("down")).cast(_TERM))
    size = lambda a, b: F.size(a) * F.size(b)
    refused = F.lit(None).cast(_SUM)

    def leaf(t: Column) -> Column:
        return F.when(is_number(t), F.filter(number(t.try_cast("double")), lambda x: x["n"] != 0)).otherwise(factor(t))

    def one(t: Column, x: Column) -> Column:
        return F.when(t == "~", _negated(x)).otherwise(factor(F.concat(t, F.lit("("), _sum_text(x), F.lit(")"))))

    def over(x: Column) -> Column:
        """One over a single term."""
        whole = x["n"] == F.floor(x["n"])
        return F.array(_term(F.when(whole, F.signum(x["n"]) * x["d"]).otherwise(x["d"] / x["n"]), F.when(whole, F.abs(x["n"])).otherwise(F.lit(1.0)), x["down"], x["up"]))

    def power(x: Column, y: Column) -> Column:
        k = F.when((F.size(y) == 1) & (F.size(y[0]["up"]) + F.size(y[0]["down"]) == 0) & (y[0]["d"] == 1) & (y[0]["n"] == F.floor(y[0]["n"])), y[0]["n"])
        k = F.when(F.size(y) == 0, F.lit(0.0)).otherwise(k)
        whole = factor(F.concat(_based(_sum_text(x)), F.lit("^"), F.when(_sum_text(y).rlike(r"^[A-Za-z_0-9.]+$"), _sum_text(y)).otherwise(F.concat(F.lit("("), _sum_text(y), F.lit(")")))))

        def raised(k: Column) -> Column:
            steps = F.abs(k).cast("int")
            base = F.when((k < 0) & (F.size(x) == 1), over(x[0])).otherwise(x)
            fits = F.pow(F.size(x), steps) <= MOST_TERMS
            out = let(base, lambda b: F.aggregate(F.array_repeat(F.lit(0), steps), number(F.lit(1.0)), lambda a, _: _times(a, b)))
            return F.when(k.isNull() | (steps > MOST_POWER) | ((k < 0) & (F.size(x) != 1)) | ((k <= 0) & (F.size(x) == 0)), whole).when(fits, out)

        return let(k, raised)

    def two(t: Column, x: Column, y: Column) -> Column:
        parts = F.when((t == "*") & (size(x, y) > MOST_TERMS), refused).when(t == "*", _times(x, y)).when(t == "^", power(x, y))
        parts = parts.when((t == "/") & (F.size(y) == 1), _times(x, over(y[0])))
        below = F.array(F.struct(F.lit(1.0).alias("n"), F.lit(1.0).alias("d"), none.alias("up"), F.array(F.concat(F.lit("("), _sum_text(y), F.lit(")"))).alias("down")).cast(_TERM))
        parts = parts.when((t == "/") & (F.size(y) > 1), _times(x, below)).when(t == "/", refused)
        joined = F.concat(x, F.when(t == "-", _negated(y)).otherwise(y))
        return F.when(x.isNull() | y.isNull(), refused).otherwise(parts.when(F.size(x) + F.size(y) > MOST_TERMS, refused).otherwise(_gathered(joined)))

    return folded(tree, _SUM, leaf, one, two)


def _negated(x: Column) -> Column:
    return F.transform(x, lambda t: F.struct((-t["n"]).alias("n"), t["d"].alias("d"), t["up"].alias("up"), t["down"].alias("down")).cast(_TERM))


def expanded(text: Column) -> Column:
    """A text with its products of sums multiplied out; as it was if it is no formula, has log10 or braces, or would have too many terms."""
    skipped = F.contains(text, F.lit("log10")) | text.rlike("[{}]")
    return F.coalesce(F.when(~skipped, let(expanded_terms(parsed(text)), lambda ts: F.when(ts.isNotNull(), _sum_text(ts)))), text)


# --- equivalence -------------------------------------------------------------------------------------------------------


def point(name: Column, seed: int) -> Column:
    """A name's value at a seeded point, between 1/2 and 2."""
    return 0.5 + 1.5 * F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def agree(a: Column, b: Column) -> Column:
    """Whether two numbers are equal but for rounding."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def equal_at(a: Column, b: Column, seeds: range, ones: Column | None = None) -> Column:
    """Whether two trees agree at every seeded point where both have a value; null if there are no two such points. Names among ``ones`` count as 1."""
    def of(seed: int):
        return lambda t: point(t, seed) if ones is None else F.when(F.array_contains(ones, t), 1.0).otherwise(point(t, seed))

    finite = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    pairs = F.array(*[F.struct(value(a, of(s)).alias("x"), value(b, of(s)).alias("y")) for s in seeds])
    # A value on one side alone is a difference too.
    odd = lambda ps: F.exists(ps, lambda p: finite(p["x"]) != finite(p["y"]))
    good = lambda ps: F.filter(ps, lambda p: finite(p["x"]) & finite(p["y"]))
    return let(pairs, lambda ps: F.when(odd(ps), False).when(F.size(good(ps)) >= 2, F.forall(good(ps), lambda p: agree(p["x"], p["y"]))))


def exact_match(one: Column, other: Column, seeds: range = range(100, 106)) -> Column:
    """Whether two formulas are the same function of the names that they share, with every other name as 1; null if it cannot be said.

    Like the display check of the matches, formulas with decimal logarithms or braces are not attempted.
    """
    skipped = F.contains(one, F.lit("log10")) | F.contains(other, F.lit("log10")) | one.rlike("[{}]") | other.rlike("[{}]")

    def compared(t: Column) -> Column:
        shared = F.array_intersect(names(t["a"]), names(t["b"]))
        ones = F.array_except(F.array_union(names(t["a"]), names(t["b"])), shared)
        return let(ones, lambda o: equal_at(t["a"], t["b"], seeds, o))

    both = F.struct(parsed(one).alias("a"), parsed(other).alias("b"))
    return F.when(~skipped, let(both, lambda t: F.when(t["a"].isNotNull() & t["b"].isNotNull(), compared(t))))
