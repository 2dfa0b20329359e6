"""Secret scans: fixed patterns and a battery of randomness tests.

Three patterns give the base spans. Besides them, each long run of encoded
characters clear of those is tested for being random: its encoding is inferred
as the smallest alphabet that holds it, its symbols and their kinds (vowels,
consonants, capitals, digits) are tested for uniformity (chi-squared), and the
symbols for the number of runs above and below the middle of the alphabet and
for serial correlation. The statistics are near standard normal for random
symbols and are combined to one p-value. Two estimates of the share of
ordinary strings among those called random must both stay under ``RATE``:

* Random strings have uniform p-values, so those above one half give the number
  of random strings in a class of lengths, and the rest above a cut is ordinary.
* The corpus shows what ordinary text scores: all its letters and digits outside
  of spans and tested strings, run together and cut to the lengths of the
  classes in turn, go through the same tests. The share of those pieces that have a string's
  encoding and at least its p-value, times the strings tested in the class, is
  the number of ordinary ones to expect; against the number observed it gives
  the least cut of the class and encoding (Benjamini-Hochberg's rule). So a few
  long words that look random by chance are not called so, however few strings
  are tested. Where the corpus holds no such pieces this estimate is zero.

Each different string counts once, so copies of a document add no evidence.

Everything is DataFrame expressions: there is no Python on the rows.

Defined cases: a null text counts as empty; a text without findings has empty
spans; texts of any length are scanned whole; repeated rows are scanned each;
further columns pass through unchanged; an empty table gives no rows.
Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound, table

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Classes that whole texts are scanned for name each symbol: Java looks those up in one table, and goes through ranges
# one by one, which took eight times as long for the class of all but letters and digits.
_ALNUM = _DIGITS + _UPPER + _LOWER

# The base patterns. Kinds sort in this order where spans start together.
# The look ahead at the first letter only saves trying each name at each place.
ASSIGN = r"""(?=[aApPsStT])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = f"[{_DIGITS}abcdef]{{24,}}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = f"[{_ALNUM}+/_=-]{{20,}}"
MASK = "<SECRET>"
#: Highest estimated share of ordinary strings among those called random.
RATE = 0.05
#: Length classes: under 32, under 48, under 96 characters, and longer.
LENGTHS = (32, 48, 96)
#: Lengths of the ordinary pieces of each class, and how far apart their starts are by default where only some are wanted.
PIECES, STRIDE = (20, 32, 48, 96), 4096
BINS = 100
#: Sums of squares of three and of four tests from which on the p-value is under the lowest cut, 1 / BINS.
FAR_OFF = (11.4, 13.3)

#: Encodings from the smallest alphabet: pattern of the whole string, and its symbols in order.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("^[a-z]+$", _LOWER),
    ("^[A-Z]+$", _UPPER),
    ("^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("^.*$", _UPPER + _LOWER + _DIGITS + "+/-_"),
)


#: Numbers of the encodings of small letters and of letters alone.
_SMALL, _LETTERS = 3, 8
#: Kinds of symbols; all others are one kind too.
_KINDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each element of a long array the merged value of those before it.

    Values merge over blocks first, so that the work stays near linear for
    texts with very many findings.
    """
    total = lambda a: F.aggregate(a, zero, merge)
    count = F.ceil(F.size(values) / F.lit(block)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    sums = F.transform(upto(count), lambda b: total(F.slice(values, b * block + 1, F.lit(block))))
    starts = bound(sums, lambda s: F.transform(upto(count), lambda b: total(F.slice(s, F.lit(1), b))))
    block_of = lambda i: F.floor(i / F.lit(block)).cast("int")
    return bound(starts, lambda s: F.transform(
        upto(F.size(values)),
        lambda i: F.aggregate(F.slice(values, block_of(i) * block + 1, i % block), F.element_at(s, block_of(i) + 1), merge),
    ))


def running_totals(values: Column, block: int = 256) -> Column:
    return running(values, F.lit(0).cast("long"), lambda a, x: a + x, block)


def ends_before(spans: Column) -> Column:
    """For each span of a sorted array the furthest end of those before it, 0 for none."""
    return running(F.transform(spans, lambda s: s["end"]), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))


_SPAN = "array<struct<start:long,rank:int,end:long,hit:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end, hit).

    The pieces between matches and the matches alternate, so the running
    total of their lengths gives the positions.
    """
    rank = F.lit(KINDS.index(kind))
    long_of = lambda x: F.length(x).cast("long")

    def placed(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["pieces"], F.lit(1), F.size(s["hits"])), s["hits"], lambda p, h: F.struct(long_of(p).alias("gap"), h.alias("hit")))
        return bound(steps, lambda st: F.zip_with(
            st, running_totals(F.transform(st, lambda x: x["gap"] + long_of(x["hit"]))),
            lambda x, before: F.struct(
                (before + x["gap"]).alias("start"), rank.alias("rank"), (before + x["gap"] + long_of(x["hit"])).alias("end"), x["hit"].alias("hit")
            ),
        ))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), bound(both, placed)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and kind."""
    assigned = F.filter(matches(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assigned, matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by a logistic approximation."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) * (1.5976 + 0.07056 * z * z)))


def _near_normal(chi: Column, free: Column) -> Column:
    """A chi-squared value as a standard normal one."""
    return (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def _kinds_of(body: Column, own: Column) -> Column:
    """How many symbols of each kind a string has, and of none; ``own`` is its encoding."""
    n, none = F.length(body), F.lit(0)
    # Each letter becomes the first of its kind, so that a kind is counted by one letter.
    marked = F.translate(body, "".join(_KINDS), "".join(k[0] * len(k) for k in _KINDS))
    named = bound(marked, lambda m: F.array(*[n - F.length(F.replace(m, F.lit(k[0]))) for k in _KINDS]))
    every = bound(named, lambda c: F.concat(c, F.array(n - sum((c[k] for k in range(len(_KINDS))), none))))
    small = bound(F.length(F.regexp_replace(body, f"[{_KINDS[0]}]+", "")), lambda rest: F.array(n - rest, rest, none, none, none))
    return F.when(own == _SMALL, small).otherwise(every)


def _case_off(body: Column, n: Column, held: Column, size: Column) -> Column:
    """A lower bound of how far the kinds are off, from small letters and all other symbols."""
    due = n * (held[0] + held[1]) / size
    others = F.length(F.regexp_replace(body, f"[{_LOWER}]+", ""))
    return bound(n - others - due, lambda off: off * off / due + off * off / (n - due))


def _kinds_off(counts: Column, n: Column, held: Column, size: Column) -> tuple[Column, Column]:
    """How far the kinds of symbols are from the numbers held by the alphabet, and the degrees of freedom."""
    chi, kinds = F.lit(0.0), F.lit(-1.0)
    for k, own in enumerate(counts[k] for k in range(len(_KINDS) + 1)):
        due = F.greatest(n * held[k] / size, F.lit(1e-9))
        chi += F.when(held[k] > 0, F.pow(own - due, F.lit(2)) / due).otherwise(0.0)
        kinds += F.when(held[k] > 0, 1.0).otherwise(0.0)
    return chi, kinds


#: How many symbols of each kind, and of none, the encodings' alphabets hold.
_HELD = [[float(sum(c in k for c in symbols)) for k in _KINDS] + [float(sum(c not in "".join(_KINDS) for c in symbols))] for _, symbols in ENCODINGS]

#: The number of each ASCII symbol in the encodings' alphabets, -1 for those that they do not hold.
_PLACES = [[float(symbols.find(chr(c))) for c in range(128)] for _, symbols in ENCODINGS]


def _body(token: Column) -> Column:
    return F.when(token.endswith("="), F.rtrim(token, F.lit("="))).otherwise(token)


def encoding(token: Column) -> Column:
    """Number of the smallest encoding that holds ``token``."""
    def first(numbers: list[int]) -> Column:
        found = F.lit(numbers[-1])
        for k in reversed(numbers[:-1]):
            found = F.when(_body(token).rlike(ENCODINGS[k][0]), F.lit(k)).otherwise(found)
        return found

    # Most strings are letters alone, which few encodings need be tried for.
    return F.when(_body(token).rlike(ENCODINGS[_LETTERS][0]), first([1, 2, 3, 4, _LETTERS])).otherwise(first(list(range(len(ENCODINGS)))))


def randomness(token: Column, whole: bool = True, own: Column | None = None) -> Column:
    """p-value of the hypothesis that the symbols of ``token`` are random in its encoding, ``own`` where that is known.

    Unless ``whole``, tests end where those done put the p-value under 1 / BINS already, and 0 is given.
    """
    body = _body(token)
    of_encoding = lambda values, e: F.element_at(F.lit(values), e + 1)

    def tested(v: Column) -> Column:
        n, size = v["n"], v["size"]
        square = lambda z: z * z
        mixed_kinds = F.array_max(v["held"]) < size
        shifted = lambda x: (F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1))

        def mixed(counts: Column) -> Column:
            chi, kinds = _kinds_off(counts, n, v["held"], size)
            return bound(F.struct(chi.alias("chi"), kinds.alias("free")), lambda k: F.when(k["free"] > 0, square(_near_normal(k["chi"], k["free"]))).otherwise(0.0))

        def runs(above: Column) -> Column:
            changes = _sum(F.zip_with(*shifted(above), lambda a, b: (a != b).cast("double")))
            want = bound(_sum(above), lambda high: 1 + 2 * high * (n - high) / n)
            return bound(want, lambda w: (1 + changes - w) / F.sqrt(F.greatest((w - 1) * (w - 2) / (n - 1), F.lit(1e-9))))

        def drift(off: Column) -> Column:
            both = _sum(F.zip_with(*shifted(off), lambda a, b: a * b)) / F.greatest(F.aggregate(off, F.lit(0.0), lambda a, r: a + r * r), F.lit(1e-9))
            return (both + 1 / n) * F.sqrt(n)

        def spread(chars: Column) -> Column:
            # symbols that do not occur add nothing
            squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + square(n - F.length(F.replace(v["body"], c))))
            return square(_near_normal(squares * size / n - n, size - 1))

        def below(total: Column) -> Column:
            return 1 - bound(_near_normal(total, F.when(mixed_kinds, 4.0).otherwise(3.0)), normal_below)

        def ended(done: Column, on: Column) -> Column:
            return on if whole else F.when(done >= F.when(mixed_kinds, FAR_OFF[1]).otherwise(FAR_OFF[0]), 0.0).otherwise(on)

        def sooner(on: Column) -> Column:
            # merged kinds are never further off than all, and that is quickly seen
            least = bound(_near_normal(_case_off(v["body"], n, v["held"], size), F.lit(float(len(_KINDS) - 1))), lambda z: F.greatest(z, F.lit(0.0)))
            return on if whole else F.when((v["own"] == _LETTERS) & (bound(least, square) >= FAR_OFF[1]), 0.0).otherwise(on)

        def in_order(done: Column, chars: Column) -> Column:
            def last(x: Column, one: Column) -> Column:
                two = bound(_sum(x) / n, lambda m: bound(F.transform(x, lambda r: r - m), drift))
                return ended(done + one, bound(done + (one + square(two)), below))

            def parts(x: Column) -> Column:
                one = bound(F.transform(x, lambda r: (r >= size / 2).cast("double")), runs)
                return bound(square(one), lambda o: last(x, o))

            return bound(F.transform(chars, lambda c: F.coalesce(F.get(v["places"], F.ascii(c)), F.lit(-1.0))), parts)

        def rest(first: Column) -> Column:
            return bound(F.split(v["body"], ""), lambda chars: bound(first + spread(chars), lambda done: ended(done, in_order(done, chars))))

        return F.when(n < 16, F.lit(0.0)).otherwise(sooner(bound(bound(_kinds_of(v["body"], v["own"]), mixed), lambda first: ended(first, rest(first)))))

    whose = lambda b, e: F.struct(
        b.alias("body"), e.alias("own"), F.length(b).cast("double").alias("n"), of_encoding(_PLACES, e).alias("places"),
        of_encoding([float(len(symbols)) for _, symbols in ENCODINGS], e).alias("size"), of_encoding(_HELD, e).alias("held"),
    )
    return bound(encoding(token) if own is None else own, lambda e: bound(body, lambda b: bound(whose(b, e), tested)))


def length_class(token: Column) -> Column:
    found = F.lit(0)
    for k, most in enumerate(LENGTHS):
        found = F.when(F.length(token) >= most, F.lit(k + 1)).otherwise(found)
    return found


_FAR = 1 << 60


def clear_of(base: Column, found: Column) -> Column:
    """Spans of ``found`` that overlap none of ``base``, with all in order of their starts."""
    def kept(every: Column) -> Column:
        own = lambda s: s["rank"] < KINDS.index("random")
        before = running(F.transform(every, lambda s: F.when(own(s), s["end"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
        starts = F.reverse(F.transform(every, lambda s: F.when(own(s), s["start"]).otherwise(F.lit(_FAR).cast("long"))))
        after = F.reverse(running(starts, F.lit(_FAR).cast("long"), lambda a, x: F.least(a, x)))
        marked = F.zip_with(F.zip_with(every, before, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), after, lambda x, n: F.struct(x["s"].alias("s"), (~own(x["s"]) & (x["e"] <= x["s"]["start"]) & (n >= x["s"]["end"])).alias("ok")))
        return F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["s"])

    return F.when(F.size(found) == 0, found).when(F.size(base) == 0, found).otherwise(bound(F.array_sort(F.concat(base, found)), kept))


def candidates(docs: DataFrame, base: str, name: str) -> DataFrame:
    """Add the base spans, and the spans of strings that are tested for being random."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(base, base_spans(text)).withColumn(name, matches(text, CANDIDATE, "random"))
    return found.withColumn(name, clear_of(F.col(base), F.col(name)))


def ordinary_pieces(text: Column, stride: int = STRIDE) -> Column:
    """Pieces of a text's letters and digits outside of spans and tested strings, one of each class's length every ``stride``.

    With the sum of ``PIECES`` as stride they follow each other and are the whole text, but for ends too short to be tested.
    """
    # Assignments go first, else a string right before one would take its name along and leave its value.
    plain = F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), f"{CANDIDATE}|[^{_ALNUM}]+", "")
    each = sum(PIECES)
    runs = F.regexp_extract_all(plain, F.lit(f"(.{{{PIECES[0]},{each}}}).{{0,{stride - each}}}"), F.lit(1))
    starts = [1 + sum(PIECES[:k]) for k in range(len(PIECES))]
    cuts = F.flatten(F.transform(runs, lambda r: F.array(*[F.substring(r, at, n) for at, n in zip(starts, PIECES, strict=True)])))
    return F.filter(cuts, lambda c: F.length(c) >= PIECES[0])


def length_cuts(docs: DataFrame, rate: float = RATE) -> dict[tuple[int, int], float]:
    """The least p-value called random in each length class and encoding that has tested strings; a few rows whatever the input."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = lambda strings, own: F.transform(strings, lambda h: F.struct(h.alias("hit"), F.lit(own).alias("own")))
    both = F.concat(marked(F.transform("more", lambda s: s["hit"]), True), marked(ordinary_pieces(text, sum(PIECES)), False))
    # An outer explode, as before a plain one Spark adds a filter that finds all spans once more.
    hits = candidates(docs.select("text"), "base", "more").select(F.explode_outer(both).alias("h")).select("h.*").where("hit is not null").distinct()
    value = F.least(F.floor(randomness(F.col("hit"), whole=False, own=F.col("enc")) * BINS), F.lit(BINS - 1)).cast("int")
    binned = hits.withColumn("enc", encoding(F.col("hit"))).select("own", length_class(F.col("hit")).alias("cls"), "enc", value.alias("bin"))
    many = lambda of: F.count(F.when(of, F.lit(1)))
    counts = binned.groupBy("cls", "enc", "bin").agg(many(F.col("own")).alias("tested"), many(~F.col("own")).alias("ordinary"))
    whole, down = Window.partitionBy("cls"), Window.partitionBy("cls").orderBy(F.desc("bin"))
    down_own = Window.partitionBy("cls", "enc").orderBy(F.desc("bin"))
    high = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("tested")).otherwise(0)).over(whole)
    above = F.sum("tested").over(down)
    random = 2 * high * (1 - F.col("bin") / F.lit(float(BINS)))
    mixed = (above - random > rate * above) & (F.col("bin") < BINS // 2) & (F.col("tested") > 0)
    expected = F.sum("tested").over(whole) * F.sum("ordinary").over(down_own) / F.greatest(F.sum("ordinary").over(whole), F.lit(1))
    few = (expected <= rate * F.sum("tested").over(down_own)) & (F.col("tested") > 0)
    told = counts.withColumn("mixed", F.when(mixed, F.col("bin")).otherwise(-1)).withColumn("few", F.when(few, F.col("bin")))
    told = told.withColumn("mixed", F.max("mixed").over(whole)).groupBy("cls", "enc")
    found = told.agg(F.max("mixed").alias("mixed"), F.min("few").alias("few"), F.sum("tested").alias("tested")).where("tested > 0")
    return {(r["cls"], r["enc"]): max((r["mixed"] + 1) / BINS, (BINS if r["few"] is None else r["few"]) / BINS, 0.01) for r in found.collect()}


def with_spans(docs: DataFrame, name: str = "spans", base: str = "base") -> DataFrame:
    """Add arrays of base spans and of all spans, as (start, rank, end, hit), in place of columns of those names."""
    cuts = length_cuts(docs)

    def chosen(token: Column) -> Column:
        # p-values stay below 1, the cut of strings never tested
        least = F.array(*[F.lit(cuts.get((cls, enc), 1.0)) for cls in range(len(PIECES)) for enc in range(len(ENCODINGS))])
        return randomness(token) >= F.element_at(least, length_class(token) * len(ENCODINGS) + encoding(token) + 1)

    found = candidates(docs, base, name)
    return found.withColumn(name, F.array_sort(F.concat(F.col(base), F.filter(name, lambda s: chosen(s["hit"])))))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """Documents with every found span replaced; columns stay as they are, n_chars follows the text."""
    text = F.col("text")

    def masked(v: Column) -> Column:
        # characters are cut from an array, as each cut from a text would read it from its start
        gap = lambda s, e: F.concat(F.slice(v["chars"], (e + 1).cast("int"), (s["start"] - e).cast("int")), F.array(F.lit(mask)))
        pieces = F.zip_with("__spans", ends_before(F.col("__spans")), lambda s, e: F.when(s["start"] >= e, gap(s, e)).otherwise(F.array().cast("array<string>")))
        last = F.array_max(F.transform("__spans", lambda s: s["end"]))
        rest = F.slice(v["chars"], (last + 1).cast("int"), F.greatest(F.size(v["chars"]) - last, F.lit(0)).cast("int"))
        return F.array_join(F.concat(F.flatten(pieces), rest), "")

    new = F.when(F.size("__spans") > 0, bound(F.struct(F.split(text, "").alias("chars")), masked)).otherwise(text)
    out = with_spans(docs, "__spans", "__base").withColumn("text", new).drop("__spans", "__base")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
