"""Numbers, claims and code spans of a text as column expressions, all evaluated inside the JVM.

A number is compared by its canonical form: digits without leading zeros, a
point before a fraction without trailing zeros, a minus if it is negative. Runs
that could mean two numbers stay as they are written, marked ``literal:``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from docloom.functions.text import word_tokens

#: A fence to its closing fence or the end of the text, or back-ticks to the next back-tick or the end.
CODE = r"```[^\n]*(?:(?s:.*?)\n```[^\n]*|(?s:.*))|`[^`]*`?"

#: What may stand between the digits of one number.
SEPARATORS = ".,_'’ \u00a0\u202f"
RUN = rf"(?:(?<![0-9])[-+])?[.,]?[0-9]+(?:[{SEPARATORS}][0-9]+)*"

#: Number words, English and French.
ATOMS = {
    "zero": 0, "zéro": 0, "one": 1, "un": 1, "two": 2, "deux": 2, "three": 3, "trois": 3, "four": 4, "quatre": 4, "five": 5, "cinq": 5, "six": 6,
    "seven": 7, "sept": 7, "eight": 8, "huit": 8, "nine": 9, "neuf": 9, "ten": 10, "dix": 10, "eleven": 11, "onze": 11, "twelve": 12, "douze": 12,
    "thirteen": 13, "treize": 13, "fourteen": 14, "quatorze": 14, "fifteen": 15, "quinze": 15, "sixteen": 16, "seize": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "vingt": 20, "vingts": 20, "thirty": 30, "trente": 30, "forty": 40, "quarante": 40, "fifty": 50,
    "cinquante": 50, "sixty": 60, "soixante": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
#: Words that multiply what stands before them, and words that close such a group.
FACTORS = {"dozen": 12, "douzaine": 12, "score": 20, "hundred": 100, "cent": 100}
SCALES = {"thousand": 10**3, "mille": 10**3, "million": 10**6, "billion": 10**9, "milliard": 10**9, "trillion": 10**12}
LINKS = ["and", "et"]

#: Words without meaning of their own, and words that turn a statement around.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux ce ces dans de des du et est la le les par pour que qui sur une"
).split()
POLARITY = ["no", "not", "never", "without", "aucun", "jamais", "pas", "sans"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _canonical(run: Column) -> Column:
    """The canonical form of one run of digits and separators."""
    zeros = lambda x: F.regexp_replace(x, "^0+", "")
    negative = F.startswith(run, F.lit("-"))

    def whole(digits: Column) -> Column:
        return let(zeros(digits), lambda d: F.when(d == "", "0").otherwise(F.concat(F.when(negative, "-").otherwise(""), d)))

    def decimal(digits: Column, fraction: Column) -> Column:
        sign = F.when(negative, "-").otherwise("")
        left = let(zeros(digits), lambda d: F.when(d == "", "0").otherwise(d))
        return let(F.regexp_replace(fraction, "0+$", ""), lambda f: F.when(f == "", whole(digits)).otherwise(F.concat(sign, left, F.lit("."), f)))

    def read(parts: Column) -> Column:
        groups, marks = parts["groups"], parts["marks"]
        n = F.size(groups)
        first, last, mark = groups[0], F.element_at(groups, -1), F.try_element_at(marks, F.lit(-1))
        threes = lambda a: F.forall(a, lambda g: F.length(g) == 3)
        point = mark.isin(".", ",") & ((F.length(last) != 3) | (F.length(first) > 3) | F.exists(F.slice(marks, 1, n - 2), lambda m: m != mark))
        prefix = F.slice(groups, 1, n - 1)
        grouped = (n == 2) | ((F.length(first) <= 3) & threes(F.slice(groups, 2, n - 2)))
        plain = ((n > 2) | F.forall(marks, lambda m: ~m.isin(".", ","))) & (F.length(first) <= 3) & threes(F.slice(groups, 2, n - 1))
        return (
            F.when(n == 1, whole(first))
            .when(point & grouped, decimal(F.array_join(prefix, ""), last))
            .when(plain, whole(F.array_join(groups, "")))
            .when((n == 2) & mark.isin(".", ","), decimal(first, last))
            .otherwise(F.concat(F.lit("literal:"), F.regexp_extract(run, "^[-+]?", 0), parts["text"]))
        )

    unsigned = F.regexp_replace(F.regexp_replace(run, "^[-+]", ""), "^(?=[.,])", "0")
    return let(let(unsigned, lambda u: F.struct(u.alias("text"), F.split(u, f"[{SEPARATORS}]").alias("groups"), F.regexp_extract_all(u, F.lit(f"[{SEPARATORS}]"), 0).alias("marks"))), read)


def literal_numbers(text: Column) -> Column:
    """Canonical forms of the numbers that are written in digits, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), 0), _canonical)


def word_numbers(tokens: Column) -> Column:
    """Canonical forms of the numbers that are written in words, in order: one pass over lower-cased tokens.

    A closed group of words (``two hundred``) grows in ``cur`` and goes to
    ``total`` with its scale (``thousand``). Numbers beyond 64 bits have no form.
    """
    digit = lambda t: t.rlike("[0-9]")
    number = lambda t: digit(t) | t.isin(*LINKS, *ATOMS, *FACTORS, *SCALES)
    of = lambda table, t: F.try_element_at(_table(table), t).cast("long")

    def state(total: Column, cur: Column, saw: bool, out: Column, skip: bool = False) -> Column:
        return F.struct(total.alias("total"), cur.alias("cur"), F.lit(saw).alias("saw"), F.lit(skip).alias("skip"), out.alias("out"))

    zero = F.lit(0).cast("long")
    closed = lambda s: F.array_append(s["out"], F.try_add(s["total"], s["cur"]).cast("string"))
    filled = lambda s: F.when(s["cur"] < 1, F.lit(1).cast("long")).otherwise(s["cur"])

    def step(s: Column, x: Column) -> Column:
        t = x["t"]
        return (
            F.when(s["skip"], F.struct(s["total"].alias("total"), s["cur"].alias("cur"), s["saw"].alias("saw"), F.lit(False).alias("skip"), s["out"].alias("out")))
            .when(t.isin(*LINKS) & s["saw"] & F.coalesce(number(x["next"]), F.lit(False)), s)
            .when((t == "quatre") & F.coalesce(x["next"].isin("vingt", "vingts"), F.lit(False)), state(s["total"], F.try_add(s["cur"], F.lit(80).cast("long")), True, s["out"], True))
            .when(t.isin(*FACTORS), state(s["total"], F.try_multiply(filled(s), of(FACTORS, t)), True, s["out"]))
            .when(t.isin(*SCALES), state(F.try_add(s["total"], F.try_multiply(filled(s), of(SCALES, t))), zero, True, s["out"]))
            .when(t.isin(*ATOMS), state(s["total"], F.try_add(s["cur"], of(ATOMS, t)), True, s["out"]))
            .when(s["saw"], state(zero, zero, False, closed(s)))
            .otherwise(s)
        )

    def fold(w: Column) -> Column:
        pairs = F.transform(w, lambda t, i: F.struct(t.alias("t"), F.get(w, i + 1).alias("next")))
        return F.aggregate(pairs, state(zero, zero, False, F.array().cast("array<string>")), step, lambda s: F.when(s["saw"], closed(s)).otherwise(s["out"]))

    none = ~F.arrays_overlap(tokens, F.array(*map(F.lit, [*ATOMS, *FACTORS, *SCALES])))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(let(tokens, fold), lambda v: v.isNotNull()))


def number_values(text: Column) -> Column:
    """Canonical forms of all numbers of a text: those in digits, then those in words; null for null."""
    return F.concat(literal_numbers(text), word_numbers(word_tokens(text)))


def meaningful(tokens: Column) -> Column:
    """Those of lower-cased words that have two bytes or more and are neither stop words nor part of a number, with repeats."""
    return F.filter(tokens, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP_WORDS, *LINKS, *ATOMS, *FACTORS, *SCALES) & ~t.rlike("[0-9]"))


def statement(text: Column) -> Column:
    """struct<words, numbers>: what ``holds`` compares of a claim and its evidence; both null for a null text."""
    return let(word_tokens(text), lambda t: F.struct(meaningful(t).alias("words"), F.concat(literal_numbers(text), word_numbers(t)).alias("numbers")))


def holds(claim: Column, evidence: Column) -> Column:
    """``supported`` for two statements, so that the evidence of many claims is read once."""

    def judged(both: Column) -> Column:
        w, b = both["claim"]["words"], both["words"]
        shared = F.size(F.filter(w, lambda t: F.array_contains(b, t)))
        turning = F.filter(w, lambda t: t.isin(*POLARITY))
        numbers = F.size(F.array_except(both["claim"]["numbers"], both["numbers"])) == 0
        return numbers & (F.size(w) > 0) & F.forall(turning, lambda t: F.array_contains(b, t)) & (3 * shared >= 2 * F.size(w))

    return let(F.struct(claim.alias("claim"), evidence["words"].alias("words"), evidence["numbers"].alias("numbers")), judged)


def supported(claim: Column, evidence: Column) -> Column:
    """Whether evidence holds all numbers and all polarity words of a claim, and two thirds of its meaningful words; false without any."""
    return let(statement(evidence), lambda base: holds(statement(claim), base))


def code_ranges(text: Column) -> Column:
    """array<struct<start, stop>>: the byte ranges of code spans and fences, in order; a fence or span without an end reaches to the end of the text."""

    def ranges(parts: Column) -> Column:
        pairs = F.zip_with(F.slice(parts["outside"], 1, F.size(parts["code"])), parts["code"], lambda o, c: F.struct(F.octet_length(o).alias("gap"), F.octet_length(c).alias("size")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
        place = lambda s, x: F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("stop"))
        return F.aggregate(pairs, none, lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(s["found"], place(s, x)).alias("found")), lambda s: s["found"])

    return let(F.struct(F.split(text, CODE).alias("outside"), F.regexp_extract_all(text, F.lit(CODE), 0).alias("code")), ranges)


def owns_chunk(chunk: Column, position: Column, start: Column, end: Column, page: Column, last_page: Column, content: Column) -> Column:
    """Whether recorded provenance can belong to a chunk: its position, a span as wide as its bytes, and pages in order."""
    pages = F.when(last_page.isNull(), True).otherwise(page.isNotNull() & (page <= last_page))
    return F.coalesce((position == chunk) & (start < end) & (end - start == F.octet_length(content)) & pages, F.lit(False))
