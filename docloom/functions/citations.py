"""Citation markers, claims and their support by evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.functions.claims import CODE, let


def markers(answer: Column, chunks: Column) -> Column:
    """Distinct marker numbers outside of code, in order of appearance, from 1 to the number of chunks."""
    found = F.regexp_extract_all(F.regexp_replace(answer, CODE, ""), F.lit(r"\[(\d{1,6})\]"), 1)
    return F.filter(F.array_distinct(F.transform(found, lambda x: x.cast("int"))), lambda n: (n >= 1) & (n <= chunks))


#: The sentences that say that nothing was found.
ABSTENTIONS = [
    "Aucune source n'est disponible dans ce notebook.",
    "Les sources disponibles ne permettent pas de répondre avec suffisamment de confiance.",
    "No source is available in this notebook.",
    "The available sources do not support a confident answer.",
    "In diesem Notizbuch ist keine Quelle verfügbar.",
    "Die verfügbaren Quellen erlauben keine hinreichend sichere Antwort.",
    "No hay ninguna fuente disponible en este cuaderno.",
    "Las fuentes disponibles no permiten responder con suficiente confianza.",
    "no source was retrieved",
]
MARK = r"\[(\d{1,18})\]"


def abstains(answer: Column) -> Column:
    """Whether an answer holds one of the documented sentences, in any case."""
    found = let(F.lower(answer), lambda low: F.exists(F.array(*map(F.lit, (s.lower() for s in ABSTENTIONS))), lambda s: F.contains(low, s)))
    return F.coalesce(found, F.lit(False))


def _unfinished(prefix: Column) -> Column:
    """What follows the last line end, ! or ?, or full stop that is no decimal point."""
    return F.regexp_extract(prefix, r"(?s)^(?:.*(?:[\n!?]|(?<![0-9])\.|\.(?![0-9])))?(.*)$", 1)


def _bare(claim: Column) -> Column:
    """Without list marks and outer blanks."""
    return F.regexp_replace(F.regexp_replace(claim, r"^\s*(?:[-*] )?\s*[:;]*\s*", ""), r"\s+$", "")


def preceding_claim(prefix: Column) -> Column:
    """What follows the last line end, ! or ?, or full stop that is no decimal point; without list marks and outer blanks."""
    return _bare(_unfinished(prefix))


def hide_code(answer: Column) -> Column:
    """The answer with the brackets of its code spans and fences changed, so that these hold no markers."""
    outside = F.split(answer, CODE)
    inside = F.transform(F.regexp_extract_all(answer, F.lit(CODE), 0), lambda c: F.translate(c, "[", "\u0001"))
    return F.array_join(F.zip_with(outside, inside, lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), "")


def located_markers(answer: Column) -> Column:
    """array<struct<n, claim>>: the markers outside of code in their order, each with the claim before it.

    One pass over the pieces between markers: only what is unfinished at one
    marker can be part of the claim of the next.
    """

    def located(parts: Column) -> Column:
        pieces, numbers = parts["pieces"], parts["numbers"]
        added = F.transform(numbers, lambda _, i: F.when(i == 0, pieces[0]).otherwise(F.concat(F.lit("["), F.get(numbers, i - 1), F.lit("]"), F.get(pieces, i))))
        open_ = F.aggregate(added, F.array().cast("array<string>"), lambda seen, x: F.array_append(seen, _unfinished(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")), x))))
        return F.zip_with(numbers, open_, lambda n, x: F.struct(n.cast("bigint").alias("n"), _bare(x).alias("claim")))

    return let(let(hide_code(answer), lambda shown: F.struct(F.split(shown, MARK).alias("pieces"), F.regexp_extract_all(shown, F.lit(MARK), 1).alias("numbers"))), located)


def marker_places(answer: Column) -> Column:
    """array<struct<n, start, stop>>: markers outside of code with the characters before them and up to their end."""
    shown = hide_code(answer)
    pieces, found = F.split(shown, MARK), F.regexp_extract_all(shown, F.lit(MARK), 0)
    sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), F.regexp_extract(m, MARK, 1).cast("bigint").alias("n")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<n:bigint,start:int,stop:int>>").alias("found"))

    def add(s: Column, x: Column) -> Column:
        stop = s["at"] + x["gap"] + x["size"]
        return F.struct(stop.alias("at"), F.array_append(s["found"], F.struct(x["n"].alias("n"), (s["at"] + x["gap"]).alias("start"), stop.alias("stop"))).alias("found"))

    return F.aggregate(sizes, none, add, lambda s: s["found"])
