"""Terms of a large catalog found in texts, at a cost that does not grow with the catalog.

The words of a text and its runs of up to as many words as the longest term has are looked up in the catalog by an
equi-join; the few terms that are met are then tried as patterns on the text itself, as word runs say nothing about the signs
between and around them. Texts are read once for their runs and once for the trial; they don't travel with their runs. A catalog that is
counted and small is broadcast; otherwise rows are joined by sorting, as their number is many times what the files' sizes tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import bound

#: Bytes of a catalog that is broadcast, with what a row takes beside its text.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 100


def word_runs(text: Column, longest: int) -> Column:
    """The distinct runs of one to ``longest`` words, joined by blanks, and the empty run."""

    def runs(words: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.array_distinct(F.concat(F.array(F.lit("")), *(F.when(F.size(words) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1))))

    return bound(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)), runs)


def term_pattern(term: Column) -> Column:
    """The term as it is, without regard to case, between word edges."""
    return F.concat(F.lit(r"\b\Q"), F.replace(F.lower(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def found_terms(texts: DataFrame, catalog: DataFrame, key: str = "id", text: str = "text", term: str = "term", place: str = "place") -> DataFrame:
    """``key`` and ``terms`` of every text: the catalog's terms found in it, by ``place``.

    Terms are told apart without regard to case as patterns, and come as the catalog writes them. A null text has no
    terms, a blank term is found nowhere; texts of one key are searched each for itself.
    """
    words = F.array_join(F.regexp_extract_all(F.lower(F.col(term)), F.lit(r"\w+"), F.lit(0)), " ")
    terms = catalog.where(F.trim(F.coalesce(F.col(term), F.lit(""))) != "").select(words.alias("_run"), F.struct(F.col(place).alias("place"), F.col(term).alias("term")).alias("_term"))
    longest, held = terms.agg(F.max(F.size(F.split("_run", " "))), F.sum(F.octet_length("_run") + F.octet_length("_term.term") + ROW_BYTES)).first()
    looked_up = F.broadcast(terms) if (held or 0) <= BROADCAST_BYTES else terms.hint("merge")
    runs = texts.select(F.col(key).alias("_key"), F.explode(word_runs(F.col(text), longest or 1)).alias("_run"))
    met = runs.join(looked_up, "_run").groupBy("_key").agg(F.collect_set("_term").alias("_terms"))  # no more than a text has runs, times equal terms
    tried = lambda low: F.transform(F.filter(F.array_sort("_terms"), lambda t: F.regexp_like(low, term_pattern(t["term"]))), lambda t: t["term"])
    found = bound(F.lower(F.col(text)), tried)
    return texts.hint("merge").join(met, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce(found, F.array().cast("array<string>")).alias("terms"))
