"""Names, tokens and similarity. The four ways of normalising a name differ on purpose; each is named by its use."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def squashed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def compatible(rows: DataFrame, column: str) -> DataFrame:
    """rows with column in compatibility form (NFKC), for texts that hold full-width letters, ligatures and the like.

    Only different texts beyond plain Latin and Cyrillic go through Python, once each; the rest are as they are.
    """
    odd = rows.select(column).where(F.col(column).rlike(r"[^\x00-\x7f\u0400-\u045f]")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({column: batch[column], "_plain": [unicodedata.normalize("NFKC", t) for t in batch[column]]})

    made = odd.mapInPandas(run, f"{column} string, _plain string")
    return rows.join(made, column, "left").withColumn(column, F.coalesce("_plain", column)).select(*rows.columns)


def stripped(c: Column) -> Column:
    """Without blanks of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: What compatibility forms can't change.
PLAIN = r"^[\x00-\x7f\u0400-\u045f]*$"


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def folded(c: Column) -> Column:
    """In compatibility form (NFKC). Plain texts are as they are; only others travel to Python, which columns can't replace."""
    odd = ~c.rlike(PLAIN)
    return F.when(odd, _compatible(F.when(odd, c))).otherwise(c)


def answered_name(c: Column) -> Column:
    """For names that places answer to: compatibility form, lower case, anything but Latin and Cyrillic letters and digits a space."""
    return F.trim(F.regexp_replace(F.lower(folded(c)), "[^0-9a-zа-яёіў]+", " "))


def matched_name(c: Column) -> Column:
    """For matching stops: also one letter folded, punctuation a space."""
    return squashed(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[^\p{L}\p{N}\s]+", " "))


def title_name(c: Column) -> Column:
    """For article titles: without what stands in parentheses."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), r"[^\p{L}\p{N}]+", " "))


def territory_name(c: Column) -> Column:
    """For exact territory names: punctuation removed, not replaced."""
    return squashed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]+", ""))


def keyword_tokens(c: Column) -> Column:
    """Words of three letters or more, digits may follow; distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([а-яёa-z]{3,}\d*)"), F.lit(1)))


def alias_tokens(c: Column) -> Column:
    """Words of two letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([а-яёa-z]{2,})"), F.lit(1)))


def ordered_trigrams(c: Column) -> Column:
    """Trigrams of each word, padded by two blanks in front and one behind, in order."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams."""
    return jaccard(F.array_distinct(ordered_trigrams(a)), F.array_distinct(ordered_trigrams(b)))


def word_similarity(a: Column, b: Column) -> Column:
    """The greatest similarity of a's trigrams with those of any run of b's ordered trigrams.

    A best run begins with a shared trigram. From each of these one pass counts different trigrams and shared ones as the
    run grows: a trigram is new to a run that began after its last place. So a pair takes shared x all steps.
    """

    def best(own: Column, other: Column) -> Column:
        def mark(g: Column, p: Column) -> Column:
            back = F.array_position(F.reverse(F.slice(other, F.lit(1), p)), g)
            return F.struct(F.array_contains(own, g).alias("hit"), F.when(back > 0, p - back).otherwise(F.lit(-1).cast("long")).cast("long").alias("last"))

        def grow(s: Column, m: Column, i: Column) -> Column:
            new = m["last"] < i
            all_, both = s["all"] + new.cast("int"), s["both"] + (new & m["hit"]).cast("int")
            return F.struct(all_.alias("all"), both.alias("both"), F.greatest(s["best"], both / (F.size(own) + all_ - both)).alias("best"))

        def from_each(marks: Column) -> Column:
            start = F.struct(F.lit(0).alias("all"), F.lit(0).alias("both"), F.lit(0.0).alias("best"))
            tried = F.transform(marks, lambda m, i: F.when(m["hit"], F.aggregate(F.slice(marks, i + 1, F.size(marks) - i), start, lambda s, x: grow(s, x, i), lambda s: s["best"])).otherwise(0.0))
            return F.coalesce(F.array_max(tried), F.lit(0.0))

        return F.element_at(F.transform(F.array(F.transform(other, mark)), from_each), 1)

    own, other = F.array_distinct(ordered_trigrams(a)), ordered_trigrams(b)
    both = F.array(F.struct(own.alias("own"), other.alias("other")))
    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(F.transform(both, lambda x: best(x["own"], x["other"])), 1))


def script_of(c: Column) -> Column:
    """ru, en, mixed or unknown."""
    ru, en = c.rlike("[А-Яа-яЁё]"), c.rlike("[A-Za-z]")
    return F.when(ru & en, "mixed").when(ru, "ru").when(en, "en").otherwise("unknown")


def without_markup(c: Column) -> Column:
    """Tags and addresses removed; a text said twice is said once."""
    plain = squashed(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"https?://\S+", " "))
    half = (F.length(plain) - 1) / 2
    first = F.substring(plain, F.lit(1), half.cast("int"))
    second = F.substring(plain, (half + 2).cast("int"), half.cast("int"))
    twice = (F.length(plain) % 2 == 1) & (F.length(plain) > 2) & (first == second)
    return F.when(twice, first).otherwise(plain)


def email(c: Column) -> Column:
    """Trimmed and lower-cased; null if it isn't an address."""
    own = F.lower(F.trim(c))
    return F.when(own.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), own)


def embedded_text(name: Column, category: Column, town: Column) -> Column:
    """What a place's vector is made from: its non-empty parts, each closed by a full stop."""
    parts = F.filter(F.array(name, category, town), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit(".")))


def has_fragment(text: Column, fragment: Column) -> Column:
    """Whether the fragment stands in the text, case and blanks aside."""
    return F.contains(F.lower(squashed(text)), F.lower(squashed(fragment)))


def names_agree(a: Column, b: Column) -> Column:
    """Equal, or one contains the other."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | F.contains(x, y) | F.contains(y, x)


def capped(c: Column, n: int = 240) -> Column:
    """At most so many characters; null if empty."""
    cut = F.substring(F.trim(c), 1, n)
    return F.when(cut != "", cut)


def blank_to_null(c: Column) -> Column:
    own = F.trim(c)
    return F.when(own != "", own)


def duration(minutes: Column) -> Column:
    """``2 h 05 min`` or ``45 min``."""
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.when(minutes >= 60, F.format_string("%d h %02d min", h, m)).otherwise(F.format_string("%d min", m))


def parts(c: Column, separator: str) -> Column:
    """Split at a literal separator, trimmed, empty parts dropped."""
    quoted = "".join(f"\\{x}" if not x.isalnum() else x for x in separator)
    return F.filter(F.transform(F.split(c, quoted), lambda x: F.trim(x)), lambda x: x != "")


def generated_label(name: Column, labels: list[str]) -> Column:
    """Whether the name is a known label, with or without something in parentheses."""
    return F.lower(F.trim(F.substring_index(name, "(", 1))).isin([x.lower() for x in labels])


def first_facts(c: Column, n: int = 3) -> Column:
    """From a JSON array of texts, or texts between bars."""
    return F.slice(F.coalesce(F.from_json(c, "array<string>"), parts(c, "|")), 1, n)


def first_links(c: Column, n: int = 4) -> Column:
    """struct(title, url) from a JSON array of objects, or from ``title | url``."""
    listed = F.from_json(c, "array<struct<title:string,url:string>>")
    pair = F.array(F.struct(F.trim(F.substring_index(c, "|", 1)).alias("title"), F.trim(F.substring_index(c, "|", -1)).alias("url")))
    return F.slice(F.coalesce(listed, F.when(F.contains(c, F.lit("|")), pair)), 1, n)
