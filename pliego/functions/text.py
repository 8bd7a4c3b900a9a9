"""Column expressions for names, citations and clean-up. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pliego import constants as K


def strip(text: Column, blanks: str = K.PYTHON_BLANKS) -> Column:
    """Drop white space at both ends. Only the ends are looked at; a regular expression would try every position."""
    return F.btrim(text, F.lit(blanks))


def one_line(text: Column) -> Column:
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def clip(text: Column, limit: int) -> Column:
    """Texts over ``limit`` keep ``limit`` characters, the last three of them dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def file_name(source: Column) -> Column:
    named = clip(base_name(source), K.FILE_NAME_CHARS)
    return F.when(F.coalesce(source, F.lit("")) == "", F.lit(K.UNNAMED_DOCUMENT)).otherwise(named)


def page_known(page: Column) -> Column:
    text = page.cast("string")
    return text.isNotNull() & (text != "None")


def citation_name(name: Column) -> Column:
    plain = F.replace(F.replace(name, F.lit(".pdf")), F.lit(".txt"))
    words = F.transform(
        F.split(plain, "_"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1))),
    )
    unknown = F.coalesce(name, F.lit("")).isin("", K.UNKNOWN_DOCUMENT)
    return F.when(unknown, F.lit(K.UNKNOWN_DOCUMENT)).otherwise(F.array_join(words, " "))


def citation(name: Column, page: Column) -> Column:
    shown = citation_name(name)
    return F.when(page_known(page), F.concat(shown, F.lit(" (página "), page.cast("string"), F.lit(")"))).otherwise(shown)


def source_annotation(name: Column, page: Column) -> Column:
    shown = F.coalesce(name, F.lit("None"))
    where = F.when(page_known(page), F.concat(F.lit(", página "), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("[Fuente: "), shown, where, F.lit("]"))


def fill(template: str, **values: Column) -> Column:
    """Put columns into the named places of a text template, each name used once and in the order given."""
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))
