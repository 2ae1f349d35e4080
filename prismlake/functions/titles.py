"""Sample titles and group keys: pure string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismlake.functions.rowlocal import bound

#: The title format. CODE-DD-MM-YYYY[-AD-{A,M,S}-PCT%]-T{1,2,3}: outer blanks, underscores for
#: the hyphens before date, AD and T, no separator before T, T_1 for T1 and a doubled percent sign are read too.
TITLE = r"^\s*([A-Z]{2,4})[-_](\d{2}-\d{2}-\d{4})(?:[-_]AD-([AMS])-(\d+(?:[.,]\d+)?)%%?)?[-_]?T_?([123])\s*$"


def parse_title(title: Column) -> dict[str, Column]:
    """code, date, adulterant, content, replicate, valid and group_id of a title; nulls where it doesn't fit.

    The content is percent with comma or dot; an adulterated title of content 0 or less is invalid. The group
    is code and date, of an adulterated sample also its letter and its content with two decimals."""
    got = lambda k: F.nullif(F.regexp_extract(title, TITLE, k), F.lit(""))
    content = F.regexp_replace(got(4), ",", ".").cast("double")
    valid = F.coalesce(got(1).isNotNull() & (got(3).isNull() | (content > 0)), F.lit(False))
    pick = lambda c: F.when(valid, c)
    key = F.concat_ws("-", got(1), got(2), F.when(got(3).isNotNull(), F.concat(got(3), F.format_string("%.2f", content))))
    return {"code": pick(got(1)), "date": pick(got(2)), "adulterant": pick(got(3)), "content": pick(content), "replicate": pick(got(5).cast("int")), "valid": valid, "group_id": pick(key)}


def group_key(title: Column) -> Column:
    """The group_id of parse_title alone, by one match: the title's parts are bound once."""
    mark = "\x01"
    split = lambda t: F.split(F.regexp_replace(t, TITLE, mark.join(f"${k}" for k in range(1, 6))), mark)

    def key(p: Column) -> Column:
        content = F.regexp_replace(p[3], ",", ".").cast("double")
        return F.when(p[2] == "", F.concat_ws("-", p[0], p[1])).when(content > 0, F.concat_ws("-", p[0], p[1], F.concat(p[2], F.format_string("%.2f", content))))

    # a title that doesn't fit is not replaced, and one that holds the mark doesn't fit
    return bound(title, lambda t: F.when(~F.contains(t, F.lit(mark)), bound(split(t), lambda p: F.when(F.size(p) == 5, key(p)))))


def adulterant_of(group_id: Column) -> Column:
    """The letter of the last token of a group key, if it is one of A, M, S followed by a digit."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(group_id, "-"), -1), r"^([AMS])\d", 1), F.lit(""))


def content_from_name(name: Column) -> Column:
    """The first `N,NN %` (or N.NN%) of a file name as a number."""
    return F.regexp_replace(F.nullif(F.regexp_extract(name, r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit("")), ",", ".").cast("double")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def normal_label(text: Column) -> Column:
    """Labels of file records compare without space, hyphen, underscore and slash, in upper case."""
    return F.upper(F.regexp_replace(text, r"[\s\-_/]", ""))


def metric_in(text: Column, name: str) -> Column:
    """The number after `name:` or `name =` at the start of a line of a summary, whatever the case."""
    return F.nullif(F.regexp_extract(text, rf"(?im)^\s*{name}\s*[:=]\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double")
