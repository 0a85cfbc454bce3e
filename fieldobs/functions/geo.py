"""Coordinates: sexagesimal parsing, bounding boxes, grid cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldobs.functions.rounding import js_round, pg_round

# Fixed value: the element of a profile page that holds the coordinates.
COORDINATE_ELEMENT = "profile-coordinates"
# A hemisphere letter that stands by itself.
HEMISPHERE = "(?<![A-Za-z])[NSEW](?![A-Za-z])"


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, hemi: Column) -> Column:
    """Decimal degrees to five digits; south and west are negative."""
    size = deg + minutes / 60.0 + seconds / 3600.0
    return js_round(F.when(hemi.isin("S", "W"), -size).otherwise(size), 5)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def element_text(html: Column, element_id: str) -> Column:
    """What stands between the tag with the id and the end of that element, tags left out; else null."""
    sign = f'id="{element_id}"'

    def inner(after: Column) -> Column:
        inside = F.substring_index(after, "</div>", 1)
        text = F.regexp_replace(F.regexp_replace(inside, "^[^>]*>", ""), "<[^>]*>", " ")
        return F.when(F.instr(after, "</div>") > 0, text)

    return F.when(F.instr(html, sign) > 0, _let(F.substring_index(html, sign, -1), inner))


def numbers_in(text: Column) -> Column:
    """The plain decimal numbers of a text, in order."""
    parts = F.split(F.regexp_replace(text, "[^0-9.]+", " "), " ")
    return F.filter(F.transform(parts, lambda p: p.try_cast("double")), lambda x: x.isNotNull())


def sexagesimal(term: Column, hemisphere: Column) -> Column:
    """Degrees of a term that ends with degrees, minutes and seconds; null with fewer than three numbers."""
    return _let(numbers_in(term), lambda values: F.when(F.size(values) >= 3, dms_to_decimal(
        *[F.get(values, F.size(values) - F.lit(3 - i)) for i in range(3)], hemisphere)))


def page_coordinates(html: Column) -> Column:
    """Struct (latitude, longitude) of a profile page; null unless both terms are there.

    Character references are blanks to us: none of them is a digit or a hemisphere letter of
    the value. A term is what leads up to a hemisphere letter.
    """
    def both_terms(text: Column) -> Column:
        letters, terms = F.regexp_extract_all(text, F.lit(HEMISPHERE), F.lit(0)), F.split(text, HEMISPHERE)
        return F.array(*[sexagesimal(F.get(terms, F.lit(i)), F.get(letters, F.lit(i))) for i in (0, 1)])

    text = F.regexp_replace(element_text(html, COORDINATE_ELEMENT), "&[^;]*;", " ")
    return _let(_let(text, both_terms), lambda d: F.when(
        d[0].isNotNull() & d[1].isNotNull(), F.struct(d[0].alias("latitude"), d[1].alias("longitude"))))


def bounding_box(latitude: Column, longitude: Column, reach: float = 0.02) -> Column:
    """"west,south,east,north" around a point, five digits each."""
    edges = [longitude - reach, latitude - reach, longitude + reach, latitude + reach]
    fixed = [pg_round(e, 5).cast("decimal(12,5)").cast("string") for e in edges]
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.concat_ws(",", *fixed))


def grid_cell(coordinate: Column, step: float) -> Column:
    return F.floor(coordinate / F.lit(step)).cast("int")
