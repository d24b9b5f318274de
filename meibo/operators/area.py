"""Compare a phone number's area code with the row's area or address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.functions.address import address_text
from meibo.functions.names import col, cols
from meibo.functions.text import digits, match_text
from meibo.operators.lookup import BROADCAST_MAX_BYTES, OWN, Sized, first_match, longest_prefix, lookup_join, prefix_search, prefixes, sized

# Japanese number ranges without a place (mobile, data, internet and pager numbers,
# toll-free, shared-cost, mass-call and premium services).
NO_AREA = "^(0[26789]0|050|0120|0800|0570|0180|0990)"

TEL, CODE, AREA, PLACE, SERVED = (OWN + c for c in ("tel", "code", "area", "place", "served"))


def code_table(ref: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> Sized:
    """The lookup table of a list with ``code`` and ``area``, or ``code`` and ``place``."""
    code = digits(F.col("code")).alias(CODE)
    area = match_text(F.col("area")).alias(AREA) if "area" in ref.columns else address_text(F.col("place")).alias(AREA)
    return sized(ref.select(code, area).where(col(CODE).isNotNull()).distinct(), max_bytes, CODE)


def _numbered(rows: DataFrame, tel: str, number: str | None) -> DataFrame:
    """Add the phone's digits, which the column ``number`` may have already."""
    return rows.withColumn(TEL, col(number) if number else digits(col(tel)))


def _coded(rows: DataFrame, tel: str, number: str | None, listed: Sized, max_bytes: int, staged: bool) -> DataFrame:
    """Add the phone's digits and the longest listed code that they begin with."""
    codes = listed.rows.select(col(CODE).alias("key"), CODE).distinct()
    keyed = _numbered(rows, tel, number)
    return first_match(keyed, [TEL], prefixes(col(TEL), listed.lengths), listed._replace(rows=codes), max_bytes, staged)


def _pairs(listed: Sized) -> Sized:
    return listed._replace(rows=listed.rows.where(col(AREA).isNotNull()).withColumn(SERVED, F.lit(True)))


def _unplaced():
    """The verdicts that the number alone decides."""
    return (
        F.when(col(TEL).isNull(), None)
        .when(col(CODE).isNull() & col(TEL).rlike(NO_AREA), "no_area")
        .when(col(CODE).isNull(), "unknown_code")
    )


def check_area_code(
    rows: DataFrame,
    tel: str,
    area: str,
    ref: DataFrame | Sized,
    verdict_col: str = "verdict",
    max_bytes: int = BROADCAST_MAX_BYTES,
    number: str | None = None,
    texts: dict[str, str] | None = None,
    staged: bool = False,
) -> DataFrame:
    """Add a verdict: ``ok``, ``mismatch``, ``unknown_code`` or ``no_area``; null for a blank phone.

    ``no_area`` is a number of a range that belongs to no place, such as mobile phones, unless the
    list holds its code.
    ``ref`` has ``code`` and ``area``; a code may serve several areas, and the longest code the
    phone begins with counts. A blank area never equals a listed one, so it is a mismatch. ``number`` names
    a column that has the phone's digits already, ``texts`` is as in :func:`~meibo.operators.rules.apply_rules`.
    ``staged`` says that ``rows`` are cheap to read more than once.
    """
    listed = ref if isinstance(ref, Sized) else code_table(ref, max_bytes)
    coded = _coded(rows, tel, number, listed, max_bytes, staged).withColumn(AREA, col(texts[area]) if area in (texts or {}) else match_text(col(area)))
    judged = lookup_join(coded, [CODE, AREA], _pairs(listed), max_bytes=max_bytes)
    verdict = _unplaced().when(col(SERVED), "ok").otherwise("mismatch")
    return judged.select(*cols(rows.columns), verdict.alias(verdict_col))


def check_area_of_address(
    rows: DataFrame,
    tel: str,
    address: str,
    ref: DataFrame | Sized,
    verdict_col: str = "verdict",
    max_bytes: int = BROADCAST_MAX_BYTES,
    number: str | None = None,
    staged: bool = False,
) -> DataFrame:
    """Compare a phone number with the place that the address begins with.

    ``ref`` has ``code`` and ``place``, a relation: a code serves several places, a place may have several
    codes. The longest listed code of the phone and the longest listed place of the address count,
    and the verdict is ``ok`` when the list holds the two together. Besides the verdicts of
    :func:`check_area_code` there is ``unknown_place``, for an address that begins with no listed place.
    """
    listed = ref if isinstance(ref, Sized) else code_table(ref, max_bytes)
    known = listed.rows.where(col(AREA).isNotNull())
    places = sized(known.select(col(AREA).alias("key"), col(AREA).alias(PLACE)).distinct(), max_bytes, "key")
    coded = _coded(rows, tel, number, listed, max_bytes, staged).withColumn(OWN + "address", address_text(col(address)))
    at = OWN + "address"
    placed = longest_prefix(coded, at, places, prefix_search(places, max_bytes), max_bytes)
    judged = lookup_join(placed.withColumn(AREA, col(PLACE)), [CODE, AREA], _pairs(listed), max_bytes=max_bytes)
    verdict = _unplaced().when(col(PLACE).isNull(), "unknown_place").when(col(SERVED), "ok").otherwise("mismatch")
    return judged.select(*cols(rows.columns), verdict.alias(verdict_col))


def phone_table(jobs: DataFrame, jobs_tel: str = "TEL", max_bytes: int = BROADCAST_MAX_BYTES) -> Sized:
    """The phone numbers of the job data, each once."""
    phones = jobs.select(digits(col(jobs_tel)).alias(TEL)).where(col(TEL).isNotNull()).distinct()
    return sized(phones.withColumn(OWN + "seen", F.lit(True)), max_bytes)


def corroborate(
    rows: DataFrame,
    tel: str,
    jobs: DataFrame | Sized,
    jobs_tel: str = "TEL",
    seen_col: str = "seen_in_jobs",
    max_bytes: int = BROADCAST_MAX_BYTES,
    number: str | None = None,
) -> DataFrame:
    """Add whether the phone number also stands in the job data. Evidence beside the verdict."""
    phones = jobs if isinstance(jobs, Sized) else phone_table(jobs, jobs_tel, max_bytes)
    keyed = _numbered(rows, tel, number)
    seen = lookup_join(keyed, [TEL], phones, "left", max_bytes)
    return seen.select(*cols(rows.columns), col(OWN + "seen").isNotNull().alias(seen_col))
