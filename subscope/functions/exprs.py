"""Column expressions shared by the reports. All built-in Spark expressions:
they stay inside whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def quoted(text: str | None) -> str:
    """A SQL string literal."""
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_case(x: str, arms: Sequence[tuple[str, object]]) -> str:
    """``CASE`` with one arm for each (condition on ``{}``, value)."""
    value = lambda v: v if isinstance(v, int) else quoted(v)
    return "CASE " + " ".join(f"WHEN {c.format(x)} THEN {value(v)}" for c, v in arms) + " END"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- fixed values that the results depend on -------------------------------
# Width of the padded contract key and its fill character.
KEY_WIDTH = 10
KEY_FILL = "0"
# Lower-case acute vowels folded by the district-name matcher, and their
# replacements (upper-case and other diacritics are deliberately kept).
ACCENTED = "áéíóú"
UNACCENTED = "aeiou"
# Bundle labels by owned products (broadband, TV, voice).
BUNDLE_3P = "3P"
BUNDLE_BB_TV = "2P - BB+TV"
BUNDLE_BB_VO = "2P - BB+VO"
BUNDLE_TV_VO = "2P - TV+VO"
BUNDLE_BB = "1P - BB"
BUNDLE_TV = "1P - TV"
BUNDLE_VO = "1P - VO"
# The same labels keyed by the owned-products code of ``bundle_code``
# (broadband 4 + TV 2 + voice 1); code 0 (nothing owned) has no label.
BUNDLE_BY_CODE = {7: BUNDLE_3P, 6: BUNDLE_BB_TV, 5: BUNDLE_BB_VO, 3: BUNDLE_TV_VO, 4: BUNDLE_BB, 2: BUNDLE_TV,
                  1: BUNDLE_VO, 0: None}
# Tenure bands: (inclusive upper bound in months, label); last label is open.
TENURE_14 = (
    (1, "1M"), (2, "1M-2M"), (3, "2M-3M"), (4, "3M-4M"), (5, "4M-5M"), (6, "5M-6M"),
    (7, "6M-7M"), (8, "7M-8M"), (9, "8M-9M"), (10, "9M-10M"), (11, "10M-11M"),
    (12, "11M-1Y"), (24, "1Y-2Y"), (None, "2Y+"),
)
TENURE_4 = ((6, "6M"), (12, "06-1Y"), (24, "1Y-2Y"), (None, "2Y+"))
TENURE_3 = ((3, "3M"), (6, "3M-6M"), (None, "6M+"))
# Month names used by the sales-cohort report, January first.
MONTH_NAMES_ES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)
# White space stripped around location names and numbers: ASCII and Unicode,
# the no-break space included.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
# What counts as a number: sign, digits with a point, exponent. Not Java's
# type suffixes (12d, 5f), nor Infinity or NaN.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Trend labels.
WENT_DOWN, SAME, WENT_UP = "WENT DOWN", "SAME", "WENT UP"
# Service-order values.
DISCONNECT = "DESINSTALACION"
CANCELLED, ANNULLED = "CANCELADA", "ANULADA"
NON_PAYMENT = "MOROSIDAD"
# ---------------------------------------------------------------------------


def pad_key(x: ColumnOrName) -> Column:
    """Rightmost ``KEY_WIDTH`` characters of the zero-prefixed key.

    Long ids lose their front characters, NULL stays NULL. Never ``lpad``,
    which truncates from the right.
    """
    return F.right(F.concat(F.lit(KEY_FILL * KEY_WIDTH), _c(x).cast("string")), F.lit(KEY_WIDTH))


def strip_acute_accents(x: ColumnOrName) -> Column:
    """Fold lower-case acute vowels only."""
    return F.translate(_c(x), ACCENTED, UNACCENTED)


def folded_upper(x: ColumnOrName) -> Column:
    """Catalogue name as matched against CRM codes: fold, then upper-case."""
    return F.upper(strip_acute_accents(x))


def bundle_flag(bb: ColumnOrName = "bb_product_id", tv: ColumnOrName = "tv_product_id",
                vo: ColumnOrName = "vo_product_id") -> Column:
    """Bundle label from which of the three products are present; NULL if none."""
    labels = F.array(*[F.lit(BUNDLE_BY_CODE[code]).cast("string") for code in range(8)])
    return labels[bundle_code(bb, tv, vo)]


# owned products of a CRM row as SQL (see ``bundle_code``)
BUNDLE_CODE = "int(bb_product_id IS NOT NULL) * 4 + int(tv_product_id IS NOT NULL) * 2 + int(vo_product_id IS NOT NULL)"


def bundle_code(bb: ColumnOrName = "bb_product_id", tv: ColumnOrName = "tv_product_id",
                vo: ColumnOrName = "vo_product_id") -> Column:
    """Owned products as one small integer (see ``BUNDLE_BY_CODE``). The
    aggregates that pivot by bundle compare this code instead of
    re-evaluating the label CASE once per slot."""
    return (
        _c(bb).isNotNull().cast("int") * 4 + _c(tv).isNotNull().cast("int") * 2 + _c(vo).isNotNull().cast("int")
    )


def sql_band(x: str, bands: Sequence[tuple[int | None, str]]) -> str:
    return sql_case(x, [("{} IS NOT NULL" if bound is None else f"{{}} <= {bound}", label) for bound, label in bands])


def _band(x: ColumnOrName, bands: Sequence[tuple[int | None, str]]) -> Column:
    if isinstance(x, str):
        return F.expr(sql_band(x, bands))
    expr = None
    for bound, label in bands:
        cond = x.isNotNull() if bound is None else (x <= bound)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def tenure_band_14(age: ColumnOrName) -> Column:
    """14 bands, upper bound inclusive; NULL age gives NULL."""
    return _band(age, TENURE_14)


def tenure_band_4(age: ColumnOrName) -> Column:
    return _band(age, TENURE_4)


def tenure_band_3(age: ColumnOrName) -> Column:
    return _band(age, TENURE_3)


def band_rank(label: ColumnOrName, bands: Sequence[tuple[int | None, str]] = TENURE_14) -> Column:
    """Calendar order of a tenure label (for display ordering only, T20)."""
    labels = ", ".join(quoted(name) for _, name in bands)
    return F.array_position(F.expr(f"array({labels})"), _c(label))


def sql_month_diff(later: str, earlier: str) -> str:
    return f"(year({later}) - year({earlier})) * 12 + month({later}) - month({earlier})"


def month_diff(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Calendar-month boundaries crossed from ``earlier`` to ``later`` (T3):
    Jan 31 -> Feb 1 is 1."""
    if isinstance(later, str) and isinstance(earlier, str):
        return F.expr(sql_month_diff(later, earlier))
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def month_start(d: ColumnOrName) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(_c(d), "MM")


def relative_change(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    """later / earlier - 1, NULL on a zero or NULL base."""
    return _c(later) / F.nullif(_c(earlier), F.lit(0.0)) - 1


def trend_label(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    a, b = _c(earlier), _c(later)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
        .when(a > b, WENT_DOWN)
        .when(a == b, SAME)
        .otherwise(WENT_UP)
    )


_NAMES_ES = "array(" + ", ".join(quoted(n) for n in MONTH_NAMES_ES) + ")"


def month_name_es(month: ColumnOrName) -> Column:
    return F.try_element_at(F.expr(_NAMES_ES), F.nullif(_c(month), F.lit(0)))


def month_number_es(name: ColumnOrName) -> Column:
    return F.array_position(F.expr(_NAMES_ES), _c(name))


def number_from_text(x: ColumnOrName) -> Column:
    """Text to DOUBLE, NULL on text that is not a number (``NUMBER`` after
    trimming; a plain cast would take ``12d`` for 12)."""
    t = trim_white(x)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def sql_trim_white(x: str) -> str:
    return f"btrim({x}, {quoted(WHITE_SPACE)})"


def trim_white(x: ColumnOrName) -> Column:
    """Strip all white space around a text (``trim`` strips blanks only)."""
    return F.btrim(_c(x), F.lit(WHITE_SPACE))


def round2(x: ColumnOrName) -> Column:
    """Half-up rounding to 2 decimals of the value's decimal form."""
    return F.round(_c(x), 2)


def status_kept(status: ColumnOrName = "status", strict: bool = False) -> Column:
    """Status filter of disconnect orders.

    The literal predicate ``status <> cancelled OR status <> annulled`` holds
    for every non-null status, so it reduces to ``IS NOT NULL``; ``strict``
    applies the evident intent instead.
    """
    s = _c(status)
    if strict:
        return (s != CANCELLED) & (s != ANNULLED)
    return s.isNotNull()


def cents(x: ColumnOrName) -> Column:
    """A rounded amount as a decimal: sums do not depend on their order."""
    return round2(x).cast("decimal(18,2)")


def net_recurring_charge() -> Column:
    """Sum over voice, broadband and TV of (charge - discount), in cents."""
    return cents(
        (F.col("vo_mrc") - F.col("vo_mrc_discount"))
        + (F.col("bb_mrc") - F.col("bb_mrc_discount"))
        + (F.col("tv_mrc") - F.col("tv_mrc_discount"))
    )


def billed_total() -> Column:
    """Voice bill (text, NULL/unparsable as 0) + broadband + TV bill, in
    cents. A NULL broadband or TV bill makes the total NULL."""
    return cents(F.coalesce(number_from_text("vo_billed_raw"), F.lit(0.0)) + F.col("bb_billed") + F.col("tv_billed"))
