"""Normalisation of raw extracts into the declared inputs (operators S4b-S4h).

The source extracts were cleaned by hand before loading: quotes masked and
restored, free-text columns replaced by a
presence flag and a length, sentinel texts recoded, ages given in weeks
recoded and timestamps reformatted.  A value or column that cannot be read fails the job by default.  These functions do the same to a raw
DataFrame, column by column, with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxlens import schemas

# Fixed values of the source extracts.
QUOTE_MASK = "%-&-%"
HCC_SENTINEL = "Deleted 2014"
AGE_TEXT = {"2 WEEKS": 0.5, "3 WEEKS": 0.75}
TIMESTAMP_FORMAT = "yyyy-MM-dd[ HH:mm:ss]"


# Escapes of the bulk-load text format (fixed values): letter and the byte it stands for, in hexadecimal.
ESCAPES = {"b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B"}


def copy_text_unescape(col: str | Column) -> Column:
    r"""Decode the backslash escapes of the bulk-load text format.

    ``\b \f \n \r \t \v``, up to three octal digits, ``\x`` with up to two
    hexadecimal digits; any other escaped character stands for itself.  Numeric escapes are bytes
    of the UTF-8 text.  A text without a backslash is passed on untouched.
    """
    c = F.col(col) if isinstance(col, str) else col
    parts = F.regexp_extract_all(c, F.lit(r"(\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\[\s\S]|[^\\]+|\\$)"), F.lit(1))

    def as_hex(part: Column) -> Column:
        body = F.substring(part, 2, 10)
        plain = F.hex(F.encode(F.when(part.startswith("\\") & (F.length(part) > 1), body).otherwise(part), "UTF-8"))
        out = F.when(part.rlike(r"^\\x[0-9A-Fa-f]"), F.lpad(F.substring(part, 3, 2), 2, "0"))
        out = out.when(part.rlike(r"^\\[0-7]"), F.lpad(F.conv(F.conv(body, 8, 10).cast("int") % 256, 10, 16), 2, "0"))
        for letter, byte in ESCAPES.items():
            out = out.when(part == F.lit("\\" + letter), F.lit(byte))
        return out.otherwise(plain)

    decoded = F.decode(F.unhex(F.array_join(F.transform(parts, as_hex), "")), "UTF-8")
    return F.when(F.contains(c, F.lit("\\")), decoded).otherwise(c)


def restore_quotes(df: DataFrame, col: str = "term", mask: str = QUOTE_MASK) -> DataFrame:
    """Put back the ``"`` characters an export replaced by ``mask``."""
    return df.withColumn(col, F.replace(F.col(col), F.lit(mask), F.lit('"')))


def shorten(col: str | Column, max_len: int) -> Column:
    """Cut a text to fewer than ``max_len`` characters, keeping a trailing ``(...)`` tag.

    Strings have no limit here, so nothing calls this by default; it serves exports to systems that have one.
    """
    c = F.col(col) if isinstance(col, str) else col
    tag = F.regexp_extract(c, r"\s*\([^()]*\)$", 0)
    cut = F.concat(F.substring(c, F.lit(1), F.lit(max_len - 1) - F.length(tag)), tag)
    return F.when(F.length(c) >= max_len, F.when(F.length(tag) < max_len, cut).otherwise(F.substring(c, 1, max_len - 1))).otherwise(c)


def presence_flag(col: str | Column) -> Column:
    """1 when the cell holds any text, white space included, 0 for an empty one."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | (c == ""), 0).otherwise(1)


def text_length(col: str | Column) -> Column:
    """Length of the text, 0 for a missing one."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.length(c), F.lit(0))


def _checked(value: Column, text: Column, what: str, strict: bool) -> Column:
    """``value``; a text that gave none fails the job (``strict``) or becomes NULL."""
    if not strict:
        return value
    bad = text.isNotNull() & (F.trim(text) != "") & value.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: "), text))).otherwise(value)


def recode_hcc(col: str | Column, sentinel_value: float | None = 0.0, strict: bool = True) -> Column:
    """Decimal(4,3) score; the ``Deleted 2014`` sentinel becomes ``sentinel_value``.

    Problem-list scores used 0, billing scores dropped the value (``None``).
    Text that is no number or too wide for decimal(4,3) fails the job unless ``strict`` is off (then NULL).
    """
    c = F.col(col) if isinstance(col, str) else col
    text = F.trim(c.cast("string"))
    parsed = text.try_cast("decimal(20,6)")
    value = F.when(F.abs(parsed) < 9.9995, parsed.cast("decimal(4,3)"))
    sentinel = F.lit(sentinel_value).cast("decimal(4,3)")
    return F.when(text == HCC_SENTINEL, sentinel).otherwise(_checked(value, text, "not a score", strict))


def recode_age(col: str | Column, strict: bool = True) -> Column:
    """Age in years as double; ages given in weeks are recoded; other texts fail the job or, not ``strict``, are NULL."""
    c = F.upper(F.trim((F.col(col) if isinstance(col, str) else col).cast("string")))
    value = c.try_cast("double")
    for text, years in AGE_TEXT.items():
        value = F.when(c == text, F.lit(years)).otherwise(value)
    return _checked(value, c, "not an age", strict)


def to_ntz(col: str | Column, fmt: str = TIMESTAMP_FORMAT, strict: bool = True) -> Column:
    """Parse a timestamp text into ``timestamp_ntz``; one that does not parse fails the job or, not ``strict``, is NULL."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return _checked(F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"), c, "not a timestamp", strict)


PROBLEM_TIMES = ("admitdate", "noteddate", "entrydate", "deldate", "resoldate")
DISCHARGE_TIMES = ("admitdate", "dischdate", "readmit")


def _prepared(raw: DataFrame, schema, recoded: dict[str, Column], times: tuple[str, ...], fmt: str,
              may_be_absent: tuple[str, ...], strict: bool) -> DataFrame:
    missing = [f.name for f in schema.fields if f.name not in raw.columns and f.name not in recoded]
    unexpected = sorted(set(missing) - set(may_be_absent))
    if unexpected:
        raise ValueError(f"extract lacks {', '.join(unexpected)}; name columns that may be missing in may_be_absent")
    cols = []
    for f in schema.fields:
        if f.name in recoded:
            value = recoded[f.name]
        elif f.name in missing:
            value = F.lit(None).cast(f.dataType)
        else:
            value = to_ntz(f.name, fmt, strict) if f.name in times else F.col(f.name)
        cols.append(value.alias(f.name))
    return schemas.conform(raw.select(cols), schema)


def prepare_problem_extract(raw: DataFrame, fmt: str = TIMESTAMP_FORMAT, may_be_absent: tuple[str, ...] = (),
                            strict: bool = True) -> DataFrame:
    """Raw problem-list extract -> ``pldata``.

    ``probdesc`` and ``overview`` arrive as free text: they become presence
    flags, ``overview`` also its length ``overlen``; the texts are dropped.  A missing column fails
    unless ``may_be_absent`` names it (then NULL); bad values fail unless ``strict`` is off.
    """
    recoded = {"probdesc": presence_flag("probdesc"), "overview": presence_flag("overview"),
               "overlen": text_length("overview")}
    if "phcc" in raw.columns:
        recoded["phcc"] = recode_hcc("phcc", 0.0, strict)
    return _prepared(raw, schemas.PLDATA, recoded, PROBLEM_TIMES, fmt, may_be_absent, strict)


def prepare_discharge_extract(raw: DataFrame, fmt: str = TIMESTAMP_FORMAT, may_be_absent: tuple[str, ...] = (),
                              strict: bool = True) -> DataFrame:
    """Raw discharge extract -> ``disch`` (ages in weeks recoded); missing columns and bad values as above."""
    recoded = {"pt_age": recode_age("pt_age", strict)} if "pt_age" in raw.columns else {}
    return _prepared(raw, schemas.DISCH, recoded, DISCHARGE_TIMES, fmt, may_be_absent, strict)


def prepare_billing_extract(raw: DataFrame, may_be_absent: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Raw billing extract -> ``billdata`` (deleted scores become NULL); missing columns and bad values as above."""
    recoded = {"bhcc": recode_hcc("bhcc", None, strict)} if "bhcc" in raw.columns else {}
    return _prepared(raw, schemas.BILLDATA, recoded, (), TIMESTAMP_FORMAT, may_be_absent, strict)


def prepare_terms(descr: DataFrame, mask: str | None = QUOTE_MASK) -> DataFrame:
    """Restore masked quotes; terms keep their whole length and so their semantic tag."""
    return restore_quotes(descr, "term", mask) if mask else descr
