"""Column expressions that stay inside whole-stage code generation; no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, CharType, DataType, DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType, VarcharType

#: Cells that a text file's reader takes as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Tokens, trimmed and lower-cased, that stand for missing in cells.
MISSING_TOKENS = ["?", "na", "n/a", "n.a.", "nan", "null", "nil", "#n/a", "<na>", "n\\a"]
#: Spellings of booleans.
TRUE_WORDS, FALSE_WORDS = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Spellings of infinite numbers.
INFINITE = [s + w for s in ("", "+", "-") for w in ("inf", "infinity")]
#: Fixed pattern of date-like text: y-m-d, d-m-y with two or four digits of year, or eight digits, then anything after a blank.
DATE_LIKE = r"^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}\d{2}\d{2})(\s.*)?$"


def is_text(kind: DataType) -> bool:
    return isinstance(kind, (StringType, CharType, VarcharType))


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def is_datetime(kind: DataType) -> bool:
    return isinstance(kind, (TimestampType, TimestampNTZType, DateType))


def is_boolean(kind: DataType) -> bool:
    return isinstance(kind, BooleanType)


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def blank_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null: the library has one missing value. Infinities stay."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(named(c)), named(c)) for c in floats}) if floats else df


#: Fixed value: Unicode white space and the four separators of ASCII.
WHITE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Takes off all Unicode white space at both ends (``trim`` alone knows blanks only); looks at the ends, not at the whole text."""
    return F.btrim(c, F.lit(WHITE))


def lowered(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def without_tokens(c: Column, tokens: Iterable[str], exact: bool = False) -> Column:
    """Null where the cell is one of the tokens; compared trimmed and lower-cased unless ``exact``."""
    return F.when(~F.coalesce((c if exact else lowered(c)).isin(list(tokens)), F.lit(False)), c)


def to_number(c: Column) -> Column:
    """Text as a double; null where it is no plain number (a cast alone would take 1d or 1f)."""
    text = strip(c)
    plain = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.lower(text).isin(INFINITE), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(plain)


def to_boolean(c: Column, kind: DataType) -> Column:
    """Known spellings, and the numbers 0 and 1; null for all else."""
    if is_boolean(kind):
        return c
    if is_numeric(kind):
        return F.when(c == 1, True).when(c == 0, False)
    word = lowered(c)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def whole(c: Column) -> Column:
    """True where a finite number has no fraction."""
    x = c.cast("double")
    return F.coalesce((F.abs(x) < float("inf")) & (x % 1 == 0), F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    """Limits that leave null alone (``greatest`` and ``least`` would skip it)."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def right_closed_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin, the lowest edge included; null outside the edges."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")) | (c < edges[0]) | (c > edges[-1]), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(c <= edge, F.lit(label))
    return out


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of all keys in which missing equals missing."""
    out = F.lit(True)
    for k in keys:
        out = out & left["`" + k + "`"].eqNullSafe(right["`" + k + "`"])
    return out


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant, null below three values."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(corrected, F.lit(0.0)))


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Values replaced by a small map; others stay."""
    if not mapping:
        return c
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)
