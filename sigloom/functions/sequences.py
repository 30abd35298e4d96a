"""Column functions over sequence text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet, the base-4 digit of each letter, and the corner of
# the chaos-game square each letter owns: A(0,0) C(0,1) G(1,1) T(1,0).
ALPHABET = "ACGT"
DIGITS = "0123"
ROW_BITS = "0011"
COL_BITS = "0110"

MAX_K = 32

_HEADER_START = r"(?md)^(?=[ \t\r\f\x0b]*>)"
_BLANK_LINES = "\n\\s*\n"
_HEADER_LINE = "^\\s*(>[^\n]*)"


def check_k(k: int) -> int:
    """Word lengths run from 1 to 32."""
    if not 1 <= int(k) <= MAX_K:
        raise ValueError(f"k must lie in 1..{MAX_K}, got {k}")
    return int(k)


def sanitize(seq: Column | str, keep_other_letters: bool = False) -> Column:
    """Delete everything outside upper-case ``ACGT``; letters around a gap become adjacent."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return col if keep_other_letters else F.regexp_replace(col, f"[^{ALPHABET}]+", "")


def fasta_header(record: Column | str) -> Column:
    """Header line of one record, with its ``>``; null for a record without one."""
    col = F.col(record) if isinstance(record, str) else record
    line = F.regexp_replace(F.regexp_extract(col, _HEADER_LINE, 1), r"\s+$", "")
    return F.when(line != "", line)


def _body(record: Column) -> Column:
    return F.regexp_replace(record, "^\\s*>[^\n]*\n?", "")


def fasta_sequence(record: Column | str, keep_other_letters: bool = False) -> Column:
    """Lines of one record, stripped and concatenated; null when it has no line at all."""
    col = F.col(record) if isinstance(record, str) else record
    body = _body(col)
    if keep_other_letters:
        text = F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), "\\s*\n\\s*", "")
    else:
        text = sanitize(body)
    return F.when(body.rlike(r"\S"), text)


def fasta_records(content: Column | str, keep_other_letters: bool = False) -> Column:
    """Whole FASTA text as ``array<struct<header, seq>>``, in file order.

    A header line and a blank line both end the current record.
    """
    col = F.col(content) if isinstance(content, str) else content
    by_header = F.split(col, _HEADER_START)
    pieces = F.flatten(F.transform(by_header, lambda part: F.split(part, _BLANK_LINES)))
    records = F.transform(
        pieces,
        lambda piece: F.struct(
            fasta_header(piece).alias("header"),
            fasta_sequence(piece, keep_other_letters).alias("seq"),
        ),
    )
    return F.filter(records, lambda record: record["seq"].isNotNull())


def kmer_code(kmer: Column | str, k: int) -> Column:
    """Base-4 number of a k-mer, first letter most significant (``k <= 31``)."""
    if not 1 <= k <= 31:
        raise ValueError("a BIGINT holds codes of up to 31 letters")
    col = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.conv(F.translate(col, ALPHABET, DIGITS), 4, 10).cast("bigint")


def cgr_cell(kmer: Column | str, k: int) -> Column:
    """Cell of a k-mer in the 2^k x 2^k chaos-game grid: ``struct<row, col, idx>``.

    The last letter picks the quadrant, the one before it the sub-quadrant, and
    so on. ``idx`` is the row-major position; at k = 32 it is the signed 64-bit
    pattern of that number.
    """
    check_k(k)
    col = F.col(kmer) if isinstance(kmer, str) else kmer
    backwards = F.reverse(col)
    row = F.conv(F.translate(backwards, ALPHABET, ROW_BITS), 2, 10).cast("bigint")
    column = F.conv(F.translate(backwards, ALPHABET, COL_BITS), 2, 10).cast("bigint")
    idx = F.shiftleft(row, k).bitwiseOR(column)
    return F.struct(row.alias("row"), column.alias("col"), idx.alias("idx"))


def ordinal_name(number: Column | str) -> Column:
    """``%010d.fasta`` name of a numbered sample."""
    col = F.col(number) if isinstance(number, str) else number
    digits = col.cast("string")
    padded = F.when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0"))
    return F.concat(padded, F.lit(".fasta"))
