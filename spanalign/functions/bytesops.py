"""Column functions over raw bytes: offsets are byte offsets, text is UTF-8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanalign.functions import scans

# Fixed values of the model-free score series: bytes after which a score is high, and its numbers.
SEPARATORS = " \n\t()[]{};,.:="
HIGH, LOW, STEP, MODULUS = 2.0, 0.4, 2654435761, 97


def byte_length(text) -> Column:
    return F.octet_length(text).cast("long")


def keyed_hash(*parts) -> Column:
    """Hex SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws(chr(0), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hash32(hexdigest: Column) -> Column:
    """The first eight hex digits as a number."""
    return F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("long")


def pieces(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every match of a pattern of ASCII classes: key, idx, start_byte, end_byte, piece; none for a null text."""
    return scans.scan(docs, key, text, scans.matches(pattern), "idx bigint, start_byte bigint, end_byte bigint, piece string")


IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_NOISE = np.array([(i * STEP % MODULUS) / 1000 for i in range(MODULUS)], np.float64).astype(np.float32)


def mock_scores(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """float32 scores of the bytes of many texts; one looks at the byte before it, byte 0 sees a line feed."""
    after = np.empty(len(data), bool)
    after[1:] = IS_SEPARATOR[data[:-1]]
    begins = np.concatenate([[0], ends[:-1]])
    after[begins[begins < ends]] = True
    place = np.arange(len(data)) - np.repeat(begins, ends - begins)
    return np.where(after, np.float32(HIGH), np.float32(LOW)) + _NOISE[place % MODULUS]
