"""Words of letters, digits and all beyond ASCII, cut from UTF-8 bytes, as lexical search and decontamination take them."""

from __future__ import annotations

import pyarrow as pa

#: A-Z to a-z; digits, letters and every byte of a character beyond ASCII stay; the rest become blanks.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased; none of a null."""
    return text.translate(_TABLE).split() if text else []


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as its UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
