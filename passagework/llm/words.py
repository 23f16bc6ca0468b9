"""Words as UTF-8 bytes: only ASCII letters are folded, so bytes of other characters pass through unchanged."""
from __future__ import annotations

#: ASCII digits and letters stay (letters folded), bytes of non-ASCII characters stay, everything else is a gap.
_TERMS = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    r"""The lower-cased runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``; none for null."""
    return text.translate(_TERMS).split() if text else []


def blank_separated(text: bytes | None) -> list[bytes]:
    r"""The lower-cased runs of ``[^\x20\x09-\x0D]``; none for null."""
    return text.lower().split() if text else []
