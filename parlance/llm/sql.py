"""Fragments of DuckDB SQL that several queries share."""

from __future__ import annotations

# The CRC-32 (reflected 0xEDB88320) of each half byte.
_CRC_STEPS = (
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: half byte by half byte, the lower first."""
    steps = "[" + ", ".join(f"{s}::BIGINT" for s in _CRC_STEPS) + "]"
    digits = f"list_transform(range(length(hex(encode({text})))), lambda k: (strpos('0123456789ABCDEF', hex(encode({text}))[k + 2 - 2 * (k % 2)]) - 1)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda c, d: xor(c >> 4, {steps}[(xor(c, d) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
