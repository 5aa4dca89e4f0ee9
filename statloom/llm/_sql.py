"""DuckDB expressions that several oracles share."""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, byte by byte over the table of its polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295::BIGINT)"
