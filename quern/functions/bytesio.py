"""Little-endian reads, UTF-16 text and typed values of compiled libraries, without Spark."""

from __future__ import annotations

import math
import re
import struct

MISSING = (0xFFFF, 0xFFFFFFFF)

# Type codes of the subject language, and file extensions of its objects.
BUILTIN_TYPES = {
    0: "", 1: "integer", 2: "long", 3: "real", 4: "double", 5: "decimal", 6: "string", 7: "boolean", 8: "any", 9: "uint", 10: "ulong", 11: "blob",
    12: "date", 13: "time", 14: "datetime", 15: "cursor", 16: "procedure", 18: "char", 19: "objhandle", 20: "longlong", 21: "byte",
}
OBJECT_TYPES = {
    "apl": "application", "sra": "application", "dwo": "datawindow", "srd": "datawindow", "fun": "function", "srf": "function", "men": "menu", "srm": "menu",
    "str": "structure", "srs": "structure", "udo": "userobject", "sru": "userobject", "win": "window", "srw": "window",
}


class FormatError(ValueError):
    """Bytes that are not what the format asks for; `offset` is where."""

    def __init__(self, message: str, offset: int = 0):
        super().__init__(message)
        self.offset = offset


class Reader:
    """A position in a buffer; reads past its end raise FormatError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError(f"{n} bytes wanted at {self.at}, {len(self.data) - self.at} are left", self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    def u16(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def u32(self) -> int:
        return int.from_bytes(self.take(4), "little")

    def buffer(self) -> bytes:
        """A length-prefixed buffer; its second, auxiliary part is passed over."""
        n, rest = self.u32(), self.u32()
        data = self.take(n)
        self.take(rest)
        return data

    def records(self, size: int, what: str) -> list[tuple[int, bytes]]:
        """(offset, record) of a table whose length is given in bytes."""
        start = self.at
        n = self.u16()
        if n % size:
            raise FormatError(f"{what}: {n} bytes are no whole number of {size}-byte records", start)
        return [(self.at, self.take(size)) for _ in range(n // size)]


def u16_at(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def u32_at(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def utf16_lossy(data: bytes) -> str:
    """Text without NULs and outer white space; what is no UTF-16 becomes the replacement character."""
    return data.decode("utf-16-le", "replace").replace("\0", "").strip()


def utf16_at(buffer: bytes, offset: int, odd: bool = False) -> str | None:
    """The text that ends with a NUL word at an offset (its highest bit is a flag); None if it is out of
    range, unterminated or no UTF-16, or (unless `odd`) starts at an odd place."""
    start = offset & 0x7FFFFFFF
    if start > len(buffer) or (start % 2 and not odd):
        return None
    for end in range(start, len(buffer) - 1, 2):
        if buffer[end] == 0 == buffer[end + 1]:
            try:
                return buffer[start:end].decode("utf-16-le")
            except UnicodeDecodeError:
                return None
    return None


def identifier_at(buffer: bytes, offset: int, dash: bool = True) -> str | None:
    """Such a text if it is an identifier."""
    name = utf16_at(buffer, offset, odd=True)
    return name if name and re.fullmatch(r"[^\W\d][\w-]*" if dash else r"[^\W\d]\w*", name) else None


def array_shape(buffer: bytes, offset: int) -> str | None:
    """Dimensions as `[5,2 to 3,]`; empty if there are none, None if out of range."""
    if offset in MISSING:
        return ""
    start = offset & 0x7FFFFFFF
    if start >= len(buffer) or start + 4 + 8 * buffer[start] > len(buffer) and buffer[start]:
        return None
    parts = []
    for i in range(buffer[start]):
        low, high = u32_at(buffer, start + 4 + 8 * i), u32_at(buffer, start + 8 + 8 * i)
        parts.append(str(high) if low == 1 else "" if low == high == 0 else f"{low} to {high}")
    return f"[{','.join(parts)}]"


def type_name(ref: int, names: dict[int, str]) -> str:
    """A type's name: built in, or of the library's own (0x8000) or the system's (0x4000) table."""
    if ref in BUILTIN_TYPES:
        return BUILTIN_TYPES[ref]
    return names.get(ref) or f"{'system_' if ref & 0xF000 == 0x4000 else ''}type_{ref:04X}"


def typed_value(type_ref: int, raw: int, strings: bytes) -> dict:
    """A constant's value as {kind, i, s}."""
    out = {"kind": "unresolved", "i": raw, "s": None}
    low = raw & 0xFFFF
    if type_ref == 1:
        out = {"kind": "signed", "i": low - (low >> 15 << 16), "s": None}
    elif type_ref == 2:
        out = {"kind": "signed", "i": raw - (raw >> 31 << 32), "s": None}
    elif type_ref == 6 and raw not in MISSING and (text := utf16_at(strings, raw)) is not None:
        out = {"kind": "string", "i": None, "s": text}
    elif type_ref == 7 and raw <= 1:
        out = {"kind": "boolean", "i": raw, "s": None}
    elif type_ref in (9, 10, 21):
        out = {"kind": "unsigned", "i": raw & {9: 0xFFFF, 10: 0xFFFFFFFF, 21: 0xFF}[type_ref], "s": None}
    elif type_ref == 18:
        out = {"kind": "character", "i": low, "s": None}
    return out


def decimal_at(buffer: bytes, offset: int) -> str:
    """A 16-byte decimal as a literal: 7 bytes of magnitude, 7 of zero, sign, scale."""
    record = buffer[offset : offset + 16]
    if len(record) < 16:
        raise FormatError("decimal is out of range", offset)
    value, sign, scale = int.from_bytes(record[:7], "little"), record[14], record[15]
    if any(record[7:14]) or sign > 1 or scale > 14 or (sign and not value):
        raise FormatError("not a decimal", offset)
    digits = str(value).rjust(scale + 1, "0")
    return "-" * sign + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def double_at(buffer: bytes, offset: int) -> str:
    """An 8-byte float as a literal without an exponent; whole numbers have no point."""
    if offset + 8 > len(buffer):
        raise FormatError("double is out of range", offset)
    (value,) = struct.unpack_from("<d", buffer, offset)
    if not math.isfinite(value) or (value == 0 and math.copysign(1, value) < 0):
        raise FormatError("not a plain number", offset)
    from decimal import Decimal

    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def escaped(text: str) -> str:
    """A string literal's inside."""
    for a, b in (("~", "~~"), ("\r", "~r"), ("\n", "~n"), ("\t", "~t"), ('"', '~"')):
        text = text.replace(a, b)
    return text


def object_type(name: str) -> str:
    """By a name's extension."""
    return OBJECT_TYPES.get(name.rpartition(".")[2].lower(), "unknown")


def object_type_by_content(data: bytes) -> str:
    """By the first of these words that the bytes hold, in any case."""
    low = data.lower()
    for word, kind in ((b"datawindow", "datawindow"), (b"window", "window"), (b"menu", "menu"), (b"function", "function"), (b"user_object", "userobject"), (b"userobject", "userobject"), (b"application", "application"), (b"structure", "structure")):
        if word in low:
            return kind
    return "global"


def safe_name(name: str) -> str:
    """A name for a file: control and reserved characters as `_`, 160 characters, no final blank or dot."""
    return re.sub(r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "_", name)[:160].rstrip(" .") or "object"


def entry_file(index: int, name: str) -> str:
    return f"{index:04d}_{safe_name(name)}.bin"


def function_file(entry: int, region: int, function: int, name: str) -> str:
    return f"{entry:04d}_{region:04d}_{function:04d}_{safe_name(name)}.powerscript.txt"
