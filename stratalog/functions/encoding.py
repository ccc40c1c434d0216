"""Record and key encodings, checksums, names and parsers, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the storage format.
PAGE, BLOCK_SHIFT, RECORD_OVERHEAD, HEADER_BYTES = 4096, 18, 24, 20
MULTIPART = 10 * 1024 * 1024


def be8(x: Column) -> Column:
    """8 bytes, big-endian: byte order is numeric order for non-negative numbers."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def be8_value(b: Column) -> Column:
    """The number in the first 8 bytes; null if there are fewer."""
    return F.when(F.octet_length(b) >= 8, F.conv(F.hex(F.substring(b, 1, 8)), 16, 10).cast("long"))


def le4(x: Column) -> Column:
    """4 bytes, little-endian."""
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def key(ledger_id: Column, entry_id: Column) -> Column:
    return F.concat(be8(ledger_id), be8(entry_id))


def key_ledger(k: Column) -> Column:
    return F.when(F.octet_length(k) >= 16, be8_value(k))


def key_entry(k: Column) -> Column:
    return F.when(F.octet_length(k) >= 16, be8_value(F.substring(k, 9, 8)))


def digest(data: Column) -> Column:
    return F.crc32(data)


def record_crc(ledger_id: Column, entry_id: Column, data: Column) -> Column:
    return F.crc32(F.concat(le4(F.octet_length(data)), be8(ledger_id), be8(entry_id), data))


def record(ledger_id: Column, entry_id: Column, data: Column) -> Column:
    """A segment record: length, key, payload, checksum."""
    return F.concat(le4(F.octet_length(data)), be8(ledger_id), be8(entry_id), data, le4(record_crc(ledger_id, entry_id, data)))


def record_bytes(data: Column) -> Column:
    return F.octet_length(data).cast("long") + RECORD_OVERHEAD


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 under one key, as binary; the pads are literals, so it stays in codegen."""
    import hashlib

    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(c ^ pad for c in block)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def entry_message(ledger_id: Column, entry_id: Column, lac: Column, data: Column) -> Column:
    return F.concat(be8(ledger_id), be8(entry_id), be8(lac), data)


def hmac_valid(entry_hmac: Column, ledger_key: bytes | None, message: Column) -> Column:
    """Checked only where the entry has one and a key is stored."""
    if ledger_key is None:
        return F.lit(True)
    return F.when(entry_hmac.isNull(), True).otherwise(entry_hmac == hmac_sha256(ledger_key, message))


def align_up(x: Column) -> Column:
    return F.shiftright(x.cast("long") + (PAGE - 1), 12) * PAGE


def resume_offset(x: Column) -> Column:
    return F.shiftright(x.cast("long"), 12) * PAGE


def block_start(offset: Column) -> Column:
    return F.shiftleft(F.shiftright(offset.cast("long"), BLOCK_SHIFT), BLOCK_SHIFT)


def payload_in_block(offset: Column, length: Column) -> Column:
    """Where a record's payload begins and ends, counted from its block's start."""
    begin = offset.cast("long") - block_start(offset) + HEADER_BYTES
    return F.struct(begin.alias("begin"), (begin + length - RECORD_OVERHEAD).alias("end"))


def hex_id(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("long"))), 16, "0")


def wal_file(x: Column) -> Column:
    return F.concat(F.lit("seg-"), hex_id(x), F.lit(".seg"))


def entry_file(x: Column) -> Column:
    return F.concat(F.lit("entry-"), hex_id(x), F.lit(".ent"))


def remote_key(x: Column) -> Column:
    return F.concat(F.lit("entries/"), hex_id(x), F.lit(".ent"))


def file_id(name: Column) -> Column:
    """The id in a segment file's name; null for other files."""
    h = F.regexp_extract(name, r"^(?:seg|entry)-([0-9a-f]{16})\.(?:seg|ent)$", 1)
    return F.when(h != "", F.conv(h, 16, 10).cast("long"))


def fenced_ledger(message: Column) -> Column:
    return _number(message, r"ledger (\d+) is fenced", 1)


def missing_entry(message: Column) -> Column:
    found = r"entry (\d+) not found in ledger (\d+)"
    return F.when(message.rlike(found), F.struct(_number(message, found, 1).alias("entry_id"), _number(message, found, 2).alias("ledger_id")))


def _number(message: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(message, pattern, group), F.lit("")).cast("long")


#: Reasons and the status code each travels as.
STATUS = {"EntryNotFound": "NOT_FOUND", "LedgerNotFound": "NOT_FOUND", "LedgerFenced": "FAILED_PRECONDITION", "CasConflict": "ABORTED", "QuorumNotMet": "UNAVAILABLE", "InvalidEntryId": "INVALID_ARGUMENT", "LacTimeout": "DEADLINE_EXCEEDED"}


def status_code(reason: Column) -> Column:
    out = F.when(reason.isNull(), "OK")
    for name, code in STATUS.items():
        out = out.when(reason == name, code)
    return out.otherwise("INTERNAL")


def normal_address(address: Column) -> Column:
    """Trimmed, localhost as 127.0.0.1, with a scheme."""
    a = F.regexp_replace(F.trim(address), r"(^|//)localhost(?=[:/]|$)", "$1127.0.0.1")
    return F.when(a.rlike("^https?://"), a).otherwise(F.concat(F.lit("http://"), a))


def csv_parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def options_valid(ensemble: Column, write: Column, ack: Column) -> Column:
    return (ack > 0) & (ack <= write) & (write <= ensemble)


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def checked_sub(a: Column, b: Column) -> Column:
    return F.when(a >= b, a - b)
