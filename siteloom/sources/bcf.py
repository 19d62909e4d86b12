"""BCF2 records: decoding to VCF lines and encoding from them, in tasks that each hold whole records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from siteloom.sources.header import Header, parse_header

MAGIC = b"BCF\x02\x02"
_MISSING = {1: -128, 2: -32768, 3: -2147483648}
_END = {1: -127, 2: -32767, 3: -2147483647}
_CODE = {1: ("b", 1), 2: ("h", 2), 3: ("i", 4)}
_NAN = 0x7F800001
_NAN_END = 0x7F800002


class BcfError(ValueError):
    pass


def _dictionary(header: Header) -> list[str]:
    """FILTER, INFO and FORMAT ids in order; PASS is the first."""
    out = ["PASS"]
    for kind in ("FILTER", "INFO", "FORMAT"):
        out += [t for t in header.fields.get(kind, {}) if t not in out]
    return out


def _read(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, position after) of a typed value's descriptor."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        t, _, at = _read(data, at)
        code, size = _CODE[t]
        n = struct.unpack_from(f"<{code}", data, at)[0]
        at += size
    return kind, n, at


def _values(data: bytes, at: int, kind: int, n: int) -> tuple[list, int]:
    """Values as texts, None for missing; what follows the end of a vector is left out."""
    if kind == 0:
        return [], at
    if kind == 7:
        text = data[at : at + n].split(b"\0")[0].decode()
        return [text] if text else [], at + n
    if kind == 5:
        out = []
        for (bits,) in struct.iter_unpack("<I", data[at : at + 4 * n]):
            if bits == _NAN_END:
                break
            out.append(None if bits == _NAN else format(struct.unpack("<f", struct.pack("<I", bits))[0], ".6g"))
        return out, at + 4 * n
    code, size = _CODE[kind]
    out = []
    for (v,) in struct.iter_unpack(f"<{code}", data[at : at + size * n]):
        if v == _END[kind]:
            break
        out.append(None if v == _MISSING[kind] else v)
    return out, at + size * n


def _typed(data: bytes, at: int) -> tuple[list, int]:
    kind, n, at = _read(data, at)
    return _values(data, at, kind, n)


def _join(values: list) -> str:
    return ",".join("." if v is None else str(v) for v in values) or "."


def _genotype(values: list) -> str:
    out = ""
    for i, v in enumerate(values):
        v = 0 if v is None else v
        out += ("" if i == 0 else "|" if v & 1 else "/") + ("." if v >> 1 == 0 else str((v >> 1) - 1))
    return out or "."


def decode_record(shared: bytes, individual: bytes, header: Header, names: list[str]) -> str:
    chrom, pos, _, qual, n_info, n_allele, n_sample, n_fmt = (*struct.unpack_from("<iii", shared), struct.unpack_from("<I", shared, 12)[0], *struct.unpack_from("<HH", shared, 16), struct.unpack_from("<I", shared, 20)[0] & 0xFFFFFF, shared[23])
    at = 24
    name, at = _typed(shared, at)
    alleles = []
    for _ in range(n_allele):
        a, at = _typed(shared, at)
        alleles.append(a[0] if a else ".")
    filters, at = _typed(shared, at)
    info = []
    for _ in range(n_info):
        key, at = _typed(shared, at)
        kind, n, at = _read(shared, at)
        values, at = _values(shared, at, kind, n)
        info.append(names[key[0]] if kind == 0 or n == 0 else f"{names[key[0]]}={_join(values)}")
    q = "." if qual == _NAN else format(struct.unpack("<f", struct.pack("<I", qual))[0], ".6g")
    fields = [header.contigs[chrom], str(pos + 1), name[0] if name else ".", alleles[0], ",".join(alleles[1:]) or ".", q, ";".join(names[f] for f in filters) or ".", ";".join(info) or "."]
    if n_fmt:
        at, keys, columns = 0, [], [[] for _ in range(n_sample)]
        for _ in range(n_fmt):
            key, at = _typed(individual, at)
            kind, n, at = _read(individual, at)
            keys.append(names[key[0]])
            for column in columns:
                values, at = _values(individual, at, kind, n)
                column.append(_genotype(values) if keys[-1] == "GT" else _join(values))
        fields += [":".join(keys), *(":".join(c) for c in columns)]
    return "\t".join(fields)


def decode(data: bytes) -> tuple[Header, Iterator[str]]:
    """Header and VCF lines of an uncompressed BCF stream."""
    if data[:5] != MAGIC:
        raise BcfError("not BCF2.2")
    size = struct.unpack_from("<I", data, 5)[0]
    header = parse_header(data[9 : 9 + size].rstrip(b"\0").decode().splitlines())

    def lines() -> Iterator[str]:
        names, at = _dictionary(header), 9 + size
        while at < len(data):
            a, b = struct.unpack_from("<II", data, at)
            at += 8
            yield decode_record(data[at : at + a], data[at + a : at + a + b], header, names)
            at += a + b

    return header, lines()


def _descriptor(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _integers([n])


def _integers(values: list, width: int | None = None) -> bytes:
    """Typed integers in the least size that holds them; None is missing, a shorter vector is ended."""
    known = [v for v in values if v is not None]
    kind = 1 if all(-120 <= v <= 127 for v in known) else 2 if all(-32760 <= v <= 32767 for v in known) else 3
    return _descriptor(kind, width or len(values)) + _raw(values, kind, width or len(values))


def _raw(values: list, kind: int, width: int) -> bytes:
    filled = [_MISSING[kind] if v is None else v for v in values] + [_END[kind]] * (width - len(values))
    return struct.pack(f"<{width}{_CODE[kind][0]}", *filled)


def _text(s: str) -> bytes:
    b = s.encode()
    return _descriptor(7, len(b)) + b


def _float_bits(v: str | None) -> int:
    return _NAN if v in (None, ".") else struct.unpack("<I", struct.pack("<f", float(v)))[0]


def _value(text: str, kind: str) -> bytes:
    parts = [None if x == "." else x for x in text.split(",")]
    if kind == "Integer":
        return _integers([None if x is None else int(x) for x in parts])
    if kind == "Float":
        return _descriptor(5, len(parts)) + b"".join(struct.pack("<I", _float_bits(x)) for x in parts)
    return _text(text)


def encode_record(line: str, header: Header, names: list[str]) -> bytes:
    f = line.split("\t")
    at = {n: i for i, n in enumerate(names)}
    alts = [] if f[4] == "." else f[4].split(",")
    info = [] if f[7] == "." else f[7].split(";")
    fmt = f[8].split(":") if len(f) > 9 else []
    end = next((int(x[4:]) for x in info if x.startswith("END=")), None)
    length = end - int(f[1]) + 1 if end else len(f[3])
    shared = struct.pack("<iiiIHHI", header.contigs.index(f[0]), int(f[1]) - 1, length, _float_bits(f[5]), len(info), 1 + len(alts), len(fmt) << 24 | (len(f) - 9 if fmt else 0))
    shared += _text("" if f[2] == "." else f[2]) + _text(f[3]) + b"".join(map(_text, alts))
    shared += _integers([] if f[6] == "." else [at[x] for x in f[6].split(";")]) if f[6] != "." else b"\x00"
    for x in info:
        key, _, value = x.partition("=")
        shared += _integers([at[key]]) + (b"\x00" if "=" not in x else _value(value, header.type("INFO", key)))
    individual = b""
    columns = [c.split(":") for c in f[9:]]
    for i, key in enumerate(fmt):
        texts = [c[i] if i < len(c) else "." for c in columns]
        individual += _integers([at[key]]) + _format(texts, key, header.type("FORMAT", key))
    return struct.pack("<II", len(shared), len(individual)) + shared + individual


def _format(texts: list[str], key: str, kind: str) -> bytes:
    if key == "GT":
        rows = []
        for t in texts:
            alleles, phased, row = t.replace("|", "/").split("/"), [x == "|" for x in t if x in "|/"], []
            for i, a in enumerate(alleles):
                row.append(((0 if a == "." else int(a) + 1) << 1) | int(i > 0 and phased[i - 1]))
            rows.append(row)
    elif kind == "Integer":
        rows = [[None if x == "." else int(x) for x in t.split(",")] for t in texts]
    elif kind == "Float":
        width = max(t.count(",") + 1 for t in texts)
        cells = [[_float_bits(x) for x in t.split(",")] for t in texts]
        return _descriptor(5, width) + b"".join(struct.pack(f"<{width}I", *c, *[_NAN_END] * (width - len(c))) for c in cells)
    else:
        width = max(len(t.encode()) for t in texts)
        return _descriptor(7, width) + b"".join(t.encode().ljust(width, b"\0") for t in texts)
    width = max(map(len, rows))
    known = [v for r in rows for v in r if v is not None]
    code = 1 if all(-120 <= v <= 127 for v in known) else 2 if all(-32760 <= v <= 32767 for v in known) else 3
    return _descriptor(code, width) + b"".join(_raw(r, code, width) for r in rows)


def encode(header: Header, lines: list[str]) -> bytes:
    """An uncompressed BCF stream. Every FILTER, INFO and FORMAT id and contig must be in the header."""
    text = ("\n".join(header.lines()) + "\n").encode() + b"\0"
    names = _dictionary(header)
    try:
        body = b"".join(encode_record(x, header, names) for x in lines)
    except (KeyError, ValueError) as e:
        raise BcfError(f"not in the header, or of another type: {e}") from e
    return MAGIC + struct.pack("<I", len(text)) + text + body


def _record_at(data: bytes, at: int, contigs: int, samples: int) -> int | None:
    """Where the record after the one at ``at`` begins; None if none can be there. Only looked at as far as ``data`` goes."""
    if at + 32 > len(data):
        return at
    shared, own, chrom, pos, length, _, n_info, n_allele, packed = struct.unpack_from("<IIiiiIHHI", data, at)
    if not 24 <= shared < 1 << 28 or own >= 1 << 30 or not 0 <= chrom < contigs or pos < -1 or length < 0 or n_allele > shared or n_info > shared:
        return None
    if packed & 0xFFFFFF not in (0, samples) or (packed >> 24 == 0 and own > 0):
        return None
    return at + 8 + shared + own


def first_record(data: bytes, contigs: int, samples: int, chain: int = 8) -> int | None:
    """The first offset in ``data`` from which ``chain`` records, or all that there are, follow each other."""
    for at in range(len(data)):
        here, n = at, 0
        while n < chain and here < len(data):
            after = _record_at(data, here, contigs, samples)
            if after is None or after == here:
                break
            here, n = after, n + 1
        if n == chain or (n and here == len(data)) or (n and here > len(data)):
            return at
    return None


def range_records(f, start: int, end: int, size: int, contigs: int, samples: int, skip: int = 0) -> Iterator[bytes]:  # noqa: ANN001
    """Whole records that begin in the blocks from ``start`` to before ``end``; ``skip`` bytes of the file's text come before its first one."""
    from siteloom.sources import bgzf

    at = bgzf.find_block(f, start, size) if start else 0
    if at is None or at >= end:
        return
    held, own, found = b"", 0, start == 0
    for offset, text in bgzf.texts_from(f, at, size):
        if offset < end:
            own += len(text)
        held += text
        if not found:
            if len(held) < 1 << 18 and offset < end:
                continue  # enough to judge by
            at = first_record(held, contigs, samples)
            if at is None:
                continue
            skip, found = at, True
        if skip:
            cut = min(skip, len(held))
            held, own, skip = held[cut:], own - cut, skip - cut
        i = 0
        while i < min(own, len(held) - 7):
            n = 8 + sum(struct.unpack_from("<II", held, i))
            if i + n > len(held):
                break
            yield held[i : i + n]
            i += n
        held, own = held[i:], own - i
        if offset >= end and own <= 0:
            return
    if not found and (at := first_record(held, contigs, samples)) is not None:
        held, own, i = held[at:], own - at, 0
        while i < min(own, len(held) - 7):
            n = 8 + sum(struct.unpack_from("<II", held, i))
            yield held[i : i + n]
            i += n


def read_bcf(spark, path: str, step: int | None = None):  # noqa: ANN001, ANN201
    """Header and sites of block-compressed BCF files, in parallel by ranges of compressed bytes.

    A range's first record is where a chain of plausible ones begins. The first file in name order holds the header; others hold records only, or headers of their own.
    """
    import pandas as pd

    from siteloom.sources import bgzf
    from siteloom.sources.vcf import parse_lines

    ranges = bgzf.file_ranges(spark, path, step or bgzf.RANGE)

    def head(name: str, size: int) -> bytes:
        out = b""
        with bgzf.open_file(name) as f:
            for _, text in bgzf.texts_from(f, 0, size):
                out += text
                if out[:5] != MAGIC or len(out) >= 9 + struct.unpack_from("<I", out, 5)[0]:
                    break
        return out[: 9 + struct.unpack_from("<I", out, 5)[0]] if out[:5] == MAGIC else b""

    first = ranges.orderBy("file", "nth").first()
    top = head(first["path"], first["size"])
    if not top:
        raise BcfError(f"{first['path']} has no BCF header")
    header, _ = decode(top)
    contigs, samples = len(header.contigs), len(header.samples)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                n, lot, held = (r.file << 50) + (r.nth << 27), [], 0
                with bgzf.open_file(r.path) as f:
                    skip = len(head(r.path, r.size)) if r.start == 0 else 0
                    for record in range_records(f, r.start, r.end, r.size, contigs, samples, skip):
                        lot.append(record)
                        held += len(record)
                        if held > 1 << 22:
                            yield pd.DataFrame({"value": list(decode(top + b"".join(lot))[1]), "ord": range(n, n + len(lot))})
                            n, lot, held = n + len(lot), [], 0
                if lot:
                    yield pd.DataFrame({"value": list(decode(top + b"".join(lot))[1]), "ord": range(n, n + len(lot))})

    return header, parse_lines(ranges.mapInPandas(run, "value string, ord long"), header)


def write_bcf(sites, header: Header, path: str, level: int = 6) -> None:  # noqa: ANN001
    """Block-compressed BCF part files under ``path`` in position order; the header is a first one of its own."""
    from siteloom.sources import bgzf
    from siteloom.sources.vcf import ordered_lines

    names = _dictionary(header)
    with ordered_lines(sites, header) as rows:
        bgzf.write_parts(rows, lambda lines: b"".join(encode_record(x, header, names) for x in lines), path, encode(header, []), ".bcf", level)
