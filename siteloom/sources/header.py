"""VCF headers: parsed on the driver, written at the sink."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

_FIELD = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')
_VERSION = re.compile(r"##fileformat=(?:VCF)?v?(?:VCF)?v?(\d+\.\d+)$", re.I)


class HeaderError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    """Meta lines by kind, contigs in order, samples in order."""

    version: str = "4.2"
    fields: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    """INFO, FORMAT, FILTER, contig, ... : ID to attributes, in order."""
    other: tuple[str, ...] = ()
    samples: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def contigs(self) -> list[str]:
        return list(self.fields.get("contig", {}))

    def number(self, kind: str, tag: str) -> str:
        return self.fields.get(kind, {}).get(tag, {}).get("Number", ".")

    def type(self, kind: str, tag: str) -> str:
        return self.fields.get(kind, {}).get(tag, {}).get("Type", "String")

    def with_field(self, kind: str, tag: str, number: str, type_: str, description: str) -> Header:
        made = {k: dict(v) for k, v in self.fields.items()}
        made.setdefault(kind, {})[tag] = {"Number": number, "Type": type_, "Description": f'"{description}"'}
        return replace(self, fields=made)

    def with_samples(self, *names: str) -> Header:
        if len(set(names)) != len(names):
            raise HeaderError("duplicate sample names")
        return replace(self, samples=names)

    def renamed(self, names: dict[str, str]) -> Header:
        return self.with_samples(*(names.get(s, s) for s in self.samples))

    def with_contigs(self, lengths: dict[str, int]) -> Header:
        """Contigs of an index of the reference: others go, new ones are added, attributes stay."""
        now = self.fields.get("contig", {})
        made = {k: dict(v) for k, v in self.fields.items()}
        kept = [c for c in now if c in lengths] + [c for c in lengths if c not in now]
        made["contig"] = {c: {**now.get(c, {}), "length": str(lengths[c])} for c in kept}
        return replace(self, fields=made)

    def with_provenance(self, program: str, version: str, command: str) -> Header:
        """Lines that say what wrote the file; those of the same program are replaced."""
        keep = tuple(x for x in self.other if not re.match(rf"##{re.escape(program)}(Version|Command)=", x))
        return replace(self, other=(*keep, f"##{program}Version={version}", f"##{program}Command={command}"))

    def lines(self) -> list[str]:
        out = [f"##fileformat=VCFv{self.version}"]
        for kind, tags in self.fields.items():
            for tag, attributes in tags.items():
                out.append(f"##{kind}=<" + ",".join([f"ID={tag}", *(f"{k}={v}" for k, v in attributes.items())]) + ">")
        out += self.other
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        return [*out, "\t".join(columns + (["FORMAT", *self.samples] if self.samples else []))]


def parse_header(lines: list[str]) -> Header:
    """Reads meta lines and the column line; a version written without its ``v`` is repaired, with a warning."""
    version, fields, other, samples, warnings = "4.2", {}, [], (), []
    seen = False
    for line in lines:
        if m := _VERSION.match(line):
            version = m[1]
            if f"VCFv{version}" not in line:
                warnings.append(f"fileformat {line.partition('=')[2]} is read as VCFv{version}")
        elif m := re.match(r"##(\w+)=<(.*)>$", line):
            attributes = dict(_FIELD.findall(m[2]))
            if "ID" in attributes:
                fields.setdefault(m[1], {})[attributes.pop("ID")] = attributes
            else:
                other.append(line)
        elif line.startswith("##"):
            other.append(line)
        elif line.startswith("#CHROM"):
            seen = True
            columns = line.rstrip("\n").split("\t")
            samples = tuple(columns[9:])
            if len(set(samples)) != len(samples):
                raise HeaderError("duplicate sample names")
    if not seen:
        raise HeaderError("no #CHROM line")
    return Header(version, fields, tuple(other), samples, tuple(warnings))


def merge_headers(headers: list[Header], force_samples: bool = False) -> Header:
    """Fields and contigs of all; samples of all, duplicates an error or prefixed ``N:`` until unique."""
    fields: dict[str, dict[str, dict[str, str]]] = {}
    samples: list[str] = []
    for i, h in enumerate(headers):
        for kind, tags in h.fields.items():
            for tag, attributes in tags.items():
                fields.setdefault(kind, {}).setdefault(tag, attributes)
        for s in h.samples:
            while s in samples:
                if not force_samples:
                    raise HeaderError(f"sample {s} is in several inputs")
                s = f"{i + 1}:{s}"
            samples.append(s)
    return Header(headers[0].version, fields, tuple(dict.fromkeys(x for h in headers for x in h.other)), tuple(samples))
