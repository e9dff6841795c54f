"""Job options: key=value texts with the rules of legacy configuration files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

#: Legacy option names and the fields that they set (fixed values).
LEGACY = {
    "mapred.reduce.tasks": "partitions",
    "mapred.textoutputformat.separator": "separator",
    "key.value.separator.in.input.line": "input_separator",
    "mapred.output.compress": "compress",
    "mapred.output.compression.codec": "codec",
    "mapred.map.output.sort": "sort",
    "mapred.map.tasks": "maps",
    "total.order.partitioner.path": "cuts",
}
#: Legacy option names of plug-ins and their roles (fixed values).
LEGACY_PLUGS = {
    "native.recordreader.class": "reader",
    "native.mapper.class": "mapper",
    "native.combiner.class": "combiner",
    "native.partitioner.class": "partitioner",
    "native.reducer.class": "reducer",
    "native.recordwriter.class": "writer",
}


def parse_pairs(lines: Iterable[str]) -> dict[str, str]:
    """key=value lines: blank lines, comments (#) and keys that begin with - are passed over; a repeated key joins with a comma."""
    out: dict[str, str] = {}
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if key and not key.startswith("-"):
            out[key] = f"{out[key]},{value}" if key in out else value
    return out


def load_pairs(path: str) -> dict[str, str]:
    with open(path) as f:
        return parse_pairs(f)


def parse_list(value: str, kind: type = str) -> list:
    """Comma-separated values, trimmed, empty ones dropped."""
    return [kind(x.strip()) for x in value.split(",") if x.strip()]


def parse_bool(value: str) -> bool:
    """True for the exact text true alone."""
    return value == "true"


@dataclass(frozen=True)
class JobOptions:
    partitions: int | None = None  # of the reduce side; 0: a map-only job; None: as the session has it
    separator: str = "\t"
    input_separator: str = "\t"
    compress: bool = False
    codec: str = "gzip"
    sort: bool = True
    maps: int | None = None  # partitions of the input; None: as it is read
    cuts: str | None = None  # a file of cut points, a line each
    wrap_sums: bool = False
    plugs: dict = field(default_factory=dict)  # names of plug-ins by role
    extra: dict = field(default_factory=dict)

    def with_pairs(self, pairs: dict[str, str]) -> JobOptions:
        """With legacy options applied; those without a field are kept in extra."""
        named = {LEGACY_PLUGS[k]: v for k, v in pairs.items() if k in LEGACY_PLUGS}
        pairs = {k: v for k, v in pairs.items() if k not in LEGACY_PLUGS}
        known = {LEGACY[k]: v for k, v in pairs.items() if k in LEGACY}
        for name in ("partitions", "maps"):
            if name in known:
                known[name] = int(known[name])
        for name in ("compress", "sort"):
            if name in known:
                known[name] = parse_bool(known[name])
        if "codec" in known:
            known["codec"] = known["codec"].rpartition(".")[2].removesuffix("Codec").lower()
        return replace(self, **known, plugs=self.plugs | named, extra=self.extra | {k: v for k, v in pairs.items() if k not in LEGACY})
