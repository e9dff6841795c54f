"""Names of plug-ins, 'library.name': a library registered later comes first, and modules can be registered as libraries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from millrace.operators import mapping, pipes, reducing
from millrace.options import parse_list
from millrace.sources import readers, writers

_LIBRARIES: list[tuple[str, dict[str, Callable]]] = []
#: The plug-in of each role that a job uses if it names none.
DEFAULTS = {"reader": "core.lines", "mapper": "core.identity", "partitioner": "core.hash", "reducer": "core.passive", "writer": "core.kv_text"}


def register(library: str, objects: dict[str, Callable]) -> None:
    _LIBRARIES.append((library, dict(objects)))


def load(libraries: str) -> None:
    """name=module,...: each module's `plugins` dictionary, or its public callables, under that name."""
    for pair in parse_list(libraries):
        name, _, module = pair.partition("=")
        found = importlib.import_module(module or name)
        register(name, getattr(found, "plugins", None) or {k: v for k, v in vars(found).items() if callable(v) and not k.startswith("_")})


def lookup(name: str) -> Callable:
    """By 'library.name', or by the name alone in the library registered last that has it."""
    library, _, short = name.rpartition(".")
    for own, objects in reversed(_LIBRARIES):
        if (not library or own == library) and short in objects:
            return objects[short]
    raise KeyError(f"no plug-in named {name!r}")


def default(role: str) -> Callable:
    if role not in DEFAULTS:
        raise KeyError(f"no default for the role {role!r}")
    return lookup(DEFAULTS[role])


register(
    "core",
    {
        "lines": readers.lines,
        "key_value_lines": readers.key_value_lines,
        "tera_lines": readers.tera_lines,
        "raw_lines": readers.raw_lines,
        "identity": mapping.identity,
        "tokens": mapping.tokens,
        "count_records": reducing.count_records,
        "int_sum": reducing.int_sum,
        "passive": mapping.identity,
        "group_identity": reducing.identity,
        "hash": "hash",
        "total_order": "total_order",
        "pipe_map": pipes.pipe_map,
        "pipe_reduce": pipes.pipe_reduce,
        "kv_text": writers.write_kv,
        "text_int": writers.write_text_int,
        "tera_text": writers.write_tera,
        "raw_text": writers.write_raw,
    },
)
