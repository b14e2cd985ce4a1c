"""C++ symbol names, readable: the Itanium scheme, without arguments and return types.

The C++ runtime's own demangler is called. A machine without it raises, so that
executors can't give different names.
"""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _runtime():
    for name in ("libstdc++.so.6", "libc++abi.so.1", "libc++abi.dylib"):
        try:
            call = ctypes.CDLL(name).__cxa_demangle
        except (OSError, AttributeError):
            continue
        call.restype = ctypes.c_void_p
        call.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_void_p, ctypes.POINTER(ctypes.c_int)]
        free = ctypes.CDLL(None).free
        free.argtypes = [ctypes.c_void_p]
        return call, free
    raise RuntimeError("no C++ runtime with a demangler on this machine")


def _by_runtime(name: str) -> str | None:
    call, free = _runtime()
    status = ctypes.c_int()
    found = call(name.encode(), None, None, ctypes.byref(status))
    if status.value or not found:
        return None
    text = ctypes.string_at(found).decode("utf-8", "replace")
    free(found)
    return text


_CLOSE = {")": "(", ">": "<", "]": "["}


def without_arguments(full: str) -> str:
    """Cut at the bracket that opens the last argument list; an operator's own brackets stay.

    An opening bracket without its closing one counts for nothing.
    """
    inside = dict.fromkeys(_CLOSE.values(), 0)
    for i in range(len(full) - 1, -1, -1):
        c = full[i]
        if c in _CLOSE:
            inside[_CLOSE[c]] += 1
        elif c in inside:
            inside[c] = max(0, inside[c] - 1)
            if c == "(" and not any(inside.values()) and full[max(0, i - 8) : i] != "operator":
                return full[:i]
    return full


def without_qualifiers(name: str) -> str:
    """Cut white space and const, volatile, & and && off the end, as long as there are any."""
    while True:
        short = name.rstrip(" \t\n\r\f\v")
        for end in ("const", "volatile", "&&", "&"):
            if short.endswith(end):
                short = short[: -len(end)]
                break
        if short == name:
            return name
        name = short


def without_return_type(name: str) -> str:
    """What follows the last space that is in no angle brackets, seen from the end."""
    for m in reversed(list(re.finditer(" ", name))):
        tail = name[m.end() :]
        if tail.count("<") == tail.count(">"):
            return tail
    return name


@lru_cache(maxsize=200_000)
def demangled(name: str) -> str:
    """A readable name, or the name itself if it isn't a mangled one."""
    found = _by_runtime(name)
    if found is None:
        return name
    while " >" in found:
        found = found.replace(" >", ">")
    return without_return_type(without_qualifiers(without_arguments(found)))


def _mapped(rule):
    """A function of a text as one of a column, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def mapped(names: pd.Series) -> pd.Series:
        return names.map(rule, na_action="ignore")

    return mapped


def demangle(c: Column) -> Column:
    """Demangled names."""
    return _mapped(demangled)(c)


def strip_arguments(c: Column) -> Column:
    """Readable names without their last argument list (see :func:`without_arguments`)."""
    return _mapped(without_arguments)(c)


def strip_qualifiers(c: Column) -> Column:
    """Readable names without qualifiers at the end (see :func:`without_qualifiers`)."""
    return _mapped(without_qualifiers)(c)


def strip_return_type(c: Column) -> Column:
    """Readable names without what stands before the last outer space (see :func:`without_return_type`)."""
    return _mapped(without_return_type)(c)
