"""SHA-256 whose state outlives a process, so that tasks can take a long stream one after the other.

hashlib keeps the state to itself; the library under it, OpenSSL, has it as a plain structure. Its bytes are in the machine's own
order, so they are for machines of one kind, as a cluster's are.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from functools import cache

#: SHA256_CTX has 112 bytes.
STATE = 128


@cache
def _library() -> ctypes.CDLL | None:
    """OpenSSL as hashlib has loaded it, else the system's; None without either."""
    places = []
    try:
        import _hashlib

        places.append(getattr(_hashlib, "__file__", None))
    except ImportError:
        pass
    for place in [*places, ctypes.util.find_library("crypto")]:
        try:
            found = ctypes.CDLL(place) if place else None
            if found is not None:
                found.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t)
                found.SHA256_Init.argtypes, found.SHA256_Final.argtypes = (ctypes.c_void_p,), (ctypes.c_void_p, ctypes.c_void_p)
                return found
        except (OSError, AttributeError):
            continue
    return None


class Sha256:
    """A hash that goes on from the state of another; update() takes pyarrow buffers."""

    def __init__(self, state: bytes | None = None):
        self._lib = _library()
        if self._lib is None:
            raise RuntimeError("SHA-256 can't be resumed without OpenSSL's library")
        self._context = ctypes.create_string_buffer(state, STATE) if state else ctypes.create_string_buffer(STATE)
        if not state:
            self._lib.SHA256_Init(self._context)

    def update(self, buffer) -> None:
        if buffer.size:
            self._lib.SHA256_Update(self._context, buffer.address, buffer.size)

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        end, out = ctypes.create_string_buffer(self._context.raw, STATE), ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, end)
        return out.raw.hex()


@cache
def resumable(algorithm: str) -> bool:
    """Whether a hash of this name can be resumed here."""
    if algorithm != "sha256" or _library() is None:
        return False
    import pyarrow as pa

    first = Sha256()
    first.update(pa.py_buffer(b"a" * 100))
    rest = Sha256(first.state())
    rest.update(pa.py_buffer(b"b" * 100))
    return rest.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()
