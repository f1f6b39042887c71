"""Rows as text, and the length-prefixed protocol.

A request is a little-endian u64 length and so many bytes of SQL; the answer a status byte (0: fine), a u64 length and text.
Each connection has a current database of its own; statements run one at a time.
"""

from __future__ import annotations

import datetime as dt
import socketserver
import struct
import threading
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame

from brindle.session import Engine

MOST_BYTES = 1 << 30


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return f"{value:f}" if isinstance(value, Decimal) else str(value)


def lines(frame: DataFrame | None) -> Iterator[str]:
    """Cells separated by blanks, a row a line, a partition at a time."""
    if frame is not None:
        for row in frame.toLocalIterator():
            yield " ".join(map(cell, row)) + " \n"


class Sessions:
    """One catalog for all connections, and one statement at a time."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.lock = engine, threading.Lock()

    def run(self, text: str, database, parameters: list | None = None, use=None):
        """Runs a batch as a connection whose current database is given; what ``use`` makes of the result, and the database then."""
        with self.lock:
            self.engine.catalog.current = database
            try:
                result = self.engine.sql(text, parameters)
                return (use(result) if use else result), self.engine.catalog.current
            finally:
                self.engine.catalog.current = None


def exactly(stream, n: int) -> bytes | None:
    out = stream.read(n)
    return out if out is not None and len(out) == n else None


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        database = None
        while (head := exactly(self.rfile, 8)) is not None:
            n = struct.unpack("<Q", head)[0]
            if not 0 < n < MOST_BYTES or (raw := exactly(self.rfile, n)) is None:
                return
            try:
                text, database = self.server.sessions.run(raw.decode(), database, use=lambda f: "".join(lines(f)))
                status = 0
            except Exception as e:  # whatever a statement raises is the client's answer
                status, text = 1, str(e)
            body = text.encode()
            self.wfile.write(struct.pack("<BQ", status, len(body)) + body)


class TextServer(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self, sessions: Sessions, port: int, host: str = "127.0.0.1") -> None:
        super().__init__((host, port), _Handler)
        self.sessions = sessions
