import socket
import struct
import threading

import pytest

from brindle.__main__ import main
from brindle.serving.postgres import PostgresServer
from brindle.serving.text import Sessions, TextServer


@pytest.fixture
def served(engine):
    engine.sql("create table t (id i32, name string8, price f64); insert into t values (1, 'alpha', 1.5), (2, null, 2.5)")
    sessions = Sessions(engine)
    servers = [TextServer(sessions, 0), PostgresServer(sessions, 0)]
    for s in servers:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [s.server_address[1] for s in servers]
    for s in servers:
        s.shutdown()
        s.server_close()


def read(sock, n):
    out = b""
    while len(out) < n:
        part = sock.recv(n - len(out))
        assert part
        out += part
    return out


def ask(sock, text):
    raw = text.encode()
    sock.sendall(struct.pack("<Q", len(raw)) + raw)
    status, n = struct.unpack("<BQ", read(sock, 9))
    return status, read(sock, n).decode()


def test_text_protocol(served):
    with socket.create_connection(("127.0.0.1", served[0])) as s:
        assert ask(s, "select id from t")[0] == 1  # no database yet
        assert ask(s, "use d; select id, name, price from t order by id") == (0, "1 alpha 1.500000 \n2 NULL 2.500000 \n")
        assert ask(s, "select nope from t")[0] == 1
        assert ask(s, "select count(*) from t") == (0, "2 \n")


class Pg:
    def __init__(self, port, **parameters):
        self.s = socket.create_connection(("127.0.0.1", port))
        self.s.sendall(struct.pack("!II", 8, 80877103))
        assert read(self.s, 1) == b"N"
        body = b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in parameters.items()) + b"\0"
        self.s.sendall(struct.pack("!II", len(body) + 8, 196608) + body)
        self.until(b"Z")

    def until(self, *kinds):
        out = []
        while not out or out[-1][0] not in kinds:
            kind = read(self.s, 1)
            out.append((kind, read(self.s, struct.unpack("!I", read(self.s, 4))[0] - 4)))
        return out

    def send(self, kind, body=b""):
        self.s.sendall(kind + struct.pack("!I", len(body) + 4) + body)

    def query(self, text):
        self.send(b"Q", text.encode() + b"\0")
        return self.until(b"Z")


def kinds(messages):
    return b"".join(k for k, _ in messages)


def test_postgres_simple(served):
    c = Pg(served[1], user="u", database="d")
    got = c.query("select id, name, price from t order by id;")
    assert kinds(got) == b"TDDCZ" and b"alpha" in got[1][1] and got[3][1] == b"SELECT 2\0"
    assert [struct.unpack("!I", got[0][1][at + 6 : at + 10])[0] for at in (got[0][1].index(b"id\0") + 3, got[0][1].index(b"name\0") + 5, got[0][1].index(b"price\0") + 6)] == [23, 25, 701]
    assert kinds(c.query("select * from nowhere")) == b"EZ"
    assert kinds(c.query("select count(*) from t")) == b"TDCZ"
    assert kinds(c.query(" ; ")) == b"IZ"
    assert kinds(c.query("insert into t values (3, 'x', 0)")) == b"CZ"


def test_postgres_extended(served):
    c = Pg(served[1], user="u", database="d")
    c.send(b"P", b"q\0select id from t where id > $1 and price < $2 order by id\0" + struct.pack("!HI", 1, 23))
    c.send(b"D", b"Sq\0")
    c.send(b"B", b"p\0q\0" + struct.pack("!HH", 0, 2) + struct.pack("!i", 1) + b"0" + struct.pack("!i", 3) + b"9.5" + struct.pack("!H", 0))
    c.send(b"D", b"Pp\0")
    c.send(b"E", b"p\0" + struct.pack("!I", 1))
    c.send(b"E", b"p\0" + struct.pack("!I", 0))
    c.send(b"C", b"Pp\0")
    c.send(b"S")
    assert kinds(c.until(b"Z")) == b"1tT2TDsDC3Z"
    c.send(b"P", b"\0selec\0" + struct.pack("!H", 0))
    c.send(b"B", b"\0\0" + struct.pack("!HHH", 0, 0, 0))
    c.send(b"E", b"\0" + struct.pack("!I", 0))
    c.send(b"S")
    assert kinds(c.until(b"Z")) == b"12EZ"


def test_command_line(engine, capsys):
    engine.sql("create table t (a bool, b date, c timestamp, d decimal(5,2)); insert into t values (true, '2024-01-02', '2024-01-02', 1.5)")
    assert main(["--folder", engine.catalog.folder, "--query", "use d; select * from t"]) == 0
    assert capsys.readouterr().out == "true 2024-01-02 2024-01-02 00:00:00 1.50 \n"
    assert main(["--folder", engine.catalog.folder, "--query", "use nothing"]) == 1
